"""Operator 4, SentencePiece: offset-preserving normalisation, encoding with byte spans, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

#: Chunks kept in a worker's cache before it starts anew, and bytes of text that leave it in one Arrow batch.
CACHED, BATCH = 300_000, 4_000_000
SPACE = "▁"


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 keys, and the texts that replace them."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]
        self.first = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in range(1, 256) if self._child(0, c) is not None) + b"]") if size else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _child(self, node: int, byte: int) -> int | None:
        at = node ^ self._offset(self.units[node]) ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at`` and its replacement, if there is one."""
        node, found = 0, None
        for i in range(at, len(data)):
            node = self._child(node, data[i])
            if node is None:
                break
            if self.units[node] >> 8 & 1:
                value = self.units[node ^ self._offset(self.units[node])] & 0x7FFFFFFF
                found = i + 1 - at, value
        return found and (found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])])

    def apply(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Mapped bytes, and for each of them (and the end) the offset of its source."""
        if not self.units:
            return data, np.arange(len(data) + 1, dtype=np.int32)
        out, source, done, at = bytearray(), [], 0, 0
        while m := self.first.search(data, at):
            at = m.start()
            if at and data[at] & 0xC0 == 0x80:
                at += 1
                continue
            hit = self.longest(data, at)
            if hit is None:
                at += 1
                continue
            out += data[done:at] + hit[1]
            source += [np.arange(done, at, dtype=np.int32), np.full(len(hit[1]), at, np.int32)]
            done = at = at + hit[0]
        out += data[done:]
        return bytes(out), np.concatenate([*source, np.arange(done, len(data) + 1, dtype=np.int32)])


class Pieces:
    """One model in a worker: normalises, encodes and decodes whole texts."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.spec = proto.normalizer_spec
        if not (self.spec.add_dummy_prefix and self.spec.escape_whitespaces):
            raise ValueError("models with a space before each text are supported")
        if any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces):
            raise ValueError("a piece spans two words, so words can't be encoded one by one")
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.map = CharMap(self.spec.precompiled_charsmap)
        self.sizes = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int32)
        self.unknown = self.lib.unk_id()
        self.end = self.lib.eos_id()
        self.chunk = re.compile(f"[ {SPACE}]+[^ {SPACE}]*")
        self.cache: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text with plain spaces and a space in front, and the source offset of each byte of its escaped form."""
        data, source = self.map.apply(text.encode())
        raw = np.frombuffer(data, np.uint8)
        if self.spec.remove_extra_whitespaces:
            space = raw == 32
            keep = ~(space & np.concatenate([[True], space[:-1]]))
            if len(keep):
                keep[np.flatnonzero(~space).max(initial=-1) + 1 :] = False
            kept = np.flatnonzero(keep)
            data, source = raw[kept].tobytes(), np.concatenate([source[kept], source[-1:]])
            raw = raw[kept]
        if not data:
            return "", np.zeros(1, np.int32)
        wide = np.repeat(source[:-1], np.where(raw == 32, 3, 1))
        return " " + data.decode(), np.concatenate([np.full(3, source[0], np.int32), wide, source[-1:]])

    def _learn(self, chunks: list[str]) -> None:
        """Each chunk's ids as bytes. A space before nothing is a piece too, though the library drops it from an empty text."""
        found = self.lib.encode([c[1:] for c in chunks], num_threads=1)
        found = [ids or [self.lib.piece_to_id(SPACE)] for ids in found]
        flat = np.array([i for ids in found for i in ids], np.int32).tobytes()
        at = 0
        for c, ids in zip(chunks, found, strict=True):
            self.cache[c] = flat[at : (at := at + 4 * len(ids))]

    def _sizes(self, chunks: list[str], ids: np.ndarray) -> np.ndarray:
        """Bytes of each piece in the escaped text; the library tells those of unknown pieces."""
        if not (ids == self.unknown).any():
            return self.sizes[ids]
        return np.array([len(p.piece.encode()) for c in chunks for p in self.lib.encode(c[1:], out_type="immutable_proto").pieces], np.int32)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the end id, and each piece's span in the bytes of the original text (the end id's is empty)."""
        normal, source = self.normalise(text)
        chunks = self.chunk.findall(normal)
        new = set(chunks).difference(self.cache)
        if new:
            if len(self.cache) + len(new) > CACHED:
                self.cache.clear()
                new = set(chunks)
            self._learn(list(new))
        ids = np.frombuffer(b"".join([self.cache[c] for c in chunks]), np.int32)
        starts = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self._sizes(chunks, ids), out=starts[1:])
        if starts[-1] != len(source) - 1:
            raise ValueError(f"pieces don't cover the text {text[:200]!r}")
        at = source[starts].astype(np.int32)
        return np.append(ids, np.int32(self.end)), at, np.append(at[1:], at[-1:])


_LOADED: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def encode_decode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, ``ids`` (end id last), ``starts`` and ``ends`` (bytes of the original text), ``decoded``.

    ``model`` holds a SentencePiece model's bytes (some hundred KB; it goes along with the tasks). Whole texts are
    normalised with source offsets and cut before each run of spaces, where no piece reaches across, so a word's
    pieces are looked up once per worker in a cache of bounded size. A null text counts as empty and has the end id
    alone. Rows are independent: repeated rows and ids stay, very long texts leave in a batch of their own, other
    columns are ignored. No shuffle.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = loaded(model)

        def batch(rows: list) -> pa.RecordBatch:
            ids, starts, ends = ([r[i] for r in rows] for i in (1, 2, 3))
            decoded = m.lib.decode([i.tolist() for i in ids], num_threads=1)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], key), _lists(ids), _lists(starts), _lists(ends), pa.array(decoded, pa.string())],
                ["doc_id", "ids", "starts", "ends", "decoded"],
            )

        rows, size = [], 0
        key = pa.int64()
        for b in batches:
            key = b.schema.field(0).type
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                rows.append((i, *m.encode(text)))
                size += len(text)
                if size >= BATCH:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>, decoded string"
    )


def digests(encoded: DataFrame) -> DataFrame:
    """What the contract asks of each document, from the operator's ids and decoded texts."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
