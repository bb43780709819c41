"""Operator 8, token ids in patched frame-of-reference blocks: encode, write files in document order, read them back."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.llm.common import shared_folder

#: Ids of a block; ids a segment is cut after (at a document's end); the file's mark.
BLOCK, SEGMENT, MAGIC = 128, 1 << 15, b"PFOR"
#: Words that a worker remembers, bytes of text that are encoded together, and bytes of text in a stretch of the order.
KNOWN, TOGETHER, STRETCH = 600_000, 4 << 20, 64 << 20


# --- the format -------------------------------------------------------------------------------------------------------


def pack(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """One segment: mark, count of ids and blocks, block index, then the blocks.

    The index has for each block where it starts. A block is its minimum (u4), width (u1), number of exceptions (u1),
    the values less the minimum packed at that width, and the exceptions' places (u1 each) and whole values (u4 each).
    The width is the smallest that holds ``percentile`` of the block; the values that it can't hold are exceptions.
    """
    n = len(ids)
    count = -(-n // BLOCK)
    grid = np.zeros((count, BLOCK), np.uint32)
    grid.reshape(-1)[:n] = ids
    if n % BLOCK:
        grid[-1, n % BLOCK :] = ids[-1]
    low = grid.min(axis=1)
    grid -= low[:, None]
    need = np.frexp(grid.astype(np.float64))[1].astype(np.uint8)  # bits of each value
    place = int(np.ceil(percentile * BLOCK)) - 1
    width = np.partition(need, place, axis=1)[:, place]
    odd = need > width[:, None]
    packed, exceptions = BLOCK * width.astype(np.int64) // 8, odd.sum(axis=1)
    starts = np.concatenate([[0], np.cumsum(6 + packed + 5 * exceptions)])
    body = np.empty(starts[-1], np.uint8)
    body[starts[:-1, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(count, 4)
    body[starts[:-1] + 4], body[starts[:-1] + 5] = width, exceptions
    row, col = np.nonzero(odd)
    values, grid[row, col] = grid[row, col].astype("<u4"), 0
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        bits = np.unpackbits(grid[at].astype("<u4").view(np.uint8).reshape(len(at), BLOCK, 4), axis=2, count=int(w), bitorder="little")
        body[starts[at, None] + 6 + np.arange(BLOCK * int(w) // 8)] = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
    first, nth = starts[row] + 6 + packed[row], np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
    body[first + nth] = col
    body[(first + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = values.view(np.uint8).reshape(-1, 4)
    return MAGIC + np.array([n, count], "<u4").tobytes() + starts.astype("<u4").tobytes() + body.tobytes()


def unpack_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block alone, found through the index."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, count = np.frombuffer(data, "<u4", 2, 4)
    at = 12 + 4 * (int(count) + 1) + int(np.frombuffer(data, "<u4", 1, 12 + 4 * block)[0])
    low, width, odd = int.from_bytes(data[at : at + 4], "little"), data[at + 4], data[at + 5]
    size = BLOCK * width // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at + 6), bitorder="little").reshape(BLOCK, width)
    out = (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    out[np.frombuffer(data, np.uint8, odd, at + 6 + size)] = np.frombuffer(data, "<u4", odd, at + 6 + size + odd)
    return (out + np.uint32(low))[: int(n) - block * BLOCK]


def unpack(data: bytes) -> np.ndarray:
    """All ids of a segment; blocks of one width are unpacked together."""
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a segment of token ids")
    n, count = map(int, np.frombuffer(data, "<u4", 2, 4))
    raw = np.frombuffer(data, np.uint8)
    at = np.frombuffer(data, "<u4", count, 12).astype(np.int64) + 12 + 4 * (count + 1)
    low = raw[at[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width, odd = raw[at + 4], raw[at + 5]
    out = np.zeros((count, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        size = BLOCK * int(w) // 8
        bits = np.unpackbits(raw[at[rows, None] + 6 + np.arange(size)], axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
        if w:
            full = np.zeros((len(rows), BLOCK, 4), np.uint8)
            full[:, :, : -(-int(w) // 8)] = np.packbits(bits, axis=2, bitorder="little")
            out[rows] = full.reshape(len(rows), -1).view("<u4")
    row = np.repeat(np.arange(count), odd)
    first, nth = at[row] + 6 + BLOCK * width[row].astype(np.int64) // 8, np.arange(len(row)) - np.repeat(np.cumsum(odd, dtype=np.int64) - odd, odd)
    values = raw[(first + odd[row] + 4 * nth)[:, None] + np.arange(4)]
    out[row, raw[first + nth]] = values.view("<u4")[:, 0]
    return (out + low[:, None]).reshape(-1)[:n]


# --- the tokenizer ----------------------------------------------------------------------------------------------------


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, end to end."""
    at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    at += np.arange(len(at))
    return flat[at]


class Words:
    """A tokenizer that drops white space, in a worker: the distinct words of many texts are looked up once, by Arrow's codes.

    A word of Latin letters and then ASCII marks other than apostrophes is the ids of its lower-case letters and those of
    its marks, as the tokenizer parts a word there. Any other word goes to the library whole. What was learned is kept,
    up to ``KNOWN`` words unless said otherwise.
    """

    plain = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"

    def __init__(self, model: str):
        self.lib = tokenizers.Tokenizer.from_str(model)
        self.lib.encode_special_tokens = False
        # for groups of lower-case words: parted at spaces only, which is all there is to part
        spaced = json.loads(model)
        spaced["normalizer"] = None
        spaced["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        self.spaced = tokenizers.Tokenizer.from_str(json.dumps(spaced))
        self.ends = np.array([(self.lib.id_to_token(i) or "").endswith("</w>") for i in range(self.lib.get_vocab_size())])
        self._forget()

    def _forget(self) -> None:
        """The known words, and where the ids of each begin in ``flat``. Arrow looks them up without an object of Python for each."""
        self.known, self.flat, self.starts = pa.array([""], pa.large_string()), np.zeros(1 << 20, np.uint32), np.zeros(1 << 17, np.int64)

    def _add(self, words: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        n, at = len(self.known), int(self.starts[len(self.known)])
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[at : at + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(words)] = at + ends
        self.known = pa.concat_arrays([self.known, words])

    def _learn_whole(self, words: pa.Array) -> None:
        found = [e.ids for e in self.lib.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        self._add(words, np.array([i for e in found for i in e], np.uint32), np.cumsum([len(e) for e in found], dtype=np.int64))

    def _learn_letters(self, words: pa.Array) -> None:
        """Many words at a time: each ends with the first id that ends a word, which the number of words confirms."""
        for a in range(0, len(words), 1 << 14):
            part = words[a : a + (1 << 14)]
            names = part.to_numpy(zero_copy_only=False).tolist()
            found = self.spaced.encode_batch_fast([" ".join(names[i : i + 64]) for i in range(0, len(names), 64)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                self._add(part, ids, ends)
            else:
                self._learn_whole(part)

    def _places(self, letters: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word, once all are known: of letters alone, and of others."""
        words = [letters, others]
        found = pc.index_in(pa.concat_arrays(words), value_set=self.known)
        places = found.fill_null(-1).to_numpy().astype(np.int64)
        both = places[: len(letters)], places[len(letters) :]
        for at, some, learn in zip(both, words, (self._learn_letters, self._learn_whole), strict=True):
            if len(new := np.flatnonzero(at < 0)):
                coded = some.take(pa.array(new)).dictionary_encode()
                at[new] = len(self.known) + coded.indices.to_numpy()
                learn(coded.dictionary)
        return both

    def encode_all(self, texts: pa.Array, end_id: int, most: int = KNOWN) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id last, and the number of each text's. Starts anew with over ``most`` words."""
        if len(self.known) > most:
            self._forget()
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        words, until = coded.dictionary, split.offsets.to_numpy()
        parts = pc.extract_regex(words, self.plain)
        # of its letters, its marks and the whole word, what a word doesn't have is empty
        letters, marks = pc.utf8_lower(pc.struct_field(parts, "letters")).fill_null(""), pc.struct_field(parts, "marks").fill_null("")
        letters, others = self._places(letters, pa.concat_arrays([marks, pc.if_else(parts.is_valid(), "", words)]))
        places = np.stack([letters, others[: len(words)], others[len(words) :]], axis=1)
        sizes = self.starts[places + 1] - self.starts[places]
        ids, sizes = gathered(self.flat, self.starts[places].ravel(), sizes.ravel()), sizes.sum(axis=1)
        ids, sizes = np.append(ids, np.uint32(end_id)), np.append(sizes, 1)
        order = np.insert(coded.indices.to_numpy(), until[1:] - until[0], len(words))
        upto = np.concatenate([[0], np.cumsum(sizes[order])])
        ends = upto[until[1:] - until[0] + np.arange(1, len(texts) + 1)]
        return gathered(ids, (np.cumsum(sizes) - sizes)[order], sizes[order]), np.diff(ends, prepend=0)

    def encode(self, text: str) -> list[int]:
        """The ids of one text, without an end id."""
        return self.encode_all(pa.array([text]), 0)[0][:-1].tolist()


_LOADED: dict[str, Words] = {}


def loaded(model: str) -> Words:
    if model not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _LOADED.clear()
        _LOADED[model] = Words(model)
    return _LOADED[model]


# --- the jobs ---------------------------------------------------------------------------------------------------------

def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts in pieces of about ``TOGETHER`` bytes, or of one text that is longer."""
    keys, texts, held = [], [], 0
    for b in batches:
        size = pc.coalesce(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff((held + np.cumsum(size)) // TOGETHER, prepend=held // TOGETHER)) + 1
        for a, z in zip([0, *cuts], [*cuts, len(b)], strict=True):
            keys += b.column(0)[a:z].to_pylist()
            texts.append(b.column(1)[a:z])
            if z in cuts:
                yield keys, pa.concat_arrays(texts)
                keys, texts = [], []
        held = (held + int(size.sum())) % TOGETHER
    if keys:
        yield keys, pa.concat_arrays(texts)


SEGMENTS = "part int, number int, first_start bigint, doc_ids array<bigint>, lengths array<bigint>, ids binary"


def write_tokens(docs: DataFrame, path: str, model: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every whole text's ids and ``end_id`` in ascending doc_id order as segments under ``path``.

    Texts are dealt by range of doc_id, as many stretches as their bytes ask for, so each task encodes and writes one
    stretch of the order as it reads it. A segment ends with the document in which it passes its size, so a document is
    in one segment. The rows are Spark's own files, which tasks of lost executors leave no halves of. Rows with equal ids
    lie together in the order of a hash of their texts, over several stretches if they are many; a null id comes first; a
    null text has the end id alone.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // STRETCH))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(n, F.col("doc_id"), tie, F.rand(1)).sortWithinPartitions(F.col("doc_id"), tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = loaded(model), TaskContext.get().partitionId()
        number, start, keys, sizes, ids = 0, 0, [], [], []

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([pack(np.concatenate(ids))], pa.binary())],
                ["part", "number", "first_start", "doc_ids", "lengths", "ids"],
            )

        held = 0
        for some, texts in _together(batches):
            got, counts = words.encode_all(texts, end_id)
            at = begun = 0
            for key, n in zip(some, counts.tolist(), strict=True):
                keys.append(key)
                sizes.append(n)
                held, at = held + n, at + n
                if held >= SEGMENT:
                    ids.append(got[begun:at])
                    yield segment()
                    number, start, begun, held, keys, sizes, ids = number + 1, start + held, at, 0, [], [], []
            ids.append(got[begun:])
        if keys:
            yield segment()

    ordered.mapInArrow(run, SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, ``start`` (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ``ids``.

    Each segment is unpacked by itself. A stretch's ids are counted from the segments' lengths, and the stretches'
    totals (one row each) give where each starts.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = segments.groupBy("part").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("_n"))
    totals = totals.withColumn("_from", F.sum("_n").over(W.orderBy("part")) - F.col("_n")).drop("_n")
    kind = "part int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, first, keys, lengths, data in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                ids = unpack(data.as_buffer()).astype("<u4")
                at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * c]) for a, c in zip(at, at[1:], strict=False)]
                columns = [pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(at[:-1] + first), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["part", "doc_id", "local", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = segments.select("part", "first_start", "doc_ids", "lengths", "ids").mapInArrow(run, kind)
    out = rows.join(totals, "part")
    return out.select("doc_id", (F.col("_from") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_table(docs: DataFrame, model: str, end_id: int = 1) -> DataFrame:
    """Write the ids of ``docs`` in the shared folder and give what is read back, without the ids themselves."""
    path = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, model, end_id)
    return read_tokens(docs.sparkSession, path, with_ids=False)
