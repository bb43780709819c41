"""Operator 12, packing: documents laid end to end by prefix sums over partitions, then cut into windows of one length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.llm.common import shared_folder, written
from veilwork.llm.token_blocks import BLOCK, _together, loaded, pack, unpack, unpack_block

#: Ids a segment is cut after, at a document's end; words that a worker remembers (it stays, with them, for what follows).
SEGMENT, REMEMBERED = 1 << 18, 300_000


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Inside, tasks get rows in Arrow batches of at most about ``size``: for an action that ends inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_segments(docs: DataFrame, path: str, model: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """First pass: every whole text's ids and ``end_id``, document after document as each task reads them, as segments.

    No row moves. A segment (``ids`` in the blocks of operator 8) ends with a document and says where its ids begin in
    its partition; what is written fixes the order of the documents for all that follows, whichever executors are lost.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = loaded(model), TaskContext.get().partitionId()
        first, held, keys, sizes, ids = 0, 0, [], [], []
        key_kind = None

        def segment() -> pa.RecordBatch:
            packed = pack(np.concatenate(ids))
            columns = [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([keys], pa.list_(key_kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([packed], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "first", "size", "doc_ids", "lengths", "ids"])

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal key_kind
            for b in batches:
                key_kind = b.schema.field(0).type
                yield b

        for some, texts in _together(typed()):
            got, counts = words.encode_all(texts, end_id, REMEMBERED)
            at = begun = 0
            for key, n in zip(some, counts.tolist(), strict=True):
                keys.append(key)
                sizes.append(n)
                held, at = held + n, at + n
                if held >= SEGMENT:
                    ids.append(got[begun:at])
                    yield segment()
                    first, begun, held, keys, sizes, ids = first + held, at, 0, [], [], []
            ids.append(got[begun:])
        if keys:
            yield segment()

    with batches_of(docs.sparkSession, "4m"):
        rows.mapInArrow(run, f"part int, first bigint, size bigint, doc_ids array<{kind}>, lengths array<bigint>, ids binary").write.parquet(path)


def _located(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``: the ids of all segments before. Partitions' totals are summed up in their order and sent to the
    segments, which don't move: a row of two numbers per partition of the first pass, whatever it holds."""
    segments = spark.read.parquet(path)
    totals = segments.groupBy("part").agg(F.sum("size").alias("_n"))
    totals = totals.select("part", (F.sum("_n").over(W.orderBy("part")) - F.col("_n")).alias("_from"))
    return segments.join(F.broadcast(totals), "part").select((F.col("_from") + F.col("first")).alias("start"), "size", "doc_ids", "lengths", "ids")


def _some(data: bytes, a: int, z: int) -> np.ndarray:
    """Ids a to z of a segment, from the blocks that hold them."""
    return np.concatenate([unpack_block(data, i) for i in range(a // BLOCK, -(-z // BLOCK))])[a % BLOCK :][: z - a]


def _windows(segments: DataFrame, length: int, inner: bool) -> DataFrame:
    """Second pass: what each segment has of each window: whole windows (``inner``), or the parts of windows cut at its ends.

    A row: sequence_id, ``offset`` of its first id in the window, ids, and arrays for the pieces in it: doc_ids,
    starts (of the piece in its document), lengths, doc_tokens, offsets (in the window) and sums (CRC-32 of its ids).
    """
    kind = dict(segments.dtypes)["doc_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                start, size, lengths = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(3)[i].values.to_numpy()
                data, docs = b.column(4)[i].as_buffer(), b.column(2)[i].values
                cuts = np.unique(np.concatenate([[0, size], np.arange(-start % length, size, length)]))
                pairs = [(int(a), int(z)) for a, z in zip(cuts, cuts[1:], strict=False) if (z - a == length) == inner]
                if not pairs:
                    continue
                ends = np.cumsum(lengths)
                begins, whole = ends - lengths, unpack(data) if inner else None
                ids, kept, spans = [], [], []
                for a, z in pairs:
                    n, m = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(begins, z, "left"))
                    lo, hi = np.maximum(begins[n:m], a), np.minimum(ends[n:m], z)
                    ids.append(whole[a:z] if inner else _some(data, a, z))
                    kept.append(np.arange(n, m))
                    raw = memoryview(ids[-1].astype("<u4").tobytes())
                    sums = np.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip((lo - a).tolist(), (hi - a).tolist(), strict=True)], np.int64)
                    spans.append((lo - begins[n:m], hi - lo, lengths[n:m], lo - a + (start + a) % length, sums))
                at = np.array([start + a for a, _ in pairs])
                bounds, cut = ([0, *np.cumsum([len(x) for x in some])] for some in (kept, ids))
                columns = [
                    pa.array(at // length, pa.int64()), pa.array(at % length, pa.int32()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), docs.take(pa.array(np.concatenate(kept)))),
                    *[pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(x).astype(np.int64))) for x in zip(*spans, strict=True)],
                ]
                yield pa.RecordBatch.from_arrays(columns, ["sequence_id", "offset", "ids", "doc_ids", "starts", "lengths", "doc_tokens", "offsets", "sums"])

    return segments.mapInArrow(run, f"sequence_id bigint, offset int, ids array<int>, doc_ids {kind}, starts array<bigint>, lengths array<bigint>, doc_tokens array<bigint>, offsets array<bigint>, sums array<bigint>")


def read_sequences(spark: SparkSession, path: str, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """Packed sequences of segments under ``path``: sequence_id, n_tokens, ids, and arrays for its pieces (see ``_windows``).

    Windows inside a segment are cut where they lie; only the records at the boundaries of segments move, and are put
    together by their window, which holds ``length`` ids at most. All sequences are full but the last; that one is padded
    with ``pad_id`` unless its length is a power of two.
    """
    segments = _located(spark, path)
    whole = _windows(segments, length, True)
    parts = _windows(segments, length, False).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_ids", "starts", "lengths", "doc_tokens", "offsets", "sums"))).alias("p"))
    names = ["ids", "doc_ids", "starts", "lengths", "doc_tokens", "offsets", "sums"]
    parts = parts.select("sequence_id", *[F.flatten(f"p.{c}").alias(c) for c in names])
    out = whole.select("sequence_id", *names).unionByName(parts).withColumn("n_tokens", F.size("ids"))
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(length) - F.col("n_tokens")))
    return out.withColumn("ids", F.when(F.bit_count("n_tokens") > 1, padded).otherwise(F.col("ids"))).select("sequence_id", "n_tokens", *names)


def pack_documents(docs: DataFrame, model: str, length: int = 4096, end_id: int = 2, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents in sequences of ``length`` ids: laid end to end and cut, so only the last one has padding.

    Whole texts are encoded once and their ids written in the shared folder in the order in which tasks read them;
    prefix sums over the partitions' totals give every id its place. A null or empty text has the end id alone, a null
    doc_id is kept, repeated rows are documents of their own, a text longer than a sequence runs over several; an empty
    table gives no sequences.
    """
    path = shared_folder(docs.sparkSession, "segments")
    write_segments(docs, path, model, end_id, id_col, text_col)
    return read_sequences(docs.sparkSession, path, length, pad_id)


def pieces(sequences: DataFrame) -> DataFrame:
    """A row per piece: doc_id, ``start`` in its document, length, ids_crc32, doc_tokens, sequence_id, ``offset`` in it.

    Pieces of a sequence lie without gaps from offset 0.
    """
    each = sequences.select("sequence_id", F.explode(F.arrays_zip("doc_ids", "starts", "lengths", "sums", "doc_tokens", "offsets")).alias("p"))
    return each.select(
        F.col("p.doc_ids").alias("doc_id"), F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"), F.col("p.sums").alias("ids_crc32"),
        F.col("p.doc_tokens").alias("doc_tokens"), "sequence_id", F.col("p.offsets").alias("offset"),
    )


def packed_pieces(docs: DataFrame, model: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents packed (see ``pack_documents``), written in the shared folder while tasks get small batches."""
    sequences = pack_documents(docs, model, length, end_id, id_col=id_col, text_col=text_col)
    with batches_of(docs.sparkSession, "4m"):
        return written(pieces(sequences), "pieces")


def boundary_records(sequences: DataFrame) -> DataFrame:
    """The documents that a cut runs through: sequence_id that begins inside one, doc_id, and ids of it that lie before."""
    first = sequences.select("sequence_id", F.element_at("doc_ids", 1).alias("doc_id"), F.element_at("starts", 1).alias("start"))
    return first.filter("start > 0")


def export_sequences(sequences: DataFrame, name: str = "sequences") -> DataFrame:
    """The sequences written in the shared folder and read back."""
    return written(sequences, name)
