"""Operator 6, mixing sources to target weights: a low-discrepancy schedule over equal-token blocks. Native only."""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.llm.common import written

#: The golden ratio's part after the point as a 40-bit binary fraction (odd, so the points of 2^40 slots are distinct).
GOLDEN, BITS = 679_535_556_991, 40


@dataclass(frozen=True)
class Mix:
    """``documents``: a row per document with what the mix takes of it; ``schedule``: a row per slot, in training order."""

    documents: DataFrame
    schedule: DataFrame


def golden_point(n: Column) -> Column:
    """The n-th point of the golden-ratio sequence in [0, 1), in whole numbers that don't overflow below 2^40."""
    size = F.lit(1 << BITS)
    high, low = F.shiftright(n, 20), n.bitwiseAND(F.lit((1 << 20) - 1))
    return F.pmod(F.pmod(high * GOLDEN, size) * (1 << 20) + low * GOLDEN, size) / F.lit(float(1 << BITS))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``(source, source_size, target)``: targets share ``share`` of all sizes by weight and stop at ``cap`` times a source's size.

    The excess is reshared by weight until none is above: sources are ordered by the level at which they are full, and
    the first one that isn't full at the level of the rest fixes it. One row per source; this table is small.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(rank, F.lit(len(weights))) + 1)
    totals = totals.withColumn("w", w).withColumn("full", F.lit(float(cap)) * F.col("source_size"))
    order = W.orderBy(F.col("full") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(order), F.lit(0.0))
    heavy = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(order), F.lit(0.0))
    totals = totals.withColumn("level", left / heavy)
    fits = F.when(F.col("level") * F.col("w") <= F.col("full"), F.struct(F.col("full") / F.col("w"), "level"))
    totals = totals.withColumn("level", F.min(fits).over(everything)["level"])
    target = F.least("full", F.coalesce(F.col("level") * F.col("w"), F.col("full")))
    return totals.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: Column | None = None,
) -> Mix:
    """Mix all documents: sources (by code point, null last) weigh ``weights``, repeating.

    A source's documents are shuffled by a keyed hash, laid end to end and cut into blocks of equal words (a quarter of
    a mean document). Slot n's golden-ratio point falls into one source's part of the cumulative weights; slots are
    ranked per source, and rank j takes the source's block j, round after round, up to the source's target, so no
    document is taken more than ``cap`` times (rounded up to a whole cap). Slots that the points leave open come last.
    Prefix sums and ranks run over parts of a source (by hash, by slot number) with the parts' totals added, so a
    source of a third of all rows is spread. Null or empty texts have size 0 and are taken 0 times; a null source is a
    source; rows with equal ids are documents of their own, next to each other; an empty table gives empty results.
    ``row`` names rows, where ids may repeat; it is carried to ``documents``.
    """
    text, n_words = F.coalesce(F.col(text_col), F.lit("")), F.lit("[^ \\t-\\r]+")
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, n_words).cast("long").alias("size"), (F.lit(0).cast("long") if row is None else row).alias("row"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    sizes = written(sizes.withColumn("key", key), "sizes")
    n_docs, n_all = sizes.agg(F.count(F.lit(1)), F.sum("size")).first()
    step = max(1, round((n_all or 0) / max(1, n_docs) / 4))
    bits = min(28, isqrt(n_docs).bit_length())  # about as many parts of a source as rows in a part
    part = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    sizes = sizes.withColumn("part", F.shiftright(part, 28 - bits))

    targets = source_targets(sizes, weights, share, cap)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("rounds", rounds.cast("long"))
    targets = targets.withColumn("rest", F.round(F.col("target") - F.col("rounds") * F.col("source_size")).cast("long"))
    targets = targets.withColumn("blocks", F.ceil(F.col("source_size") / step).cast("long"))
    targets = targets.withColumn("slots", (F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / step)).cast("long"))
    targets = written(targets, "targets")

    parts = sizes.groupBy("source", "part").agg(F.sum("size").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("source").orderBy("part")) - F.col("_n")
    parts = parts.withColumn("_from", before).alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source"))
    parts = parts.select("p.source", "p.part", "p._from", "t.source_size", "t.target")
    inside = F.sum("size").over(W.partitionBy("source", "part").orderBy("key", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, 0))
    laid = sizes.withColumn("_to", inside).alias("d").join(parts.alias("p"), F.expr("d.source <=> p.source and d.part = p.part"))
    laid = laid.select("d.doc_id", "d.row", "d.source", "d.size", "p.source_size", "p.target", (F.col("p._from") + F.col("d._to") - F.col("d.size")).alias("start"))
    schedule = _schedule(targets, step)
    pieces = laid.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {step}, (start + size - 1) div {step})")))
    low, high = F.greatest(F.col("d.start"), F.col("d.block") * step), F.least(F.col("d.start") + F.col("d.size"), F.col("d.block") * step + F.col("s.words"))
    taken = pieces.alias("d").join(schedule.alias("s"), F.expr("d.source <=> s.source and d.block = s.block"), "left")
    taken = taken.withColumn("taken", F.when(F.col("s.words").isNull(), F.lit(0)).otherwise(F.greatest(high - low, F.lit(0))))
    taken = taken.groupBy("d.doc_id", "d.row", "d.source", "d.start", "d.size", "d.source_size", "d.target").agg(F.sum("taken").alias("taken"))
    names = ["doc_id", "row", "source", "size", "source_size", "target"]
    empty = laid.filter("size = 0").select(*names, F.lit(0).cast("long").alias("taken"))
    return Mix(taken.select(*names, F.col("taken").cast("long").alias("taken")).unionByName(empty), schedule)


def _schedule(targets: DataFrame, step: int) -> DataFrame:
    """``(slot, source, block, words)``: which block each slot takes, and how many of its words (the last one in part)."""
    spark = targets.sparkSession
    n_sources, n = targets.agg(F.count(F.lit(1)), F.sum("slots")).first()
    n, cells = n or 0, 1 << max(6, (4 * n_sources).bit_length())
    by_source = W.orderBy(F.col("source").isNull(), "source")
    spans = targets.filter("slots > 0").withColumn("hi", F.sum("slots").over(by_source) / F.lit(float(max(1, n))))
    spans = spans.withColumn("lo", F.coalesce(F.lag("hi").over(by_source), F.lit(0.0)))
    spans = spans.withColumn("cell", F.explode(F.expr(f"sequence(cast(floor(lo * {cells}) as int), least({cells - 1}, cast(floor(hi * {cells}) as int)))")))
    points = spark.range(n).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells).cast("int"))
    hits = points.join(spans, "cell").filter("u >= lo and u < hi").select("slot", "source", F.shiftright("slot", isqrt(n).bit_length()).alias("chunk"))
    hits = written(hits, "slots")
    chunks = hits.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    chunks = chunks.withColumn("_from", F.sum("_n").over(W.partitionBy("source").orderBy("chunk")) - F.col("_n"))
    inside = F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = hits.withColumn("_at", inside).alias("h").join(chunks.alias("c"), F.expr("h.source <=> c.source and h.chunk = c.chunk"))
    ranked = ranked.select("h.source", "h.slot", (F.col("c._from") + F.col("h._at")).alias("rank"))
    got = hits.groupBy("source").agg(F.count(F.lit(1)).alias("_got"))
    short = targets.alias("t").join(got.alias("g"), F.expr("t.source <=> g.source"), "left").select("t.source", "t.slots", F.coalesce("g._got", F.lit(0)).alias("_got"))
    late = short.filter("slots > _got").select("source", F.explode(F.expr("sequence(_got, slots - 1)")).alias("rank"))
    late = late.select("source", (F.lit(n) + F.col("rank")).alias("slot"), "rank")
    facts = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    all_ = ranked.unionByName(late).withColumn("_salt", F.pmod("rank", F.lit(16)).cast("int")).alias("r")
    all_ = all_.join(facts.alias("t"), F.expr("r.source <=> t.source and r._salt = t._salt")).filter("r.rank < t.slots")
    turn, block = F.expr("r.rank div t.blocks"), F.expr("r.rank % t.blocks")
    end = F.when(turn < F.col("t.rounds"), F.col("t.source_size")).otherwise(F.col("t.rest"))
    return all_.select("r.slot", "r.source", block.alias("block"), F.least(F.lit(step), end - block * step).alias("words"))


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs``, with their own columns whatever their names, as often as the mix takes them.

    A document is repeated for each whole time that it is taken; where a source's last round ends inside a document,
    its last copy has the words up to there (with what stands before each) and ``n_chars`` says so. Rows that the mix
    takes no word of go, null and empty texts among them. Rows are written with a number each, so repeated rows and rows
    of one id are taken one by one and no word is lost. An empty table stays empty.
    """
    columns = docs.columns
    numbered = written(docs.select(F.struct(*columns).alias("row"), F.monotonically_increasing_id().alias("number")), "rows")
    facts = numbered.select("row.doc_id", "row.source", "row.text", "number")
    mix = mix_sources(facts, row=F.col("number"), **options).documents.filter("taken > 0").select("row", "size", "taken")
    taken = numbered.alias("r").join(mix.alias("m"), F.expr("r.number = m.row"))
    part = F.explode(F.expr("transform(sequence(0, cast((m.taken - 1) div m.size as int)), i -> least(m.size, m.taken - i * m.size))"))
    taken = taken.select("r.row", F.col("m.size").alias("size"), part.alias("n"))
    cut = F.array_join(F.slice(F.split("row.text", "(?<=[^ \\t-\\r])(?=[ \\t-\\r])"), F.lit(1), F.col("n").cast("int")), "")
    taken = taken.withColumn("text", F.when(F.col("n") < F.col("size"), cut).otherwise(F.col("row.text")))
    made = {"text": F.col("text")}
    if "n_chars" in columns:
        made["n_chars"] = F.when(F.col("n") < F.col("size"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return taken.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in columns])
