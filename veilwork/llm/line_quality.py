"""Operator 2, quality rules: word and line statistics of each text, and line frequency across documents. Native only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import SPACES, words, written

SYMBOLS = "#*$%&|<>"


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of every whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    n_repeat_words counts the words that lie in a 3-word window found twice or more in the text. Windows are hashed to
    64 bits; only texts that repeat a window pay for the sort that finds its words. A null text counts as empty.
    All of it is a projection: no shuffle, and no text leaves its row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    clean = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), *keep)
    clean = clean.withColumn("_w", words(F.col("_t")))
    clean = clean.withColumn("n_words", F.size("_w").cast("long"))
    clean = clean.withColumn(
        "_h",
        F.when(
            F.col("n_words") >= 3,
            F.expr("transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))"),
        ).otherwise(F.expr("cast(array() as array<bigint>)")),
    )
    repeated = F.expr(
        """case when size(_h) < 2 or size(array_distinct(_h)) = size(_h) then 0L else
        aggregate(
          array_sort(flatten(transform(
            array(array_sort(transform(_h, (h, i) -> struct(h as h, i as p)))),
            s -> transform(
              filter(s, (x, i) -> (i > 0 and s[greatest(i - 1, 0)].h = x.h)
                               or (i < size(s) - 1 and s[least(i + 1, size(s) - 1)].h = x.h)),
              x -> x.p)))),
          struct(0L as n, -1 as upto),
          (a, p) -> struct(a.n + (p + 3 - greatest(a.upto, p)) as n, p + 3 as upto),
          a -> a.n) end"""
    )
    lines = F.expr("filter(split(_t, '\\n'), x -> x rlike '[^ \\\\t-\\\\r]')")
    clean = clean.withColumn("_l", lines)
    out = clean.select(
        "doc_id",
        *keep,
        "_t",
        "n_words",
        F.length(F.translate("_t", SPACES + " ", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def frequent_lines(
    docs: DataFrame, host_col: str, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """``(lines, frequent)``: one row per line of a document, and the hosts' lines above the limit.

    A line is normalised (lower case, white space squeezed, digits to 0) and hashed. A host's frequency of a line is the
    number of distinct documents that hold it; a document is an id and a text, so repeated rows and a line's repeats in
    one document count once. Lines of every length count, passages too: only their hashes are written and shuffled.
    Partial counts are made before the shuffle, so a host or a line that holds a third of all rows moves as one row per
    document and then one per task. Null texts and lines of white space have none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the whole text is normalised before it is parted, all but its line ends
    clean = F.regexp_replace(F.translate(F.lower(text), "123456789\t\x0b\f\r", "0" * 9 + " " * 4), "  +", " ")
    lines = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.xxhash64(text).alias("copy"),
        F.posexplode(F.split(clean, "\n")).alias("at", "line"),
    )
    lines = lines.withColumn("line", F.trim("line")).filter("line != ''")
    n = F.length("line") - F.length(F.translate("line", " ", "")) + 1
    lines = lines.select("doc_id", "host", "copy", "at", F.xxhash64("line").alias("key"), n.alias("n"))
    lines = written(lines, "lines")
    once = lines.groupBy("host", "key", "doc_id", "copy").agg(F.lit(1).alias("one"))
    frequent = once.groupBy("host", "key").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > max_docs)
    return lines, written(frequent, "frequent")


def line_quality(
    docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
    max_docs: int = 20, min_kept_share: float = 0.3,
) -> DataFrame:
    """One row per document: its counts, ``removed_words`` (words in lines above the limit) and ``kept``.

    A document is rejected when its counts fail (``base_failed``) or when the lines left hold less than
    ``min_kept_share`` of its words. Null hosts form one host of their own; null and empty texts fail the counts;
    repeated rows (same id and text) count once and share a verdict; a null id is an id. An empty table gives an empty
    result. Extra columns are ignored.
    """
    stats = text_statistics(docs, id_col, text_col).withColumn("copy", F.xxhash64("_t")).drop("_t")
    lines, frequent = frequent_lines(docs, host_col, id_col, text_col, max_docs)
    removed = lines.alias("l").join(frequent.alias("f"), F.expr("l.host <=> f.host and l.key = f.key"))
    # the repeats of a row have the same lines at the same places
    removed = removed.groupBy("l.doc_id", "l.copy", "l.at").agg(F.max("l.n").alias("n"))
    removed = removed.groupBy("doc_id", "copy").agg(F.sum("n").alias("removed_words"))
    out = stats.alias("s").join(removed.alias("r"), F.expr("s.doc_id <=> r.doc_id and s.copy = r.copy"), "left")
    out = out.select("s.*", F.coalesce(F.col("r.removed_words"), F.lit(0)).alias("removed_words"))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= min_kept_share * F.col("n_words"))
    return out.withColumn("kept", kept)


def kept_documents(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns whatever their names; texts stay as they are.

    Counts are made once, in ``line_quality``; ids and text hashes of what it rejects are then taken from the rows, so
    rows of one id and one text share a verdict, and rows of one id with other texts, or without id, have their own. Null
    and empty texts go, as they fail the counts. An empty table stays empty.
    """
    gone = line_quality(docs, host_col).filter("not kept").select("doc_id", "copy").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("g.copy"))
    return docs.alias("d").join(gone.alias("g"), same, "left_anti")
