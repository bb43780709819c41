"""Operator 1, URL filters: host and path rules tested through a Bloom filter cascade, without a join."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.common import lower_ascii, written


def split_url(url: Column) -> tuple[Column, Column]:
    """``(host, path)``: host after the first ``://`` up to ``/ ? #`` with A-Z lower-cased, path up to ``? #``.

    A null url and one without ``://`` give two empty strings.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    return (
        lower_ascii(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))),
        F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")),
    )


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``m`` bits in ``words`` and ``k`` probes a key."""

    m: int
    k: int
    words: np.ndarray

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        a, b, out = np.mod(h1, self.m), np.mod(h2, self.m), np.ones(len(h1), bool)
        for i in range(self.k):
            p = (a + i * b) % self.m
            out &= (self.words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


@dataclass(frozen=True)
class Cascade:
    """Alternating levels: the first holds the listed keys, each next one the keys that its predecessor errs on."""

    levels: tuple[Level, ...]

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
        for i, level in enumerate(self.levels):
            ok = level.passes(h1[open_], h2[open_])
            out[open_[~ok]] = i % 2 == 1
            open_ = open_[ok]
        out[open_] = len(self.levels) % 2 == 1
        return out


def hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(7)).alias("h2"))


def _level(keys: DataFrame, n: int, rate: float, at: int) -> Level:
    """Bits are set and joined by OR on the executors; the driver gets ``m / 64`` words, in proportion to ``n``.

    The number of bits is odd and another one at each level ``at``, so keys that meet at one level part at a later one.
    """
    k = max(1, round(math.log2(1 / rate)))
    m = max(1023, math.ceil(1.4427 * n * math.log2(1 / rate))) // 2 * 2 + 1 + 2 * at
    words = np.zeros(m // 64 + 1, np.uint64)
    at = keys.select(F.explode(F.expr(f"transform(sequence(0, {k - 1}), i -> pmod(pmod(h1, {m}L) + i * pmod(h2, {m}L), {m}L))")).alias("p"))
    bits = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    for w, b in bits.collect():
        words[w] = np.uint64(b % (1 << 64))
    return Level(m, k, words)


def _that_pass(keys: DataFrame, level: Level) -> DataFrame:
    @F.pandas_udf("boolean")
    def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(level.passes(h1.to_numpy(np.int64), h2.to_numpy(np.int64)))

    return keys.filter(passes("h1", "h2"))


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 64) -> Cascade:
    """Cascade over ``listed(key)`` that is exact for every key of ``universe(key)`` and every listed key.

    The first level lets about as many foreign keys pass as are listed, so all that follows is as small as the list:
    about ``n (1.44 log2(universe / n) + 4)`` bits. Only the keys that pass the first level are written or shuffled.
    Null keys are ignored; an empty list gives a cascade without levels that contains nothing.
    """
    listed = written(hashed(listed.filter("key is not null").distinct()), "listed")
    n = listed.count()
    if not n:
        return Cascade(())
    universe = hashed(universe.filter("key is not null"))
    total = max(1, universe.agg(F.approx_count_distinct("h1")).first()[0])
    levels = [_level(listed, n, min(0.5, max(n / total, 1e-9)), 0)]
    foreign = _that_pass(universe, levels[0]).join(listed.select("key"), "key", "left_anti").distinct()
    inside, outside = listed, written(foreign, "passed")
    while len(levels) < max_levels:
        errors = outside.count()
        if not errors:
            return Cascade(tuple(levels))
        levels.append(_level(outside, errors, 0.5, len(levels)))
        inside, outside = outside, written(_that_pass(inside, levels[-1]), "passed")
    raise ValueError("the cascade did not settle: two keys share both hashes")


def candidate_keys(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """Array of the keys (host suffix + path prefix) a rule could have, longest first.

    Only the shapes that occur in the list are made (number of host labels, path length), so their number depends on
    the list's shapes, not on the url. Every key is a true suffix and prefix, so every listed one fits the url.
    """
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    made = []
    for labels, size in shapes:
        h, p = F.substring_index(host, ".", -labels), F.substring(path, 1, size)
        made.append(F.struct((F.length(h) + F.length(p)).alias("n"), F.length(h).alias("h"), F.concat(h, p).alias("key")))
    return F.transform(F.sort_array(F.array(*made), asc=False), lambda x: x["key"])


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Each url's host, path, the rule that decides (longest; else null) and its verdict (else ``default``).

    ``rules`` holds ``(host, path, verdict)``; the list is the caller's own, so its size is bounded by the driver that
    wrote it, and what executors receive grows with the list and the logarithm of the corpus only. A host and path
    listed twice must not have two verdicts. Null, empty and odd urls have empty host and path and match a rule only
    if its host and path are empty. Repeated rows and ids are judged one by one; other columns are ignored.
    """
    verdicts = {h + p: v for h, p, v in rules}
    if len({(h, p, v) for h, p, v in rules}) != len(verdicts) or set(verdicts.values()) - {"allow", "block"}:
        raise ValueError("each rule needs one verdict, allow or block")
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    host, path = split_url(F.col("_url"))
    urls = urls.withColumns({"host": host, "path": path}).drop("_url")
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    urls = urls.withColumn("_keys", candidate_keys(rules, F.col("host"), F.col("path")))
    listed = _keys(spark, [h + p for h, p, _ in rules])
    known = build_cascade(listed, urls.select(F.explode("_keys").alias("key")))
    blocked = build_cascade(_keys(spark, [k for k, v in verdicts.items() if v == "block"]), listed)

    @F.pandas_udf("struct<at int, block boolean>")
    def decide(h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        """Index of the first listed candidate, or -1, and whether the list blocks it."""
        width = len(h1.iloc[0]) if len(h1) else 0
        a, b = (np.concatenate(x.to_numpy()).astype(np.int64) if len(x) else np.zeros(0, np.int64) for x in (h1, h2))
        hit = known.contains(a, b).reshape(len(h1), width)
        at = np.where(hit.any(axis=1), hit.argmax(axis=1), -1) if width else np.full(len(h1), -1)
        first = np.arange(len(h1)) * width + np.maximum(at, 0)
        return pd.DataFrame({"at": at.astype(np.int32), "block": blocked.contains(a[first], b[first]) if len(a) else np.zeros(0, bool)})

    urls = urls.withColumn("_d", decide(F.transform("_keys", lambda k: F.xxhash64(k)), F.transform("_keys", lambda k: F.xxhash64(k, F.lit(7)))))
    listed_rule = F.col("_d.at") >= 0
    return urls.select(
        "page_id",
        "host",
        "path",
        F.when(listed_rule, F.expr("get(_keys, _d.at)")).alias("rule"),
        F.when(~listed_rule, F.lit(default)).when(F.col("_d.block"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )


def _keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")
