"""Operator 3, SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming check and connected components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from veilwork.llm.common import lower_ascii, words, written
from veilwork.llm.components import connected_components

#: Shingles whose bits are unpacked at a time.
PART = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is set if more than half of the hashes have it; no hashes give zero."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), PART):
        part = np.ascontiguousarray(hashes[i : i + PART], "<i8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprint(hashes: pd.Series) -> pd.Series:
    return pd.Series([majority(np.asarray(h)) for h in hashes], dtype="int64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, keep: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, fp)`` of every whole text, and what ``keep`` names; a null or empty text has fingerprint zero."""
    # words of a text are made once and carried to the hashing expression
    kept = [c.alias(n) for n, c in (keep or {}).items()]
    w = docs.select(F.col(id_col).alias("doc_id"), words(lower_ascii(F.col(text_col))).alias("_w"), *kept)
    runs = F.expr(
        f"case when size(_w) = 0 then cast(array() as array<bigint>) "
        f"when size(_w) < {size} then array(xxhash64(array_join(_w, ' '))) "
        f"else transform(sequence(0, size(_w) - {size}), i -> xxhash64(concat_ws(' ', {', '.join(f'_w[i + {k}]' for k in range(size))}))) end"
    )
    return w.select("doc_id", _fingerprint(runs).alias("fp"), *(keep or {}))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(free: list[int], distance: int, blocks: int) -> list[tuple[int, list[int]]]:
    """For every choice of ``blocks - distance`` blocks of the bits ``free``: its mask, and the bits that it leaves.

    Two fingerprints that differ in ``distance`` of these bits or fewer agree on one of the choices at least.
    """
    edges = [len(free) * i // blocks for i in range(blocks + 1)]
    parts = [free[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for chosen in combinations(range(blocks), blocks - distance):
        mask = sum(1 << bit for i in chosen for bit in parts[i])
        out.append((mask, [bit for i in range(blocks) if i not in chosen for bit in parts[i]]))
    return out


def close_pairs(nodes: DataFrame, distance: int = 2, blocks: int = 5, most: int = 64) -> DataFrame:
    """Every link ``(a, b)``, a < b and once, among distinct fingerprints ``nodes(fp)`` that differ in ``distance`` bits or fewer.

    Each fingerprint is dealt to its blocks: the bits that a choice of ``blocks - distance`` of the blocks holds. Members
    of a block are compared bit by bit, and a pair counts in the first choice on which it agrees. A block of more than
    ``most`` members (many near copies of one text) is dealt again in the same way by the bits that its choice leaves
    open, 64, 25 or 26, 10 or 11, until so few are open that no block can hold more; so every pair is found by its
    blocks, whatever their size, and no task compares more than ``most`` members or the 2 to the open bits that are left.
    """
    # a row carries the number of its choices so far, which says what bits are open, and what the chosen bits were
    open_bits, levels, links = [list(range(64))], [], None
    members = nodes.select("fp", F.lit(0).alias("way"), F.expr("cast(array() as array<bigint>)").alias("key"))
    while members is not None:
        ways = [block_masks(free, distance, blocks) for free in open_bits]
        n = len(ways[0])
        levels.append(f"array({', '.join('array(' + ', '.join(f'{_signed(m)}L' for m, _ in choices) + ')' for choices in ways)})")
        dealt = members.withColumn("masks", F.expr(f"get({levels[-1]}, way)")).select("fp", "way", "key", F.posexplode("masks").alias("choice", "mask"))
        dealt = dealt.select("fp", (F.col("way") * n + F.col("choice")).alias("way"), F.concat("key", F.array(F.col("fp").bitwiseAND(F.col("mask")))).alias("key"))
        sizes = dealt.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        members = written(dealt.join(written(sizes, "sizes"), ["way", "key"]), "blocks")
        left = [free for choices in ways for _, free in choices]
        last = max(map(len, left)) <= max(distance, most.bit_length() - 1) or min(map(len, left)) < blocks
        grouped = (members if last else members.filter(F.col("n") <= most)).groupBy("way", "key").agg(F.collect_list("fp").alias("s"))
        # the choices before the block's own, of this dealing and of those before it
        before = [f"filter(get({masks}, cast(way div {n ** (i + 1)} as int)), (m, j) -> j < way div {n**i} % {n})" for i, masks in enumerate(reversed(levels))]
        near = f"y > x and bit_count(x ^ y) <= {distance} and not exists(before, m -> ((x ^ y) & m) = 0)"
        pairs = grouped.withColumn("before", F.expr(f"concat({', '.join(before)})"))
        pairs = pairs.select(F.explode(F.expr(f"flatten(transform(s, x -> transform(filter(s, y -> {near}), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
        links = pairs if links is None else links.unionByName(pairs)
        open_bits, members = left, members.filter(F.col("n") > most).select("fp", "way", "key")
        if last or members.isEmpty():
            members = None
    return links


def _groups(docs: DataFrame, id_col: str, text_col: str, size: int, distance: int, blocks: int, most: int, keep: dict[str, Column]) -> DataFrame:
    """Per row: doc_id, fp, ``part`` (the smallest fingerprint that its own is linked with), component_id and what ``keep`` names."""
    prints = written(fingerprints(docs, id_col, text_col, size, keep), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
    found = connected_components(close_pairs(nodes.select("fp"), distance, blocks, most))
    parts = nodes.alias("n").join(found.alias("f"), F.expr("n.fp = f.id"), "left")
    parts = written(parts.select("n.fp", "n.id", F.coalesce("f.component", "n.fp").alias("part")), "parts")
    first = parts.groupBy("part").agg(F.min("id").alias("component_id"))
    # both sides of the last join are tables, so that a fingerprint of very many rows can be split
    groups = written(parts.join(first, "part").select("fp", "part", "component_id"), "groups")
    return prints.join(groups, "fp")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 2, blocks: int = 5, most: int = 64
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents link when their fingerprints differ in ``distance`` bits or fewer; component_id is the smallest doc_id
    reachable by links. Equal fingerprints are grouped first, so exact copies cost one node. Null and empty texts have
    fingerprint zero and link like any other. A row without id gets its group's component (null if none in it has an
    id). Repeated rows stay rows; rows of one id with unlike texts are in groups of their own. Other columns are
    ignored, and an empty table gives an empty result.
    """
    found = _groups(docs, id_col, text_col, size, distance, blocks, most, {})
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, distance: int = 2) -> DataFrame:
    """Of each group of near-duplicates one row of ``docs``, with its own columns whatever their names.

    It is the row with the smallest doc_id (rows without one come last), among rows of that id the first by a hash of
    the text and then of all columns, and of rows that are equal in everything one. Rows of one id with unlike texts
    lie in groups of their own, so each has a row that stays. Only hashes are compared; each text moves once. Null and
    empty texts are one group; an empty table stays empty.
    """
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    text, row = F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64(*plain)
    found = _groups(docs, "doc_id", "text", 3, distance, 5, 64, {"text_hash": text, "row_hash": row})
    stay = found.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "row_hash")).alias("k"))
    # one key without nulls, so that the join and the choice among equal rows share one move of the texts
    known = lambda doc_id, *hashes: F.struct(doc_id.isNull(), F.coalesce(doc_id.cast("string"), F.lit("")), *hashes)
    stay = stay.select(known(F.col("k.doc_id"), F.col("k.text_hash"), F.col("k.row_hash")).alias("key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), known(F.col("doc_id"), text, row).alias("key"))
    return rows.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
