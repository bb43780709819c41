"""Operator 7, embedding near-dedup: a navigable small-world graph per shard, audited beams, cosine check, components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import written
from veilwork.llm.components import connected_components

#: Queries walked at a time with a beam of up to ``WIDE`` entries, and with a wider one; entries that each opens in one
#: step, at least and as a part of the beam; nodes that are inserted together; pairs compared at a time, few enough for a
#: processor's cache.
TOGETHER, WIDE, FEWER, OPENED, PART, INSERTED, VERIFIED = 256, 512, 48, 4, 8, 256, 1 << 12


@dataclass
class Graph:
    """One shard: unit vectors, and for each level from the top the links of its nodes (-1: none), which are the first ones."""

    vectors: np.ndarray
    levels: list[np.ndarray]


def _diverse(near: np.ndarray, sims: np.ndarray, vectors: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1: none), at most ``m`` that are nearer to the node than to one kept before.

    Places that stay free go to the nearest of the others.
    """
    n, width = near.shape
    kept = np.zeros((n, width), bool)
    unit = vectors[np.maximum(near, 0)]
    for r in range(width):
        between = np.einsum("nd,nkd->nk", unit[:, r], unit[:, :r]) if r else np.zeros((n, 0), np.float32)
        blocked = (kept[:, :r] & (between >= sims[:, r : r + 1])).any(axis=1)
        kept[:, r] = (near[:, r] >= 0) & ~blocked & (kept[:, :r].sum(axis=1) < m)
    order = np.argsort(np.where(kept, 0, np.where(near >= 0, 1, 2)) * width + np.arange(width), axis=1)[:, :m]
    return np.take_along_axis(near, order, axis=1)


def _widest(rows: list[list[int]], vectors: np.ndarray, of: list[int], width: int) -> None:
    """Cut the links of the nodes ``of`` to ``width`` diverse ones, in place."""
    long = max(len(rows[i]) for i in of)
    near = np.array([rows[i] + [-1] * (long - len(rows[i])) for i in of])
    sims = np.where(near >= 0, np.einsum("nd,nkd->nk", vectors[of], vectors[np.maximum(near, 0)]), -2)
    order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
    for i, row in zip(of, _diverse(np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1), vectors, width).tolist(), strict=True):
        rows[i] = [j for j in row if j >= 0]


def _level(vectors: np.ndarray, above: list[np.ndarray], m: int, ef: int) -> np.ndarray:
    """Links on one level. Nodes are inserted in order, some at a time: a search of the graph so far, and of those that are

    inserted together, gives each its candidates; it links with ``m`` diverse ones of them, and they link back. A node
    keeps 2 m to 3 m links, and a node that can't be reached from the first one gets a link from its nearest node that can.
    """
    n, width = len(vectors), 3 * m
    rows: list[list[int]] = [[] for _ in range(n)]
    table, a = np.full((n, width), -1, np.int32), 0
    while a < n:
        b = min(n, a + min(INSERTED, max(32, a)))
        sims = vectors[a:b] @ vectors[a:b].T
        sims[np.triu_indices(b - a)] = -2
        near = np.broadcast_to(np.arange(a, b), sims.shape)
        if a:
            start = _descend(vectors, above, vectors[a:b])
            found, s = _walk(vectors[:a], table[:a], vectors[a:b], np.where(start < a, start, 0), min(ef, a))
            near, sims = np.concatenate([near, found], axis=1), np.concatenate([sims, np.where(found >= 0, s, -2)], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * m]
        near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
        changed = set(range(a, b))
        for i, row in enumerate(_diverse(np.where(sims > -1.5, near, -1), sims, vectors, m).tolist(), a):
            rows[i] += [j for j in row if j >= 0]
            for j in rows[i]:
                rows[j].append(i)
            changed.update(rows[i])
        if long := [i for i in changed if len(rows[i]) > width]:
            _widest(rows, vectors, long, 2 * m)
        for i in changed:
            table[i] = -1
            table[i, : len(rows[i])] = rows[i]
        a = b
    seen = np.zeros(n, bool)
    todo = [0] if n else []
    while True:
        seen[todo] = True
        while todo:
            new = [j for j in rows[todo.pop()] if not seen[j]]
            seen[new] = True
            todo += set(new)
        left = np.flatnonzero(~seen)
        if not len(left):
            break
        reached = np.flatnonzero(seen)
        rows[int(reached[np.argmax(vectors[reached] @ vectors[left[0]])])].append(int(left[0]))
        todo = [int(left[0])]
    table = np.full((n, max(map(len, rows), default=0)), -1, np.int32)
    for i, row in enumerate(rows):
        table[i, : len(row)] = row
    return table


def build(vectors: np.ndarray, m: int = 12, ef: int = 48) -> tuple[Graph, np.ndarray]:
    """Graph over unit vectors, and the place that each of its nodes had among them.

    A node is on each next level with a chance of 1 in ``m`` (by its place, so reruns agree); nodes of upper levels come
    first on the levels below, so what a level finds are entries of the next one.
    """
    u = (np.arange(len(vectors), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(float) / 2**53
    height = np.minimum(np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(m)).astype(int), 6)
    order = np.argsort(-height, kind="stable")
    vectors, levels = np.ascontiguousarray(vectors[order], np.float32), []
    for h in range(int(height.max(initial=0)), -1, -1):
        levels.append(_level(vectors[: int((height >= h).sum())], levels, m, ef))
    return Graph(vectors, levels), order


def _walk(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Beams of ``ef`` nodes (best first, -1: none) and their cosines, walked along the links for all queries in step.

    ``seen`` and ``met`` have ``n + 1`` places for each query, the last one for links that aren't there: -1 is the last
    place of the query before.
    """
    q, n = len(queries), len(vectors)
    ids, sims, opened = np.full((q, ef), -1, np.int64), np.full((q, ef), -np.inf, np.float32), np.zeros((q, ef), bool)
    active, step = np.arange(q), min(ef, max(OPENED, ef // PART))
    first, seen, met = np.arange(q + 1) * (n + 1), np.zeros(q * (n + 1), bool), np.zeros(q * (n + 1), bool)
    seen[n :: n + 1] = True
    reach = first[:q, None] + start
    while len(active):
        met[reach] = True
        new = np.flatnonzero(met > seen)
        met[reach] = False
        seen[new] = True
        row = np.repeat(np.arange(q), np.diff(np.searchsorted(new, first)))
        node, s = new - first[row], np.empty(len(new), np.float32)
        for a in range(0, len(new), VERIFIED):
            part = slice(a, a + VERIFIED)
            s[part] = np.einsum("nd,nd->n", queries.take(row[part], axis=0), vectors.take(node[part], axis=0))
        count = np.bincount(row, minlength=q)[active]
        width = int(count.max(initial=0))
        if width:
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(np.arange(len(active)), count)
            near, close = np.full((len(active), width), -1, np.int64), np.full((len(active), width), -np.inf, np.float32)
            near[at, place], close[at, place] = node, s
            all_ids, all_sims = np.concatenate([ids[active], near], axis=1), np.concatenate([sims[active], close], axis=1)
            all_open = np.concatenate([opened[active], np.zeros(near.shape, bool)], axis=1)
            keep = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids[active] = np.take_along_axis(all_ids, keep, axis=1)
            sims[active] = np.take_along_axis(all_sims, keep, axis=1)
            opened[active] = np.take_along_axis(all_open, keep, axis=1)
        closed = np.where(opened[active], np.inf, -sims[active])
        top = np.argsort(closed, axis=1, kind="stable")[:, :step]
        fine = np.take_along_axis(closed, top, axis=1) < np.inf
        go, at = np.nonzero(fine)
        row, col = active[go], top[go, at]
        opened[row, col] = True
        reach = first[row, None] + links.take(ids[row, col], axis=0)
        active = active[fine.any(axis=1)]
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def _descend(vectors: np.ndarray, levels: list[np.ndarray], queries: np.ndarray, narrow: int = 8) -> np.ndarray:
    """Up to ``narrow`` nodes near each query, found from the top level down."""
    start = np.zeros((len(queries), 1), np.int64)
    for links in levels:
        found, _ = _walk(vectors[: len(links)], links, queries, start, min(narrow, len(links)))
        start = np.where(found >= 0, found, found[:, :1])
    return start


def beams(graph: Graph, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` nearest nodes found for each query (-1: none): down the upper levels with narrow beams, then the ground level."""
    start = _descend(graph.vectors, graph.levels[:-1], queries)
    return _walk(graph.vectors, graph.levels[-1], queries, start, min(ef, len(graph.vectors)))


def audited_width(graph: Graph, audit: int = 24, recall: float = 0.98, ef: int = 32) -> int:
    """The beam that finds ``recall`` of the 10 nearest nodes of ``audit`` evenly spaced nodes, widened twofold until it does."""
    n = len(graph.vectors)
    sample = graph.vectors[np.unique(np.linspace(0, n - 1, audit).astype(int))]
    true = np.argsort(-(sample @ graph.vectors.T), axis=1, kind="stable")[:, : min(10, n)]
    while ef < n:
        found = beams(graph, sample, ef)[0]
        if np.mean([len(np.intersect1d(a, b)) / len(b) for a, b in zip(found, true, strict=True)]) >= recall:
            break
        ef *= 2
    return min(ef, n)


def linked(graph: Graph, queries: np.ndarray, least: float, ef: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(query, node)`` numbers of pairs with a cosine of about ``least`` or more (a little below too).

    A query's beam widens fourfold until its worst entry lies below ``least`` or it holds the shard.
    """
    n, low = len(graph.vectors), np.float32(least - 1e-4)
    queries = np.ascontiguousarray(queries, np.float32)
    left, wide = np.arange(len(queries)), min(ef, n)
    while len(left):
        again, some = [], TOGETHER if wide <= WIDE else FEWER
        for a in range(0, len(left), some):
            part = left[a : a + some]
            ids, sims = beams(graph, queries[part], wide)
            full = (sims[:, -1] >= low) & (wide < n)
            row, col = np.nonzero((sims >= low) & (ids >= 0) & ~full[:, None])
            yield part[row], ids[row, col]
            again.append(part[full])
        left, wide = np.concatenate(again), min(n, 4 * wide)


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, also of very large and very small numbers."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


class Shard:
    """A shard's graph, and what the queries that it is asked have found."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, least: float, m: int, recall: float):
        unit = unit_vectors(raw)
        self.graph, order = build(unit, m)
        self.ids, self.counts, self.unit, self.least = ids[order], counts[order], unit[order], least
        self.ef, self.total, self.up = audited_width(self.graph, recall=recall), np.zeros(len(ids), np.int64), {}

    def _sure(self, unit: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Which pairs have the cosine in double precision."""
        parts = [np.einsum("nd,nd->n", unit[q[a : a + VERIFIED]], self.unit[x[a : a + VERIFIED]]) >= self.least for a in range(0, len(q), VERIFIED)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    def own(self) -> list[tuple[int, int]]:
        """Links among the shard's nodes; one that is found from either end holds for both."""
        n, joins = len(self.ids), []
        found = np.zeros((n, n), bool)
        for q, x in linked(self.graph, self.unit, self.least, self.ef):
            found[q, x] = self._sure(self.unit, q, x)
        found |= found.T
        np.fill_diagonal(found, False)
        for a in range(0, n, TOGETHER):
            self.total[a : a + TOGETHER] += found[a : a + TOGETHER] @ self.counts
            q, x = np.nonzero(np.triu(found[a : a + TOGETHER], a + 1))
            joins += _forest(self.ids[a + q], self.ids[x], self.up)
        return joins

    def asked(self, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Of each of another shard's nodes, the number of links; and links that join. Both ends of a link count it."""
        unit, total, joins = unit_vectors(raw), np.zeros(len(ids), np.int64), []
        for q, x in linked(self.graph, unit, self.least, self.ef):
            sure = self._sure(unit, q, x)
            q, x = q[sure], x[sure]
            np.add.at(total, q, self.counts[x])
            np.add.at(self.total, x, counts[q])
            joins += _forest(ids[q], self.ids[x], self.up)
        return total, joins


def _forest(a: np.ndarray, b: np.ndarray, up: dict[int, int]) -> list[tuple[int, int]]:
    """Of the links a-b, those that join what ``up`` (which learns them) has apart."""

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


#: Other shards' nodes that one task asks a shard, in shards.
ASKED = 32


def _asks(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each node in its own shard (``kind`` 0, once per part) and in each shard that it is asked of (1).

    Of two shards of a label one is asked: the one with the smaller number if their sum is even, else the other. So each
    asks and is asked by about half of the others, and every pair of nodes meets once. What a shard is asked is dealt
    to parts of about ``ASKED`` shards.
    """
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    dealt = nodes.alias("x").join(groups.alias("g"), ["label", "size"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("parts", F.expr(f"1 + blocks div {2 * ASKED}").cast("int"))
    held = dealt.withColumn("block", F.col("own")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("kind", F.lit(0))
    asked = dealt.withColumn("block", other).filter("block != own and (block < own) = ((block + own) % 2 = 0)")
    asked = asked.withColumn("part", F.pmod("own", "parts")).withColumn("kind", F.lit(1))
    names = ["label", "size", "block", "part", "kind", "node", "n", "v"]
    return held.select(*names).unionByName(asked.select(*names))


def _found(asks: DataFrame, spread: int, least: float, m: int, recall: float) -> DataFrame:
    """``(node, n, other)``: numbers of links (``other`` null), and links that join. A shard's nodes come first, then what it is asked."""
    keys = ["label", "size", "block", "part"]
    rows = asks.repartition(spread, *keys).sortWithinPartitions(*keys, "kind", "node")

    def counted(ids: np.ndarray, total: np.ndarray) -> pd.DataFrame:
        hit = np.flatnonzero(total)
        return pd.DataFrame({"node": ids[hit], "n": total[hit], "other": pd.array([None] * len(hit), "Int64")})

    def joined(joins: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"node": np.array([j[0] for j in joins], np.int64), "n": np.zeros(len(joins), np.int64), "other": pd.array([j[1] for j in joins], "Int64")})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, waiting, shard = None, [], None

        def built() -> Shard:
            rows = pd.concat(waiting)
            waiting.clear()
            return Shard(rows["node"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(float), least, m, recall)

        def ended() -> Iterator[pd.DataFrame]:
            nonlocal shard
            if at is not None:
                shard = shard or built()
                if at[3] == 0:
                    yield joined(shard.own())
                yield counted(shard.ids, shard.total)

        for batch in batches:
            for key, rows in batch.groupby([*keys, "kind"], sort=False):
                if key[:4] != at:
                    yield from ended()
                    at, shard = key[:4], None
                if key[4] == 0:
                    waiting.append(rows)
                    continue
                shard = shard or built()
                ids = rows["node"].to_numpy(np.int64)
                total, joins = shard.asked(ids, rows["n"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(float))
                yield counted(ids, total)
                yield joined(joins)
        yield from ended()

    return rows.mapInPandas(search, "node bigint, n bigint, other bigint")


def _usable(v: Column) -> Column:
    """A vector of finite numbers that aren't all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def embedding_components(
    vectors: DataFrame, least: float = 0.98, shard: int = 4096, m: int = 12, recall: float = 0.98,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept (it is its component's smallest id).

    Vectors of one label link at a cosine of ``least`` or more in double precision. Equal vectors are one node with a
    count, so copies cost nothing. Each label's nodes are dealt by hash to shards of about ``shard`` nodes. A task builds
    a shard's graph by searches of the graph so far, widens its beam until the audit of recall passes, and walks it for
    its own nodes and for those of other shards, which stream past; every pair of shards is searched once, and a link
    counts for both ends. A task gives numbers of links and the links that join (a forest), never all pairs. Vectors are
    moved once per shard that they are asked of. Vectors that are null, empty, zero or hold a null or a number that
    isn't finite, and those without label or id, link with nothing; vectors of unequal lengths don't link. A vector
    without id has a null component. Repeated rows are vectors of their own with one id. Other columns are ignored, an
    empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    rows = rows.withColumn("fine", _usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("key", F.when(F.col("fine"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>")), 256)))
    facts = written(rows.select("vec_id", "fine", "key"), "vectors")
    nodes = rows.filter("fine").groupBy("label", "key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    nodes = nodes.withColumn("size", F.size("v")).withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes.select("node", "id", "n", "v", "label", "size", "key"), "nodes")

    # hashes are uniform, so shards are of even size
    groups = nodes.groupBy("label", "size").count().withColumn("blocks", F.ceil(F.col("count") / shard).cast("int")).drop("count")
    groups = written(groups, "groups")
    tasks = groups.agg(F.sum("blocks")).first()[0] or 1
    spread = max(min(tasks, 100_000), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = written(_found(_asks(nodes, groups), spread, least, m, recall), "links")

    components = connected_components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    totals = found.filter("other is null").groupBy("node").agg(F.sum("n").alias("others"))
    known = nodes.select("node", "id", "n", "key").join(totals, "node", "left").join(components.withColumnRenamed("id", "node"), "node", "left")
    known = written(known.select("id", "key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("part")), "known")
    first = known.groupBy("part").agg(F.min("id").alias("component_id"))
    known = written(known.join(first, "part").select("key", "n_links", "component_id"), "classes")
    out = facts.filter("fine").join(known, "key").select("vec_id", "n_links", "component_id")
    out = out.unionByName(facts.filter("not fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
