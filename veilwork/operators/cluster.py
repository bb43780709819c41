"""Clusterings by distance on Spark: neighbours in cells, spanning forests in rounds, clustering features, kernel components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.core import at_once, stored, with_position
from veilwork.errors import InputError

#: Points of a block, and columns that make cells.
BLOCK, GRID = 512, 3


def distinct_points(x: DataFrame) -> DataFrame:
    """``(pid, p, n)``: the distinct ``features`` in their order, numbered from 0, and how many rows have each."""
    counted = x.groupBy(vector_to_array("features").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return stored(with_position(counted, [F.col("p")], "pid").select("pid", "p", "n"))


def with_points(x: DataFrame, points: DataFrame, names: list[str]) -> DataFrame:
    """Adds to each row what ``points`` say of its ``features``."""
    return x.withColumn("_p", vector_to_array("features")).join(points.select(F.col("p").alias("_p"), *names), "_p").drop("_p")


# --- pairs of near blocks ---------------------------------------------------------------------------------------------


def near_pairs(points: DataFrame, radius: float) -> DataFrame:
    """Every two blocks of points that can hold two of at most ``radius``: b, c and for each pid, n, f and the flat p.

    Cells have sides of the radius along up to three columns, those of the widest spread. A cell's points are dealt to
    blocks of about ``BLOCK`` by their hash, so one of a third of all points is many blocks; numbers of neighbouring
    cells' blocks are joined by cell, then the blocks by number. Every two points of the radius or less meet once.
    """
    more = [c for c in points.columns if c == "f"]
    size = points.select(F.size("p")).first()
    width = size[0] if size else 0
    ends = points.agg(*[F.min(F.col("p")[i]) for i in range(width)], *[F.max(F.col("p")[i]) for i in range(width)]).first() if width else []
    spread = [ends[width + i] - ends[i] for i in range(width)]
    sides = [i for i in sorted(range(width), key=lambda i: -spread[i])[:GRID] if spread[i] > radius]
    side = radius * (1 + 1e-9)
    placed = points.withColumn("cell", F.array(*[F.floor(F.col("p")[i] / side).cast("bigint") for i in sides] or [F.lit(0).cast("bigint")]))
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("bigint").alias("parts"))
    placed = placed.join(stored(parts), "cell").withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts")))
    blocks = placed.groupBy("cell", "part").agg(F.collect_list(F.struct("pid", "p", "n", *more)).alias("r"))
    blocks = stored(blocks.select(F.monotonically_increasing_id().alias("b"), "cell", "r.pid", F.flatten("r.p").alias("p"), "r.n", *[f"r.{c}" for c in more]))
    steps = F.explode(F.array(*[F.array(*[F.col("cell")[i] + s for i, s in enumerate(way)]) for way in product((-1, 0, 1), repeat=max(1, len(sides)))]))
    near = blocks.select("b", steps.alias("cell")).join(blocks.select(F.col("b").alias("c"), "cell"), "cell").filter("b <= c").select("b", "c")
    held = ["pid", "p", "n", *more]
    one, two = (blocks.select(F.col("b").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in held]) for k in ("b", "c"))
    return near.join(one, "b").join(two, "c")


def over_pairs(pairs: DataFrame, work: Callable[[dict, dict, np.ndarray, bool], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``work(block, other, squared distances, same)`` gives of each pair, as tuples of arrays."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for i in range(len(batch)):
                sides: tuple[dict, dict] = {}, {}
                for name in batch.schema.names:
                    if name not in ("b", "c"):
                        sides[name.endswith("_c")][name[:-2]] = batch.column(name)[i].values.to_numpy(zero_copy_only=False)
                for s in sides:
                    s["p"] = s["p"].reshape(len(s["pid"]), -1)
                a, b = sides
                d = np.zeros((len(a["pid"]), len(b["pid"])))
                for k in range(a["p"].shape[1]):
                    d += (a["p"][:, k, None] - b["p"][None, :, k]) ** 2
                found += work(a, b, d, batch.column("b")[i] == batch.column("c")[i])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*found, strict=True)], names)

    return pairs.mapInArrow(run, schema)


def neighbour_counts(points: DataFrame, radius: float) -> DataFrame:
    """``(pid, near)``: rows within ``radius`` of each point, its own rows included. Blocks give sums, no pair is written."""
    limit = radius * radius

    def work(a: dict, b: dict, d: np.ndarray, same: bool) -> Iterator[tuple]:
        near = d <= limit
        yield a["pid"], near @ b["n"]
        if not same:
            yield b["pid"], near.T @ a["n"]

    return over_pairs(near_pairs(points, radius), work, "pid bigint, near bigint").groupBy("pid").agg(F.sum("near").alias("near"))


def light_forest(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A lightest spanning forest of a small graph (infinite where there is no edge): ends and weights, tree after tree from its first node."""
    n = len(weights)
    best, where, out = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    ends, heads, sizes = [], [], []
    for _ in range(n):
        v = int(np.argmin(np.where(out, best, np.inf)))
        if not np.isfinite(best[v]) or not out[v]:
            v = int(np.argmax(out))
        else:
            ends.append(v)
            heads.append(where[v])
            sizes.append(best[v])
        out[v] = False
        nearer = out & (weights[v] < best)
        best[nearer], where[nearer] = weights[v][nearer], v
    return np.array(ends, int), np.array(heads, int), np.array(sizes)


def light_edges(points: DataFrame, radius: float) -> DataFrame:
    """``(a, b, w)``: edges of at most ``radius`` that hold a lightest spanning forest of all such edges.

    Each pair of blocks keeps a lightest forest of its own edges: what it leaves out is the heaviest of a cycle. So a
    pair gives fewer edges than it has points.
    """
    limit = radius * radius

    def work(a: dict, b: dict, d: np.ndarray, same: bool) -> Iterator[tuple]:
        n, m = d.shape
        d = np.where(d <= limit, d, np.inf)
        if same:
            ids, w = a["pid"], d
        else:
            ids, w = np.concatenate([a["pid"], b["pid"]]), np.full((n + m, n + m), np.inf)
            w[:n, n:], w[n:, :n] = d, d.T
        i, j, size = light_forest(w)
        yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.sqrt(size)

    return over_pairs(near_pairs(points, radius), work, "a bigint, b bigint, w double").groupBy("a", "b").agg(F.min("w").alias("w"))


# --- spanning forests -------------------------------------------------------------------------------------------------


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tree(a, b, w), labels(pid, label))`` of weighted edges: a lightest forest, and the smallest node of each node's tree.

    Borůvka rounds: every component takes its lightest edge (one aggregate; ties by the ends), components join along
    them, pointers are doubled until all show to their root, and the edges are kept between components, the lightest of
    each two. A round halves the components at least, so rounds grow with the logarithm of the nodes; what a round leaves
    is written in the shared folder, and no edge or label goes to the driver.
    """
    live = stored(edges.filter("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.struct("w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).alias("e")))
    labels = stored(live.select(F.col("u").alias("pid")).union(live.select("v")).distinct().withColumn("label", F.col("pid")))
    trees = []
    while True:
        both = live.select("u", "v", "e").unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v"), "e"))
        picked = stored(both.groupBy("u").agg(F.min(F.struct("e", "v")).alias("m")).select("u", "m.v", "m.e"))
        if picked.isEmpty():
            break
        trees.append(picked.select("e.*").distinct())
        other = picked.select(F.col("u").alias("v"), F.col("v").alias("back"))
        # two components that take each other: the smaller is the root
        shown = picked.join(other, "v", "left").select("u", F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("to"))
        shown = stored(shown)
        while True:  # two doublings at a time
            for _ in range(2):
                far = shown.select(F.col("u").alias("to"), F.col("to").alias("next"))
                shown = shown.join(far, "to").select("u", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
            shown = stored(shown)
            if shown.filter("moved").isEmpty():
                break
            shown = shown.drop("moved")
        shown = shown.drop("moved")
        to_v = shown.select(F.col("u").alias("v"), F.col("to").alias("to_v"))
        kept = live.join(shown, "u").join(to_v, "v").filter("to != to_v")
        kept = kept.groupBy(F.least("to", "to_v").alias("u"), F.greatest("to", "to_v").alias("v")).agg(F.min("e").alias("e"))
        moved = labels.join(shown.select(F.col("u").alias("label"), "to"), "label", "left").select("pid", F.coalesce("to", "label").alias("label"))
        live, labels = at_once(stored, [kept, moved])
    smallest = labels.groupBy("label").agg(F.min("pid").alias("first"))
    labels = stored(labels.join(smallest, "label").select("pid", F.col("first").alias("label")))
    tree = edges.filter("false").select("a", "b", "w")
    for t in trees:
        tree = tree.unionByName(t.select("a", "b", "w"))
    return stored(tree.distinct()), labels


def _numbered(points: DataFrame, label: str) -> DataFrame:
    """Labels in place of which stands their order: ``(label, prediction)``."""
    return with_position(points.filter(F.col(label).isNotNull()).select(label).distinct(), [F.col(label)], "prediction")


# --- clusterings ------------------------------------------------------------------------------------------------------


def dbscan(x: DataFrame, radius: float, least: int) -> DataFrame:
    """Adds ``prediction`` and ``core`` to rows with ``features``: density clusters, numbered by their first point; noise is -1.

    A point with ``least`` rows or more within ``radius``, itself included, is a core; cores within the radius of each
    other are one cluster; another point within the radius of a core is of its nearest one's cluster (ties: the smaller
    point). Equal rows are one point of some weight. Counts, forests and nearest cores come from pairs of near blocks.
    An empty table gives no rows; rows without features aren't taken.
    """
    if radius <= 0 or least < 1:
        raise InputError("a radius above 0 and a number of 1 or more are needed")
    points = distinct_points(x)
    points = stored(points.join(neighbour_counts(points, radius), "pid").withColumn("f", F.col("near") >= least))
    cores = points.filter("f").select("pid", "p", "n")
    _, labels = spanning_forest(light_edges(cores, radius))
    limit = radius * radius

    def nearest(a: dict, b: dict, d: np.ndarray, same: bool) -> Iterator[tuple]:
        for one, two, dist in [(a, b, d)] if same else [(a, b, d), (b, a, d.T)]:
            cores = np.flatnonzero(two["f"])
            cores = cores[np.argsort(two["pid"][cores])]  # of equal distances the first holds
            border = np.flatnonzero(~one["f"].astype(bool))
            if len(cores) and len(border):
                part = dist[np.ix_(border, cores)]
                at = part.argmin(axis=1)
                close = part[np.arange(len(border)), at]
                ok = close <= limit
                yield one["pid"][border][ok], close[ok], two["pid"][cores][at][ok]

    close = over_pairs(near_pairs(points.select("pid", "p", "n", "f"), radius), nearest, "pid bigint, d double, core bigint")
    border = close.groupBy("pid").agg(F.min(F.struct("d", "core")).alias("m")).select("pid", F.col("m.core").alias("of"))
    of = points.join(border, "pid", "left").withColumn("of", F.when(F.col("f"), F.col("pid")).otherwise(F.col("of")))
    # a core without another in reach is in no edge
    of = of.join(labels.withColumnRenamed("pid", "of"), "of", "left").withColumn("label", F.coalesce("label", "of"))
    of = stored(of.select("p", F.col("f").alias("core"), "label"))
    of = of.join(_numbered(of, "label"), "label", "left").withColumn("prediction", F.coalesce("prediction", F.lit(-1)))
    return with_points(x, of, ["prediction", "core"])


def linkage_tree(points: DataFrame, clusters: int, radius: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The lightest spanning forest of the points, with as many trees as ``clusters`` or fewer, and its labels.

    The radius starts at ``radius`` (else so that a cell of the widest columns holds a few points) and is doubled until
    few enough trees are left, so it stays near the longest edge that is needed.
    """
    n = points.count()
    if radius is None:
        width = points.select(F.size("p")).first()
        spread = [] if width is None else points.agg(*[F.max(F.col("p")[i]) - F.min(F.col("p")[i]) for i in range(width[0])]).first()
        wide = sorted((s for s in spread if s), reverse=True)[:GRID]
        radius = float(np.prod(wide) * 4 / max(n, 1)) ** (1 / len(wide)) if wide else 1.0
    while True:
        tree, labels = spanning_forest(light_edges(points, radius))
        if n - tree.count() <= max(1, clusters):
            return tree, labels
        radius *= 2


def single_linkage(x: DataFrame, clusters: int = 2, distance: float | None = None) -> DataFrame:
    """Adds ``prediction`` to rows with ``features``: agglomerative clusters by single linkage, numbered by their first point.

    The lightest spanning tree is cut at its ``clusters - 1`` heaviest edges (ties: the larger ends go first), or where
    edges are longer than ``distance``. Fewer distinct points than clusters are clusters of their own; an empty table
    gives no rows.
    """
    if clusters < 1 or distance is not None and distance < 0:
        raise InputError("one cluster or more and a distance from 0 on are needed")
    points = distinct_points(x)
    if distance is not None:
        tree = light_edges(points, distance) if distance else points.select(F.col("pid").alias("a"), F.col("pid").alias("b"), F.lit(0.0).alias("w")).limit(0)
    else:
        tree, _ = linkage_tree(points, clusters)
        left = points.count() - tree.count()  # trees already
        placed = with_position(tree, [F.col("w").desc(), F.col("a").desc(), F.col("b").desc()], "rank")
        tree = placed.filter(F.col("rank") >= clusters - left).drop("rank")
    _, labels = spanning_forest(tree)
    of = points.join(labels, "pid", "left").select("p", F.coalesce("label", "pid").alias("label"))
    of = stored(of)
    return with_points(x, of.join(_numbered(of, "label"), "label"), ["prediction"])


# --- clustering features ----------------------------------------------------------------------------------------------


def _cells(width: int, low: list[float], side: float, shifts: list[int]) -> Column:
    """The cell of ``features``; null where one of them isn't finite."""
    p = vector_to_array("features")
    at = F.array(*[F.shiftright(F.floor((p[i] - low[i]) / side), shifts[i]) for i in range(width)])
    return F.when(F.forall(p, lambda v: F.abs(v) < float("inf")), at)


def feature_tree(x: DataFrame, threshold: float, most: int = 1000) -> tuple[DataFrame, Callable[[], Column]]:
    """Clustering features ``(cell, n, sums, squares)`` of ``features``, ``most`` at most, and the cell of a row as a column.

    Leaves are cells whose diagonal is ``threshold``, laid from the least value of each column. While there are more than
    ``most``, cells are doubled along one column after the other: a level is made by adding up the features of the one
    below, never from rows, and cells are nested, so the features of every level sum up to the moments of the table and
    don't hang on its partitions or order. A doubling at most halves their number, so those that are sure to be needed are
    made at once. Rows with values that aren't finite are in no feature; an empty table has none.
    """
    if not threshold > 0 or most < 1:
        raise InputError("a threshold above 0 and one feature or more are needed")
    rows = x.select("features", vector_to_array("features").alias("p")).filter(F.forall("p", lambda v: F.abs(v) < float("inf")))
    first = rows.select(F.size("p")).first()
    width = first[0] if first else 0
    if not width:
        return x.sparkSession.createDataFrame([], "cell array<bigint>, n bigint, sums array<double>, squares array<double>"), lambda: F.lit(None).cast("array<bigint>")
    ends = rows.agg(*[F.min(F.col("p")[i]) for i in range(width)], *[F.max(F.col("p")[i]) for i in range(width)]).first()
    low, side, shifts = list(ends[:width]), threshold / width**0.5, [0] * width
    if any((ends[width + i] - low[i]) / side >= 2.0**52 for i in range(width)):
        raise InputError("the threshold is too small for the columns' spread")
    sums = [F.array(*[F.sum(F.pow(F.col("p")[i], F.lit(k))) for i in range(width)]).alias(name) for name, k in (("sums", 1), ("squares", 2))]
    features = stored(rows.groupBy(_cells(width, low, side, shifts).alias("cell")).agg(F.count(F.lit(1)).alias("n"), *sums), "features")
    step = 0
    while (found := features.count()) > most:
        for _ in range(max(1, int(np.ceil(np.log2(found / most))))):
            shifts[step % width] += 1
            step += 1
            at = (step - 1) % width
            features = features.withColumn("cell", F.array(*[F.shiftright(F.col("cell")[i], int(i == at)) for i in range(width)]))
        added = [F.array(*[F.sum(F.col(c)[i]) for i in range(width)]).alias(c) for c in ("sums", "squares")]
        features = stored(features.groupBy("cell").agg(F.sum("n").alias("n"), *added), "features")
    return features, lambda: _cells(width, low, side, shifts)


def ward_labels(sizes: np.ndarray, means: np.ndarray, clusters: int) -> np.ndarray:
    """Clusters of weighted points that grow their inner sum of squares least, two at a time, by chains of nearest neighbours."""
    m, size, mean, alive = len(sizes), sizes.astype(float), means.astype(float), np.ones(len(sizes), bool)
    merges, height, chain = [], np.zeros(len(sizes)), []
    while len(merges) < m - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        i = chain[-1]
        cost = size * size[i] / (size + size[i]) * ((mean - mean[i]) ** 2).sum(axis=1)
        cost[~alive] = cost[i] = np.inf
        j = int(np.argmin(cost))
        if len(chain) > 1 and cost[chain[-2]] <= cost[j]:  # each is the other's nearest
            j = chain[-2]
            a, b = min(i, j), max(i, j)
            height[a] = max(cost[j], height[a], height[b])
            merges.append((height[a], a, b))
            mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
            size[a], alive[b] = size[a] + size[b], False
            del chain[-2:]
        else:
            chain.append(j)
    label = np.arange(m)
    for _, a, b in sorted(merges, key=lambda t: t[0])[: max(0, m - clusters)]:
        one, two = label[a], label[b]
        label[label == max(one, two)] = min(one, two)
    return np.unique(label, return_inverse=True)[1]


def birch(x: DataFrame, clusters: int | None = 8, threshold: float = 0.5, most: int = 1000) -> DataFrame:
    """Adds ``prediction``: the cluster of the row's clustering feature.

    Of ``feature_tree`` the driver gets ``most`` features at most, whatever the table holds, and joins them to ``clusters``
    by Ward's rule, each weighing as many rows as it has (none: every feature is a cluster). Clusters are numbered by
    their first cell. Equal rows share a cluster; fewer features than clusters are clusters of their own; a row with a
    value that isn't finite gets -1; an empty table gives no rows.
    """
    if clusters is not None and clusters < 1:
        raise InputError("one cluster or more is needed")
    features, cell = feature_tree(x, threshold, most)
    found = sorted(features.collect(), key=lambda r: r.cell)  # ``most`` rows at most
    n = np.array([r.n for r in found])
    if clusters is None or len(found) <= clusters:
        labels = range(len(found))
    else:
        labels = ward_labels(n, np.array([r.sums for r in found]) / n[:, None], clusters).tolist()
    table = x.sparkSession.createDataFrame([(r.cell, v) for r, v in zip(found, labels, strict=True)], "_cell array<bigint>, prediction int")
    out = x.withColumn("_cell", cell()).join(F.broadcast(table), "_cell", "left")
    return out.withColumn("prediction", F.coalesce("prediction", F.lit(-1))).drop("_cell")


# --- kernel components ------------------------------------------------------------------------------------------------


def kernel_component(x: DataFrame, gamma: float | None = None, landmarks: int = 256, seed: int = 1234) -> DataFrame:
    """Adds ``component``: the first principal component of the Gaussian kernel ``exp(-gamma |a - b|^2)``, by landmarks.

    ``landmarks`` distinct points, drawn by hash, span the space: a row is its kernel with them times the inverse root of
    theirs, so the kernel of all rows is seen through a matrix of landmarks by landmarks, whose sums partitions make
    (Nyström). With all distinct points as landmarks the component is exact; ``gamma`` is one over the number of columns
    if not given. The sign is the one with the larger sum of cubes. An empty table gives no rows.
    """
    points = x.select(vector_to_array("features").alias("p")).distinct()
    chosen = np.array([r.p for r in points.orderBy(F.xxhash64("p", F.lit(seed)), "p").limit(landmarks).collect()], float)
    if not len(chosen):
        return x.withColumn("component", F.lit(0.0))
    gamma = 1 / chosen.shape[1] if gamma is None else gamma

    def kernel(rows: np.ndarray) -> np.ndarray:
        d = np.zeros((len(rows), len(chosen)))
        for k in range(chosen.shape[1]):
            d += (rows[:, k, None] - chosen[None, :, k]) ** 2
        return np.exp(-gamma * d)

    values, vectors = np.linalg.eigh(kernel(chosen))
    keep = values > 1e-10 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    size = root.shape[1]

    def rows_of(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(size), np.zeros((size, size))
        for b in batches:
            z = kernel(rows_of(b.column(0))) @ root
            n, total, squares = n + len(z), total + z.sum(axis=0), squares + z.T @ z
        flat = np.concatenate([[n], total, squares.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "v"])

    flat = x.select(vector_to_array("features").alias("p"))
    got = flat.mapInArrow(sums, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    got = np.array([r.v for r in got])  # one number for each cell of the matrix of landmarks
    n, mean, squares = got[0], got[1 : 1 + size] / got[0], got[1 + size :].reshape(size, size)
    _, axes = np.linalg.eigh(squares / n - np.outer(mean, mean))
    axis = root @ axes[:, -1]
    shift = float(mean @ axes[:, -1])

    @F.pandas_udf("double")
    def component(p):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(kernel(np.array(p.tolist(), float)) @ axis - shift)

    out = x.withColumn("component", component(vector_to_array("features")))
    cubes = out.agg(F.sum(F.pow("component", F.lit(3)))).first()[0] or 0.0
    return out.withColumn("component", F.col("component") * (1.0 if cubes >= 0 else -1.0))


def features_of(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``features``, the columns given as numbers."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.array(*[c.cast("double") for c in columns.values()])))
