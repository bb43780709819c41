"""What all masks share: column choice, fitted column expressions, stable intermediate tables and global order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from veilwork.errors import DataTypeError, InputError

T, U = TypeVar("T"), TypeVar("U")


@dataclass(frozen=True)
class Mask:
    """A fitted mask: an expression per column, with what it learned as literals. Runs on batches and streams alike."""

    columns: dict[str, Column]

    def apply(self, df: DataFrame, output: str = "all", keep_types: bool = True) -> DataFrame:
        """``output``: the whole table with masked columns (all), or these columns only (subset)."""
        kinds = {f.name: f.dataType for f in df.schema.fields}
        made = {c: e.cast(kinds[c]) if keep_types and c in kinds else e for c, e in self.columns.items()}
        return df.select(*[e.alias(c) for c, e in made.items()]) if output == "subset" else df.withColumns(made)


def chosen(df: DataFrame, cols: str | Iterable[str] | None, numeric: bool = False, least: int = 1) -> list[str]:
    """The columns named (all if none), checked against the schema."""
    cols = df.columns if cols is None else [cols] if isinstance(cols, str) else list(cols)
    if missing := [c for c in cols if c not in df.columns]:
        raise InputError(f"unknown columns: {', '.join(missing)}")
    if numeric and (odd := [c for c in cols if not is_numeric(df, c)]):
        raise DataTypeError(f"not numeric: {', '.join(odd)}")
    if len(cols) < least:
        raise InputError(f"{least} columns or more are needed")
    return cols


def is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, NumericType)


def number(col: str | Column) -> Column:
    """A column as double with NaN as null, as every mask and metric reads numbers."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(c), c)


def row_key(df: DataFrame, key: str | list[str] | None) -> Column:
    """Key of a row for keyed noise: the columns named as text, else a hash of all (equal rows then get equal noise)."""
    if key is None:
        return F.xxhash64(*df.columns).cast("string")
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ([key] if isinstance(key, str) else key)])


def with_groups(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds each row's group values: partial sums and a join, so a group of a third of all rows can be split over tasks.

    Null keys are equal to each other. Where groups are few the join is a broadcast by their known size.
    """
    groups = df.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(*[v.alias(n) for n, v in values.items()])
    if not keys:
        return df.crossJoin(groups)  # one row
    same = F.col(keys[0]).eqNullSafe(F.col("_g0"))
    for i, k in enumerate(keys[1:], 1):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    return df.join(groups, same).drop(*[f"_g{i}" for i in range(len(keys))])


def shared_base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Where it isn't set, local runs get a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None and not (context.master == "local" or context.master.startswith("local[")):
            raise InputError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares."""
    return f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that all executors share and a lost one doesn't take along."""
    shared_base(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table in the shared folder and read it back. For rounds: a checkpoint keeps the constraints of its plan, which
    grow from round to round until planning takes longer than the work."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str = "table", least: int = 10_000) -> DataFrame:
    """A stored copy for many passes, in as many tasks as run at once if each then has ``least`` rows.

    A small file of many rows is read by one or two tasks, which would do all the work of every pass. Tables of more
    partitions stay as they are laid, and so do small ones.
    """
    laid = stored(df, name)
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, laid.count() // least)
    return stored(laid.repartition(tasks), name) if laid.rdd.getNumPartitions() < tasks else laid


def at_once(work: Callable[[T], U], items: Iterable[T], threads: int = 4) -> list[U]:
    """``work`` of every item, in order; a few of these Spark jobs run side by side, each from a thread of the driver."""
    items = list(items)
    session = SparkSession.getActiveSession()
    target = inheritable_thread_target(session)(work) if session is not None else work
    with ThreadPoolExecutor(max(1, min(threads, len(items)))) as pool:
        return list(pool.map(target, items))


def with_position(df: DataFrame, order: list[Column], name: str = "_pos") -> DataFrame:
    """Adds each row's place (from 0) in a global order without moving all rows into one task.

    Rows are dealt by range and sorted in their partition; partition sizes (one number each) give where each starts.
    Nulls come first. Rows that ``order`` can't tell apart get their places in any order.
    """
    slots = "_slot"
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(slots, F.monotonically_increasing_id())
    laid = checkpointed(laid)
    part = F.shiftright(slots, 33)
    sizes = sorted(map(tuple, laid.groupBy(part.alias("p")).count().collect()))
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _from long"))  # a row per partition
    place = F.col("_from") + F.col(slots).bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(offsets, part == F.col("_part")).withColumn(name, place).drop(slots, "_part", "_from")


def with_running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of its column over the rows before in a global order, and over all rows (``name_all``).

    Rows are dealt by range and sorted; a range's sum is one row, ranges' sums are added up on the driver, and the
    window inside a range is no longer than the range. Rows that ``order`` can't tell apart come in any order.
    """
    laid = df.withColumns({f"_x_{n}": c for n, c in sums.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    laid = checkpointed(laid.withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftright("_slot", 33).cast("int")
    found = sorted(map(tuple, laid.groupBy(part.alias("p")).agg(*[F.sum(f"_x_{n}") for n in sums]).collect()))
    kinds = dict(laid.select(*[F.sum(f"_x_{n}").alias(n) for n in sums]).dtypes)
    starts, total = [], [0.0 if kinds[n] == "double" else 0 for n in sums]
    for p, *values in found:
        starts.append((p, *total))
        total = [t + (v or 0) for t, v in zip(total, values, strict=True)]
    kind = "_part int, " + ", ".join(f"_from_{n} {kinds[n]}" for n in sums)
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts or [(0, *total)], kind))  # a row per range
    before = W.partitionBy("_part").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    laid = laid.withColumn("_part", part).withColumns({f"_in_{n}": F.coalesce(F.sum(f"_x_{n}").over(before), F.lit(0).cast(kinds[n])) for n in sums})
    laid = laid.join(offsets, "_part").withColumns({n: F.col(f"_from_{n}") + F.col(f"_in_{n}") for n in sums})
    laid = laid.withColumns({f"{n}_all": F.lit(t).cast(kinds[n]) for n, t in zip(sums, total, strict=True)})
    return laid.drop("_part", "_slot", *[f"{p}{n}" for n in sums for p in ("_x_", "_in_", "_from_")])


def with_ranks(df: DataFrame, col: str, prefix: str = "_r_") -> DataFrame:
    """Adds, for the non-null values of ``col``: ``n`` rows below, ``c`` rows equal, ``d`` distinct values below (prefixed).

    Distinct values are counted with partial sums and ordered globally; each value's row joins back by equality.
    """
    counts = df.groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias(f"{prefix}c")).filter("_v is not null")
    placed = with_running(counts, [F.col("_v")], {f"{prefix}n": F.col(f"{prefix}c"), f"{prefix}d": F.lit(1).cast("long")})
    placed = checkpointed(placed.select("_v", f"{prefix}n", f"{prefix}c", f"{prefix}d"))  # a table, so that the join can split a value of many rows
    return df.join(placed, df[col] == placed["_v"], "left").drop("_v")
