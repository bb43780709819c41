"""Reading tables, and generated ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.core import row_key, with_position
from veilwork.errors import InputError, NotInRangeError
from veilwork.functions.keyed import normal, uniform


def load_data(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """A file or folder in csv (with header), parquet, json or orc; types are inferred only where no schema is given."""
    kind = kind or (path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else "parquet")
    if kind not in ("csv", "parquet", "json", "orc"):
        raise InputError(f"unknown kind of file {kind}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.csv(path, header=True, inferSchema=schema is None) if kind == "csv" else getattr(reader, kind)(path)


def geometric_sequence(start: float = 0.5, n: int = 6, rate: float = 2) -> list[float]:
    return [start * rate**i for i in range(n)]


def binary_table(spark: SparkSession, n: int = 1000, seed: int = 1234) -> DataFrame:
    """A label of two halves, columns that agree with it but for 0 to 40 % of the rows, and a constant."""
    rows = spark.range(n).withColumn("Label", (F.col("id") >= n // 2).cast("int"))
    key = F.col("id")
    cols = [F.when(uniform(key, f"flip{p}", seed) < p / 100, 1 - F.col("Label")).otherwise(F.col("Label")).alias(f"Perc_{p}") for p in (0, 10, 20, 30, 40)]
    return rows.select("Label", *cols, F.lit(1).alias("One_Cat"))


def numeric_table(spark: SparkSession, n: int = 1000, seed: int = 1234) -> DataFrame:
    """A label of two halves and normal columns around 5 and 10 with deviations that double from one half to 16."""
    rows = spark.range(n).withColumn("Label", (F.col("id") >= n // 2).cast("int"))
    key, middle = F.col("id"), 5.0 * (1 + F.col("Label"))
    return rows.select("Label", *[(middle + normal(key, f"sd{s}", seed) * s).alias(f"STDEV_{s}".replace(".", "_")) for s in geometric_sequence()])


def l_diverse_table(spark: SparkSession, diversity: int | Sequence[int], columns: int = 5, blocks: int = 5, rows: int = 5) -> DataFrame:
    """Blocks of ``rows`` rows with one key each and exactly so many distinct sensitive values."""
    wanted = [diversity] * blocks if isinstance(diversity, int) else list(diversity)
    if any(not 1 <= d <= rows for d in wanted):
        raise NotInRangeError("a block's diversity lies between 1 and its rows")
    made = spark.range(len(wanted) * rows).withColumn("_b", F.floor(F.col("id") / rows).cast("int")).withColumn("_l", F.element_at(F.array(*map(F.lit, wanted)), F.col("_b") + 1))
    return made.select(*[F.concat(F.lit(f"{i}_"), F.col("_b").cast("string")).alias(f"col_{i}") for i in range(columns)], F.least(F.pmod("id", F.lit(rows)), F.col("_l") - 1).cast("int").alias("sensitive"))


def t_close_table(spark: SparkSession, sensitive: Sequence[object], columns: int = 3, rows: int = 3) -> DataFrame:
    """Blocks of ``rows`` rows with one key each around the sensitive values given."""
    made = [(*[f"{c}_{i // rows}" for c in range(columns)], v) for i, v in enumerate(sensitive)]
    kind = "bigint" if all(isinstance(v, int) for v in sensitive) else "double" if all(isinstance(v, (int, float)) for v in sensitive) else "string"
    return spark.createDataFrame(made, ", ".join(f"col_{i} string" for i in range(columns)) + f", sensitive {kind}")


def change_categories(df: DataFrame, col: str, p: float, key: str | None = None, seed: int = 1234, most: int = 10_000) -> DataFrame:
    """Exactly ``int(n p)`` cells, the first by a keyed order, get another of the column's categories (``most`` at most)."""
    if not 0 <= p <= 1:
        raise NotInRangeError("p lies between 0 and 1")
    names = sorted((r[0] for r in df.select(col).distinct().limit(most + 1).collect()), key=lambda v: (v is not None, v))
    if len(names) > most:
        raise InputError(f"more than {most} categories")
    if len(names) < 2:
        raise InputError("one category can't change")
    row, n = row_key(df, key), int(df.count() * p)
    others = F.array(*map(F.lit, names))
    at = F.array_position(others, F.col(col))
    step = 1 + F.floor(uniform(row, "other", seed) * (len(names) - 1)).cast("long")
    other = F.element_at(others, (F.pmod(at - 1 + step, F.lit(len(names))) + 1).cast("int"))
    laid = with_position(df.withColumn("_u", uniform(row, "who", seed)), [F.col("_u")])
    return laid.withColumn(col, F.when(F.col("_pos") < n, other).otherwise(F.col(col))).select(*df.columns)
