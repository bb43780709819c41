"""Models and tables kept in a folder under a name and a hash of the rows that they were made from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.errors import InputError


def content(df: DataFrame) -> tuple:
    """Order-insensitive content: row count and sum of row hashes."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def entry_path(folder: str, name: str, made_from: DataFrame, *facts: object) -> str:
    """Where a result lies: its name, and a hash of the schema, the rows in any order and whatever else it hangs on."""
    if not name.replace("_", "").replace("-", "").isalnum():
        raise InputError("a name of letters, digits, - and _ is needed")
    text = "|".join(map(str, (*content(made_from), made_from.schema.simpleString(), *facts)))
    digest = made_from.sparkSession.range(1).select(F.sha2(F.lit(text), 256)).first()[0]
    return f"{folder.rstrip('/')}/{name}/{digest[:32]}"


def _there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # any file system that Spark knows
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def save(result: DataFrame | MLWritable, path: str) -> None:
    """Write a table as Parquet, a model by its own writer; what lay there before is replaced."""
    (result.write.mode("overwrite").parquet if isinstance(result, DataFrame) else result.write().overwrite().save)(path)


def load(spark: SparkSession, path: str, kind: type = PipelineModel) -> object | None:
    """The model or table (``kind`` DataFrame) of a path, or nothing."""
    if not _there(spark, path):
        return None
    return spark.read.parquet(path) if kind is DataFrame else kind.load(path)


def kept(folder: str | None, name: str, made_from: DataFrame, make: Callable[[], object], kind: type = PipelineModel, retrain: bool = False, facts: tuple = ()) -> object:
    """What ``make`` gives, from the folder if it was made of the same rows before; without a folder it is always made."""
    if folder is None:
        return make()
    path = entry_path(folder, name, made_from, *facts)
    found = None if retrain else load(made_from.sparkSession, path, kind)
    if found is None:
        save(make(), path)
        found = load(made_from.sparkSession, path, kind)
    return found


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, entry, bytes)`` of all that a folder keeps."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    parts = F.regexp_extract("path", r"/([^/]+)/([0-9a-f]{32})/", 1), F.regexp_extract("path", r"/([^/]+)/([0-9a-f]{32})/", 2)
    return files.groupBy(parts[0].alias("name"), parts[1].alias("entry")).agg(F.sum("length").alias("bytes")).filter("entry != ''")
