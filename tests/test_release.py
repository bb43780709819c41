"""Rows that leave a stream by the size of their class."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from veilwork.errors import InputError
from veilwork.streaming import reports

START = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, kind string, zone long, note string"


def written(spark, folder, name, rows):
    """A file of the stream; files come in the order of their times."""
    spark.createDataFrame([(i, START + datetime.timedelta(minutes=m), kind, zone, note) for i, m, kind, zone, note in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def in_order(spark, folder, batches):
    for i, rows in enumerate(batches):
        written(spark, folder, f"p{i}", rows)
        for f in os.listdir(folder / f"p{i}"):
            os.utime(folder / f"p{i}" / f, (1e9 + i, 1e9 + i))


def run(spark, source, out, k=3):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    rows = reports.released_rows(stream, "ts", ["kind", "zone"], k, 3600)
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(rows.schema).parquet(f"{out}/rows")
    return {r.id: (r.kind, r.zone, r.note, r.released) for r in found.collect()}, found.count()


BATCHES = [
    [(1, 1, "a", 2**60 + 1, "x"), (2, 5, "a", 2**60 + 1, None), (3, 6, "b", None, "y"), (4, 7, None, 1, "z")],
    [(5, 30, "a", 2**60 + 1, "x"), (6, 40, "b", None, "y"), (7, 41, "a", 7, "q"), (8, 61, "a", 2**60 + 1, "next hour")],
    [(10, 59, "b", None, "third"), (11, 125, "c", 1, "w")],
    [(12, 126, "c", 1, "w"), (13, 195, "d", 1, "v")],
]


def test_rows_leave_with_their_class_or_masked(spark, tmp_path):
    whole, parted = tmp_path / "whole", tmp_path / "parted"
    in_order(spark, whole, BATCHES)
    got, n = run(spark, str(whole), str(tmp_path / "one"))
    assert n == len(got)
    zone = 2**60 + 1
    assert [got[i] for i in (1, 2, 5)] == [("a", zone, "x", True), ("a", zone, None, True), ("a", zone, "x", True)]
    assert [got[i][3] for i in (3, 6, 10)] == [True] * 3 and got[3][:2] == ("b", None)
    assert got[4] == (None, None, "z", False) and got[7] == (None, None, "q", False)  # alone in their hour
    assert got[8] == (None, None, "next hour", False)
    assert got[11] == got[12] == (None, None, "w", False) and 13 not in got  # its hour isn't over
    for i, rows in enumerate(BATCHES):  # restarted after each file
        written(spark, parted, f"p{i}", rows)
        again, n = run(spark, str(parted), str(tmp_path / "two"))
        assert n == len(again) and all(v[3] is False or v[0] is not None for v in again.values())
    assert again == got


def test_late_rows(spark, tmp_path):
    zone = 2**60 + 1
    late = [(14, 30, "a", zone, "older than the watermark"), (15, 55, "a", zone, "fourth of its class")]
    in_order(spark, tmp_path / "in", [*BATCHES[:3], BATCHES[3] + late, [(16, 116, "f", 1, "its hour is over"), (17, 200, "g", 1, "w")]])
    got, _ = run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert 14 not in got and got[15] == ("a", zone, "fourth of its class", True)
    assert got[16] == (None, None, "its hour is over", False) and 17 not in got


def test_large_class_and_bounds(spark, tmp_path):
    written(spark, tmp_path / "in", "p", [(i, 1, "a", 1, "x") for i in range(25_000)] + [(-1, 1, "b", 1, "x")])
    got, n = run(spark, str(tmp_path / "in"), str(tmp_path / "out"), 20_000)
    assert n == 25_000 and all(v[3] for v in got.values())
    for bad in ({"k": 0}, {"seconds": 0}, {"keys": []}):
        with pytest.raises(InputError):
            reports.released_rows(spark.createDataFrame([], SCHEMA), **({"time_col": "ts", "keys": ["kind"]} | bad))
