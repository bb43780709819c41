"""Corpus pipeline: quality rules, toxicity, near-duplicates, mixing and encoding, each over all that the one before kept.

Every stage but the last returns the columns of its documents whatever their names, and takes an empty table to an empty
one. Texts are read whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import line_quality, mixing, pieces, simhash, toxicity
from veilwork.llm.common import table, written
from veilwork.llm.queries import model_bytes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail the rules. Rows of one id and one text share a verdict; rows without id, or of one id with
    other texts, have their own. A null source is a source.
    """
    return line_quality.kept_documents(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic.

    Null and empty texts stay; repeated rows share a verdict; a row without id is judged by its text like any other. Of
    two labels of one id the larger holds, and labels of unknown ids count for nothing.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Null and empty texts are one group; of repeated rows one stays; rows of one id with unlike texts are in groups of
    their own; a row without id stays only where no row of its group has one, and of several such rows one.
    """
    return simhash.first_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time it takes them; the one where a source ends is cut there.

    Null and empty texts have no words to take and go; repeated rows and rows of one id are taken one by one; ties in the
    order of a source are broken by id, size and row. A null source is a source, the last.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every row of the mix, repeats included; a null text is empty and has the end id alone."""
    return pieces.digests(pieces.encode_decode(docs, model_bytes(public_tokenizers.path("piece_bpe_32k.model"))))


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxic),
    ("simhash near-dedup", near_duplicates),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Fingerprints, learned scores and encoding can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
