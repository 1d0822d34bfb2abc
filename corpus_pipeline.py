"""A training corpus from the table of documents, stage by stage.

Every stage reads whole texts and all rows that its predecessor kept. What a stage stores on its way is
deleted when the next one begins; tables that other operators of the session stored stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from gridloom.session import delete_path, new_path, release, scope, ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_SCOPE = "pipeline"


def _stage(spark: SparkSession, operator: Callable[[], DataFrame]) -> DataFrame:
    """The stage before has been written, so what it stored can go."""
    ship(spark)
    release(spark, _SCOPE)
    with scope(_SCOPE):
        return operator()


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows.

    Null and empty texts and texts without a letter go, as do all if no row teaches a language. Rows that repeat an id or a text stay
    or go alike. An empty table stays empty. Columns beside id, text and lang are carried along unread.
    """
    return _stage(spark, lambda: language_id.keep_identified(docs, language_id.train(docs)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id.

    Null and empty texts are equal; a null id is smaller than any other. Of rows that
    repeat an id and a text one stays. An empty table stays empty. Other columns are carried along unread.
    """
    return _stage(spark, lambda: exact_dedup.drop_duplicates(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles: that with the smallest id.

    Null, empty and wordless texts and rows without an id link with nothing and stay. Rows that repeat an id stay or go
    together. An empty table stays empty. Other columns are carried along unread.
    """
    return _stage(spark, lambda: jaccard_join.keep_one(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target rate draws, in a global random order.

    A null source is a source of its own; empty texts are drawn at their source's rate; a
    null id draws as an id of its own, and rows with equal ids draw alike. Columns named copy or order_key go. An
    empty table stays empty.
    """
    return _stage(spark, lambda: mixing.mix(docs).drop("copy", "order_key"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 4096 tokens.

    Null and empty texts are packed as the end mark alone; each row is packed, those that repeat an id or have none
    too. An empty table gives no rows. Other columns are not read.
    """
    return _stage(spark, lambda: packing.pack(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Language models, packing and tokenizers are beyond SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; only the last one's table is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before is not None:
            delete_path(spark, before)
        before = path
    release(spark, _SCOPE)
    return docs
