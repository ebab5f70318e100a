"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, documents, table folder) and works on every row it is given; all but the
last return the columns of the documents as they came, whatever they are. Null ids, null and empty
texts, repeated rows and empty tables are allowed in every stage; what each means is in the docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tallyfield
from tallyfield.llm import decontam, jaccard, mixing, ring, rules
from tallyfield.llm.text import drop_ids
from tallyfield.session import checkpoint, scratch_path

# Python workers need not have the package on their path: its functions travel with the task
cloudpickle.register_pickle_by_value(tallyfield)

SHARDS = 8
WEIGHTS = (5, 2, 1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no quality rule. Null and blank texts fail; equal rows go or stay together."""
    whole_rows = docs.select(F.struct("*").alias("_all"), F.col("text"))
    return rules.judged(whole_rows, key="_all").where("kept").select("_all.*")


def numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row number, and the name of its column.

    Written, so that every read of the stage, and one after a lost executor, sees the same numbers.
    """
    number = "_nth" + "_" * max(len(c) for c in docs.columns)  # no column of the documents
    path = scratch_path(spark, "numbered")
    docs.withColumn(number, F.monotonically_increasing_id()).write.parquet(path, compression="zstd")
    return spark.read.parquet(path), number


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, one of the smallest id; a row without an id only if none has one.

    Rows are told apart by number: those that repeat an id, or have none, stay or go each by its own
    text. Rows without words are nobody's copy.
    """
    rows, number = numbered(spark, docs)
    linked = jaccard.joined(rows, key=number, written=True).where("n_links > 0").select(F.col(number).alias("_of"), "class_id")
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("a"), F.xxhash64("text").alias("b"), F.col(number).alias("c"))
    order = rows.select(F.col(number).alias("_row"), place.alias("_order"))
    members = checkpoint(linked.join(order, F.col("_of") == F.col("_row")).select("class_id", "_order"))
    first = members.groupBy("class_id").agg(F.min("_order").alias("_first"))
    gone = members.join(first, "class_id").where("_order.c <> _first.c")
    return drop_ids(rows, gone.select(F.col("_order.c").alias(number)), number).drop(number)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, not even with a few edits.

    A null or empty text holds none. Rows are told apart by number, whatever their ids.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, number = numbered(spark, docs)
    return drop_ids(rows, decontam.leaks(rows, items, key=number), number).drop(number)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as its source's target asks for, none to three.

    Rows are told apart by number, whatever their ids. Blank texts weigh nothing.
    """
    rows, number = numbered(spark, docs)
    copies = mixing.mixed(rows, WEIGHTS, row=number).where("copies > 0").select(F.col(number).alias("_row"), F.col("copies").alias("_copies"))
    taken = rows.join(copies, rows[number] == copies["_row"])
    each = F.explode(F.sequence(F.lit(1).cast("long"), copies["_copies"])).alias(number)
    return taken.select(*[rows[c] for c in docs.columns], each).drop(number)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every row: doc_id, size, text_crc32, shard, slot. Copies are rows of their own."""
    return ring.placed(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixture),
    ("sharding", shards),
]

# MinHash, edit distance and ring hashes have no SQL text; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
