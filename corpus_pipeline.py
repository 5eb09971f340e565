"""The corpus pipeline: language ID, near-duplicate join, suffix-array dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the shared folder and read again as the next stage's docs.
The intermediate tables of a stage go when the stage after it begins, unless what that one gets still reads them: stages can be chained without
writing in between, and pipelines of several threads or inputs, or one after the other, do not touch each other's tables. What no stage deletes goes with the session.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontam, jaccard, langid, storage, suffix
from corvane.llm.queries import tokenizer_path
from corvane.llm.storage import drop, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_left: dict[tuple[int, str], tuple[str, list[str]]] = {}  # by thread and input: the last stage and its tables


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The same function, which deletes first the intermediate tables of the stage before it that nothing reads any more."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key, names = (threading.get_ident(), sf_dir), [f.__name__ for _, f in STAGES]
        last, left = _left.pop(key, ("", []))
        follows = last in names and names.index(last) + 1 == names.index(function.__name__)
        left = left if follows else []
        if left and storage.read_by(docs).isdisjoint(left):
            storage.delete(spark, left)
            left = []
        before = storage.made()
        out = function(spark, docs, sf_dir)
        _left[key] = function.__name__, [p for p in storage.made() if p not in before] + left
        return out

    return run


@stage
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go; lang becomes the predicted one.

    Null texts and texts without letters have no language and go; repeated rows are judged alike. Without labelled rows
    nothing is learned and all go; an empty table gives an empty one. Other columns are left out.
    """
    found = langid.predict(docs, langid.train(docs), keep=["doc_id", "text", "source", "n_chars"])
    return found.where(~F.col("rejected")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


@stage
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by five-word shingles at a similarity of 0.8 or more one stays: the one with the smallest doc_id.

    Every row counts for itself, by a key of its own: rows without a doc_id come last in that order, and of rows
    that repeat a doc_id those stay that are linked to nothing before them.
    """
    rows = table(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    found = jaccard.jaccard_components(rows.select(F.col("row").alias("doc_id"), "text"), n=5, num=4, den=5)
    order = F.struct(F.col("own").isNull().alias("none"), "own", "row")
    first = found.withColumnRenamed("doc_id", "row").join(rows.select("row", F.col("doc_id").alias("own")), "row").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select("first.row"), "row", "left_semi").select(*COLUMNS)


@stage
def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut; documents of which nothing is left go.

    Null and empty texts go with them; a null doc_id counts as the last, and rows that repeat a doc_id are not cut by each other.
    """
    found = suffix.remove_repeats(docs, length=50, keep=("lang", "source")).where("length(kept) > 0")
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


@stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of the benchmark go, or all words of a shorter item.

    Null and empty texts stay; repeated rows are judged alike; an empty benchmark removes nothing.
    """
    return decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10, drop="documents", keep=COLUMNS[2:])


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids of what is left; null and empty texts have none, every repeated row has a row."""
    return bpe.encode_documents(docs, tokenizer_path(), decoded=False).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("suffix_array_dedup", cut_repeated_strings),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", encode),
]

#: Language ID and BPE cannot be said in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES:
        before, docs = docs, table(function(spark, docs, sf_dir))
        drop(before)
    return docs
