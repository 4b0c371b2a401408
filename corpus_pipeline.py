"""A corpus pipeline of five stages, each by one operator of ``lodewright.llm``, written as Parquet between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodewright.llm._store import forget, intermediates, new_path
from lodewright.llm.jaccard_join import keep_one
from lodewright.llm.line_dedup import dedup_lines
from lodewright.llm.mixing import mixed_documents
from lodewright.llm.packing import pack_documents, piece_digests, tokenizer_files
from lodewright.llm.toxicity import without_toxic


#: What holds for every stage: all columns of its input are kept, whatever they are called; an empty table gives an
#: empty table; a null id is an id of its own; texts of any length are taken whole.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored 0.7 or more go; the others stay as they are.

    Null and empty texts, and texts without a word that a labelled example has, have the low rate of such examples and
    stay. Repeated rows and equal texts score equally. Without usable labels all stay.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier one go, and documents of which nothing is left.

    Earlier is by doc_id, null last, and line number. Repeated rows, equal in id and text, count as one document and all
    lose the same lines. Null, empty and blank texts have no lines and stay.
    """
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on shingles of five words, the one with the smallest id stays.

    Of repeated rows one stays. Null and empty texts have no shingles, link with nothing and stay; rows with a null id
    stay too, as they have no smallest id.
    """
    return keep_one(docs, n=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words drawn from each source up to its target: a row for each document and pass over it.

    Null and empty texts have no words and are never drawn. A null source is a source. Repeated rows count each. Ids
    repeat where a source is passed over more than once.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids, with the columns of ``op9_packing``.

    A null or empty text is its closing id alone. Repeated ids and rows are documents of their own; ties along the curve
    go by id.
    """
    return piece_digests(pack_documents(docs, *tokenizer_files()))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: No stage but a part of the first could be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with intermediates(spark):  # once a stage's result is written, nothing reads its operator's tables any more
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before:
            forget(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
