"""The corpus pipeline: documents that pass the quality rules, one of each near-duplicate group, mixed to target weights, encoded.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``. Tables that a stage writes on its way
are dropped when the next stage begins, unless its docs still read them.

Parquet files are not read in the order in which they were written, so the order that the mixture decides is
read from where its rows lie (file and row) and leaves the pipeline as a column.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolodeck.llm.anchor_simhash import one_of_each
from rolodeck.llm.host_quality import keep_good
from rolodeck.llm.pfair_mix import in_mixed_order
from rolodeck.llm.scan_bpe import digests
from rolodeck.llm.staging import Staged, collecting, drop_unread, staged, table

_on_the_way: list[Staged] = []


def _made(docs: DataFrame, operator) -> DataFrame:
    drop_unread(_on_the_way, docs)
    with collecting(_on_the_way):
        return operator(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail their own rules, or whose source is rejected, go."""
    return _made(docs, keep_good)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints within four bits stays."""
    return _made(docs, one_of_each)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources have their target weights."""
    return _made(docs, in_mixed_order)


def with_position(docs: DataFrame) -> DataFrame:
    """``docs``, read from one written table, with position: 0, 1, ... in the order in which its rows were written.

    Files are named by the task that wrote them and, within it, by their turn (part-00003-...-c001.zstd.parquet).
    """
    place = docs.metadataColumn("_metadata")
    file = place["file_name"]
    turn = [F.regexp_extract(file, pattern, 1).cast("long") for pattern in (r"^part-(\d+)-", r"-c(\d+)\.")]
    files = docs.groupBy(file.alias("file"), turn[0].alias("task"), turn[1].alias("turn")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("task", "turn").rowsBetween(Window.unboundedPreceding, -1)
    # a row a file; written first, so that its size is known before it is joined
    files = staged(files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "files")
    rows = docs.select("*", file.alias("file"), place["row_index"].alias("row_index")).join(files, "file")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col("before") + F.col("row_index")).alias("position"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position (the place in the mixture, from 0), n_tokens, ids and the digests of ids and decoded bytes."""
    return _made(docs, lambda d: digests(with_position(d.select("doc_id", "text")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep=("position",)))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("mixture", mixture), ("encoding", encoding)]

#: Fingerprint components and byte-pair merges are beyond SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        written = Staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before:
            before.drop()
        docs, before = written.df, written
    return docs
