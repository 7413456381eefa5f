"""A corpus pipeline from raw documents to packed token sequences.

``STAGES`` are functions of (spark, docs, sf_dir). Each works on what the one
before it kept; all but the last return the columns of ``documents``. ``run``
writes the result of each stage as Parquet and reads it again for the next one.

In every stage a null text counts as empty, an empty table gives an empty result,
and columns beyond those of ``documents`` pass unchanged, whatever their names (but
for the last stage, which has columns of its own). What each does with null and
repeated ids and with ties is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import decontaminate, entries, importance, line_dedup, near_dedup
from tidegauge.llm.scratch import Scratch


def _aside(docs: DataFrame, names: tuple[str, ...], operator) -> DataFrame:
    """``operator`` on ``docs``, without the columns ``names`` that it adds; columns of ``docs`` that are called so come back as they were."""
    away = {c: f"{c} of the input" for c in names if c in docs.columns}
    out = operator(docs.withColumnsRenamed(away)).drop(*names)
    return out.withColumnsRenamed({b: a for a, b in away.items()}).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; the others go.

    Rows with a null id are scored like all others. Equal rows (repeats, ties) are
    selected or go together. Without labels all stay.
    """
    labels = entries.table(spark, sf_dir, "labels")
    return _aside(docs, ("log_weight", "sample_key"), lambda rows: importance.select(rows, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten rows or more share; ``n_chars`` follows the text.

    Every row counts, null and repeated ids included; a null text becomes an empty one.
    No row goes.
    """
    out = _aside(docs, ("n_lines", "n_dropped"), lambda rows: line_dedup.drop_common_lines(rows, min_docs=10))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Rows with a null id stay. Rows that repeat an id are one document with several
    texts: they stay or go together.
    """
    copies = near_dedup.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id")
    return docs.join(copies.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; judged row by row, null and repeated ids included. An empty benchmark removes nothing."""
    return decontaminate.without_contaminated(docs, entries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the packed sequences; every row is packed, null and repeated ids included."""
    return entries.packed(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", pack),
]

#: SQL can express neither the classifier nor the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = entries.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs
