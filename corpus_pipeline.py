"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination and mixing over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame whose columns are those of ``docs``, extra ones included,
whatever their names. The rows of a repeated doc_id are told apart by their texts. An empty table gives no rows. Very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bagminhash, decontaminate, langid, linededup, mixing
from palimpsest.llm.shared import Scratch, materialize

#: Columns that the stages work on; others travel in one struct, where no name can clash.
USED = ("doc_id", "text", "lang", "source", "n_chars")
#: Calibrated probability below which the language of a document is not accepted.
MIN_SCORE = 0.5


def _packed(docs: DataFrame) -> DataFrame:
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in USED]
    return docs.select(*USED, *([F.struct(*rest).alias("__rest")] if rest else []))


def _unpacked(rows: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    """The columns of ``docs``, as they came, and ``more``."""
    return rows.select(*[F.col(c) if c in USED else F.col("__rest")[c].alias(c) for c in docs.columns if c not in more], *more)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised: not ``und``, and with a probability of ``MIN_SCORE`` at least.

    The classifier learns from the rows that have text and lang. Null, empty and letterless texts go; repeated rows stay
    or go together; without any labelled row all go.
    """
    model = langid.train(docs, F.lit(True))
    found = langid.identify(_packed(docs), model, out="__found")
    return _unpacked(found.where((F.col("__found.lang") != "und") & (F.col("__found.score") >= MIN_SCORE)), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take boilerplate lines of each source out of the texts, and set n_chars anew; every document stays.

    A null source is a source of its own; null texts stay null, with null n_chars.
    """
    out = linededup.drop_boilerplate(_packed(docs), out="__lines")
    return _unpacked(out.withColumn("n_chars", F.length("text").cast("bigint")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class: the one with the least doc_id.

    Null, empty and blank texts are no copies and stay, as do rows without doc_id; of rows that agree in doc_id and words
    one stays.
    """
    return _unpacked(bagminhash.keep_one(_packed(docs)), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no item of ``benchmark``; null and empty texts hold none, repeated rows go together."""
    out = decontaminate.decontaminate(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="__items")
    return _unpacked(out.where(F.size("__items") == 0), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, with the number of the copy in ``mix_copy``.

    Documents without words are taken by the rate of their source like others; a source without words is not taken.
    """
    return _unpacked(mixing.repeat_rows(mixing.mix(_packed(docs), out="__mix"), "__mix"), docs, "mix_copy")


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("mixing", mixture),
]

#: Language ID, near-dedup and decontamination can't be said in SQL: tests/llm/test_pipeline.py compares every stage with
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read back by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as early:
        for _, stage in STAGES[:-2]:
            docs = early.write(stage(spark, docs, sf_dir))
        docs = materialize(STAGES[-2][1](spark, docs, sf_dir))  # the mix still reads this one
    return STAGES[-1][1](spark, docs, sf_dir)
