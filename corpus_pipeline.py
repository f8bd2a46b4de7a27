"""The corpus pipeline: language ID, line dedup, near-dedup, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents; each is written to the shared folder and read again before the next begins.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unitflow.llm.common import quoted, read_documents, unused, written
from unitflow.llm.language_id import labelled, language_id
from unitflow.llm.line_dedup import line_dedup
from unitflow.llm.near_dedup import near_components
from unitflow.llm.packing import pack_documents
from unitflow.llm.pii import redact


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """docs with another text, and n_chars to go with it where the table has it."""
    docs = docs.withColumn("text", text)
    return (docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in columns else docs).select(*quoted(columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text or no letter) go; lang becomes the predicted one. Where no row is labelled, nothing
    can be learned: then documents with a letter stay as they are. Rows that repeat a doc_id are judged each by its own text."""
    if labelled(docs).isEmpty():
        return docs.filter(F.col("text").rlike("\\p{L}"))
    found = language_id(docs).filter("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*quoted(docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that many documents hold, all but those of the largest doc_id; every document stays. Rows that repeat a
    doc_id count as one document for a line, and each loses its own. Null and empty texts stay as they are, null as empty."""
    return _with_text(line_dedup(docs), F.col("kept_text"), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest doc_id. Shingles have five words. Where rows share a
    doc_id, each distinct text counts as a document of its own, ordered by (doc_id, text); of equal texts one row stays,
    the first by its other columns. Rows without a doc_id stay."""
    known = docs.filter("doc_id is not null")
    if known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        kept = near_components(docs).filter("kept and doc_id is not null").select("doc_id")
        stay = known.join(kept, "doc_id", "left_semi")
    else:
        others = quoted([c for c in docs.columns if c not in ("doc_id", "text")])
        at, row = unused(docs.columns, "place", "row")
        place = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*others or ["doc_id"]))
        rows = known.withColumn(at, place).filter(F.col(at) == 1).orderBy("doc_id", "text")
        rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "pipeline-near-rows")
        kept = near_components(rows.select(F.col(row).alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias(row))
        stay = rows.join(kept, row, "left_semi")
    return stay.select(*quoted(docs.columns)).unionByName(docs.filter("doc_id is null"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes <KIND>; every document stays, and so do null and empty texts. Where spans overlap, the earlier
    stands, of two that begin together the longer. Rows that repeat a doc_id are read each by its own text."""
    return _with_text(redact(docs), F.col("text"), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences of 2048 tokens. Rows that repeat a doc_id are packed each; equal
    lengths are placed by doc_id, piece and checksum; a null text is the end id alone."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
