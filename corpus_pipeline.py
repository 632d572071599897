"""The corpus pipeline: five operators one after another over whole documents.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Rows whose
text changes get their new number of characters. What a stage decides is attached by a row key, the
same for every scan of the same files, so null or repeated ids and repeated rows are safe. Columns of
any name may follow those of documents; an empty table gives an empty table; very long texts are
treated whole like all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import dropped, scannable, stored, table, unused, with_row_key
from assayer.llm.langid import UNKNOWN, fit, predict
from assayer.llm.line_dedup import line_dedup
from assayer.llm.packing import pack_documents
from assayer.llm.pii import pii_documents, redacted
from assayer.llm.queries import LANG_HELD_OUT, vocabulary
from assayer.llm.shingles import shingle_groups

#: Documents with a lower language score, or without a letter, go.
MIN_LANG_SCORE = 0.35
#: Shingles of the near-duplicate stage have five words; a Jaccard similarity of 0.8 links.
STAGE_WORDS = 5


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, with n_chars (where documents has it) following the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier can tell. Null texts and texts without letters go.
    Where no document has a label nothing is learned, and only those go."""
    net = fit(docs, f"NOT ({LANG_HELD_OUT})")
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = unused(docs, "_lang"), unused(docs, "_score")
    found = predict(docs, net, passed=tuple(docs.columns), names=(lang, score))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= MIN_LANG_SCORE)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with an earlier one. A document all of whose
    lines go was a copy and goes too; one that was blank before stays."""
    done = line_dedup(docs)
    emptied = (F.size(f"{done.columns[-1]}.removed") > 0) & ~F.col("text").rlike(r"\S")
    return _counted(done.where(~F.coalesce(emptied, F.lit(False))), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id (null last), of rows that repeat it one."""
    docs = scannable(docs)
    row = unused(docs, "_row")
    groups = shingle_groups(docs, words=STAGE_WORDS)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    first = stored(groups.groupBy("root").agg(F.min(order)["rid"].alias(row)).select(row), "first")
    return with_row_key(docs, row).join(first.hint("merge"), row, "left_semi").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    docs = scannable(docs)
    row, spans = unused(docs, "_row"), unused(docs, "_spans")
    found = stored(pii_documents(docs).where(F.size("found") > 0).select(F.col("rid").alias(row), F.col("found").alias(spans)), "spans")
    done = with_row_key(docs, row).join(found.hint("merge"), row, "left")
    text = F.when(F.col(spans).isNotNull(), redacted(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    return _counted(done.withColumn("text", text), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its sequence and place."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json")).drop("rid")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]

#: Training a network, patience diff and packing have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
