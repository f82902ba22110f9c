"""The corpus pipeline: documents in, token ids out, through five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one
before kept; run() writes every stage's result and reads it back. All stages
but the last return the columns of documents; n_chars follows the text.

Columns beyond doc_id, text, lang and n_chars pass through untouched, whatever
their names. An empty table gives an empty one at every stage. What a stage does
with nulls, empty texts and repeated rows stands in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import bpe, decontaminate, langid, line_dedup, near_copies
from prosegauge.llm.common import lookup, read, settle, unused

#: A document whose likeliest language has a lower calibrated probability has no clear language.
LEAST_CLEAR = 0.3
#: SQL can express neither the language model nor the fingerprints.
ORACLE_SQL = None


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator reads, and the whole row beside them, so that no name of the row meets the operator's."""
    return docs.select(*columns, F.struct("*").alias("_row"))


def _unpacked(found: DataFrame, columns: list[str], **new: str) -> DataFrame:
    """The rows again, some of their columns new ones."""
    return found.select(*[F.expr(new[c]).alias(c) if c in new else F.col("_row")[c].alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: those without letters (null and empty texts too), or without a clear language, go. Null langs teach nothing; repeated rows stay or go together."""
    found = langid.learn_and_predict(_packed(docs, "doc_id", "text", "lang"))
    return _unpacked(found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_CLEAR)), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds. Null texts and rows with a null doc_id stay as they are; rows that repeat a doc_id are one document."""
    kept = line_dedup.dedup(_packed(docs, "doc_id", "text"))
    return _unpacked(kept, docs.columns, text="text", **({"n_chars": "CAST(char_length(text) AS BIGINT)"} if "n_chars" in docs.columns else {}))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8 or more).

    Of rows that repeat a doc_id the one with the smallest text stays. Texts
    without words are copies of each other. Rows with a null doc_id stay.
    """
    found = settle(near_copies.near_copies(docs.select("doc_id", "text"), width=5, least=0.8), "near-duplicates")
    goes, rows = unused(docs.columns, "goes", "row")
    again = found.where("doc_id <> component_id").select(F.col("doc_id"), F.lit(True).alias(goes)).distinct()
    out = lookup(docs.select("doc_id", F.struct("*").alias(rows)), "doc_id", again, by=[rows]).where(F.col(goes).isNull()).select(f"{rows}.*")
    if found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty():
        return out
    one = out.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct("*"), F.coalesce("text", F.lit(""))).alias("_row"))
    return _unpacked(one, docs.columns).unionByName(out.where("doc_id IS NULL"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts hold none; repeated rows stay or go together."""
    found = decontaminate.overlaps(_packed(docs, "text"), read(spark, sf_dir, "benchmark"))
    return _unpacked(found.where(F.col("hits.n_hit") == 0), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the text that they decode to. Null and empty texts have no ids; repeated rows and null doc_ids stay."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs, path, pieces=bpe.vocabulary(spark, path))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, f"stage-{i}")
    return docs
