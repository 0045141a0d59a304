"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.core import materialize
from gristmill.llm import contamination, langid, neardup, packing, secrets
from gristmill.llm.common import read_text, table

#: Documents under this posterior, or without letters, are rejected.
LEAST_SCORE = 0.5


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; lang becomes the language found.

    Null, empty and letterless texts go. Where no training row has a language, nothing can
    be told and all documents stay as they are. Repeated rows and null doc_ids keep a row
    each; an empty table gives no rows; further columns, whatever their names, pass through.
    """
    pieces = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = langid.train(langid.training_rows(docs), pieces)
    if not model[0]:
        return docs
    found = langid.identify(docs.toDF(*[c if c == "text" else f"own_{c}" for c in docs.columns]), model, pieces)
    kept = found.where((found["lang_pred"] != langid.UNKNOWN) & (found["score"] >= LEAST_SCORE))
    name = {"text": "text", "lang": "lang_pred"}
    return kept.select(*[F.col(name.get(c, f"own_{c}")).alias(c) for c in docs.columns])


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one document of each group of near copies: that with the smallest doc_id.

    Rows are told apart by a number of their own, so an id that stands for several texts
    does no harm. Documents without doc_id count as larger than all others; of equal ids
    the first row stays, so repeated rows become one. Documents without words are copies
    of nothing and all stay. An empty table gives no rows; further columns pass through.
    """
    numbered = materialize(docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_n")), "numbered")
    judged = neardup.near_duplicates(numbered.select(F.col("_n").alias("doc_id"), "_row.text"))
    ids = numbered.select("_n", F.col("_row.doc_id").alias("id"))
    order = F.min(F.struct(F.col("id").isNull(), "id", "_n"))["_n"]
    kept = judged.join(ids, judged["doc_id"] == ids["_n"]).groupBy("component_id").agg(order.alias("_n")).select("_n")
    return numbered.join(kept, "_n", "left_semi").select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null, empty and wordless texts, and all documents of an empty benchmark, stay. Repeated
    rows and null doc_ids keep a row each; an empty table gives no rows; further columns pass through.
    """
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars made to fit.

    Null and empty texts, repeated rows and null doc_ids stay as they are; an empty table
    gives no rows; further columns pass through.
    """
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence (see packing.pack_documents).

    A null or empty text has its end id only. Repeated rows and null doc_ids keep all their
    pieces; an empty table gives no rows; further columns are not read.
    """
    return packing.pack_documents(docs, read_text(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", keep_identified), ("near_duplicates", keep_first_copies), ("decontamination", drop_contaminated),
    ("secret_masking", mask_secrets), ("packing", pack),
]

#: SQL cannot express the language model, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
