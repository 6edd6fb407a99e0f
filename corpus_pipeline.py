"""From raw documents to token ids: language, near copies, benchmark passages, secrets, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and keeps the columns of documents; the last returns token counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import bpe, common, decontaminate, jaccard, language, secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without letters) go; a null lang becomes the predicted one.

    Repeated rows each stay or go; ties of languages go by name. An empty table gives none. Columns beyond those of
    documents are dropped, in this stage and all after it.
    """
    found = language.predict(docs, language.learned(docs), keep=COLUMNS[1:])
    return found.where(F.col("lang_pred") != "und").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id (then text hash) stays; rows that repeat its id and text become one.

    Rows of one id with unlike texts are documents of their own. Null ids and texts without words stay; an empty table
    gives none.
    """
    found = jaccard.join(docs)
    gone = found.where((F.col("group_id") != F.col("doc_id")) | (F.col("group_hash") != F.col("text_hash"))).select("doc_id", "text_hash").distinct()
    left = docs.withColumn("text_hash", F.xxhash64("text")).join(gone, ["doc_id", "text_hash"], "left_anti")
    return left.dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; null texts hold none. An empty table or benchmark is as good as any."""
    found = decontaminate.match(docs, common.table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.where("n_hit = 0").select(*COLUMNS)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, repeated rows too; found spans become `[secret]` and n_chars follows the text. Null texts stay null."""
    common.shared_dir(spark)
    found = secrets.findings(docs, common.scratch(spark, "ledger"))
    text = F.when(F.size("found") > 0, secrets.redact(F.col("text"), F.col("found"))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; null and empty texts have no tokens, an empty table no rows."""
    return bpe.encode_public(docs)


STAGES = [("language", languages), ("near copies", near_copies), ("benchmark", benchmark_passages), ("secrets", secret_spans), ("byte-level BPE", token_ids)]

#: Stages 1, 2 and 5 have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.kept(docs, f"stage-{k}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
