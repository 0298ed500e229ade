"""Corpus pipeline: quality rules, near-dedup, decontamination, secret scan, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's input. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.functions.columns import fresh
from sporeline.functions.storage import materialize
from sporeline.llm.bpe import encode, vocabulary
from sporeline.llm.decontam import drop_contaminated
from sporeline.llm.near_dedup import one_of_each_class
from sporeline.llm.quality import quality
from sporeline.llm.secrets import redact, scan_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps.

    Null, empty and short texts go. Repeated rows stay repeated, other columns
    pass through, and an empty table gives an empty one.
    """
    verdict = fresh(docs, "_quality")
    return quality(docs, out=verdict).where(F.col(verdict)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near-duplicates.

    Null and empty texts are one class. Rows without an id stay only where
    their class has no id; of rows equal in id and text one stays. Other
    columns pass through; an empty table gives an empty one.
    """
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; rows without an id stay. Repeated rows stay
    repeated, other columns pass through, and an empty table gives an empty one.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and ``n_chars`` brought up to date.

    The ledger takes the documents in two deliveries, by source, and scans no
    text twice. Rows without findings, null and empty texts stay as they are,
    repeated rows are masked each, other columns pass through, and an empty
    table gives an empty one.
    """
    blob, found, masked = (fresh(docs, name) for name in ("_blob", "_findings", "_masked"))
    scanned = scan_secrets(docs, source_col="source", blob_col=blob, findings_col=found).withColumn(masked, redact(F.col("text"), F.col(found)))
    changed = {"text": F.coalesce(masked, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(masked).isNotNull(), F.length(masked).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return scanned.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of each document's whole text.

    Null and empty texts have no tokens; repeated rows are encoded each; an
    empty table gives an empty one.
    """
    import public_tokenizers

    shared = vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encode(docs.select("doc_id", "text"), shared).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_tokens", bpe_tokens),
]

#: Near-dedup, edit distance and BPE have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
