"""Token counts as delta-maintained rollups.

A batch of changes (inserts, deletes, revised texts) becomes signed rows:
+1 document and its tokens, -1 document and its tokens, or both for a
revision. Totals by source, language and tokenizer version are sums of signed
rows, so a batch is added to them without reading older documents. A batch is
committed once by its name, so delivering it twice changes nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.functions.storage import discard, materialize, shared_dir
from sporeline.llm.batches import Batches
from sporeline.llm.bpe import codec, vocabulary

KEYS = ("source", "lang", "tokenizer")
ROWS = "source string, lang string, tokenizer string, docs long, tokens long"


def bpe_count(shared: Broadcast):
    """Counter of one vocabulary; null and empty texts have no tokens."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        made = codec(shared)
        return pd.Series([len(made.encode(t)) if t else 0 for t in texts], dtype="int64")

    return count


def word_count(text: Column) -> Column:
    """Counter of the version that takes words between white space as tokens."""
    return F.when(F.length(F.btrim(text, F.lit(" \t\n\x0b\f\r"))) > 0, F.size(F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def measured(docs: DataFrame, counters: dict, text_col: str = "text", also: dict | None = None) -> DataFrame:
    """(source, lang, counts, one column for each of ``also``): each row's tokens by counter, in their order.

    Null and empty texts have no tokens, long ones are counted whole. Repeated
    rows each get a row, other columns are not used, and an empty table gives
    an empty one. Rows are counted here once and can be summed many times.
    """
    counts = F.array(*[F.coalesce(c(F.col(text_col)), F.lit(0)).cast("long") for c in counters.values()])
    return docs.select("source", "lang", counts.alias("counts"), *[v.alias(k) for k, v in (also or {}).items()])


def signed(rows: DataFrame, names, sign: int = 1, times: Column | None = None) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens): totals of measured rows that come (1) or go (-1), each ``times`` over."""
    n = (F.lit(1) if times is None else times).cast("long") * sign
    sums = rows.groupBy("source", "lang").agg(F.sum(n).alias("docs"), *[F.sum(n * F.get("counts", F.lit(i))).alias(f"t{i}") for i, _ in enumerate(names)])
    each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(f"t{i}").alias("tokens")) for i, name in enumerate(names)])
    return sums.select("source", "lang", "docs", F.explode(each).alias("r")).select("source", "lang", "r.tokenizer", "docs", "r.tokens")


def signed_counts(docs: DataFrame, counters: dict, sign: int = 1, text_col: str = "text") -> DataFrame:
    """(source, lang, tokenizer, docs, tokens) partial totals of documents that come (1) or go (-1).

    Null sources and languages are keys of their own. Null and empty texts
    count as documents without tokens. Repeated rows count each. An empty
    table gives an empty one.
    """
    return signed(measured(docs, counters, text_col), counters, sign)


def revised_counts(before: DataFrame, after: DataFrame, counters: dict) -> DataFrame:
    """Signed rows of documents whose text, source or language changes: the old go, the new come."""
    return add(signed_counts(before, counters, -1).unionByName(signed_counts(after, counters, 1)))


def add(rows: DataFrame) -> DataFrame:
    """Totals of signed rows."""
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup(Batches):
    """Totals kept as committed batches of signed rows; ``commit`` adds a batch once."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, ROWS)

    def totals(self) -> DataFrame:
        """Sums over all committed batches, empty before the first; groups whose documents are all gone leave."""
        return add(self.read()).where("docs <> 0 OR tokens <> 0")


def later_copies(rows: DataFrame) -> DataFrame:
    """Measured rows with ``fp`` and ``id``, one of each text, source and language, and how many of such rows are later copies (``gone``).

    Of all rows of one text, one of the least id stays (rows without an id
    come last; of one id the least source and language stays). So of repeated
    rows one stays. Nothing of a text is collected: its rows are counted, with
    partial sums before the shuffle.
    """
    groups = rows.groupBy("fp", "source", "lang").agg(F.count("*").alias("n"), F.first("counts").alias("counts"), F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"))
    place = F.struct("first", "source", "lang")
    heads = groups.groupBy("fp").agg(F.min(place).alias("head"), F.sum("n").alias("all")).where("all > 1").select("fp", "head")
    gone = F.col("n") - (place == F.col("head")).cast("long")
    return groups.join(heads, "fp").select("source", "lang", "counts", gone.alias("gone")).where("gone > 0")


def op7_token_rollups(spark, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version of all ``documents`` without later copies of a text.

    Batch 1 inserts every document, batch 2 deletes every copy of a text but
    the one of least doc_id, and batch 1 is delivered again, to no effect.

    Nulls, empty and very long texts, repeated rows, further columns and empty
    tables are taken as ``measured`` says.
    """
    import uuid

    import public_tokenizers

    shared = vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    counters = {"byte_bpe_50k": bpe_count(shared), "words": word_count}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    fp = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = materialize(measured(docs, counters, also={"id": F.col("doc_id"), "fp": fp}))
    rollup = Rollup(spark, f"{shared_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}")
    rollup.commit("insert", signed(rows, counters))
    rollup.commit("drop-copies", signed(later_copies(rows), counters, -1, F.col("gone")))
    rollup.commit("insert", signed(rows, counters))
    discard(rows)
    return rollup.totals()
