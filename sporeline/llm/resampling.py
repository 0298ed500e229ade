"""Importance resampling of a corpus towards a target distribution, by bit-sliced aggregation.

A feature is hashed to one of 10,000 buckets; a bucket's gain is the scaled
log ratio of its smoothed shares in target and corpus. A document's weight is
the sum of its features' gains, and is worked out without a multiplication a
feature: its bucket counts are written as planes of 10,000 bits, plane j
holding bit j of every count, and the gains likewise as planes of positive and
of negative bits. The weight is the sum, over pairs of a count plane j and a
gain plane k, of 2^(j+k) times the population count of the two planes' AND.

The corpus is read twice, to count its buckets and to weigh its documents;
neither pass keeps more than one batch of texts and 10,000 numbers. Drawing
uses Gumbel noise from a digest of the id, so that the highest scores are a
sample without replacement, and ranks come from a sort by range.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeline.functions.columns import fresh
from sporeline.functions.numbering import numbered
from sporeline.functions.storage import materialize

BUCKETS = 10_000
#: Bytes to word bytes: digits, small letters and bytes of characters beyond ASCII stay, A-Z become small, the rest parts words.
_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def features(text: str | None, width: int = 1) -> list[bytes]:
    """All runs of 1 to ``width`` consecutive words as UTF-8, repeats counted; none for null."""
    words = (text or "").encode().translate(_WORD_BYTES).split(b" ")
    words = [w for w in words if w]
    return words + [b" ".join(words[i : i + n]) for n in range(2, width + 1) for i in range(len(words) - n + 1)]


def counts_of(text: str | None, n_buckets: int = BUCKETS, width: int = 1) -> np.ndarray:
    """How many features of a text each bucket holds."""
    found = features(text, width)
    return np.bincount(np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % n_buckets, minlength=n_buckets)


def planes(values: np.ndarray) -> np.ndarray:
    """Bits of whole numbers of 0 or more: row j holds bit j of every value, packed into 64-bit words."""
    depth = int(values.max(initial=0)).bit_length()
    bits = (values[None, :] >> np.arange(depth)[:, None] & 1).astype(np.uint8)
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)


class Scales:
    """Gain planes of one set of gains, positive planes first, and what a bit in each is worth."""

    def __init__(self, gains: np.ndarray):
        up, down = planes(np.maximum(gains, 0)), planes(np.maximum(-gains, 0))
        self.planes = np.concatenate([up, down])
        self.worth = np.concatenate([1 << np.arange(len(up)), -(1 << np.arange(len(down)))]).astype(np.int64)

    def weigh(self, counts: np.ndarray) -> int:
        total = 0
        for j, plane in enumerate(planes(counts)):
            total += int((np.bitwise_count(plane & self.planes).sum(axis=1, dtype=np.int64) * self.worth).sum()) << j
        return total


def bucket_counts(texts: DataFrame, text_col: str = "text", n_buckets: int = BUCKETS, width: int = 1) -> DataFrame:
    """(bucket, n) over all texts: each task sends one row a bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += counts_of(text, n_buckets, width)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held.astype(np.int32), "n": total[held]})

    each = texts.select(F.col(f"`{text_col}`").alias("text")).mapInPandas(count, "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> list[int]:
    """Gain of every bucket from (bucket, n) of corpus and target; a list of ``n_buckets`` numbers, whatever the corpus."""
    s, t = ({r["bucket"]: r["n"] for r in side.collect()} for side in (corpus, target))  # one row a bucket at most
    S, T = sum(s.values()), sum(t.values())
    share = lambda b: float(t.get(b, 0) + 1) * float(S + n_buckets) / (float(s.get(b, 0) + 1) * float(T + n_buckets))
    return [math.floor(1000 * math.log(share(b))) for b in range(n_buckets)]


def weigh(docs: DataFrame, values: list[int], text_col: str = "text", width: int = 1, out: str = "weighed") -> DataFrame:
    """``docs`` with ``out``: struct of n_features and weight, the sum of the gains of a text's features (null and empty texts: 0 and 0)."""
    n_buckets = len(values)
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(values, np.int64))  # a number a bucket

    @F.pandas_udf("n_features long, weight long")
    def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scales = Scales(shared.value)
        for texts in batches:
            rows = [(int(c.sum()), scales.weigh(c)) for c in (counts_of(t, n_buckets, width) for t in texts)]
            yield pd.DataFrame(rows, columns=["n_features", "weight"], dtype="int64")

    return docs.withColumn(out, weighed(F.col(f"`{text_col}`")))


def target_resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_features: int = 20, seed: int = 2024,
    n_buckets: int = BUCKETS, width: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, n_features, weight, score and rank of every document; the rank is null where the document is not drawn.

    Of the N documents with at least ``least_features`` features,
    ``percent`` of a hundred (rounded down) are drawn by highest score, ties
    to the smaller id, rows without an id last. Rows equal in all of these are
    drawn one by one. The noise of a row without an id is that of the text
    "null". Null and empty texts have no features and weight 0. An empty
    corpus gives an empty table; an empty target is smoothed like any other.
    Other columns are left out. The noise and the gains hang on ids and whole
    counts only, so a run again gives the same draw.
    """
    values = gains(bucket_counts(docs, text_col, n_buckets, width), bucket_counts(target, text_col, n_buckets, width), n_buckets)
    rows = weigh(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")), values, "_text", width)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(rows.select(F.col("_id").alias(id_col), "weighed.n_features", "weighed.weight", (F.col("weighed.weight") + noise).alias("score")))
    able = F.col("n_features") >= least_features
    n_drawn = percent * scored.where(able).count() // 100
    row, place = fresh(scored, "_row"), fresh(scored, "_place")
    # the place in the written table parts rows that are equal in all else, so no group of them is one range
    entries = scored.where(able).withColumn(row, F.monotonically_increasing_id())
    ranked = numbered(entries, [F.col("score").desc(), F.col(f"`{id_col}`").asc_nulls_last(), F.col("n_features"), F.col(row)], place)
    ranked = ranked.withColumn("rank", F.when(F.col(place) <= n_drawn, F.col(place))).drop(row, place)
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def op12_target_resampling(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of ``documents``, drawn towards ``benchmark``.

    Nulls, empty and very long texts, ties, repeated rows, further columns and
    empty tables are taken as ``target_resample`` says.
    """
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c) for t, c in (("documents", ["doc_id", "text"]), ("benchmark", ["text"])))
    return target_resample(docs, items)


OP12_SQL = r"""
WITH RECURSIVE step(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
words AS (SELECT rid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM d),
aims AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM benchmark),
kinds AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM words UNION SELECT w FROM aims)),
crc AS (SELECT w, (xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT),
          lambda acc, x: xor(acc // 256, t[xor(acc % 256, x) + 1]), 4294967295), 4294967295) % 10000)::BIGINT AS bucket FROM kinds CROSS JOIN tab),
s AS (SELECT bucket, count(*) AS n FROM words JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM aims JOIN crc USING (w) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS big_s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS big_t),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (big_s + 10000) / ((s.n + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS g
         FROM s LEFT JOIN t USING (bucket) CROSS JOIN sums),
w AS (SELECT rid, count(*) AS n, sum(g)::BIGINT AS g FROM words JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY rid),
scored AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(g, 0)::BIGINT AS weight,
             (coalesce(g, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
           FROM d LEFT JOIN w USING (rid)),
able AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, n_features) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM able
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
"""
