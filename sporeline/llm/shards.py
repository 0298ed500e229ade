"""Proportional stratified interleaving of a corpus into shards.

Rows of a source are ranked in a seeded shuffled order; a row's fractional
rank is (rank + 1/2) / rows of the source. Sorting all rows by fractional rank
spreads every source evenly over the whole order, and cutting that order into
equal blocks gives every shard the mixture of the corpus.

No rank needs all rows of a source in one task: the shuffle key, an MD5 of the
seed and the id, is uniform, so its leading digits cut each source into
buckets whose counts give each bucket's first rank. The same holds for the
second ranking, over buckets of the fractional rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def proportional_shards(docs: DataFrame, n_shards: int, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with ``shard`` (0 to n_shards - 1) and ``slot`` (0, 1, ... in each shard).

    Shard sizes differ by at most one row, and so do the shares of a source in
    any two shards, up to rounding of each cut. Null sources form one stratum.
    Rows equal in id and source are interchangeable and get neighbouring
    slots. Columns named ``shard`` or ``slot`` are replaced; an empty table
    stays empty.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_src"),
        digest.alias("_key"),
        F.conv(F.substring(digest, 1, 3), 16, 10).cast("int").alias("_cell"),
    )
    cells = rows.groupBy("_src", "_cell").agg(F.count("*").alias("_n"))
    by_source = Window.partitionBy("_src")
    cells = cells.select(
        "_src", "_cell",
        (F.sum("_n").over(by_source.orderBy("_cell")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(by_source).alias("_size"),
    )
    ranked = rows.join(cells, ["_src", "_cell"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_src", "_cell").orderBy("_key")) - 1
    )
    ranked = ranked.withColumn("_frac", (2 * F.col("_rank") + 1) / (2.0 * F.col("_size")))
    ranked = ranked.withColumn("_slice", F.floor(F.col("_frac") * BUCKETS))
    slices = ranked.groupBy("_slice").agg(F.count("*").alias("_m"))
    everything = Window.partitionBy()
    slices = slices.select(
        "_slice",
        (F.sum("_m").over(everything.orderBy("_slice")) - F.col("_m")).alias("_first"),
        F.sum("_m").over(everything).alias("_all"),
    )  # one row a slice, 4096 at most
    placed = ranked.join(F.broadcast(slices), "_slice").withColumn(
        "_at", F.col("_first") + F.row_number().over(Window.partitionBy("_slice").orderBy("_frac", "_src", "_rank")) - 1
    )
    placed = placed.withColumn("shard", F.expr(f"cast((_at * {n_shards}) div _all as int)"))
    placed = placed.withColumn("slot", F.expr(f"_at - ((shard * _all + {n_shards - 1}) div {n_shards})"))
    return placed.select(*[F.col("_row")[c].alias(c) for c in own], "shard", "slot")


def op1_interleaved_shards(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of ``documents``, law ``rows``, 24 shards.

    Nulls, empty and very long texts, repeated rows, further columns and empty
    tables are taken as ``proportional_shards`` says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return proportional_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP1_SQL = """
WITH RECURSIVE step(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, source, coalesce(text, '') AS txt, row_number() OVER () AS rid FROM documents),
b AS (SELECT *, hex(encode(txt)) AS h FROM d),
c AS (SELECT *, (length(h) // 2 + 8)::BIGINT AS size,
        xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT),
             lambda acc, x: xor(acc // 256, t[xor(acc % 256, x) + 1]), 4294967295), 4294967295) AS crc
      FROM b CROSS JOIN tab),
r AS (SELECT doc_id, size, crc, coalesce('=' || source, '') AS src,
        row_number() OVER (PARTITION BY source ORDER BY md5('17:' || coalesce(doc_id::VARCHAR, 'null'))) - 1 AS rk,
        count(*) OVER (PARTITION BY source) AS n FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rk + 1)::DOUBLE / (2.0::DOUBLE * n), src, rk) - 1 AS pos, count(*) OVER () AS total FROM r),
s AS (SELECT *, ((pos * 24) // total)::INTEGER AS shard FROM p)
SELECT doc_id, size, crc::BIGINT AS text_crc32, 'rows' AS law, shard, (pos - (shard::BIGINT * total + 23) // 24)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard FROM s
"""
