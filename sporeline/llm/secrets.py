"""Secret scan over an incremental blob ledger, in DataFrame operations only.

Every version of every path names a blob by the SHA-256 of its text. A blob is
scanned once for each version of the rule set: pairs that the ledger already
holds are skipped, the findings of new pairs are appended, and findings are
joined back to every path that carries the blob. The ledger is a set of
committed batches in the shared folder, so a delivery that comes twice is
scanned once.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sporeline.functions.columns import fresh
from sporeline.functions.storage import shared_dir
from sporeline.llm.batches import Batches

# Kinds in their order, pattern, and the least length of a group for a match to stand.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    # a run below the least length hides no other match of its kind, so these two state the length in the pattern
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What a match that stands must contain; a cheap test before the match positions are worked out.
HINTS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
RULES_VERSION = "base-1"

FINDING = "array<struct<start:long,rank:int,kind:string,end:long>>"
LEDGER = f"blob string, rules_version string, findings {FINDING}"


def blob_id(text: Column) -> Column:
    """Content address; a null text has the address of the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _pieces(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Length of the gap before each match, of the match, and whether it stands, in order."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    # arrays_zip pads to the gaps, of which there is one more than matches
    made = F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), kept.alias("part")),
        lambda x, i: F.struct(
            F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), i.alias("i"),
            F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("hit"), (F.length(x["part"]) >= least).alias("stands"),
        ),
    )
    return F.when(text.rlike(HINTS[kind]), made)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, findings) for the blobs that have findings; ``blobs`` has blob, text.

    Positions are code points: the pieces between matches and the matches
    themselves add up to the text, so running sums of their lengths are the
    places. The sums run over one row a match, not over the text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.array(*[_pieces(text, rank, *rule) for rank, rule in enumerate(RULES)])
    rows = (
        blobs.select("blob", F.explode(found).alias("a"))
        .where("a IS NOT NULL")
        .select("blob", F.explode("a").alias("x"))
        .where("x.hit IS NOT NULL")
        .select("blob", "x.*")
    )
    order = Window.partitionBy("blob", "kind").orderBy("i")
    ends = F.sum(F.col("gap") + F.col("hit")).over(order)
    placed = rows.withColumn("end", ends).where("stands")
    one = F.struct((F.col("end") - F.col("hit")).alias("start"), "rank", "kind", "end")
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(one)).alias("findings"))


def _unseen(versions: DataFrame, ledger: DataFrame | None, rules_version: str) -> DataFrame:
    if ledger is None:
        return versions
    return versions.join(ledger.where(F.col("rules_version") == rules_version).select("blob").distinct(), "blob", "left_anti")


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules_version: str = RULES_VERSION) -> DataFrame:
    """Ledger rows to append: (blob, rules_version, findings) of unseen pairs.

    ``versions`` has blob, text; ``ledger`` the same columns as the result.
    A blob without findings gets a row with an empty list, so that it counts
    as seen. Copies of a text meet in one partial aggregation, so a text that
    a third of all rows share is shipped once by each task. A text in which no
    rule can match (HINTS) is seen where it lies and not shipped at all.
    """
    unseen = _unseen(versions, ledger, rules_version)
    maybe = unseen.where(reduce(or_, [F.col("text").rlike(hint) for hint in HINTS.values()]))
    scanned = scan_blobs(maybe.groupBy("blob").agg(F.first("text").alias("text")))
    named = unseen.select("blob").distinct().join(scanned, "blob", "left")
    return named.select("blob", F.lit(rules_version).alias("rules_version"), F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def with_findings(docs: DataFrame, ledger: DataFrame, rules_version: str = RULES_VERSION, text_col: str = "text", blob_col: str = "blob", findings_col: str = "findings") -> DataFrame:
    """``docs`` with the blob of each row and the ledger's findings of it (start, rank, kind, end by start, then kind).

    Rows of blobs that the ledger has no row of get an empty list. Columns
    named ``blob_col`` or ``findings_col`` are replaced, others pass through.
    """
    kept = [c for c in docs.columns if c.lower() not in (blob_col.lower(), findings_col.lower())]
    key, found = fresh(docs, "_blob"), fresh(docs, "_findings")
    paths = docs.select(*[F.col(f"`{c}`") for c in kept], blob_id(F.col(f"`{text_col}`")).alias(key))
    known = ledger.where((F.col("rules_version") == rules_version) & (F.size("findings") > 0)).select(F.col("blob").alias(key), F.col("findings").alias(found))
    joined = paths.join(known, key, "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.col(key).alias(blob_col), F.coalesce(found, F.array().cast(FINDING)).alias(findings_col))


def deliver(store: Batches, delivery: str, docs: DataFrame, rules_version: str = RULES_VERSION, text_col: str = "text") -> bool:
    """Scan the blobs of a delivery that the ledger has not seen under these rules; False where the delivery was there before."""
    versions = docs.select(blob_id(F.col(f"`{text_col}`")).alias("blob"), F.col(f"`{text_col}`").alias("text"))
    return store.commit(f"{rules_version}:{delivery}", update_ledger(versions, store.read(), rules_version))


def new_ledger(spark: SparkSession) -> Batches:
    """An empty ledger in the shared folder."""
    return Batches(spark, f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}", LEDGER)


def scan_secrets(
    docs: DataFrame, store: Batches | None = None, rules_version: str = RULES_VERSION, text_col: str = "text", source_col: str | None = None, blob_col: str = "blob", findings_col: str = "findings"
) -> DataFrame:
    """``docs`` with ``blob`` and ``findings`` (start, rank, kind, end by start, then kind), by way of the ledger.

    Null and empty texts are one blob without findings. Repeated rows share a
    blob and each get its findings. Columns named ``blob_col`` or
    ``findings_col`` are replaced. Rows come in two deliveries, by a hash of
    ``source_col``, or in one without it; blobs that an earlier delivery or the
    given ledger has are not scanned again. An empty table gives an empty one.
    """
    store = store or new_ledger(docs.sparkSession)
    run = uuid.uuid4().hex
    half = F.pmod(F.xxhash64(F.col(f"`{source_col}`")), F.lit(2)) if source_col else F.lit(0)
    for i in range(2 if source_col else 1):
        deliver(store, f"{run}-{i}", docs.where(half == i) if source_col else docs, rules_version, text_col)
    return with_findings(docs, store.read(), rules_version, text_col, blob_col, findings_col)


def redact(text: Column, findings: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each finding, or run of overlapping findings, replaced by ``mask``."""
    text = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mask))
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), gap.alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        )

    done = F.aggregate(findings, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(findings) > 0, done)


def op5_secret_ledger(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of ``documents``.

    The documents of half of the sources are the first delivery to an empty
    ledger, the others the second, of which only unseen blobs are scanned.

    Nulls, empty and very long texts, repeated rows, further columns and empty
    tables are taken as ``scan_secrets`` says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = scan_secrets(docs, source_col="source").select("doc_id", "blob", "findings")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k, *_ in RULES], joined.alias("spans"), F.col("blob").alias("blob_sha256")).withColumn(
        "base_sha256", F.sha2(F.col("spans").cast("binary"), 256)
    )


def _sql_kind(kind: str, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT rid, '{kind}' AS kind, {[k for k, *_ in RULES].index(kind)} AS rank, i,
         list_sum(list_transform(range(1, i + 1), lambda j: length(gaps[j]))) + coalesce(list_sum(list_transform(range(1, i), lambda j: length(hits[j]))), 0) AS s,
         length(hits[i]) AS n
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT rid, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits,
           regexp_extract_all(t, '{pattern}', {group}) AS parts FROM d WHERE regexp_matches(t, '{pattern}')))
  WHERE length(parts[i]) >= {least}"""


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
f AS ({' UNION ALL '.join(_sql_kind(k, p, g, n) for k, p, g, n in RULES)}),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nk, count(*) FILTER (kind = 'hex') AS nh,
             string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, rank) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(na, 0)::BIGINT AS n_assign, coalesce(nk, 0)::BIGINT AS n_access, coalesce(nh, 0)::BIGINT AS n_hex,
       coalesce(spans, '') AS spans, sha256(t) AS blob_sha256, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN g USING (rid)
"""
