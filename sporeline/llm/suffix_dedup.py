"""Repeated passages by sparse suffix arrays.

Only suffixes that start at minimisers are kept: word places whose hash of the
next ``SEED`` words is least in some window of ``GAP`` such places. The choice
depends on content alone, so every passage of SEED + GAP - 1 words or more has
a kept suffix at the same place in each of its copies. Sorted, suffixes with an
equal seed (128 bits of its words) are neighbours; a seed with a neighbour is repeated, and runs of
overlapping repeated seeds are repeated text. Where a run ends, matches are
extended: the suffixes that share the run's last seed are sorted by the words
after it, those that share its first seed by the words before it (backwards),
and the longest common run with a neighbour is added. Beyond GAP words no
extension is needed, for a longer match holds another kept suffix.

All sorts are range-partitioned by content with the place as the last key, so
a seed that a third of all texts share is spread over tasks; rows at the two
ends of a partition are compared in a second, small sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sporeline.functions.storage import discard, materialize
from sporeline.llm.wordhash import U, chunks, minimum_places, mix, word_hashes

#: Passages of MIN_WORDS = SEED + GAP - 1 words and more are found whole.
SEED, GAP = 32, 19
MIN_WORDS = SEED + GAP - 1


def minimisers(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, seed hashes, second hashes) of the kept suffixes of a run of texts, whose words ``first`` parts; places count over all."""
    if len(words) < MIN_WORDS:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U), np.zeros(0, dtype=U)
    seeds = _seed_hashes(words) | U(1)
    places = minimum_places(seeds, np.repeat(np.arange(len(first) - 1), np.diff(first)), GAP, SEED)
    return places, seeds[places], _second(words, places)


def _second(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Another 64 bits of the SEED words from each place, which tell apart seeds of equal hash."""
    made = np.zeros(len(places), dtype=U)
    for j in range(SEED):
        made = (made ^ words[places + j]) * U(0x9E3779B97F4A7C15) + (made >> U(29))
    return made


def _seed_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of each run of SEED words (a power of two), by doubling."""
    made, have = words, 1
    while have < SEED:
        made = mix(made[: len(made) - have] * U(5) + made[have:])
        have *= 2
    return made


def _kept(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    names = batch["name"].to_numpy()
    for at, raws in chunks(batch["text"].tolist()):
        words, first, _, _ = word_hashes(raws)
        places, seeds, second = minimisers(words, first)
        text = np.searchsorted(first, places, side="right") - 1
        yield pd.DataFrame({"seed": seeds.view(np.int64), "second": second.view(np.int64), "name": names[at + text], "place": (places - first[text]).astype(np.int32)})


CONTEXT = "seed long, second long, side int, name binary, place int, context binary"


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The GAP words after a seed (side 1), or before it, nearest first (side 0), 8 bytes each."""
    for batch in batches:
        out = []
        for name, text, wanted in zip(batch["name"], batch["text"], batch["wanted"], strict=True):
            words, *_ = word_hashes([(text or "").encode("utf-8", "surrogatepass")])
            big = words.astype(">u8")
            for x in wanted:
                at = x["place"]
                near = big[at + SEED : at + SEED + GAP] if x["side"] else big[max(0, at - GAP) : at][::-1]
                out.append((x["seed"], x["second"], x["side"], name, at, near.tobytes()))
        yield pd.DataFrame(out, columns=["seed", "second", "side", "name", "place", "context"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    return n if same.all() else int(same.argmin())


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words shared with the better neighbour in sorted order; the partition's ends are marked and keep their context."""
    last, first = None, True

    def row(x, edge: bool) -> list:
        return [*x[:5], x[6], edge, x[5] if edge else None]

    for batch in batches:
        out = []
        for seed, second, side, name, place, context in batch.itertuples(index=False):
            words = np.frombuffer(context, dtype=">u8")
            now = [seed, second, side, name, place, context, 0, words]
            if last is not None:
                if last[:3] == now[:3]:
                    now[6] = _common(last[7], words)
                    last[6] = max(last[6], now[6])
                out.append(row(last, first))
                first = False
            last = now
        if out:
            yield pd.DataFrame(out, columns=["seed", "second", "side", "name", "place", "more", "edge", "context"])
    if last is not None:
        yield pd.DataFrame([row(last, True)], columns=["seed", "second", "side", "name", "place", "more", "edge", "context"])


def _extensions(contexts: DataFrame) -> DataFrame:
    """(side, name, place, more): words that a match goes on beyond a seed."""
    order = ["seed", "second", "side", "context", "name", "place"]
    ranged = contexts.repartitionByRange(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    found = materialize(ranged.sortWithinPartitions(*order).mapInPandas(_neighbours, "seed long, second long, side int, name binary, place int, more int, edge boolean, context binary"))
    edges = found.where("edge")  # two rows a partition
    by = Window.partitionBy("seed", "second", "side").orderBy("context", "name", "place")

    def shared(other) -> "F.Column":
        words = F.least(F.octet_length("context"), F.octet_length(other)) / 8
        same = F.aggregate(
            F.sequence(F.lit(1), F.greatest(words.cast("int"), F.lit(1))),
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda acc, i: F.struct(
                F.when(acc["on"] & (F.substring("context", i * 8 - 7, F.lit(8)) == F.substring(other, i * 8 - 7, F.lit(8))) & (i <= words), i).otherwise(acc["n"]).alias("n"),
                (acc["on"] & (F.substring("context", i * 8 - 7, F.lit(8)) == F.substring(other, i * 8 - 7, F.lit(8)))).alias("on"),
            ),
            lambda acc: acc["n"],
        )
        return F.coalesce(same, F.lit(0))

    edges = edges.withColumns({"before": F.lag("context").over(by), "after": F.lead("context").over(by)})
    edges = edges.select("side", "name", "place", F.greatest("more", shared(F.col("before")), shared(F.col("after"))).alias("more"))
    return found.where("NOT edge").select("side", "name", "place", "more").unionByName(edges)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word) of passages that stand in another document too.

    Words are runs of anything but ASCII white space, ends are exclusive, and
    spans of a document neither touch nor overlap. Every passage of MIN_WORDS
    words or more that two documents share is covered whole; every span has
    MIN_WORDS words or more and consists of runs of SEED words or more that
    stand elsewhere, lengthened by what another kept suffix shares. Documents
    with equal texts of MIN_WORDS words are one whole span. Null, empty and
    shorter texts have none. Repeated rows are copies of each other. An empty
    table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).cast("string").alias("id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("name"))

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in batches:
            fresh = batch[~batch["name"].duplicated() & ~batch["name"].isin(seen)]
            seen.update(fresh["name"].tolist())
            yield from _kept(fresh)

    suffixes = materialize(named.select("name", "text").mapInPandas(kept, "seed long, second long, name binary, place int"))
    head = F.xxhash64("name")  # of one seed's texts, whether two differ
    shared = suffixes.groupBy("seed", "second").agg(F.min(head).alias("lo"), F.max(head).alias("hi")).where("lo <> hi").select("seed", "second")
    flagged = materialize(suffixes.join(shared, ["seed", "second"]).distinct())
    discard(suffixes)
    by_text = Window.partitionBy("name").orderBy("place")
    begins = F.when(F.col("place") <= F.lag("place").over(by_text) + SEED, 0).otherwise(1)
    runs = flagged.withColumn("new", begins).withColumn("run", F.sum("new").over(by_text))
    of_run = Window.partitionBy("name", "run")
    runs = runs.withColumns({"lo": F.min("place").over(of_run), "hi": F.max("place").over(of_run)})
    # a match that ends at another suffix's words can still reach further than the run's last seed
    runs = materialize(runs.where((F.col("place") <= F.col("lo") + GAP) | (F.col("place") >= F.col("hi") - GAP)).select("name", "run", "seed", "second", "place", "lo", "hi"))
    near = lambda side, where: runs.where(where).select("seed", "second", F.lit(side).alias("side"))
    ends = near(0, F.col("place") <= F.col("lo") + GAP).unionByName(near(1, F.col("place") >= F.col("hi") - GAP)).distinct()
    wanted = flagged.join(ends, ["seed", "second"]).groupBy("name").agg(F.collect_list(F.struct("seed", "second", "side", "place")).alias("wanted"))
    wanted = materialize(wanted)
    texts = named.select("name", "text").join(wanted.select("name"), "name", "left_semi").dropDuplicates(["name"])
    contexts = wanted.join(texts, "name").select("name", "text", "wanted").mapInPandas(_contexts, CONTEXT)
    more = materialize(_extensions(contexts))
    reach = runs.join(more, ["name", "place"]).groupBy("name", "run").agg(
        F.min(F.when(F.col("side") == 0, F.col("place") - F.col("more"))).alias("s"),
        F.max(F.when(F.col("side") == 1, F.col("place") + SEED + F.col("more"))).alias("e"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    spans = reach.select("name", F.least("s", "lo").alias("s"), F.greatest("e", F.col("hi") + SEED).alias("e"))
    merged = Window.partitionBy("name").orderBy("s", "e")
    before = F.max("e").over(merged.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(merged))
    spans = spans.groupBy("name", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word")).where(F.col("end_word") - F.col("start_word") >= MIN_WORDS)

    slim = materialize(named.select("id", "name", _word_count(F.col("text")).alias("n_words")))
    copied = slim.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    copied = slim.where(F.col("n_words") >= MIN_WORDS).join(copied, "name", "left_semi")
    whole = copied.select("id", F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"))
    copied_names = copied.select("name").distinct()
    parts = slim.join(spans.join(copied_names, "name", "left_anti"), "name").select("id", "start_word", "end_word")
    return whole.unionByName(parts).select(F.col("id").cast(kind).alias(id_col), F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"))


def _word_count(text) -> "F.Column":
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).otherwise(0)


def op2_sparse_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of all ``documents``: doc_id, start_word, end_word, n_words.

    Nulls, empty and very long texts, repeated rows, further columns and empty
    tables are taken as ``repeated_passages`` says.
    """
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("n_words", F.col("end_word") - F.col("start_word"))
