"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A shingle is five words; its weight is 1 + ln(times in the text). Each shingle
is the source of a Poisson process whose rate is its weight; every arrival
falls on one of the signature's registers, and a register keeps the shingle
that arrives first. Two texts agree in a register with the probability
Jaccard of their weighted shingles. An element stops as soon as its next
arrival is later than the latest register, so a text of n shingles costs
about n + m log m arrivals rather than n times m. Registers are banded,
texts that share a band are verified by the exact probability Jaccard, and
links become classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeline.functions.columns import fresh
from sporeline.functions.storage import materialize
from sporeline.llm.similar import Screen, fingerprint, linked_classes
from sporeline.llm.wordhash import U, chunks, counted, mix, seeded, shingles, word_hashes

WORDS = 5
THRESHOLD = 0.8
#: (bands, rows a band) of each level: one. A pair at the threshold shares a band with probability
#: 1 - (1 - 0.8 ** 8) ** 24 = 0.988, whatever the size of its buckets; texts that share half their shingles (a common
#: passage) do with 0.5 ** 8 = 0.004 a band.
LEVELS = ((24, 8),)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to numbers in (0, 1)."""
    return ((x >> U(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def prob_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """(n_texts, registers): the element that arrives first in each register; 0 in texts without elements."""
    first = np.full(n_texts * registers, np.inf)
    winner = np.zeros(n_texts * registers, dtype=U)
    at = np.zeros(len(elements))
    e, w, o = elements, weights, owner
    turn = 0
    while len(e):
        at = at - np.log(_uniform(seeded(e, 2 * turn))) / w
        slot = o * registers + (seeded(e, 2 * turn + 1) % U(registers)).astype(np.int64)
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        winner[slot[won]] = e[won]
        latest = first.reshape(n_texts, registers).max(axis=1)
        on = at < latest[o]
        e, w, o, at = e[on], w[on], o[on], at[on]
        turn += 1
    return winner.reshape(n_texts, registers)


def _weighted(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, first, _, _ = word_hashes(raws)
    elements, owner, times = counted(*shingles(words, first, WORDS))
    return elements, owner, 1.0 + np.log(np.maximum(times, 1))


def signer(level: int) -> Callable[[list[str | None]], list[np.ndarray]]:
    """The function from texts to band hashes of a level; a text without words has none."""
    bands, rows = LEVELS[level]

    def sign(texts: list[str | None]) -> list[np.ndarray]:
        hashes: list[np.ndarray] = []
        for _, raws in chunks(texts):
            elements, owner, weights = _weighted(raws)
            signature = prob_minhash(elements, weights, owner, len(raws), bands * rows)
            made = seeded(np.broadcast_to(np.arange(bands, dtype=U), (len(raws), bands)), 77 + level)
            for r in range(rows):
                made = mix(made + signature[:, r::rows])
            some = np.bincount(owner, minlength=len(raws)) > 0
            hashes += [row if full else row[:0] for row, full in zip(made.view(np.int64), some, strict=True)]
        return hashes

    return sign


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact: the sum over shared i of 1 / sum over all j of max(a_j / a_i, b_j / b_i)."""
    (ea, wa), (eb, wb) = a, b
    every = np.union1d(ea, eb)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, ea)] = wa
    y[np.searchsorted(every, eb)] = wb
    shared = (x > 0) & (y > 0)
    if not shared.any():
        return 0.0
    kinds, times = np.unique(np.stack([x[shared], y[shared]], axis=1), axis=0, return_counts=True)
    return float(sum(n / np.maximum(x / p, y / q).sum() for (p, q), n in zip(kinds, times, strict=True)))


def similar_texts(a: list[str], b: list[str]) -> list[bool]:
    """Which pairs reach the threshold."""
    kept: dict[str, tuple] = {}

    def of(text: str) -> tuple:
        if text not in kept:
            if len(kept) > 256:
                kept.clear()
            elements, _, weights = _weighted([text.encode("utf-8", "surrogatepass")])
            kept[text] = elements, weights
        return kept[text]

    return [probability_jaccard(of(x), of(y)) >= THRESHOLD - 1e-9 for x, y in zip(a, b, strict=True)]


def sketches(texts: list[str]) -> list[tuple[bytes, float]]:
    """(bits, sum of weights) of the shingles of each text; sixteen bits a shingle at least, 512 a text."""
    out = []
    for text in texts:
        elements, _, weights = _weighted([text.encode("utf-8", "surrogatepass")])
        size = 512
        while size < 16 * len(elements):
            size *= 2
        bits = np.zeros(size, dtype=np.uint8)
        bits[(elements % U(size)).astype(np.int64)] = 1
        out.append((np.packbits(bits, bitorder="little").tobytes(), float(weights.sum())))
    return out


def could_be_similar(only_a: np.ndarray, only_b: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray) -> np.ndarray:
    """Which pairs may reach the threshold, by an upper bound of the probability Jaccard.

    Each bit that one text alone has stands for a shingle of its own, of weight
    1 at least. With own weights u, v and shared weights s, t, a shared shingle
    adds at most 1 / ((s + u) / a + v / b), which is concave in its weights a, b
    and grows with both, so all of them add at most 1 / (1 + u / s + v / t).
    """
    shared_a, shared_b = weight_a - only_a, weight_b - only_b
    some = (shared_a > 0) & (shared_b > 0)
    ratio = only_a / np.where(some, shared_a, 1.0) + only_b / np.where(some, shared_b, 1.0)
    return some & (1.0 / (1.0 + ratio) >= THRESHOLD - 1e-6)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, class, class_id, class_size, keep) for every row of ``docs``.

    ``class`` names the class. ``keep`` is true for one row of each class, of
    its least id; rows without an id come last. ``class_id`` is its least id: null where no row
    of the class has an id, and not of one class only where ids repeat. Equal texts are one class, so
    null and empty texts, which have no shingles, form one class and link to
    nothing else. A text of fewer than five words is one shingle. Rows equal in
    all columns each get a row. An empty table gives an empty one. Other
    columns of ``docs`` are not used.
    """

    first = signer(0)

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "fp": batch["fp"], "bands": first(batch["text"].tolist())})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    named = rows.select("id", "text", fingerprint(F.col("text")).alias("fp"))
    slim = materialize(named.select(F.col("id").cast("string").alias("id"), "fp", "text").mapInPandas(signed, "id string, fp binary, bands array<long>"))
    # the place in the written table tells apart rows of one id
    slim = slim.select(F.col("id").cast(kind).alias("id"), "fp", "bands", F.monotonically_increasing_id().alias("row"))
    texts_of = slim.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("low"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    texts = named.groupBy("fp").agg(F.first("text").alias("body"))
    linked = linked_classes(texts_of.select("fp", "bands"), texts, [signer(level) for level in range(1, len(LEVELS))], similar_texts, Screen(sketches, could_be_similar))
    sized = texts_of.select("fp", "low", "n").join(linked, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    heads = sized.groupBy("class").agg(F.min("low").alias("head"), F.sum("n").alias("class_size"))
    by_text = sized.join(heads, "class").select("fp", "class", "head", "class_size")
    rows = slim.select("id", "fp", "row").join(by_text, "fp")
    return rows.select(F.col("id").alias(id_col), "fp", "class", F.col("head.id").alias("class_id"), "class_size", (F.col("row") == F.col("head.row")).alias("keep"))


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each class: a row of least id.

    Rows without an id are kept only where their class has no id at all. Of
    rows equal in id and class, one stays.
    """
    name, head = fresh(docs, "_fp"), fresh(docs, "_head")
    least = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("fp").alias("text"))
    heads = near_duplicates(docs, id_col, text_col).groupBy("class").agg(F.min(least).alias("least"))
    heads = heads.select(F.col("least.id").alias(head), F.col("least.text").alias(name))
    own = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.withColumn(name, fingerprint(F.col(text_col)))
    left = named.join(heads, (named[name] == heads[name]) & named[id_col].eqNullSafe(heads[head]), "left_semi")
    return left.dropDuplicates([id_col, name]).select(*own)


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Class of every document: doc_id, class_id (least doc_id of the class), class_size, keep.

    Nulls, empty and very long texts, repeated rows, further columns and empty
    tables are taken as ``near_duplicates`` says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "class_id", "class_size", "keep")
