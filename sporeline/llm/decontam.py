"""Benchmark decontamination: CGK embedding of pieces, exact edit distance.

An item of n words is found where at most k = n / 5 edits part it from a run of
a document. It is cut into k + 1 pieces over its whole length: k edits leave
one piece as it is, wherever they stand and however long the item is. The CGK
random walk reads a piece with a pointer that moves on or stays, by a random
bit of (step, word), and writes the word under it at each step, nothing after
the piece's end. Its output names the piece; the walk from every word of a
document, over as many words, gives equal output for an equal piece, so no
item within the distance is lost. Where outputs agree, the item is held against
the text around by exact edit distance over words, with the window's ends free.

Items are a stated query set: they go to the tasks in blocks of a fixed number
of rows, whose size is checked, and documents stream past each block. No pair
of documents and items is made besides candidates, and nothing is shuffled but
the matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.llm.wordhash import U, chunks, mix, word_hashes

#: An item is found where the edit distance over words is at most (1 - SIMILARITY) of its words.
SIMILARITY = 0.8
#: Steps of a walk for each word of a piece. A walk that ends before its piece does names it less sharply, but loses none.
STEPS = 3
#: A block of the query set never exceeds these.
BLOCK_ROWS, BLOCK_BYTES = 20_000, 32 << 20
FILTER = 1 << 20


def walk(words: np.ndarray, starts: np.ndarray, reach: int) -> np.ndarray:
    """One number for each start: the output of the walk over the ``reach`` words from it."""
    steps = STEPS * reach
    step_keys = (mix(np.arange(steps, dtype=U) + U(1)) >> U(32)).astype(np.uint32) | np.uint32(1)
    at = starts.astype(np.int32)
    ends = at + np.int32(reach)
    key = np.zeros(len(at), dtype=U)
    for step in range(steps):
        out = np.take(words, at, mode="clip")
        out *= at < ends
        key *= U(0x9E3779B97F4A7C15)
        key += out
        at += ((out * step_keys[step]) >> np.uint32(31)).astype(np.int32)
    key *= U(0xBF58476D1CE4E5B9)
    return key ^ (key >> U(32))


def _allowed(n):
    """Edits within which an item of ``n`` words is found."""
    return ((1 - SIMILARITY) * n + 1e-9).astype(np.int64)


def _short(words: np.ndarray) -> np.ndarray:
    return (words >> U(32)).astype(np.uint32)


class Items:
    """The tables of one block of items, made once in a worker."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        words, first, _, _ = word_hashes([(r[1] or "").encode("utf-8", "surrogatepass") for r in rows])
        self.words = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        n = np.diff(first)
        pieces = _allowed(n) + 1
        reach = n // pieces  # 0: no words, never found
        self.tables = []
        for q in np.unique(reach[reach > 0]).tolist():
            members = np.flatnonzero(reach == q)
            owner = np.repeat(members, pieces[members])
            offsets = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces[members]) - pieces[members], pieces[members])) * q
            keys = walk(_short(words), first[owner] + offsets, q)
            order = np.argsort(keys)
            bits = np.zeros(max(FILTER, 1 << (8 * len(keys)).bit_length()), dtype=bool)
            bits[(keys & U(len(bits) - 1)).astype(np.int64)] = True
            self.tables.append((q, bits, keys[order], owner[order], offsets[order]))


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance over words of ``item`` to any run of ``text``."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    steps = np.arange(len(text) + 1)
    for i, word in enumerate(item):
        best = np.empty_like(row)
        best[0] = i + 1
        best[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(best - steps) + steps
    return int(row.min())


def _find(items: Items, raws: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(text, item, distance) of the items found in a run of texts, the least distance of each pair."""
    words, first, _, _ = word_hashes(raws)
    text_of = np.repeat(np.arange(len(raws)), np.diff(first))
    short, places = _short(words), np.arange(len(words))
    left = first[text_of + 1] - places
    found = [np.zeros((3, 0), dtype=np.int64)]
    for q, bits, keys, members, offsets in items.tables:
        starts = places[left >= q]
        mine = walk(short, starts, q)
        maybe = np.flatnonzero(bits[(mine & U(len(bits) - 1)).astype(np.int64)])
        lo = np.searchsorted(keys, mine[maybe], "left")
        times = np.searchsorted(keys, mine[maybe], "right") - lo
        hits = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(starts[maybe], times)
        found.append(np.stack([members[hits], text_of[at], at - offsets[hits]]))
    found = np.concatenate(found, axis=1)
    found = found[:, np.lexsort(found[::-1])]
    new = (found[:, 1:] != found[:, :-1]).any(axis=0)
    found = found[:, np.flatnonzero(np.concatenate([[True], new]))] if found.shape[1] else found
    small = (words & U(0xFFFF)).astype(np.int64)
    known = np.zeros(1 << 16, dtype=bool)
    cuts = np.flatnonzero(np.diff(found[0])) + 1
    for group in np.split(found, cuts, axis=1) if found.shape[1] else []:
        m = int(group[0, 0])
        yield from _verify(items.words[m], m, group[1], group[2], words, small, known, first)


def _verify(item, m, texts, starts, words, small, known, first) -> Iterator[tuple[int, int, int]]:
    """The texts that hold one item, of the windows at ``starts``, which come by text, then place."""
    allowed = int(_allowed(np.int64(len(item))))
    # within the distance, all but ``allowed`` words of the item match words of the window
    mine = (item & U(0xFFFF)).astype(np.int64)
    known[mine] = True
    before, after = allowed + 2, len(item) + 2 * allowed + 2
    reach = np.arange(-before, after)
    full = np.zeros(len(starts), dtype=bool)
    for part in np.array_split(np.arange(len(starts)), len(starts) * len(reach) // (1 << 19) + 1):
        places = starts[part, None] + reach
        inside = (places >= first[texts[part]][:, None]) & (places < first[texts[part] + 1][:, None])
        full[part] = (known[small[np.clip(places, 0, len(words) - 1)]] & inside).sum(axis=1) >= len(item) - allowed
    known[mine] = False
    texts, starts = texts[full], starts[full]
    best: dict[int, int] = {}
    # windows of a text that meet are one
    apart = np.flatnonzero((np.diff(texts) > 0) | (np.diff(starts) > before + after)) + 1
    for lo, hi in zip([0, *apart.tolist()], [*apart.tolist(), len(starts)], strict=True) if len(starts) else []:
        t = int(texts[lo])
        if best.get(t) == 0:
            continue
        d = edit_distance_within(item, words[max(first[t], starts[lo] - before) : min(first[t + 1], starts[hi - 1] + after)])
        if d <= allowed:
            best[t] = min(d, best.get(t, d))
    yield from ((t, m, d) for t, d in best.items())


_made: list[tuple[list, Items]] = []


def _items(shared: Broadcast) -> Items:
    """The tables of a block; the block is kept with them, so that it is told by what it is, not by its address."""
    rows = shared.value
    if not _made or _made[0][0] is not rows:
        _made[:] = [(rows, Items(rows))]
    return _made[0][1]


def _blocks(bench: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    rows = bench.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n_blocks = max(-(-size["n"] // (BLOCK_ROWS // 2)), -(-size["b"] // (BLOCK_BYTES // 2)), 1)
    for i in range(n_blocks):
        block = rows if n_blocks == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == i)
        yield [tuple(r) for r in block.collect()]  # bounded by BLOCK_ROWS and BLOCK_BYTES


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, item id, distance, n_words) of each item found in each document.

    ``distance`` is the least edit distance over words of the item to a run of
    the document; n_words is the item's. Every pair within it is found. Null and
    empty items are found nowhere, null and empty documents hold nothing.
    Repeated rows of a document or an item give one row a pair of ids. An
    empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = None
    for block in _blocks(bench, item_col, text_col):
        part = _match(spark, texts, block)
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("id", "item").agg(F.min_by(F.struct("distance", "n_words"), F.struct("distance", "n_words")).alias("m"))
    return found.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("item").cast(bench.schema[item_col].dataType).alias(item_col), "m.distance", "m.n_words"
    )


def _match(spark: SparkSession, texts: DataFrame, block: list[tuple]) -> DataFrame:
    shared = spark.sparkContext.broadcast(block)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = _items(shared)
        for batch in batches:
            rows, ids = [], batch["id"].tolist()
            for at, raws in chunks(batch["text"].tolist()):
                rows += [(ids[at + t], items.ids[m], d, len(items.words[m])) for t, m, d in _find(items, raws)]
            yield pd.DataFrame(rows, columns=["id", "item", "distance", "n_words"])

    return texts.mapInPandas(search, "id string, item string, distance long, n_words long")


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item; rows without an id stay.

    All rows of an id go where one of them holds an item. Null and empty texts
    hold none. Repeated rows stay repeated, other columns pass through, and an
    empty table on either side gives ``docs``.
    """
    hit = contaminated(docs, bench, id_col, item_col, text_col).select(id_col).distinct()
    return docs.join(hit, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_cgk_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair found: doc_id, item_id, distance, n_words.

    Nulls, empty and very long texts, repeated rows, further columns and empty
    tables are taken as ``contaminated`` says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
