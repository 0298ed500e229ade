"""Substring dedup by paragraphs: MinHash banding, exact Jaccard, components.

A text has two kinds of paragraphs. Lines are what its author parted. Passages
are content-defined: PIECE words from a place chosen by the words there, one
in every GAP successive places at least, whatever lines, spaces or other text
stand around, so every run of PIECE + GAP - 1 = 50 words that two documents
share holds a passage whole. Equal word sequences are one node.

The scan names each paragraph by its words and gives it its first bands. What
stands in a band with no other document is dropped at once; that is nearly
all. A second reading of the texts fetches the shingles of what is left, one
paragraph a node, and nodes that share a band are verified by the exact
Jaccard of their shingle sets; links become classes. Of each class that stands
in two documents or more, the first paragraph stays and the others are
removals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sporeline.functions.storage import discard, materialize
from sporeline.llm.similar import linked_classes
from sporeline.llm.wordhash import U, chunks, minimum_places, mix, seeded, word_hashes

WORDS = 5
THRESHOLD = 0.8
MIN_WORDS = 8
#: Passages: words, places of which one at least is chosen, and the least number of different shingles of one that can
#: resemble another: with fewer (a few words over and over) only equal ones meet.
PIECE, GAP, LEAST_SHINGLES = 16, 35, 8
#: (bands, rows a band) of each level. A pair at the threshold shares a band with probability
#: 1 - (1 - 0.8) ** 3 = 0.992 and, in large buckets that stay open,
#: 1 - (1 - 0.8 ** 14) ** 64 = 0.944. Passages are of one size, so the next similarity under 1 is 11 / 13,
#: which two bands catch with probability 0.976.
LEVELS = ((3, 1), (64, 14))
PASSAGE_BANDS = 2
LINE, PASSAGE, MONOTONE = 0, 1, 2


class Paragraphs:
    """The paragraphs of a run of texts: arrays with one entry a paragraph."""

    def __init__(self, raws: list[bytes]):
        words, first, starts, _ = word_hashes(raws)
        text_of = np.repeat(np.arange(len(raws)), np.diff(first))
        self.shingles = words[: max(len(words) - WORDS + 1, 0)]
        for j in range(1, WORDS):
            self.shingles = mix(self.shingles * U(5) + words[j : len(self.shingles) + j])
        joined = np.frombuffer(b" " + b" ".join(raws) + b" ", dtype=np.uint8)
        ends_before = np.cumsum(joined == 10)[starts] if len(starts) else np.zeros(0, dtype=np.int64)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(text_of) > 0) | (np.diff(ends_before) > 0)])) if len(words) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.concatenate([new, [len(words)]]))
        new, size = new[size >= MIN_WORDS], size[size >= MIN_WORDS]
        offsets = np.cumsum([0] + [len(r) + 1 for r in raws])[:-1]
        ends_at = np.cumsum(joined == 10)[offsets]
        line = ends_before[new] - ends_at[text_of[new]]
        # a place is chosen by the shingle in the passage's middle, so edits at its ends do not move it
        middle = self.shingles[(PIECE - WORDS) // 2 :]
        place = minimum_places(middle | U(1), text_of, GAP, PIECE)
        width = PIECE - WORDS + 1
        grid = np.sort(self.shingles[place[:, None] + np.arange(width)], axis=1) if len(place) else np.zeros((0, width), dtype=U)
        varied = 1 + (np.diff(grid, axis=1) != 0).sum(axis=1) >= LEAST_SHINGLES
        self.kind = np.concatenate([np.full(len(new), LINE), np.where(varied, PASSAGE, MONOTONE)])
        self.text = np.concatenate([text_of[new], text_of[place]])
        self.begin = np.concatenate([new, place])
        self.n_words = np.concatenate([size, np.full(len(place), PIECE)])
        self.number = np.concatenate([line, place - first[text_of[place]]])
        self.hi, self.lo = self._names(words, 1), self._names(words, 2)

    def _spans(self, values: np.ndarray, reduce: np.ufunc, cut: int, rest: int) -> np.ndarray:
        """``reduce`` over values[begin : begin + n_words - cut] of each paragraph."""
        if not len(self.begin):
            return np.zeros(0, dtype=U)
        bounds = np.stack([self.begin, self.begin + self.n_words - cut], axis=1).ravel()
        return reduce.reduceat(np.concatenate([values, np.array([rest], dtype=U)]), bounds)[::2]

    def _names(self, words: np.ndarray, seed: int) -> np.ndarray:
        """64 bits of each paragraph's word sequence and kind."""
        at = np.arange(len(words), dtype=U) * U(0x9E3779B97F4A7C15)
        # places count from the paragraph's start: a sum of word times odd power would need a pass a paragraph
        powers = seeded(at, seed)
        out = np.zeros(len(self.begin), dtype=U)
        for kind in (LINE, PASSAGE, MONOTONE):
            mine = np.flatnonzero(self.kind == kind)
            if len(mine):
                begin, n = self.begin[mine], self.n_words[mine]
                total = np.cumsum(n)
                within = np.arange(total[-1]) - np.repeat(total - n, n)
                parts = seeded(words[np.repeat(begin, n) + within] + powers[within], seed)
                out[mine] = seeded(np.add.reduceat(parts, total - n) + n.astype(U), 10 * seed + kind)
        return out

    def first_bands(self) -> tuple[np.ndarray, np.ndarray]:
        """(band hash, paragraph) of the first level."""
        bands, owners = [], []
        for k in range(LEVELS[0][0]):
            low = self._spans(seeded(self.shingles, 100 + k), np.minimum, WORDS - 1, 2**64 - 1)
            mine = np.flatnonzero((self.kind == LINE) | ((self.kind == PASSAGE) & (k < PASSAGE_BANDS)))
            bands.append(seeded(low[mine] + self.kind[mine].astype(U), 200 + k))
            owners.append(mine)
        equal = np.flatnonzero(self.kind == MONOTONE)
        return np.concatenate([*bands, seeded(self.hi[equal], 300)]), np.concatenate([*owners, equal])


def shared_keys(bands: np.ndarray, owners: np.ndarray, names: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, paragraph, sure) rows to ship and the bands that more than two texts share.

    ``hot`` are such bands of earlier runs.

    A band that two texts of this task have sent is known to be shared, so more
    rows of it are not sent to the band but flagged, under a key of their own.
    """
    order = np.lexsort((names[owners], bands))
    b, o = bands[order], owners[order]
    n = names[o]
    fresh = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, dtype=bool)
    other = np.concatenate([[True], (b[1:] != b[:-1]) | (n[1:] != n[:-1])]) if len(b) else fresh
    counted = np.cumsum(other)
    # of one band, the first text has rank 0, the next 1
    rank = counted - np.repeat(counted[fresh], np.diff(np.concatenate([np.flatnonzero(fresh), [len(b)]])))
    sure = (rank >= 2) | np.isin(b, hot)
    flagged = np.unique(o[sure])
    keys = np.concatenate([b[~sure], mix(names[flagged] + flagged.astype(U))])
    return keys, np.concatenate([o[~sure], flagged]), np.repeat([False, True], [int((~sure).sum()), len(flagged)]), np.unique(b[rank >= 2])


#: Bands that a task remembers as shared; beyond it forgets, which costs rows but loses none.
REMEMBERED = 1 << 18

SCANNED = "key long, sure boolean, t_hi long, t_lo long, kind byte, number int, n_words int, hi long, lo long"
READ = "t_hi long, t_lo long, kind byte, number int, n_words int, hi long, lo long, body binary"


def _halves(names: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(names), dtype=">i8").reshape(-1, 2).astype(np.int64)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hot = np.zeros(0, dtype=U)
    for batch in batches:
        halves = _halves(batch["name"].tolist())
        for at, raws in chunks(batch["text"].tolist(), 1 << 22):
            found = Paragraphs(raws)
            mine = halves[at : at + len(raws)]
            bands, owners = found.first_bands()
            keys, o, sure, more = shared_keys(bands, owners, mine[:, 0].view(U)[found.text] if len(raws) else np.zeros(0, dtype=U), hot)
            hot = np.union1d(hot if len(hot) < REMEMBERED else hot[:0], more)
            t = found.text[o]
            yield pd.DataFrame({
                "key": keys.view(np.int64), "sure": sure, "t_hi": mine[t, 0], "t_lo": mine[t, 1], "kind": found.kind[o].astype(np.int8), "number": found.number[o].astype(np.int32),
                "n_words": found.n_words[o].astype(np.int32), "hi": found.hi[o].view(np.int64), "lo": found.lo[o].view(np.int64),
            })


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Wanted paragraphs of texts with their shingles; all of a copied text's, without shingles where not wanted."""
    for batch in batches:
        halves, wanted, copied = _halves(batch["name"].tolist()), batch["wanted"].tolist(), batch["copied"].to_numpy()
        for at, raws in chunks(batch["text"].tolist(), 1 << 22):
            found = Paragraphs(raws)
            packed = found.number * 4 + found.kind + (found.text.astype(np.int64) << 32)
            mine = [np.asarray(w, dtype=np.int64) + (i << 32) for i, w in enumerate(wanted[at : at + len(raws)])]
            body = np.isin(packed, np.concatenate(mine))
            o = np.flatnonzero(body | copied[at + found.text])
            begin, end = found.begin[o], (found.begin + found.n_words)[o] - WORDS + 1
            # shingles of lines and of passages differ, so no line is near a passage
            marks = np.where(found.kind[o] == PASSAGE, U(0x5DEECE66D5DEECE6), U(0))
            bodies = [np.unique(found.shingles[a:b] ^ x).tobytes() if y else None for a, b, x, y in zip(begin.tolist(), end.tolist(), marks, body[o].tolist(), strict=True)]
            t = found.text[o]
            yield pd.DataFrame({
                "t_hi": halves[at + t, 0], "t_lo": halves[at + t, 1], "kind": found.kind[o].astype(np.int8), "number": found.number[o].astype(np.int32), "n_words": found.n_words[o].astype(np.int32),
                "hi": found.hi[o].view(np.int64), "lo": found.lo[o].view(np.int64), "body": pd.Series(bodies, dtype=object),
            })


#: Bytes of bodies that are worked on at a time.
AT_ONCE = 1 << 21


def _slices(sizes: Iterable[int]) -> Iterator[slice]:
    """Runs of about AT_ONCE bytes; a larger body is a run of its own."""
    first, total, i = 0, 0, -1
    for i, size in enumerate(sizes):
        if i > first and total + size > AT_ONCE:
            yield slice(first, i)
            first, total = i, 0
        total += size
    if i >= first:
        yield slice(first, i + 1)


def _joined(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all shingles, how many each body has)."""
    return np.frombuffer(b"".join(bodies), dtype=U), np.fromiter((len(b) // 8 for b in bodies), dtype=np.int64, count=len(bodies))


def signer(level: int) -> Callable[[list[bytes]], list[np.ndarray]]:
    """The function from bodies to band hashes of a level."""
    bands, rows = LEVELS[level]

    def sign(bodies: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for part in _slices(map(len, bodies)):
            elements, n = _joined(bodies[part])
            made = seeded(np.broadcast_to(np.arange(bands, dtype=U), (len(n), bands)), 300 + level)
            for k in range(bands * rows):
                made[:, k % bands] = mix(made[:, k % bands] + np.minimum.reduceat(seeded(elements, 1000 * level + k), np.cumsum(n) - n))
            out += list(made.view(np.int64))
        return out

    return sign


def similar_sets(a: list[bytes], b: list[bytes]) -> list[bool]:
    """Which pairs of shingle sets reach the threshold by their exact Jaccard."""
    out: list[bool] = []
    for part in _slices(len(x) + len(y) for x, y in zip(a, b, strict=True)):
        (x, n), (y, m) = _joined(a[part]), _joined(b[part])
        pair = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
        both = np.concatenate([x, y])
        order = np.lexsort((both, pair))
        both, pair = both[order], pair[order]
        shared = np.bincount(pair[1:][(both[1:] == both[:-1]) & (pair[1:] == pair[:-1])], minlength=len(n))
        out += (shared >= THRESHOLD * (n + m - shared) - 1e-9).tolist()
    return out


def _name(hi: str, lo: str) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit, paragraph, n_words, class, keep) of paragraphs that stand in two documents or more.

    ``unit`` is "line" or "passage"; ``paragraph`` is the line's number or the
    passage's first word, both from 0. ``class`` is the least fingerprint of
    its class in hex; lines and passages are never of one class, and a passage
    of fewer than LEAST_SHINGLES different shingles only with its equals. One row of
    each class has ``keep``, of its least (id, unit, paragraph). Lines of fewer
    than MIN_WORDS words, null and empty texts have no paragraphs, texts of
    fewer than PIECE + GAP - 1 words no passages. Words are runs of anything but
    ASCII white space. Rows equal in id and text count as one document, rows of
    one id with several texts too, and rows without an id by their text. An
    empty table gives an empty result. Other columns are not used.
    """
    kind = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("name"))
    document = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.concat(F.lit("~"), F.hex("name")))
    slim = materialize(named.where(F.length("text") > 0).select("id", "name", document.alias("doc")).distinct())
    of_text = slim.groupBy("name").agg(F.count("*").alias("n"))

    scanned = named.select("name", "text").mapInPandas(_scan, SCANNED)
    met = Window.partitionBy("key")
    apart = [f(c).over(met) for c in ("t_hi", "t_lo") for f in (F.min, F.max)]
    place = ["t_hi", "t_lo", "kind", "number", "n_words", "hi", "lo"]
    scanned = scanned.withColumns(dict(zip(("a", "b", "c", "d"), apart, strict=True)))
    left = materialize(scanned.where("sure OR a <> b OR c <> d").select(*place).distinct())

    packed = (F.col("number").cast("long") * 4 + F.col("kind")).alias("at")
    read = left.where(F.col("kind") != MONOTONE).groupBy("hi", "lo").agg(F.min(F.struct("t_hi", "t_lo", packed)).alias("x")).select("x.*")
    wanted = read.groupBy(_name("t_hi", "t_lo").alias("name")).agg(F.collect_list("at").alias("wanted"))
    empty = F.array().cast("array<bigint>")
    wanted = of_text.where("n > 1").select("name", F.lit(True).alias("copied")).join(wanted, "name", "full")
    wanted = materialize(wanted.select("name", F.coalesce("wanted", empty).alias("wanted"), F.coalesce("copied", F.lit(False)).alias("copied")))
    texts = named.select("name", "text").join(wanted.select("name"), "name", "left_semi").dropDuplicates(["name"])
    fetched = materialize(texts.join(wanted, "name").select("name", "text", "wanted", "copied").mapInPandas(_read, READ))

    nodes = materialize(fetched.where("body IS NOT NULL").select(_name("hi", "lo").alias("fp"), "body"))
    first = signer(0)

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"fp": batch["fp"], "bands": first(batch["body"].tolist())})

    classes = linked_classes(nodes.mapInPandas(banded, "fp binary, bands array<long>"), nodes, [signer(1)], similar_sets)
    each = left.unionByName(fetched.select(*place)).distinct()
    each = each.select(_name("t_hi", "t_lo").alias("name"), "kind", "number", "n_words", _name("hi", "lo").alias("fp"))
    rows = each.join(slim, "name").join(classes, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    unit = F.when(F.col("kind") == LINE, "line").otherwise("passage")
    rows = materialize(rows.select("id", "doc", unit.alias("unit"), F.col("number").alias("paragraph"), F.col("n_words").cast("long").alias("n_words"), "class"))
    # rows without an id come last; the text's name tells them apart
    order = F.struct(F.col("id").isNull().alias("none"), "id", "unit", "paragraph", "doc")
    heads = rows.groupBy("class").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(order).alias("head")).where("lo <> hi")
    heads = materialize(heads.select("class", "head"))
    discard(left, fetched, nodes, wanted)
    done = rows.join(heads, "class").withColumn("keep", order == F.col("head"))
    return done.select(F.col("id").cast(kind).alias(id_col), "unit", "paragraph", "n_words", F.hex("class").alias("class"), "keep")


def op8_paragraph_minhash(spark, sf_dir: str) -> DataFrame:
    """Every paragraph of ``documents`` that stands in two documents or more: doc_id, unit, paragraph, n_words, class, keep.

    Nulls, empty and very long texts, repeated rows, further columns and empty
    tables are taken as ``repeated_paragraphs`` says.
    """
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
