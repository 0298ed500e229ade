"""Verified similarity classes from band hashes: the part that two operators share.

Nodes are distinct texts, named by a 16-byte fingerprint. Nodes that share a
band form a bucket. A bucket's members are not paired with each other: they are
paired with one hub, the node whose buckets are largest, which of many near
copies is the one that most resemble. Pairs are verified exactly, and links
become classes. A bucket whose members other than the hub are in one class is
closed, for no link in it can change a class. In an open one the hub is retired.
Open buckets of up to SMALL members go on as they are. The members of larger
ones are signed anew with more rows a band, so that a bucket of texts that
only share a passage falls apart and those that resemble each other stay
together, and go through the same round. After the last level the next hubs
are tried, GROWTH times as many in each round, against members of other classes
only, until every bucket is closed: then every pair of different classes that
shares a small bucket, or one of the longest bands, has been verified.

With a screen there are no further hubs: after the first round of the last level every pair of different classes in
an open bucket is looked at. Members of large buckets carry a bit sketch of their shingles and meet in blocks of
bounded size, where shared bits bound their similarity from above; only pairs whose bound reaches the threshold are
made as rows. The bound is never under the similarity, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sporeline.functions.storage import discard, materialize
from sporeline.operators.graph import connected_components

#: Hubs of a bucket in the first round of the last level, second, ...: 1, GROWTH, GROWTH ** 2, ...
GROWTH = 64
#: Members of an open bucket that is not split by longer bands.
SMALL = 16
#: Members and bytes of sketches of a cell of a large bucket, about; two cells meet in a block.
CELL, CELL_BYTES = 512, 8 << 20


class Screen(NamedTuple):
    """``sketch`` gives (bits, weight) of bodies: a set bit for each of its shingles at hash modulo the number of bits, a
    power of two, at least 64. ``could`` says from the bits that only a has (a lower bound of its own shingles), those
    that only b has, and both weights, which pairs may be similar."""

    sketch: Callable[[list], list[tuple[bytes, float]]]
    could: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def fingerprint(text: Column) -> Column:
    """16 bytes that name a text; a null text has the name of the empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def linked_classes(bands: DataFrame, bodies: DataFrame, sign: list[Callable], similar: Callable[[list, list], list[bool]], screen: Screen | None = None) -> DataFrame:
    """(fp, class): classes of two and more nodes and single members of their buckets, named by their least fingerprint.

    ``bands`` has fp and an array of band hashes of the first level, one row a
    node; ``bodies`` has fp and body, one row a node. ``sign`` gives the band
    hashes of bodies at each further level, ``similar`` says for two lists of
    bodies which pairs are similar; both run in the tasks. ``screen`` takes the
    place of further hubs.
    """
    rows = bands.select("fp", F.explode("bands").alias("band"))
    full = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(_weighed(rows.join(full, "band")))
    bodies = materialize(bodies.join(members.select("fp").distinct(), "fp", "left_semi"))
    classes = materialize(bodies.select("fp", F.col("fp").alias("class")))
    tested, level, cells = [], 0, 1

    def linked(classes: DataFrame, pairs: DataFrame) -> DataFrame:
        if tested:  # one join for the pairs of all rounds
            known = reduce(DataFrame.unionByName, [t.select("a", "b") for t in tested])
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        found = materialize(_verified(pairs, bodies, similar))
        tested.append(found)
        links = found.where("linked")
        if links.isEmpty():
            return classes
        joined = materialize(_merged(classes, links))
        discard(classes)
        return joined

    while not members.isEmpty():
        classed = members.join(classes, "fp")
        cell = F.pmod(F.xxhash64("band", "fp"), F.lit(cells))
        hubs = materialize(classed.groupBy("band", cell.alias("cell")).agg(F.max_by(F.struct("fp", "class"), F.struct("weight", "fp")).alias("hub")).select("band", "hub.*"))
        heads = hubs.select("band", F.col("fp").alias("hub"), F.col("class").alias("hub_class"))
        pairs = heads.join(classed, "band").where("hub_class <> class")
        classes = linked(classes, pairs.select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b")).distinct())
        rest = members.join(hubs.select("band", "fp"), ["band", "fp"], "left_anti").join(classes, "fp")
        mixed = _mixed(rest.select("band", F.xxhash64("class").alias("of")))
        if level < len(sign):
            left = rest.join(mixed.where(F.col("n") > SMALL), "band", "left_semi").select("fp", F.xxhash64("class").alias("of")).distinct()
            kept = rest.join(mixed.where(F.col("n") <= SMALL), "band", "left_semi").select("band", "fp", "weight")
            following = materialize(kept.unionByName(_signed(left.join(bodies, "fp"), sign[level])))
            level += 1
        elif screen:
            open_rows = materialize(rest.join(mixed, "band").select("band", "n", "fp", F.xxhash64("class").alias("of")))
            classes = linked(classes, _possible(open_rows, bodies, screen))
            discard(open_rows, members, hubs)
            break
        else:
            following = materialize(rest.join(mixed, "band", "left_semi").select("band", "fp", "weight"))
            cells *= GROWTH
        discard(members, hubs)
        members = following
    discard(members, bodies, *tested)
    return classes


def _possible(rows: DataFrame, bodies: DataFrame, screen: Screen) -> DataFrame:
    """(a, b) of the pairs of different classes in the buckets of ``rows`` (band, n, fp, of: a hash of the class) that may be similar.

    Two classes with one hash would not be compared: 64 bits tell apart the few of one bucket.
    """
    small = rows.where(F.col("n") <= SMALL)
    one, other = small.select("band", F.col("fp").alias("a"), F.col("of").alias("of_a")), small.select("band", F.col("fp").alias("b"), F.col("of").alias("of_b"))
    near = one.join(other, "band").where("a < b AND of_a <> of_b").select("a", "b")

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits, weights = zip(*screen.sketch(batch["body"].tolist()), strict=True) if len(batch) else ((), ())
            yield pd.DataFrame({"fp": batch["fp"], "bits": pd.Series(bits, dtype=object, index=batch.index), "weight": pd.Series(weights, dtype=float, index=batch.index)})

    large = rows.where(F.col("n") > SMALL)
    nodes = large.select("fp").distinct().join(bodies, "fp").select("fp", "body")
    nodes = materialize(nodes.mapInPandas(sketched, "fp binary, bits binary, weight double"))
    sizes = large.join(nodes.select("fp", F.length("bits").alias("size")), "fp").groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    cells = sizes.select("band", F.greatest(F.ceil(F.col("n") / CELL), F.ceil(F.col("bytes") / CELL_BYTES)).alias("cells"))
    placed = large.select("band", "fp", "of").join(cells, "band").withColumn("cell", F.pmod(F.xxhash64("fp"), F.col("cells")))
    placed = placed.withColumn("meets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    placed = placed.select("band", F.least("cell", "meets").alias("i"), F.greatest("cell", "meets").alias("j"), "cell", "fp", "of").join(nodes, "fp")

    def met(block: pd.DataFrame) -> pd.DataFrame:
        a, b = _block(block["bits"].tolist(), block["weight"].to_numpy(), block["of"].to_numpy(), block["cell"].to_numpy(), screen.could)
        fp = block["fp"].to_numpy()
        return pd.DataFrame({"a": [min(x, y) for x, y in zip(fp[a], fp[b], strict=True)], "b": [max(x, y) for x, y in zip(fp[a], fp[b], strict=True)]}, dtype=object)

    far = placed.groupBy("band", "i", "j").applyInPandas(met, "a binary, b binary")
    return near.unionByName(far).distinct()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches of more words made as short as ``words``: a shingle's bit is its hash modulo the number of bits."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


def _block(bits: list[bytes], weight: np.ndarray, of: np.ndarray, cell: np.ndarray, could: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different ``of`` that ``could`` lets pass: of one cell, or one of each where there are two."""
    size = np.array([len(b) // 8 for b in bits])
    across = len(set(cell.tolist())) > 1
    lengths = sorted(set(size.tolist()))
    own = {w: np.flatnonzero(size == w) for w in lengths}
    table = {w: np.frombuffer(b"".join(bits[k] for k in own[w]), dtype=np.uint64).reshape(-1, w) for w in lengths}
    left, right = [], []
    for x, w in enumerate(lengths):
        for v in lengths[x:]:
            others, theirs = own[v], _folded(table[v], w)
            n_theirs = np.bitwise_count(theirs).sum(axis=1, dtype=np.int64)
            for k, mine in zip(own[w], table[w], strict=True):
                free = of[others] != of[k]
                if v == w:
                    free &= others > k
                if across:
                    free &= cell[others] != cell[k]
                at = np.flatnonzero(free)
                if not len(at):
                    continue
                both = np.bitwise_count(theirs[at] & mine).sum(axis=1, dtype=np.int64)
                passed = at[could(int(np.bitwise_count(mine).sum(dtype=np.int64)) - both, n_theirs[at] - both, weight[k], weight[others[at]])]
                left.append(np.full(len(passed), k))
                right.append(others[passed])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _weighed(members: DataFrame) -> DataFrame:
    """(band, fp, weight) of rows with the size ``n`` of their bucket: a node whose buckets are large is near many others."""
    return members.select("band", "fp").join(members.groupBy("fp").agg(F.sum("n").alias("weight")), "fp").select("band", "fp", "weight")


def _mixed(rows: DataFrame) -> DataFrame:
    """(band, n) of buckets that hold two classes or more, told by a hash of the class: compared are the few classes of one bucket."""
    sides = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("of").alias("a"), F.max("of").alias("b"))
    return sides.where("a <> b").select("band", "n")


def _signed(nodes: DataFrame, sign: Callable) -> DataFrame:
    """(band, fp, weight) of the buckets of ``nodes`` (fp, body, of: a hash of the class) that hold two classes or more."""

    def bands_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"fp": batch["fp"], "of": batch["of"], "bands": sign(batch["body"].tolist())})

    made = materialize(nodes.select("fp", "of", "body").mapInPandas(bands_of, "fp binary, of long, bands array<long>"))
    rows = made.select("fp", "of", F.explode("bands").alias("band"))
    return _weighed(rows.join(_mixed(rows), "band"))


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` after the classes that new links touch have become one."""
    ends = links.join(classes.select(F.col("fp").alias("a"), F.col("class").alias("u")), "a").join(classes.select(F.col("fp").alias("b"), F.col("class").alias("v")), "b")
    joined = connected_components(ends.select("u", "v"), src="u", dst="v").select(F.col("node").alias("class"), "component")
    return classes.join(joined, "class", "left").select("fp", F.coalesce("component", "class").alias("class"))


def _verified(pairs: DataFrame, bodies: DataFrame, similar: Callable) -> DataFrame:
    """``pairs`` with ``linked``. Members' bodies travel; a hub's meets them in the tasks of its own pairs."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": similar(batch["body_a"].tolist(), batch["body_b"].tolist())})

    left = bodies.select(F.col("fp").alias("a"), F.col("body").alias("body_a"))
    right = bodies.select(F.col("fp").alias("b"), F.col("body").alias("body_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "body_a", "body_b").mapInPandas(check, "a binary, b binary, linked boolean")
