"""Long sequences as chunk tables (id, number, bases): cuts, edits and tags that touch only the chunks they need.

Chunk 0, 1, ... of a sequence hold SIZE bases each, the last one the rest; an
empty sequence has one empty chunk. So a place tells its chunk by a division,
every job meets chunks by equality on (id, number), and no value is longer
than a chunk but for results that a caller asks to be whole. Ids are unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sporeline.functions.bases import reverse_complement
from sporeline.functions.storage import materialize

SIZE = 1 << 14


def chunked(seqs: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, number, bases) of sequences (id, seq); a null sequence counts as empty."""
    seq = F.coalesce("seq", F.lit(""))
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(seq) / size).cast("int") - 1, F.lit(0)))
    return seqs.select("id", seq.alias("seq"), F.explode(numbers).alias("number")).select("id", "number", F.substring("seq", F.col("number") * size + 1, F.lit(size)).alias("bases"))


def lengths(chunks: DataFrame) -> DataFrame:
    """(id, length)."""
    return chunks.groupBy("id").agg(F.sum(F.length("bases").cast("long")).alias("length"))


def whole(pieces: DataFrame, keys: list[str], order: str = "number", bases: str = "bases", out: str = "seq") -> DataFrame:
    """(keys, out): pieces of each key put together in order, for results that are meant to be one value."""
    return pieces.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.struct(order, bases)))[bases], "").alias(out))


def regrid(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """A chunk table from pieces (id, at 0-based, bases) that cover each sequence and are no longer than a chunk."""
    first, last = F.expr(f"cast(at div {size} as int)"), F.expr(f"cast((at + greatest(length(bases), 1) - 1) div {size} as int)")
    cells = pieces.select("id", "at", "bases", F.explode(F.sequence(first, last)).alias("number"))
    begin = F.greatest(F.col("number").cast("long") * size, "at")
    part = F.substring("bases", (begin - F.col("at") + 1).cast("int"), ((F.col("number") + 1).cast("long") * size - begin).cast("int"))
    parts = cells.select("id", "number", begin.alias("_at"), part.alias("bases"))
    return whole(parts, ["id", "number"], "_at", out="bases")


def read_fasta_chunks(spark: SparkSession, path: str, size: int = SIZE) -> DataFrame:
    """S1 for records of any length: (id, number, bases), white space dropped. Lines before a file's first header are left out.

    A task reads its block of a file line by line; the place where a block
    goes on with a record is known from the bases in the blocks before, one
    row a block and record end.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        place, record, name, at, held, total = None, 0, None, 0, [], 0

        def flush():
            nonlocal at, held, total
            text = "".join(held)
            rows.extend((*place, record, name, at + i, text[i : i + size]) for i in range(0, max(len(text), at == 0), size))
            at, held, total = at + len(text), [], 0

        for batch in batches:
            for file, block, value in zip(batch["file"], batch["block"], batch["value"], strict=True):
                if (file, block) != place:
                    if place:
                        flush()
                    place, record, name, at = (file, block), 0, None, 0
                if value.startswith(">"):
                    flush()
                    record, name, at = record + 1, (value[1:].split() or [""])[0], 0
                else:
                    held.append("".join(value.split()))
                    total += len(value)
                    if total >= size:
                        flush()
            if rows:
                yield pd.DataFrame(rows, columns=["file", "block", "record", "id", "at", "bases"])
                rows = []
        if place:
            flush()
            yield pd.DataFrame(rows, columns=["file", "block", "record", "id", "at", "bases"])

    found = lines.mapInPandas(pieces, "file string, block long, record int, id string, at long, bases string")
    per = found.groupBy("file", "block").agg(
        F.max(F.when(F.col("record") > 0, F.struct("record", "id"))).alias("last"),
        F.sum(F.when(F.col("record") == 0, F.length("bases"))).alias("lead"), F.max("record").alias("n"),
        F.max(F.struct("record", (F.col("at") + F.length("bases")).alias("end"))).alias("tail"),
    )
    # bases of a block that belong to its last record; a block without a header goes on with the one before
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    group = F.count(F.when(F.col("n") > 0, 1)).over(before)
    per = per.select("file", "block", F.last("last.id", ignorenulls=True).over(before).alias("carried"), group.alias("_g"), F.coalesce("tail.end", F.lit(0)).alias("end"), "n", "lead")
    ended = per.withColumn("_g2", F.col("_g") + (F.col("n") > 0).cast("int"))
    run = Window.partitionBy("file", "_g2").orderBy("block")
    sums = ended.select("file", "block", "carried", F.col("_g2").alias("_run"), F.sum("end").over(run).alias("done"))
    earlier = Window.partitionBy("file").orderBy("block")
    sums = sums.select("file", "block", "carried", F.coalesce(F.lag("done").over(earlier), F.lit(0)).alias("gone"))
    placed = found.join(sums, ["file", "block"])
    lead = F.col("record") == 0
    placed = placed.select(F.when(lead, F.col("carried")).otherwise(F.col("id")).alias("id"), F.when(lead, F.col("gone") + F.col("at")).otherwise(F.col("at")).alias("at"), "bases")
    return regrid(placed.where("id IS NOT NULL"), size)


def cut(chunks: DataFrame, ranges: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """(keys, at, bases): pieces of closed 1-based ranges (keys, id, start, end); ``at`` is a piece's place in its range.

    A range with start > end is cut from the other strand. Parts of a range
    beyond its sequence are left out; a range that lies beyond it whole has an
    empty piece; one of an unknown sequence has none.
    """
    lo, hi = F.greatest(F.least("start", "end"), F.lit(1)).cast("long"), F.greatest("start", "end").cast("long")
    asked = ranges.select(*keys, "id", lo.alias("_lo"), hi.alias("_hi"), (F.col("start") > F.col("end")).alias("_minus"))
    number = lambda c: F.expr(f"cast(greatest({c} - 1, 0) div {size} as int)")
    wanted = F.array_union(F.array(F.lit(0)), F.when(F.col("_hi") >= F.col("_lo"), F.sequence(number("_lo"), number("_hi"))).otherwise(F.array().cast("array<int>")))
    met = asked.withColumn("number", F.explode(wanted)).join(chunks.select("id", "number", "bases"), ["id", "number"])
    before = F.col("number").cast("long") * size
    a, b = F.greatest(F.col("_lo"), before + 1), F.least(F.col("_hi"), before + F.length("bases"))
    piece = F.when(a <= b, F.substring("bases", (a - before).cast("int"), (b - a + 1).cast("int"))).otherwise("")
    at = F.when(a > b, 0).when(F.col("_minus"), F.col("_hi") - b).otherwise(a - F.col("_lo"))
    return met.select(*keys, at.alias("at"), F.when(F.col("_minus"), reverse_complement(piece)).otherwise(piece).alias("bases"))


def cut_whole(chunks: DataFrame, ranges: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """(keys, id, start, end, seq): each range row as one value; equal rows are cut once."""
    all_keys = list(dict.fromkeys([*keys, "id", "start", "end"]))
    asked = ranges.groupBy(*all_keys).agg(F.count("*").alias("_n"))
    named = asked.select(F.struct(*all_keys, "_n").alias("_key"), "id", "start", "end")
    found = whole(cut(chunks, named, ["_key"], size), ["_key"], "at")
    return found.select("_key.*", "seq", F.explode(F.sequence(F.lit(1), F.col("_key._n").cast("int"))).alias("_i")).drop("_n", "_i")


def apply_snps(chunks: DataFrame, snps: DataFrame, strict: bool = False, size: int = SIZE) -> DataFrame:
    """Q11: (id, number, bases, applied, rejected): the base at (id, pos, ref, alt) replaced in its chunk.

    Rows of one place go by (ref, alt); strict ones that find another base than
    ``ref`` are rejected, and so are places outside the sequence, counted in
    chunk 0, and rows whose ``alt`` is not one base.
    """
    per = snps.groupBy("id", "pos", "ref", "alt").agg(F.count("*").alias("n")).join(lengths(chunks), "id")
    inside = F.coalesce(F.col("pos").between(1, F.col("length")) & (F.length("alt") == 1), F.lit(False))
    rows = per.select("id", F.when(inside, F.expr(f"cast((pos - 1) div {size} as int)")).otherwise(0).alias("number"), F.when(inside, F.col("pos") - F.expr(f"(pos - 1) div {size}") * size).cast("int").alias("at"), "ref", "alt", "n")
    places = rows.groupBy("id", "number", "at").agg(F.array_sort(F.collect_list(F.struct("ref", "alt", "n"))).alias("edits"), F.sum("n").alias("n"))

    def one(acc: Column, e: Column) -> Column:
        fits = acc["base"] == e["ref"] if strict else F.lit(True)
        # of n equal rows the first may change the base, so that the others no longer fit
        ok = F.when(fits, F.when(F.lit(not strict) | (e["ref"] == e["alt"]), e["n"]).otherwise(1)).otherwise(0)
        return F.struct(F.when(fits, e["alt"]).otherwise(acc["base"]).alias("base"), (acc["ok"] + ok).cast("long").alias("ok"))

    listed = places.groupBy("id", "number").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "edits")))).alias("p"), F.sum("n").alias("all"))
    j = chunks.join(listed, ["id", "number"], "left")
    zero = lambda x: F.struct(F.substring("bases", x["at"], F.lit(1)).alias("base"), F.lit(0).cast("long").alias("ok"))
    done = j.withColumn("p", F.transform(F.coalesce("p", F.array().cast(listed.schema["p"].dataType)), lambda x: F.struct(x["at"].alias("at"), F.aggregate(x["edits"], zero(x), one).alias("to"))))
    # the chunk is put together from the bases between edited places, so work grows with its size, not with edits times size
    ends = lambda i: F.when(i == 0, 0).otherwise(F.get("p", i - 1)["at"])
    parts = F.transform("p", lambda x, i: F.concat(F.substring("bases", ends(i) + 1, x["at"] - ends(i) - 1), x["to"]["base"]))
    tail = F.substring("bases", F.coalesce(F.get("p", F.size("p") - 1)["at"], F.lit(0)) + 1, F.lit(size))
    applied = F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["to"]["ok"])
    return done.select("id", "number", F.concat(F.array_join(parts, ""), tail).alias("bases"), applied.alias("applied"), (F.coalesce("all", F.lit(0)) - applied).alias("rejected"))


def mask_regions(chunks: DataFrame, regions: DataFrame, base: str = "N", size: int = SIZE) -> DataFrame:
    """Q12: the chunk table with regions (id, start, end) overwritten; regions are clamped to the sequence."""
    kept = regions.where("greatest(start, 1) <= end").select("id", F.greatest("start", F.lit(1)).cast("long").alias("s"), F.col("end").cast("long").alias("e"))
    # a region far beyond the sequence must not make a row a chunk of it
    kept = kept.join(lengths(chunks), "id").where("s <= length").withColumn("e", F.least("e", "length"))
    cells = kept.withColumn("number", F.explode(F.sequence(F.expr(f"cast((s - 1) div {size} as int)"), F.expr(f"cast((e - 1) div {size} as int)"))))
    before = F.col("number").cast("long") * size
    cells = cells.select("id", "number", F.greatest(F.col("s") - before, F.lit(1)).cast("int").alias("s"), F.least(F.col("e") - before, F.lit(size)).cast("int").alias("e"))
    longest = cells.groupBy("id", "number", "s").agg(F.max("e").alias("e"))  # a row a base of the chunk at most
    listed = longest.groupBy("id", "number").agg(F.collect_list(F.struct("s", "e")).alias("r"))
    over = lambda acc, r: F.overlay(acc, F.repeat(F.lit(base), r["e"] - r["s"] + 1), r["s"], r["e"] - r["s"] + 1)
    j = chunks.join(listed, ["id", "number"], "left")
    return j.select("id", "number", F.when(F.col("r").isNull(), F.col("bases")).otherwise(F.aggregate("r", F.col("bases"), over)).alias("bases"))


class Pieces:
    """A sequence as pieces (from, n) of the old one, and inserted bases (-1, n), in lists of bounded length."""

    MOST = 512

    def __init__(self, length: int):
        self.blocks = [[(0, length)]] if length else [[]]
        self.sizes = [length]

    def _find(self, at: int) -> tuple[int, int]:
        """The block and the piece in it that begin at ``at``; a piece is parted there."""
        b = 0
        while b + 1 < len(self.blocks) and at > self.sizes[b]:
            at -= self.sizes[b]
            b += 1
        k, block = 0, self.blocks[b]
        while k < len(block) and at >= block[k][1]:
            at -= block[k][1]
            k += 1
        if at:
            source, n = block[k]
            block[k : k + 1] = [(source, at), (source + at if source >= 0 else -1, n - at)]
            k += 1
        return b, k

    def insert(self, at: int, n: int) -> None:
        b, k = self._find(at)
        self.blocks[b].insert(k, (-1, n))
        self.sizes[b] += n
        if len(self.blocks[b]) > self.MOST:
            half = self.blocks[b][self.MOST // 2 :]
            del self.blocks[b][self.MOST // 2 :]
            size = sum(n for _, n in half)
            self.sizes[b] -= size
            self.blocks.insert(b + 1, half)
            self.sizes.insert(b + 1, size)

    def delete(self, at: int, n: int) -> None:
        self._find(at + n)
        b, k = self._find(at)
        while n:
            block = self.blocks[b]
            if k == len(block):
                b, k = b + 1, 0
                continue
            size = block[k][1]
            if size > n:
                source = block[k][0]
                block[k] = (source + n if source >= 0 else -1, size - n)
                size = n
            else:
                del block[k]
            self.sizes[b] -= size
            n -= size

    def all(self) -> list[tuple[int, int]]:
        return [p for block in self.blocks for p in block]


def apply_moves(chunks: DataFrame, moves: DataFrame, base: str = "N", size: int = SIZE) -> DataFrame:
    """Q13: the chunk table after edits (id, ord, loc, shift), each on the sequence as the edits before it left it.

    A shift > 0 inserts that many ``base`` before place ``loc``, a shift < 0
    deletes the bases just before ``loc``, a shift of 0 does nothing. An edit
    that reaches outside the sequence fails the job. The edits of a sequence
    are folded in one task, as numbers, in sorted partitions without a call a
    sequence; bases are moved by chunk.
    """

    columns = ["id", "ord", "loc", "shift", "length"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = (r for batch in batches for r in zip(*(batch[c].tolist() for c in columns), strict=True))
        out: list[tuple] = []
        for name, rows in groupby(every, key=itemgetter(0)):
            made = None
            for _, _, loc, shift, length in rows:
                if made is None:
                    made, now = Pieces(length), length
                at = loc - 1 + min(shift, 0)
                if shift and not (0 <= at and loc - 1 <= now):
                    raise ValueError(f"edit at {loc} by {shift} reaches outside a sequence of {now} bases")
                if shift > 0:
                    made.insert(at, shift)
                elif shift < 0:
                    made.delete(at, -shift)
                now += shift
            at = 0
            for source, n in made.all() or [(-1, 0)]:
                out.append((name, at, source, n))
                at += n
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=["id", "at", "source", "n"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["id", "at", "source", "n"])

    asked = moves.select("id", F.col("ord").cast("long").alias("ord"), F.col("loc").cast("long").alias("loc"), F.col("shift").cast("long").alias("shift"))
    kind = chunks.schema["id"].dataType.simpleString()
    placed = asked.join(lengths(chunks), "id").repartition("id").sortWithinPartitions("id", "ord", "loc", "shift").select(*columns)
    table = materialize(placed.mapInPandas(fold, f"id {kind}, at long, source long, n long"))
    kept = table.where("source >= 0").select("id", "at", (F.col("source") + 1).alias("start"), (F.col("source") + F.col("n")).alias("end"))
    old = cut(chunks, kept.withColumnRenamed("at", "_to").withColumn("_id", F.col("id")), ["_id", "_to"], size).where("bases <> ''")
    old = old.select(F.col("_id").alias("id"), (F.col("_to") + F.col("at")).alias("at"), "bases")
    new = table.where("source < 0").select("id", "at", "n", F.explode(F.expr(f"sequence(0L, greatest(n - 1, 0) div {size})")).alias("_k"))
    new = new.select("id", (F.col("at") + F.col("_k") * size).alias("at"), F.repeat(F.lit(base), F.least(F.lit(size), F.col("n") - F.col("_k") * size).cast("int")).alias("bases"))
    still = chunks.join(asked.select("id").distinct(), "id", "left_anti")
    return still.select("id", "number", "bases").unionByName(regrid(old.unionByName(new), size))


def sequence_tags(features: DataFrame, chunks: DataFrame, half: int = 40, size: int = SIZE) -> DataFrame:
    """Q19: (id, side, tag): the 2 * half bases around each feature's start and end.

    A tag begins ``half`` bases before the place; both its ends are clamped to
    the sequence, and the end to one base less than its length.
    """
    j = features.join(lengths(chunks).withColumnRenamed("id", "ref"), "ref")
    sides = F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("start").alias("at")), F.struct(F.lit("end").alias("side"), F.col("end").alias("at"))))
    clamp = lambda c: F.when(c < 0, 0).when(c >= F.col("length"), F.col("length") - 1).otherwise(c)
    rows = j.select(F.col("id").alias("_feature"), F.col("ref").alias("id"), "length", sides.alias("x"))
    rows = rows.withColumns({"_from": clamp(F.col("x.at") - 1 - half), "_to": clamp(F.col("x.at") - 1 + half)})
    rows = rows.select("_feature", "id", F.col("x.side").alias("_side"), (F.col("_from") + 1).alias("start"), F.col("_to").alias("end"))
    some = rows.where("start <= end")
    tags = cut_whole(chunks, some, ["_feature", "_side"], size).select("_feature", "_side", "seq")
    none = rows.where("start > end").select("_feature", "_side", F.lit("").alias("seq"))
    return tags.unionByName(none).select(F.col("_feature").alias("id"), F.col("_side").alias("side"), F.col("seq").alias("tag"))


def spliced(features: DataFrame, chunks: DataFrame, kind: str = "CDS", size: int = SIZE) -> DataFrame:
    """(parent, seq, regions): pieces (parent, strand, seqid, type, start, end) of each parent cut, put together in order, reverse-complemented on the minus strand."""
    asked = features.where(F.col("type") == kind).select("parent", "strand", F.col("seqid").alias("id"), "start", "end")
    pieces = cut_whole(chunks, asked, ["parent", "strand"], size)
    per = pieces.groupBy("parent", "strand").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("seq").alias("piece")))).alias("p"))
    joined = F.array_join(F.col("p.piece"), "")
    regions = F.array_join(F.transform("p", lambda x: F.concat_ws("..", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return per.select("parent", F.when(F.col("strand") == "-", reverse_complement(joined)).otherwise(joined).alias("seq"), regions.alias("regions"))
