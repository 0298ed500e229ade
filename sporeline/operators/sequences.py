"""Sequence records (id, descr, seq, line_no; reads add qual array<int>): projections, filters, edits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sporeline.functions.bases import longest_open_pieces, peptide, reverse_complement
from sporeline.functions.numbering import numbered
from sporeline.operators import chunks as C


def seq_lengths(seqs: DataFrame) -> DataFrame:
    """Q1."""
    return seqs.select("id", F.length("seq").alias("length"))


def seq_md5(seqs: DataFrame) -> DataFrame:
    """Q2."""
    return seqs.select("id", F.md5("seq").alias("md5"))


def base_distribution(seqs: DataFrame, alphabet: str = "ACGTN") -> DataFrame:
    """Q3: one row: count of each base, total, percent N; no row is made for a base."""
    count = lambda c: F.length("seq") - F.length(F.replace("seq", F.lit(c)))
    sums = seqs.agg(*[F.sum(count(c)).alias(f"n_{c}") for c in alphabet], F.sum(F.length("seq")).alias("total"))
    return sums.withColumn("percent_n", F.round(100 * F.col("n_N") / F.col("total"), 4))


def seq_grep(seqs: DataFrame, patterns: str | list[str], on: str = "record", invert: bool = False, exact: bool = False, ignore_case: bool = False) -> DataFrame:
    """Q4: records that match any pattern (or none, inverted), over id, descr, seq or the whole record."""
    patterns = [patterns] if isinstance(patterns, str) else patterns
    text = F.concat(F.lit(">"), "id", F.lit(" "), F.coalesce("descr", F.lit("")), F.lit("\n"), "seq") if on == "record" else F.col(on)
    if exact:
        hit = text.isin(patterns)
    else:
        hit = text.rlike(("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns))
    return seqs.where(~hit if invert else hit)


def dedup_nth(seqs: DataFrame, n: int = 1) -> DataFrame:
    """Q5: the n-th record of each id in line order."""
    by = Window.partitionBy("id").orderBy("line_no")
    return seqs.withColumn("_n", F.row_number().over(by)).where(F.col("_n") == n).drop("_n")


def sort_by_id(seqs: DataFrame) -> DataFrame:
    """Q6: all records, repeated ids too, in range partitions by id."""
    return seqs.orderBy("id", "line_no")


def edit_records(seqs: DataFrame, id: Callable | None = None, descr: Callable | None = None, seq: Callable | None = None, revcom: bool = False) -> DataFrame:
    """Q7: each part through a function of columns, then reverse complement if asked."""
    same = lambda c: c
    edited = (seq or same)(F.col("seq"))
    return seqs.withColumns({"id": (id or same)(F.col("id")), "descr": (descr or same)(F.col("descr")), "seq": reverse_complement(edited) if revcom else edited})


def subsequence(seqs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Q8: (id:start-end, seq) for ranges (id, start, end), closed and 1-based; start > end takes the reverse complement. Ids are unique."""
    name = F.concat("id", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return C.cut_whole(C.chunked(seqs), ranges.select("id", "start", "end"), []).select(name.alias("id"), "seq")


def extract_seqs(seqs: DataFrame, ids: DataFrame | None = None, min_len: int | None = None, pattern: str | None = None, invert: bool = False) -> DataFrame:
    """Q9: records whose id is listed, or longer than min_len, or matching the pattern in id or seq; or all others."""
    hit = F.lit(False)
    out = seqs
    if ids is not None:
        out = out.join(ids.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left")
        hit = hit | F.coalesce("_in", F.lit(False))
    if min_len is not None:
        hit = hit | (F.length("seq") > min_len)
    if pattern is not None:
        hit = hit | F.col("id").rlike(pattern) | F.col("seq").rlike(pattern)
    return out.where(~hit if invert else hit).select(*seqs.columns)


def renumber_ids(seqs: DataFrame, root: str, width: int = 4) -> DataFrame:
    """Q10: records in line order with new ids root_0001, ... and the old id."""
    rows = numbered(seqs, [F.col("line_no")], "_n")
    name = F.concat(F.lit(f"{root}_"), F.format_string(f"%0{width}d", F.col("_n")))
    return rows.withColumns({"old_id": F.col("id"), "id": name}).drop("_n")


def apply_snps(seqs: DataFrame, snps: DataFrame, strict: bool = False) -> DataFrame:
    """Q11: (id, seq, applied, rejected): bases replaced at (id, pos, ref, alt); strict skips places whose base is not ref. See ``chunks.apply_snps``."""
    done = C.apply_snps(C.chunked(seqs), snps, strict)
    counts = done.groupBy("id").agg(*[F.sum(c).cast("int").alias(c) for c in ("applied", "rejected")])
    return C.whole(done, ["id"]).join(counts, "id")


def mask_regions(seqs: DataFrame, regions: DataFrame, base: str = "N") -> DataFrame:
    """Q12: sequences with regions (id, start, end) overwritten; regions are clamped to the sequence. Ids are unique."""
    return _changed(seqs, C.mask_regions(C.chunked(seqs), regions, base))


def _changed(seqs: DataFrame, made: DataFrame) -> DataFrame:
    """``seqs`` with the sequences of a chunk table."""
    return seqs.drop("seq").join(C.whole(made, ["id"]), "id").select(*seqs.columns)


def features_outside(features: DataFrame, regions: DataFrame, width: int = 10_000) -> DataFrame:
    """Q12: features without those that have an end inside a region of their sequence (ref, start, end).

    Regions are cut into bins of ``width``, so each end meets only the regions
    of its bin, by an equality join.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    r = regions.select(F.col("ref").alias("_ref"), F.col("start").alias("_s"), F.col("end").alias("_e"), bins.alias("_bin"))
    for end in ("start", "end"):
        inside = (F.col("ref") == F.col("_ref")) & (F.floor(F.col(end) / width) == F.col("_bin")) & F.col(end).between(F.col("_s"), F.col("_e"))
        features = features.join(r, inside, "left_anti")
    return features


def apply_moves(seqs: DataFrame, moves: DataFrame) -> DataFrame:
    """Q13: edits (id, ord, loc, shift) in order: shift > 0 inserts that many N before loc, < 0 deletes the bases before it. Ids are unique. See ``chunks.apply_moves``."""
    return _changed(seqs, C.apply_moves(C.chunked(seqs), moves))


def primers_to_fasta(primers: DataFrame) -> DataFrame:
    """Q14: (id, seq): forward, twenty n, reverse; forward alone where there is no reverse."""
    both = F.concat("forward", F.lit("n" * 20), "reverse")
    return primers.select("id", F.when(F.col("reverse").isNull() | (F.col("reverse") == ""), F.col("forward")).otherwise(both).alias("seq"))


def ungap_alignment(aligned: DataFrame) -> DataFrame:
    """Q15."""
    return aligned.withColumn("seq", F.regexp_replace("seq", "[-.]", ""))


def read_quality_stats(reads: DataFrame, cuts: tuple[int, ...] = (15, 20, 25)) -> DataFrame:
    """Q16: length, N count, and for each cut the span between first and last good base and the percent of bases below it."""
    cols = ["id", F.length("seq").alias("length"), (F.length("seq") - F.length(F.replace(F.upper("seq"), F.lit("N")))).alias("n_count")]
    for q in cuts:
        good = F.transform("qual", lambda x: x >= q)
        first = F.array_position(good, True)
        last = F.size("qual") - F.array_position(F.reverse(good), True) + 1
        cols.append(F.when(first > 0, last - first + 1).otherwise(0).cast("long").alias(f"span_{q}"))
        below = F.size(F.filter("qual", lambda x: x < q))
        cols.append(F.round(100 * below / F.size("qual"), 2).alias(f"below_{q}"))
    return reads.select(*cols)


def pair_quality(stats1: DataFrame, stats2: DataFrame, cutoff: float = 90) -> DataFrame:
    """Q17: (pair, tag) over mates, ids without their last two characters: GOOD, PAIR1 POOR, PAIR2 POOR, BOTH POOR, ABSENT.

    A read is poor when the percent of its bases below quality 15 reaches the cutoff.
    """
    side = lambda df, n: df.select(F.expr("substring(id, 1, length(id) - 2)").alias("pair"), (F.col("below_15") >= cutoff).alias(f"poor{n}"))
    j = side(stats1, 1).join(side(stats2, 2), "pair", "full")
    tag = (
        F.when(F.col("poor1").isNull() | F.col("poor2").isNull(), "ABSENT").when(F.col("poor1") & F.col("poor2"), "BOTH POOR")
        .when(F.col("poor1"), "PAIR1 POOR").when(F.col("poor2"), "PAIR2 POOR").otherwise("GOOD")
    )
    return j.select("pair", tag.alias("tag"))


def end_n_trims(seqs: DataFrame) -> DataFrame:
    """Q18: (id, leading, trailing) runs of N."""
    return seqs.select("id", F.length(F.regexp_extract("seq", "(?i)^(N*)", 1)).alias("leading"), F.length(F.regexp_extract("seq", "(?i)(N*)$", 1)).alias("trailing"))


def sequence_tags(features: DataFrame, seqs: DataFrame, half: int = 40) -> DataFrame:
    """Q19: (id, side, tag): 2 * half bases around each feature's start and end; the right clamp keeps length - 1. Ids of sequences are unique."""
    return C.sequence_tags(features, C.chunked(seqs), half)


def end_samples(seqs: DataFrame, size: int = 300) -> DataFrame:
    """Q23: for sequences longer than ``size`` its first and last bases (half the length when shorter than twice), ids with :5 and :3."""
    n = F.when(F.length("seq") < 2 * size, F.floor(F.length("seq") / 2)).otherwise(size).cast("int")
    five = F.struct(F.concat("id", F.lit(":5")).alias("id"), F.substring("seq", F.lit(1), n).alias("seq"))
    three = F.struct(F.concat("id", F.lit(":3")).alias("id"), F.substring("seq", F.length("seq") - n + 1, n).alias("seq"))
    return seqs.where(F.length("seq") > size).select(F.explode(F.array(five, three)).alias("x")).select("x.id", "x.seq")


def mask_percent(seqs: DataFrame, cutoff: float = 50) -> DataFrame:
    """Q24: (id, percent_n, removed) per sequence."""
    pct = F.round(100 * (F.length("seq") - F.length(F.replace(F.upper("seq"), F.lit("N")))) / F.length("seq"), 2)
    return seqs.where(F.length("seq") > 0).select("id", pct.alias("percent_n"), (pct > cutoff).alias("removed"))


def tag_masked(cleaning: DataFrame, masked: DataFrame, cutoff: float = 50, rm_tag: str = "seq_masked", trim_tag: str = "mask_percentage") -> DataFrame:
    """Q24: cleaning rows (id, rm_tag, trim_tag) with both tags appended, after '; ', where more than ``cutoff`` percent is masked.

    ``masked`` is the result of ``mask_percent``; the trim tag carries the
    whole part of the percentage. Sequences that it lacks stay as they are.
    """
    j = cleaning.join(masked.select("id", "percent_n"), "id", "left")
    over = F.coalesce(F.col("percent_n") > cutoff, F.lit(False))

    def appended(column: str, tag: Column) -> Column:
        return F.when(over, F.when(F.col(column).rlike(r"\w"), F.concat(column, F.lit("; "), tag)).otherwise(tag)).otherwise(F.col(column))

    share = F.concat(F.lit(f"{trim_tag}("), F.floor("percent_n").cast("string"), F.lit("%)"))
    return j.withColumns({"rm_tag": appended("rm_tag", F.lit(rm_tag)), "trim_tag": appended("trim_tag", share)}).select(*cleaning.columns)


def annotate_deflines(seqs: DataFrame, functions: DataFrame) -> DataFrame:
    """Q25: go_terms: and functional_description: on deflines, replaced where there; gene id is the id without its version."""
    rows = seqs.withColumn("_gene", F.regexp_replace("id", r"\.\d+$", "")).join(functions.select(F.col("id").alias("_gene"), "go_terms", "description"), "_gene", "left")
    bare = F.trim(F.regexp_replace(F.coalesce("descr", F.lit("")), r'\s*(go_terms:\S+|functional_description:"[^"]*")', ""))
    go = F.when(F.col("go_terms").isNotNull(), F.concat(F.lit("go_terms:"), "go_terms"))
    text = F.when(F.col("description").isNotNull(), F.concat(F.lit('functional_description:"'), "description", F.lit('"')))
    return rows.withColumn("descr", F.concat_ws(" ", F.when(bare != "", bare), go, text)).select(*seqs.columns)


def trim_by_coords(reads: DataFrame, coords: DataFrame) -> DataFrame:
    """Q26: sequence and quality cut at (id, begin 0-based, length)."""
    j = reads.join(coords, "id")
    cut = {"seq": F.substring("seq", (F.col("begin") + 1).cast("int"), F.col("length").cast("int"))}
    if "qual" in reads.columns:
        cut["qual"] = F.slice("qual", (F.col("begin") + 1).cast("int"), F.col("length").cast("int"))
    return j.withColumns(cut).select(*reads.columns)


def translate_cds(cds: DataFrame, strip_lower: bool = False, max_other: float = 100) -> DataFrame:
    """Q21: (id, protein, set_apart): sequences with more than max_other percent of letters outside ATCGN have no protein."""
    seq = F.regexp_replace("seq", "[a-z]", "") if strip_lower else F.col("seq")
    rows = cds.select("id", F.coalesce(seq, F.lit("")).alias("seq"))
    other = 100 * F.length(F.regexp_replace(F.upper("seq"), "[ATCGN]", "")) / F.greatest(F.length("seq"), F.lit(1))
    return rows.select("id", F.when(other <= max_other, peptide(F.upper("seq"))).alias("protein"), (other > max_other).alias("set_apart"))


def longest_orf(seqs: DataFrame) -> DataFrame:
    """Q20: (id, frame, begin, protein, cds): all longest stop-free pieces over six frames; begin is 0-based on the strand of the frame. Ids are unique."""

    @F.pandas_udf("array<struct<frame:int,begin:int,protein:string,cds:string>>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for seqs in batches:
            yield pd.Series([longest_open_pieces(s) for s in seqs], dtype=object)

    found = seqs.where("id IS NOT NULL").select("id", F.explode(pieces(F.upper(F.coalesce("seq", F.lit(""))))).alias("x")).select("id", "x.*")
    top = found.withColumn("top", F.max(F.length("protein")).over(Window.partitionBy("id")))  # ids that repeat share their longest
    return top.where(F.length("protein") == F.col("top")).drop("top")


def walk_start_stop(seqs: DataFrame, best_hits: DataFrame) -> DataFrame:
    """Q22: (id, start, stop, complete): from the best hit's ends in frame back to M and on to a stop; null where unknown. Places are 1-based."""
    j = seqs.join(best_hits.select(F.col("query_id").alias("id"), "q_start", "q_end"), "id")
    seq = F.upper("seq")
    off = F.pmod(F.col("q_start") - 1, F.lit(3)).cast("int")
    back = peptide(F.substring(seq, off + 1, (F.col("q_start") - 1 - off + 3).cast("int")))
    j = j.withColumns({"_back": back, "_off": off, "_to": (F.col("q_start") - 1 + F.floor((F.col("q_end") - F.col("q_start") + 1) / 3) * 3).cast("int")})
    j = j.withColumns({"_tail": F.regexp_extract("_back", r"([M*][^M*]*)$", 1), "_on": F.call_function("instr", peptide(F.substring(seq, F.col("_to") + 1, F.length("seq"))), F.lit("*"))})
    start = F.when(F.col("_tail").startswith("M"), F.col("_off") + 3 * (F.length("_back") - F.length("_tail")) + 1).cast("int")
    stop = F.when(F.col("_on") > 0, F.col("_to") + 3 * F.col("_on")).cast("int")
    return j.select("id", start.alias("start"), stop.alias("stop"), (start.isNotNull() & stop.isNotNull()).alias("complete"))
