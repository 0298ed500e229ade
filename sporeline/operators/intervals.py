"""Interval joins, unions of ranges, and assembly lines. Coordinates are 1-based and closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_ranges(ranges: DataFrame, keys: list[str], adjoin: int = 0, aggs: list[Column] | None = None, ties: list[Column] | None = None) -> DataFrame:
    """Union of the ranges (start, end) of each key: one row a region, with ``aggs`` over its ranges.

    ``adjoin`` = 1 joins ranges that touch without overlap. ``aggs`` can name
    ``_inside``: whether a range lies in another one; of equal ranges the first
    by ``ties`` does not.
    """
    by = Window.partitionBy(*keys).orderBy("start", F.col("end").desc(), *(ties or []))
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumns({"_new": F.when(F.col("start") <= reach + adjoin, 0).otherwise(1), "_inside": F.coalesce(F.col("end") <= reach, F.lit(False))})
    marked = marked.withColumn("_region", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy(*keys, "_region").agg(F.min("start").alias("start"), F.max("end").alias("end"), *(aggs or []))
    return merged.drop("_region")


def overlap_join(a: DataFrame, b: DataFrame, mode: str = "strict", width: int = 1000, ref: str = "ref") -> DataFrame:
    """Pairs on one reference whose ranges overlap; columns get the suffixes _a and _b.

    Ranges are cut into bins, so the join is an equality join on (ref, bin)
    that spreads a chromosome over tasks; a pair is kept in its first common
    bin only. A range over many bins goes to bins 64 times as wide, each side
    meeting the other at both widths, so that no range makes many rows.
    'strict' wants an end of ``a`` between the ends of ``b``, or ``b`` between
    the ends of ``a``, ends not counted: equal ranges do not match, nor a
    longer ``a`` that shares an end with ``b``. 'closed' counts a common place
    as overlap.
    """
    left = a.select(*[F.col(c).alias(f"{c}_a") for c in a.columns])
    right = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns])
    wide = width * 64

    def binned(df: DataFrame, s: str, own: int, at: int) -> DataFrame:
        """Rows whose own level is ``own``, in bins of level ``at``."""
        long = F.floor(F.col(f"end_{s}") / width) - F.floor(F.col(f"start_{s}") / width) > 64
        w = wide if at else width
        return df.where(long if own else ~long).select("*", F.explode(F.sequence(F.floor(F.col(f"start_{s}") / w), F.floor(F.col(f"end_{s}") / w))).alias("_bin"))

    if mode == "strict":
        between = lambda c: (F.col(c) > F.col("start_b")) & (F.col(c) < F.col("end_b"))
        test = between("start_a") | between("end_a") | ((F.col("start_a") < F.col("start_b")) & (F.col("end_a") > F.col("end_b")))
    else:
        test = (F.col("start_a") <= F.col("end_b")) & (F.col("start_b") <= F.col("end_a"))
    out = None
    for own_a in (0, 1):
        for own_b in (0, 1):
            at = max(own_a, own_b)
            w = wide if at else width
            x, y = binned(left, "a", own_a, at), binned(right, "b", own_b, at).withColumnRenamed("_bin", "_bin_b")
            pairs = x.join(y, (F.col(f"{ref}_a") == F.col(f"{ref}_b")) & (F.col("_bin") == F.col("_bin_b")))
            pairs = pairs.where(test & (F.col("_bin") == F.floor(F.greatest("start_a", "start_b") / w))).drop("_bin", "_bin_b")
            out = pairs if out is None else out.unionByName(pairs)
    return out


def overlap_counts(features: DataFrame, marks: DataFrame, mode: str = "strict", width: int = 1000, ref: str = "ref") -> DataFrame:
    """``features`` with ``marked``: how many marks overlap each, as ``overlap_join`` of marks with features finds, without the pairs.

    Marks that start before a feature's end less those that end before its
    start are those that overlap it; strict ones are less by the marks that
    share its start and reach its end, and by those that share its end and
    start before it. The four numbers are running sums along a reference, whose
    bins are handed on, so the work grows with the rows. Ranges have start <= end.
    """
    strict = mode == "strict"
    own = features.select("*", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_n"))
    per = marks.where(F.col(ref).isNotNull() & (F.col("start") <= F.col("end"))).groupBy(ref, "start", "end").agg(F.count("*").alias("_n"))
    rows = own.unionByName(per.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    mark = F.col("_kind") == 1
    upto = lambda w: F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    # of equal places, those that count are sorted before the feature
    first, after = F.col("_kind").desc(), F.col("_kind").asc()
    for name, of_mark, of_feature, tie in (("_begun", "start", "end", after if strict else first), ("_ended", "end", "start", first if strict else after)):
        place = F.when(mark, F.col(of_mark)).otherwise(F.col(of_feature))
        rows = rows.withColumns({"_at": place, "_bin": F.floor(place / width)})
        sums = per.groupBy(ref, F.floor(F.col(of_mark) / width).alias("_bin")).agg(F.sum("_n").alias("_s"))
        bins = rows.select(ref, "_bin").distinct().join(sums, [ref, "_bin"], "left")
        before = F.coalesce(F.sum("_s").over(Window.partitionBy(ref).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn(name, upto(Window.partitionBy(ref, "_bin").orderBy("_at", tie)))
        rows = rows.join(bins.select(ref, "_bin", before.alias("_before")), [ref, "_bin"], "left").withColumn(name, F.col(name) + F.col("_before")).drop("_before")
    n = F.col("_begun") - F.col("_ended")
    if strict:
        rows = rows.withColumn("_start", upto(Window.partitionBy(ref, "start").orderBy(F.col("end").desc(), first)))
        rows = rows.withColumn("_end", upto(Window.partitionBy(ref, "end").orderBy("start", after)))
        rows = rows.withColumn("_point", F.sum(F.when(F.col("start") == F.col("end"), F.col("_n"))).over(Window.partitionBy(ref, "end")))
        n = F.when(F.col("start") == F.col("end"), n + F.coalesce("_point", F.lit(0))).otherwise(n - F.col("_start") - F.col("_end"))
    found = F.when(F.col("start") <= F.col("end"), F.coalesce(n, F.lit(0))).otherwise(0)
    return rows.where(~mark).select(*features.columns, found.cast("long").alias("marked"))


def overlap_summary(features: DataFrame, marks: DataFrame, mode: str = "strict") -> DataFrame:
    """(ref, features, features_hit, bases): of features that marks overlap; bases are the feature's end - start, summed over pairs, which are counted and not made."""
    counts = overlap_counts(features.select("ref", "start", "end", "id"), marks, mode)
    hit, bases = F.countDistinct(F.when(F.col("marked") > 0, F.col("id"))), F.sum((F.col("end") - F.col("start")) * F.col("marked"))
    return counts.groupBy("ref").agg(F.count("*").alias("features"), hit.alias("features_hit"), F.coalesce(bases, F.lit(0)).alias("bases"))


def uncontained_cds(features: DataFrame) -> DataFrame:
    """CDS rows of a gene that lie in no exon of it on their strand; features has gene, type, strand, start, end."""
    cds = features.where("type = 'CDS'")
    exon = features.where("type = 'exon'").select(*[F.col(c).alias(f"_{c}") for c in ("gene", "strand", "start", "end")])
    inside = (cds["gene"] == exon["_gene"]) & (cds["strand"] == exon["_strand"]) & (exon["_start"] <= cds["start"]) & (cds["end"] <= exon["_end"])
    return cds.join(exon, inside, "left_anti")


def nest_components(scaffolds: DataFrame, contigs: DataFrame, width: int = 100_000) -> DataFrame:
    """I4: (seqid, id, start, end, scaffold, ok): each contig with the last scaffold that starts at or before it; ok where it ends inside.

    A sequence is cut into bins of ``width``: each bin's last scaffold is
    handed on over the bins, so no task sorts a whole sequence.
    """
    rows = scaffolds.select("seqid", "id", "start", "end", F.lit(0).alias("_kind")).unionByName(contigs.select("seqid", "id", "start", "end", F.lit(1).alias("_kind")))
    rows = rows.withColumn("_bin", F.floor(F.col("start") / width))
    lasts = rows.groupBy("seqid", "_bin").agg(F.max_by(F.struct("id", "end"), F.when(F.col("_kind") == 0, F.struct("start", "id"))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("seqid").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(lasts.select("seqid", "_bin", before.alias("_before")), ["seqid", "_bin"])
    by = Window.partitionBy("seqid", "_bin").orderBy("start", "_kind", "id")
    host = F.coalesce(F.last(F.when(F.col("_kind") == 0, F.struct("id", "end")), ignorenulls=True).over(by), F.col("_before"))
    placed = rows.withColumn("_host", host).where("_kind = 1")
    return placed.select("seqid", "id", "start", "end", F.col("_host.id").alias("scaffold"), F.coalesce(F.col("_host.end") >= F.col("end"), F.lit(False)).alias("ok"))


#: What a gap's note says for each gap type.
GAP_NAMES = {
    "fragment": 'gap between two sequence contigs (also called a "sequence gap")',
    "clone": " a gap between two clones that do not overlap",
    "contig": 'a gap between clone contigs (also called a "layout gap")',
    "centromere": "a gap inserted for the centromere",
    "short_arm": "a gap inserted at the start of an acrocentric chromosome",
    "heterochromatin": "a gap inserted for an especially large region of heterochromatic sequence (may also include the centromere)",
    "telomere": "a gap inserted for the telomere",
    "repeat": "an unresolvable repeat",
}


def agp_to_features(agp: DataFrame) -> DataFrame:
    """Assembly lines as features: contig, supercontig, or a remark for a gap, whose note gives its type and description ("none" for types that are not known)."""
    names = F.create_map(*[F.lit(x) for pair in GAP_NAMES.items() for x in pair])
    kind = F.when(F.col("is_gap"), "remark").when(F.col("type") == "W", "contig").otherwise("supercontig")
    note = F.when(F.col("is_gap"), F.concat(F.lit("type: "), "type", F.lit(", description: "), F.coalesce(names[F.col("gap_type")], F.lit("none"))))
    name = F.when(F.col("is_gap"), F.concat("gap_type", F.lit("_gap"))).otherwise(F.col("ident"))
    strand = F.when(F.col("orient") == "-", "-").otherwise("+")
    return agp.select(F.col("objname").alias("seqid"), kind.alias("type"), F.col("ostart").alias("start"), F.col("oend").alias("end"), strand.alias("strand"), name.alias("name"), "ident", note.alias("note"))


#: The type that a gap of each name has in a tiling path file.
GAP_TYPES = {
    "fragment": "TYPE-2", "centromere": "CENTROMERE", "telomere": "TELOMERE", "heterochromatin": "HETEROCHROMATIN",
    "short-arm": "SHORT-ARM", "repeat": "TYPE-2", "contig": "TYPE-3", "clone": "TYPE-2",
}


def agp_to_tpf(agp: DataFrame, local_ids: DataFrame, contigs: DataFrame) -> DataFrame:
    """Component lines with local ids (?) and PLUS / MINUS, gap lines with type, size and method, in order.

    Linkage, yes or no, decides a gap's type; without it a gap of known size (N)
    has the type of its name. Only N gaps have a size, and a method unless
    they are not linked. Gaps of other names than GAP_TYPES are left out.
    """
    comp = agp.where("NOT is_gap").join(local_ids, "ident", "left").join(contigs, "ident", "left")
    orient = F.when(F.col("orient") == "-", "MINUS").otherwise("PLUS")
    comp = comp.select("objname", "partnum", F.coalesce("ident", F.lit("?")).alias("accession"), F.coalesce("local_id", F.lit("?")).alias("clone"), F.coalesce("contig", F.lit("?")).alias("contig"), orient.alias("orient"))
    named = F.create_map(*[F.lit(x) for pair in GAP_TYPES.items() for x in pair])[F.col("gap_type")]
    sized = F.coalesce(F.col("type") == "N", F.lit(False))
    kind = F.when(F.col("linkage") == "yes", "TYPE-2").when(F.col("linkage") == "no", "TYPE-3").when(sized, named).otherwise("")
    size = F.when(sized, (F.col("oend") - F.col("ostart") + 1).cast("string")).otherwise("")
    method = F.when(sized & F.coalesce(F.col("linkage") != "no", F.lit(True)), "PAIRED ENDS").otherwise("")
    gaps = agp.where("is_gap").where(named.isNotNull()).select("objname", "partnum", F.lit("GAP").alias("accession"), kind.alias("clone"), size.alias("contig"), method.alias("orient"))
    return comp.unionByName(gaps)


def tiling_groups(tiles: DataFrame, width: int = 100_000) -> DataFrame:
    """(ref, start, end, tiles): tiles grouped while each starts before the end of the tile before; a group ends where its last tile does.

    A reference is cut into bins of ``width``; the last tile's end and the
    number of groups so far are handed on over the bins, so no task sorts a
    whole reference.
    """
    rows = tiles.withColumn("_bin", F.floor(F.col("start") / width))
    place = F.struct("start", "end", "id")
    over = Window.partitionBy("ref").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("ref", "_bin").agg(F.max_by("end", place).alias("_top"))
    rows = rows.join(tops.select("ref", "_bin", F.last("_top").over(over).alias("_before")), ["ref", "_bin"])
    by = Window.partitionBy("ref", "_bin").orderBy("start", "end", "id")
    marked = rows.withColumn("_new", F.when(F.col("start") < F.coalesce(F.lag("end").over(by), "_before"), 0).otherwise(1))
    counts = marked.groupBy("ref", "_bin").agg(F.sum("_new").alias("_n"))
    marked = marked.join(counts.select("ref", "_bin", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base")), ["ref", "_bin"])
    marked = marked.withColumn("_g", F.col("_base") + F.sum("_new").over(by))
    return marked.groupBy("ref", "_g").agg(F.min("start").alias("start"), F.max_by("end", place).alias("end"), F.count("*").alias("tiles")).drop("_g")


def tpf_index(tpf: DataFrame, ids: DataFrame) -> DataFrame:
    """I8: (accession, ord): the first line of each wanted accession; null where there is none."""
    first = tpf.join(ids.select("accession").distinct(), "accession", "left_semi").groupBy("accession").agg(F.min("ord").alias("ord"))
    return ids.select("accession").distinct().join(first, "accession", "left")


def _tpf_ends(tpf: DataFrame, first: str, last: str) -> DataFrame:
    """One row (lo, hi), null unless both lines are there and in order."""
    at = lambda name: F.min(F.when(F.col("accession") == name, F.col("ord")))
    ends = tpf.where(F.col("accession").isin(first, last)).agg(at(first).alias("lo"), at(last).alias("hi"))
    usable = F.col("lo") <= F.col("hi")
    return ends.select(F.when(usable, F.col("lo")).alias("lo"), F.when(usable, F.col("hi")).alias("hi"))


def tpf_interval(tpf: DataFrame, first: str, last: str) -> DataFrame:
    """I8: the lines from one accession to another, both included; none where an end is missing or they are out of order."""
    return tpf.crossJoin(F.broadcast(_tpf_ends(tpf, first, last))).where("ord BETWEEN lo AND hi").select(*tpf.columns)


def tpf_splice(tpf: DataFrame, first: str, last: str, new: DataFrame) -> DataFrame:
    """I8: the lines between accessions ``first`` and ``last``, which stay, replaced by ``new`` (same columns); ``ord`` renumbered.

    Nothing changes where an end is missing or they are out of order.
    """
    ends = F.broadcast(_tpf_ends(tpf, first, last))  # one row
    size = F.broadcast(new.agg(F.count("*").alias("n"), F.min("ord").alias("base")))  # one row
    kept = tpf.crossJoin(ends).crossJoin(size).where("lo IS NULL OR ord <= lo OR ord >= hi OR lo = hi")
    gone = F.greatest(F.col("hi") - F.col("lo") - 1, F.lit(0))
    moved = F.when((F.col("ord") > F.col("lo")) & F.col("lo").isNotNull(), F.col("ord") - gone + F.col("n")).otherwise(F.col("ord"))
    added = new.crossJoin(size).crossJoin(ends).where("lo IS NOT NULL").withColumn("ord", F.col("lo") + 1 + F.col("ord") - F.col("base"))
    return kept.withColumn("ord", moved).select(*tpf.columns).unionByName(added.select(*tpf.columns))


#: Fixed value: the length that a gap of unknown size is given.
UNKNOWN_GAP = 100


def place_bacs(hits: DataFrame, agp: DataFrame, tpf: DataFrame, id_map: DataFrame | None = None) -> DataFrame:
    """(objname, start, end, type, ident, cstart, cend, orient, status): the lines of each chromosome with BACs sorted in.

    ``hits`` has bac_id, scaffold, bac_start, length, s_start, s_end; ``tpf``
    ident, scaffold, ord; ``id_map`` old (an id without its chromosome
    prefix), new. A BAC lies where its scaffold's first contig starts plus its
    own place; one on an unknown scaffold is left out. Contigs and gaps inside
    a BAC go. A line that ends before the farthest line so far is CONTAINED in
    it, one that only starts before its end is its CONTAINED TURNOUT, where
    either is a BAC. A BAC's orientation is that of the contigs on both sides,
    or of one where the other side has none or begins with an unknown gap,
    turned when the hit is reversed, else ERROR. Unknown gaps become
    UNKNOWN_GAP long and what follows is shifted. Lines of one chromosome are
    sorted together: an assembly has few.
    """
    if id_map is not None:
        key = F.regexp_replace("bac_id", r"^\D\d\d", "")
        hits = hits.withColumn("_k", key).join(id_map.select(F.col("old").alias("_k"), "new"), "_k", "left").withColumn("bac_id", F.coalesce("new", "bac_id")).drop("_k", "new")
    bare = F.regexp_replace("ident", r"\.\d+$", "")
    lines = agp.select("objname", F.col("ostart").alias("start"), F.col("oend").alias("end"), "type", bare.alias("ident"), "cstart", "cend", "orient")
    first = tpf.join(lines.select("ident", "objname", "start"), "ident").groupBy("scaffold").agg(F.min_by(F.struct("objname", "start"), F.struct("ord", "ident")).alias("f"))
    j = hits.join(first, "scaffold")
    low, high = F.least("s_start", "s_end"), F.greatest("s_start", "s_end")
    bacs = j.select(
        F.col("f.objname").alias("objname"), (low + F.col("f.start") - 1).alias("start"), (high + F.col("f.start") - 1).alias("end"), F.lit("O").alias("type"), F.col("bac_id").alias("ident"),
        F.col("bac_start").alias("cstart"), (F.col("length") + F.col("bac_start") - 1).alias("cend"), F.when(F.col("s_end") < F.col("s_start"), "REV").otherwise("").alias("orient"),
    )
    # a line lies inside a BAC when the farthest end of the BACs that start before it is beyond its own
    starts = Window.partitionBy("objname").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    both = lines.withColumn("_bac", F.lit(False)).unionByName(bacs.withColumn("_bac", F.lit(True)))
    both = both.withColumn("_reach", F.max(F.when(F.col("_bac"), F.col("end"))).over(starts))
    rows = both.where(F.col("_bac") | ~F.coalesce(F.col("_reach") > F.col("end"), F.lit(False))).drop("_bac", "_reach")
    by = Window.partitionBy("objname").orderBy("start", "end", F.coalesce("ident", F.lit("")))
    # what follows is what comes before in the opposite order: a frame up to the end would be gone through for each row
    back = Window.partitionBy("objname").orderBy(F.col("start").desc(), F.col("end").desc(), F.coalesce("ident", F.lit("")).desc())
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (by, back))
    solid = F.col("type").isin("W", "O")
    contig = F.when(F.col("type") == "W", F.col("orient"))
    rows = rows.withColumns({
        "_far": F.max(F.when(solid, F.struct("end", "ident", "type"))).over(before), "_left": F.last(contig, ignorenulls=True).over(before), "_right": F.last(contig, ignorenulls=True).over(after),
        "_prev": F.lag("type").over(by), "_next": F.lead("type").over(by),
        "_shift": F.coalesce(F.sum(F.when(F.col("type") == "U", UNKNOWN_GAP - (F.col("end") - F.col("start") + 1)).otherwise(0)).over(before), F.lit(0)),
    })
    bac = F.col("type") == "O"
    mixed = solid & (bac | (F.col("_far.type") == "O"))
    status = F.when(mixed & (F.col("_far.end") > F.col("end")), F.concat(F.lit("CONTAINED\t"), "_far.ident")).when(mixed & (F.col("_far.end") > F.col("start")), F.concat(F.lit("CONTAINED TURNOUT\t"), "_far.ident"))
    side = (
        F.when(F.col("_left") == F.col("_right"), F.col("_left")).when(F.col("_right").isNull() | (F.col("_next") == "U"), F.col("_left")).when(F.col("_left").isNull() | (F.col("_prev") == "U"), F.col("_right"))
    )
    turned = F.when(F.col("orient") != "REV", side).when(side == "+", "-").when(side == "-", "+")
    orient = F.when(bac, F.coalesce(turned, F.lit("ERROR"))).otherwise(F.col("orient"))
    end = F.when(F.col("type") == "U", F.col("start") + UNKNOWN_GAP - 1).otherwise(F.col("end"))
    return rows.select("objname", (F.col("start") + F.col("_shift")).alias("start"), (end + F.col("_shift")).alias("end"), "type", "ident", "cstart", "cend", orient.alias("orient"), status.alias("status"))


def lift_to_object(places: DataFrame, agp: DataFrame) -> DataFrame:
    """Component places (ident, start, end) in object coordinates, by orientation."""
    comp = agp.where("NOT is_gap").select("objname", "ostart", "oend", "cstart", "cend", "orient", "ident")
    j = places.join(comp, "ident").where("start >= cstart AND end <= cend")
    minus = F.col("orient") == "-"
    start = F.when(minus, F.col("oend") - (F.col("end") - F.col("cstart"))).otherwise(F.col("ostart") + F.col("start") - F.col("cstart"))
    end = F.when(minus, F.col("oend") - (F.col("start") - F.col("cstart"))).otherwise(F.col("ostart") + F.col("end") - F.col("cstart"))
    return j.select(*[F.col(c) for c in places.columns if c not in ("start", "end")], "objname", F.col("start").alias("cstart"), F.col("end").alias("cend"), start.alias("start"), end.alias("end"))


def split_component(agp: DataFrame, regions: DataFrame, width: int = 100_000) -> DataFrame:
    """(objname, ostart, oend, is_gap, type, gap_type, linkage, ident, cstart, cend, orient): components cut around masked object ranges (objname, mstart, mend).

    A range is cut out as a linked fragment gap of unknown size. In the
    component's own direction, what lies before it gets the suffix a and keeps
    its first place, what lies behind it gets the suffix b and is counted from
    1; a further range cuts the part with b again. Ranges that touch count as
    one; empty parts are dropped.
    """
    masks = merge_ranges(regions.select("objname", F.col("mstart").alias("start"), F.col("mend").alias("end")), ["objname"], adjoin=1)
    rows = agp.select("*", F.monotonically_increasing_id().alias("_row"))
    lines = rows.where("NOT is_gap").select(F.col("objname").alias("ref"), F.col("ostart").alias("start"), F.col("oend").alias("end"), "_row")
    met = overlap_join(lines, masks.withColumnRenamed("objname", "ref"), "closed", width)
    cuts = met.groupBy(F.col("_row_a").alias("_row")).agg(F.sort_array(F.collect_list(F.struct(F.greatest("start_a", "start_b").alias("s"), F.least("end_a", "end_b").alias("e")))).alias("_m"))
    j = rows.join(cuts, "_row", "left").withColumn("_n", F.coalesce(F.size("_m"), F.lit(0)))
    minus = F.col("orient") == "-"

    def part(i: Column) -> Column:
        """The i-th of _n + 1 parts along the object."""
        begin = F.when(i == 0, F.col("ostart")).otherwise(F.get("_m", i - 1)["e"] + 1)
        end = F.when(i == F.col("_n"), F.col("oend")).otherwise(F.get("_m", i)["s"] - 1)
        k = F.when(minus, F.col("_n") - i).otherwise(i)  # its place along the component
        suffix = F.concat(F.repeat(F.lit("b"), k), F.when(k < F.col("_n"), "a").otherwise(""))
        return F.struct(begin.alias("s"), end.alias("e"), F.lit(False).alias("gap"), F.concat("ident", suffix).alias("ident"), F.when(k == 0, F.col("cstart")).otherwise(1).alias("c"))

    none = F.lit(None)
    gap = lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit(True).alias("gap"), none.cast("string").alias("ident"), none.cast("long").alias("c"))
    pieces = F.concat(F.transform(F.sequence(F.lit(0), F.col("_n")), part), F.transform("_m", gap))
    cut = j.where("_n > 0").select("objname", "type", "orient", F.explode(pieces).alias("p")).where("p.s <= p.e")
    of_gap = lambda text: F.when(F.col("p.gap"), text)
    cut = cut.select(
        "objname", F.col("p.s").alias("ostart"), F.col("p.e").alias("oend"), F.col("p.gap").alias("is_gap"), of_gap("U").otherwise(F.col("type")).alias("type"), of_gap("fragment").alias("gap_type"), of_gap("yes").alias("linkage"),
        F.col("p.ident").alias("ident"), F.col("p.c").alias("cstart"), (F.col("p.c") + F.col("p.e") - F.col("p.s")).alias("cend"), F.when(~F.col("p.gap"), F.col("orient")).alias("orient"),
    )
    return j.where("_n = 0").select(*cut.columns).unionByName(cut)


def compose_trims(passes: DataFrame) -> DataFrame:
    """(id, start, end, passes) of successive trims (id, pass, start, end), each in the coordinates of the one before."""
    ordered = F.array_sort(F.collect_list(F.struct("pass", "start", "end")))
    zero = F.struct(F.lit(1).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    fold = lambda acc, x: F.struct((acc["start"] + x["start"] - 1).cast("long").alias("start"), (acc["start"] + x["end"] - 1).cast("long").alias("end"))
    done = passes.groupBy("id").agg(ordered.alias("_p")).withColumn("_t", F.aggregate("_p", zero, fold))
    return done.select("id", F.col("_t.start").alias("start"), F.col("_t.end").alias("end"), F.size("_p").alias("passes"))


def trim_tags(passes: DataFrame, tags: DataFrame, last: int) -> DataFrame:
    """(id, pass, tag, start, end, removed): tags (id, pass, tag, start, end) of any pass in the coordinates of the untrimmed sequence.

    Places count in the sequence as it was at the tag's pass, so the starts of
    the passes before it are added. ``removed`` marks ids without a pass
    ``last``: they were lost on the way.
    """
    by = Window.partitionBy("id").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)
    shifts = passes.select("id", "pass", F.coalesce(F.sum(F.col("start") - 1).over(by), F.lit(0)).alias("_by"))
    here = passes.where(F.col("pass") == last).select("id").distinct().withColumn("_here", F.lit(True))
    j = tags.join(shifts, ["id", "pass"]).join(here, "id", "left")
    return j.select("id", "pass", "tag", (F.col("start") + F.col("_by")).alias("start"), (F.col("end") + F.col("_by")).alias("end"), F.col("_here").isNull().alias("removed"))


def convert_coords(df: DataFrame, source: str, target: str) -> DataFrame:
    """(first, second) between 0/L, 1/L, 0/E, 1/E (origin / length or end) by way of 1-based closed; round trips hold."""
    base, form = source.split("/")
    start = F.col("first") + (1 - int(base))
    end = start + F.col("second") - 1 if form == "L" else F.col("second") + (1 - int(base))
    base, form = target.split("/")
    second = end - start + 1 if form == "L" else end - (1 - int(base))
    return df.withColumns({"first": start - (1 - int(base)), "second": second})
