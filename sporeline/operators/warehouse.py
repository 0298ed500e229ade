"""Assembly tables and reports over the library -> clone -> read -> est -> unigene chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contig_summary(ace_rows: DataFrame) -> DataFrame:
    """(contig_id, reads, first, last, span, trimmed_end) of reads (contig_id, start, span, start_trim, end_trim).

    ``first`` and ``last`` are the ends of the reads with what was trimmed off
    them, ``span`` lies between; ``trimmed_end`` is the last end without. As in
    the reports this follows, minimum and maxima start at 0.
    """
    end = F.col("start") + F.col("span")
    per = ace_rows.groupBy("contig_id").agg(
        F.count("*").alias("reads"), F.least(F.min(F.col("start") - F.col("start_trim")), F.lit(0)).alias("first"),
        F.greatest(F.max(end + F.col("end_trim")), F.lit(0)).alias("last"), F.greatest(F.max(end), F.lit(0)).alias("trimmed_end"),
    )
    return per.withColumn("span", F.col("last") - F.col("first"))


def contig_read_list(ace_rows: DataFrame) -> DataFrame:
    """(contig_id, place, read_id, orient, start, end, start_trim, end_trim): the reads of each contig by start, places from 1; ties by id."""
    by = Window.partitionBy("contig_id").orderBy("start", "read_id")
    return ace_rows.select("contig_id", F.row_number().over(by).cast("long").alias("place"), "read_id", "orient", "start", (F.col("start") + F.col("span")).alias("end"), "start_trim", "end_trim")


def named_libraries(reads: DataFrame, pattern: str) -> DataFrame:
    """``reads`` (name, ...) with ``library``: what the pattern's first group shows in the name, in any case; null where it shows none."""
    found = F.regexp_extract("name", f"(?i){pattern}", 1)
    return reads.withColumn("library", F.when(found != "", found))


def library_mix_stats(ace_rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(libraries, contigs, contig_bases, reads, read_bases): contigs by the set of libraries present in them; reads of no library count but show none."""
    per = ace_rows.groupBy("contig_id").agg(F.array_join(F.array_sort(F.collect_set("library")), "-").alias("libraries"), F.count("*").alias("reads"), F.sum("span").alias("bases"))
    j = per.join(lengths, "contig_id", "left")
    return j.groupBy("libraries").agg(F.count("*").alias("contigs"), F.sum("length").alias("contig_bases"), F.sum("reads").alias("reads"), F.sum("bases").alias("read_bases"))


def library_reads(ace_rows: DataFrame, singletons: DataFrame) -> DataFrame:
    """(library, reads, bases): reads in contigs of each library, those 'unmatched', and the 'singletons' (read_id, span)."""
    placed = ace_rows.groupBy(F.coalesce("library", F.lit("unmatched")).alias("library")).agg(F.count("*").alias("reads"), F.sum("span").alias("bases"))
    lone = singletons.agg(F.countDistinct("read_id").alias("reads"), F.coalesce(F.sum("span"), F.lit(0)).alias("bases"))
    return placed.unionByName(lone.select(F.lit("singletons").alias("library"), "reads", "bases"))


#: Pairs of clusters that one task makes and counts.
PAIRS = 500_000


def _shared_members(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """(old_cluster, new_cluster, old_size, new_size), a row for each member that both hold, dealt by ``keys``.

    The pairs are counted from the members before they are made, so that their
    partitions grow in number and not in size. Sizes come along from the
    narrow tables, so that the pairs are neither sorted nor joined for them.
    """
    size = lambda df, name: df.groupBy("cluster_id").agg(F.count("*").alias(f"{name}_size"))
    side = lambda df, name: df.join(size(df, name), "cluster_id").select("member_id", F.col("cluster_id").alias(f"{name}_cluster"), f"{name}_size")
    times = lambda df, name: df.groupBy("member_id").agg(F.count("*").alias(name))
    made = times(old, "a").join(times(new, "b"), "member_id").agg(F.sum(F.col("a") * F.col("b"))).head()[0] or 0
    tasks = max(int(made) // PAIRS + 1, int(old.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left, right = (side(df, name).repartition(tasks, "member_id") for df, name in ((old, "old"), (new, "new")))
    return left.join(right.hint("shuffle_merge"), "member_id").drop("member_id").repartition(tasks, *keys)


def build_overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_cluster, new_cluster, shared, old_size, new_size) over clusters that share members."""
    j = _shared_members(old, new, "old_cluster", "new_cluster")
    counted = j.groupBy("old_cluster", "new_cluster").agg(F.count("*").alias("shared"), F.first("old_size").alias("old_size"), F.first("new_size").alias("new_size"))
    return counted.select("old_cluster", "new_cluster", "shared", "old_size", "new_size")


def split_clusters(overlap: DataFrame) -> DataFrame:
    """(old_cluster, parts) of old clusters found in more than one new one."""
    return overlap.groupBy("old_cluster").agg(F.count("*").alias("parts")).where("parts > 1")


def dropped_members(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows whose member is in no new cluster."""
    return old.join(new.select("member_id"), "member_id", "left_anti")


def version_map(reads: DataFrame, builds: dict[str, DataFrame]) -> DataFrame:
    """Each read with its cluster in each build, 'absent' where none; of several the least."""
    out = reads.select("read_id")
    for name, members in builds.items():
        one = members.groupBy(F.col("member_id").alias("read_id")).agg(F.min("cluster_id").cast("string").alias(name))
        out = out.join(one, "read_id", "left")
    return out.select("read_id", *[F.coalesce(n, F.lit("absent")).alias(n) for n in builds])


def membership_map(chain: list[tuple[DataFrame, str]], columns: list[str], how: str = "inner") -> DataFrame:
    """Chosen columns along a chain of tables, each joined to the one before on the named key."""
    first, *rest = chain
    return reduce(lambda acc, step: acc.join(step[0], step[1], how), rest, first[0]).select(*columns)


def unigene_dump(contigs: DataFrame, singletons: DataFrame, best_hits: DataFrame) -> DataFrame:
    """(unigene_id, seq, note): consensus, or the trimmed read of a singleton (begin 0-based, length), with the best hit's text."""
    trimmed = singletons.select("unigene_id", F.substring("seq", (F.col("begin") + 1).cast("int"), F.col("length").cast("int")).alias("seq"))
    rows = contigs.select("unigene_id", "seq").union(trimmed).distinct()
    return rows.join(best_hits.select("unigene_id", "note"), "unigene_id", "left")


def organism_report(organisms: DataFrame, libraries: DataFrame, clones: DataFrame, reads: DataFrame, ests: DataFrame) -> DataFrame:
    """(organism, libraries, clones, reads, ests): each level is counted by its own parent, then rolled up.

    Distinct counts over the joined chain would multiply rows at every level.
    """
    per_read = ests.groupBy("read_id").agg(F.count("*").alias("ests"))
    per_clone = reads.join(per_read, "read_id", "left").groupBy("clone_id").agg(F.count("*").alias("reads"), F.sum(F.coalesce("ests", F.lit(0))).alias("ests"))
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    per_library = clones.join(per_clone, "clone_id", "left").groupBy("library_id").agg(F.count("*").alias("clones"), zero("reads"), zero("ests"))
    per_organism = libraries.join(per_library, "library_id", "left").groupBy("organism_id").agg(F.count("*").alias("libraries"), zero("clones"), zero("reads"), zero("ests"))
    j = organisms.join(per_organism, "organism_id", "left")
    return j.select("organism", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("libraries", "clones", "reads", "ests")])


def build_report(members: DataFrame, cds: DataFrame, annotated: DataFrame) -> DataFrame:
    """(build, unigenes, members, contigs, min_id, max_id, annotated, cds, cds_with_domain, cds_without_domain) per build.

    ``cds`` has unigene_id, domain (boolean), a row a coding sequence;
    ``annotated`` has unigene_id. Each is counted per unigene before the join.
    """
    per = members.groupBy("build", "unigene_id").agg(F.count("*").alias("n"))
    coding = cds.groupBy("unigene_id").agg(F.count_if("domain").alias("w"), F.count_if(~F.col("domain")).alias("o"))
    j = per.join(coding, "unigene_id", "left").join(annotated.select("unigene_id").distinct().withColumn("a", F.lit(1)), "unigene_id", "left")
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return j.groupBy("build").agg(
        F.count("*").alias("unigenes"), F.sum("n").alias("members"), F.count_if(F.col("n") > 1).alias("contigs"), F.min("unigene_id").alias("min_id"), F.max("unigene_id").alias("max_id"),
        F.count("a").alias("annotated"), (zero("w") + zero("o")).alias("cds"), zero("w").alias("cds_with_domain"), zero("o").alias("cds_without_domain"),
    )


def annotated_by_target(members: DataFrame, annotated: DataFrame) -> DataFrame:
    """(build, target, unigenes): unigenes of each build that a target database annotates; ``annotated`` has unigene_id, target."""
    per = members.select("build", "unigene_id").distinct()
    return per.join(annotated.select("unigene_id", "target").distinct(), "unigene_id").groupBy("build", "target").agg(F.count("*").alias("unigenes"))


def integrity_check(levels: list[tuple[str, DataFrame, DataFrame, str]]) -> DataFrame:
    """(level, parents, childless): for (name, parents, children, key) how many parents have no child."""
    parts = []
    for name, parents, children, key in levels:
        lone = parents.join(children.select(key), key, "left_anti").agg(F.count("*").alias("childless"))
        parts.append(parents.agg(F.count("*").alias("parents")).crossJoin(lone).select(F.lit(name).alias("level"), "parents", "childless"))  # one row each
    return reduce(DataFrame.unionByName, parts)


def field_gaps(level: str, rows: DataFrame, fields: list[str]) -> DataFrame:
    """(level, field, nulls, blanks): rows of a level whose field is null, or blank text; one pass over the rows."""
    counts = []
    for f in fields:
        counts += [F.count_if(F.col(f).isNull()).alias(f"n_{f}"), F.count_if(F.trim(F.col(f).cast("string")) == "").alias(f"b_{f}")]
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("nulls"), F.col(f"b_{f}").alias("blanks")) for f in fields])
    return rows.agg(*counts).select(F.lit(level).alias("level"), F.explode(each).alias("x")).select("level", "x.*")


def status_counts(rows: DataFrame, status: str = "status", flags: str = "flags") -> DataFrame:
    """(status, flags, rows) of a level, blanks as null."""
    blank = F.when(F.trim(F.col(status)) != "", F.col(status))
    return rows.groupBy(blank.alias("status"), F.col(flags).alias("flags")).agg(F.count("*").alias("rows"))


def preferred_protein(cds: DataFrame) -> DataFrame:
    """Cds rows with ``preferred``: the longest of each unigene, the later id on ties."""
    best = cds.groupBy("unigene_id").agg(F.max_by("cds_id", F.struct("length", "cds_id")).alias("_best"))
    return cds.join(best, "unigene_id").select(*cds.columns, (F.col("cds_id") == F.col("_best")).alias("preferred"))


def map_accessions(clones: DataFrame, genbank: DataFrame) -> DataFrame:
    """(clone_id, rule, accession): the first rule that matches a clone's name: accession.version, accession, locus, primary id, library-clone, clone."""
    rules = [("accession.version", F.concat_ws(".", "accession", F.col("version").cast("string"))), ("accession", F.col("accession")), ("locus", F.col("locus")), ("primary id", F.col("primary_id").cast("string")), ("library-clone", F.concat("library", F.lit("-"), "clone")), ("clone", F.col("clone"))]
    keys = genbank.select("accession", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("rule"), k.alias("key")) for i, (n, k) in enumerate(rules)])).alias("k")).select("accession", "k.*")
    j = clones.join(keys.where("key IS NOT NULL"), clones["name"] == F.col("key"))
    return j.groupBy("clone_id").agg(F.min(F.struct("rank", "rule", "accession")).alias("m")).select("clone_id", "m.rule", "m.accession")


def rewrite_paths(files: DataFrame, column: str = "path") -> DataFrame:
    """/data prefix to /export."""
    return files.withColumn(column, F.regexp_replace(column, "^/data(?=/|$)", "/export"))


def refresh_sequences(ests: DataFrame, updates: DataFrame, keys: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(ests with new seq and qual where found by the first id kind that matches, updates that match none).

    ``updates`` has kind, id, seq, qual; ``keys`` maps a kind to the est column that holds it.
    """
    once = updates.groupBy("kind", "id").agg(F.min(F.struct("seq", "qual")).alias("u"))
    out, hit = ests, None
    for kind, key in keys.items():
        part = once.where(F.col("kind") == kind).select(F.col("id").alias(f"_{kind}"), F.col("u").alias(f"u_{kind}"))
        out = out.join(part, key == F.col(f"_{kind}"), "left")
        found = once.where(F.col("kind") == kind).join(ests.select(key.alias("id")).distinct(), "id", "left_semi").select("kind", "id")
        hit = found if hit is None else hit.unionByName(found)
    new = F.coalesce(*[F.col(f"u_{k}") for k in keys])
    fresh = out.withColumns({"seq": F.coalesce(new["seq"], "seq"), "qual": F.coalesce(new["qual"], "qual")}).select(*ests.columns)
    return fresh, updates.join(hit, ["kind", "id"], "left_anti")


def library_rollup(rows: DataFrame, least: int = 100) -> DataFrame:
    """(library, organism, accessions): libraries under ``least`` pooled into one virtual library an organism."""
    per = rows.groupBy("library", "organism").agg(F.count("*").alias("n"))
    name = F.when(F.col("n") < least, F.concat(F.lit("virtual_"), "organism")).otherwise(F.col("library"))
    return per.groupBy(name.alias("library"), "organism").agg(F.sum("n").alias("accessions"))


def map_accessions_partial(clones: DataFrame, genbank: DataFrame, least: int = 6) -> DataFrame:
    """(clone_id, accession) where one cleaned name begins or ends with the other, of ``least`` characters or more; the least accession.

    Names are reduced to lower-case letters and digits. Prefixes and suffixes
    of the longer name are keys of an equality join, so no pair is made to be
    tested; only ends as long as some name of the other side are made. Equal
    names count once, so a common name does not multiply. Ends are many more
    bytes than their table shows, so these joins are never broadcast.
    """
    clean = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    mine = clones.select("clone_id", clean(F.col("name")).alias("x")).where(F.length("x") >= least)
    theirs = genbank.select("accession", clean(F.col("clone")).alias("y")).where(F.length("y") >= least).groupBy("y").agg(F.min("accession").alias("accession"))
    names = mine.select("x").distinct()

    def ends(c: str, other: DataFrame, key: str) -> DataFrame:
        """Rows of (c, ...) with each end of ``c`` that is as long as a name of ``other``."""
        sizes = F.broadcast(other.agg(F.collect_set(F.length(key)).alias("_sizes")))  # one row, a number for each length
        cut = F.explode(F.array_distinct(F.flatten(F.transform(F.filter("_sizes", lambda n: n <= F.length(c)), lambda n: F.array(F.substring(c, F.lit(1), n), F.substring(c, F.length(c) - n + 1, n))))))
        rows = theirs if c == "y" else names
        return rows.crossJoin(sizes).select("*", cut.alias("_end")).drop("_sizes")

    inside = names.join(ends("y", names, "x").groupBy(F.col("_end").alias("x")).agg(F.min("accession").alias("accession")).hint("merge"), "x")
    around = ends("x", theirs, "y").join(theirs.hint("merge"), F.col("_end") == theirs["y"]).select("x", "accession")
    best = inside.select("x", "accession").unionByName(around).groupBy("x").agg(F.min("accession").alias("accession"))
    return mine.join(best.hint("merge"), "x").select("clone_id", "accession")
