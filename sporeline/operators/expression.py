"""Expression and composition statistics across libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeline.functions.storage import materialize


def library_counts(contig_reads: DataFrame, read_library: DataFrame) -> DataFrame:
    """(contig_id, library, n) of libraries that a contig has; a read in several libraries belongs to its first line's. A written table."""
    first = read_library.groupBy("read_id").agg(F.min_by("library", "line_no").alias("library"))
    return materialize(contig_reads.select("contig_id", "read_id").join(first, "read_id").groupBy("contig_id", "library").agg(F.count("*").alias("n")))


def library_composition(contig_reads: DataFrame, read_library: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """(contig_id, library, n, total, ppm or rpkm), zero rows included; a read in several libraries belongs to its first line's.

    Counts are made once, by an aggregation with map-side combine after an
    equality join on the read. Each contig's counts become one map, and the
    libraries, one row with all of them, give it its zeros: no grid is joined.
    """
    counts = library_counts(contig_reads, read_library)
    totals = counts.groupBy("library").agg(F.sum("n").alias("total"))
    listed = totals.agg(F.sort_array(F.collect_list(F.struct("library", "total"))).alias("all"))  # one row: the width of the report
    per = counts.groupBy("contig_id").agg(F.map_from_entries(F.collect_list(F.struct("library", "n"))).alias("own"))
    rows = per.crossJoin(F.broadcast(listed)).select("contig_id", "own", F.explode("all").alias("t"))
    rows = rows.select("contig_id", F.col("t.library").alias("library"), F.coalesce(F.try_element_at("own", F.col("t.library")), F.lit(0)).alias("n"), F.col("t.total").alias("total"))
    if lengths is None:
        return rows.withColumn("ppm", F.col("n") * 1e6 / F.col("total"))
    rows = rows.join(lengths, "contig_id")
    return rows.select("contig_id", "library", "n", "total", (F.col("n") * 1e9 / (F.col("total") * F.col("length"))).alias("rpkm"))


def stekel_r(counts: DataFrame, min_reads: int = 51, max_share: float = 0.2) -> DataFrame:
    """(contig_id, r) from a written table (contig_id, library, n), zero rows or not; null for all unless every library has ``min_reads`` and no contig takes more than ``max_share`` of one."""
    totals = counts.groupBy("library").agg(F.sum("n").alias("total"))
    composition = counts.join(totals, "library")
    size = composition.groupBy("library").agg(F.max("total").alias("t"), F.max(F.col("n") / F.col("total")).alias("share"))
    valid = size.agg(((F.min("t") >= min_reads) & (F.max("share") <= max_share)).alias("valid"))
    whole = counts.agg(F.sum("n").alias("whole"))
    sums = composition.groupBy("contig_id").agg(F.sum("n").alias("x"))
    rows = composition.where("n > 0").join(sums, "contig_id").crossJoin(F.broadcast(whole))  # one row
    part = F.col("n") * F.log10(F.col("n") / (F.col("total") * F.col("x") / F.col("whole")))
    r = rows.groupBy("contig_id").agg(F.sum(part).alias("r")).crossJoin(F.broadcast(valid))  # one row
    return r.select("contig_id", F.when(F.col("valid"), F.col("r")).alias("r"))


def strain_contigs(counts: DataFrame, lengths: DataFrame, placed: DataFrame) -> DataFrame:
    """(reference, strain, contig_id, library, n, total, rpkm, r): a row a contig and library, and one of nulls for each strain that a reference lacks.

    ``counts`` has contig_id, library, n; ``lengths`` reference, length;
    ``placed`` contig_id, reference, strain. r is ``strain_r`` of the reference.
    """
    totals = counts.groupBy("library").agg(F.sum("n").alias("total"))
    rows = materialize(counts.join(placed, "contig_id").join(lengths, "reference").join(totals, "library"))
    r = strain_r(rows)
    rpkm = F.col("n") * 1e9 / (F.col("total") * F.col("length"))
    found = rows.join(r, "reference").select("reference", "strain", "contig_id", "library", "n", "total", rpkm.alias("rpkm"), "r")
    every = rows.select("strain").distinct().agg(F.collect_set("strain").alias("every"))  # one row: the width of the report
    own = rows.groupBy("reference").agg(F.collect_set("strain").alias("own"))
    lacking = own.crossJoin(F.broadcast(every)).select("reference", F.explode(F.array_except("every", "own")).alias("strain"))
    nulls = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns[2:]]
    return found.unionByName(lacking.select("reference", "strain", *nulls))


def strain_r(rows: DataFrame) -> DataFrame:
    """(reference, r) over strains: the sum of n log10(n / (N f)), N the strain's reads and f the reference's share of all reads."""
    per = materialize(rows.groupBy("reference", "strain").agg(F.sum("n").alias("n")))
    strain = per.groupBy("strain").agg(F.sum("n").alias("strain_n"))
    reference = per.groupBy("reference").agg(F.sum("n").alias("reference_n"))
    whole = per.agg(F.sum("n").alias("whole"))  # one row
    j = per.where("n > 0").join(strain, "strain").join(reference, "reference").crossJoin(F.broadcast(whole))
    return j.groupBy("reference").agg(F.sum(F.col("n") * F.log10(F.col("n") / F.col("strain_n") / (F.col("reference_n") / F.col("whole")))).alias("r"))


def strain_expression(counts: DataFrame, lengths: DataFrame, strains: DataFrame) -> DataFrame:
    """(reference, strain, n, rpkm): counts (contig_id, library, n) through contig -> (reference, strain); null where a strain is absent.

    ``lengths`` has contig_id, length; ``strains`` contig_id, reference, strain.
    """
    totals = counts.groupBy("library").agg(F.sum("n").alias("total"))
    j = counts.join(totals, "library").join(lengths, "contig_id").join(strains, "contig_id")
    per = materialize(j.groupBy("reference", "strain").agg(F.sum("n").alias("n"), F.avg(F.col("n") * 1e9 / (F.col("total") * F.col("length"))).alias("rpkm")))
    every = strains.select("strain").distinct().agg(F.collect_set("strain").alias("every"))  # one row: the width of the report
    own = strains.select("reference", "strain").distinct().join(per, ["reference", "strain"], "left").groupBy("reference").agg(F.collect_set(F.when(F.col("n").isNotNull(), F.col("strain"))).alias("own"))
    lacking = own.crossJoin(F.broadcast(every)).select("reference", F.explode(F.array_except("every", "own")).alias("strain"))
    return per.unionByName(lacking.select("reference", "strain", F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("rpkm")))


def dominant_contigs(composition: DataFrame, share: float = 0.2) -> DataFrame:
    """(contig_id, library, share) of contigs above a share of a library."""
    return composition.withColumn("share", F.col("n") / F.col("total")).where(F.col("share") > share).select("contig_id", "library", "share")


def replicate_stats(signals: DataFrame) -> DataFrame:
    """(template, n, mean, median, sd, cv); sd and cv are null for one replicate, cv also where the mean is not above 0."""
    per = signals.groupBy("template").agg(F.count("signal").alias("n"), F.avg("signal").alias("mean"), F.percentile("signal", 0.5).alias("median"), F.stddev_samp("signal").alias("sd"))
    sd = F.when(F.col("n") > 1, F.col("sd"))
    return per.select("template", "n", "mean", "median", sd.alias("sd"), F.when(F.col("mean") > 0, sd / F.col("mean")).alias("cv"))


def read_placement(library: DataFrame, step1: DataFrame, step2: DataFrame, step3: DataFrame, alleles: DataFrame) -> DataFrame:
    """E5: each read's library, contig at three steps, allele and note; NA where missing.

    Steps map (id, contig): reads, then the contigs of the step before, whose
    names lose their ``step2_`` prefix before the third step.
    """
    j = library.join(step1.select(F.col("id").alias("read_id"), F.col("contig").alias("step1")), "read_id", "left")
    j = j.join(step2.select(F.col("id").alias("step1"), F.col("contig").alias("step2")), "step1", "left")
    j = j.withColumn("_k", F.regexp_replace("step2", "^step2_", "")).join(step3.select(F.col("id").alias("_k"), F.col("contig").alias("step3")), "_k", "left")
    j = j.join(alleles.select(F.col("contig").alias("step3"), "allele", "note"), "step3", "left")
    return j.select("read_id", *[F.coalesce(c, F.lit("NA")).alias(c) for c in ("library", "step1", "step2", "step3", "allele", "note")])
