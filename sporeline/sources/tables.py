"""Tabular and feature files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.sources.sequences import numbered_lines, records

M8 = "query_id string, subject_id string, pident double, length int, mismatches int, gaps int, q_start int, q_end int, s_start int, s_end int, evalue double, score double"


def read_m8(spark: SparkSession, path: str, described: bool = False) -> DataFrame:
    """The twelve-column hit table (thirteen with a description), '#' lines dropped; a row of another width or a bad number fails the job."""
    schema = M8 + (", description string" if described else "")
    return spark.read.csv(path, sep="\t", schema=schema, comment="#", mode="FAILFAST", ignoreLeadingWhiteSpace=True)


def url_decode(c: Column) -> Column:
    """%XX escapes to characters; '+' stands for itself in GFF3."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def url_encode(c: Column) -> Column:
    """The characters that GFF3 reserves in attributes."""
    for char, code in (("%", "%25"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), (",", "%2C"), ("\t", "%09"), ("\n", "%0A")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """Seqid, source, type, start, end, score, strand, phase, attrs map<string, array<string>>, line_no; comments and sequences left out."""
    lines = numbered_lines(spark, path).where(~F.col("value").startswith("#") & (F.size(F.split("value", "\t")) == 9))
    part = F.split("value", "\t")
    blank = lambda c: F.when(c != ".", c)
    pairs = F.filter(F.split(part[8], r"\s*;\s*"), lambda x: F.instr(x, "=") > 0)
    attrs = F.map_from_entries(
        F.transform(pairs, lambda p: F.struct(url_decode(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.transform(F.split(F.regexp_replace(p, "^[^=]*=", ""), ","), url_decode).alias("v")))
    )
    return lines.select(
        part[0].alias("seqid"), part[1].alias("source"), part[2].alias("type"), part[3].cast("long").alias("start"), part[4].cast("long").alias("end"),
        blank(part[5]).cast("double").alias("score"), part[6].alias("strand"), blank(part[7]).cast("int").alias("phase"), attrs.alias("attrs"), "line_no",
    )


def gff3_text(features: DataFrame) -> DataFrame:
    """(value): lines with attributes encoded and sorted by key."""
    entries = F.array_sort(F.map_entries("attrs"))
    attrs = F.array_join(F.transform(entries, lambda e: F.concat(url_encode(e["key"]), F.lit("="), F.array_join(F.transform(e["value"], url_encode), ","))), ";")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return features.select(F.concat_ws("\t", "seqid", "source", "type", dot("start"), dot("end"), dot("score"), dot("strand"), dot("phase"), attrs).alias("value"))


def write_gff3(features: DataFrame, path: str) -> None:
    """S6."""
    gff3_text(features.orderBy("seqid", "start")).write.mode("overwrite").text(path)


def read_agp(spark: SparkSession, path: str) -> DataFrame:
    """Objname, ostart, oend, partnum, type, is_gap, then component columns or gap columns."""
    part = F.split("value", "\t")
    rows = numbered_lines(spark, path).where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0))
    gap = part[4].isin("N", "U")
    comp = lambda i, t="string": F.when(~gap, F.get(part, F.lit(i)).cast(t))
    return rows.select(
        part[0].alias("objname"), part[1].cast("long").alias("ostart"), part[2].cast("long").alias("oend"), part[3].cast("long").alias("partnum"), part[4].alias("type"), gap.alias("is_gap"),
        comp(5).alias("ident"), comp(6, "long").alias("cstart"), comp(7, "long").alias("cend"), comp(8).alias("orient"),
        F.when(gap, part[5].cast("long")).alias("length"), F.when(gap, part[6]).alias("gap_type"), F.when(gap, F.get(part, F.lit(7))).alias("linkage"), "line_no",
    )


def read_tpf(spark: SparkSession, path: str) -> DataFrame:
    """Ord, accession, clone, contig, orient (columns of a gap line keep their places)."""
    part = F.split("value", "\t")
    rows = numbered_lines(spark, path).where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0))
    return rows.select((F.col("line_no") + 1).alias("ord"), *[F.get(part, F.lit(i)).alias(n) for i, n in enumerate(("accession", "clone", "contig", "orient"))])


def write_tpf(tpf: DataFrame, path: str) -> None:
    """Lines in order; range-sorted, so files follow each other."""
    tpf.orderBy("ord").select(F.concat_ws("\t", "accession", "clone", "contig", "orient").alias("value")).write.mode("overwrite").text(path)


def read_tab_checked(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """String columns by header; another header, or a row of another width, fails the job.

    Without a header the first row sets the width and the columns are c1, c2, ...
    """
    lines = spark.read.text(path).where(F.length("value") > 0)
    part = F.split("value", "\t")
    if header is None:
        first = lines.limit(1).collect()
        names = [f"c{i + 1}" for i in range(len(first[0]["value"].split("\t")) if first else 1)]
        body = lines
    else:
        seen = lines.where(part[0] == header[0]).limit(1).select(part.alias("h")).collect()  # the header line
        if not seen or seen[0]["h"] != header:
            raise ValueError(f"expected the header {header}, found {seen[0]['h'] if seen else None}")
        names, body = header, lines.where(F.col("value") != "\t".join(header))
    checked = F.when(F.size(part) == len(names), part).otherwise(F.raise_error(F.concat(F.lit("wrong number of columns: "), "value")))
    return body.select(checked.alias("p")).select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def read_genotype_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(accession, marker, chromosome, position, call) from a wide matrix whose first three lines are marker, chromosome and position.

    Lines are split and exploded by position, so the number of markers makes rows and not thousands of columns.
    """
    cells = numbered_lines(spark, path).where(F.length("value") > 0).select("line_no", F.posexplode(F.split("value", sep)).alias("i", "v"))
    heads = cells.where("line_no < 3 AND i > 0")
    pick = lambda n: F.max(F.when(F.col("line_no") == n, F.col("v")))
    markers = heads.groupBy("i").agg(pick(0).alias("marker"), pick(1).alias("chromosome"), pick(2).alias("position"))
    body = cells.where("line_no >= 3")
    names = body.where("i = 0").select("line_no", F.col("v").alias("accession"))
    calls = body.where("i > 0").join(markers, "i").join(names, "line_no")
    return calls.select("accession", "marker", "chromosome", F.col("position").cast("double").alias("position"), F.trim("v").alias("call"))


def read_metrics_blocks(spark: SparkSession, runs: dict[str, str]) -> DataFrame:
    """(file, metric, one column a run) of 'name = value;' lines inside 'file { ... }' blocks; NA where a run lacks it."""
    out = None
    for run, path in runs.items():
        blocks = records(spark, path, "}").select(F.regexp_extract("value", r"(?s)(\w+)\s*\{", 1).alias("file"), F.regexp_extract_all("value", F.lit(r"(\w+\s*=\s*[^;]*);"), F.lit(1)).alias("m"))
        rows = blocks.where("file <> ''").select(F.lit(run).alias("run"), "file", F.explode("m").alias("x"))
        rows = rows.select("run", "file", F.trim(F.substring_index("x", "=", 1)).alias("metric"), F.trim(F.regexp_replace("x", r'^[^=]*=|"', "")).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("file", "metric").pivot("run", list(runs)).agg(F.first("value")).fillna("NA", subset=list(runs))


def parse_signalp(spark: SparkSession, path: str) -> DataFrame:
    """(id, nn_site, hmm_site); the network's site is null unless its D score says YES, the model's unless it predicts a signal peptide; the first block of an id."""
    rows = records(spark, path, "\n>").where(F.length(F.trim("value")) > 0)
    ident = F.regexp_extract("value", r"^>?(\S+)", 1)
    nn = F.regexp_extract("value", r"Most likely cleavage site between pos\.\s+(\d+) and", 1)
    hmm = F.regexp_extract("value", r"Max cleavage site probability: [\d.]+ between pos\.\s+(\d+) and", 1)
    signal = F.col("value").contains("Prediction: Signal peptide")
    scored = F.regexp_extract("value", r"(?m)^\s+D\s+\S+\s+\S+\s+\S+\s+(\S+)", 1) == "YES"
    found = rows.select(ident.alias("id"), F.when(scored & (nn != ""), nn.cast("int")).alias("nn_site"), F.when(signal & (hmm != ""), hmm.cast("int")).alias("hmm_site"))
    return found.groupBy("id").agg(F.first("nn_site").alias("nn_site"), F.first("hmm_site").alias("hmm_site"))


def read_repeatmasker(spark: SparkSession, path: str) -> DataFrame:
    """repeat_region features with target and its ends in ascending order."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(part[0].rlike(r"^\d+$") & (F.size(part) >= 14))
    minus = part[8] == "C"
    number = lambda i: F.regexp_replace(F.get(part, F.lit(i)), r"[()]", "").cast("long")
    a, b = F.when(minus, number(13)).otherwise(number(11)), number(12)
    return rows.select(
        part[4].alias("seqid"), F.lit("repeat_region").alias("type"), part[5].cast("long").alias("start"), part[6].cast("long").alias("end"), part[0].cast("double").alias("score"),
        F.when(minus, "-").otherwise("+").alias("strand"), part[9].alias("target"), F.least(a, b).alias("t_start"), F.greatest(a, b).alias("t_end"),
    )


def pathologic_text(genes: DataFrame) -> DataFrame:
    """(seqid, value): KEY<tab>value lines of each gene, closed by '//'; ``fields`` is an array of (key, value)."""
    lines = F.array_join(F.transform(F.filter("fields", lambda f: f["value"].isNotNull()), lambda f: F.concat_ws("\t", f["key"], f["value"])), "\n")
    return genes.select("seqid", F.concat_ws("\n", lines, F.lit("//")).alias("value"))


def write_pathologic(genes: DataFrame, path: str) -> None:
    """One folder a sequence."""
    pathologic_text(genes).write.mode("overwrite").partitionBy("seqid").text(path)
