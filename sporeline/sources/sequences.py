"""Sequence files: FASTA, QUAL, FASTQ, and records of other sequence formats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, value): one row a record of a text whose records start after ``separator``; readers split files at it."""
    return spark.read.text(path, lineSep=separator).select(F.input_file_name().alias("file"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines with their place in the whole input, files by name, from 0.

    A line is numbered by its place in its file block and the sizes of the
    blocks before it; blocks are few, and lines stay where they are read.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    blocks = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = F.sum("_n").over(Window.orderBy("file", "_block")) - F.col("_n")  # one row a block
    blocks = blocks.select("file", "_block", "_low", before.alias("_before"))
    return lines.join(blocks, ["file", "_block"]).select("file", (F.col("_before") + F.col("_at") - F.col("_low")).alias("line_no"), "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, descr, seq): id is the first token after '>', descr the rest of the line, white space in sequences dropped."""
    rows = records(spark, path, "\n>").where(F.length(F.trim("value")) > 0)
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "^>|\r$", "")
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("descr"), F.regexp_replace(body, r"\s", "").alias("seq"))


def fasta_text(seqs: DataFrame, width: int = 60) -> DataFrame:
    """One text value a record, sequences wrapped at ``width``."""
    head = F.concat(F.lit(">"), F.concat_ws(" ", "id", F.when(F.col("descr") != "", F.col("descr"))))
    lines = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), "\n$", "")
    return seqs.select("*", F.concat_ws("\n", head, lines).alias("value"))


def write_fasta(seqs: DataFrame, path: str, width: int = 60, by: str | None = None) -> None:
    """One folder of text files, or one a value of ``by``."""
    text = fasta_text(seqs, width)
    if by is None:
        text.select("value").write.mode("overwrite").text(path)
    else:
        text.select("value", by).write.mode("overwrite").partitionBy(by).text(path)


def read_qual(spark: SparkSession, path: str) -> DataFrame:
    """S3: (id, qual array<int>)."""
    rows = records(spark, path, "\n>").where(F.length(F.trim("value")) > 0)
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "^>", "")
    body = F.trim(F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), r"\s+", " "))
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.when(body == "", F.array().cast("array<int>")).otherwise(F.split(body, " ").cast("array<int>")).alias("qual"))


#: Offset of a quality character by platform.
OFFSETS = {"sanger": 33, "illumina": 64, "solexa": 64}


def decode_quality(text: Column, variant: str = "sanger") -> Column:
    """Characters to qualities; the solexa scale is turned to phred: 10 * log10(10 ** (q / 10) + 1)."""
    raw = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - OFFSETS[variant])
    if variant != "solexa":
        return raw
    return F.transform(raw, lambda q: F.round(10 * F.log10(F.pow(F.lit(10.0), q / 10) + 1)).cast("int"))


def encode_quality(qual: Column, variant: str = "sanger") -> Column:
    return F.array_join(F.transform(qual, lambda q: F.char(q + OFFSETS[variant])), "")


def read_fastq(spark: SparkSession, path: str, variant: str = "sanger") -> DataFrame:
    """S3: (id, descr, seq, qual) from groups of four lines by line number; '@' is a quality character too."""
    lines = numbered_lines(spark, path)
    first = lines.groupBy("file").agg(F.min("line_no").alias("base"))
    groups = lines.join(first, "file").withColumn("n", F.col("line_no") - F.col("base"))
    part = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("value")))
    rows = groups.groupBy("file", F.floor(F.col("n") / 4).alias("g")).agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("q")).where("q IS NOT NULL")
    head = F.regexp_replace("head", "^@", "")
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("descr"), "seq", decode_quality(F.col("q"), variant).alias("qual"))


def write_fastq(reads: DataFrame, path: str, variant: str = "sanger", default: int = 15) -> None:
    """S3: four lines a read; a read without quality gets the fixed ``default`` at every base."""
    reads = reads.withColumn("qual", F.coalesce("qual", F.array_repeat(F.lit(default), F.length("seq"))))
    head = F.concat(F.lit("@"), F.concat_ws(" ", "id", F.when(F.col("descr") != "", F.col("descr"))))
    reads.select(F.concat_ws("\n", head, "seq", F.lit("+"), encode_quality(F.col("qual"), variant)).alias("value")).write.mode("overwrite").text(path)


def fasta_qual_to_fastq(seqs: DataFrame, quals: DataFrame, default: int = 15) -> DataFrame:
    """Reads with qualities joined by id, a fixed quality where there is none."""
    j = seqs.join(quals, "id", "left")
    return j.withColumn("qual", F.coalesce("qual", F.array_repeat(F.lit(default), F.length("seq")))).select("id", "descr", "seq", "qual")


def read_ace(spark: SparkSession, path: str) -> DataFrame:
    """(contig_id, read_id, orient, start, end, q_begin, q_end, a_begin, a_end, seq): a row a read of a contig block."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["value"]:
                lines = text.split("\n")
                contig, places, reads, at = lines[0].removeprefix("CO ").split()[0], {}, [], None
                for line in lines[1:]:
                    word = line.split()
                    if line.startswith("AF "):
                        places[word[1]] = (word[2], int(word[3]))
                    elif line.startswith("RD "):
                        at = [word[1], [], (None,) * 4]
                        reads.append(at)
                    elif line.startswith("QA ") and at:
                        at[2] = tuple(map(int, word[1:5]))
                        at = None
                    elif at and word:
                        at[1].append(word[0])
                for name, parts, trims in reads:
                    orient, start = places.get(name, (None, None))
                    seq = "".join(parts)
                    rows.append((contig, name, orient, start, None if start is None else start + len(seq) - 1, *trims, seq))
            yield pd.DataFrame(rows, columns=["contig_id", "read_id", "orient", "start", "end", "q_begin", "q_end", "a_begin", "a_end", "seq"], dtype=object)

    schema = "contig_id string, read_id string, orient string, start long, end long, q_begin long, q_end long, a_begin long, a_end long, seq string"
    return records(spark, path, "\nCO ").where(~F.col("value").startswith("AS ")).select("value").mapInPandas(blocks, schema)


def read_maf_assembly(spark: SparkSession, path: str, unpad: bool = False) -> DataFrame:
    """(contig_id, contig_seq, contig_qual, read_id, seq, qual) from CO / CS / CQ and RD / RS / RQ lines; unpadded without '*' and quality 1."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["value"]:
                contig, reads = {"CO": None, "CS": "", "CQ": ""}, []
                for i, line in enumerate(text.split("\n")):
                    tag, _, rest = (("CO\t" + line) if i == 0 and not line.startswith("CO\t") else line).partition("\t")
                    if tag in contig:
                        contig[tag] = rest.strip()
                    elif tag == "RD":
                        reads.append({"RD": rest.strip(), "RS": "", "RQ": ""})
                    elif tag in ("RS", "RQ") and reads:
                        reads[-1][tag] = rest.strip()
                rows += [(contig["CO"], contig["CS"], contig["CQ"], r["RD"], r["RS"], r["RQ"]) for r in reads]
            yield pd.DataFrame(rows, columns=["contig_id", "contig_seq", "cq", "read_id", "seq", "rq"], dtype=object)

    rows = records(spark, path, "\nCO\t").where(F.length(F.trim("value")) > 0).select("value").mapInPandas(blocks, "contig_id string, contig_seq string, cq string, read_id string, seq string, rq string")
    rows = rows.select("contig_id", "contig_seq", decode_quality(F.col("cq")).alias("contig_qual"), "read_id", "seq", decode_quality(F.col("rq")).alias("qual"))
    if not unpad:
        return rows
    for seq, qual in (("contig_seq", "contig_qual"), ("seq", "qual")):
        rows = rows.withColumns({seq: F.regexp_replace(seq, r"\*", ""), qual: F.filter(qual, lambda q: q != 1)})
    return rows


def read_uniprot_flat(spark: SparkSession, path: str, fields: list[str], species: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """Distinct (id, key, value) of tag lines; a field 'DR=GO' takes lines of tag DR that start with GO."""
    entries = records(spark, path, "\n//\n").where(F.length(F.trim("value")) > 0).withColumn("id", F.regexp_extract("value", r"(?m)^ID\s+(\S+)", 1))
    if species is not None:
        entries = entries.where(F.regexp_extract("value", r"(?m)^OS\s+(.*)$", 1).contains(species))
    if ids is not None:
        entries = entries.where(F.col("id").isin(ids))
    lines = entries.select("id", F.explode(F.split("value", "\n")).alias("line")).select("id", F.substring("line", 1, 2).alias("tag"), F.trim(F.expr("substring(line, 6)")).alias("text"))
    hit = None
    for field in fields:
        tag, _, sub = field.partition("=")
        test = F.col("tag") == tag
        if sub:
            test = test & F.col("text").rlike("^(" + "|".join(sub.split(";")) + ")")
        hit = test if hit is None else hit | test
    return lines.where(hit).select("id", F.col("tag").alias("key"), F.col("text").alias("value")).distinct()


def read_frg(spark: SparkSession, path: str, exclude: DataFrame | None = None, edits: DataFrame | None = None) -> DataFrame:
    """(id, tag, value) of {FRG messages}; without excluded ids, with values of (id, tag, value) edits put in."""
    rows = records(spark, path, "\n}").where(F.col("value").contains("{FRG")).withColumn("id", F.regexp_extract("value", r"(?m)^acc:(\S+)", 1))
    multi = F.regexp_extract_all("value", F.lit(r"(?m)^([a-z]{3}:(?:\n[^.]*\n\.|[^\n]*))"), F.lit(1))
    tags = rows.select("id", F.explode(multi).alias("m")).select("id", F.substring("m", 1, 3).alias("tag"), F.regexp_replace(F.expr("substring(m, 5)"), r"\n\.?", "").alias("value"))
    if exclude is not None:
        tags = tags.join(exclude.select("id"), "id", "left_anti")
    if edits is not None:
        tags = tags.join(edits.withColumnRenamed("value", "_new"), ["id", "tag"], "left").withColumn("value", F.coalesce("_new", "value")).drop("_new")
    return tags.select("id", "tag", "value")


def read_deflines(spark: SparkSession, path: str) -> DataFrame:
    """(subject_id, description) from four styles of definition line; the first line of an id wins."""
    lines = numbered_lines(spark, path).where(F.col("value").startswith(">")).withColumn("v", F.expr("substring(value, 2)"))
    bare = F.regexp_replace("v", r"^(gnl\|BL_ORD_ID\|\d+\s+|lcl\|)", "")
    ident = F.when(F.col("v").startswith("gi|"), F.regexp_extract("v", r"^gi\|\d+\|[^|]*\|([^|\s]+)", 1)).otherwise(F.regexp_extract(bare, r"^(\S+)", 1))
    text = F.trim(F.regexp_replace(F.when(F.col("v").startswith("gi|"), F.col("v")).otherwise(bare), r"^\S+", ""))
    return lines.select(ident.alias("subject_id"), text.alias("description"), "line_no").groupBy("subject_id").agg(F.min_by("description", "line_no").alias("description"))


def read_dbest(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, accession, clone, library, organism, seq, sections) from labelled blocks.

    ``sections`` holds the whole entry: each section's name and its labels
    with their values, in order; a line without a label goes on from the one
    before it.
    """
    rows = records(spark, path, "\nIDENTIFIERS").where(F.col("value").contains("dbEST Id"))
    label = lambda n: F.trim(F.regexp_extract("value", rf"(?m)^{n}:[ \t]*(.*)$", 1))
    seq = F.regexp_replace(F.regexp_extract("value", r"(?s)\nSEQUENCE\s*\n(.*?)(?:\n[A-Z]|\|\||$)", 1), r"\s", "")
    return rows.select(label("dbEST Id").alias("id"), label("EST name").alias("name"), label("GenBank Acc").alias("accession"), label("Clone Id").alias("clone"), label("Lib Name").alias("library"), label("Organism").alias("organism"), seq.alias("seq"), _sections(F.concat(F.lit("IDENTIFIERS"), F.regexp_replace("value", r"^IDENTIFIERS", ""))).alias("sections"))


def _sections(entry: Column) -> Column:
    """array<struct<section, labels array<struct<label, value>>>> of a labelled block; sections begin with a line of capitals."""
    parts = F.split(F.regexp_replace(entry, r"\s*\|\|\s*$", ""), r"\n(?=[A-Z][A-Z ]*[ \t]*(?:\n|$))")

    def labels(text: Column) -> Column:
        body = F.regexp_replace(text, r"^[^\n]*\n?", "")
        each = F.regexp_extract_all(body, F.lit(r"(?m)^([^:\n\s][^:\n]*:[^\n]*(?:\n[ \t]+[^:\n]*$)*)"), F.lit(1))
        return F.transform(each, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("label"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^[^:]*:", ""), r"\s+", " ")).alias("value")))

    return F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, "\n", 1)).alias("section"), labels(x).alias("labels")))
