"""Variants, genotypes and pedigrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snp_reads(snps: DataFrame, ace_rows: DataFrame, width: int = 1000) -> DataFrame:
    """V1: (contig_id, pos, read_id, strain, base) of every read that covers a SNP; reads have start, end, seq on the contig.

    Reads are cut into bins of ``width``, so a SNP meets only the reads of its
    bin, by an equality join, however long its contig is.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    reads = ace_rows.where("start <= end").withColumn("_bin", bins)
    j = snps.select("contig_id", "pos", F.floor(F.col("pos") / width).alias("_bin")).join(reads, ["contig_id", "_bin"]).where("pos BETWEEN start AND end")
    return j.select("contig_id", "pos", "read_id", "strain", F.expr("substring(seq, cast(pos - start + 1 as int), 1)").alias("base"))


def snp_by_strain(reads: DataFrame) -> DataFrame:
    """V2: (contig_id, pos, strain, alleles) as '{A}x3+{T}x1', alleles in order."""
    n = reads.groupBy("contig_id", "pos", "strain", "base").agg(F.count("*").alias("n"))
    text = F.concat(F.lit("{"), "base", F.lit("}x"), F.col("n").cast("string"))
    return n.groupBy("contig_id", "pos", "strain").agg(F.array_join(F.array_sort(F.collect_list(text)), "+").alias("alleles"))


def snp_similarity(reads: DataFrame, refs: list[str], target: str) -> DataFrame:
    """V3: (contig_id, reference, same, different, total) over SNPs seen in the target and all references; alleles are the sets of bases."""
    sets = reads.groupBy("contig_id", "pos", "strain").agg(F.array_sort(F.collect_set("base")).alias("s"))
    full = sets.where(F.col("strain").isin([*refs, target])).groupBy("contig_id", "pos").agg(F.count("*").alias("n")).where(F.col("n") == len(set(refs)) + 1).select("contig_id", "pos")
    sets = sets.join(full, ["contig_id", "pos"])
    t = sets.where(F.col("strain") == target).select("contig_id", "pos", F.col("s").alias("t"))
    j = sets.where(F.col("strain").isin(refs)).join(t, ["contig_id", "pos"])
    return j.groupBy("contig_id", F.col("strain").alias("reference")).agg(F.count_if(F.col("s") == F.col("t")).alias("same"), F.count_if(F.col("s") != F.col("t")).alias("different"), F.count("*").alias("total"))


def filter_genotypes(variants: DataFrame, pattern: dict[str, str], ploidy: int = 2) -> DataFrame:
    """V4: variants that fit: S=AA drops homozygous S, S=AB heterozygous S; strains whose patterns share a letter are dropped when equal.

    ``genotypes`` is text 'S1=AA,S2=AB'. Zygosity is a rule for diploids only;
    with another ``ploidy`` the comparison between strains alone holds.
    """
    calls = F.str_to_map("genotypes", F.lit(","), F.lit("="))
    hom = lambda c: F.substring(c, 1, 1) == F.substring(c, 2, 1)
    keep = F.lit(True)
    names = sorted(pattern)
    for s in names:
        call = F.element_at(calls, s)
        same = pattern[s][0] == pattern[s][-1] and len(pattern[s]) > 1
        if len(pattern[s]) > 1 and ploidy == 2:
            keep = keep & F.coalesce(~hom(call) if same else hom(call), F.lit(True))
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if set(pattern[a]) & set(pattern[b]):
                keep = keep & F.coalesce(F.element_at(calls, a) != F.element_at(calls, b), F.lit(True))
    return variants.where(keep)


def significant(x: Column, digits: int = 3) -> Column:
    """``x`` rounded to significant digits, 0 for 0."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def variant_density(variants: DataFrame, seqs: DataFrame) -> DataFrame:
    """V5: (id, length, gc, changes, snps, indels, changes_per_100, ...) per sequence, those without variants too."""
    indel = F.col("alleles").contains("*")
    n = variants.groupBy("seq_id").agg(F.count("*").alias("changes"), F.count_if(~indel).alias("snps"), F.count_if(indel).alias("indels"))
    j = seqs.where(F.length("seq") > 0).join(n, seqs["id"] == n["seq_id"], "left")
    gc = F.length(F.regexp_replace(F.upper("seq"), "[^GC]", ""))
    cols = {c: F.coalesce(c, F.lit(0)) for c in ("changes", "snps", "indels")}
    return j.select("id", F.length("seq").alias("length"), significant(100 * gc / F.length("seq")).alias("gc"), *[v.alias(c) for c, v in cols.items()], *[significant(100 * v / F.length("seq")).alias(f"{c}_per_100") for c, v in cols.items()])


def allele_spectrum(variants: DataFrame) -> DataFrame:
    """V6: (alleles, n) by sorted allele set."""
    return variants.groupBy(F.array_join(F.array_sort(F.split("alleles", ",")), "").alias("alleles")).agg(F.count("*").alias("n"))


def base_totals(seqs: DataFrame) -> DataFrame:
    """V6: (base, n): how often each base stands in all sequences, upper case; sums are made where the rows lie."""
    bases = "ACGTN"
    text = F.upper("seq")
    sums = seqs.agg(*[F.coalesce(F.sum(F.length("seq") - F.length(F.replace(text, F.lit(b)))), F.lit(0)).alias(b) for b in bases])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("n")) for b in bases])).alias("x")).select("x.*")


def genotype_json(genotypes: DataFrame) -> DataFrame:
    """V7: (accession, genotype): one JSON object marker -> call, calls outside 0, 1, 2 as NA; of repeated markers the first line."""
    once = genotypes.groupBy("accession", "marker").agg(F.min_by("call", "line_no").alias("call"))
    call = F.when(F.col("call").isin("0", "1", "2"), F.col("call")).otherwise("NA")
    return once.groupBy("accession").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("marker", call.alias("call")))))).alias("genotype"))


def match_accessions(accessions: DataFrame, stocks: DataFrame, synonyms: DataFrame) -> DataFrame:
    """V7: (accession, stock_id, status): by lower-case name or synonym; found, missing, or ambiguous."""
    keys = stocks.select(F.lower("name").alias("k"), "stock_id").union(synonyms.select(F.lower("synonym"), "stock_id")).distinct()
    per = keys.groupBy("k").agg(F.count("*").alias("n"), F.min("stock_id").alias("stock_id"))
    j = accessions.join(per, F.lower("accession") == F.col("k"), "left")
    return j.select("accession", F.when(F.col("n") == 1, F.col("stock_id")).alias("stock_id"), F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found").alias("status"))


def pedigree_parents(pedigrees: DataFrame) -> DataFrame:
    """V8: (accession, female, male, cross) from 'A/B': '.' as male is a selfing, '?' or nothing unknown; splits at the longest slash run."""
    text = F.trim("pedigree")
    depth = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(/+)"), F.lit(1)), F.length))
    cut = F.when(depth.isNull(), F.array(text)).otherwise(F.split(text, F.lit("(?<!/)/{3}(?!/)")))
    for n in (2, 1):
        cut = F.when(depth == n, F.split(text, f"(?<!/)/{{{n}}}(?!/)")).otherwise(cut)
    female, male = F.get(cut, F.lit(0)), F.get(cut, F.lit(1))
    known = lambda c: F.when(F.trim(c).isin("?", ""), None).otherwise(F.trim(c))
    selfed = F.trim(male) == "."
    cross = F.when(selfed, "self").when(known(male).isNull(), "open").otherwise("biparental")
    return pedigrees.select("accession", known(female).alias("female"), F.when(selfed, known(female)).otherwise(known(male)).alias("male"), cross.alias("cross"))


def missing_accessions(pedigrees: DataFrame, stocks: DataFrame) -> DataFrame:
    """V9: (name) at the leaves of pedigrees, and accessions, that the stock table does not have."""
    leaves = pedigrees.select(F.explode(F.split("pedigree", "/+")).alias("name")).select(F.trim("name").alias("name"))
    names = leaves.union(pedigrees.select("accession")).where("name IS NOT NULL AND name NOT IN ('', '.', '?')").distinct()
    return names.join(stocks.select("name"), "name", "left_anti")
