"""Ontology terms, domains and free-text annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeline.functions.storage import materialize


def domains_to_go(domains: DataFrame, methods: list[str] | None = None, min_len: int | None = None, max_eval: float | None = None, layout: str = "long") -> DataFrame:
    """A1: distinct (id, ontology, go_id, term) of the domain rows that pass; 'wide' gives one line an id, ordered BP, MF, CC."""
    rows = domains if methods is None else domains.where(F.col("method").isin(methods))
    if min_len is not None:
        rows = rows.where(F.col("end") - F.col("start") >= min_len)
    if max_eval is not None:
        rows = rows.where(F.col("evalue") <= max_eval)
    # terms are parted by commas too, but only before the name of an ontology, for descriptions hold commas
    parted = F.regexp_replace("go", ", (Molecular Function|Biological Process|Cellular Component):", "; $1:")
    each = rows.select("id", F.explode(F.split(parted, "; ")).alias("g"))
    pattern = r"^([^:]+): (.*) \((GO:\d+)\)$"
    terms = each.where(F.col("g").rlike(pattern)).select("id", *[F.regexp_extract("g", pattern, i).alias(n) for n, i in (("ontology", 1), ("go_id", 3), ("term", 2))]).distinct()
    if layout == "long":
        return terms
    order = F.when(F.col("ontology") == "Biological Process", 0).when(F.col("ontology") == "Molecular Function", 1).otherwise(2)
    return terms.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct(order.alias("o"), "go_id"))), lambda x: x["go_id"]), ",").alias("go_ids"))


def go_distribution(reference: DataFrame, samples: DataFrame, level: int, min_n: int = 1) -> DataFrame:
    """A2: (sample, term, percent) against each sample's total over all rows; 0 where a term of the reference is absent.

    Both have term, level, n; samples also sample. The reference is the sample named 'reference'.
    """
    rows = reference.select(F.lit("reference").alias("sample"), "term", "level", "n").unionByName(samples.select("sample", "term", "level", "n"))
    totals = rows.groupBy("sample").agg(F.sum("n").alias("total"))
    kept = rows.where((F.col("level") == level) & (F.col("n") >= min_n)).groupBy("sample", "term").agg(F.sum("n").alias("n"))
    kept = materialize(kept)
    wanted = kept.where("sample = 'reference'").select("term").distinct()
    listed = totals.agg(F.collect_list(F.struct("sample", "total")).alias("all"))  # one row: the width of the report
    own = wanted.join(kept, "term").groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("sample", "n"))).alias("own"))
    j = own.crossJoin(F.broadcast(listed)).select("term", "own", F.explode("all").alias("t"))
    return j.select(F.col("t.sample").alias("sample"), "term", F.round(100 * F.coalesce(F.try_element_at("own", F.col("t.sample")), F.lit(0)) / F.col("t.total"), 4).alias("percent"))


def go_table(distribution: DataFrame, samples: list[str]) -> DataFrame:
    """A2: (term, one column a sample): the percents of ``go_distribution`` side by side."""
    return distribution.groupBy("term").pivot("sample", samples).agg(F.first("percent"))


def family_go(members: DataFrame, go: DataFrame) -> DataFrame:
    """A3: (family, go_ids, n_members): union of the members' terms, sorted."""
    j = members.join(go, "member")
    return j.groupBy("family").agg(F.array_join(F.array_sort(F.collect_set("go_id")), ",").alias("go_ids"), F.countDistinct("member").alias("n_members"))


def merge_notes(notes: DataFrame) -> DataFrame:
    """A4: (feature_id, note) of features with more than one note, joined by ', ' in note_id order."""
    per = notes.groupBy("feature_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("note_id", "note"))).alias("a"))
    return per.where("n > 1").select("feature_id", F.array_join(F.col("a.note"), ", ").alias("note"))


def parse_defline_annotations(lines: DataFrame) -> DataFrame:
    """A5: (id, alias, description), a row an alias (null where none), from '>id | Symbols: a, b | description | ...'."""
    parts = F.split("value", r"\s*\|\s*")
    ident = F.regexp_extract("value", r"^>?(\S+)", 1)
    symbols = F.regexp_extract("value", r"Symbols:\s*([^|]*)", 1)
    aliases = F.array_distinct(F.filter(F.transform(F.split(symbols, ","), lambda x: F.trim(x)), lambda x: x != ""))
    description = F.get(parts, F.when(F.get(parts, F.lit(1)).startswith("Symbols:"), 2).otherwise(1))
    return lines.select(ident.alias("id"), F.explode_outer(aliases).alias("alias"), description.alias("description"))


def add_synonyms(names: DataFrame, features: DataFrame, kind: str) -> DataFrame:
    """(name, synonym, feature_id, status): found, not found, or multiple features of the kind by name."""
    found = features.where(F.col("type") == kind).groupBy("name").agg(F.count("*").alias("n"), F.min("feature_id").alias("feature_id"))
    j = names.join(found, "name", "left")
    status = F.when(F.col("n").isNull(), "not found").when(F.col("n") > 1, "multiple").otherwise("found")
    return j.select("name", "synonym", F.when(F.col("n") == 1, F.col("feature_id")).alias("feature_id"), status.alias("status"))


def derive_polypeptides(features: DataFrame, relations: DataFrame) -> DataFrame:
    """A polypeptide row for each mRNA that has none: same place, name with mRNA replaced, parent link."""
    have = relations.where("type = 'derives_from'").select(F.col("object_id").alias("feature_id"))
    lacking = features.where("type = 'mRNA'").join(have, "feature_id", "left_anti")
    return lacking.select(F.regexp_replace("name", "mRNA", "polypeptide").alias("name"), F.lit("polypeptide").alias("type"), "seqid", "start", "end", F.col("feature_id").alias("derives_from"))
