"""Alignment hits: filters, best hits, coverage, annotation transfer, chimeras.

A hit has query_id, subject_id, pident, length, mismatches, gaps, q_start,
q_end, s_start, s_end, evalue, score, and line_no, its place in the source.
Ties are broken by the smaller line_no. Coordinates are 1-based and closed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sporeline.functions.storage import discard, materialize
from sporeline.operators import words
from sporeline.operators.graph import connected_components
from sporeline.operators.intervals import merge_ranges

COMPARE = {"<": "__lt__", "<=": "__le__", "=": "__eq__", ">=": "__ge__", ">": "__gt__"}


def filter_hits(hits: DataFrame, conds: list[tuple[str, str, float]], combine: str = "all") -> DataFrame:
    """H1: rows for which all (or any) conditions (column, comparison, value) hold."""
    tests = [getattr(F.col(c), COMPARE[op])(F.lit(v)) for c, op, v in conds]
    if not tests:
        return hits
    return hits.where(reduce(lambda a, b: (a & b) if combine == "all" else (a | b), tests))


def full_length_bac_hits(hits: DataFrame, lengths: DataFrame, slack: int = 5000) -> DataFrame:
    """H2: near-identical hits about as long as the query; ``lengths`` has query_id, query_length."""
    near = hits.where("pident >= 99.99 AND mismatches <= 5").join(lengths, "query_id")
    return near.where(F.col("length").between(F.col("query_length") - slack, F.col("query_length")))


def repeat_copy_number(hits: DataFrame, min_ident: float = 98, min_length: int = 200) -> DataFrame:
    """H3: (query_id, copies): long, near-identical hits of each query."""
    return hits.where((F.col("pident") >= min_ident) & (F.col("length") >= min_length)).groupBy("query_id").agg(F.count("*").alias("copies"))


def best_hit(hits: DataFrame, by: str = "score", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """H4: one hit a key: highest score, lowest evalue, or the first line ('first').

    One aggregation with map-side combine: each task ships a row a key, where
    a window would ship and sort every hit.
    """
    rank = {"score": [F.col("score")], "evalue": [-F.col("evalue")], "first": []}[by]
    row = F.max_by(F.struct(*hits.columns), F.struct(*rank, -F.col("line_no")))
    return hits.groupBy(*keys).agg(row.alias("_best")).select(*[F.col("_best")[c].alias(c) for c in hits.columns])


def reciprocal_best_hits(hits: DataFrame) -> DataFrame:
    """H5: (query_id, subject_id, evalue) where each is the other's lowest-evalue match."""
    forward = best_hit(hits, "evalue").select("query_id", "subject_id", "evalue")
    backward = best_hit(hits, "evalue", ("subject_id",)).select("query_id", "subject_id")
    return forward.join(backward, ["query_id", "subject_id"])


def hit_coverage(hits: DataFrame, lengths: DataFrame, min_cov: float = 75, min_ident: float = 90, max_gaps: int = 10) -> DataFrame:
    """H6: (query_id, subject_id, covered, regions, coverage, identity) of pairs that pass.

    Query ranges that overlap or adjoin are one region, whose identity is the
    highest of its hits that lie in no other hit's range (of equal ranges the
    highest counts); identity is the mean over regions.
    """
    ranges = hits.select("query_id", "subject_id", F.least("q_start", "q_end").alias("start"), F.greatest("q_start", "q_end").alias("end"), "pident")
    regions = merge_ranges(ranges, ["query_id", "subject_id"], adjoin=1, aggs=[F.max(F.when(~F.col("_inside"), F.col("pident"))).alias("ident")], ties=[F.col("pident").desc()])
    pairs = regions.groupBy("query_id", "subject_id").agg(
        F.sum(F.col("end") - F.col("start") + 1).alias("covered"), F.count("*").alias("regions"), F.avg("ident").alias("identity")
    )
    pairs = pairs.join(lengths, "query_id").withColumn("coverage", 100 * F.col("covered") / F.col("query_length"))
    kept = pairs.where((F.col("coverage") > min_cov) & (F.col("identity") > min_ident) & (F.col("regions") - 1 <= max_gaps))
    return kept.select("query_id", "subject_id", "covered", "regions", "coverage", "identity")


def annotate_hits(hits: DataFrame, deflines: DataFrame) -> DataFrame:
    """H7: hits with their subject's description (null where unknown); deflines has subject_id, description."""
    return hits.join(deflines.select("subject_id", "description"), "subject_id", "left").select(*hits.columns, "description")


def annotate_records(records: DataFrame, annotated: DataFrame, label: str, id_col: str = "id", text_col: str = "descr") -> DataFrame:
    """H7: first hit of each record as text after its description: ``label subject (e_value=...) description``."""
    first = best_hit(annotated, "first").select(
        F.col("query_id").alias(id_col),
        F.concat(F.lit(f"{label} "), "subject_id", F.lit(" (e_value="), F.col("evalue").cast("string"), F.lit(") "), F.coalesce("description", F.lit(""))).alias("_note"),
    )
    joined = records.join(first, id_col, "left").withColumn(text_col, F.concat_ws(" ", text_col, "_note"))
    return joined.select(*records.columns)


def transfer_annotation(genes: DataFrame, sources: list[tuple[str, DataFrame, float]], ec: DataFrame | None = None) -> DataFrame:
    """H8: (id, source, subject_id, description, comment, ec_numbers): the first source, in order, with a described best hit under its evalue cut.

    Each source is (name, annotated hits, highest evalue); a source whose
    annotation comes from a pathway table has descriptions only for the
    subjects that are in it, so the others pass on to the next source. ``ec``
    has source, subject_id, ec: the numbers, joined by ',', are those that the
    chosen source gives its subject. A gene with no source is unknown.
    """
    out = genes.select("id")
    picks = []
    for i, (name, hits, cut) in enumerate(sources):
        best = best_hit(hits.where(F.col("evalue") < cut)).where("description IS NOT NULL")
        found = best.select(F.col("query_id").alias("id"), F.struct(F.lit(name).alias("source"), "subject_id", "description", "evalue").alias(f"_{i}"))
        out = out.join(found, "id", "left")
        picks.append(F.col(f"_{i}"))
    chosen = F.coalesce(*picks)
    comment = F.when(chosen.isNotNull(), F.concat(F.lit("based on "), chosen["source"], F.lit(" match ("), chosen["subject_id"], F.lit(")")))
    rows = out.select("id", *[chosen[c].alias(c) for c in ("source", "subject_id")], F.coalesce(chosen["description"], F.lit("unknown")).alias("description"), comment.alias("comment"))
    if ec is None:
        return rows.withColumn("ec_numbers", F.lit(None).cast("string"))
    listed = ec.groupBy("source", "subject_id").agg(F.array_join(F.array_sort(F.collect_set("ec")), ",").alias("ec_numbers"))
    return rows.join(listed, ["source", "subject_id"], "left").select("id", "source", "subject_id", "description", "comment", "ec_numbers")


#: Words of functions that say nothing.
UNKNOWN_FUNCTION = "unknown|hypothetical|uncharacterized|unnamed|ORF"


def gene_records(genes: DataFrame, functions: DataFrame, hits: DataFrame, cut: int = 8, synonyms: DataFrame | None = None) -> DataFrame:
    """H9: (id, function, function_source): the first function that says something of: the gene's own, the table's, the best described hit's; else ORF.

    ``genes`` has id, note and, where they are known, function and name. The
    table's function is that of the gene's id, else of its name, else of its
    ``synonyms`` (id, synonym), else the note stands for it. A table id matches
    when the gene's id equals it after losing 0 to ``cut`` trailing
    characters, and the longest match wins; of several functions of a name the
    least counts.
    """
    has = lambda c: F.col(c) if c in genes.columns else F.lit(None).cast("string")
    own = genes.select("id", "note", has("function").alias("own"), has("name").alias("name"))
    named = functions.groupBy(F.col("id").alias("key")).agg(F.min("function").alias("function"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(cut)), lambda k: F.substring("id", F.lit(1), F.length("id") - k))
    short = own.select("id", F.explode(F.array_distinct(keys)).alias("key")).where("key <> ''")
    table = short.join(named, "key").groupBy("id").agg(F.max_by("function", F.length("key")).alias("by_id"))
    joined = own.join(table, "id", "left").join(named.select(F.col("key").alias("name"), F.col("function").alias("by_name")), "name", "left")
    if synonyms is None:
        joined = joined.withColumn("by_synonym", F.lit(None).cast("string"))
    else:
        others = synonyms.join(named.withColumnRenamed("key", "synonym"), "synonym").groupBy("id").agg(F.min("function").alias("by_synonym"))
        joined = joined.join(others, "id", "left")
    best = best_hit(hits.where("description IS NOT NULL")).select(F.col("query_id").alias("id"), F.col("description").alias("by_hit"))
    joined = joined.join(best, "id", "left")
    listed = F.coalesce("by_id", "by_name", "by_synonym")
    note = F.when(listed.isNull() & (F.trim("note") != ""), F.col("note"))
    ranked = (("own", F.col("own")), ("table", listed), ("note", note), ("hit", F.col("by_hit")))
    told = F.coalesce(*[F.when(~text.rlike(f"(?i){UNKNOWN_FUNCTION}"), F.struct(text.alias("text"), F.lit(source).alias("source"))) for source, text in ranked])
    return joined.select("id", F.coalesce(told["text"], F.lit("ORF")).alias("function"), F.coalesce(told["source"], F.lit("none")).alias("function_source"))


def gene_parts(genes: DataFrame, parts: DataFrame, cut: int = 8) -> DataFrame:
    """H9: (id, cds_start, cds_end, introns): the span of each gene's coding pieces and its introns as 'start-end', by start, joined by ','.

    ``parts`` has id, type (CDS or intron), start, end; a part belongs to the
    gene whose id its own id equals after losing the fewest, 0 to ``cut``,
    trailing characters.
    """
    keys = F.transform(F.sequence(F.lit(0), F.lit(cut)), lambda k: F.struct(k.alias("k"), F.substring("id", F.lit(1), F.length("id") - k).alias("gene")))
    names = parts.select("id").distinct().select("id", F.explode(keys).alias("x")).select("id", "x.*").where("gene <> ''")
    owner = names.join(genes.select(F.col("id").alias("gene")), "gene").groupBy("id").agg(F.min_by("gene", "k").alias("gene"))
    rows = parts.join(owner, "id")
    cds = F.col("type") == "CDS"
    intron = F.when(F.col("type") == "intron", F.struct("start", "end"))
    per = rows.groupBy("gene").agg(F.min(F.when(cds, F.col("start"))).alias("cds_start"), F.max(F.when(cds, F.col("end"))).alias("cds_end"), F.array_sort(F.collect_list(intron)).alias("i"))
    text = F.array_join(F.transform("i", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return genes.select("id").join(per, genes["id"] == per["gene"], "left").select("id", "cds_start", "cds_end", F.when(text != "", text).alias("introns"))


def pathologic_records(genes: DataFrame, named: DataFrame, parts: DataFrame, ecs: DataFrame, synonyms: DataFrame, dblinks: DataFrame) -> DataFrame:
    """H9: (seqid, id, fields): the key and value lines of each gene record, in their order.

    ``genes`` has seqid, id, name, strand, start, end; ``named`` the functions
    of ``gene_records``; ``parts`` the result of ``gene_parts``; the others
    have id and ec, synonym or dblink, each value once. Bases run along the
    strand and are those of the coding span where there is one.
    """
    listed = lambda df, c: df.groupBy("id").agg(F.array_sort(F.collect_set(c)).alias(c))
    j = genes.join(named, "id").join(parts, "id", "left").join(listed(ecs, "ec"), "id", "left").join(listed(synonyms, "synonym"), "id", "left").join(listed(dblinks, "dblink"), "id", "left")
    low, high = F.coalesce("cds_start", "start").cast("string"), F.coalesce("cds_end", "end").cast("string")
    minus = F.col("strand") == "-"
    one = lambda k, v: F.array(F.struct(F.lit(k).alias("key"), v.alias("value")))
    many = lambda k, a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.struct(F.lit(k).alias("key"), x.alias("value")))
    fields = F.concat(
        one("ID", F.col("id")), one("NAME", F.coalesce("name", "id")), many("SYNONYM", F.col("synonym")), one("STARTBASE", F.when(minus, high).otherwise(low)), one("ENDBASE", F.when(minus, low).otherwise(high)),
        many("INTRON", F.split("introns", ",")), one("FUNCTION", F.col("function")), many("EC", F.col("ec")), many("DBLINK", F.col("dblink")), one("PRODUCT-TYPE", F.lit("P")),
    )
    return j.select("seqid", "id", fields.alias("fields"))


def full_length_hits(hits: DataFrame, subjects: DataFrame, min_ident: float = 80, min_cover: float = 0.99) -> DataFrame:
    """Best hits that span the subject; ``subjects`` has subject_id, subject_length, description."""
    best = best_hit(hits).join(subjects, "subject_id")
    return best.where((F.col("pident") >= min_ident) & (F.col("length") >= min_cover * F.col("subject_length")))


def identity_histogram(hits: DataFrame, width: int = 10) -> DataFrame:
    """(bin, hits) of percent identity, bins of ``width``."""
    return hits.groupBy((F.floor(F.col("pident") / width) * width).cast("int").alias("bin")).agg(F.count("*").alias("hits"))


def organism_summary(hits: DataFrame, rare: int = 2, pattern: str = r"OS=([^=]+?)(?: [A-Z]{2}=|$)") -> DataFrame:
    """(organism, hits, mean_ident) from descriptions; organisms under ``rare`` hits are pooled as 'other'."""
    named = hits.withColumn("organism", F.regexp_extract("description", pattern, 1))
    each = named.groupBy("organism").agg(F.count("*").alias("n"), F.sum("pident").alias("s"))
    pooled = each.groupBy(F.when(F.col("n") < rare, "other").otherwise(F.col("organism")).alias("organism"))
    return pooled.agg(F.sum("n").alias("hits"), (F.sum("s") / F.sum("n")).alias("mean_ident"))


def chimera_by_ends(end_hits: DataFrame, self_hits: DataFrame) -> DataFrame:
    """(clone, subject5, subject3) whose ends' top subjects differ and are not linked with each other.

    Query ids end in ':5' or ':3'; ``self_hits`` holds subject pairs.
    """
    top = best_hit(end_hits, "first").withColumn("clone", F.regexp_extract("query_id", r"^(.*):[53]$", 1))
    side = lambda s: top.where(F.col("query_id").endswith(f":{s}")).select("clone", F.col("subject_id").alias(f"subject{s}"))
    pairs = side(5).join(side(3), "clone").where("subject5 <> subject3")
    linked = self_hits.select(F.col("query_id").alias("subject5"), F.col("subject_id").alias("subject3"))
    linked = linked.unionByName(linked.select(F.col("subject3").alias("subject5"), F.col("subject5").alias("subject3"))).distinct()
    return pairs.join(linked, ["subject5", "subject3"], "left_anti").select("clone", "subject5", "subject3")


def chimera_by_spans(hits: DataFrame, min_length: int = 100, max_gap: int = 20, min_support: int = 2) -> DataFrame:
    """(query_id, left_end, right_start): two well-supported spans of the query less than ``max_gap`` apart."""
    ranges = hits.where((F.col("length") >= min_length) & (F.col("query_id") != F.col("subject_id")))
    ranges = ranges.select("query_id", F.least("q_start", "q_end").alias("start"), F.greatest("q_start", "q_end").alias("end"))
    spans = merge_ranges(ranges, ["query_id"], aggs=[F.count("*").alias("support")])
    by = Window.partitionBy("query_id").orderBy("start")
    spans = spans.withColumns({"left_end": F.lag("end").over(by), "left_support": F.lag("support").over(by)})
    kept = spans.where((F.col("support") >= min_support) & (F.col("left_support") >= min_support) & (F.col("start") - F.col("left_end") < max_gap))
    return kept.select("query_id", "left_end", F.col("start").alias("right_start"))


def contrast_group_genes(hits: DataFrame, species: Column, outgroup: list[str], ingroup: list[str], contrast: list[str], min_out: int = 4, min_in: int = 6) -> DataFrame:
    """(query_id, n_out, n_in): hits in enough out-group and in-group species, none in the contrast group."""
    named = hits.select("query_id", species.alias("species"))
    per = named.groupBy("query_id").agg(
        F.countDistinct(F.when(F.col("species").isin(outgroup), F.col("species"))).alias("n_out"),
        F.countDistinct(F.when(F.col("species").isin(ingroup), F.col("species"))).alias("n_in"),
        F.max(F.col("species").isin(contrast).cast("int")).alias("n_contrast"),
    )
    return per.where((F.col("n_out") >= min_out) & (F.col("n_in") >= min_in) & (F.coalesce("n_contrast", F.lit(0)) == 0)).select("query_id", "n_out", "n_in")


def parent_allele_by_hit(hits: DataFrame, by: str = "pident") -> DataFrame:
    """(query_id, parents): the parents whose best hit is best, ties joined by ','; ``hits`` has a parent column."""
    best = best_hit(hits, "score", ("query_id", "parent"))
    value = -F.col("evalue") if by == "evalue" else F.col(by)
    ranked = best.withColumn("_r", F.rank().over(Window.partitionBy("query_id").orderBy(value.desc()))).where("_r = 1")
    return ranked.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("parent")), ",").alias("parents"))


#: Bases of a piece, and of a part of it, that words are cut from: a place inside a string is reached by walking to it.
PIECES = (1 << 14, 1 << 8)


#: Pairs that a task makes.
PAIRS = 1 << 22


def _pieces(seqs: DataFrame, k: int, *sizes: int) -> DataFrame:
    """(id, seq): different sequences of ``k`` bases or more, equal ones under their least id, cut into pieces that overlap by k - 1 bases, these into smaller ones."""
    rows = seqs.where(F.length("seq") >= k).groupBy("seq").agg(F.min("id").alias("id"))
    for size in sizes:
        last = F.expr(f"cast((length(seq) - {k}) div {size} as int)")
        rows = rows.select("id", "seq", F.explode(F.sequence(F.lit(0), last)).alias("i")).select("id", F.substring("seq", F.col("i") * size + 1, F.lit(size + k - 1)).alias("seq"))
    return rows


def _words(seqs: DataFrame, k: int) -> DataFrame:
    """(id, word) for every place of different sequences, equal ones under their least id; equal words of a sequence are repeated.

    Sequences are cut into pieces and these into parts that overlap by k - 1 bases, so the work grows with their length.
    """
    rows = _pieces(seqs, k, *PIECES)
    places = F.sequence(F.lit(1), F.length("seq") - k + 1)
    return rows.select("id", F.explode(F.transform(places, lambda i: F.substring("seq", i, F.lit(k)))).alias("word"))


def _word_lists(seqs: DataFrame, k: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Written tables (id, words) of different sequences with ``least`` words or more, and (word, id) of their rarest words.

    Two sequences that share ``least`` words share one of the n - least + 1
    rarest of either. Words of one sequence only are left out.
    """
    whole = _words(seqs, k).groupBy("id").agg(F.collect_set(F.xxhash64("word")).alias("words"))
    whole = materialize(whole.where(F.size("words") >= least))
    rows = whole.select("id", F.explode("words").alias("word"))
    usual = rows.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    ranked = rows.join(usual, "word", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "word"))).alias("by"))
    rare = F.slice("by", F.lit(1), F.size("by") - least + 1)
    return whole, materialize(ranked.select("id", F.explode(rare).alias("x")).where("x.n > 1").select("x.word", "id"))


def _shared(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b, n) of pairs (a, b): the words that both have, on their whole lists."""
    both = pairs.join(whole.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b").join(whole.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
    return both.select("a", "b", F.size(F.array_intersect("wa", "wb")).cast("long").alias("n"))


def kmer_candidates(seqs: DataFrame, k: int = 9, min_score: int = 75) -> DataFrame:
    """(a, b, score): pairs of different sequences by shared words, score = shared distinct words times k.

    Equal sequences are one, under its least id (``equal_sequences`` gives the
    membership), so copies make no pairs. No word is left out for being
    frequent. Sequences shorter than k have no words. The result grows with
    the square of a group of alike sequences; ``kmer_classes`` gives the groups
    without their pairs. Words travel in runs (``words.py``), and the sequences
    that share them in lists, whose pairs are made after they are dealt.
    """
    kind = seqs.schema["id"].dataType.simpleString()

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = b["seq"].str.len().cumsum() // words.LETTERS
            for _, part in b.groupby(sizes):
                owner, core, run = words.runs(part["seq"].tolist(), k)
                yield pd.DataFrame({"core": core, "id": part["id"].to_numpy()[owner], "run": run})

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in words.whole_cores(batches):
            yield words.pair_cells(rows, k)

    runs = _pieces(seqs.where("id IS NOT NULL"), k, PIECES[0]).mapInPandas(dealt, f"core long, id {kind}, run string").repartition("core").sortWithinPartitions("core")
    lists = materialize(runs.mapInPandas(listed, f"cell long, a array<{kind}>, b array<{kind}>, n long"))
    size = F.size("a").cast("long")
    total = lists.agg(F.sum(F.when(F.col("b").isNull(), size * (size - 1) / 2).otherwise(size * F.size("b")))).first()[0]
    # lists of one cell meet in a task, so a pair is added up there before it travels
    placed = lists.repartition(int(total or 0) // PAIRS + 1, "cell")
    firsts = placed.select("a", "b", "n", F.posexplode("a").alias("i", "x"))
    others = F.when(F.col("b").isNull(), F.slice("a", F.col("i") + 2, F.size("a"))).otherwise(F.col("b"))
    pairs = firsts.select("x", F.explode(others).alias("y"), "n").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n")
    return pairs.groupBy("a", "b").agg((F.sum("n") * k).alias("score")).where(F.col("score") >= min_score)


#: Hubs of a word in the first round, second, ...: 1, HUBS, HUBS ** 2, ...
HUBS = 64


def kmer_classes(seqs: DataFrame, k: int = 9, min_score: int = 75) -> DataFrame:
    """(id, class): sequences joined by pairs of ``min_score`` or more, named by the least id; sequences without such a pair are their own class.

    A word's sequences are not paired with each other but with a hub, the one
    whose words are shared most; the pairs' scores are exact. A word whose
    sequences are then of one class is closed, for no pair of it can change a
    class; in an open one the hub is done with, and more hubs come in the next
    round, until all words are closed. So every pair of different classes that
    shares one of its rarest words has been scored, and none within a class
    but those with hubs.
    """
    least = max(1, -(-min_score // k))
    whole, rare = _word_lists(seqs, k, least)
    weights = rare.join(rare.groupBy("word").agg(F.count("*").alias("n")), "word").groupBy("id").agg(F.sum("n").alias("weight"))
    members = materialize(rare.join(weights, "id"))
    discard(rare)
    classes = materialize(whole.select("id", F.col("id").alias("class")))
    cells, tested = 1, []
    while not members.isEmpty():
        classed = members.join(classes, "id")
        cell = F.pmod(F.xxhash64("word", "id"), F.lit(cells))
        hubs = materialize(classed.groupBy("word", cell.alias("cell")).agg(F.max_by(F.struct("id", "class"), F.struct("weight", "id")).alias("hub")).select("word", F.col("hub.id").alias("hub"), F.col("hub.class").alias("hub_class")))
        pairs = classed.join(hubs, "word").where("class <> hub_class").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        if tested:
            pairs = pairs.join(reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti")
        found = materialize(_shared(pairs, whole))
        tested.append(found.select("a", "b"))
        ends = found.where(F.col("n") * k >= min_score)
        if not ends.isEmpty():
            side = lambda c, name: classes.select(F.col("id").alias(c), F.col("class").alias(name))
            joined = connected_components(ends.join(side("a", "u"), "a").join(side("b", "v"), "b").select("u", "v"), src="u", dst="v")
            last, classes = classes, materialize(classes.join(joined.withColumnRenamed("node", "class"), "class", "left").select("id", F.coalesce("component", "class").alias("class")))
            discard(last)
        rest = members.join(hubs.select("word", F.col("hub").alias("id")), ["word", "id"], "left_anti")
        open_ = rest.join(classes, "id").groupBy("word").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("word")
        last, members = members, materialize(rest.join(open_, "word").select("word", "id", "weight"))
        discard(last, hubs)
        cells *= HUBS
    out = seqs.groupBy("seq").agg(F.min("id").alias("least"))
    named = seqs.join(out, "seq").join(classes.withColumnRenamed("id", "least"), "least", "left")
    return named.select("id", F.coalesce("class", "least").alias("class"))


def equal_sequences(seqs: DataFrame) -> DataFrame:
    """(id, least): each sequence's id and the least id of its equals, under which ``kmer_candidates`` knows it."""
    least = seqs.groupBy("seq").agg(F.min("id").alias("least"))
    return seqs.join(least, "seq").select("id", "least")
