"""Queries over gene families (P0 to P16) and the remaining feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sporeline.functions.storage import materialize
from sporeline.operators import families as P
from sporeline.operators import features as FT
from sporeline.plans.adapters import peptide_sql, view, with_views


def _aligned(spark, d):
    return view(spark, d, "aligned")


def _strains(spark, d):
    return view(spark, d, "members").select("member", "strain")


def _members(spark, d):
    return _aligned(spark, d).select("family", "member").join(_strains(spark, d), "member")


def p0_align_stats(spark, d):
    return P.align_stats(_aligned(spark, d), _strains(spark, d)).withColumn("identity", F.round("identity", 4))


def p0b_ace_to_alignment(spark, d):
    rows = view(spark, d, "contig_reads").select("contig_id", "read_id", (F.col("start") % 40 - 5).alias("start"), F.lit("ACGTTGCAAC").alias("seq"))
    return P.ace_to_alignment(rows, view(spark, d, "contig_lengths").withColumn("length", F.col("length") * 0 + 60))


def p1_aligned_span(spark, d):
    return P.aligned_span(_aligned(spark, d))


def p2_member_overlaps(spark, d):
    return P.member_overlaps(_aligned(spark, d)).select("family", "a", "b", "start", "end", "length", F.round("identity", 4).alias("identity"), F.round("score", 4).alias("score"))


def p3_seed_pairs(spark, d):
    return P.seed_pairs(P.member_overlaps(_aligned(spark, d)), "length", 10).select("family", "a", "b", "length")


def p3_ranked_pairs(spark, d):
    return P.ranked_pairs(P.member_overlaps(_aligned(spark, d)), "length", 10).select("family", "a", "b", "length", "rank")


def p4_common_overlap(spark, d):
    return P.common_overlap(P.aligned_span(_aligned(spark, d)))


def p4_slice_alignment(spark, d):
    a = _aligned(spark, d)
    return P.slice_alignment(a, P.common_overlap(P.aligned_span(a)))


def p5_strain_composition(spark, d):
    return P.strain_composition(_members(spark, d), {"st0": 1, "st2": 2})


def p6_prune_by_strains(spark, d):
    return P.prune_by_strains(P.pair_distances(_aligned(spark, d)), _strains(spark, d), {"st0": 1, "st2": 1}, first=[("st0", "st2")])


def p7_prune_by_overlaps(spark, d):
    return P.prune_by_overlaps(P.member_overlaps(_aligned(spark, d)), _strains(spark, d), {"st0": 1, "st2": 1}, seeds=3)


def p7_pruned_slices(spark, d):
    kept = p7_prune_by_overlaps(spark, d)
    a = _aligned(spark, d).join(kept.select("family", "member"), ["family", "member"])
    return P.slice_alignment(a, P.common_overlap(P.aligned_span(a)))


def p8_prune_by_align(spark, d):
    return P.prune_by_align(P.align_stats(_aligned(spark, d), _strains(spark, d)), {"members": ("<", 2), "length": (">", 900)}).select("family", "members")


def p8_qualify(spark, d):
    a = _aligned(spark, d)
    found = P.qualify_alignments(a, P.align_stats(a, _strains(spark, d)), 60, 80)
    return found.select("family", "length", "members", F.round("identity", 4).alias("identity"), F.round("coverage", 4).alias("coverage"), "qualification")


def p9_pair_distances(spark, d):
    return P.pair_distances(_aligned(spark, d), "jukes-cantor").withColumn("distance", F.round("distance", 6))


def p9_nearest_member(spark, d):
    return P.nearest_member(P.pair_distances(_aligned(spark, d), "uncorrected")).withColumn("distance", F.round("distance", 6))


def p10_trees(spark, d):
    return P.trees(P.pair_distances(_aligned(spark, d)), "nj")


def p10_upgma(spark, d):
    return P.trees(P.pair_distances(_aligned(spark, d)), "upgma")


def _rooted(spark, d, method):
    t = P.trees(P.pair_distances(_aligned(spark, d)))
    lengths = _aligned(spark, d).select("family", "member", F.length(F.replace("seq", F.lit("-"))).alias("length"))
    return P.root_trees(t, lengths.join(_strains(spark, d), "member"), method, "st1")


def p10_midpoint(spark, d):
    return _rooted(spark, d, "midpoint")


def p10_strain_root(spark, d):
    return _rooted(spark, d, "strain")


def p10_longest_root(spark, d):
    return _rooted(spark, d, "longest")


def p11_bootstrap(spark, d):
    return P.bootstrap_support(_aligned(spark, d), 100)


def p12_filter_support(spark, d):
    a = _aligned(spark, d)
    return P.filter_support(P.trees(P.pair_distances(a)), P.bootstrap_support(a, 100), 20)


def p13_topotypes(spark, d):
    return P.topotypes(_rooted(spark, d, "midpoint"), _members(spark, d))


def _by_method(spark, d):
    return P.topologies(P.trees_by(P.pair_distances(_aligned(spark, d)), ["nj", "upgma"]), _members(spark, d))


def p14_topology_table(spark, d):
    return P.topology_table(_by_method(spark, d), ["nj", "upgma"])


def p14_topology_counts(spark, d):
    return P.topology_counts(_by_method(spark, d), ["nj", "upgma"])


def p15_allele_parent(spark, d):
    return P.allele_parent(_rooted(spark, d, "midpoint"), _members(spark, d), ["st0", "st1"], "st2", P.member_overlaps(_aligned(spark, d)), 10, 20)


def _omegas(spark, d):
    omega = F.when(F.col("gaps") == 2, 99.0).otherwise(F.col("evalue") * 20)
    return view(spark, d, "hits").select(F.col("subject_id").alias("contig"), F.concat(F.lit("r"), "mismatches").alias("a"), F.concat(F.lit("r"), (F.col("gaps") + 1).cast("string")).alias("b"), omega.alias("omega"))


def p16_selection_classes(spark, d):
    return P.selection_classes(_omegas(spark, d)).groupBy("contig", "selection").agg(F.count("*").alias("n"))


def p16_pairs_by_contig(spark, d):
    return P.pairs_by_contig(_omegas(spark, d))


def p16_omega_bands(spark, d):
    return P.omega_bands(view(spark, d, "hits").select(F.when(F.col("gaps") == 2, 99.0).otherwise(F.col("evalue") * 10).alias("omega")))


def _gff(spark, d):
    f = view(spark, d, "features")
    return f.select(F.col("ref").alias("seqid"), F.lit("src").alias("source"), F.when(F.col("type") == "F", "gene").otherwise("mRNA").alias("type"), "start", "end", F.lit("+").alias("strand"), "id",
                    F.create_map(F.lit("ID"), F.array(F.concat(F.lit("F"), F.substring("id", 3, 9))), F.lit("Name"), F.array("id")).alias("attrs"), F.regexp_replace("id", "F", "").cast("long").alias("line_no"))


def i11_move_features(spark, d):
    moves = view(spark, d, "marks").groupBy(F.col("ref").alias("seqid")).agg(F.min("start").alias("a"), F.max("start").alias("b"))
    moves = moves.select("seqid", F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.col("a").alias("loc"), F.lit(100).alias("shift")), F.struct(F.lit(2).alias("ord"), F.col("b").alias("loc"), F.lit(-50).alias("shift")))).alias("m")).select("seqid", "m.*")
    return FT.move_features(_gff(spark, d).select("id", "seqid", "start", "end"), moves)


def i11_invalid_families(spark, d):
    k = F.regexp_replace("id", "F", "").cast("long")
    parent = F.when(k % 16 == 0, F.lit(None)).when(k % 4 == 0, F.concat(F.lit("F"), k - k % 16)).otherwise(F.concat(F.lit("F"), k - k % 4))
    return FT.invalid_families(i11_move_features(spark, d).withColumn("parent", parent))


def i11_region_lengths(spark, d):
    moves = view(spark, d, "marks").select(F.col("ref").alias("seqid"), F.col("start").alias("loc"), F.when(F.col("start") % 2 == 0, 10).otherwise(-3).alias("shift"))
    regions = view(spark, d, "features").groupBy(F.col("ref").alias("seqid")).agg((F.max("end") - 20000).alias("length"))
    return FT.region_lengths(regions, moves)


def i12_normalize(spark, d):
    k = F.col("line_no") % 3
    target = F.when(k == 0, F.concat_ws(" ", F.lit("x"), F.col("end").cast("string"), F.col("start").cast("string"))).when(k == 1, F.lit("t 5 9 -")).otherwise("t 9 5")
    f = _gff(spark, d).withColumn("attrs", F.map_concat("attrs", F.create_map(F.lit("Target"), F.array(target))))
    out = FT.normalize_features(f, "ITAG", {"mRNA": "transcript"}, "LIB_")
    return out.select("id", "source", "type", "start", "end", F.col("attrs")["Name"][0].alias("name"), F.col("attrs")["Target"][0].alias("target"))


def i13_unique_ids(spark, d):
    own = F.when(F.col("line_no") % 10 == 0, F.map_filter("attrs", lambda k, v: k != "ID")).otherwise(F.col("attrs"))
    return FT.unique_ids(_gff(spark, d).withColumn("attrs", own)).select("id", F.col("attrs")["ID"][0].alias("new_id"))


def i13_edit_attributes(spark, d):
    return FT.edit_attributes(_gff(spark, d), [("^N", "^F", "gene "), ("ID|Name", "7", "seven")]).select("id", F.col("attrs")["ID"][0].alias("new_id"), F.col("attrs")["Name"][0].alias("name"))


def i13_sequence_regions(spark, d):
    declared = view(spark, d, "features").select(F.concat("ref", F.col("start") % 3).alias("seqid"), F.lit(1).cast("long").alias("start"), (F.col("end") - F.col("end") % 20000 + 20000).alias("end"), F.regexp_replace("id", "F", "").cast("long").alias("line_no"))
    seqs = view(spark, d, "marks").groupBy(F.concat("ref", F.lit("1")).alias("id")).agg(F.lit(60000).cast("long").alias("length"))
    return FT.sequence_regions(declared, seqs)


def i14_mark_partial(spark, d):
    f = _gff(spark, d).withColumn("attrs", F.create_map(F.lit("ID"), F.array(F.concat(F.lit("gene:"), "id", F.lit(".1")))))
    five = view(spark, d, "marks").select(F.regexp_replace("id", "M", "F").alias("id"))
    three = five.where("id like '%5'")
    return FT.mark_partial(f, five, three).select("id", F.array_join(F.col("attrs")["partial"], ",").alias("partial"))


def i15_add_functions(spark, d):
    g = view(spark, d, "features").select("id")
    s = view(spark, d, "members_go").select(F.regexp_replace("member", "V", "F").alias("id"), "go_id")
    gen = view(spark, d, "marks").select(F.regexp_replace("id", "M", "F").alias("id"), F.concat(F.lit("GO:g"), F.col("start") % 5).alias("go_id"))
    return FT.add_functions(g, s, gen, view(spark, d, "features").select("id", F.concat(F.lit("note "), "type").alias("note")))


def _old(spark, d):
    f = _gff(spark, d)
    return f.where("line_no % 3 > 0").select("id", (F.col("line_no") - F.col("line_no") % 8).alias("locus"), "type", F.col("start"), (F.col("end") + F.when(F.col("line_no") % 16 < 8, F.col("line_no") % 2).otherwise(0)).alias("end"), F.lit("old").alias("source"), F.create_map(F.lit("Name"), F.array(F.lit("old")), F.lit("Note"), F.array(F.lit("n"))).alias("attrs"), F.lit(2).alias("version"))


def i16_merge_builds(spark, d):
    new = _gff(spark, d).where("line_no % 2 = 1").select("id", (F.col("line_no") - F.col("line_no") % 8).alias("locus"), F.when(F.col("line_no") % 8 == 1, "exon").otherwise(F.col("type")).alias("type"), "start", "end", F.lit("new").alias("source"), F.create_map(F.lit("Name"), F.array("id")).alias("attrs"))
    return FT.merge_gene_builds(new, _old(spark, d)).select("id", "start", "end", "source", "version", "place", F.col("attrs")["Name"][0].alias("name"), F.col("attrs")["Note"][0].alias("note"))


def _models(spark, d):
    h = view(spark, d, "hits")
    return h.select(F.col("query_id").alias("parent"), F.concat("query_id", F.lit("")).alias("gene"), F.when(F.col("mismatches") == 2, "CDS").otherwise("exon").alias("type"), F.when(F.regexp_replace("query_id", "Q", "").cast("long") % 2 == 0, "-").otherwise("+").alias("strand"), F.col("q_start").alias("start"), F.col("q_end").alias("end"))


def i17_spliced(spark, d):
    m = _models(spark, d).withColumns({"seqid": F.regexp_replace("parent", "Q", ""), "end": F.col("start") + 20})
    return FT.spliced_sequences(m, view(spark, d, "seqs"), "exon")


def i17_proteins(spark, d):
    m = _models(spark, d).withColumns({"seqid": F.regexp_replace("parent", "Q", ""), "end": F.col("start") + 20, "type": F.lit("CDS")})
    return FT.spliced_proteins(m, view(spark, d, "seqs"))


def _spread(spark, d):
    """Models whose pieces lie apart: exons of 60 bases at steps of 100, coding pieces that reach over some of the gaps."""
    h = view(spark, d, "hits")
    cds = F.col("mismatches") == 2
    start = F.when(cds, F.col("mismatches") * 100 + F.col("gaps") * 30).otherwise(F.col("mismatches") * 100)
    return h.select(F.concat("query_id", F.lit(".1.1")).alias("parent"), F.when(cds, "CDS").when(F.col("mismatches") == 6, "intron").otherwise("exon").alias("type"), F.when(F.col("line_no") * 0 + F.length("query_id") % 2 == 0, "-").otherwise("+").alias("strand"), start.cast("long").alias("start"), (start + F.when(cds, 75 + F.col("gaps") * 20).otherwise(60)).cast("long").alias("end"))


def i18_rebuild_models(spark, d):
    return FT.rebuild_models(_spread(spark, d))


def i18_recalc_utrs(spark, d):
    return FT.recalc_utrs(_models(spark, d))


def i19_trim_models(spark, d):
    f = _models(spark, d)
    genes = f.groupBy("parent", "gene", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("type", F.lit("gene"))
    trims = genes.select("gene", (F.col("start") % 40).alias("five"), (F.col("end") % 30).alias("three"))
    return FT.trim_models(f.unionByName(genes), trims).select("gene", "type", "start", "end")


def i20_feature_table(spark, d):
    h = _models(spark, d).join(view(spark, d, "subjects").select(F.regexp_replace("subject_id", "S", "Q").alias("parent"), "description"), "parent", "left")
    h = materialize(h)
    span = h.groupBy("gene", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("description").alias("note"))
    span = materialize(span)  # read for genes, for places and for qualifiers
    genes = span.select(F.lit("chr1").alias("seqid"), "gene", "strand", "start", "end")
    note = F.concat("note", F.lit(" Unknown Protein (EC 1.2.3) (AHRD V1 *-*- Q9X) IPR000001"))
    mrnas = span.select("gene", F.concat("gene", F.lit(".1")).alias("mrna"), F.concat("gene", F.lit(".1.1")).alias("name"), "strand", note.alias("note"), F.array(F.lit("5'")).alias("partial"), F.array(F.lit("GO:0001"), F.lit("X:1")).alias("terms"))
    parts = h.select(F.concat("gene", F.lit(".1")).alias("mrna"), "type", "start", "end").distinct()
    go = spark.createDataFrame([("GO:0001", "growth", "biological_process")], "go_id string, name string, namespace string")
    return FT.feature_table(genes, mrnas, parts, go).select("gene", F.col("ord.mrna").alias("mrna"), F.col("ord.k").alias("k"), F.col("ord.i").alias("i"), "value")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "pi" and k[1].isdigit() and callable(v)}

_SPAN = """sp AS (SELECT *, length(seq) - length(ltrim(seq, '-')) + 1 AS first, length(rtrim(seq, '-')) AS last FROM aligned)"""
_PAIR = _SPAN + """, pr AS (SELECT a.family, a.member AS a, b.member AS b, a.seq AS sa, b.seq AS sb, greatest(a.first, b.first) AS start, least(a.last, b.last) AS "end" FROM sp a JOIN sp b ON a.family = b.family AND a.member < b.member WHERE greatest(a.first, b.first) <= least(a.last, b.last)),
ov AS (SELECT family, a, b, start, "end", "end" - start + 1 AS length,
  100.0::DOUBLE * len(list_filter(range(start, "end" + 1), lambda i: substr(sa, i, 1) = substr(sb, i, 1) AND substr(sa, i, 1) <> '-')) / greatest(len(list_filter(range(start, "end" + 1), lambda i: substr(sa, i, 1) <> '-' AND substr(sb, i, 1) <> '-')), 1) AS identity FROM pr)"""
_DIST = """ds AS (SELECT a.family, a.member AS a, b.member AS b, len(list_filter(range(1, length(a.seq) + 1), lambda i: substr(a.seq, i, 1) <> '-' AND substr(b.seq, i, 1) <> '-')) AS n,
  len(list_filter(range(1, length(a.seq) + 1), lambda i: substr(a.seq, i, 1) <> '-' AND substr(b.seq, i, 1) <> '-' AND substr(a.seq, i, 1) <> substr(b.seq, i, 1))) AS k FROM aligned a JOIN aligned b ON a.family = b.family AND a.member < b.member)"""
_MODEL = """m AS (SELECT query_id AS parent, CASE WHEN mismatches = 2 THEN 'CDS' ELSE 'exon' END AS type, CASE WHEN substr(query_id, 2)::BIGINT % 2 = 0 THEN '-' ELSE '+' END AS strand, q_start AS s, q_end AS e FROM hits)"""

_MOVED = with_views(
    "features marks",
    """WITH mv AS (SELECT ref, min(start) AS a, max(start) AS b FROM marks GROUP BY ref),
        x AS (SELECT id, f.ref, f.start AS s, f."end" AS e, a, b FROM features f LEFT JOIN mv USING (ref)),
        y AS (SELECT id, ref, CASE WHEN a <= s THEN s + 100 ELSE s END AS s, CASE WHEN a <= e THEN e + 100 ELSE e END AS e, (a IS NULL OR a <= s OR a > e) AS ok, b FROM x),
        moved AS (SELECT id, ref AS seqid, CASE WHEN b - 1 <= s THEN s - 50 ELSE s END AS start, CASE WHEN b - 1 <= s THEN e - 50 ELSE e END AS "end", ok AND (b IS NULL OR b - 1 <= s OR b - 50 > e) AS valid FROM y) SELECT""",
)[5:].rsplit(" SELECT", 1)[0]

SQL = {
    "p0_align_stats": with_views("aligned members", "WITH " + _PAIR + """, i AS (SELECT family, avg(identity) AS identity FROM ov GROUP BY family), c AS (SELECT family, strain, count(*) AS k FROM aligned a JOIN members m ON m.member = a.member GROUP BY ALL),
        cc AS (SELECT family, string_agg(strain || '=' || k, ',' ORDER BY strain || '=' || k) AS composition FROM c GROUP BY family)
        SELECT family, count(*) AS members, max(length(seq)) AS length, round(max(identity), 4) AS identity, max(composition) AS composition, string_agg(member, ',' ORDER BY member) AS member_list FROM aligned LEFT JOIN i USING (family) LEFT JOIN cc USING (family) GROUP BY family""".replace("FROM aligned a JOIN members m ON m.member = a.member", "FROM (SELECT a.family, m.strain FROM aligned a JOIN members m ON m.member = a.member)")),
    "p0b_ace_to_alignment": with_views("contig_reads contig_lengths", "WITH r AS (SELECT contig_id, read_id, start % 40 - 5 AS s FROM contig_reads JOIN contig_lengths USING (contig_id)) SELECT contig_id AS family, read_id AS member, rpad(CASE WHEN s < 1 THEN substr('ACGTTGCAAC', 2 - s) ELSE repeat('-', s - 1) || 'ACGTTGCAAC' END, 60, '-') AS seq FROM r"),
    "p1_aligned_span": with_views("aligned", "WITH " + _SPAN + " SELECT family, member, first, last FROM sp"),
    "p2_member_overlaps": with_views("aligned", "WITH " + _PAIR + " SELECT family, a, b, start, \"end\", length, round(identity, 4) AS identity, round(length * (identity / 100) ** 2, 4) AS score FROM ov"),
    "p3_seed_pairs": with_views("aligned", "WITH " + _PAIR + " SELECT family, a, b, length FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY length DESC, a, b) AS r FROM ov WHERE length >= 10) WHERE r = 1"),
    "p3_ranked_pairs": with_views("aligned", "WITH " + _PAIR + " SELECT family, a, b, length, row_number() OVER (PARTITION BY family ORDER BY length DESC, a, b) AS rank FROM ov WHERE length >= 10"),
    "p8_qualify": with_views("aligned", "WITH " + _PAIR + """, i AS (SELECT family, avg(identity) AS identity FROM ov GROUP BY family), st AS (SELECT family, count(*) AS members, max(length(seq)) AS length FROM aligned GROUP BY family),
        c AS (SELECT family, i, x, count(*) AS n FROM (SELECT family, i, substr(seq, i, 1) AS x FROM aligned, range(1, 60) r(i)) WHERE x NOT IN ('', '-') GROUP BY ALL), m AS (SELECT family, i, max(n) AS n FROM c GROUP BY ALL),
        g AS (SELECT family, count(*) FILTER (2 * n >= members) AS agreed FROM m JOIN st USING (family) GROUP BY family), q AS (SELECT family, length, members, identity, 100.0::DOUBLE * coalesce(agreed, 0) / length AS coverage FROM st LEFT JOIN g USING (family) LEFT JOIN i USING (family))
        SELECT family, length, members, round(identity, 4) AS identity, round(coverage, 4) AS coverage, CASE WHEN coverage < 60 AND coalesce(identity < 80, false) THEN 'NO PASS COVERAGE FILTER+ NO PASS IDENTITY FILTER' WHEN coverage < 60 THEN 'NO PASS COVERAGE FILTER' WHEN coalesce(identity < 80, false) THEN 'NO PASS IDENTITY FILTER' ELSE 'PASS' END AS qualification FROM q"""),
    "p16_selection_classes": with_views("hits", "WITH o AS (SELECT subject_id AS contig, CASE WHEN gaps = 2 THEN 99 ELSE evalue * 20 END AS w FROM hits) SELECT contig, CASE WHEN w = 99 THEN 'NA (SAME CDS SEQUENCE)' WHEN w = 0 THEN 'NA (SAME PROTEIN, DIFFERENT CDS SEQUENCE)' WHEN w = 1 THEN 'NEUTRALITY' WHEN w > 1.5 THEN 'STRONG POSITIVE SELECTION' WHEN w > 1.2 THEN 'POSITIVE SELECTION' WHEN w > 1 THEN 'CLOSE NEUTRALITY' WHEN w > 0.8 THEN 'CLOSE NEUTRALITY' WHEN w > 0.5 THEN 'NEGATIVE SELECTION' ELSE 'STRONG NEGATIVE SELECTION' END AS selection, count(*) AS n FROM o GROUP BY ALL"),
    "p16_pairs_by_contig": with_views("hits", "WITH o AS (SELECT subject_id AS contig, least(mismatches, gaps + 1) AS a, greatest(mismatches, gaps + 1) AS b, min(CASE WHEN gaps = 2 THEN 99 ELSE evalue * 20 END) AS w FROM hits GROUP BY ALL) SELECT contig, count(*) AS pairs, count(*) FILTER (w <> 99) AS defined FROM o GROUP BY contig"),
    "p4_common_overlap": with_views("aligned", "WITH " + _SPAN + " SELECT family, max(first) AS start, min(last) AS \"end\" FROM sp GROUP BY family HAVING max(first) <= min(last)"),
    "p4_slice_alignment": with_views("aligned", "WITH " + _SPAN + ", c AS (SELECT family, max(first) AS s, min(last) AS e FROM sp GROUP BY family HAVING max(first) <= min(last)) SELECT family, member, substr(seq, s, e - s + 1) AS seq FROM aligned JOIN c USING (family)"),
    "p5_strain_composition": with_views("aligned members", "WITH n AS (SELECT a.family, m.strain, count(*) AS n FROM aligned a JOIN members m ON m.member = a.member GROUP BY ALL) SELECT family, string_agg(strain || '=' || n, ',' ORDER BY strain || '=' || n) AS composition, count(*) FILTER (strain = 'st0' AND n >= 1) > 0 AND count(*) FILTER (strain = 'st2' AND n >= 2) > 0 AS complete FROM n GROUP BY family"),
    "p8_prune_by_align": with_views("aligned", "SELECT family, count(*) AS members FROM aligned GROUP BY family HAVING count(*) >= 2"),
    "p9_pair_distances": with_views("aligned", "WITH " + _DIST + " SELECT family, a, b, round(CASE WHEN n > 0 AND k::DOUBLE / n < 0.75 THEN -0.75::DOUBLE * ln(1 - 4.0::DOUBLE / 3 * k / n) END, 6) AS distance FROM ds"),
    "p9_nearest_member": with_views("aligned", "WITH " + _DIST + ", b AS (SELECT family, a AS member, b AS nearest, k::DOUBLE / n AS d FROM ds WHERE n > 0 UNION ALL SELECT family, b, a, k::DOUBLE / n FROM ds WHERE n > 0) SELECT family, member, nearest, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY family, member ORDER BY d, nearest) AS r FROM b) WHERE r = 1"),
    "p16_omega_bands": with_views("hits", "SELECT c::DOUBLE AS cutoff, count(*) FILTER (evalue * 10 <= c) AS pairs FROM hits, (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) v(c) WHERE gaps <> 2 GROUP BY c"),
    "i11_move_features": "WITH " + _MOVED + " SELECT * FROM moved",
    "i12_normalize": with_views("features", "SELECT id, 'ITAG' AS source, CASE type WHEN 'F' THEN 'gene' ELSE 'transcript' END AS type, start, \"end\", 'LIB_' || id AS name, CASE substr(id, 2)::BIGINT % 3 WHEN 0 THEN 'LIB_' || id || ' ' || start || ' ' || \"end\" || ' +' WHEN 1 THEN 't 5 9 -' ELSE 't 5 9 +' END AS target FROM features"),
    "i11_invalid_families": "WITH RECURSIVE " + _MOVED + """, f AS (SELECT id, substr(id, 2)::BIGINT AS k, valid FROM moved), p AS (SELECT id, valid, CASE WHEN k % 16 = 0 THEN NULL WHEN k % 4 = 0 THEN 'F' || (k - k % 16) ELSE 'F' || (k - k % 4) END AS parent FROM f),
        up AS (SELECT id FROM p WHERE NOT valid UNION SELECT p.parent FROM p JOIN up USING (id) WHERE p.parent IS NOT NULL), down AS (SELECT id FROM up UNION SELECT p.id FROM p JOIN down ON p.parent = down.id) SELECT id FROM down""",
    "i11_region_lengths": with_views("features marks", "SELECT r.ref AS seqid, l + coalesce(sum(CASE WHEN m.start <= l THEN CASE WHEN m.start % 2 = 0 THEN 10 ELSE -3 END END), 0)::BIGINT AS length FROM (SELECT ref, max(\"end\") - 20000 AS l FROM features GROUP BY ref) r LEFT JOIN marks m USING (ref) GROUP BY r.ref, l"),
    "i13_edit_attributes": with_views("features", "SELECT id, replace('F' || substr(id, 3, 9), '7', 'seven') AS new_id, replace('gene ' || substr(id, 2), '7', 'seven') AS name FROM features"),
    "i13_sequence_regions": with_views("features marks", """WITH d AS (SELECT ref || (start % 3) AS seqid, 1 AS s, "end" - "end" % 20000 + 20000 AS e, substr(id, 2)::BIGINT AS line_no FROM features), q AS (SELECT DISTINCT ref || '1' AS seqid, 60000 AS e FROM marks),
        c AS (SELECT seqid, 1::BIGINT AS start, coalesce(q.e, f.e)::BIGINT AS e FROM (SELECT seqid, min_by(e, line_no) AS e FROM d GROUP BY seqid) f FULL JOIN q USING (seqid))
        SELECT c.seqid, c.start, c.e AS "end", count(*) FILTER (d.e <> c.e) AS conflicts FROM c LEFT JOIN d USING (seqid) GROUP BY ALL"""),
    "i13_unique_ids": with_views("features", "WITH m AS (SELECT *, substr(id, 2)::BIGINT AS k, row_number() OVER (PARTITION BY type = 'F', substr(id, 2)::BIGINT % 10 = 0 ORDER BY substr(id, 2)::BIGINT) AS lone FROM features), o AS (SELECT id, k, CASE WHEN k % 10 = 0 THEN ref || '_' || CASE type WHEN 'F' THEN 'gene' ELSE 'mRNA' END || '_' || lone ELSE 'F' || substr(id, 3, 9) END AS o FROM m), n AS (SELECT id, o, row_number() OVER (PARTITION BY o ORDER BY k) AS k FROM o) SELECT id, CASE WHEN k = 1 THEN o ELSE o || '_' || k END AS new_id FROM n"),
    "i14_mark_partial": with_views("features marks", "SELECT f.id, CASE WHEN m.id IS NOT NULL THEN CASE WHEN f.id LIKE '%5' THEN '5'',3''' ELSE '5''' END END AS partial FROM features f LEFT JOIN marks m ON replace(m.id, 'M', 'F') = f.id"),
    "i15_add_functions": with_views("features marks members_go", "SELECT f.id, coalesce(s.g, m.g) AS go_terms, CASE WHEN s.g IS NOT NULL THEN 'specific' WHEN m.g IS NOT NULL THEN 'general' END AS go_source, 'note ' || type AS note FROM features f LEFT JOIN (SELECT replace(member, 'V', 'F') AS id, string_agg(DISTINCT go_id, ',' ORDER BY go_id) AS g FROM members_go GROUP BY 1) s ON s.id = f.id LEFT JOIN (SELECT replace(id, 'M', 'F') AS id, 'GO:g' || (start % 5) AS g FROM marks) m ON m.id = f.id"),
    "i16_merge_builds": with_views("features", """WITH n AS (SELECT *, substr(id, 2)::BIGINT AS k, CASE type WHEN 'F' THEN 'gene' ELSE 'mRNA' END AS t FROM features),
        up AS (SELECT DISTINCT k - k % 8 AS locus FROM n WHERE k % 2 = 1 AND k % 3 > 0 AND k % 16 < 8),
        r AS (SELECT id, k, CASE WHEN k % 8 = 1 THEN 'exon' ELSE t END AS t, start, "end", 'new' AS source, CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END AS v, id AS name, CASE WHEN k % 3 > 0 THEN 'n' END AS note FROM n WHERE k % 2 = 1
        UNION ALL SELECT id, k, t, start, "end", 'old', 2, 'old', 'n' FROM n WHERE k % 2 = 0 AND k % 3 > 0)
        SELECT id, start, "end", source, (v + CASE WHEN k - k % 8 IN (SELECT locus FROM up) THEN 1 ELSE 0 END)::BIGINT AS version, CASE WHEN t = 'exon' THEN 1 ELSE 0 END AS place, name, note FROM r"""),
    "i17_spliced": with_views("hits seqs", "WITH " + _MODEL + """, p AS (SELECT parent, strand, s, substr(seq, s, 21) AS piece FROM m JOIN seqs ON seqs.id = substr(parent, 2) WHERE type = 'exon'),
        j AS (SELECT parent, strand, string_agg(piece, '' ORDER BY s, piece) AS q, string_agg(s || '..' || (s + 20), ',' ORDER BY s) AS regions FROM p GROUP BY ALL)
        SELECT parent, CASE strand WHEN '-' THEN reverse(translate(q, 'ACGTacgt', 'TGCAtgca')) ELSE q END AS seq, regions FROM j"""),
    "i17_proteins": with_views("hits seqs", "WITH " + _MODEL + """, p AS (SELECT parent, strand, s, substr(seq, s, 21) AS piece FROM m JOIN seqs ON seqs.id = substr(parent, 2)),
        j AS (SELECT parent, strand, string_agg(piece, '' ORDER BY s, piece) AS q, string_agg(s || '..' || (s + 20), ',' ORDER BY s) AS regions FROM p GROUP BY ALL),
        k AS (SELECT parent, CASE strand WHEN '-' THEN reverse(translate(q, 'ACGTacgt', 'TGCAtgca')) ELSE q END AS seq, regions FROM j)
        SELECT parent, regexp_replace(""" + peptide_sql("seq") + r""", '\*$', '') AS protein, regions FROM k"""),
    "i18_rebuild_models": with_views("hits", """WITH h AS (SELECT query_id || '.1.1' AS parent, mismatches AS m, CASE WHEN length(query_id) % 2 = 0 THEN '-' ELSE '+' END AS strand, CASE WHEN mismatches = 2 THEN mismatches * 100 + gaps * 30 ELSE mismatches * 100 END AS s, gaps FROM hits),
        f AS (SELECT parent, strand, CASE m WHEN 2 THEN 'CDS' WHEN 6 THEN 'intron' ELSE 'exon' END AS type, s, s + CASE WHEN m = 2 THEN 75 + gaps * 20 ELSE 60 END AS e FROM h),
        c AS (SELECT parent, strand, s, e FROM f WHERE type = 'CDS'), x AS (SELECT DISTINCT parent, strand, s, e FROM f WHERE type = 'exon'),
        y AS (SELECT *, lead(s) OVER (PARTITION BY parent ORDER BY s, e) AS nx FROM x),
        z AS (SELECT y.*, nx IS NOT NULL AND EXISTS (SELECT 1 FROM c WHERE c.parent = y.parent AND (y.e + 1 BETWEEN c.s AND c.e OR y.nx - 1 BETWEEN c.s AND c.e)) AS closed FROM y),
        g AS (SELECT *, coalesce(lag(closed) OVER (PARTITION BY parent ORDER BY s, e), false) AS on_ FROM z),
        r AS (SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY parent ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM g),
        ex AS (SELECT parent, strand, min(s) AS s, max(e) AS e FROM r GROUP BY parent, strand, run), sp AS (SELECT parent, min(s) AS cs, max(e) AS ce FROM c GROUP BY parent),
        u AS (SELECT ex.parent, strand, 'l' AS side, s, least(e, cs - 1) AS e FROM ex JOIN sp USING (parent) UNION ALL SELECT ex.parent, strand, 'r', greatest(s, ce + 1), e FROM ex JOIN sp USING (parent)),
        o AS (SELECT parent, 'exon' AS type, s, e FROM ex UNION ALL SELECT parent, 'CDS', s, e FROM c UNION ALL SELECT parent, CASE WHEN (side = 'l') = (strand <> '-') THEN 'five_prime_UTR' ELSE 'three_prime_UTR' END, s, e FROM u WHERE s <= e)
        SELECT replace(parent, '.1.1', '.2.1') AS parent, type, s::BIGINT AS start, e::BIGINT AS "end" FROM o"""),
    "i18_recalc_utrs": with_views("hits", "WITH " + _MODEL + """, c AS (SELECT parent, min(s) AS cs, max(e) AS ce FROM m WHERE type = 'CDS' GROUP BY parent), x AS (SELECT m.*, cs, ce FROM m JOIN c USING (parent) WHERE type = 'exon'),
        u AS (SELECT parent, strand, 'l' AS side, s AS a, least(e, cs - 1) AS b FROM x UNION ALL SELECT parent, strand, 'r', greatest(s, ce + 1), e FROM x)
        SELECT parent, CASE WHEN (side = 'l') = (strand <> '-') THEN 'five_prime_UTR' ELSE 'three_prime_UTR' END AS type, a AS start, b AS "end" FROM u WHERE a <= b"""),
    "i19_trim_models": with_views("hits", "WITH " + _MODEL + """, g AS (SELECT parent, strand, min(s) AS s, max(e) AS e FROM m GROUP BY ALL), t AS (SELECT *, ((s % 40 + 2) // 3) * 3 AS f, e % 30 AS h FROM g),
        w AS (SELECT parent, s + CASE strand WHEN '-' THEN h ELSE f END AS a, e - CASE strand WHEN '-' THEN f ELSE h END AS b, f > 0 OR h > 0 AS cut FROM t), r AS (SELECT parent, type, s, e FROM m UNION ALL SELECT parent, 'gene', s, e FROM g)
        SELECT parent AS gene, type, CASE WHEN cut THEN greatest(s, a) ELSE s END AS start, CASE WHEN cut THEN least(e, b) ELSE e END AS "end" FROM r JOIN w USING (parent) WHERE NOT cut OR greatest(s, a) < least(e, b)"""),
}
