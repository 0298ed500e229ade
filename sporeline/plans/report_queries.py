"""Queries over annotation, expression, warehouse and variant tables (A, E, W, V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sporeline.operators import annotation as A
from sporeline.operators import expression as E
from sporeline.operators import variants as V
from sporeline.operators import warehouse as W
from sporeline.plans.adapters import view, with_views


def a1_domains_to_go(spark, d):
    return A.domains_to_go(view(spark, d, "domains"), ["A", "R"], 20, 0.05)


def a1_domains_to_go_wide(spark, d):
    return A.domains_to_go(view(spark, d, "domains"), layout="wide")


def _terms(spark, d):
    v = view(spark, d, "domains")
    return v.groupBy("method", F.expr("cast(substring(id, length(id), 1) as int)").alias("k")).agg(F.count("*").alias("n"))


def a2_go_distribution(spark, d):
    t = _terms(spark, d).select(F.col("method").alias("sample"), F.concat(F.lit("GO:"), "k").alias("term"), (F.col("k") % 2).alias("level"), "n")
    return A.go_distribution(t.where("sample = 'N'"), t.where("sample <> 'N' AND term <> 'GO:3'"), 1, 5)


def a2_go_table(spark, d):
    return A.go_table(a2_go_distribution(spark, d), ["reference", "A", "R"])


def a3_family_go(spark, d):
    return A.family_go(view(spark, d, "members"), view(spark, d, "members_go"))


def a4_merge_notes(spark, d):
    return A.merge_notes(view(spark, d, "hits").select(F.col("query_id").alias("feature_id"), F.col("line_no").alias("note_id"), F.col("subject_id").alias("note")))


def a5_defline_annotations(spark, d):
    s = view(spark, d, "subjects")
    sym = F.when(F.col("subject_length") % 20 == 0, F.concat(F.lit(" | Symbols: "), "subject_id", F.lit(", X"), (F.col("subject_length") % 7).cast("string"))).otherwise("")
    return A.parse_defline_annotations(s.select(F.concat(F.lit(">"), "subject_id", sym, F.lit(" | "), "description", F.lit(" | chr1")).alias("value")))


def a6_add_synonyms(spark, d):
    f = view(spark, d, "features").select(F.substring("id", 1, 4).alias("name"), "type", F.col("id").alias("feature_id"))
    names = view(spark, d, "marks").select(F.regexp_replace(F.substring("id", 1, 4), "M", "F").alias("name"), F.col("id").alias("synonym"))
    return A.add_synonyms(names, f, "F")


def a7_derive_polypeptides(spark, d):
    f = view(spark, d, "features").select(F.col("id").alias("feature_id"), F.concat(F.lit("mRNA:"), "id").alias("name"), F.when(F.col("type") == "F", "mRNA").otherwise("gene").alias("type"), F.col("ref").alias("seqid"), "start", "end")
    r = view(spark, d, "marks").select(F.regexp_replace("id", "M", "F").alias("object_id"), F.lit("derives_from").alias("type"))
    return A.derive_polypeptides(f, r)


def _composition(spark, d):
    v = view(spark, d, "contig_reads")
    return E.library_composition(v.select("contig_id", "read_id"), v.select("read_id", "library", "line_no"))


def e1_library_composition(spark, d):
    return _composition(spark, d).withColumn("ppm", F.round("ppm", 3))


def e1_rpkm(spark, d):
    v = view(spark, d, "contig_reads")
    out = E.library_composition(v.select("contig_id", "read_id"), v.select("read_id", "library", "line_no"), view(spark, d, "contig_lengths"))
    return out.withColumn("rpkm", F.round("rpkm", 3))


def e2_stekel_r(spark, d):
    v = view(spark, d, "contig_reads")
    return E.stekel_r(E.library_counts(v, v.select("read_id", "library", "line_no"))).withColumn("r", F.round("r", 4))


def e3_strain_expression(spark, d):
    counts = view(spark, d, "contig_reads").groupBy("contig_id", "library").agg(F.count("*").alias("n"))
    lengths = view(spark, d, "contig_lengths")
    strains = lengths.select("contig_id", F.concat(F.lit("R"), F.substring("contig_id", 2, 2)).alias("reference"), F.concat(F.lit("st"), (F.col("length") / 100 % 5).cast("int")).alias("strain"))
    return E.strain_expression(counts, lengths, strains).withColumn("rpkm", F.round("rpkm", 3))


def _strain_contigs(spark, d):
    counts = view(spark, d, "contig_reads").groupBy("contig_id", "library").agg(F.count("*").alias("n"))
    lengths = view(spark, d, "contig_lengths")
    reference = F.concat(F.lit("R"), F.substring("contig_id", 2, 2))
    placed = lengths.select("contig_id", reference.alias("reference"), F.concat(F.lit("st"), (F.col("length") / 100 % 5).cast("int")).alias("strain"))
    return E.strain_contigs(counts, lengths.groupBy(reference.alias("reference")).agg(F.max("length").alias("length")), placed)


def e3_strain_contigs(spark, d):
    return _strain_contigs(spark, d).withColumns({"rpkm": F.round("rpkm", 3), "r": F.round("r", 3)})


def e3_dominant_contigs(spark, d):
    return E.dominant_contigs(_composition(spark, d), 0.0009).withColumn("share", F.round("share", 6))


def e4_replicate_stats(spark, d):
    out = E.replicate_stats(view(spark, d, "signals"))
    return out.select("template", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "sd", "cv")])


def e5_read_placement(spark, d):
    r = view(spark, d, "reads")
    key = F.col("read_id").cast("string")
    lib = r.select(key.alias("read_id"), F.col("status").alias("library"))
    s1 = r.where("read_id % 3 > 0").select(key.alias("id"), F.concat(F.lit("c1_"), F.col("read_id") % 97).alias("contig"))
    s2 = s1.where("contig like '%1%'").select(F.col("contig").alias("id"), F.concat(F.lit("step2_"), "contig").alias("contig")).distinct()
    s3 = s2.where("id like '%2%'").select("id", F.concat(F.lit("c3_"), "id").alias("contig"))
    al = s3.where("id like '%12%'").select("contig", F.lit("allele").alias("allele"), F.col("id").alias("note"))
    return E.read_placement(lib, s1, s2, s3, al)


def w1_contig_summary(spark, d):
    return W.contig_summary(_trimmed_reads(spark, d))


def _trimmed_reads(spark, d):
    trims = {"start_trim": F.col("start") % 7, "end_trim": F.col("span") % 5, "orient": F.when(F.col("span") % 2 == 0, "+").otherwise("-")}
    return view(spark, d, "contig_reads").withColumns(trims)


def w1_contig_read_list(spark, d):
    return W.contig_read_list(_trimmed_reads(spark, d))


def _named_reads(spark, d):
    rows = view(spark, d, "contig_reads").withColumn("name", F.concat(F.lit("r_"), F.lower("library"), F.lit("."), "read_id"))
    return W.named_libraries(rows, "_(AF|NO|RF)").withColumn("library", F.upper("library"))


def w2_library_mix(spark, d):
    return W.library_mix_stats(_named_reads(spark, d), view(spark, d, "contig_lengths"))


def w2_library_reads(spark, d):
    lone = view(spark, d, "clones").select(F.col("clone_id").alias("read_id"), (F.col("clone_id") % 700).alias("span"))
    return W.library_reads(_named_reads(spark, d), lone)


def w3_build_overlap(spark, d):
    return W.build_overlap(view(spark, d, "old_builds"), view(spark, d, "new_builds"))


def w3_split_clusters(spark, d):
    return W.split_clusters(W.build_overlap(view(spark, d, "old_builds"), view(spark, d, "new_builds")))


def w3_dropped_members(spark, d):
    return W.dropped_members(view(spark, d, "old_builds"), view(spark, d, "new_builds"))


def w4_version_map(spark, d):
    return W.version_map(view(spark, d, "reads"), {"old": view(spark, d, "old_builds"), "new": view(spark, d, "new_builds")})


def w5_membership_map(spark, d):
    chain = [(view(spark, d, "libraries"), ""), (view(spark, d, "clones"), "library_id"), (view(spark, d, "reads"), "clone_id"), (view(spark, d, "ests").where("flags = 0").drop("status"), "read_id")]
    return W.membership_map(chain, ["name", "clone_name", "read_id", "est_id", "unigene_id"], "left").where(F.col("name").ilike("%1%"))


def w6_unigene_dump(spark, d):
    s = view(spark, d, "seqs").select(F.col("line_no").alias("unigene_id"), "seq")
    single = s.where("unigene_id % 2 = 1").withColumns({"begin": F.lit(5), "length": F.lit(50)})
    notes = s.where("unigene_id % 3 = 0").select("unigene_id", F.concat(F.lit("hit "), F.col("unigene_id").cast("string")).alias("note"))
    return W.unigene_dump(s.where("unigene_id % 2 = 0"), single, notes).select("unigene_id", F.md5("seq").alias("md5"), "note")


def w7_organism_report(spark, d):
    return W.organism_report(*[view(spark, d, n) for n in ("organisms", "libraries", "clones", "reads", "ests")])


def w8_build_report(spark, d):
    m = view(spark, d, "ests").select((F.col("read_id") % 4).alias("build"), "unigene_id")
    cds = view(spark, d, "cds").select("unigene_id", (F.col("length") > 30).alias("domain"))
    return W.build_report(m, cds, view(spark, d, "cds").where("length < 2"))


def w8_annotated_by_target(spark, d):
    m = view(spark, d, "ests").select((F.col("read_id") % 4).alias("build"), "unigene_id")
    hits = view(spark, d, "hits").select(F.regexp_replace("subject_id", "S", "").cast("long").alias("unigene_id"), F.when(F.col("gaps") == 0, "ath").when(F.col("gaps") == 1, "gb").otherwise("swp").alias("target"), "pident")
    return W.annotated_by_target(m, hits.where("pident > 90"))


def w9_integrity(spark, d):
    o, li, c, r, e = (view(spark, d, n) for n in ("organisms", "libraries", "clones", "reads", "ests"))
    return W.integrity_check([("organism", o, li, "organism_id"), ("library", li, c, "library_id"), ("clone", c, r, "clone_id"), ("read", r, e, "read_id")])


def w9_field_gaps(spark, d):
    rows = view(spark, d, "pedigrees").withColumn("extra", F.when(F.length("pedigree") % 3 == 0, F.lit(None)).when(F.length("pedigree") % 3 == 1, "  ").otherwise("x"))
    return W.field_gaps("clone", rows, ["accession", "pedigree", "extra"])


def w9_status_counts(spark, d):
    return W.status_counts(view(spark, d, "ests"))


def w10_preferred_protein(spark, d):
    return W.preferred_protein(view(spark, d, "cds"))


def w11_map_accessions(spark, d):
    c = view(spark, d, "clones")
    g = c.select(F.concat(F.lit("AC"), "clone_id").alias("accession"), (F.col("clone_id") % 3).alias("version"), F.concat(F.lit("LOC"), "clone_id").alias("locus"), F.col("clone_id").alias("primary_id"), F.col("library_id").cast("string").alias("library"), F.col("clone_name").alias("clone"))
    k = F.col("clone_id") % 7
    name = F.when(k == 0, F.concat(F.lit("AC"), "clone_id", F.lit("."), F.col("clone_id") % 3)).when(k == 1, F.concat(F.lit("AC"), "clone_id")).when(k == 2, F.concat(F.lit("LOC"), "clone_id")).when(k == 3, F.col("clone_id").cast("string")).when(k == 4, F.col("clone_name")).when(k == 5, F.concat(F.col("library_id").cast("string"), F.lit("-"), "clone_name")).otherwise("none")
    return W.map_accessions(c.select("clone_id", name.alias("name")), g)


def w11_partial(spark, d):
    c = view(spark, d, "clones")
    g = c.where("clone_id % 2 = 0").select(F.concat(F.lit("AC"), "clone_id").alias("accession"), F.concat(F.lit("lib-"), "clone_name").alias("clone"))
    return W.map_accessions_partial(c.select("clone_id", F.upper("clone_name").alias("name")), g, 12)


def w12_rewrite_paths(spark, d):
    return W.rewrite_paths(view(spark, d, "clones").select("clone_id", F.concat(F.when(F.col("clone_id") % 2 == 0, "/data/").otherwise("/database/"), "clone_name").alias("path")))


def _refresh(spark, d):
    s = view(spark, d, "seqs").select(F.col("id").alias("read"), F.concat(F.lit("GB"), "id").alias("gb"), F.md5("seq").alias("seq"), F.lit("q").alias("qual"))
    u = s.where("length(read) < 3").select(F.lit("gb").alias("kind"), F.col("gb").alias("id"), F.lit("NEW1").alias("seq"), F.lit("n1").alias("qual")).union(
        s.where("read like '1%'").select(F.lit("read"), F.concat("read", F.when(F.col("read") > "15", "x").otherwise("")), F.lit("NEW2"), F.lit("n2"))
    )
    return W.refresh_sequences(s, u, {"gb": F.col("gb"), "read": F.col("read")})


def w13_refresh_sequences(spark, d):
    return _refresh(spark, d)[0]


def w13_unmatched(spark, d):
    return _refresh(spark, d)[1].select("kind", "id", "seq", "qual")


def w14_library_rollup(spark, d):
    return W.library_rollup(view(spark, d, "contig_reads").select(F.col("contig_id").alias("library"), F.col("library").alias("organism")), 6)


def _snp_reads(spark, d):
    h = view(spark, d, "hits")
    reads = h.select(F.col("subject_id").alias("contig_id"), F.col("line_no").alias("read_id"), F.concat(F.lit("s"), "gaps").alias("strain"), F.col("q_start").alias("start"), (F.col("q_start") + 27).alias("end"), F.expr("concat(repeat('ACGT', cast(mismatches as int)), 'ACGTTGCAACGTTGCAACGTTGCAACGT')").alias("seq"))
    snps = h.select(F.col("subject_id").alias("contig_id"), (F.col("q_start") + 5).alias("pos")).distinct()
    return V.snp_reads(snps, reads)


def v1_snp_reads(spark, d):
    return _snp_reads(spark, d)


def v2_snp_by_strain(spark, d):
    return V.snp_by_strain(_snp_reads(spark, d))


def v3_snp_similarity(spark, d):
    return V.snp_similarity(_snp_reads(spark, d), ["s0", "s1"], "s2")


def v4_filter_genotypes(spark, d):
    return V.filter_genotypes(view(spark, d, "variants"), {"S1": "AA", "S2": "BC"}).select("seq_id", "pos", "genotypes")


def v4_filter_haploid(spark, d):
    return V.filter_genotypes(view(spark, d, "variants"), {"S1": "AB", "S2": "BC"}, ploidy=1).select("seq_id", "pos", "genotypes")


def v5_variant_density(spark, d):
    return V.variant_density(view(spark, d, "variants"), view(spark, d, "seqs")).withColumns({c: F.round(c, 6) for c in ("gc", "changes_per_100", "snps_per_100", "indels_per_100")})


def v6_allele_spectrum(spark, d):
    return V.allele_spectrum(view(spark, d, "variants"))


def v6_base_totals(spark, d):
    return V.base_totals(view(spark, d, "seqs"))


def v7_genotype_json(spark, d):
    return V.genotype_json(view(spark, d, "genotypes"))


def v7_match_accessions(spark, d):
    c = view(spark, d, "clones")
    stocks = c.select(F.concat(F.lit("STOCK"), F.col("clone_id") % 900).alias("name"), F.col("clone_id").alias("stock_id"))
    syn = c.where("clone_id % 4 = 0").select(F.concat(F.lit("syn"), F.col("clone_id").cast("string")).alias("synonym"), F.col("clone_id").alias("stock_id"))
    acc = c.select(F.when(F.col("clone_id") % 2 == 0, F.concat(F.lit("Syn"), "clone_id")).otherwise(F.concat(F.lit("stock"), "clone_id")).alias("accession"))
    return V.match_accessions(acc, stocks, syn)


def v8_pedigree_parents(spark, d):
    return V.pedigree_parents(view(spark, d, "pedigrees"))


def v9_missing_accessions(spark, d):
    return V.missing_accessions(view(spark, d, "pedigrees"), view(spark, d, "stocks"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "aewv" and k[1].isdigit() and callable(v)}

_COMP = """f AS (SELECT read_id, min_by(library, line_no) AS library FROM contig_reads GROUP BY read_id),
c AS (SELECT contig_id, f.library, count(*) AS n FROM contig_reads JOIN f USING (read_id) GROUP BY ALL), t AS (SELECT library, sum(n)::BIGINT AS total FROM c GROUP BY library),
g AS (SELECT k.contig_id, t.library, t.total, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT contig_id FROM c) k CROSS JOIN t LEFT JOIN c ON c.contig_id = k.contig_id AND c.library = t.library)"""
_GO = r"""x AS (SELECT DISTINCT id, regexp_extract(g, '^([^:]+): (.*) \((GO:\d+)\)$', 1) AS ontology, regexp_extract(g, '^([^:]+): (.*) \((GO:\d+)\)$', 3) AS go_id, regexp_extract(g, '^([^:]+): (.*) \((GO:\d+)\)$', 2) AS term
FROM (SELECT id, unnest(string_split(go, '; ')) AS g FROM domains {w}))"""
_SNP = """rd AS (SELECT subject_id AS contig_id, line_no AS read_id, 's' || gaps AS strain, q_start AS s, repeat('ACGT', mismatches) || 'ACGTTGCAACGTTGCAACGTTGCAACGT' AS seq FROM hits),
sn AS (SELECT DISTINCT subject_id AS contig_id, q_start + 5 AS pos FROM hits),
sr AS (SELECT contig_id, pos, read_id, strain, substr(seq, pos - s + 1, 1) AS base FROM sn JOIN rd USING (contig_id) WHERE pos BETWEEN s AND s + 27)"""
_SIG = "CASE WHEN {x} = 0 THEN 0 ELSE round(round({x} * 10.0::DOUBLE ^ (2 - floor(log10({x})))) / 10.0::DOUBLE ^ (2 - floor(log10({x}))), 6) END"
_COUNTS = "(SELECT count(*) FROM {p}) AS parents, (SELECT count(*) FROM {p} p WHERE NOT EXISTS (SELECT 1 FROM {c} c WHERE c.{k} = p.{k})) AS childless"

SQL = {
    "a1_domains_to_go": with_views("domains", "WITH " + _GO.format(w="WHERE method IN ('A', 'R') AND \"end\" - start >= 20 AND evalue <= 0.05") + " SELECT * FROM x"),
    "a1_domains_to_go_wide": with_views("domains", "WITH " + _GO.format(w="") + " SELECT id, string_agg(go_id, ',' ORDER BY CASE ontology WHEN 'Biological Process' THEN 0 WHEN 'Molecular Function' THEN 1 ELSE 2 END, go_id) AS go_ids FROM x GROUP BY id"),
    "a2_go_distribution": with_views(
        "domains",
        """WITH t AS (SELECT method AS sample, right(id, 1)::INTEGER AS k, count(*) AS n FROM domains GROUP BY ALL), r AS (SELECT CASE sample WHEN 'N' THEN 'reference' ELSE sample END AS sample, k, n FROM t WHERE sample = 'N' OR k <> 3),
        tot AS (SELECT sample, sum(n) AS total FROM r GROUP BY sample), w AS (SELECT k FROM r WHERE sample = 'reference' AND k % 2 = 1 AND n >= 5)
        SELECT tot.sample, 'GO:' || w.k AS term, round(100.0::DOUBLE * coalesce(r.n, 0) / total, 4) AS percent FROM tot CROSS JOIN w LEFT JOIN r ON r.sample = tot.sample AND r.k = w.k AND r.n >= 5""",
    ),
    "a3_family_go": with_views("members members_go", "SELECT family, string_agg(DISTINCT go_id, ',' ORDER BY go_id) AS go_ids, count(DISTINCT member) AS n_members FROM members JOIN members_go USING (member) GROUP BY family"),
    "a4_merge_notes": with_views("hits", "SELECT query_id AS feature_id, string_agg(subject_id, ', ' ORDER BY line_no) AS note FROM hits GROUP BY query_id HAVING count(*) > 1"),
    "a5_defline_annotations": with_views("subjects", "SELECT subject_id AS id, unnest(['' || subject_id, 'X' || (subject_length % 7)]) AS alias, description FROM subjects WHERE subject_length % 20 = 0 UNION ALL SELECT subject_id, NULL, description FROM subjects WHERE subject_length % 20 <> 0"),
    "a6_add_synonyms": with_views("features marks", """WITH f AS (SELECT substr(id, 1, 4) AS name, count(*) AS n, min(id) AS i FROM features WHERE type = 'F' GROUP BY 1)
        SELECT replace(substr(m.id, 1, 4), 'M', 'F') AS name, m.id AS synonym, CASE WHEN n = 1 THEN i END AS feature_id, CASE WHEN n IS NULL THEN 'not found' WHEN n > 1 THEN 'multiple' ELSE 'found' END AS status FROM marks m LEFT JOIN f ON f.name = replace(substr(m.id, 1, 4), 'M', 'F')"""),
    "a7_derive_polypeptides": with_views("features marks", """SELECT 'polypeptide:' || id AS name, 'polypeptide' AS type, ref AS seqid, start, "end", id AS derives_from FROM features WHERE type = 'F' AND replace(id, 'F', 'M') NOT IN (SELECT id FROM marks)"""),
    "e1_library_composition": with_views("contig_reads", "WITH " + _COMP + " SELECT contig_id, library, n, total, round(n * 1e6::DOUBLE / total, 3) AS ppm FROM g"),
    "e1_rpkm": with_views("contig_reads contig_lengths", "WITH " + _COMP + " SELECT contig_id, library, n, total, round(n * 1e9::DOUBLE / (total * length), 3) AS rpkm FROM g JOIN contig_lengths USING (contig_id)"),
    "e2_stekel_r": with_views("contig_reads", "WITH " + _COMP + """, v AS (SELECT min(t) >= 51 AND max(s) <= 0.2 AS ok FROM (SELECT max(total) AS t, max(n::DOUBLE / total) AS s FROM g GROUP BY library)), w AS (SELECT sum(total) AS whole FROM t), x AS (SELECT contig_id, sum(n) AS x FROM g GROUP BY contig_id)
        SELECT contig_id, CASE WHEN ok THEN round(r, 4) END AS r FROM (SELECT contig_id, sum(n * log10(n / (total::DOUBLE * x / whole))) AS r FROM g JOIN x USING (contig_id), w WHERE n > 0 GROUP BY contig_id), v"""),
    "e3_strain_expression": with_views("contig_reads contig_lengths", """WITH c AS (SELECT contig_id, library, count(*) AS n FROM contig_reads GROUP BY ALL), t AS (SELECT library, sum(n) AS total FROM c GROUP BY library),
        s AS (SELECT contig_id, length, 'R' || substr(contig_id, 2, 2) AS reference, 'st' || ((length // 100) % 5) AS strain FROM contig_lengths),
        p AS (SELECT reference, strain, sum(n)::BIGINT AS n, round(avg(n * 1e9::DOUBLE / (total * length)), 3) AS rpkm FROM c JOIN t USING (library) JOIN s USING (contig_id) GROUP BY ALL)
        SELECT r.reference, x.strain, p.n, p.rpkm FROM (SELECT DISTINCT reference FROM s) r CROSS JOIN (SELECT DISTINCT strain FROM s) x LEFT JOIN p ON p.reference = r.reference AND p.strain = x.strain"""),
    "e3_strain_contigs": with_views("contig_reads contig_lengths", """WITH c AS (SELECT contig_id, library, count(*) AS n FROM contig_reads GROUP BY ALL), t AS (SELECT library, sum(n)::BIGINT AS total FROM c GROUP BY library),
        s AS (SELECT contig_id, 'R' || substr(contig_id, 2, 2) AS reference, 'st' || ((length // 100) % 5) AS strain FROM contig_lengths), l AS (SELECT 'R' || substr(contig_id, 2, 2) AS reference, max(length) AS length FROM contig_lengths GROUP BY 1),
        w AS (SELECT * FROM c JOIN s USING (contig_id) JOIN l USING (reference) JOIN t USING (library)), p AS (SELECT reference, strain, sum(n) AS n FROM w GROUP BY ALL),
        r AS (SELECT reference, sum(p.n * log10(p.n::DOUBLE / sn / (rn::DOUBLE / whole))) AS r FROM p JOIN (SELECT strain, sum(n) AS sn FROM p GROUP BY 1) USING (strain) JOIN (SELECT reference, sum(n) AS rn FROM p GROUP BY 1) USING (reference), (SELECT sum(n) AS whole FROM p) GROUP BY reference)
        SELECT reference, strain, contig_id, library, n, total, round(n * 1e9::DOUBLE / (total * length), 3) AS rpkm, round(r, 3) AS r FROM w JOIN r USING (reference)
        UNION ALL SELECT x.reference, y.strain, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT reference FROM w) x CROSS JOIN (SELECT DISTINCT strain FROM w) y WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.reference = x.reference AND p.strain = y.strain)"""),
    "a2_go_table": with_views(
        "domains",
        """WITH t AS (SELECT method AS sample, right(id, 1)::INTEGER AS k, count(*) AS n FROM domains GROUP BY ALL), r AS (SELECT CASE sample WHEN 'N' THEN 'reference' ELSE sample END AS sample, k, n FROM t WHERE sample = 'N' OR k <> 3),
        tot AS (SELECT sample, sum(n) AS total FROM r GROUP BY sample), w AS (SELECT k FROM r WHERE sample = 'reference' AND k % 2 = 1 AND n >= 5),
        p AS (SELECT tot.sample, 'GO:' || w.k AS term, round(100.0::DOUBLE * coalesce(r.n, 0) / total, 4) AS percent FROM tot CROSS JOIN w LEFT JOIN r ON r.sample = tot.sample AND r.k = w.k AND r.n >= 5)
        SELECT term, max(percent) FILTER (sample = 'reference') AS reference, max(percent) FILTER (sample = 'A') AS "A", max(percent) FILTER (sample = 'R') AS "R" FROM p GROUP BY term""",
    ),
    "e3_dominant_contigs": with_views("contig_reads", "WITH " + _COMP + " SELECT contig_id, library, round(n::DOUBLE / total, 6) AS share FROM g WHERE n::DOUBLE / total > 0.0009"),
    "e4_replicate_stats": with_views("signals", "SELECT template, count(signal) AS n, round(avg(signal), 4) AS mean, round(quantile_cont(signal, 0.5), 4) AS median, round(stddev_samp(signal), 4) AS sd, round(CASE WHEN avg(signal) > 0 THEN stddev_samp(signal) / avg(signal) END, 4) AS cv FROM signals GROUP BY template"),
    "e5_read_placement": with_views("reads", """WITH p AS (SELECT read_id::VARCHAR AS read_id, status AS library, CASE WHEN read_id % 3 > 0 THEN 'c1_' || (read_id % 97) END AS s1 FROM reads),
        q AS (SELECT *, CASE WHEN s1 LIKE '%1%' THEN 'step2_' || s1 END AS s2 FROM p), r AS (SELECT *, CASE WHEN s2 IS NOT NULL AND s1 LIKE '%2%' THEN 'c3_' || s1 END AS s3 FROM q)
        SELECT read_id, coalesce(library, 'NA') AS library, coalesce(s1, 'NA') AS step1, coalesce(s2, 'NA') AS step2, coalesce(s3, 'NA') AS step3, CASE WHEN s3 LIKE '%12%' THEN 'allele' ELSE 'NA' END AS allele, CASE WHEN s3 LIKE '%12%' THEN s1 ELSE 'NA' END AS note FROM r"""),
    "w1_contig_summary": with_views("contig_reads", "SELECT contig_id, count(*) AS reads, least(min(start - start % 7), 0) AS first, max(start + span + span % 5) AS last, max(start + span) AS trimmed_end, max(start + span + span % 5) - least(min(start - start % 7), 0) AS span FROM contig_reads GROUP BY contig_id"),
    "w1_contig_read_list": with_views("contig_reads", """SELECT contig_id, row_number() OVER (PARTITION BY contig_id ORDER BY start, read_id) AS place, read_id, CASE WHEN span % 2 = 0 THEN '+' ELSE '-' END AS orient, start, start + span AS "end", start % 7 AS start_trim, span % 5 AS end_trim FROM contig_reads"""),
    "w2_library_mix": with_views("contig_reads contig_lengths", "WITH c AS (SELECT contig_id, coalesce(string_agg(DISTINCT library, '-' ORDER BY library) FILTER (library IN ('AF', 'NO', 'RF')), '') AS libraries, count(*) AS n, sum(span) AS b FROM contig_reads GROUP BY contig_id) SELECT libraries, count(*) AS contigs, sum(length)::BIGINT AS contig_bases, sum(n)::BIGINT AS reads, sum(b)::BIGINT AS read_bases FROM c LEFT JOIN contig_lengths USING (contig_id) GROUP BY libraries"),
    "w2_library_reads": with_views("contig_reads clones", "SELECT CASE WHEN library IN ('AF', 'NO', 'RF') THEN library ELSE 'unmatched' END AS library, count(*) AS reads, sum(span)::BIGINT AS bases FROM contig_reads GROUP BY 1 UNION ALL SELECT 'singletons', count(DISTINCT clone_id), sum(clone_id % 700)::BIGINT FROM clones"),
    "w3_build_overlap": with_views("old_builds new_builds", "SELECT o.cluster_id AS old_cluster, n.cluster_id AS new_cluster, count(*) AS shared, max(os.s) AS old_size, max(ns.s) AS new_size FROM old_builds o JOIN new_builds n USING (member_id) JOIN (SELECT cluster_id, count(*) AS s FROM old_builds GROUP BY 1) os ON os.cluster_id = o.cluster_id JOIN (SELECT cluster_id, count(*) AS s FROM new_builds GROUP BY 1) ns ON ns.cluster_id = n.cluster_id GROUP BY ALL"),
    "w3_split_clusters": with_views("old_builds new_builds", "SELECT o.cluster_id AS old_cluster, count(DISTINCT n.cluster_id) AS parts FROM old_builds o JOIN new_builds n USING (member_id) GROUP BY 1 HAVING parts > 1"),
    "w3_dropped_members": with_views("old_builds new_builds", "SELECT member_id, cluster_id FROM old_builds WHERE member_id NOT IN (SELECT member_id FROM new_builds)"),
    "w4_version_map": with_views("reads old_builds new_builds", "SELECT read_id, coalesce(o.c, 'absent') AS old, coalesce(n.c, 'absent') AS new FROM reads LEFT JOIN (SELECT member_id, min(cluster_id)::VARCHAR AS c FROM old_builds GROUP BY 1) o ON o.member_id = read_id LEFT JOIN (SELECT member_id, min(cluster_id)::VARCHAR AS c FROM new_builds GROUP BY 1) n ON n.member_id = read_id"),
    "w5_membership_map": with_views("libraries clones reads ests", "SELECT name, clone_name, read_id, est_id, unigene_id FROM libraries LEFT JOIN clones USING (library_id) LEFT JOIN reads USING (clone_id) LEFT JOIN (SELECT * FROM ests WHERE flags = 0) e USING (read_id) WHERE name ILIKE '%1%'"),
    "w6_unigene_dump": with_views("seqs", "SELECT line_no AS unigene_id, md5(CASE WHEN line_no % 2 = 0 THEN seq ELSE substr(seq, 6, 50) END) AS md5, CASE WHEN line_no % 3 = 0 THEN 'hit ' || line_no END AS note FROM seqs"),
    "w7_organism_report": with_views("organisms libraries clones reads ests", "SELECT organism, count(DISTINCT library_id) AS libraries, count(DISTINCT clone_id) AS clones, count(DISTINCT read_id) AS reads, count(DISTINCT est_id) AS ests FROM organisms LEFT JOIN libraries USING (organism_id) LEFT JOIN clones USING (library_id) LEFT JOIN reads USING (clone_id) LEFT JOIN ests USING (read_id) GROUP BY organism"),
    "w8_build_report": with_views("ests cds", "WITH p AS (SELECT read_id % 4 AS build, unigene_id, count(*) AS n FROM ests GROUP BY ALL) SELECT build, count(*) AS unigenes, sum(n)::BIGINT AS members, count(*) FILTER (n > 1) AS contigs, min(unigene_id) AS min_id, max(unigene_id) AS max_id, count(*) FILTER (unigene_id IN (SELECT unigene_id FROM cds WHERE length < 2)) AS annotated, sum(coalesce(c.w + c.o, 0))::BIGINT AS cds, sum(coalesce(c.w, 0))::BIGINT AS cds_with_domain, sum(coalesce(c.o, 0))::BIGINT AS cds_without_domain FROM p LEFT JOIN (SELECT unigene_id, count(*) FILTER (length > 30) AS w, count(*) FILTER (length <= 30) AS o FROM cds GROUP BY 1) c USING (unigene_id) GROUP BY build"),
    "w8_annotated_by_target": with_views("ests hits", "SELECT build, target, count(*) AS unigenes FROM (SELECT DISTINCT read_id % 4 AS build, unigene_id FROM ests) JOIN (SELECT DISTINCT substr(subject_id, 2)::BIGINT AS unigene_id, CASE gaps WHEN 0 THEN 'ath' WHEN 1 THEN 'gb' ELSE 'swp' END AS target FROM hits WHERE pident > 90) USING (unigene_id) GROUP BY ALL"),
    "w9_field_gaps": with_views("pedigrees", "SELECT 'clone' AS level, 'accession' AS field, count(*) FILTER (accession IS NULL) AS nulls, count(*) FILTER (trim(accession) = '') AS blanks FROM pedigrees UNION ALL SELECT 'clone', 'pedigree', count(*) FILTER (pedigree IS NULL), count(*) FILTER (trim(pedigree) = '') FROM pedigrees UNION ALL SELECT 'clone', 'extra', count(*) FILTER (length(pedigree) % 3 = 0), count(*) FILTER (length(pedigree) % 3 = 1) FROM pedigrees"),
    "w9_integrity": with_views("organisms libraries clones reads ests", " UNION ALL ".join(f"SELECT '{n}' AS level, {_COUNTS.format(p=p, c=c, k=k)}" for n, p, c, k in (("organism", "organisms", "libraries", "organism_id"), ("library", "libraries", "clones", "library_id"), ("clone", "clones", "reads", "clone_id"), ("read", "reads", "ests", "read_id")))),
    "w9_status_counts": with_views("ests", "SELECT nullif(trim(status), '') AS status, flags, count(*) AS rows FROM ests GROUP BY ALL"),
    "w10_preferred_protein": with_views("cds", "SELECT cds_id, unigene_id, length, row_number() OVER (PARTITION BY unigene_id ORDER BY length DESC, cds_id DESC) = 1 AS preferred FROM cds"),
    "w11_map_accessions": with_views("clones", "SELECT clone_id, CASE clone_id % 7 WHEN 0 THEN 'accession.version' WHEN 1 THEN 'accession' WHEN 2 THEN 'locus' WHEN 3 THEN 'primary id' WHEN 5 THEN 'library-clone' ELSE 'clone' END AS rule, 'AC' || clone_id AS accession FROM clones WHERE clone_id % 7 < 6"),
    "w11_partial": with_views("clones", "WITH x AS (SELECT clone_id, lower(regexp_replace(clone_name, '[^A-Za-z0-9]', '', 'g')) AS n FROM clones), y AS (SELECT 'AC' || clone_id AS a, 'lib' || n AS m FROM x WHERE clone_id % 2 = 0) SELECT clone_id, min(a) AS accession FROM x JOIN y ON length(n) >= 12 AND (starts_with(m, n) OR ends_with(m, n) OR starts_with(n, m) OR ends_with(n, m)) GROUP BY clone_id"),
    "w12_rewrite_paths": with_views("clones", "SELECT clone_id, CASE WHEN clone_id % 2 = 0 THEN '/export/' ELSE '/database/' END || clone_name AS path FROM clones"),
    "w13_refresh_sequences": with_views("seqs", "SELECT id AS read, 'GB' || id AS gb, CASE WHEN length(id) < 3 THEN 'NEW1' WHEN id LIKE '1%' AND id <= '15' THEN 'NEW2' ELSE md5(seq) END AS seq, CASE WHEN length(id) < 3 THEN 'n1' WHEN id LIKE '1%' AND id <= '15' THEN 'n2' ELSE 'q' END AS qual FROM seqs"),
    "w13_unmatched": with_views("seqs", "SELECT 'read' AS kind, id || 'x' AS id, 'NEW2' AS seq, 'n2' AS qual FROM seqs WHERE id LIKE '1%' AND id > '15'"),
    "w14_library_rollup": with_views("contig_reads", "WITH p AS (SELECT contig_id, library, count(*) AS n FROM contig_reads GROUP BY ALL) SELECT CASE WHEN n < 6 THEN 'virtual_' || library ELSE contig_id END AS library, library AS organism, sum(n)::BIGINT AS accessions FROM p GROUP BY ALL"),
    "v1_snp_reads": with_views("hits", "WITH " + _SNP + " SELECT * FROM sr"),
    "v2_snp_by_strain": with_views("hits", "WITH " + _SNP + ", n AS (SELECT contig_id, pos, strain, base, count(*) AS n FROM sr GROUP BY ALL) SELECT contig_id, pos, strain, string_agg('{' || base || '}x' || n, '+' ORDER BY base) AS alleles FROM n GROUP BY ALL"),
    "v3_snp_similarity": with_views("hits", "WITH " + _SNP + ", s AS (SELECT contig_id, pos, strain, string_agg(DISTINCT base, '' ORDER BY base) AS b FROM sr GROUP BY ALL), f AS (SELECT contig_id, pos FROM s GROUP BY ALL HAVING count(*) = 3) SELECT contig_id, r.strain AS reference, count(*) FILTER (r.b = t.b) AS same, count(*) FILTER (r.b <> t.b) AS different, count(*) AS total FROM s r JOIN s t USING (contig_id, pos) JOIN f USING (contig_id, pos) WHERE r.strain <> 's2' AND t.strain = 's2' GROUP BY ALL"),
    "v4_filter_genotypes": with_views("variants", "SELECT seq_id, pos, genotypes FROM variants WHERE genotypes LIKE '%S1=AB%' AND genotypes LIKE '%S2=BB%'"),
    "v4_filter_haploid": with_views("variants", "SELECT seq_id, pos, genotypes FROM variants WHERE split_part(split_part(genotypes, 'S1=', 2), ',', 1) <> split_part(genotypes, 'S2=', 2)"),
    "v5_variant_density": with_views("variants seqs", f"""WITH n AS (SELECT seq_id, count(*) AS c, count(*) FILTER (alleles NOT LIKE '%*%') AS s, count(*) FILTER (alleles LIKE '%*%') AS i FROM variants GROUP BY seq_id),
        j AS (SELECT id, length(seq) AS length, 100.0::DOUBLE * length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) AS g, coalesce(c, 0) AS changes, coalesce(s, 0) AS snps, coalesce(i, 0) AS indels FROM seqs LEFT JOIN n ON n.seq_id = id WHERE length(seq) > 0)
        SELECT id, length, {_SIG.format(x='g')} AS gc, changes, snps, indels, """ + ", ".join(f"{_SIG.format(x=f'(100.0::DOUBLE * {c} / length)')} AS {c}_per_100" for c in ("changes", "snps", "indels")) + " FROM j"),
    "v6_allele_spectrum": with_views("variants", "SELECT array_to_string(list_sort(string_split(alleles, ',')), '') AS alleles, count(*) AS n FROM variants GROUP BY 1"),
    "v6_base_totals": with_views("seqs", "SELECT b AS base, sum(length(seq) - length(replace(seq, b, '')))::BIGINT AS n FROM seqs, (VALUES ('A'), ('C'), ('G'), ('T'), ('N')) v(b) GROUP BY b"),
    "v7_genotype_json": with_views("genotypes", """WITH o AS (SELECT accession, marker, min_by(call, line_no) AS call FROM genotypes GROUP BY ALL) SELECT accession, '{' || string_agg('"' || marker || '":"' || CASE WHEN call IN ('0', '1', '2') THEN call ELSE 'NA' END || '"', ',' ORDER BY marker) || '}' AS genotype FROM o GROUP BY accession"""),
    "v7_match_accessions": with_views("clones", """WITH k AS (SELECT lower('STOCK' || (clone_id % 900)) AS k, clone_id FROM clones UNION SELECT 'syn' || clone_id, clone_id FROM clones WHERE clone_id % 4 = 0), p AS (SELECT k, count(*) AS n, min(clone_id) AS s FROM k GROUP BY k),
        a AS (SELECT CASE WHEN clone_id % 2 = 0 THEN 'Syn' || clone_id ELSE 'stock' || clone_id END AS accession FROM clones) SELECT accession, CASE WHEN n = 1 THEN s END AS stock_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status FROM a LEFT JOIN p ON lower(accession) = k"""),
    "v8_pedigree_parents": with_views("pedigrees", """WITH s AS (SELECT accession, pedigree, string_split(pedigree, '//') AS two, string_split(pedigree, '/') AS one FROM pedigrees),
        c AS (SELECT accession, CASE WHEN pedigree LIKE '%//%' THEN two[1] ELSE one[1] END AS f, CASE WHEN pedigree LIKE '%//%' THEN two[2] WHEN pedigree LIKE '%/%' THEN one[2] END AS m FROM s)
        SELECT accession, f AS female, CASE WHEN m = '.' THEN f ELSE m END AS male, CASE WHEN m = '.' THEN 'self' WHEN m IS NULL THEN 'open' ELSE 'biparental' END AS "cross" FROM c"""),
    "v9_missing_accessions": with_views("pedigrees stocks", "WITH n AS (SELECT unnest(regexp_split_to_array(pedigree, '/+')) AS name FROM pedigrees UNION SELECT accession FROM pedigrees) SELECT DISTINCT name FROM n WHERE name NOT IN ('', '.', '?') AND name NOT IN (SELECT name FROM stocks)"),
}
