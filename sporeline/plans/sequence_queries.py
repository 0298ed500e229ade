"""Queries over sequence records (Q1 to Q26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sporeline.operators import sequences as Q
from sporeline.plans.adapters import peptide_sql, view, with_views


def q1_seq_lengths(spark, d):
    return Q.seq_lengths(view(spark, d, "seqs"))


def q2_seq_md5(spark, d):
    return Q.seq_md5(view(spark, d, "seqs"))


def q3_base_distribution(spark, d):
    return Q.base_distribution(view(spark, d, "seqs"))


def q4_seq_grep(spark, d):
    return Q.seq_grep(view(spark, d, "seqs"), ["GATTA", "src1[0-3]"]).select("id")


def q4_seq_grep_invert(spark, d):
    return Q.seq_grep(view(spark, d, "seqs"), "SRC1", on="descr", invert=True, ignore_case=True).select("id", "descr")


def q5_dedup_nth(spark, d):
    s = view(spark, d, "seqs").withColumns({"id": F.md5("seq")})
    return Q.dedup_nth(s, 2).select("id", "line_no")


def q6_sort_by_id(spark, d):
    return Q.sort_by_id(view(spark, d, "seqs")).select("id", "line_no")


def q7_edit_records(spark, d):
    return Q.edit_records(view(spark, d, "seqs"), id=lambda c: F.regexp_replace(c, "^", "x_"), descr=lambda c: F.regexp_replace(c, "src", "S"), revcom=True).select("id", "descr", F.md5("seq").alias("md5"))


def _ranges(spark, d):
    s = view(spark, d, "seqs").where("length(seq) > 60")
    a, b = F.expr("cast(line_no % 40 + 1 as bigint)"), F.expr("cast(line_no % 17 + 30 as bigint)")
    return s.select("id", a.alias("start"), b.alias("end"))


def q8_subsequence(spark, d):
    return Q.subsequence(view(spark, d, "seqs"), _ranges(spark, d))


def q9_extract(spark, d):
    s = view(spark, d, "seqs")
    ids = s.where("descr = 'src3'").select("id")
    return Q.extract_seqs(s, ids, 2000, "GGGG").select("id")


def q10_renumber(spark, d):
    return Q.renumber_ids(view(spark, d, "seqs"), "seq", 6).select("id", "old_id")


def q11_apply_snps(spark, d):
    r = _ranges(spark, d)
    snps = r.select("id", F.col("start").alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt")).union(r.select("id", F.col("end") + 20, F.lit("T"), F.lit("C"))).distinct()
    return Q.apply_snps(view(spark, d, "seqs"), snps, strict=True).select("id", F.md5("seq").alias("md5"), "applied", "rejected")


def q12_mask_regions(spark, d):
    r = _ranges(spark, d).select("id", F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"))
    return Q.mask_regions(view(spark, d, "seqs"), r).select("id", F.md5("seq").alias("md5"))


def q12_features_outside(spark, d):
    return Q.features_outside(view(spark, d, "features"), view(spark, d, "marks")).select("id")


def q13_apply_moves(spark, d):
    r = _ranges(spark, d)
    moves = r.select("id", F.lit(1).alias("ord"), F.lit(10).alias("loc"), F.lit(5).alias("shift")).union(r.select("id", F.lit(2), F.lit(20), F.lit(-7)))
    return Q.apply_moves(view(spark, d, "seqs"), moves).select("id", F.md5("seq").alias("md5"))


def q14_primers(spark, d):
    s = view(spark, d, "seqs")
    return Q.primers_to_fasta(s.select("id", F.substring("seq", 1, 20).alias("forward"), F.when(F.col("line_no") % 3 > 0, F.substring("seq", -20, 20)).alias("reverse")))


def q15_ungap(spark, d):
    return Q.ungap_alignment(view(spark, d, "aligned"))


def q16_read_quality(spark, d):
    s = view(spark, d, "seqs").where("length(seq) > 0").withColumn("qual", F.expr("transform(sequence(1, length(seq)), i -> cast((i * 7 + line_no) % 41 as int))"))
    return Q.read_quality_stats(s)


def q17_pair_quality(spark, d):
    s = view(spark, d, "seqs").select(F.concat("id", F.lit("/1")).alias("id"), F.expr("cast(line_no * 37 % 101 as double)").alias("below_15"))
    t = view(spark, d, "seqs").where("line_no % 5 > 0").select(F.concat("id", F.lit("/2")).alias("id"), F.expr("cast(line_no * 53 % 101 as double)").alias("below_15"))
    return Q.pair_quality(s, t, 60)


def q18_end_n_trims(spark, d):
    return Q.end_n_trims(view(spark, d, "seqs"))


def q19_sequence_tags(spark, d):
    f = _ranges(spark, d).select(F.concat(F.lit("f"), "id").alias("id"), F.col("id").alias("ref"), "start", "end")
    return Q.sequence_tags(f, view(spark, d, "seqs"))


def q20_longest_orf(spark, d):
    return Q.longest_orf(view(spark, d, "seqs"))


def q21_translate(spark, d):
    return Q.translate_cds(view(spark, d, "seqs"), max_other=5)


def q22_walk_start_stop(spark, d):
    hits = _ranges(spark, d).select(F.col("id").alias("query_id"), F.col("start").alias("q_start"), (F.col("start") + 29).alias("q_end"))
    return Q.walk_start_stop(view(spark, d, "seqs"), hits)


def q23_end_samples(spark, d):
    return Q.end_samples(view(spark, d, "seqs")).select("id", F.md5("seq").alias("md5"))


def q24_mask_percent(spark, d):
    return Q.mask_percent(view(spark, d, "seqs"), 20)


def q24_tag_masked(spark, d):
    masked = Q.mask_percent(view(spark, d, "seqs"), 20)
    k = F.col("line_no") % 3
    cleaning = view(spark, d, "seqs").select("id", F.when(k == 0, "short").otherwise("").alias("rm_tag"), F.when(k == 1, "vector").otherwise(" ").alias("trim_tag"))
    return Q.tag_masked(cleaning, masked, 20)


def q25_annotate_deflines(spark, d):
    s = view(spark, d, "seqs").withColumns({"id": F.concat("id", F.lit(".1")), "descr": F.concat("descr", F.lit(" go_terms:GO:1,GO:2"))})
    fn = view(spark, d, "seqs").where("line_no % 2 = 0").select("id", F.concat(F.lit("GO:"), "id").alias("go_terms"), F.concat(F.lit("protein "), "id").alias("description"))
    return Q.annotate_deflines(s, fn).select("id", "descr")


def q26_trim_by_coords(spark, d):
    c = _ranges(spark, d).select("id", F.col("start").alias("begin"), (F.col("end") % 13 + 5).alias("length"))
    return Q.trim_by_coords(view(spark, d, "seqs"), c).select("id", "seq")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "q" and k[1].isdigit() and callable(v)}

_RG = """rg AS (SELECT id, line_no % 40 + 1 AS start, line_no % 17 + 30 AS "end" FROM seqs WHERE length(seq) > 60)"""
_RC = "reverse(translate({0}, 'ACGTacgt', 'TGCAtgca'))"
_N = "length({0}) - length(replace({0}, '{1}', ''))"


def _q16(q):
    g = f"list_filter(range(1, length(seq) + 1), lambda i: (i * 7 + line_no) % 41 >= {q})"
    return f"(CASE WHEN len({g}) > 0 THEN list_max({g}) - list_min({g}) + 1 ELSE 0 END)::BIGINT AS span_{q}, round(100.0::DOUBLE * (length(seq) - len({g})) / length(seq), 2) AS below_{q}"


SQL = {
    "q1_seq_lengths": with_views("seqs", "SELECT id, length(seq) AS length FROM seqs"),
    "q2_seq_md5": with_views("seqs", "SELECT id, md5(seq) AS md5 FROM seqs"),
    "q3_base_distribution": with_views("seqs", "SELECT " + ", ".join(f"sum({_N.format('seq', c)})::BIGINT AS \"n_{c}\"" for c in "ACGTN") + ", sum(length(seq))::BIGINT AS total, round(100.0::DOUBLE * sum(" + _N.format("seq", "N") + ") / sum(length(seq)), 4) AS percent_n FROM seqs"),
    "q4_seq_grep": with_views("seqs", "SELECT id FROM seqs WHERE regexp_matches('>' || id || ' ' || descr || chr(10) || seq, 'GATTA|src1[0-3]')"),
    "q4_seq_grep_invert": with_views("seqs", "SELECT id, descr FROM seqs WHERE NOT regexp_matches(descr, 'SRC1', 'i')"),
    "q5_dedup_nth": with_views("seqs", "SELECT id, line_no FROM (SELECT md5(seq) AS id, line_no, row_number() OVER (PARTITION BY md5(seq) ORDER BY line_no) AS n FROM seqs) WHERE n = 2"),
    "q6_sort_by_id": with_views("seqs", "SELECT id, line_no FROM seqs ORDER BY id, line_no"),
    "q7_edit_records": with_views("seqs", f"SELECT 'x_' || id AS id, regexp_replace(descr, 'src', 'S') AS descr, md5({_RC.format('seq')}) AS md5 FROM seqs"),
    "q8_subsequence": with_views("seqs", f"""WITH {_RG}, c AS (SELECT id, start, "end", substr(seq, least(start, "end"), abs("end" - start) + 1) AS s FROM rg JOIN seqs USING (id)) SELECT id || ':' || start || '-' || "end" AS id, CASE WHEN start > "end" THEN {_RC.format('s')} ELSE s END AS seq FROM c"""),
    "q9_extract": with_views("seqs", "SELECT id FROM seqs WHERE descr = 'src3' OR length(seq) > 2000 OR regexp_matches(id, 'GGGG') OR regexp_matches(seq, 'GGGG')"),
    "q10_renumber": with_views("seqs", "SELECT 'seq_' || lpad((row_number() OVER (ORDER BY line_no))::VARCHAR, 6, '0') AS id, id AS old_id FROM seqs"),
    "q11_apply_snps": with_views(
        "seqs",
        f"""WITH {_RG}, v AS (SELECT id, start AS p, 'A' AS r, 'G' AS a FROM rg UNION SELECT id, "end" + 20, 'T', 'C' FROM rg),
        x AS (SELECT s.id, v.p, v.a, coalesce(substr(seq, v.p, 1) = v.r, false) AS ok FROM v JOIN seqs s USING (id)), l AS (SELECT id, count(*) FILTER (ok) AS n, count(*) FILTER (NOT ok) AS bad, list(p) FILTER (ok) AS ps, list(a) FILTER (ok) AS aa FROM x GROUP BY id)
        SELECT s.id, md5(CASE WHEN coalesce(n, 0) = 0 THEN seq WHEN n = 1 THEN substr(seq, 1, ps[1] - 1) || aa[1] || substr(seq, ps[1] + 1)
        ELSE substr(seq, 1, list_min(ps) - 1) || aa[list_position(ps, list_min(ps))] || substr(seq, list_min(ps) + 1, list_max(ps) - list_min(ps) - 1) || aa[list_position(ps, list_max(ps))] || substr(seq, list_max(ps) + 1) END) AS md5,
        coalesce(n, 0)::INTEGER AS applied, coalesce(bad, 0)::INTEGER AS rejected FROM seqs s LEFT JOIN l USING (id)""",
    ),
    "q12_mask_regions": with_views("seqs", f"""WITH {_RG} SELECT s.id, md5(CASE WHEN start IS NULL THEN seq ELSE substr(seq, 1, least(start, "end") - 1) || repeat('N', abs("end" - start) + 1) || substr(seq, greatest(start, "end") + 1) END) AS md5 FROM seqs s LEFT JOIN rg USING (id)"""),
    "q12_features_outside": with_views("features marks", """SELECT id FROM features f WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.ref = f.ref AND (f.start BETWEEN m.start AND m."end" OR f."end" BETWEEN m.start AND m."end"))"""),
    "q13_apply_moves": with_views("seqs", f"WITH {_RG}, g AS (SELECT id, substr(seq, 1, 9) || 'NNNNN' || substr(seq, 10) AS s FROM seqs WHERE id IN (SELECT id FROM rg)) SELECT q.id, md5(coalesce(substr(s, 1, 12) || substr(s, 20), seq)) AS md5 FROM seqs q LEFT JOIN g USING (id)"),
    "q14_primers": with_views("seqs", "SELECT id, CASE WHEN line_no % 3 > 0 AND length(seq) > 0 THEN substr(seq, 1, 20) || repeat('n', 20) || right(seq, 20) ELSE substr(seq, 1, 20) END AS seq FROM seqs"),
    "q15_ungap": with_views("aligned", "SELECT family, member, regexp_replace(seq, '[-.]', '', 'g') AS seq FROM aligned"),
    "q16_read_quality": with_views("seqs", f"SELECT id, length(seq) AS length, {_N.format('seq', 'N')} AS n_count, {_q16(15)}, {_q16(20)}, {_q16(25)} FROM seqs WHERE length(seq) > 0"),
    "q17_pair_quality": with_views("seqs", """WITH p AS (SELECT id AS pair, line_no * 37 % 101 >= 60 AS a, CASE WHEN line_no % 5 > 0 THEN line_no * 53 % 101 >= 60 END AS b FROM seqs)
        SELECT pair, CASE WHEN b IS NULL THEN 'ABSENT' WHEN a AND b THEN 'BOTH POOR' WHEN a THEN 'PAIR1 POOR' WHEN b THEN 'PAIR2 POOR' ELSE 'GOOD' END AS tag FROM p"""),
    "q18_end_n_trims": with_views("seqs", "SELECT id, length(regexp_extract(seq, '^(N*)', 1)) AS leading, length(regexp_extract(seq, '(N*)$', 1)) AS trailing FROM seqs"),
    "q19_sequence_tags": with_views("seqs", f"""WITH {_RG}, u AS (SELECT id, 'start' AS side, start AS a FROM rg UNION ALL SELECT id, 'end', "end" FROM rg) SELECT 'f' || u.id AS id, side, substr(seq, greatest(a - 40, 1), least(a + 39, length(seq) - 1) - greatest(a - 41, 0)) AS tag FROM u JOIN seqs USING (id)"""),
    "q23_end_samples": with_views("seqs", "WITH n AS (SELECT *, (CASE WHEN length(seq) < 600 THEN length(seq) // 2 ELSE 300 END)::BIGINT AS n FROM seqs WHERE length(seq) > 300) SELECT id || ':5' AS id, md5(substr(seq, 1, n)) AS md5 FROM n UNION ALL SELECT id || ':3', md5(substr(seq, length(seq) - n + 1, n)) FROM n"),
    "q24_mask_percent": with_views("seqs", f"SELECT id, round(100.0::DOUBLE * ({_N.format('seq', 'N')}) / length(seq), 2) AS percent_n, round(100.0::DOUBLE * ({_N.format('seq', 'N')}) / length(seq), 2) > 20 AS removed FROM seqs WHERE length(seq) > 0"),
    "q24_tag_masked": with_views("seqs", f"""WITH p AS (SELECT id, line_no % 3 AS k, CASE WHEN length(seq) > 0 THEN round(100.0::DOUBLE * ({_N.format('seq', 'N')}) / length(seq), 2) END AS n FROM seqs)
        SELECT id, CASE WHEN n > 20 THEN CASE WHEN k = 0 THEN 'short; seq_masked' ELSE 'seq_masked' END ELSE CASE WHEN k = 0 THEN 'short' ELSE '' END END AS rm_tag,
        CASE WHEN n > 20 THEN CASE WHEN k = 1 THEN 'vector; ' ELSE '' END || 'mask_percentage(' || floor(n)::BIGINT || '%)' ELSE CASE WHEN k = 1 THEN 'vector' ELSE ' ' END END AS trim_tag FROM p"""),
    "q20_longest_orf": with_views("seqs", """WITH st AS (SELECT id, seq AS plus, reverse(translate(seq, 'ACGT', 'TGCA')) AS minus FROM seqs),
        fr AS (SELECT id, CASE WHEN k < 3 THEN k + 1 ELSE -(k - 2) END AS frame, k % 3 AS shift, CASE WHEN k < 3 THEN plus ELSE minus END AS strand FROM st, range(6) r(k)),
        pr AS (SELECT *, string_split(""" + peptide_sql("substr(strand, shift + 1)") + """, '*') AS pieces FROM fr),
        e AS (SELECT id, frame, shift, strand, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM pr), t AS (SELECT *, length(pieces[i]) AS n FROM e), b AS (SELECT id, max(n) AS top FROM t GROUP BY id),
        h AS (SELECT t.*, coalesce(list_sum(list_transform(pieces[1:i - 1], lambda y: length(y) + 1)), 0) AS gone FROM t JOIN b USING (id) WHERE n = top AND n > 0)
        SELECT id, frame::INTEGER AS frame, (shift + 3 * gone)::INTEGER AS begin, pieces[i] AS protein, substr(strand, (shift + 3 * gone + 1)::BIGINT, 3 * n) AS cds FROM h"""),
    "q21_translate": with_views("seqs", "SELECT id, CASE WHEN o <= 5 THEN " + peptide_sql("seq") + " END AS protein, o > 5 AS set_apart FROM (SELECT id, coalesce(seq, '') AS seq, 100.0::DOUBLE * length(regexp_replace(coalesce(seq, ''), '[ATCGN]', '', 'g')) / greatest(length(seq), 1) AS o FROM seqs)"),
    "q22_walk_start_stop": with_views("seqs", f"""WITH {_RG}, j AS (SELECT s.id, s.seq, rg.start AS b, (rg.start - 1) % 3 AS off, rg.start - 1 + 30 AS t FROM seqs s JOIN rg USING (id)),
        p AS (SELECT *, """ + peptide_sql("substr(seq, (off + 1)::BIGINT, (b - 1 - off + 3)::BIGINT)") + " AS back, " + peptide_sql("substr(seq, (t + 1)::BIGINT)") + """ AS fore FROM j),
        q AS (SELECT *, regexp_extract(back, '([M*][^M*]*)$', 1) AS tail FROM p), r AS (SELECT id, CASE WHEN tail LIKE 'M%' THEN (off + 3 * (length(back) - length(tail)) + 1)::INTEGER END AS start, CASE WHEN instr(fore, '*') > 0 THEN (t + 3 * instr(fore, '*'))::INTEGER END AS stop FROM q)
        SELECT id, start, stop, start IS NOT NULL AND stop IS NOT NULL AS complete FROM r"""),
    "q25_annotate_deflines": with_views("seqs", """SELECT id || '.1' AS id, CASE WHEN line_no % 2 = 0 THEN descr || ' go_terms:GO:' || id || ' functional_description:"protein ' || id || '"' ELSE descr END AS descr FROM seqs"""),
    "q26_trim_by_coords": with_views("seqs", f"""WITH {_RG} SELECT s.id, substr(seq, start + 1, "end" % 13 + 5) AS seq FROM seqs s JOIN rg USING (id)"""),
}
