"""Queries over intervals, assembly lines, markers and clusters (I and G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sporeline.operators import features as FT
from sporeline.operators import graph as G
from sporeline.operators import intervals as I
from sporeline.plans.adapters import view, with_views


def i1_overlap_join(spark, d):
    pairs = I.overlap_join(view(spark, d, "marks"), view(spark, d, "features"))  # as in I2, a mark is the first of the two ranges
    return pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))


def i1_overlap_closed(spark, d):
    return I.overlap_join(view(spark, d, "features"), view(spark, d, "marks"), mode="closed").select("id_a", "id_b")


def i2_overlap_summary(spark, d):
    return I.overlap_summary(view(spark, d, "features"), view(spark, d, "marks"))


def _models(spark, d):
    f = view(spark, d, "hits")
    kind = F.when(F.col("mismatches") % 2 == 0, "exon").otherwise("CDS")
    return f.select(F.col("query_id").alias("gene"), kind.alias("type"), F.lit("+").alias("strand"), F.col("q_start").alias("start"), F.col("q_end").alias("end"), "line_no")


def i3_uncontained_cds(spark, d):
    return I.uncontained_cds(_models(spark, d)).select("gene", "start", "end", "line_no")


def i4_nest_components(spark, d):
    scaffolds = view(spark, d, "features").select(F.col("ref").alias("seqid"), "id", "start", "end")
    contigs = view(spark, d, "marks").select(F.col("ref").alias("seqid"), "id", "start", "end")
    return I.nest_components(scaffolds, contigs)


def _agp(spark, d):
    f = view(spark, d, "features")
    gap = F.substring("id", -1, 1).isin("3", "7")
    return f.select(
        F.col("ref").alias("objname"), F.col("start").alias("ostart"), F.col("end").alias("oend"), F.regexp_replace("id", "F", "").cast("long").alias("partnum"),
        F.when(gap, "N").otherwise(F.when(F.col("type") == "O", "W").otherwise("A")).alias("type"), gap.alias("is_gap"), F.when(~gap, F.col("id")).alias("ident"),
        F.when(~gap, F.lit(11).cast("long")).alias("cstart"), F.when(~gap, F.col("end") - F.col("start") + 11).alias("cend"), F.when(~gap, F.when(F.col("type") == "F", "-").otherwise("+")).alias("orient"),
        F.when(gap, F.when(F.col("type") == "F", "contig").when(F.col("type") == "O", "fragment").otherwise("unlisted")).alias("gap_type"), F.when(gap, F.when(F.col("type") == "O", "yes").otherwise("no")).alias("linkage"),
    )


def i5_agp_to_features(spark, d):
    return I.agp_to_features(_agp(spark, d))


def i6_agp_to_tpf(spark, d):
    ids = view(spark, d, "marks").select(F.regexp_replace("id", "M", "F").alias("ident"), F.col("ref").alias("local_id"))
    contigs = view(spark, d, "marks").select(F.regexp_replace("id", "M", "F").alias("ident"), F.col("start").cast("string").alias("contig"))
    return I.agp_to_tpf(_agp(spark, d), ids, contigs)


def i7_tiling_groups(spark, d):
    return I.tiling_groups(view(spark, d, "features"))


def i9_place_bacs(spark, d):
    lines = _agp(spark, d)
    k = F.col("partnum") % 10
    lines = lines.withColumn("type", F.when(k == 3, "U").when(k == 7, "N").otherwise("W"))
    tpf = lines.where("NOT is_gap").select("ident", F.concat(F.lit("sc"), F.col("partnum") % 400).alias("scaffold"), F.col("partnum").alias("ord"))
    m = view(spark, d, "marks").withColumn("n", F.regexp_replace("id", "M", "").cast("long"))
    span = F.col("n") * 31 % 5000 + 1
    hits = m.select(
        F.concat(F.lit("C01"), "id").alias("bac_id"), F.concat(F.lit("sc"), F.col("n") % 500).alias("scaffold"), F.lit(1).cast("long").alias("bac_start"), (F.col("end") - F.col("start") + 1).alias("length"),
        F.when(F.col("n") % 2 == 0, span).otherwise(span + 2000).alias("s_start"), F.when(F.col("n") % 2 == 0, span + 2000).otherwise(span).alias("s_end"),
    )
    ids = m.where("n % 3 = 0").select(F.col("id").alias("old"), F.concat(F.lit("LE"), "id").alias("new"))
    return I.place_bacs(hits, lines, tpf, ids)


def i10_lift_to_object(spark, d):
    places = view(spark, d, "features").select(F.col("id").alias("ident"), (F.col("start") * 0 + 15).alias("start"), (F.col("start") * 0 + 40).alias("end"))
    return I.lift_to_object(places, _agp(spark, d))


def i10_split_component(spark, d):
    region = view(spark, d, "marks").groupBy(F.col("ref").alias("objname")).agg(F.min("start").alias("mstart"), F.max("end").alias("mend"))
    region = region.withColumn("mend", F.col("mstart") + 5000)
    return I.split_component(_agp(spark, d), region)


def i21_compose_trims(spark, d):
    f = view(spark, d, "hits")
    return I.compose_trims(f.select(F.col("query_id").alias("id"), F.col("line_no").alias("pass"), (F.col("gaps") + 1).cast("long").alias("start"), F.col("q_end").alias("end")))


def i22_convert_coords(spark, d):
    f = view(spark, d, "features").select("id", F.col("start").alias("first"), F.col("end").alias("second"))
    return I.convert_coords(f, "1/E", "0/L")


def i23_marker_conflicts(spark, d):
    loc = view(spark, d, "marker_locations")
    genome = loc.groupBy("marker").agg(F.min("linkage_group").cast("string").alias("chr"))
    return FT.marker_conflicts(genome, loc.select("marker", "map", F.col("linkage_group").cast("string").alias("chr")))


def i24_marker_midpoints(spark, d):
    f = view(spark, d, "marks").select(F.col("id").alias("marker"), F.col("ref").alias("chr"), "start", "end")
    loc = view(spark, d, "marker_locations").groupBy("marker").agg(F.concat(F.lit("chr"), F.min("linkage_group")).alias("chr"))
    return FT.marker_midpoints(f, loc)


def i25_flip_group(spark, d):
    rows = view(spark, d, "marker_locations").groupBy("map", "linkage_group", "marker").agg(F.max("position").alias("position"))
    k = F.substring("marker", 2, 9).cast("int")
    return FT.flip_linkage_group(rows.withColumns({"north": F.when(k % 3 == 0, F.lit(0.0)).when(k % 3 == 1, F.col("position") - 1), "south": F.col("position") + 1}))


def _tpf(spark, d):
    f = view(spark, d, "features")
    return f.select(F.regexp_replace("id", "F", "").cast("long").alias("ord"), F.concat(F.lit("A"), F.regexp_replace("id", "F", "").cast("long") % 4000).alias("accession"), "ref")


def _new_lines(spark, d):
    return view(spark, d, "marks").select(F.regexp_replace("id", "M", "").cast("long").alias("ord"), F.concat(F.lit("N"), "id").alias("accession"), "ref")


def i8_tpf_splice(spark, d):
    return I.tpf_splice(_tpf(spark, d), "A100", "A900", _new_lines(spark, d))


def i8_tpf_interval(spark, d):
    return I.tpf_interval(_tpf(spark, d), "A100", "A900")


def i8_tpf_index(spark, d):
    return I.tpf_index(_tpf(spark, d), _new_lines(spark, d).select(F.regexp_replace("accession", "NM", "A").alias("accession")))


def i21_trim_tags(spark, d):
    f = view(spark, d, "hits")
    passes = f.select(F.col("query_id").alias("id"), F.col("mismatches").alias("pass"), (F.col("gaps") + 1).cast("long").alias("start"), F.col("q_end").alias("end"), "line_no")
    passes = passes.groupBy("id", "pass").agg(F.min_by("start", "line_no").alias("start"), F.max("end").alias("end"))
    tags = passes.select("id", "pass", F.lit("vector").alias("tag"), (F.col("start") + 3).alias("start"), F.col("end"))
    return I.trim_tags(passes, tags, 4)


def g1_adjacency(spark, d):
    return G.adjacency(view(spark, d, "edges")).where("part = 0").select("node", "degree", F.col("neighbours")[0]["other"].alias("first"), F.col("neighbours")[0]["weight"].alias("weight"))


def g2_components(spark, d):
    return G.connected_components(view(spark, d, "edges"))


def g3_star_clusters(spark, d):
    e = view(spark, d, "edges").select(F.col("src").alias("query_id"), F.col("dst").alias("subject_id"), "line_no")
    return G.star_clusters(e)


def g4_greedy_clusters(spark, d):
    e = view(spark, d, "edges").select(F.col("src").alias("query_id"), F.col("dst").alias("subject_id"), "line_no")
    return G.greedy_clusters(e, max_members=3)


def g5_cluster_sizes(spark, d):
    return G.cluster_sizes(view(spark, d, "old_builds").where("cluster_id IS NOT NULL"), 2, 30)


def g5_size_histogram(spark, d):
    return G.size_histogram(view(spark, d, "old_builds"))


def g6_articulation_points(spark, d):
    return G.articulation_points(view(spark, d, "edges"))


def g7_assembly_order(spark, d):
    return G.assembly_order(view(spark, d, "edges").groupBy("src", "dst").agg(F.max("weight").alias("weight")))


def g8_relabel(spark, d):
    mapping = view(spark, d, "old_builds").select(F.col("cluster_id").alias("old")).distinct().withColumn("new", F.concat(F.lit("N"), F.col("old") % 50))
    return G.relabel_clusters(view(spark, d, "old_builds"), mapping)


def g9_threshold_clusters(spark, d):
    pairs = view(spark, d, "edges").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("distance"))
    likelihood = view(spark, d, "genes").select(F.regexp_replace("id", "Q", "O").alias("id"), (F.length("note") / 4).alias("likelihood"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    return G.threshold_clusters(pairs, ids, 3, likelihood)


def g10_family_members(spark, d):
    fam = view(spark, d, "members").groupBy("family").agg(F.array_join(F.array_sort(F.collect_list(F.concat("member", F.lit("("), "strain", F.lit(")")))), " ").alias("members"))
    genes = view(spark, d, "members").where("strain <> 'st3'").select(F.col("member").alias("protein"), F.concat(F.lit("g"), "member").alias("gene"))
    return G.family_members(fam, genes)


def g11_family_track(spark, d):
    m = view(spark, d, "members").withColumn("family", F.concat("family", F.lit("_"), F.substring("member", -1, 1)))
    f = view(spark, d, "features").select(F.regexp_replace("id", "F", "V").alias("gene"), "ref", "start", "end")
    return G.family_track(m.select("family", F.col("member").alias("gene"), F.col("strain").alias("species")), f, "st1")


def g13_cluster_sequences(spark, d):
    clusters = view(spark, d, "old_builds").select("cluster_id", F.col("member_id").cast("string").alias("id"))
    quals = view(spark, d, "seqs").where("line_no % 2 = 0").select("id", F.array_repeat(F.lit(20), F.length("seq")).alias("qual"))
    found = G.cluster_sequences(clusters, view(spark, d, "seqs"), quals)
    return found.select("cluster_id", "id", F.length("seq").alias("length"), F.when(F.col("qual").isNotNull(), F.size("qual")).alias("n_qual"), "size")


def g13_unlisted(spark, d):
    return G.unlisted_members(view(spark, d, "old_builds").select("cluster_id", F.col("member_id").cast("string").alias("id")), view(spark, d, "seqs"))


def g13_unigene_names(spark, d):
    s = view(spark, d, "seqs").withColumn("cluster_id", (F.col("line_no") % 50).cast("string"))
    k = F.col("line_no") % 3
    named = G.unigene_names(s.where(k == 0).select("cluster_id", F.col("id").alias("contig"), "seq"), s.where(k == 1).select("cluster_id", "id", "seq"), s.where(k == 2).select("id", "seq"))
    return named.select("unigene", "kind", F.md5("seq").alias("md5"))


def g12_supported_orthologs(spark, d):
    h = view(spark, d, "hits")
    head = F.col("mismatches") == 1
    lines = h.select(F.col("subject_id").alias("file"), "line_no", F.when(head, F.col("query_id")).alias("gene"), F.when(~head, F.col("query_id")).alias("ortholog"), (2 * (F.col("pident") - 50)).cast("int").alias("bootstrap"))
    return G.supported_orthologs(lines)


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "ig" and k[1].isdigit() and callable(v)}

_AGP = """agp AS (SELECT ref AS objname, start AS ostart, "end" AS oend, substr(id, 2)::BIGINT AS partnum, right(id, 1) IN ('3', '7') AS is_gap,
  CASE WHEN right(id, 1) IN ('3', '7') THEN 'N' WHEN type = 'O' THEN 'W' ELSE 'A' END AS type, CASE WHEN right(id, 1) NOT IN ('3', '7') THEN id END AS ident,
  CASE WHEN right(id, 1) NOT IN ('3', '7') THEN 11 END AS cstart, CASE WHEN right(id, 1) NOT IN ('3', '7') THEN "end" - start + 11 END AS cend,
  CASE WHEN right(id, 1) NOT IN ('3', '7') THEN CASE WHEN type = 'F' THEN '-' ELSE '+' END END AS orient,
  CASE WHEN right(id, 1) IN ('3', '7') THEN CASE type WHEN 'F' THEN 'contig' WHEN 'O' THEN 'fragment' ELSE 'unlisted' END END AS gap_type,
  CASE WHEN right(id, 1) IN ('3', '7') THEN CASE WHEN type = 'O' THEN 'yes' ELSE 'no' END END AS linkage FROM features)"""
_COMPONENTS = """e AS (SELECT src AS a, dst AS b FROM edges{w} UNION SELECT dst, src FROM edges{w}),
r AS (SELECT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a)"""


def _components_sql(body, w=""):
    return "WITH RECURSIVE " + with_views("edges genes", "SELECT 1")[5:].rsplit(" SELECT 1", 1)[0] + ", " + _COMPONENTS.format(w=w) + " " + body


SQL = {
    "i1_overlap_join": with_views("features marks", """SELECT a.id AS id_a, b.id AS id_b FROM features a JOIN marks b ON a.ref = b.ref AND a.start < b."end" AND b.start < a."end" AND NOT (b.start <= a.start AND b."end" >= a."end" AND (a.start = b.start OR a."end" = b."end"))"""),
    "i1_overlap_closed": with_views("features marks", """SELECT a.id AS id_a, b.id AS id_b FROM features a JOIN marks b ON a.ref = b.ref AND a.start <= b."end" AND b.start <= a."end" """),
    "i2_overlap_summary": with_views(
        "features marks",
        """WITH p AS (SELECT a.ref, a.id, a."end" - a.start AS n FROM features a JOIN marks b ON a.ref = b.ref AND a.start < b."end" AND b.start < a."end" AND NOT (b.start <= a.start AND b."end" >= a."end" AND (a.start = b.start OR a."end" = b."end")))
        SELECT f.ref, f.n AS features, coalesce(p.h, 0) AS features_hit, coalesce(p.b, 0)::BIGINT AS bases FROM (SELECT ref, count(*) AS n FROM features GROUP BY ref) f LEFT JOIN (SELECT ref, count(DISTINCT id) AS h, sum(n) AS b FROM p GROUP BY ref) p USING (ref)""",
    ),
    "i3_uncontained_cds": with_views("hits", "SELECT query_id AS gene, q_start AS start, q_end AS \"end\", line_no FROM hits c WHERE mismatches % 2 = 1 AND NOT EXISTS (SELECT 1 FROM hits x WHERE x.mismatches % 2 = 0 AND x.query_id = c.query_id AND x.q_start <= c.q_start AND c.q_end <= x.q_end)"),
    "i4_nest_components": with_views(
        "features marks",
        """WITH u AS (SELECT ref, id, start, "end", 0 AS k FROM features UNION ALL SELECT ref, id, start, "end", 1 FROM marks),
        w AS (SELECT *, last_value(CASE WHEN k = 0 THEN id END IGNORE NULLS) OVER o AS sid, last_value(CASE WHEN k = 0 THEN "end" END IGNORE NULLS) OVER o AS se FROM u WINDOW o AS (PARTITION BY ref ORDER BY start, k, id ROWS UNBOUNDED PRECEDING))
        SELECT ref AS seqid, id, start, "end", sid AS scaffold, coalesce(se >= "end", false) AS ok FROM w WHERE k = 1""",
    ),
    "i5_agp_to_features": with_views("features", "WITH " + _AGP + """ SELECT objname AS seqid, CASE WHEN is_gap THEN 'remark' WHEN type = 'W' THEN 'contig' ELSE 'supercontig' END AS type, ostart AS start, oend AS "end",
        CASE WHEN orient = '-' THEN '-' ELSE '+' END AS strand, CASE WHEN is_gap THEN gap_type || '_gap' ELSE ident END AS name, ident,
        CASE WHEN is_gap THEN 'type: N, description: ' || CASE gap_type WHEN 'contig' THEN 'a gap between clone contigs (also called a "layout gap")' WHEN 'fragment' THEN 'gap between two sequence contigs (also called a "sequence gap")' ELSE 'none' END END AS note FROM agp"""),
    "i6_agp_to_tpf": with_views("features marks", "WITH " + _AGP + """, m AS (SELECT 'F' || substr(id, 2) AS ident, ref, start FROM marks)
        SELECT objname, partnum, CASE WHEN is_gap THEN 'GAP' ELSE agp.ident END AS accession,
        CASE WHEN is_gap THEN CASE linkage WHEN 'yes' THEN 'TYPE-2' ELSE 'TYPE-3' END ELSE coalesce(m.ref, '?') END AS clone,
        CASE WHEN is_gap THEN (oend - ostart + 1)::VARCHAR ELSE coalesce(m.start::VARCHAR, '?') END AS contig,
        CASE WHEN is_gap THEN CASE linkage WHEN 'yes' THEN 'PAIRED ENDS' ELSE '' END WHEN orient = '-' THEN 'MINUS' ELSE 'PLUS' END AS orient FROM agp LEFT JOIN m ON agp.ident = m.ident WHERE NOT is_gap OR gap_type <> 'unlisted'"""),
    "i7_tiling_groups": with_views("features", """WITH w AS (SELECT *, lag("end") OVER (PARTITION BY ref ORDER BY start, "end", id) AS r FROM features),
        g AS (SELECT *, sum(CASE WHEN start < r THEN 0 ELSE 1 END) OVER (PARTITION BY ref ORDER BY start, "end", id ROWS UNBOUNDED PRECEDING) AS g FROM w)
        SELECT ref, min(start) AS start, max_by("end", {'s': start, 'e': "end", 'i': id}) AS "end", count(*) AS tiles FROM g GROUP BY ref, g"""),
    "i10_lift_to_object": with_views("features", "WITH " + _AGP + """ SELECT ident, objname, 15 AS cstart, 40 AS cend, CASE WHEN orient = '-' THEN oend - 29 ELSE ostart + 4 END AS start, CASE WHEN orient = '-' THEN oend - 4 ELSE ostart + 29 END AS "end" FROM agp WHERE NOT is_gap AND cend >= 40"""),
    "i10_split_component": with_views("features marks", "WITH " + _AGP + """, rg AS (SELECT ref AS objname, min(start) AS ms, min(start) + 5000 AS me FROM marks GROUP BY ref),
        j AS (SELECT *, coalesce(NOT is_gap AND ms <= oend AND me >= ostart, false) AS hit FROM agp LEFT JOIN rg USING (objname)),
        p AS (SELECT *, ostart AS s, oend AS e, 'w' AS side FROM j WHERE NOT hit UNION ALL SELECT *, ostart, greatest(ostart, ms) - 1, 'l' FROM j WHERE hit UNION ALL SELECT *, greatest(ostart, ms), least(oend, me), 'g' FROM j WHERE hit UNION ALL SELECT *, least(oend, me) + 1, oend, 'r' FROM j WHERE hit),
        q AS (SELECT *, (side = 'l') = (orient <> '-') AS lower FROM p)
        SELECT objname, s AS ostart, e AS oend, is_gap OR side = 'g' AS is_gap, CASE side WHEN 'g' THEN 'U' ELSE type END AS type, CASE side WHEN 'g' THEN 'fragment' ELSE gap_type END AS gap_type, CASE side WHEN 'g' THEN 'yes' ELSE linkage END AS linkage,
        CASE WHEN side = 'w' THEN ident WHEN side = 'g' THEN NULL WHEN lower THEN ident || 'a' ELSE ident || 'b' END AS ident,
        CASE WHEN side = 'w' THEN cstart WHEN side = 'g' THEN NULL WHEN lower THEN cstart ELSE 1 END AS cstart,
        CASE WHEN side = 'w' THEN cend WHEN side = 'g' THEN NULL WHEN lower THEN cstart ELSE 1 END + CASE side WHEN 'w' THEN 0 ELSE e - s END AS cend, CASE side WHEN 'g' THEN NULL ELSE orient END AS orient FROM q WHERE s <= e"""),
    "i21_compose_trims": with_views("hits", "WITH w AS (SELECT query_id, gaps::BIGINT AS g, q_end, row_number() OVER (PARTITION BY query_id ORDER BY line_no DESC) AS k, sum(gaps) OVER (PARTITION BY query_id) AS t, count(*) OVER (PARTITION BY query_id) AS n FROM hits) SELECT query_id AS id, (t + 1)::BIGINT AS start, (t - g + q_end)::BIGINT AS \"end\", n::INTEGER AS passes FROM w WHERE k = 1"),
    "i22_convert_coords": with_views("features", "SELECT id, start - 1 AS first, \"end\" - start + 1 AS second FROM features"),
    "i23_marker_conflicts": with_views("marker_locations", "WITH g AS (SELECT marker, min(linkage_group)::VARCHAR AS chr FROM marker_locations GROUP BY marker), u AS (SELECT marker, 'genome' AS map, chr FROM g UNION SELECT marker, map, linkage_group::VARCHAR FROM marker_locations) SELECT marker, string_agg(map || ':' || chr, ',' ORDER BY map || ':' || chr) AS locations FROM u GROUP BY marker HAVING count(DISTINCT chr) > 1"),
    "i24_marker_midpoints": with_views("marks marker_locations", """WITH l AS (SELECT marker, 'chr' || min(linkage_group) AS chr FROM marker_locations GROUP BY marker)
        SELECT m.id AS marker, m.ref AS chr, CASE WHEN (start + "end") % 2 = 0 THEN (start + "end") // 2 WHEN ((start + "end") // 2) % 2 = 0 THEN (start + "end") // 2 ELSE (start + "end") // 2 + 1 END / 1e6 AS position,
        CASE WHEN "end" - start > 200 THEN 'error' WHEN "end" - start < 100 THEN 'warn' ELSE 'ok' END AS span_check FROM marks m JOIN l ON l.marker = m.id AND l.chr = m.ref"""),
    "i25_flip_group": with_views("marker_locations", "WITH l AS (SELECT map, linkage_group, marker, max(position) AS position FROM marker_locations GROUP BY ALL), m AS (SELECT *, max(position) OVER (PARTITION BY map, linkage_group) AS top, CASE WHEN substr(marker, 2)::INTEGER % 3 = 1 THEN position - 1 END AS n FROM l) SELECT map, linkage_group, marker, top - position AS position, CASE WHEN n <> 0 THEN top - n END AS north, CASE WHEN position + 1 <> 0 THEN top - (position + 1) END AS south FROM m"),
    "i8_tpf_splice": with_views("features marks", """WITH t AS (SELECT substr(id, 2)::BIGINT AS ord, 'A' || (substr(id, 2)::BIGINT % 4000) AS accession, ref FROM features), n AS (SELECT substr(id, 2)::BIGINT AS ord, 'N' || id AS accession, ref FROM marks),
        e AS (SELECT min(ord) FILTER (accession = 'A100') AS lo, min(ord) FILTER (accession = 'A900') AS hi FROM t), s AS (SELECT count(*) AS n, min(ord) AS base FROM n)
        SELECT CASE WHEN ord <= lo THEN ord ELSE ord - (hi - lo - 1) + s.n END AS ord, accession, ref FROM t, e, s WHERE ord <= lo OR ord >= hi UNION ALL SELECT lo + 1 + ord - base, accession, ref FROM n, e, s"""),
    "i8_tpf_interval": with_views("features", "WITH t AS (SELECT substr(id, 2)::BIGINT AS ord, 'A' || (substr(id, 2)::BIGINT % 4000) AS accession, ref FROM features) SELECT * FROM t WHERE ord BETWEEN (SELECT min(ord) FROM t WHERE accession = 'A100') AND (SELECT min(ord) FROM t WHERE accession = 'A900')"),
    "i8_tpf_index": with_views("features marks", "SELECT 'A' || substr(m.id, 2) AS accession, t.ord FROM marks m LEFT JOIN (SELECT 'A' || (substr(id, 2)::BIGINT % 4000) AS accession, min(substr(id, 2)::BIGINT) AS ord FROM features GROUP BY 1) t ON t.accession = 'A' || substr(m.id, 2)"),
    "i21_trim_tags": with_views("hits", """WITH p AS (SELECT query_id AS id, mismatches AS pass, min_by(gaps + 1, line_no)::BIGINT AS start, max(q_end) AS e FROM hits GROUP BY ALL),
        s AS (SELECT *, coalesce(sum(start - 1) OVER (PARTITION BY id ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM p)
        SELECT id, pass, 'vector' AS tag, start + 3 + b AS start, e + b AS "end", id NOT IN (SELECT id FROM p WHERE pass = 4) AS removed FROM s"""),
    "g1_adjacency": with_views("edges", """WITH b AS (SELECT src AS node, dst AS other, weight, line_no FROM edges UNION ALL SELECT dst, src, weight, line_no FROM edges),
        l AS (SELECT node, other, max_by(weight, line_no) AS weight FROM b GROUP BY ALL) SELECT node, count(*) AS degree, min(other) AS first, min_by(weight, other) AS weight FROM l GROUP BY node"""),
    "g2_components": _components_sql("SELECT node, min(reached) AS component FROM r GROUP BY node"),
    "g5_cluster_sizes": with_views("old_builds", "SELECT cluster_id, count(*) AS size FROM old_builds GROUP BY cluster_id HAVING count(*) BETWEEN 2 AND 30"),
    "g5_size_histogram": with_views("old_builds", "WITH s AS (SELECT cluster_id, count(*) AS n FROM old_builds GROUP BY cluster_id), m AS (SELECT max(n) AS m FROM s) SELECT least((n * 20) // (m + 1), 19)::INTEGER AS bin, min(n) AS smallest, max(n) AS largest, count(*) AS clusters FROM s, m GROUP BY 1"),
    "g8_relabel": with_views("old_builds", "SELECT 'N' || (cluster_id % 50) AS cluster_id, member_id FROM old_builds"),
    "g9_threshold_clusters": _components_sql(
        """, c AS (SELECT node, min(reached) AS k FROM r GROUP BY node), a AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)
        , cn AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM (SELECT DISTINCT k FROM c)), sn AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM a WHERE id NOT IN (SELECT node FROM c))
        SELECT a.id, CASE WHEN c.k IS NULL THEN 'SG-' || sn.n ELSE 'CL-' || cn.n END AS cluster, length(g.note) / 4.0::DOUBLE AS likelihood FROM a LEFT JOIN c ON c.node = a.id LEFT JOIN cn ON cn.k = c.k LEFT JOIN sn ON sn.id = a.id LEFT JOIN genes g ON 'O' || substr(g.id, 2) = a.id""", " WHERE weight <= 3"
    ).replace(" , c AS", ", c AS"),
    "g10_family_members": with_views("members", "SELECT family, 'g' || member AS gene, strain AS taxon, count(*) OVER (PARTITION BY family) AS n_members, (SELECT count(DISTINCT strain) FROM members x WHERE x.family = m.family AND strain <> 'st3') AS n_taxa FROM members m WHERE strain <> 'st3'"),
    "g11_family_track": with_views("members features", """WITH m AS (SELECT family || '_' || right(member, 1) AS family, member AS gene, strain AS species FROM members), f AS (SELECT 'V' || substr(id, 2) AS gene, ref, start, "end" FROM features),
        x AS (SELECT m.family, f.* FROM m JOIN f USING (gene) WHERE species = 'st1'), n AS (SELECT family, count(*) AS n FROM m GROUP BY family)
        SELECT x.ref, x.start, x."end", x.gene, family, m.gene AS member, m.species FROM x JOIN n USING (family) JOIN m USING (family) WHERE n.n <= 20 AND m.gene <> x.gene
        UNION ALL SELECT x.ref, x.start, x."end", x.gene, family, NULL, 'large family' FROM x JOIN n USING (family) WHERE n.n > 20"""),
    "g13_cluster_sequences": with_views("old_builds seqs", "SELECT cluster_id, member_id::VARCHAR AS id, length(seq) AS length, CASE WHEN line_no % 2 = 0 THEN length(seq) END AS n_qual, count(*) OVER (PARTITION BY cluster_id) AS size FROM old_builds LEFT JOIN seqs ON seqs.id = member_id::VARCHAR"),
    "g13_unlisted": with_views("old_builds seqs", "SELECT cluster_id, member_id::VARCHAR AS id FROM old_builds WHERE member_id::VARCHAR NOT IN (SELECT id FROM seqs)"),
    "g13_unigene_names": with_views("seqs", "SELECT CASE line_no % 3 WHEN 0 THEN (line_no % 50) || '-' || id WHEN 1 THEN (line_no % 50) || '-S-' || id ELSE 'X-S-' || id END AS unigene, CASE line_no % 3 WHEN 0 THEN 'contig' WHEN 1 THEN 'singlet' ELSE 'singleton' END AS kind, md5(seq) AS md5 FROM seqs"),
    "g12_supported_orthologs": with_views("hits", "WITH l AS (SELECT subject_id AS file, line_no, CASE WHEN mismatches = 1 THEN query_id END AS gene, CASE WHEN mismatches <> 1 THEN query_id END AS ortholog, (2 * (pident - 50))::INTEGER AS bootstrap FROM hits), f AS (SELECT *, last_value(gene IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM l) SELECT file AS family, g AS gene, ortholog, bootstrap FROM f WHERE ortholog IS NOT NULL AND bootstrap >= 60"),
    "i9_place_bacs": with_views("features marks", "WITH " + _AGP + """, l AS (SELECT objname, ostart AS s, oend AS e, CASE partnum % 10 WHEN 3 THEN 'U' WHEN 7 THEN 'N' ELSE 'W' END AS type, ident, cstart, cend, orient, partnum FROM agp),
        f AS (SELECT 'sc' || (partnum % 400) AS scaffold, min_by(objname, partnum) AS o, min_by(s, partnum) AS b FROM l WHERE ident IS NOT NULL GROUP BY 1),
        h AS (SELECT *, substr(id, 2)::BIGINT AS n, (substr(id, 2)::BIGINT * 31) % 5000 + 1 AS sp FROM marks),
        bac AS (SELECT f.o AS objname, sp + b - 1 AS s, sp + 2000 + b - 1 AS e, 'O' AS type, CASE WHEN n % 3 = 0 THEN 'LE' || id ELSE 'C01' || id END AS ident, 1::BIGINT AS cstart, "end" - start + 1 AS cend, CASE WHEN n % 2 = 0 THEN '' ELSE 'REV' END AS orient FROM h JOIN f ON f.scaffold = 'sc' || (n % 500)),
        r AS (SELECT objname, s, e, type, ident, cstart, cend, orient FROM l WHERE NOT EXISTS (SELECT 1 FROM bac WHERE bac.objname = l.objname AND l.s > bac.s AND l.e < bac.e) UNION ALL SELECT * FROM bac),
        w AS (SELECT *, max(CASE WHEN type IN ('W', 'O') THEN {'e': e, 'i': ident, 't': type} END) OVER b AS far, last_value(CASE WHEN type = 'W' THEN orient END IGNORE NULLS) OVER b AS lf, first_value(CASE WHEN type = 'W' THEN orient END IGNORE NULLS) OVER (PARTITION BY objname ORDER BY s, e, coalesce(ident, '') ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rt,
          lag(type) OVER (PARTITION BY objname ORDER BY s, e, coalesce(ident, '')) AS pv, lead(type) OVER (PARTITION BY objname ORDER BY s, e, coalesce(ident, '')) AS nx, coalesce(sum(CASE WHEN type = 'U' THEN 100 - (e - s + 1) ELSE 0 END) OVER b, 0)::BIGINT AS shift
          FROM r WINDOW b AS (PARTITION BY objname ORDER BY s, e, coalesce(ident, '') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        o AS (SELECT *, CASE WHEN lf = rt THEN lf WHEN rt IS NULL OR nx = 'U' THEN lf WHEN lf IS NULL OR pv = 'U' THEN rt END AS side, type IN ('W', 'O') AND (type = 'O' OR far.t = 'O') AS mx FROM w)
        SELECT objname, s + shift AS start, CASE WHEN type = 'U' THEN s + 99 ELSE e END + shift AS "end", type, ident, cstart, cend,
        CASE WHEN type = 'O' THEN coalesce(CASE WHEN orient <> 'REV' THEN side WHEN side = '+' THEN '-' WHEN side = '-' THEN '+' END, 'ERROR') ELSE orient END AS orient,
        CASE WHEN mx AND far.e > e THEN 'CONTAINED' || chr(9) || far.i WHEN mx AND far.e > s THEN 'CONTAINED TURNOUT' || chr(9) || far.i END AS status FROM o"""),
}
