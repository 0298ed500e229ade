"""Queries over alignment hits (H1 to H15) and the similarity graphs built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sporeline.operators import hits as H
from sporeline.plans.adapters import view, with_views

_BEST = """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}, line_no) AS rn FROM {src}) WHERE rn = 1"""


def _best(src="hits", key="query_id", order="score DESC"):
    return _BEST.format(src=src, key=key, order=order)


def h1_filter_hits(spark, d):
    return H.filter_hits(view(spark, d, "hits"), [("pident", ">=", 90), ("length", ">", 420), ("gaps", "<=", 1)])


def h1_filter_any(spark, d):
    return H.filter_hits(view(spark, d, "hits"), [("pident", ">=", 99), ("mismatches", "=", 7)], combine="any")


def h2_full_length_bac(spark, d):
    hits = view(spark, d, "hits").withColumn("pident", F.when(F.col("mismatches") < 6, 100.0).otherwise(F.col("pident")))
    return H.full_length_bac_hits(hits, view(spark, d, "lengths"), slack=300).select("query_id", "subject_id", "length", "query_length", "line_no")


def h3_repeat_copies(spark, d):
    return H.repeat_copy_number(view(spark, d, "hits"), 80, 200)


def h4_best_hit(spark, d):
    best = H.best_hit(H.filter_hits(view(spark, d, "hits"), [("pident", ">=", 60)]))
    return H.annotate_hits(best, view(spark, d, "subjects"))


def h4_first_hit(spark, d):
    return H.best_hit(view(spark, d, "hits"), "first").select("query_id", "subject_id", "line_no")


def h5_reciprocal_best(spark, d):
    return H.reciprocal_best_hits(view(spark, d, "hits"))


def h6_hit_coverage(spark, d):
    found = H.hit_coverage(view(spark, d, "hits").withColumn("subject_id", F.lit("S")), view(spark, d, "lengths"), 60, 60)
    return found.select("query_id", "covered", "regions", F.round("coverage", 4).alias("coverage"), F.round("identity", 4).alias("identity"))


def h7_annotate_hits(spark, d):
    return H.annotate_hits(view(spark, d, "hits"), view(spark, d, "subjects")).select("query_id", "subject_id", "line_no", "description")


def h7_annotate_records(spark, d):
    hits = H.annotate_hits(view(spark, d, "hits"), view(spark, d, "subjects"))
    out = H.annotate_records(view(spark, d, "genes"), hits.withColumn("evalue", F.col("mismatches")), "(*GB)", text_col="note")
    return out.select("id", "note")


def h8_transfer(spark, d):
    hits = H.annotate_hits(view(spark, d, "hits"), view(spark, d, "subjects"))
    number = F.regexp_replace("subject_id", "S", "").cast("long")
    ath = hits.where("gaps = 0").withColumn("description", F.when(number % 3 > 0, F.col("description")))  # the others are in no pathway
    sources = [("ATH", ath, 0.03), ("SWP", hits.where("gaps = 1"), 0.05), ("GB", hits.where("gaps = 2"), 0.2)]
    ec = view(spark, d, "subjects").select(F.explode(F.array(F.lit("ATH"), F.lit("SWP"))).alias("source"), "subject_id", F.explode(F.array(F.lit("1.1.1.1"), F.concat(F.lit("2.1.1."), F.col("subject_length")))).alias("ec"))
    return H.transfer_annotation(view(spark, d, "genes"), sources, ec)


def h9_gene_records(spark, d):
    functions = view(spark, d, "subjects").select(F.regexp_replace("subject_id", "S", "Q").alias("id"), F.col("description").alias("function"))
    hits = H.annotate_hits(view(spark, d, "hits").where("pident > 90"), view(spark, d, "subjects"))
    return H.gene_records(view(spark, d, "genes"), functions.where("id like '%7'"), hits, cut=2)


def _parts(spark, d):
    h = view(spark, d, "hits").where("mismatches < 6")
    kind = F.when(F.col("mismatches") % 2 == 0, "intron").otherwise("CDS")
    return h.select(F.concat("query_id", F.when(F.col("mismatches") == 3, ".1.1").when(F.col("mismatches") == 5, ".1").otherwise("")).alias("id"), kind.alias("type"), F.col("q_start").alias("start"), F.col("q_end").alias("end"))


def h9_gene_parts(spark, d):
    return H.gene_parts(view(spark, d, "genes").select("id"), _parts(spark, d).where("id NOT LIKE '%.1' OR type = 'CDS'"), cut=4)


def h9_pathologic_records(spark, d):
    g = view(spark, d, "genes")
    genes = g.select(F.concat(F.lit("chr"), F.length("id")).alias("seqid"), "id", F.when(F.col("note") != "", F.col("note")).alias("name"), F.when(F.length("note") % 2 == 0, "-").otherwise("+").alias("strand"), F.lit(5).cast("long").alias("start"), F.lit(2000).cast("long").alias("end"))
    named = g.select("id", F.concat(F.lit("f "), "id").alias("function"))
    of = lambda c, x: view(spark, d, "hits").where(x).select(F.col("query_id").alias("id"), F.col("subject_id").alias(c))
    found = H.pathologic_records(genes, named, h9_gene_parts(spark, d), of("ec", "gaps = 0"), of("synonym", "gaps = 1"), of("dblink", "gaps = 2"))
    return found.select("seqid", "id", F.array_join(F.transform("fields", lambda f: F.concat_ws("=", f["key"], f["value"])), "|").alias("record"))


def h10_full_length(spark, d):
    return H.full_length_hits(view(spark, d, "hits"), view(spark, d, "subjects")).select("query_id", "subject_id", "pident", "length", "subject_length", "description")


def h10_identity_histogram(spark, d):
    return H.identity_histogram(view(spark, d, "hits"))


def h10_organisms(spark, d):
    named = H.annotate_hits(view(spark, d, "hits"), view(spark, d, "subjects"))
    out = H.organism_summary(named, rare=2400)
    return out.select("organism", "hits", F.round("mean_ident", 4).alias("mean_ident"))


def _ends(spark, d):
    end = F.when(F.col("gaps") == 0, ":5").otherwise(":3")
    return view(spark, d, "hits").withColumn("query_id", F.concat("query_id", end))


def h11_chimera_by_ends(spark, d):
    linked = view(spark, d, "hits").select("subject_id", "q_start").where("gaps = 1").select(F.col("subject_id").alias("query_id"), F.concat(F.lit("S"), F.col("q_start")).alias("subject_id"))
    return H.chimera_by_ends(_ends(spark, d), linked)


def h12_chimera_by_spans(spark, d):
    hits = view(spark, d, "hits").withColumn("query_id", F.col("subject_id")).withColumn("subject_id", F.lit("x"))
    hits = hits.withColumn("q_end", F.col("q_start") + 12)
    return H.chimera_by_spans(hits)


def h13_contrast_groups(spark, d):
    return H.contrast_group_genes(view(spark, d, "hits"), F.concat(F.lit("sp"), F.col("mismatches")), ["sp1", "sp2"], ["sp3", "sp4"], ["sp7"], 2, 1)


def h14_parent_allele(spark, d):
    hits = view(spark, d, "hits").withColumn("parent", F.concat(F.lit("p"), F.col("gaps")))
    return H.parent_allele_by_hit(hits)


def h15_kmer_candidates(spark, d):
    return H.kmer_candidates(view(spark, d, "seqs"), 24, 96)


def h15_equal_sequences(spark, d):
    return H.equal_sequences(view(spark, d, "seqs"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "h" and "_" in k and callable(v)}

_ISL = """
reach AS (SELECT *, max({e}) OVER (PARTITION BY {k} ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {src}),
grp AS (SELECT *, sum(CASE WHEN {s} <= r + {adj} THEN 0 ELSE 1 END) OVER (PARTITION BY {k} ORDER BY {s}, {e} ROWS UNBOUNDED PRECEDING) AS g FROM reach)"""

_PARTS = """WITH p AS (SELECT query_id AS gene, q_start AS s, q_end AS e, mismatches IN (1, 3, 5) AS cds FROM hits WHERE mismatches < 6),
        g AS (SELECT gene, min(s) FILTER (cds) AS cds_start, max(e) FILTER (cds) AS cds_end, string_agg(s || '-' || e, ',' ORDER BY s, e) FILTER (NOT cds) AS introns FROM p GROUP BY gene)"""

SQL = {
    "h1_filter_hits": with_views("hits", "SELECT * FROM hits WHERE pident >= 90 AND length > 420 AND gaps <= 1"),
    "h1_filter_any": with_views("hits", "SELECT * FROM hits WHERE pident >= 99 OR mismatches = 7"),
    "h2_full_length_bac": with_views("hits lengths", "SELECT query_id, subject_id, length, query_length, line_no FROM hits JOIN lengths USING (query_id) WHERE mismatches <= 5 AND length BETWEEN query_length - 300 AND query_length"),
    "h3_repeat_copies": with_views("hits", "SELECT query_id, count(*) AS copies FROM hits WHERE pident >= 80 AND length >= 200 GROUP BY query_id"),
    "h4_best_hit": with_views("hits subjects", f"SELECT b.*, s.description FROM ({_best('(SELECT * FROM hits WHERE pident >= 60)')}) b LEFT JOIN subjects s USING (subject_id)"),
    "h4_first_hit": with_views("hits", f"SELECT query_id, subject_id, line_no FROM ({_best(order='query_id')})"),
    "h5_reciprocal_best": with_views("hits", f"SELECT f.query_id, f.subject_id, f.evalue FROM ({_best(order='evalue')}) f JOIN ({_best(key='subject_id', order='evalue')}) b ON f.query_id = b.query_id AND f.subject_id = b.subject_id"),
    "h6_hit_coverage": with_views(
        "hits lengths",
        "WITH " + _ISL.format(src="hits", k="query_id", s="q_start", e="q_end", adj=1).lstrip() + """,
        reg AS (SELECT query_id, g, min(q_start) AS s, max(q_end) AS e, max(pident) FILTER (NOT EXISTS (SELECT 1 FROM hits x WHERE x.query_id = grp.query_id AND x.q_start <= grp.q_start AND x.q_end >= grp.q_end AND x.q_end - x.q_start > grp.q_end - grp.q_start)) AS ident FROM grp GROUP BY ALL),
        pairs AS (SELECT query_id, sum(e - s + 1)::BIGINT AS covered, count(*) AS regions, avg(ident) AS identity FROM reg GROUP BY query_id)
        SELECT query_id, covered, regions, round(100.0::DOUBLE * covered / query_length, 4) AS coverage, round(identity, 4) AS identity FROM pairs JOIN lengths USING (query_id)
        WHERE 100.0 * covered / query_length > 60 AND identity > 60 AND regions - 1 <= 10""",
    ),
    "h7_annotate_hits": with_views("hits subjects", "SELECT query_id, subject_id, line_no, description FROM hits LEFT JOIN subjects USING (subject_id)"),
    "h7_annotate_records": with_views("hits subjects genes", f"SELECT g.id, concat_ws(' ', g.note, '(*GB) ' || b.subject_id || ' (e_value=' || b.mismatches || ') ' || coalesce(s.description, '')) AS note FROM genes g LEFT JOIN ({_best(order='query_id')}) b ON g.id = b.query_id LEFT JOIN subjects s USING (subject_id)"),
    "h8_transfer": with_views(
        "hits subjects genes",
        "WITH a AS (SELECT hits.*, CASE WHEN gaps > 0 OR substr(subject_id, 2)::BIGINT % 3 > 0 THEN description END AS description FROM hits LEFT JOIN subjects USING (subject_id)), " + ", ".join(f"b{i} AS (SELECT * FROM ({_best(f'(SELECT * FROM a WHERE gaps = {i} AND evalue < {c})')}) WHERE description IS NOT NULL)" for i, c in enumerate((0.03, 0.05, 0.2)))
        + """, c AS (SELECT g.id, CASE WHEN b0.query_id IS NOT NULL THEN 'ATH' WHEN b1.query_id IS NOT NULL THEN 'SWP' WHEN b2.query_id IS NOT NULL THEN 'GB' END AS source,
        CASE WHEN b0.query_id IS NOT NULL THEN b0.subject_id WHEN b1.query_id IS NOT NULL THEN b1.subject_id ELSE b2.subject_id END AS subject_id,
        CASE WHEN b0.query_id IS NOT NULL THEN b0.description WHEN b1.query_id IS NOT NULL THEN b1.description ELSE b2.description END AS description
        FROM genes g LEFT JOIN b0 ON g.id = b0.query_id LEFT JOIN b1 ON g.id = b1.query_id LEFT JOIN b2 ON g.id = b2.query_id)
        SELECT id, source, c.subject_id, coalesce(description, 'unknown') AS description, 'based on ' || source || ' match (' || c.subject_id || ')' AS comment,
        CASE WHEN source IN ('ATH', 'SWP') THEN '1.1.1.1,2.1.1.' || subject_length END AS ec_numbers FROM c LEFT JOIN (SELECT subject_id, subject_length FROM subjects) x ON x.subject_id = c.subject_id""",
    ),
    "h9_gene_records": with_views(
        "hits subjects genes",
        f"""WITH f AS (SELECT replace(subject_id, 'S', 'Q') AS k, min(description) AS fn FROM subjects WHERE subject_id LIKE '%7' GROUP BY 1),
        t AS (SELECT id, max_by(fn, length(k)) AS fn FROM (SELECT DISTINCT id, substr(id, 1, (length(id) - c)::BIGINT) AS k FROM genes, range(3) r(c)) JOIN f USING (k) WHERE k <> '' GROUP BY id),
        b AS ({_best('(SELECT * FROM hits JOIN subjects USING (subject_id) WHERE pident > 90)')})
        SELECT g.id, coalesce(t.fn, nullif(trim(note), ''), b.description, 'ORF') AS function,
        CASE WHEN t.fn IS NOT NULL THEN 'table' WHEN trim(note) <> '' THEN 'note' WHEN b.description IS NOT NULL THEN 'hit' ELSE 'none' END AS function_source
        FROM genes g LEFT JOIN t USING (id) LEFT JOIN b ON b.query_id = g.id""",
    ),
    "h9_gene_parts": with_views("hits genes", _PARTS + " SELECT id, cds_start, cds_end, introns FROM genes LEFT JOIN g ON g.gene = id"),
    "h9_pathologic_records": with_views("hits genes", _PARTS + """, x AS (SELECT query_id AS gene, string_agg(DISTINCT 'EC=' || subject_id, '|' ORDER BY 'EC=' || subject_id) FILTER (gaps = 0) AS ec, string_agg(DISTINCT 'SYNONYM=' || subject_id, '|' ORDER BY 'SYNONYM=' || subject_id) FILTER (gaps = 1) AS sy, string_agg(DISTINCT 'DBLINK=' || subject_id, '|' ORDER BY 'DBLINK=' || subject_id) FILTER (gaps = 2) AS db FROM hits GROUP BY 1),
        y AS (SELECT genes.id, note, coalesce(cds_start, 5) AS lo, coalesce(cds_end, 2000) AS hi, introns, ec, sy, db FROM genes LEFT JOIN g ON g.gene = id LEFT JOIN x ON x.gene = id)
        SELECT 'chr' || length(id) AS seqid, id, concat_ws('|', 'ID=' || id, 'NAME=' || coalesce(nullif(note, ''), id), sy, 'STARTBASE=' || CASE WHEN length(note) % 2 = 0 THEN hi ELSE lo END, 'ENDBASE=' || CASE WHEN length(note) % 2 = 0 THEN lo ELSE hi END,
        'INTRON=' || replace(introns, ',', '|INTRON='), 'FUNCTION=f ' || id, ec, db, 'PRODUCT-TYPE=P') AS record FROM y"""),
    "h10_full_length": with_views("hits subjects", f"SELECT query_id, subject_id, pident, length, subject_length, description FROM ({_best()}) JOIN subjects USING (subject_id) WHERE pident >= 80 AND length >= 0.99 * subject_length"),
    "h10_identity_histogram": with_views("hits", "SELECT (floor(pident / 10) * 10)::INTEGER AS bin, count(*) AS hits FROM hits GROUP BY 1"),
    "h10_organisms": with_views("hits subjects", "WITH e AS (SELECT regexp_extract(description, 'OS=([^=]+?)(?: [A-Z]{2}=|$)', 1) AS o, count(*) AS n, sum(pident) AS s FROM hits JOIN subjects USING (subject_id) GROUP BY 1) SELECT CASE WHEN n < 2400 THEN 'other' ELSE o END AS organism, sum(n)::BIGINT AS hits, round(sum(s) / sum(n), 4) AS mean_ident FROM e GROUP BY 1"),
    "h11_chimera_by_ends": with_views(
        "hits",
        f"""WITH t AS ({_best("(SELECT * REPLACE (query_id || CASE WHEN gaps = 0 THEN ':5' ELSE ':3' END AS query_id) FROM hits)", order='query_id')}),
        p AS (SELECT regexp_replace(a.query_id, ':5$', '') AS clone, a.subject_id AS subject5, b.subject_id AS subject3 FROM t a JOIN t b ON replace(a.query_id, ':5', ':3') = b.query_id WHERE a.query_id LIKE '%:5' AND a.subject_id <> b.subject_id),
        l AS (SELECT subject_id AS x, 'S' || q_start AS y FROM hits WHERE gaps = 1 UNION SELECT 'S' || q_start, subject_id FROM hits WHERE gaps = 1)
        SELECT clone, subject5, subject3 FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE x = subject5 AND y = subject3)""",
    ),
    "h12_chimera_by_spans": with_views(
        "hits",
        "WITH src AS (SELECT subject_id AS query_id, q_start AS s, q_start + 12 AS e FROM hits WHERE length >= 100)," + _ISL.format(src="src", k="query_id", s="s", e="e", adj=0)
        + """, sp AS (SELECT query_id, g, min(s) AS s, max(e) AS e, count(*) AS n FROM grp GROUP BY ALL),
        w AS (SELECT *, lag(e) OVER (PARTITION BY query_id ORDER BY s) AS le, lag(n) OVER (PARTITION BY query_id ORDER BY s) AS ln FROM sp)
        SELECT query_id, le AS left_end, s AS right_start FROM w WHERE n >= 2 AND ln >= 2 AND s - le < 20""",
    ),
    "h13_contrast_groups": with_views("hits", "SELECT query_id, count(DISTINCT mismatches) FILTER (mismatches IN (1, 2)) AS n_out, count(DISTINCT mismatches) FILTER (mismatches IN (3, 4)) AS n_in FROM hits GROUP BY query_id HAVING n_out >= 2 AND n_in >= 1 AND count(*) FILTER (mismatches = 7) = 0"),
    "h14_parent_allele": with_views("hits", f"WITH b AS ({_best(key='query_id, gaps')}), r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY pident DESC) AS k FROM b) SELECT query_id, string_agg('p' || gaps, ',' ORDER BY gaps) AS parents FROM r WHERE k = 1 GROUP BY query_id"),
    "h15_kmer_candidates": with_views(
        "seqs",
        """WITH q AS (SELECT min(id) AS id, seq FROM seqs GROUP BY seq), w AS (SELECT DISTINCT id, substr(seq, i, 24) AS word FROM (SELECT id, seq, unnest(range(1, length(seq) - 22)) AS i FROM q))
        SELECT x.id AS a, y.id AS b, count(*) * 24 AS score FROM w x JOIN w y ON x.word = y.word AND x.id < y.id GROUP BY ALL HAVING count(*) * 24 >= 96""",
    ),
    "h15_equal_sequences": with_views("seqs", "SELECT id, min(id) OVER (PARTITION BY seq) AS least FROM seqs"),
}
