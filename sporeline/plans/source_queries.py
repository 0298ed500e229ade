"""Queries over sources and sinks (S1 to S19) and the stream.

Each writes the whole of a table's view as files of the format under the
shared folder and reads them back, so that the reader's result is checked
against the view itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeline.functions.storage import shared_dir
from sporeline.plans.adapters import view, with_views
from sporeline.plans.interval_queries import SQL as INTERVAL_SQL
from sporeline.sources import sequences as S
from sporeline.sources import tables as T
from sporeline.streaming.clusters import ClusterLog, stream_clusters
from sporeline.streaming.hits import stream_best_hits


def _folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _lines(df: DataFrame, *cols, sep: str = "\t") -> str:
    """The columns as text lines in a new folder."""
    path = _folder(df.sparkSession)
    df.select(F.concat_ws(sep, *[c if not isinstance(c, str) else F.col(c) for c in cols]).alias("value")).write.text(path)
    return path


def s1_read_fasta(spark, d):
    path = _folder(spark)
    S.write_fasta(view(spark, d, "seqs"), path, 60)
    return S.read_fasta(spark, path)


def s2_write_fasta(spark, d):
    path = _folder(spark)
    S.write_fasta(view(spark, d, "seqs"), path, 80, by="descr")
    return S.read_fasta(spark, f"{path}/*").select("id", F.length("seq").alias("length"))


def _reads(spark, d):
    qual = F.expr("transform(sequence(1, length(seq)), i -> cast((i * 7 + line_no) % 41 as int))")
    return view(spark, d, "seqs").where("length(seq) > 0").withColumn("qual", qual)


def _summed(df):
    return df.select("id", F.md5("seq").alias("md5"), F.size("qual").cast("long").alias("n"), F.expr("aggregate(qual, 0L, (a, q) -> a + q)").alias("total"))


def s3_fastq(spark, d):
    path = _folder(spark)
    S.write_fastq(_reads(spark, d), path, "illumina")
    return _summed(S.read_fastq(spark, path, "illumina"))


def s3_fastq_default(spark, d):
    path = _folder(spark)
    S.write_fastq(_reads(spark, d).withColumn("qual", F.when(F.col("line_no") % 2 == 0, F.col("qual"))), path, default=15)
    return _summed(S.read_fastq(spark, path))


def s3_read_qual(spark, d):
    path = _lines(_reads(spark, d), F.concat(F.lit(">"), "id", F.lit("\n"), F.array_join(F.col("qual").cast("array<string>"), " ")))
    return S.read_qual(spark, path).select("id", F.size("qual").cast("long").alias("n"))


def s4_fasta_qual(spark, d):
    reads = _reads(spark, d)
    return _summed(S.fasta_qual_to_fastq(reads.select("id", "descr", "seq"), reads.where("line_no % 2 = 0").select("id", "qual"), 15))


def s5_read_m8(spark, d):
    cols = ["query_id", "subject_id", "pident", "length", "mismatches", "gaps", "q_start", "q_end", "s_start", "s_end", "evalue", "score"]
    return T.read_m8(spark, _lines(view(spark, d, "hits"), *[F.col(c).cast("string") for c in cols]))


def s6_gff3(spark, d):
    path = _folder(spark)
    f = view(spark, d, "features")
    attrs = F.create_map(F.lit("ID"), F.array("id"), F.lit("Note"), F.array(F.lit("a;b=c, d"), F.lit("50% + x")))
    T.write_gff3(f.select(F.col("ref").alias("seqid"), F.lit("src").alias("source"), "type", "start", "end", F.lit(None).cast("double").alias("score"), F.lit("+").alias("strand"), F.lit(None).cast("int").alias("phase"), attrs.alias("attrs")), path)
    return T.read_gff3(spark, path).select("seqid", "type", "start", "end", F.col("attrs")["ID"][0].alias("id"), F.array_join(F.col("attrs")["Note"], "|").alias("note"))


def s7_agp(spark, d):
    f = view(spark, d, "features")
    gap = F.col("type") == "P"
    tail = F.when(gap, F.concat_ws("\t", F.lit("N"), F.lit("100"), F.lit("fragment"), F.lit("yes"))).otherwise(F.concat_ws("\t", F.lit("W"), "id", F.lit("1"), (F.col("end") - F.col("start") + 1).cast("string"), F.lit("+")))
    path = _lines(f, "ref", F.col("start").cast("string"), F.col("end").cast("string"), F.regexp_replace("id", "F", ""), tail)
    return T.read_agp(spark, path).drop("line_no")


def s7_tpf(spark, d):
    path = _folder(spark)
    T.write_tpf(view(spark, d, "features").select(F.regexp_replace("id", "F", "").cast("long").alias("ord"), F.col("id").alias("accession"), F.col("ref").alias("clone"), F.lit("ctg").alias("contig"), F.col("type").alias("orient")), path)
    return T.read_tpf(spark, path).select("accession", "clone", "contig", "orient")


def s8_read_ace(spark, d):
    r = view(spark, d, "hits").withColumn("base", F.expr("repeat('ACGT', cast(mismatches as int))"))
    read = F.concat(F.lit("AF r"), "line_no", F.lit(" U "), "q_start", F.lit("\n\nRD r"), "line_no", F.lit(" 9 0 0\n"), "base", F.lit("\n\nQA 1 9 1 9\n"))
    blocks = r.groupBy("subject_id").agg(F.concat_ws("\n", F.collect_list(read)).alias("reads"))
    path = _lines(blocks, F.concat(F.lit("CO "), "subject_id", F.lit(" 10 1 0 U\nACGT\n\nBQ\n20 20\n\n"), "reads"))
    return S.read_ace(spark, path).select("contig_id", "read_id", "orient", "start", "end", "q_end")


def s9_read_maf(spark, d):
    r = view(spark, d, "seqs").where("length(seq) > 4")
    text = F.concat(F.lit("CO\tc"), "id", F.lit("\nCS\tAC*GT\nCQ\tII\"II\nRD\tr"), "id", F.lit("\nRS\tA*"), F.substring("seq", 1, 4), F.lit("\nRQ\tI\"IIII\nER"))
    return S.read_maf_assembly(spark, _lines(r, text), unpad=True).select("contig_id", "contig_seq", F.size("contig_qual").alias("n_contig"), "read_id", "seq", F.size("qual").alias("n"))


def s10_read_uniprot(spark, d):
    p = view(spark, d, "subjects")
    text = F.concat(F.lit("ID   "), "subject_id", F.lit("\nOS   Solanum\nDR   GO; GO:"), F.col("subject_length").cast("string"), F.lit("\nDR   EMBL; X\nDE   "), "description", F.lit("\n//"))
    return S.read_uniprot_flat(spark, _lines(p, text), ["DE", "DR=GO"], "Solanum")


def s11_read_frg(spark, d):
    p = view(spark, d, "subjects")
    text = F.concat(F.lit("{FRG\nact:A\nacc:"), "subject_id", F.lit("\nseq:\nACGT\nAC\n.\nclr:0,6\n}"))
    edits = p.where("subject_length > 250").select(F.col("subject_id").alias("id"), F.lit("clr").alias("tag"), F.lit("1,5").alias("value"))
    return S.read_frg(spark, _lines(p, text), p.where("subject_length < 50").select(F.col("subject_id").alias("id")), edits)


def s12_read_tab(spark, d):
    path = _folder(spark)
    lines = view(spark, d, "subjects").select(F.concat_ws("\t", "subject_id", "description").alias("value"))
    spark.range(1).select(F.lit("id\ttext").alias("value")).union(lines).write.text(path)
    return T.read_tab_checked(spark, path, ["id", "text"])


def s12_read_tab_width(spark, d):
    return T.read_tab_checked(spark, _lines(view(spark, d, "subjects"), "subject_id", F.lit("x"), "description"))


def s13_read_deflines(spark, d):
    p = view(spark, d, "subjects")
    n = F.col("subject_length") / 10 % 4
    style = F.when(n == 0, F.concat(F.lit(">gi|1|gb|"), "subject_id", F.lit("| "))).when(n == 1, F.concat(F.lit(">lcl|"), "subject_id", F.lit(" "))).when(n == 2, F.concat(F.lit(">gnl|BL_ORD_ID|7 "), "subject_id", F.lit(" "))).otherwise(F.concat(F.lit(">"), "subject_id", F.lit(" ")))
    return S.read_deflines(spark, _lines(p, F.concat(style, "description")))


def s14_genotype_matrix(spark, d):
    m = view(spark, d, "marks")
    width = 6
    head = lambda w, f: F.concat_ws("\t", F.lit(w), *[F.lit(f(i)) for i in range(width)])
    heads = spark.range(1).select(F.explode(F.array(head("", lambda i: f"m{i}"), head("", lambda i: f"{i % 3}"), head("", lambda i: f"{i * 1.5}"))).alias("value"))
    calls = m.orderBy("id").select(F.concat_ws("\t", "id", *[F.element_at(F.array(*map(F.lit, "AHB-")), F.expr(f"cast((start + {i}) % 4 as int)") + 1) for i in range(width)]).alias("value"))
    path = _folder(spark)
    heads.coalesce(1).write.text(path)
    calls.coalesce(1).write.mode("append").text(path + "-body")
    both = spark.read.text(path).withColumn("o", F.lit(0)).union(spark.read.text(path + "-body").withColumn("o", F.lit(1)))
    both.repartitionByRange(1, "o").sortWithinPartitions("o").select("value").write.text(path + "-all")  # one file, as matrices come
    return T.read_genotype_matrix(spark, path + "-all")


def s15_read_metrics(spark, d):
    p = view(spark, d, "subjects")
    block = F.concat("subject_id", F.lit(" {\n numReads = "), F.col("subject_length").cast("string"), F.lit(";\n name = \"x\";\n}"))
    return T.read_metrics_blocks(spark, {"run_1": _lines(p, block), "run_2": _lines(p.where("subject_length > 250"), block)})


def s16_parse_signalp(spark, d):
    p = view(spark, d, "subjects")
    yes = F.col("subject_length") > 250
    score = F.when(F.col("subject_length") % 20 == 0, "\n  D     1-21    0.512   0.43   YES").when(F.col("subject_length") % 30 == 0, "\n  D     1-21    0.112   0.43   NO").otherwise("")
    text = F.concat(F.lit(">"), "subject_id", score, F.when(yes, "\n# Most likely cleavage site between pos. 21 and 22\nPrediction: Signal peptide\nMax cleavage site probability: 0.9 between pos. 23 and 24").otherwise("\nPrediction: Non-secretory protein\nMax cleavage site probability: 0.0 between pos. 1 and 2"))
    return T.parse_signalp(spark, _lines(p, text))


def s17_read_repeatmasker(spark, d):
    f = view(spark, d, "marks")
    minus = F.col("start") % 2 == 0
    tail = F.when(minus, "C rep LTR (5) 90 10 1").otherwise("+ rep LTR 10 90 (5) 1")
    return T.read_repeatmasker(spark, _lines(f, F.lit(" 220"), F.lit("1.0 2.0 3.0"), "ref", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("(9)"), tail, sep=" "))


def s18_read_dbest(spark, d):
    p = view(spark, d, "subjects")
    text = F.concat(F.lit("IDENTIFIERS\n\ndbEST Id:       "), F.regexp_replace("subject_id", "S", ""), F.lit("\nEST name:       "), "subject_id", F.lit("\nGenBank Acc:    AC1\n\nCLONE INFO\nClone Id:       c\n\nSEQUENCE\n                ACGT\n                GG\nLIBRARY\nLib Name:       lib\nOrganism:       Solanum\n||"))
    found = S.read_dbest(spark, _lines(p, text))
    shown = F.transform("sections", lambda s: F.concat(s["section"], F.lit("["), F.array_join(F.transform(s["labels"], lambda x: F.concat_ws("=", x["label"], x["value"])), ";"), F.lit("]")))
    return found.withColumn("sections", F.array_join(shown, "|"))


def s19_write_pathologic(spark, d):
    f = view(spark, d, "features")
    fields = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in (("ID", "id"), ("STARTBASE", "start"), ("ENDBASE", "end"))])
    path = _folder(spark)
    T.write_pathologic(f.select(F.col("ref").alias("seqid"), fields.alias("fields")), path)
    return spark.read.text(path).groupBy("seqid", "value").agg(F.count("*").alias("lines"))


#: Rows of one hit file, so that a task that writes or reads one has so many, however long the table is.
HIT_FILE = 1_000_000


def _hit_files(rows: DataFrame, batches: int) -> int:
    """How many hit files: a multiple of ``batches``, each of HIT_FILE rows at most."""
    return batches * -(-max(rows.count(), 1) // (batches * HIT_FILE))


def t1_stream_best_hits(spark, d):
    """The stream reads the hit files as they lie; its last state is the batch answer."""
    path, out = _folder(spark), _folder(spark)
    hits = view(spark, d, "hits")
    files = _hit_files(hits, 4)
    hits.repartition(files).write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = stream_best_hits(spark.readStream.schema(schema).option("maxFilesPerTrigger", files // 4).parquet(path), [("pident", ">=", 60)])

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}-state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    updates = spark.read.parquet(f"{out}/*")
    return updates.groupBy("query_id").agg(F.max_by(F.struct("subject_id", "score", "line_no"), "batch").alias("b")).select("query_id", "b.*")


def t1_stream_clusters(spark, d):
    """The stream reads the hit files as they lie; after its last batch the log holds the components of all hits."""
    path, out = _folder(spark), _folder(spark)
    edges = view(spark, d, "edges").select("src", "dst")
    files = _hit_files(edges, 3)
    edges.repartition(files).write.parquet(path)
    stream = spark.readStream.schema("src string, dst string").option("maxFilesPerTrigger", files // 3).parquet(path)
    log = ClusterLog(spark, f"{out}-log")
    stream_clusters(stream, log, f"{out}-state").awaitTermination()
    return log.members()


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "st" and k[1].isdigit() and callable(v)}

_Q = "list_sum(list_transform(range(1, length(seq) + 1), lambda i: (i * 7 + line_no) % 41))"
SQL = {
    "t1_stream_clusters": INTERVAL_SQL["g2_components"],
    "s1_read_fasta": with_views("seqs", "SELECT id, descr, seq FROM seqs"),
    "s2_write_fasta": with_views("seqs", "SELECT id, length(seq) AS length FROM seqs"),
    "s3_fastq": with_views("seqs", f"SELECT id, md5(seq) AS md5, length(seq) AS n, ({_Q})::BIGINT AS total FROM seqs WHERE length(seq) > 0"),
    "s3_fastq_default": with_views("seqs", f"SELECT id, md5(seq) AS md5, length(seq) AS n, (CASE WHEN line_no % 2 = 0 THEN {_Q} ELSE 15 * length(seq) END)::BIGINT AS total FROM seqs WHERE length(seq) > 0"),
    "s3_read_qual": with_views("seqs", "SELECT id, length(seq) AS n FROM seqs WHERE length(seq) > 0"),
    "s4_fasta_qual": with_views("seqs", f"SELECT id, md5(seq) AS md5, length(seq) AS n, (CASE WHEN line_no % 2 = 0 THEN {_Q} ELSE 15 * length(seq) END)::BIGINT AS total FROM seqs WHERE length(seq) > 0"),
    "s5_read_m8": with_views("hits", "SELECT query_id, subject_id, pident, length::INTEGER AS length, mismatches, gaps, q_start::INTEGER AS q_start, q_end::INTEGER AS q_end, s_start::INTEGER AS s_start, s_end::INTEGER AS s_end, evalue, score FROM hits"),
    "s6_gff3": with_views("features", "SELECT ref AS seqid, type, start, \"end\", id, 'a;b=c, d|50% + x' AS note FROM features"),
    "s7_agp": with_views("features", """SELECT ref AS objname, start AS ostart, "end" AS oend, substr(id, 2)::BIGINT AS partnum, CASE type WHEN 'P' THEN 'N' ELSE 'W' END AS type, type = 'P' AS is_gap, CASE WHEN type <> 'P' THEN id END AS ident, CASE WHEN type <> 'P' THEN 1 END AS cstart, CASE WHEN type <> 'P' THEN "end" - start + 1 END AS cend, CASE WHEN type <> 'P' THEN '+' END AS orient, CASE WHEN type = 'P' THEN 100 END AS length, CASE WHEN type = 'P' THEN 'fragment' END AS gap_type, CASE WHEN type = 'P' THEN 'yes' END AS linkage FROM features"""),
    "s7_tpf": with_views("features", "SELECT id AS accession, ref AS clone, 'ctg' AS contig, type AS orient FROM features"),
    "s8_read_ace": with_views("hits", "SELECT subject_id AS contig_id, 'r' || line_no AS read_id, 'U' AS orient, q_start AS start, q_start + 4 * mismatches - 1 AS \"end\", 9 AS q_end FROM hits"),
    "s9_read_maf": with_views("seqs", "SELECT 'c' || id AS contig_id, 'ACGT' AS contig_seq, 4 AS n_contig, 'r' || id AS read_id, 'A' || substr(seq, 1, 4) AS seq, 5 AS n FROM seqs WHERE length(seq) > 4"),
    "s10_read_uniprot": with_views("subjects", "SELECT subject_id AS id, 'DE' AS key, description AS value FROM subjects UNION SELECT subject_id, 'DR', 'GO; GO:' || subject_length FROM subjects"),
    "s11_read_frg": with_views("subjects", "SELECT subject_id AS id, tag, CASE tag WHEN 'act' THEN 'A' WHEN 'acc' THEN subject_id WHEN 'seq' THEN 'ACGTAC' WHEN 'clr' THEN CASE WHEN subject_length > 250 THEN '1,5' ELSE '0,6' END END AS value FROM subjects, (VALUES ('act'), ('acc'), ('seq'), ('clr')) v(tag) WHERE subject_length >= 50"),
    "s12_read_tab": with_views("subjects", "SELECT subject_id AS id, description AS text FROM subjects"),
    "s12_read_tab_width": with_views("subjects", "SELECT subject_id AS c1, 'x' AS c2, description AS c3 FROM subjects"),
    "s13_read_deflines": with_views("subjects", "SELECT subject_id, description FROM subjects"),
    "s14_genotype_matrix": with_views("marks", "SELECT id AS accession, 'm' || i AS marker, (i % 3)::VARCHAR AS chromosome, (i * 1.5)::DOUBLE AS position, substr('AHB-', ((start + i) % 4 + 1)::BIGINT, 1) AS call FROM marks, range(6) r(i)"),
    "s15_read_metrics": with_views("subjects", "SELECT subject_id AS file, 'numReads' AS metric, subject_length::VARCHAR AS run_1, CASE WHEN subject_length > 250 THEN subject_length::VARCHAR ELSE 'NA' END AS run_2 FROM subjects UNION ALL SELECT subject_id, 'name', 'x', CASE WHEN subject_length > 250 THEN 'x' ELSE 'NA' END FROM subjects"),
    "s16_parse_signalp": with_views("subjects", "SELECT subject_id AS id, CASE WHEN subject_length > 250 AND subject_length % 20 = 0 THEN 21 END AS nn_site, CASE WHEN subject_length > 250 THEN 23 END AS hmm_site FROM subjects"),
    "s17_read_repeatmasker": with_views("marks", "SELECT ref AS seqid, 'repeat_region' AS type, start, \"end\", 220.0::DOUBLE AS score, CASE WHEN start % 2 = 0 THEN '-' ELSE '+' END AS strand, 'rep' AS target, 10 AS t_start, 90 AS t_end FROM marks"),
    "s18_read_dbest": with_views("subjects", "SELECT substr(subject_id, 2) AS id, subject_id AS name, 'AC1' AS accession, 'c' AS clone, 'lib' AS library, 'Solanum' AS organism, 'ACGTGG' AS seq, 'IDENTIFIERS[dbEST Id=' || substr(subject_id, 2) || ';EST name=' || subject_id || ';GenBank Acc=AC1]|CLONE INFO[Clone Id=c]|SEQUENCE[]|LIBRARY[Lib Name=lib;Organism=Solanum]' AS sections FROM subjects"),
    "s19_write_pathologic": with_views("features", """SELECT ref AS seqid, value, count(*) AS lines FROM (SELECT ref, unnest(['ID' || chr(9) || id, 'STARTBASE' || chr(9) || start, 'ENDBASE' || chr(9) || "end", '//']) AS value FROM features) GROUP BY ALL"""),
    "t1_stream_best_hits": with_views("hits", "SELECT query_id, subject_id, score, line_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, line_no) AS rn FROM hits WHERE pident >= 60) WHERE rn = 1"),
}
