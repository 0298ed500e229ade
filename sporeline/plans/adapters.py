"""Views of the driver's tables in the shapes the operators take.

Each view has a Spark form and a DuckDB form that give the same rows; integer
arithmetic and untouched columns keep them equal to the bit. ``line_no``
stands for the place in a file: a 60-bit digest of the row, so that it needs
no global numbering and is the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ROW = "l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)"
_LINE = {
    "spark": f"cast(conv(substring(md5(concat_ws('|', {_ROW}, unix_timestamp(l_shipdate))), 1, 15), 16, 10) as bigint)",
    "duck": f"('0x' || substr(md5(concat_ws('|', {_ROW}, cast(floor(epoch(l_shipdate)) as bigint))), 1, 15))::BIGINT",
}

#: name -> (tables, SQL with {line} and {clean} filled in for each engine)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "hits": (
        ("lineitem",),
        """SELECT concat('Q', l_orderkey) AS query_id, concat('S', l_partkey) AS subject_id, 50 + l_quantity AS pident,
        cast(10 * l_quantity AS bigint) AS length, l_linenumber AS mismatches, l_linenumber % 3 AS gaps,
        cast((l_suppkey * 37) % 900 + 1 AS bigint) AS q_start, cast((l_suppkey * 37) % 900 + 10 * l_quantity AS bigint) AS q_end,
        cast((l_partkey * 53) % 900 + 1 AS bigint) AS s_start, cast((l_partkey * 53) % 900 + 10 * l_quantity AS bigint) AS s_end,
        l_discount AS evalue, l_extendedprice AS score, {line} AS line_no FROM lineitem""",
    ),
    "lengths": (("orders",), "SELECT concat('Q', o_orderkey) AS query_id, cast((o_orderkey * 13) % 400 + 600 AS bigint) AS query_length FROM orders"),
    "subjects": (("part",), "SELECT concat('S', p_partkey) AS subject_id, concat(p_name, ' OS=', p_brand, ' GN=x') AS description, cast(p_size * 10 AS bigint) AS subject_length FROM part"),
    "genes": (("orders",), "SELECT concat('Q', o_orderkey) AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE '' END AS note FROM orders"),
    "seqs": (("documents",), "SELECT cast(doc_id AS {str}) AS id, upper({clean}) AS seq, source AS descr, doc_id AS line_no FROM documents"),
    "features": (
        ("orders",),
        """SELECT concat('chr', o_custkey % 12) AS ref, cast((o_orderkey * 7) % 100000 + 1 AS bigint) AS start,
        cast((o_orderkey * 7) % 100000 + 1 + cast(floor(o_totalprice) AS bigint) % 500 AS bigint) AS "end", o_orderstatus AS type, concat('F', o_orderkey) AS id FROM orders""",
    ),
    "marks": (
        ("customer",),
        """SELECT concat('chr', c_custkey % 12) AS ref, cast((c_custkey * 61) % 100000 + 1 AS bigint) AS start,
        cast((c_custkey * 61) % 100000 + 1 + (c_custkey * 17) % 900 AS bigint) AS "end", concat('M', c_custkey) AS id FROM customer""",
    ),
    "contig_reads": (("lineitem",), "SELECT concat('C', l_partkey) AS contig_id, {line} AS read_id, concat(l_returnflag, l_linestatus) AS library, cast(l_quantity AS bigint) AS span, cast((l_suppkey * 37) % 900 AS bigint) AS start, {line} AS line_no FROM lineitem"),
    "contig_lengths": (("part",), "SELECT concat('C', p_partkey) AS contig_id, cast(p_size * 100 AS bigint) AS length FROM part"),
    # every line of lineitem; 16 orders share 64 possible partners, so components stay small however long the table is
    "edges": (("lineitem",), "SELECT concat('O', l_orderkey) AS src, concat('P', (l_orderkey - l_orderkey % 16) * 4 + l_partkey % 64) AS dst, l_linenumber AS weight, {line} AS line_no FROM lineitem"),
    "old_builds": (("lineitem",), "SELECT DISTINCT l_partkey AS cluster_id, l_orderkey AS member_id FROM lineitem"),
    "new_builds": (("lineitem",), "SELECT DISTINCT l_suppkey AS cluster_id, CASE WHEN l_orderkey % 10 = 3 THEN -l_orderkey ELSE l_orderkey END AS member_id FROM lineitem"),
    "domains": (
        ("lineitem",),
        """SELECT concat('Q', l_orderkey) AS id, l_returnflag AS method, cast((l_suppkey * 37) % 900 + 1 AS bigint) AS start, cast((l_suppkey * 37) % 900 + l_quantity AS bigint) AS "end", l_discount AS evalue,
        concat('Biological Process: term', l_partkey % 7, ' (GO:000', l_partkey % 7, '); Molecular Function: act', l_suppkey % 5, ' (GO:100', l_suppkey % 5, ')') AS go FROM lineitem""",
    ),
    "genotypes": (("lineitem",), "SELECT concat('A', l_suppkey) AS accession, concat('M', l_partkey) AS marker, cast(l_linenumber % 4 AS {str}) AS call, {line} AS line_no FROM lineitem"),
    "variants": (
        ("lineitem",),
        """SELECT cast(l_orderkey % 500 AS {str}) AS seq_id, l_partkey AS pos, CASE l_linenumber % 4 WHEN 0 THEN 'A,G' WHEN 1 THEN 'T,C' WHEN 2 THEN '*,A' ELSE 'G,T' END AS alleles,
        concat('S1=', CASE WHEN l_partkey % 2 = 0 THEN 'AA' ELSE 'AB' END, ',S2=', CASE WHEN l_suppkey % 3 = 0 THEN 'AB' ELSE 'BB' END) AS genotypes FROM lineitem""",
    ),
    "pedigrees": (("customer",), "SELECT c_name AS accession, concat('L', c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN '/.' WHEN c_custkey % 5 = 0 THEN '' ELSE concat('/L', c_custkey % 40, '//L', c_custkey % 11) END) AS pedigree FROM customer"),
    "stocks": (("nation",), "SELECT concat('L', n_nationkey) AS name FROM nation"),
    "marker_locations": (("part",), "SELECT concat('M', p_partkey % 300) AS marker, concat('map', p_size % 3) AS map, p_size % 12 AS linkage_group, p_retailprice AS position FROM part"),
    "signals": (("lineitem",), "SELECT concat('T', l_partkey) AS template, cast(l_quantity AS bigint) AS signal FROM lineitem"),
    "members": (("embeddings",), "SELECT label AS family, concat('V', vec_id) AS member, concat('st', vec_id % 4) AS strain FROM embeddings"),
    "members_go": (("embeddings",), "SELECT concat('V', vec_id) AS member, concat('GO:', vec_id % 9) AS go_id FROM embeddings WHERE vec_id % 3 <> 0"),
    # families of one label in 60 rows: their number grows with the table, their size does not
    "aligned": (
        ("embeddings",),
        """SELECT (vec_id - vec_id % 60) * 10 + label AS family, concat('V', vec_id) AS member,
        concat(repeat('-', cast(vec_id % 7 AS int)), substring('ACGTACGGTACCATGCATTACGGATCCA', cast(vec_id % 7 + 1 AS int), cast(20 - vec_id % 5 AS int)), repeat('-', cast(vec_id % 5 + 8 - vec_id % 7 AS int))) AS seq FROM embeddings""",
    ),
    "libraries": (("nation",), "SELECT n_nationkey AS library_id, n_regionkey AS organism_id, n_name AS name FROM nation"),
    "clones": (("customer",), "SELECT c_custkey AS clone_id, c_nationkey AS library_id, c_name AS clone_name FROM customer"),
    "reads": (("orders",), "SELECT o_orderkey AS read_id, o_custkey AS clone_id, o_orderstatus AS status FROM orders"),
    "ests": (("lineitem",), "SELECT {line} AS est_id, l_orderkey AS read_id, l_linenumber % 2 AS flags, l_returnflag AS status, l_partkey AS unigene_id FROM lineitem"),
    "organisms": (("region",), "SELECT r_regionkey AS organism_id, r_name AS organism FROM region"),
    "cds": (("lineitem",), "SELECT {line} AS cds_id, l_partkey AS unigene_id, cast(l_quantity AS bigint) AS length FROM lineitem"),
}

_FILL = {
    "spark": {"line": _LINE["spark"], "clean": "regexp_replace(text, '[^acgtn]', '')", "str": "string"},
    "duck": {"line": _LINE["duck"], "clean": "regexp_replace(text, '[^acgtn]', '', 'g')", "str": "varchar"},
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables in ``sf_dir``, with no temporary name left behind in the session."""
    tables, sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    text = sql.format(**_FILL["spark"]).replace('"end"', "`end`")
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **frames)


def with_views(names: str, body: str) -> str:
    """DuckDB SQL: the named views as common table expressions before ``body``."""
    parts = [f"{n} AS ({VIEWS[n][1].format(**_FILL['duck'])})" for n in names.split()]
    return f"WITH {', '.join(parts)}{',' if body.lstrip().upper().startswith('WITH ') else ''} {body.lstrip()[5:] if body.lstrip().upper().startswith('WITH ') else body}"


def peptide_sql(seq: str) -> str:
    """DuckDB SQL for the amino acids of the codons of ``seq``; the same code table as functions.bases."""
    place = [f"instr('TCAG', substr(x, {i}, 1))" for i in (1, 2, 3)]
    amino = f"CASE WHEN {place[0]} * {place[1]} * {place[2]} = 0 THEN 'X' ELSE substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', 16 * ({place[0]} - 1) + 4 * ({place[1]} - 1) + {place[2]}, 1) END"
    return f"array_to_string(list_transform(regexp_extract_all({seq}, '...'), lambda x: {amino}), '')"
