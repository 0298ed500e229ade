"""Cases worked out by hand from the rules of the tools that the operators follow."""

from pyspark.sql import functions as F

from sporeline.operators import annotation as A
from sporeline.operators import features as FT
from sporeline.operators import hits as H
from sporeline.operators import intervals as I
from sporeline.operators import warehouse as W


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


SPAN = "id string, ref string, start long, end long"


def test_strict_overlap(spark):
    """An end of a between b's ends, or b between a's; so a longer a that shares an end does not match, a shorter one does."""
    a = frame(spark, [("same", "c", 10, 20), ("left", "c", 10, 30), ("right", "c", 5, 20), ("inner", "c", 10, 15), ("last", "c", 15, 20), ("over", "c", 5, 30), ("cross", "c", 15, 40), ("touch", "c", 20, 30), ("within", "c", 12, 18)], SPAN)
    b = frame(spark, [("b", "c", 10, 20)], SPAN)
    assert {r.id_a for r in I.overlap_join(a, b).collect()} == {"inner", "last", "over", "cross", "within"}
    assert {r.id_a for r in I.overlap_join(a, b, "closed").collect()} == {r.id for r in a.collect()}


def test_overlap_summary(spark):
    """A feature's whole length counts for each mark that overlaps it; a mark is the first of the two ranges."""
    features = frame(spark, [("f", "c", 100, 200), ("g", "c", 300, 310), ("h", "d", 1, 5)], SPAN)
    marks = frame(spark, [("m", "c", 150, 400), ("n", "c", 190, 195), ("o", "c", 100, 250), ("p", "c", 100, 150)], SPAN)
    assert {tuple(r) for r in I.overlap_summary(features, marks).collect()} == {("c", 2, 2, 310), ("d", 1, 0, 0)}


def test_tpf_gaps(spark):
    rows = [(1, "N", "contig", "yes"), (2, "N", "clone", "no"), (3, "U", "fragment", "yes"), (4, "N", "telomere", None), (5, "N", "odd", "yes"), (6, "U", "centromere", "no"), (7, "N", "short-arm", None)]
    agp = frame(spark, [("o", n, True, t, g, k, 1, 50, None, None) for n, t, g, k in rows], "objname string, partnum long, is_gap boolean, type string, gap_type string, linkage string, ostart long, oend long, ident string, orient string")
    none = frame(spark, [], "ident string, local_id string, contig string")
    got = {r.partnum: tuple(r)[3:] for r in I.agp_to_tpf(agp, none.select("ident", "local_id"), none.select("ident", "contig")).collect()}
    assert got == {
        1: ("TYPE-2", "50", "PAIRED ENDS"), 2: ("TYPE-3", "50", ""), 3: ("TYPE-2", "", ""), 4: ("TELOMERE", "50", "PAIRED ENDS"), 6: ("TYPE-3", "", ""), 7: ("SHORT-ARM", "50", "PAIRED ENDS"),
    }


def test_tiles_follow_the_tile_before(spark):
    """The third tile starts after the second one's end, though the first reaches further; a group ends with its last tile."""
    tiles = frame(spark, [("a", "c", 1, 100), ("b", "c", 10, 20), ("c", "c", 30, 40), ("d", "c", 35, 38), ("e", "d", 36, 60)], SPAN)
    for width in (100_000, 10):
        assert {tuple(r) for r in I.tiling_groups(tiles, width).collect()} == {("c", 1, 20, 2), ("c", 30, 38, 2), ("d", 36, 60, 1)}


def test_components_cut_by_several_regions(spark):
    line = "objname string, ostart long, oend long, is_gap boolean, type string, gap_type string, linkage string, ident string, cstart long, cend long, orient string"
    agp = frame(spark, [("o", 1, 100, False, "W", None, None, "x", 1, 100, "+"), ("o", 101, 110, True, "N", "clone", "no", None, None, None, None), ("o", 111, 160, False, "W", None, None, "y", 11, 60, "-")], line)
    regions = frame(spark, [("o", 40, 50), ("o", 10, 20), ("o", 48, 55), ("o", 150, 170)], "objname string, mstart long, mend long")
    gap = lambda s, e: ("o", s, e, True, "U", "fragment", "yes", None, None, None, None)
    part = lambda s, e, i, a, b, o: ("o", s, e, False, "W", None, None, i, a, b, o)
    want = {
        part(1, 9, "xa", 1, 9, "+"), gap(10, 20), part(21, 39, "xba", 1, 19, "+"), gap(40, 55), part(56, 100, "xbb", 1, 45, "+"),
        ("o", 101, 110, True, "N", "clone", "no", None, None, None, None), part(111, 149, "yb", 1, 39, "-"), gap(150, 160),
    }
    assert {tuple(r) for r in I.split_component(agp, regions, 30).collect()} == want
    turned = I.split_component(agp.where("ident = 'y'"), frame(spark, [("o", 121, 130)], "objname string, mstart long, mend long"))
    assert {tuple(r) for r in turned.collect()} == {part(111, 120, "yb", 1, 10, "-"), gap(121, 130), part(131, 160, "ya", 11, 40, "-")}


def test_coverage_identity(spark):
    """Region 1 to 60: the hit inside does not raise 90; the one that reaches further does (95). Region 70 to 80: 99. Mean 97."""
    rows = [("q", "s", 1, 50, 90.0), ("q", "s", 10, 20, 100.0), ("q", "s", 40, 60, 95.0), ("q", "s", 80, 70, 99.0)]
    hits = frame(spark, rows, "query_id string, subject_id string, q_start long, q_end long, pident double")
    (r,) = H.hit_coverage(hits, frame(spark, [("q", 80)], "query_id string, query_length long")).collect()
    assert (r.covered, r.regions, r.identity) == (71, 2, 97.0)


def test_gene_functions(spark):
    """Own function, then the table by id, name or synonym, else the note, then the hit; what says nothing is passed over."""
    genes = [
        ("g1", "a note", "kinase", "n1"), ("g2.1", "a note", "Unknown protein", None), ("g3", "a note", None, "n3"), ("g4", "a note", None, None), ("g5", "a note", None, None),
        ("g6", "hypothetical protein", None, None), ("g7", None, None, None), ("g8", "", "ORF1", None), ("g9", "a note", None, None),
    ]
    table = [("g2", "ligase"), ("n3", "by name"), ("s4", "by synonym"), ("g9", "unnamed thing")]
    hits = [(g, f"{g} hit", 50.0, 1e-9, i) for i, g in enumerate(["g1", "g6", "g9"])]
    got = H.gene_records(
        frame(spark, genes, "id string, note string, function string, name string"), frame(spark, table, "id string, function string"),
        frame(spark, hits, "query_id string, description string, score double, evalue double, line_no long").withColumn("subject_id", F.lit("s")),
        2, frame(spark, [("g4", "s4"), ("g3", "s4")], "id string, synonym string"),
    )
    assert {r.id: tuple(r)[1:] for r in got.collect()} == {
        "g1": ("kinase", "own"), "g2.1": ("ligase", "table"), "g3": ("by name", "table"), "g4": ("by synonym", "table"), "g5": ("a note", "note"),
        "g6": ("g6 hit", "hit"), "g7": ("ORF", "none"), "g8": ("ORF", "none"), "g9": ("g9 hit", "hit"),
    }


def test_contig_spans(spark):
    """Trimmed ends count for the span; the least start is 0 or below, greatest ends are 0 or above."""
    reads = frame(spark, [("c", "r2", 5, 100, 10, 3), ("c", "r1", 5, 90, 0, 40), ("d", "r3", 20, 10, 5, 0)], "contig_id string, read_id string, start long, span long, start_trim long, end_trim long")
    assert {r.contig_id: (r.reads, r.first, r.last, r.span, r.trimmed_end) for r in W.contig_summary(reads).collect()} == {"c": (2, -5, 135, 140, 105), "d": (1, 0, 30, 30, 30)}
    listed = W.contig_read_list(reads.withColumn("orient", F.lit("+")))
    assert [(r.place, r.read_id, r.end) for r in listed.where("contig_id = 'c'").orderBy("place").collect()] == [(1, "r1", 95), (2, "r2", 105)]


def test_partial_is_added(spark):
    rows = [("gene", {"ID": ["gene:S1.2"], "partial": ["x"]}), ("mRNA", {"ID": ["mRNA:S1.2"]}), ("exon", {"ID": ["S1.2"]})]
    features = frame(spark, rows, "type string, attrs map<string, array<string>>")
    ids = frame(spark, [("S1",)], "id string")
    assert {r.type: r.attrs.get("partial") for r in FT.mark_partial(features, ids, ids).collect()} == {"gene": ["x", "5'", "3'"], "mRNA": ["5'", "3'"], "exon": None}


def test_trimmed_models(spark):
    """A five-prime trim of 4 is rounded to 6; a piece that keeps one base goes."""
    rows = [("g", "gene", "+", 1, 30), ("g", "exon", "+", 1, 7), ("g", "exon", "+", 2, 8), ("g", "exon", "+", 20, 30)]
    features = frame(spark, rows, "gene string, type string, strand string, start long, end long")
    got = FT.trim_models(features, frame(spark, [("g", 4, 5)], "gene string, five long, three long"))
    assert {tuple(r)[1:] for r in got.collect()} == {("gene", "+", 7, 25), ("exon", "+", 7, 8), ("exon", "+", 20, 25)}


def test_terms_parted_by_commas(spark):
    go = "Biological Process: a, b process (GO:1), Molecular Function: binding (GO:2); Cellular Component: cell (GO:3)"
    rows = A.domains_to_go(frame(spark, [("p", go)], "id string, go string")).collect()
    assert {(r.ontology, r.go_id, r.term) for r in rows} == {("Biological Process", "GO:1", "a, b process"), ("Molecular Function", "GO:2", "binding"), ("Cellular Component", "GO:3", "cell")}
