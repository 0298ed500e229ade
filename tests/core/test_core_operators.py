"""Operators without a SQL form, and properties, on small literal frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sporeline.operators import families as P
from sporeline.operators import graph as G
from sporeline.operators import hits as H
from sporeline.operators import intervals as I
from sporeline.operators import sequences as Q


def hits(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "query_id string, subject_id string, line_no long")


def test_star_clusters_take_subjects_in_line_order(spark):
    got = G.star_clusters(hits(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("e", "e"), ("a", "c")]))
    assert sorted(map(tuple, got.collect())) == [("cluster_a", "a"), ("cluster_a", "b"), ("cluster_a", "c"), ("singlet_e", "e")]


def test_greedy_clusters_open_their_own_when_full(spark):
    got = G.greedy_clusters(hits(spark, [("a", "b"), ("a", "c"), ("a", "d"), ("d", "e")]), max_members=3)
    assert sorted(map(tuple, got.collect())) == [("cluster_1", "a", 3), ("cluster_1", "b", 3), ("cluster_1", "c", 3), ("cluster_2", "d", 2), ("cluster_2", "e", 2)]


def test_components_do_not_depend_on_edge_order(spark):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z")]
    one = spark.createDataFrame(pairs, "src string, dst string")
    two = spark.createDataFrame([(b, a) for a, b in reversed(pairs)], "src string, dst string")
    found = [sorted(map(tuple, G.connected_components(e).collect())) for e in (one, two)]
    assert found[0] == found[1] and len(found[0]) == 43 and {c for _, c in found[0]} == {"n0", "x"}


def test_articulation_points_and_spanning_tree(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 5.0), ("c", "a", 2.0), ("c", "d", 3.0), ("d", "e", 4.0)], "src string, dst string, weight double")
    assert sorted(r.node for r in G.articulation_points(e).collect()) == ["c", "d"]
    tree = sorted(G.assembly_order(e).collect(), key=lambda r: r.place)
    assert [(r.node, r.joined_to, r.weight) for r in tree] == [("b", None, None), ("c", "b", 5.0), ("d", "c", 3.0), ("e", "d", 4.0), ("a", "c", 2.0)]


def test_larger_components_go_by_rounds_and_are_not_cut(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert [tuple(r) for r in G.articulation_points(e, limit=1).collect()] == [tuple(r) for r in G.articulation_points(e).collect()] == [("a", "b")]


def test_overlap_join_of_long_ranges_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    make = lambda n: [(f"r{rng.integers(2)}", i, int(s), int(s + rng.choice([0, 5, 900, 90000]))) for i, s in enumerate(rng.integers(1, 100000, n))]
    a, b = make(60), make(60)
    schema = "ref string, id int, start long, end long"
    for mode in ("strict", "closed"):
        got = I.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), mode).select("id_a", "id_b").collect()
        inner = lambda p, y: y[2] < p < y[3]
        test = (lambda x, y: inner(x[2], y) or inner(x[3], y) or (x[2] < y[2] and x[3] > y[3])) if mode == "strict" else (lambda x, y: x[2] <= y[3] and y[2] <= x[3])
        assert sorted(map(tuple, got)) == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and test(x, y))


def test_coordinates_round_trip(spark):
    df = spark.createDataFrame([(5, 9), (1, 1)], "first long, second long")
    for kind in ("0/L", "1/L", "0/E", "1/E"):
        back = I.convert_coords(I.convert_coords(df, "1/E", kind), kind, "1/E")
        assert sorted(map(tuple, back.collect())) == [(1, 1), (5, 9)]


def test_tpf_splice_renumbers(spark):
    tpf = spark.createDataFrame([(i, f"A{i}") for i in range(1, 6)], "ord long, accession string")
    new = spark.createDataFrame([(1, "N1"), (2, "N2"), (3, "N3")], "ord long, accession string")
    splice = lambda a, b: [(r.ord, r.accession) for r in I.tpf_splice(tpf, a, b, new).orderBy("ord").collect()]
    # the named lines stay, those between them go
    assert splice("A2", "A4") == list(enumerate(["A1", "A2", "N1", "N2", "N3", "A4", "A5"], 1))
    assert splice("A2", "A3") == list(enumerate(["A1", "A2", "N1", "N2", "N3", "A3", "A4", "A5"], 1))
    assert splice("A4", "A2") == splice("A2", "B") == list(enumerate(["A1", "A2", "A3", "A4", "A5"], 1))
    assert [r.accession for r in I.tpf_interval(tpf, "A2", "A4").orderBy("ord").collect()] == ["A2", "A3", "A4"]


def test_reverse_complement_twice_is_identity(spark):
    s = spark.createDataFrame([("a", "", "ACGTNacgtn", 0)], "id string, descr string, seq string, line_no long")
    assert Q.edit_records(Q.edit_records(s, revcom=True), revcom=True).first().seq == "ACGTNacgtn"


def test_orf_and_walk(spark):
    s = spark.createDataFrame([("a", "CCATGAAATTTTAGCC"), ("b", ""), ("c", None)], "id string, seq string")
    best = Q.longest_orf(s.where("seq IS NOT NULL")).collect()
    assert {r.id for r in best} == {"a"} and len({len(r.protein) for r in best}) == 1
    hit = spark.createDataFrame([("a", 6, 11)], "query_id string, q_start int, q_end int")
    assert tuple(Q.walk_start_stop(s.where("id = 'a'"), hit).first()) == ("a", 3, 14, True)


def test_reciprocal_best_hits_are_symmetric(spark):
    rows = [("a", "b", 0.1), ("b", "a", 0.1), ("a", "c", 0.2), ("c", "a", 0.3)]
    h = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "query_id string, subject_id string, evalue double, line_no long")
    got = {(r.query_id, r.subject_id) for r in H.reciprocal_best_hits(h).collect()}
    assert got == {("a", "b"), ("b", "a")}


def test_neighbour_joining_recovers_an_additive_tree():
    names = ["a", "b", "c", "d"]
    d = np.array([[0, 3, 7, 8], [3, 0, 8, 9], [7, 8, 0, 5], [8, 9, 5, 0]], float)
    assert P.splits(P.build_tree(names, d)) == ["c,d"]
    assert P.splits("((a:1,b:1):1,(c:1,d:1):1);") == ["c,d"]
    assert P.canonical("((b:1,a:1):1,c:1);", {}, ()) == P.canonical("(c:1,(a:1,b:1):1);", {}, ())


def test_distances():
    assert P.distance_of("ACGT", "ACGA", "uncorrected") == 0.25
    assert P.distance_of("ACGT", "ACGA", "jukes-cantor") == pytest.approx(-0.75 * np.log(1 - 1 / 3))
    assert P.distance_of("AAAA", "GGGG", "kimura") is None and P.distance_of("--", "AC", "uncorrected") is None


def test_bootstrap_repeats(spark):
    a = spark.createDataFrame([("f", m, s) for m, s in (("a", "AACCGGTT"), ("b", "AACCGGTA"), ("c", "TTGGCCAA"), ("d", "TTGGCCAT"))], "family string, member string, seq string")
    one, two = (sorted(map(tuple, P.bootstrap_support(a, 20, 7).collect())) for _ in range(2))
    assert one == two and one[0][1] == "c,d" and one[0][2] > 80


def test_relabel_fails_on_a_missing_name(spark):
    c = spark.createDataFrame([(1, "a")], "cluster_id long, member_id string")
    with pytest.raises(Exception, match="no new name"):
        G.relabel_clusters(c, c.select(F.col("cluster_id").alias("old"), F.lit("x").alias("new")).limit(0)).collect()
