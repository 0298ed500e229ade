"""Rules on components by rounds of joins, against plain Python and against the same rule in one task."""

import random

import pytest

from sporeline.operators import forests as W
from sporeline.operators import graph as G

EDGES = "src string, dst string, weight double, line_no long"


def shapes():
    """Random graphs with ties and repeats, a path, a hub, a ring, a ladder of rings, a tree."""
    rng = random.Random(3)
    out = []
    for n, m in ((12, 14), (40, 45), (40, 90)):
        out += [(f"r{n}{m}_{rng.randrange(n):02d}", f"r{n}{m}_{rng.randrange(n):02d}", float(rng.randint(1, 4))) for _ in range(m)]
    out += [(f"path{i:03d}", f"path{i + 1:03d}", float(i % 7)) for i in range(70)]
    out += [("hub", f"leaf{i:02d}", 1.0) for i in range(50)] + [("leaf03", "leaf04", 9.0)]
    out += [(f"ring{i}", f"ring{(i + 1) % 9}", float(i)) for i in range(9)]
    for k in range(6):
        out += [(f"lad{k}a", f"lad{k}b", 1.0), (f"lad{k}b", f"lad{k + 1}a", 2.0), (f"lad{k}a", f"lad{k + 1}a", 2.0)]
    out += [(f"tree{i:02d}", f"tree{(i - 1) // 3:02d}", float((i * 37) % 11)) for i in range(1, 60)]
    rng.shuffle(out)
    return [(a, b, w, i) for i, (a, b, w) in enumerate(out)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(shapes(), EDGES)


def same(by_rounds, in_one_task):
    a, b = ({tuple(r) for r in x.collect()} for x in (by_rounds, in_one_task))
    assert a == b and a


def parts(rows):
    near, of = {}, {}
    for a, b, *_ in rows:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in sorted(near):
        todo = [start] if start not in of else []
        while todo:
            n = todo.pop()
            if n not in of:
                of[n] = start
                todo += near[n]
    return near, of


def test_articulation_points(table):
    near, of = parts(shapes())
    want = set()
    for n in near:
        kin = {k for k in near if of[k] == of[n] and k != n}
        seen, todo = set(), [min(kin)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x] - {n}
        if seen != kin:
            want.add((of[n], n))
    assert {tuple(r) for r in G.articulation_points(table, limit=0).collect()} == want
    assert {tuple(r) for r in G.articulation_points(table).collect()} == want


def test_assembly_order(table):
    best = {}
    for a, b, w, _ in shapes():
        if a != b:
            key = min(a, b), max(a, b)
            best[key] = max(w, best.get(key, w))
    _, of = parts(shapes())
    want = set()
    for root in set(of.values()):
        mine = sorted((-w, a, b) for (a, b), w in best.items() if of[a] == root)
        seen, place = {mine[0][1]}, 0
        want.add((root, mine[0][1], None, None, 0))
        while fringe := [x for x in mine if (x[1] in seen) != (x[2] in seen)]:
            w, a, b = fringe[0]
            place += 1
            want.add((root, b, a, -w, place) if a in seen else (root, a, b, -w, place))
            seen |= {a, b}
    assert {tuple(r) for r in G.assembly_order(table, limit=0).collect()} == want
    assert {tuple(r) for r in G.assembly_order(table).collect()} == want


def hits(table):
    return table.selectExpr("src AS query_id", "dst AS subject_id", "line_no")


@pytest.mark.parametrize("limit", [0, 12])
def test_star_clusters(table, limit):
    same(G.star_clusters(hits(table), limit=limit), G.star_clusters(hits(table)))


@pytest.mark.parametrize(("most", "limit"), [(None, 0), (3, 0), (3, 12), (1, 0)])
def test_greedy_clusters(table, most, limit):
    same(G.greedy_clusters(hits(table), most, limit=limit), G.greedy_clusters(hits(table), most))


def test_rules_by_hand(spark):
    """Lines in order: a takes b and c, which are no seeds then; d takes e alone, for c is taken; f is a seed though its subject is."""
    rows = [("a", "b"), ("a", "c"), ("b", "x"), ("d", "c"), ("d", "e"), ("f", "a")]
    df = spark.createDataFrame([(q, s, i) for i, (q, s) in enumerate(rows)], "query_id string, subject_id string, line_no long")
    want = {("cluster_a", "a"), ("cluster_a", "b"), ("cluster_a", "c"), ("cluster_d", "d"), ("cluster_d", "e"), ("singlet_f", "f")}
    for limit in (0, 10**6):
        assert {tuple(r) for r in G.star_clusters(df, limit=limit).collect()} == want
        # with two members at most: a+b; c alone, for a is full; x opens its own (b's cluster is full); d+e; f, and a is taken
        got = {}
        for r in G.greedy_clusters(df, 2, limit=limit).collect():
            got.setdefault(r.cluster, set()).add(r.member)
        assert sorted(map(sorted, got.values())) == [["a", "b"], ["c"], ["d", "e"], ["f"], ["x"]]


def test_rooted_walk(spark):
    tree = spark.createDataFrame([(1, 2, 5), (1, 3, 4), (3, 4, 9), (3, 5, 8), (10, 11, 0)], "u long, v long, k long")
    roots = spark.createDataFrame([(1,), (10,)], "root long")
    got = {r.node: (r.parent, r.root, r.place, r.size) for r in W.rooted(tree, roots, order="k").collect()}
    assert got == {1: (None, 1, 0, 5), 3: (1, 1, 1, 3), 5: (3, 1, 2, 1), 4: (3, 1, 3, 1), 2: (1, 1, 4, 1), 10: (None, 10, 0, 2), 11: (10, 10, 1, 1)}
    free = {r.node: (r.parent, r.size) for r in W.rooted(tree, roots).collect()}
    assert free == {n: (p, s) for n, (p, _, _, s) in got.items()}
