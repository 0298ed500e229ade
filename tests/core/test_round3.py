"""Faults found on larger tables: what grows in memory or rounds, and the same results on odd shapes."""

import contextlib
import io
import random

from sporeline.operators import graph as G
from sporeline.operators import warehouse as W
from sporeline.plans import registry, source_queries


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_partial_accessions_with_repeated_names(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abA-1") for _ in range(rng.randrange(2, 9))) for _ in range(60)] * 2 + [None]
    clones = spark.createDataFrame(list(enumerate(names)), "clone_id long, name string")
    books = [(f"AC{i:03}", "".join(rng.choice("abA-1") for _ in range(rng.randrange(2, 9)))) for i in range(80)]
    clean = lambda t: "".join(c for c in t if c.isalnum()).lower()
    want = {}
    for i, n in enumerate(names):
        for accession, other in books:
            a, b = sorted((clean(n or ""), clean(other)), key=len)
            if len(a) >= 3 and (b.startswith(a) or b.endswith(a)):
                want[i] = min(want.get(i, accession), accession)
    found = W.map_accessions_partial(clones, spark.createDataFrame(books, "accession string, clone string"), 3)
    assert dict(map(tuple, found.collect())) == want
    # ends are far more bytes than the table that they come from: only the row of lengths may be broadcast
    joins = [line for line in plan(found).splitlines() if "BroadcastHashJoin" in line]
    assert not joins


def test_components_of_sorted_chains_and_hubs_settle_in_few_rounds(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(200)]
    saw = [(f"s{i + j:03}", f"s{900 - i:03}") for i in range(60) for j in (0, 1)]
    hub = [(f"h{i:03}", "h999") for i in range(80)] + [("x", "x")]
    found = G.connected_components(spark.createDataFrame(chain + saw + hub, "src string, dst string"), max_rounds=5)
    want = {n: n[0] + "000" for pair in chain + saw + hub for n in pair if n != "x"}
    assert found.count() == len(want) and {r.node: r.component for r in found.collect()} == want


def test_many_small_components_are_walked_not_called(spark):
    rows = [(f"q{i}", f"s{i}_{j}", 10 * i + j) for i in range(50) for j in range(3)]
    found = G.star_clusters(spark.createDataFrame(rows, "query_id string, subject_id string, line_no long"))
    assert "FlatMapGroupsInPandas" not in plan(found)
    assert {tuple(r) for r in found.collect()} == {(f"cluster_q{i}", m) for i in range(50) for m in (f"q{i}", *(f"s{i}_{j}" for j in range(3)))}


def test_bacs_are_placed_without_pairs_or_open_frames(spark):
    registry_plan = plan(registry.QUERIES["i9_place_bacs"](spark, "/root/testdata/sf0.001"))
    assert "LeftAnti" not in registry_plan and "unboundedfollowing" not in registry_plan.lower()


def test_hit_files_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(source_queries, "HIT_FILE", 100)
    assert [source_queries._hit_files(spark.range(n), 4) for n in (0, 1, 400, 401, 4000)] == [4, 4, 4, 8, 40]
