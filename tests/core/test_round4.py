"""Faults of queries on larger tables: trees a call each, pairs or rows that one task holds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from sporeline.operators import families as P
from sporeline.operators import features as FT
from sporeline.operators import warehouse as W


def matrices(n, seed):
    rng, out = np.random.default_rng(seed), []
    for t in range(40):
        x = np.triu(rng.integers(0, 6 if t % 2 else 1000, (n, n)) / 7, 1)  # every second has many ties
        out.append(x + x.T)
    return out


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 17, 40])
def test_trees_of_many_matrices_equal_trees_one_by_one(n):
    ds, names = matrices(n, n), [f"m{k:02}" for k in range(n)]
    for method in ("nj", "upgma"):
        assert P.newicks([names] * len(ds), np.stack(ds), method) == [P.build_tree(names, d, method) for d in ds]
    if n > 3:
        got = [sorted(",".join(m for k, m in enumerate(names) if s >> k & 1) for s in row if s) for row in P.tree_sides(np.stack(ds)).tolist()]
        assert got == [P.splits(P.build_tree(names, d)) for d in ds]


@pytest.mark.parametrize("n", [1, 2, 3, 28, 29, 1000])
def test_draws_are_those_of_a_generator_each(n):
    want = [np.random.default_rng([7, r, 3735928559]).integers(0, n, n).tolist() for r in range(1, 40)]
    assert P.draws(7, np.arange(1, 40), 3735928559, n).tolist() == want


@pytest.mark.parametrize("model", ["uncorrected", "jukes-cantor", "kimura"])
def test_distances_of_many_pairs_equal_those_of_one(model):
    rng = random.Random(1)
    a, b = (["".join(rng.choice("ACGTacgtN-") for _ in range(rng.randrange(30))) for _ in range(300)] for _ in range(2))
    got = [None if np.isnan(x) else x for x in P.distances_of(a, b, model)]
    assert got == [P.distance_of(x, y, model) for x, y in zip(a, b, strict=True)]


def test_families_need_no_call_each(spark, monkeypatch):
    def call(*_):
        raise AssertionError("a call a family")

    monkeypatch.setattr(GroupedData, "applyInPandas", call)
    rng = random.Random(5)
    rows = []
    for f in range(30):
        base = [rng.choice("ACGT") for _ in range(25)]
        rows += [(f, f"m{k:02}", "".join(c if rng.random() < 0.8 else rng.choice("ACGT-") for c in base)) for k in range(2 + f % 7)]
    rows += [(40, "a", "ACGTAC"), (40, "a", "ACGTAA"), (40, "b", "CCGTAA"), (40, "c", "CCGTAC"), (41, "x", "ACGT"), (None, "y", "ACGT")]
    df = spark.createDataFrame(rows, "family long, member string, seq string")
    support = {(r.family, r.split) for r in P.bootstrap_support(df, 10).collect()}
    assert {f for f, _ in support} == {*(f for f in range(30) if 2 + f % 7 > 3)}  # two rows of one name are one leaf of three
    dist = P.pair_distances(df)
    got = {(r.family, r.method): r.newick for r in P.trees_by(dist.where("family < 40"), ["nj", "upgma"]).collect()}
    for f in range(30):
        pairs = dist.where(f"family = {f}").toPandas() if f in (0, 5, 12) else None
        if pairs is not None:
            assert [got[f, m] for m in ("nj", "upgma")] == [P.build_tree(*P._matrix(pairs), m) for m in ("nj", "upgma")]
    assert len(got) == 60


def test_pairs_of_clusters_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(W, "PAIRS", 50)
    rng = random.Random(6)
    old, new = ({(rng.randrange(12), rng.randrange(90)) for _ in range(400)} for _ in range(2))
    frames = [spark.createDataFrame(sorted(x), "cluster_id long, member_id long") for x in (old, new)]
    want = {}
    for a, m in old:
        for b, k in new:
            if m == k:
                want[a, b] = want.get((a, b), 0) + 1
    size = lambda rows, c: sum(x == c for x, _ in rows)
    got = W.build_overlap(*frames)
    assert {tuple(r) for r in got.collect()} == {(a, b, n, size(old, a), size(new, b)) for (a, b), n in want.items()}
    assert W._shared_members(*frames, "old_cluster", "new_cluster").rdd.getNumPartitions() == sum(want.values()) // 50 + 1
    assert {tuple(r) for r in W.split_clusters(got).collect()} == {(a, n) for a in range(12) if (n := sum(x == a for x, _ in want)) > 1}
    assert W.build_overlap(frames[0].limit(0), frames[1]).count() == 0


def most_rows_of_a_task(df):
    return max(df.groupBy(F.spark_partition_id()).count().collect(), key=lambda r: r["count"])["count"]


def test_models_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(FT, "ROWS", 60)
    rng = random.Random(8)
    pieces = [(f"g{k}.1", "+-"[k % 2], t, x, x + 40) for k in range(100) for t, x in [("exon", 1), ("exon", 90), ("exon", 300), ("CDS", rng.choice([1, 60])), ("intron", 42)]]
    rows = spark.createDataFrame(pieces, "parent string, strand string, type string, start long, end long")
    fused = FT.rebuild_models(rows)
    assert fused.where("type = 'exon'").count() == 300 - sum(1 for *_, t, x, _ in pieces if t == "CDS" and x == 60)
    # 500 rows over 60 a task: nine partitions, and no exchange after the rows are dealt
    plan = fused._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(parent" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert fused.rdd.getNumPartitions() % 9 == 0
    genes = spark.createDataFrame([(f"g{k}", "s", "+", 1, 400) for k in range(100)], "gene string, seqid string, strand string, start long, end long")
    mrnas = genes.select("gene", F.concat("gene", F.lit(".1")).alias("mrna"), F.concat("gene", F.lit(".1.1")).alias("name"), "strand", F.lit("n").alias("note"), F.array(F.lit("5'")).alias("partial"), F.array(F.lit("GO:1")).alias("terms"))
    go = spark.createDataFrame([("GO:1", "growth", "biological_process")], "go_id string, name string, namespace string")
    table = FT.feature_table(genes, mrnas, rows.where("type <> 'intron'").select(F.col("parent").alias("mrna"), "type", "start", "end"), go).cache()
    assert table.where("ord.k IN (1, 3)").count() == 400
    assert most_rows_of_a_task(table.where("ord.k IN (1, 3)")) < 200
    table.unpersist()
