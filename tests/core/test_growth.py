"""Lists of hubs, closures of any depth, clusters on a stream."""

import random

import pytest
from pyspark.sql import functions as F

from sporeline.operators import features as FT
from sporeline.operators import graph as G
from sporeline.streaming.clusters import ClusterLog, stream_clusters


def test_neighbours_of_a_hub_come_in_parts(spark):
    rows = [("hub", f"n{i:03d}", float(i), i) for i in range(250)] + [("n001", "hub", 7.0, 999), ("hub", "hub", 1.0, 1000)]
    got = G.adjacency(spark.createDataFrame(rows, "src string, dst string, weight double, line_no long"), size=100).where("node = 'hub'").orderBy("part").collect()
    assert [(r.part, r.degree, len(r.neighbours)) for r in got] == [(0, 250, 100), (1, 250, 100), (2, 250, 50)]
    assert [(x.other, x.weight) for r in got for x in r.neighbours] == [(f"n{i:03d}", 7.0 if i == 1 else float(i)) for i in range(250)]


def test_invalid_families_of_ten_levels(spark):
    """A cut in the seventh of ten levels takes the whole chain; one of two parents takes its own line, not the other's ancestors' other children."""
    rows = [(f"c{k}", f"c{k - 1}" if k else None, k != 7) for k in range(10)]
    rows += [("p", None, True), ("q", None, True), ("both", "p", False), ("both", "q", False), ("under", "both", True), ("side", "q", True), ("free", None, True), ("kid", "free", True)]
    got = FT.invalid_families(spark.createDataFrame(rows, "id string, parent string, valid boolean"))
    assert sorted(r.id for r in got.collect()) == sorted([f"c{k}" for k in range(10)] + ["p", "q", "both", "under", "side"])


def plain(edges):
    of = {}

    def top(n):
        while of.setdefault(n, n) != n:
            n = of[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        of[max(a, b)] = min(a, b)
    return {n: top(n) for n in list(of)}


def test_clusters_after_each_batch(spark, tmp_path):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)]
    batches = [edges[i : i + 15] for i in range(0, 45, 15)]
    log = ClusterLog(spark, f"file://{tmp_path}/log")
    assert log.members().count() == 0
    for k, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "src string, dst string")
        assert log.add(df, k) and not log.add(df, k)
        assert {r.node: r.component for r in log.members().collect()} == plain(edges[: 15 * (k + 1)])
        assert log.members().count() == len(plain(edges[: 15 * (k + 1)]))


def test_a_lost_batch_is_written_anew(spark, tmp_path, monkeypatch):
    log = ClusterLog(spark, f"file://{tmp_path}/log")
    df = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    log.add(df([("a", "b"), ("d", "e")]), 0)

    class Lost(Exception):
        pass

    with monkeypatch.context() as m:
        m.setattr(ClusterLog, "_fs", lambda self: (_ for _ in ()).throw(Lost) if (tmp_path / "log/joined/1").exists() else self._path().getFileSystem(spark._jsc.hadoopConfiguration()))
        with pytest.raises(Lost):
            log.add(df([("b", "d"), ("x", "e")]), 1)
    want = {"a": "a", "b": "a", "d": "d", "e": "d"}
    assert {r.node: r.component for r in log.members().collect()} == want
    assert log.add(df([("b", "d"), ("x", "e")]), 1)
    assert {r.node: r.component for r in log.members().collect()} == dict.fromkeys("abdex", "a")


def test_stream_fills_the_log(spark, tmp_path):
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
    spark.createDataFrame(edges, "src long, dst long").repartition(3, F.col("src")).write.parquet(str(tmp_path / "in"))
    log = ClusterLog(spark, f"file://{tmp_path}/log", "long")
    stream = lambda: spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_clusters(stream(), log, str(tmp_path / "state")).awaitTermination()
    assert {r.node: r.component for r in log.members().collect()} == plain(edges)
    # a stream that begins again delivers the same batches under the same numbers
    stream_clusters(stream(), log, str(tmp_path / "other")).awaitTermination()
    assert {r.node: r.component for r in log.members().collect()} == plain(edges)


def test_word_classes_equal_components_of_pairs(spark, monkeypatch):
    """Chains of overlapping sequences, a group that shares one passage, copies, and sequences alike in too few words."""
    from sporeline.operators import hits as H

    rng = random.Random(9)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    chain, stem = dna(400), dna(30)
    seqs = [chain[i : i + 60] for i in range(0, 340, 25)] + [stem + dna(40) for _ in range(40)] + [stem[:14] + dna(40) for _ in range(10)] + [dna(50) for _ in range(10)] + ["", "ACGT", None]
    seqs += seqs[:3] + [seqs[20]]
    rng.shuffle(seqs)
    rows = [(f"s{i:03d}", s) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "id string, seq string")
    least = {}
    for i, s in rows:
        least.setdefault(s, i)
    names = {i: s for s, i in least.items() if s}
    words = {i: {s[j : j + 9] for j in range(len(s) - 8)} for i, s in names.items()}
    links = [(a, b) for a in words for b in words if a < b and 9 * len(words[a] & words[b]) >= 75]
    of = plain(links)
    for hubs in (8, 1000):
        monkeypatch.setattr(H, "HUBS", hubs)
        got = {r.id: r["class"] for r in H.kmer_classes(df.where("seq IS NOT NULL")).collect()}
        assert got == {i: of.get(least[s], least[s]) for i, s in rows if s is not None}
    assert len(set(of.values())) >= 2 and len(links) > 700
