"""Faults of queries on larger tables: a call a group, pairs of whole lists, arrays of a whole group."""

import random
import time

from pyspark.sql.group import GroupedData

from sporeline.operators import chunks as C
from sporeline.operators import features as FT
from sporeline.operators import hits as H
from sporeline.operators import intervals as I


def test_moves_of_many_sequences_need_no_call_each(spark, monkeypatch):
    def call(*_):
        raise AssertionError("a call a sequence")

    monkeypatch.setattr(GroupedData, "applyInPandas", call)
    rng = random.Random(3)
    seqs = {f"s{i}": "".join(rng.choice("ACGT") for _ in range(rng.randrange(20, 60))) for i in range(300)}
    edits = [(i, *e) for i in seqs for e in ((2, 20, -7), (1, 10, 5))]
    got = C.apply_moves(C.chunked(spark.createDataFrame(list(seqs.items()), "id string, seq string"), 16), spark.createDataFrame(edits, "id string, ord int, loc int, shift int"), size=16)
    want = {i: (s[:9] + "NNNNN" + s[9:]) for i, s in seqs.items()}
    assert {r.id: r.seq for r in C.whole(got, ["id"]).collect()} == {i: s[:12] + s[19:] for i, s in want.items()}


def test_pairs_by_words_of_long_sequences(spark):
    """A sequence of 400,000 bases and pieces of it around the borders of its parts; a walk to each place from the first would take minutes."""
    rng = random.Random(4)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    long = dna(400_000)
    seqs = [long] + [long[i : i + 60] + dna(20) for i in (0, 226, 256, 16_340, 16_384, 163_810, 399_940)] + [dna(80), long[5:16], "ACGT" * 30, "TACG" * 9, "", "ACG"]
    seqs += seqs[2:4]
    rows = [(f"s{i:02}", s) for i, s in enumerate(seqs)]
    least = {}
    for i, s in rows:
        least.setdefault(s, i)
    words = {i: {s[j : j + 12] for j in range(len(s) - 11)} for s, i in least.items()}
    want = {(a, b, 12 * len(words[a] & words[b])) for a in words for b in words if a < b and 12 * len(words[a] & words[b]) >= 48}
    begun = time.monotonic()
    got = {tuple(r) for r in H.kmer_candidates(spark.createDataFrame(rows, "id string, seq string"), 12, 48).collect()}
    assert got == want and len(want) >= 9
    assert time.monotonic() - begun < 60


def test_overlaps_counted_as_pairs_are(spark):
    """Points, shared starts and ends, equal ranges, copies, nulls; no pairs are made."""
    rng = random.Random(8)
    spans = lambda n, name: [(rng.choice(["a", "b"]), s, s + rng.choice([0, 0, 1, 2, 5, 40]), f"{name}{i}") for i in range(n) for s in [rng.randrange(1, 60)]]
    kind = "ref string, start long, end long, id string"
    features = spans(250, "f") + [("c", 1, 5, "f"), (None, 1, 9, "g"), ("a", None, 9, "h")]
    marks = spans(250, "m") + [(None, 1, 9, "n"), ("a", 2, None, "o"), ("d", 1, 4, "p")]
    f, m = spark.createDataFrame(features, kind), spark.createDataFrame(marks, kind)
    tests = {
        "strict": lambda sa, ea, sb, eb: sb < sa < eb or sb < ea < eb or (sa < sb and ea > eb),
        "closed": lambda sa, ea, sb, eb: sa <= eb and sb <= ea,
    }
    for mode, test in tests.items():
        for width in (7, 1000):
            got = {r.id: r.marked for r in I.overlap_counts(f, m, mode, width).collect()}
            assert got == {i: sum(r is not None and r == q and None not in (s, e, x, y) and test(x, y, s, e) for q, x, y, _ in marks) for r, s, e, i in features}
        total = {r.ref: (r.features, r.features_hit) for r in I.overlap_summary(f, m, mode).collect()}
        assert total == {k: (sum(r == k for r, *_ in features), sum(r == k and got[i] > 0 for r, _, _, i in features)) for k in ("a", "b", "c", None)}
    summary = I.overlap_summary(f, m)
    assert "id_a" not in summary._jdf.queryExecution().optimizedPlan().toString()


def test_ids_are_numbered_without_one_task_a_type(spark):
    rng = random.Random(6)
    lines = list(range(1, 121))
    rng.shuffle(lines)
    rows = [(f"c{n % 3}", "src", rng.choice(["gene", "mRNA", None]), n, {} if n % 4 == 0 else {"ID": [f"x{n % 30}"]}, n) for n in lines]
    found = FT.unique_ids(spark.createDataFrame(rows, "seqid string, source string, type string, start long, attrs map<string, array<string>>, line_no long"))
    seen, want = {}, {}
    lone = {}
    for seqid, _, kind, _, attrs, n in sorted(rows, key=lambda r: r[-1]):
        if attrs:
            root = attrs["ID"][0]
        else:
            lone[kind] = lone.get(kind, 0) + 1
            root = "_".join(x for x in (seqid, kind, str(lone[kind])) if x is not None)
        seen[root] = seen.get(root, 0) + 1
        want[n] = root if seen[root] == 1 else f"{root}_{seen[root]}"
    assert {r.line_no: r.attrs["ID"][0] for r in found.collect()} == want
    windows = [w for w in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [row_number" in w]
    assert windows and not any("[type" in w.split("windowspec")[1] for w in windows)
