"""Faults found in the fifth round: roles of ranges, genes without a trim, a row for each word."""

import random
from collections import Counter

import pandas as pd
import pytest

from sporeline.operators import features as FT
from sporeline.operators import hits as H
from sporeline.operators import words as W
from sporeline.plans import interval_queries as Q

SPAN = "id string, ref string, start long, end long"


def test_marks_are_the_first_of_two_ranges(spark, monkeypatch):
    """The tool tests a mark's ends against a feature's: a mark that shares an end is found in a longer feature, not around a shorter one."""
    features = [("same", 10, 20), ("longer", 10, 30), ("before", 5, 20), ("shorter", 10, 15), ("last", 15, 20), ("around", 5, 30), ("touch", 20, 30), ("within", 12, 18)]
    tables = {"features": [(i, "c", s, e) for i, s, e in features], "marks": [("m", "c", 10, 20)]}
    monkeypatch.setattr(Q, "view", lambda spark, _, name: spark.createDataFrame(tables[name], SPAN))
    assert {tuple(r) for r in Q.i1_overlap_join(spark, "").collect()} == {(i, "m") for i in ("longer", "before", "around", "within")}
    (total,) = Q.i2_overlap_summary(spark, "").collect()
    assert (total.features, total.features_hit) == (8, 4)


def test_genes_without_a_trim_stay_as_they_are(spark):
    """A piece of one base goes where its gene is trimmed only, be it by no more than one codon."""
    rows = [(g, kind, "+", s, e) for g in ("none", "zero", "cut") for kind, s, e in (("gene", 10, 30), ("exon", 20, 20), ("exon", 9, 12), ("exon", 14, 31))]
    trims = spark.createDataFrame([("zero", 0, 0), ("cut", 1, 0)], "gene string, five long, three long")
    got = FT.trim_models(spark.createDataFrame(rows, "gene string, type string, strand string, start long, end long"), trims)
    want = {r for r in rows if r[0] != "cut"} | {("cut", "gene", "+", 13, 30), ("cut", "exon", "+", 14, 30)}
    assert {tuple(r) for r in got.collect()} == want


def alike():
    """Sequences with common stems, repeats, letters of every plane, one shorter than a word."""
    rng = random.Random(7)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    stems = [dna(60) for _ in range(4)] + ["A" * 50, "née\U0001f331" * 9]
    seqs = [dna(rng.randrange(30)) + rng.choice(stems)[rng.randrange(9) :] + rng.choice(stems) * rng.randrange(3) + dna(rng.randrange(30)) for _ in range(90)] + ["AC"]
    return {f"s{i:02d}": s for i, s in enumerate(seqs)}


def pairs_by_hand(seqs, k):
    words = {i: {s[j : j + k] for j in range(len(s) - k + 1)} for i, s in seqs.items()}
    return {(a, b): n for a in seqs for b in seqs if a < b and (n := len(words[a] & words[b]))}


@pytest.mark.parametrize("k", [1, 5, 9, 24, 31])
@pytest.mark.parametrize(("letters", "side"), [(1 << 20, 1024), (300, 4), (40, 3)])
def test_pairs_from_runs_of_words(monkeypatch, k, letters, side):
    monkeypatch.setattr(W, "LETTERS", letters)
    monkeypatch.setattr(W, "SIDE", side)
    seqs = {i: s for i, s in alike().items() if len(s) >= k}
    owner, core, run = W.runs(list(seqs.values()), k)
    assert sum(len(r) - k + 1 for r in run) == sum(len(s) - k + 1 for s in seqs.values())
    of = {}
    for c, r in zip(core.tolist(), run, strict=True):
        assert all(of.setdefault(r[j : j + k], c) == c for j in range(len(r) - k + 1))
    rows = pd.DataFrame({"core": core, "id": [list(seqs)[i] for i in owner], "run": run}).sort_values("core", ignore_index=True)
    frames = list(W.whole_cores(rows[i : i + 7] for i in range(0, len(rows), 7)))
    assert sum(map(len, frames)) == len(rows) and sum(f["core"].nunique() for f in frames) == rows["core"].nunique()
    got = Counter()
    for f in frames:
        for _, a, b, n in W.pair_cells(f, k).itertuples(index=False):
            for i, x in enumerate(a):
                for y in a[i + 1 :] if b is None else b:
                    got[min(x, y), max(x, y)] += n
    assert got == pairs_by_hand(seqs, k)


def test_words_are_not_dealt_a_row_each(spark, monkeypatch):
    def call(*_):
        raise AssertionError("a row for each word")

    monkeypatch.setattr(H, "_words", call)
    seqs = alike()
    rows = [*seqs.items(), ("s99", seqs["s03"]), (None, seqs["s04"] + "A"), ("none", None)]
    got = H.kmer_candidates(spark.createDataFrame(rows, "id string, seq string"), 12, 48)
    assert {(r.a, r.b): r.score for r in got.collect()} == {p: 12 * n for p, n in pairs_by_hand(seqs, 12).items() if n >= 4}
    assert H.kmer_candidates(spark.createDataFrame([("a", "ACGT")], "id string, seq string"), 12, 48).count() == 0
    _, _, run = W.runs(list(seqs.values()), 24)
    assert len(run) * 5 < sum(max(0, len(s) - 23) for s in seqs.values())
