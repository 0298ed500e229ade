"""Bootstrap by site patterns against resampled strings."""

import random
import zlib

import numpy as np
import pytest

from sporeline.operators import families as P


def alignment(seed, members, columns):
    rng = random.Random(seed)
    base = [rng.choice("ACGT") for _ in range(columns)]
    rows = []
    for m in range(members):
        own = [c if rng.random() > 0.1 * (1 + m % 3) else rng.choice("ACGTacgtN-") for c in base]
        rows.append("".join(own))
    return rows


@pytest.mark.parametrize("model", ["uncorrected", "jukes-cantor", "kimura"])
def test_pattern_distances_equal_resampled_strings(model):
    rows = [*alignment(1, 6, 60), "-" * 60, "ACGT" * 15, "CATG" * 15]
    made, rng = P.SitePatterns(rows), np.random.default_rng(2)
    assert made.size <= 60
    for _ in range(20):
        pick = rng.integers(0, 60, 60)
        got = made.distances(np.bincount(made.of_site[pick], minlength=made.size)[None, :].astype(float), model)[0]
        drawn = ["".join(r[i] for i in pick) for r in rows]
        want = [P.distance_of(drawn[i], drawn[j], model) for i, j in zip(made.first, made.second, strict=True)]
        assert got.tolist() == pytest.approx([1.0 if w is None else w for w in want])


def test_thousand_replicates_equal_trees_of_resampled_strings(spark):
    families = {f: alignment(f, 5 + f, 40) for f in (1, 2)}
    rows = [(f, f"m{i}", s) for f, seqs in families.items() for i, s in enumerate(seqs)] + [(3, "a", "ACGT"), (3, "b", "ACGA"), (3, "c", "ACCA")]
    got = {(r.family, r.split): r.support for r in P.bootstrap_support(spark.createDataFrame(rows, "family long, member string, seq string"), 1000, 7).collect()}
    want = {}
    for f, seqs in families.items():
        names = [f"m{i}" for i in range(len(seqs))]
        for rep in range(1, 1001):
            pick = np.random.default_rng([7, rep, zlib.crc32(str(f).encode())]).integers(0, 40, 40)
            drawn = ["".join(s[i] for i in pick) for s in seqs]
            d = np.array([[0.0 if a == b else (lambda x: 1.0 if x is None else x)(P.distance_of(drawn[a], drawn[b], "uncorrected")) for b in range(len(names))] for a in range(len(names))])
            for split in P.splits(P.build_tree(names, d)):
                want[f, split] = want.get((f, split), 0) + 0.1
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.5 for k in want)
