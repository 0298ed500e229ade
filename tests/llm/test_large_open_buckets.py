"""op10: a large group of texts that share bands and are mostly under the threshold."""

import random

import numpy as np
import pytest

from sporeline.llm import near_dedup, similar
from tests.llm.test_operators import jp, table, words


def group(seed, n=200, length=170):
    """Texts of one base with one to eight words changed each, some of them repeated inside."""
    rng = random.Random(seed)
    base = words(rng, length)
    texts = []
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(length), 1 + k * 8 // n):
            own[at] = words(rng, 1)[0]
        texts.append(" ".join(own + own[: rng.choice((0, 0, 30))]))
    return texts


def classes_by_all_pairs(texts):
    """Components of all links between texts that share a band."""
    bands = [set(b.tolist()) for b in near_dedup.signer(0)(texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if bands[i] & bands[j]]
    for (i, j), linked in zip(pairs, near_dedup.similar_texts([texts[i] for i, _ in pairs], [texts[j] for _, j in pairs]), strict=True):
        if linked:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))], len(pairs)


@pytest.mark.parametrize("cell", [512, 24])
def test_no_link_is_lost_and_few_pairs_are_made(spark, monkeypatch, cell):
    monkeypatch.setattr(similar, "CELL", cell)
    texts = group(3)
    made, exact = spark.sparkContext.accumulator(0), near_dedup.similar_texts

    def counting(a, b):
        made.add(len(a))
        return exact(a, b)

    monkeypatch.setattr(near_dedup, "similar_texts", counting)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    n_made = made.value
    expected, candidates = classes_by_all_pairs(texts)
    assert [got[i] for i in range(len(texts))] == expected
    assert len(set(expected)) > 20 and candidates > 5000
    assert n_made < candidates / 4


def test_the_bound_is_never_under_the_similarity():
    rng = random.Random(4)
    texts = group(5, 40) + [" ".join(words(rng, 900)), "a b c", "", "one two one two " * 50]
    texts += [texts[0] + " " + " ".join(words(rng, k)) for k in (20, 35, 200)] + [texts[40] + " x"]
    bits, weight = zip(*near_dedup.sketches(texts), strict=True)
    assert len({len(b) for b in bits}) > 2
    weight, nothing = np.array(weight), np.zeros(len(texts), dtype=int)
    a, b = similar._block(list(bits), weight, np.arange(len(texts)), nothing, near_dedup.could_be_similar)
    passed = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    every = [(i, j) for j in range(len(texts)) for i in range(j)]
    assert len(passed) == len(a) < 0.6 * len(every)
    assert all((i, j) in passed for i, j in every if texts[i] and texts[j] and jp(texts[i], texts[j]) >= 0.8)
