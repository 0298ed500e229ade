"""What large buckets, repeated words, repeated or missing ids and lost writers must not lose."""

import random

import pytest

from sporeline.llm import near_dedup, secrets, substring_dedup
from tests.llm.test_operators import jp, table, words


def test_links_in_large_buckets(spark):
    """40 texts that share more than half their shingles, and a near copy of each at 0.80 to 0.85."""
    rng = random.Random(21)
    base = words(rng, 300)
    texts, pairs = [], []
    for _ in range(40):
        own = list(base)
        for k in rng.sample(range(300), 13):
            own[k] = rng.choice(words(rng, 3))
        near = list(own)
        while jp(" ".join(own), " ".join(near)) > 0.85:
            near[rng.randrange(300)] = words(rng, 1)[0]
        while jp(" ".join(own), " ".join(near)) < 0.8:
            k = next(i for i in range(300) if near[i] != own[i])
            near[k] = own[k]
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(own), " ".join(near)]
    got = {r.doc_id: r["class"] for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    # other pairs are under the threshold, but chains of links may join them; no class without a link
    assert len(set(got.values())) > 25


def test_one_row_of_each_class_is_kept(spark, tmp_path):
    rng = random.Random(14)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    rows = [(None, a), (None, a), (5, b), (5, b), (None, b), (7, c), (7, d), (8, d)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = near_dedup.op10_near_dedup(spark, str(tmp_path)).collect()
    assert len(got) == 8 and all(r.keep is not None for r in got)
    assert sorted((r.doc_id or 0, r.class_size) for r in got if r.keep) == [(0, 2), (5, 3), (7, 1), (7, 2)]


def test_a_few_words_over_and_over(spark, tmp_path):
    rng = random.Random(15)
    menu = "home news about shop " * 20
    texts = [f"{' '.join(words(rng, 30))} {menu}", f"{menu} {' '.join(words(rng, 30))}", " ".join(words(rng, 90)), "left right " * 30]
    got = substring_dedup.repeated_paragraphs(table(spark, texts)).collect()
    passages = [r for r in got if r.unit == "passage"]
    assert {r.doc_id for r in passages} == {0, 1}
    assert sum(r.keep for r in got) == len({r["class"] for r in got})
    # every run of 50 words of the menu holds one
    for doc, first in ((0, 30), (1, 0)):
        at = sorted(r.paragraph for r in passages if r.doc_id == doc)
        assert all(any(k <= p <= k + 50 - substring_dedup.PIECE for p in at) for k in range(first, first + 80 - 50))


def test_a_batch_whose_writer_was_lost_can_be_written(spark, tmp_path, monkeypatch):
    store = secrets.Batches(spark, f"file://{tmp_path}/store", "n long")
    rows = spark.range(10).selectExpr("id AS n")

    class Lost(BaseException):
        pass

    def lost(self, draft, mark):
        raise Lost

    with monkeypatch.context() as m:
        m.setattr(secrets.Batches, "_publish", lost)
        with pytest.raises(Lost):
            store.commit("b", rows)
    assert store.read().count() == 0
    assert store.commit("b", rows) and not store.commit("b", rows) and store.read().count() == 10
