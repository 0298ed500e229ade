"""Operator 12 against sums over single features, and on odd tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np

from sporeline.llm import resampling as R

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bucket(word, n=10_000):
    return zlib.crc32(word.encode()) % n


def test_features_are_runs_of_words():
    text = "Äpfel und ÄPFEL, a-b_c 12x İ 漢字。\x00z\x7fy"
    assert [f.decode() for f in R.features(text)] == words(text)
    mine = words(text)
    assert [f.decode() for f in R.features(text, 3)] == [" ".join(mine[i : i + n]) for n in (1, 2, 3) for i in range(len(mine) - n + 1)]
    assert R.features(None) == R.features("") == R.features(" .,\n") == []


def test_bit_planes_give_exact_sums():
    rng = np.random.default_rng(1)
    for n in (10_000, 64, 7):
        gains = rng.integers(-20_000, 20_000, n)
        for scale in (gains, np.zeros(n, np.int64), np.abs(gains), -np.abs(gains)):
            scales = R.Scales(scale)
            for top in (1, 2, 3, 1000, 2**31):
                counts = rng.integers(0, top, n) * (rng.random(n) < 0.3)
                assert scales.weigh(counts) == int((counts * scale).sum())


def plain(docs, items, percent=10, least=20):
    s, t = ([bucket(w) for _, x in side for w in words(x)] for side in (docs, items))
    ns, nt = ({b: side.count(b) for b in set(side)} for side in (s, t))
    out = []
    for key, text in docs:
        mine = [bucket(w) for w in words(text)]
        weight = sum(math.floor(1000 * math.log((nt.get(b, 0) + 1) * (len(s) + 10000) / ((ns[b] + 1) * (len(t) + 10000)))) for b in mine)
        h = int(hashlib.sha256(f"2024:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(mine), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r, rank.get(id(r))) for r in out]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def test_query_equals_plain_sums(spark, tmp_path):
    rng = random.Random(6)
    some = ["alpha", "Beta", "gamma", "étude", "漢字", "x9"] + [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(some) for _ in range(rng.randint(0, 80)))) for i in range(400)]
    docs += [(None, docs[3][1]), (None, docs[3][1]), (5, docs[5][1]), (900, None), (901, ""), (902, "."), (903, "beta " * 40000)] + [(950, "gamma w1 " * 15)] * 200
    items = [(i, " ".join(rng.choice(some[:40]) for _ in range(30))) for i in range(20)] + [(None, None)]
    spark.createDataFrame([(*r, 1) for r in docs], SCHEMA + ", rank int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = R.op12_target_resampling(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert in_order(tuple(r) for r in got.collect()) == in_order(plain(docs, items))


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10, 3), (2, "d e f " * 10, 4)], "_row long, score string, _place int")
    items = spark.createDataFrame([("a b",)], "score string")
    take = dict(percent=50, id_col="_row", text_col="score")
    rows = R.target_resample(docs, items, **take).collect()
    assert sorted(r["_row"] for r in rows) == [1, 2] and [r["rank"] for r in rows].count(1) == 1
    lone = {r["_row"]: r["weight"] for r in R.target_resample(docs, items.limit(0), **take).collect()}
    assert lone == {1: 30 * math.floor(1000 * math.log(10060 / (11 * 10000))), 2: 30 * math.floor(1000 * math.log(10060 / (11 * 10000)))}
    assert R.target_resample(docs.limit(0), items, **take).count() == 0
