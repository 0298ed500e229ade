"""The pipeline on small tables with planted cases."""

import base64
import random

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_operators import words


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(21)
    clean = lambda n: " ".join(w if i % 4 else "the" for i, w in enumerate(words(rng, n)))
    item = " ".join(words(rng, 40))
    texts = {i: clean(rng.randint(80, 300)) for i in range(30)}
    texts[30] = texts[3]
    near = texts[4].split()
    near[10] = "edit"
    texts[31] = " ".join(near)
    texts[32] = clean(60) + " " + item + " " + clean(60)
    texts[33] = clean(90) + ' token = "0123456789abcdef0123456789abcdef" ' + clean(20)
    texts[34], texts[35], texts[36] = "too short", None, ""
    docs = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(30), 33}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    masked = texts[33].replace('token = "0123456789abcdef0123456789abcdef', "[SECRET]")
    for i, r in got.items():
        assert r.ids == encoding.encode_ordinary(masked if i == 33 else texts[i]) and r.n_tokens == len(r.ids)
    stage = dict(corpus_pipeline.STAGES)["secret_scan"]
    out = {r.doc_id: r for r in stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert len(out) == len(texts)
    assert out[33].text.count("[SECRET]") == 1 and "0123456789abcdef" not in out[33].text and out[33].n_chars == len(out[33].text)
    assert all(out[i].text == texts[i] for i in texts if i != 33)


def test_stages_take_clashing_columns_nulls_and_repeated_rows(spark, tmp_path):
    rng = random.Random(22)
    good = " ".join(w if i % 4 else "the" for i, w in enumerate(words(rng, 120)))
    other = " ".join(w if i % 4 else "the" for i, w in enumerate(words(rng, 40000)))
    rows = [(1, good), (1, good), (2, None), (3, ""), (None, good + " password = abcdefg1"), (None, other), (5, other)]
    extra = ("_fp", "_head", "_quality", "_masked", "_blob", "_findings", "blob", "findings", "quality", "class", "item_id", "ids")
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), *[f"own {c}" for c in extra]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    spark.createDataFrame([(0, "no such item here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {"quality_rules": 5, "near_dedup": 3, "decontamination": 7, "secret_scan": 7, "bpe_tokens": 7}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        assert len(out) == kept[name], name
        if name != "bpe_tokens":
            assert all(r[c] == f"own {c}" for r in out for c in extra)
    assert sorted(str(r.doc_id) for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, str(tmp_path)).collect()) == ["1", "2", "5"]


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        assert name == "bpe_tokens" or out.columns == docs.columns
