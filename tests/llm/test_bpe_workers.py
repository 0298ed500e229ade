"""op3 in one Python worker a task, long texts one at a time."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sporeline.llm import bpe


@pytest.mark.parametrize("segment", [64, 32768])
def test_ids_and_their_text_come_from_one_worker(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(bpe, "SEGMENT", segment)
    texts = [None, "", "one two", "three\n four é " * 40, "x" * 200, "three\n four é " * 40]
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
    spark.createDataFrame(list(enumerate(texts)), schema).write.parquet(str(tmp_path / "documents.parquet"))
    found = bpe.op3_bpe_tree(spark, str(tmp_path))
    import tiktoken

    ranks = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).value
    encoding: tiktoken.Encoding = bpe.Codec(*ranks).encoding
    for r in found.collect():
        text = texts[r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # ids of short texts, ids of pieces; no third or fourth for decoding, and no list of all long texts of a batch
    assert plan.count("ArrowEvalPython") == 2 and "collect_list" not in plan


def test_a_worker_holds_the_ids_of_a_run_and_not_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(bpe, "RUN", 1000)
    texts = ["some words é " * k for k in range(60)] + ["", None, "x" * 3000, "end"]
    import pandas as pd

    runs = [r.tolist() for r in bpe._runs(iter([pd.Series([t or "" for t in texts]), pd.Series([], dtype=object)]))]
    assert [t for r in runs for t in r] == [t or "" for t in texts]
    assert len(runs) > 20 and all(sum(map(len, r[1:])) < 1000 for r in runs)
    shared = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoding = bpe.Codec(*shared.value).encoding
    rows = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), shared, decoded="bytes").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == encoding.encode_ordinary(texts[r.doc_id] or "") and bytes(r.bytes).decode() == (texts[r.doc_id] or "")
