"""Operator 11 against the library on whole texts, and its files byte by byte."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sporeline.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return lambda text: [*made.encode(text or "", add_special_tokens=False).ids, 1]


ODD = [
    None, "", " \n\t ", "\0", "a\0b \0 \0\0 c", "Hello, World's  don't I'LL!!", "x" * 50000, "İstanbul ΣΑΣ σας. ẞß Ǆ", "H̱ ̱h é É ü̈", "<|endoftext|> <|startoftext|> a",
    "\x1c\x1d a\x1fb\x85c\xa0d e f​g\r\nh\x0bi", "漢字 かな 🙂👩‍👩‍👧 ١٢٣ ½", "a.b,c..d ... --- 'S 'Re", "﻿bom", "K K Ω",
]


def test_words_equal_whole_texts(library, monkeypatch):
    with open(PATH, "rb") as file:
        made = T.WordCodec(file.read())
    rng = random.Random(2)
    bits = [c for t in ODD if t for c in t[:40]] + [" ", " ", "\n", "the", "and", "Ünd", "'s", "."]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for limit in (500_000, 10):
        monkeypatch.setattr(T, "REMEMBERED", limit)
        for k in range(0, len(texts), 500):
            mine = texts[k : k + 500]
            for text, raw in zip(mine, list(made.encode([t or "" for t in mine])), strict=True):
                assert [*np.frombuffer(raw, made.kind).tolist(), 1] == library(text), text


def want_of(rows, library):
    out, at = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library(text)
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_the_library(spark, tmp_path, library):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma,", "Delta.", "été"]) for _ in range(rng.randint(1, 200)))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(-5, "below"), (None, "same"), (None, "same"), (7, rows[7][1])] + [(2000, "again and again")] * 300
    rng.shuffle(rows)
    spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", part string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in T.op11_token_files(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    want = want_of(rows, library)
    assert got == want


def test_files_are_small_and_hold_single_documents(spark, tmp_path, library):
    rng = random.Random(9)
    rows = [(i, " ".join(str(rng.random()) for _ in range(50))) for i in range(200)]
    folder = str(tmp_path / "out")
    T.write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, PATH, file_bytes=4000)
    (dictionary,) = [p.read_bytes()[:-1] for p in (tmp_path / "out" / "dictionary").glob("part-*") if p.stat().st_size]
    assert dictionary
    seen = {}
    for p in (tmp_path / "out" / "files").glob("part-*"):
        if content := p.read_bytes():
            file = T.TokenFile(content, dictionary)
            assert len(content) < 4000 + 3000
            for k in reversed(range(file.n)):
                seen[int(file.ids[k])] = file.document(k).tolist()
            with pytest.raises(ValueError, match="another dictionary"):
                T.TokenFile(content, dictionary + b"x")
            with pytest.raises(ValueError, match="damaged"):
                T.TokenFile(content[:-60] + bytes([content[-60] ^ 1]) + content[-59:], dictionary)
    assert seen == {i: library(t) for i, t in rows}
    starts = {(r.part, r.number): r.before for r in T.starts(spark, folder).collect()}
    got = sorted((starts[r.part, r.number] + r.first, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in T.read_token_files(spark, folder).collect())
    assert [(k, ids) for _, k, ids in got] == sorted(seen.items())
    assert len(starts) > 10


def test_empty_table_and_no_dictionary(spark, tmp_path, library):
    for name, rows in (("none", []), ("one", [(3, "a single text")])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
        assert [tuple(r) for r in T.op11_token_files(spark, str(tmp_path / name)).collect()] == want_of(rows, library)
