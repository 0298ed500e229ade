"""Q20 in one pass: odd sequences, repeated ids, and the plan."""

import random

from sporeline.functions.bases import _AMINO, longest_open_pieces
from sporeline.operators import sequences as Q

CODE = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def by_hand(seq):
    rows = []
    for sign, strand in ((1, seq), (-1, seq[::-1].translate(str.maketrans("ACGT", "TGCA")))):
        for shift in range(3):
            at = shift
            for piece in "".join(CODE.get(strand[k : k + 3], "X") for k in range(shift, len(strand) - 2, 3)).split("*"):
                rows.append((sign * (shift + 1), at, piece, strand[at : at + 3 * len(piece)]))
                at += 3 * len(piece) + 3
    top = max(len(r[2]) for r in rows)
    return sorted(r for r in rows if len(r[2]) == top > 0)


def odd(seed):
    rng = random.Random(seed)
    made = ["".join(rng.choices("ACGT", k=k)) for k in (0, 1, 2, 3, 4, 5, 6, 30, 400)] + ["".join(rng.choices("ACGTN-é漢🙂", k=90)) for _ in range(8)]
    return made + ["TAATAATAA", "TAG" * 9, "ATGTAA" * 5, "N" * 31]


def test_pieces_are_those_by_hand():
    for seq in odd(6) + odd(7):
        assert sorted((r["frame"], r["begin"], r["protein"], r["cds"]) for r in longest_open_pieces(seq)) == by_hand(seq)


def test_one_translation_and_the_longest_of_an_id(spark, tmp_path):
    texts = odd(8)
    rows = [(str(k), t.lower()) for k, t in enumerate(texts)] + [("none", None), (None, "ATG"), ("twice", "ATGAAA"), ("twice", "ATGAAACCCGGG")]
    spark.createDataFrame(rows, "id string, seq string").write.parquet(str(tmp_path / "s"))
    found = Q.longest_orf(spark.read.parquet(str(tmp_path / "s")))
    expected = [(str(k), *r) for k, t in enumerate(texts) for r in by_hand(t.lower().upper())] + [("twice", *r) for r in by_hand("ATGAAACCCGGG")]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert found.columns == ["id", "frame", "begin", "protein", "cds"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "regexp_extract_all" not in plan
