"""Chunk tables against plain strings, with chunks of a few bases and with long sequences."""

import random

import pytest
from pyspark.sql import functions as F

from sporeline.operators import chunks as C
from sporeline.operators import features as FT
from sporeline.sources.sequences import read_fasta

FLIP = str.maketrans("ACGTacgt", "TGCAtgca")
SIZE = 7


@pytest.fixture(scope="module")
def seqs():
    rng = random.Random(1)
    return {f"s{i}": "".join(rng.choice("ACGTN") for _ in range(n)) for i, n in enumerate([0, 1, 6, 7, 8, 14, 15, 100, 233])}


@pytest.fixture(scope="module")
def table(spark, seqs):
    return C.chunked(spark.createDataFrame(list(seqs.items()), "id string, seq string"), SIZE)


def strings(chunks):
    rows = chunks.collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.number):
        assert len(r.bases) <= SIZE and r.number * SIZE == len(out.get(r.id, ""))
        out[r.id] = out.get(r.id, "") + r.bases
    return out


def test_chunks_hold_the_sequences(table, seqs):
    assert strings(table) == seqs
    assert {r.id: r.length for r in C.lengths(table).collect()} == {i: len(s) for i, s in seqs.items()}


def test_cut(spark, table, seqs):
    rng = random.Random(2)
    asked = [(f"s{rng.randrange(9)}", rng.randint(1, 240), rng.randint(1, 240)) for _ in range(300)]
    asked += asked[:20] + [("gone", 1, 5), ("s0", 1, 3), ("s8", 300, 400), ("s8", -5, 3)]

    def want(i, a, b):
        part = seqs[i][max(min(a, b), 1) - 1 : max(a, b)]
        return part if a <= b else part[::-1].translate(FLIP)

    got = C.cut_whole(table, spark.createDataFrame(asked, "id string, start long, end long"), [], SIZE).collect()
    assert sorted((r.id, r.start, r.end, r.seq) for r in got) == sorted((i, a, b, want(i, a, b)) for i, a, b in asked if i != "gone")


@pytest.mark.parametrize("strict", [False, True])
def test_snps(spark, table, seqs, strict):
    rng = random.Random(3)
    edits = [(f"s{rng.randrange(9)}", rng.choice([rng.randint(1, 30), rng.randint(1, 260)]), rng.choice("ACGTN"), rng.choice("ACGT")) for _ in range(700)]
    edits += edits[:200] + [("s8", 0, "A", "C"), ("s8", -1, "A", "C"), ("s8", 3, "A", "CC"), ("gone", 1, "A", "C")]
    want = {i: [list(s), 0, 0] for i, s in seqs.items()}
    for i, p, r, a in sorted(edits):
        if i in want:
            s = want[i][0]
            fits = len(a) == 1 and 1 <= p <= len(s) and (not strict or s[p - 1] == r)
            want[i][1 if fits else 2] += 1
            if fits:
                s[p - 1] = a
    done = C.apply_snps(table, spark.createDataFrame(edits, "id string, pos long, ref string, alt string"), strict, SIZE)
    counts = {r.id: (r.a, r.r) for r in done.groupBy("id").agg(F.sum("applied").alias("a"), F.sum("rejected").alias("r")).collect()}
    assert strings(done) == {i: "".join(s) for i, (s, _, _) in want.items()}
    assert counts == {i: (a, r) for i, (_, a, r) in want.items()}


def test_masks(spark, table, seqs):
    rng = random.Random(4)
    regions = [(f"s{rng.randrange(9)}", a := rng.randint(-3, 240), a + rng.randint(-2, 20)) for _ in range(40)] + [("s8", 200, 10**12), ("gone", 1, 9)]
    want = {i: list(s) for i, s in seqs.items()}
    for i, a, b in regions:
        for k in range(max(a, 1), min(b, len(want.get(i, ""))) + 1):
            want[i][k - 1] = "N"
    got = C.mask_regions(table, spark.createDataFrame(regions, "id string, start long, end long"), size=SIZE)
    assert strings(got) == {i: "".join(s) for i, s in want.items()}


def moved(s, edits):
    """An insert goes before the place, a deletion takes the bases before it."""
    for _, loc, n in sorted(edits):
        s = s[: loc - 1] + "N" * n + s[loc - 1 :] if n > 0 else s[: loc - 1 + n] + s[loc - 1 :]
    return s


def test_moves_by_hand(spark):
    one = lambda edits: C.apply_moves(C.chunked(spark.createDataFrame([("a", "ACGTACGTAC")], "id string, seq string"), SIZE), spark.createDataFrame([("a", *e) for e in edits], "id string, ord int, loc int, shift int"), size=SIZE)
    assert strings(one([(1, 3, 2)])) == {"a": "ACNNGTACGTAC"}
    assert strings(one([(1, 5, -2)])) == {"a": "ACACGTAC"}
    assert strings(one([(1, 1, 3), (2, 4, -3), (3, 11, 1)])) == {"a": "ACGTACGTACN"}
    assert strings(one([(1, 11, -10)])) == {"a": ""}
    for bad in ((1, 12, 1), (1, 2, -2), (1, 0, 1)):
        with pytest.raises(Exception, match="outside a sequence"):
            one([bad]).collect()


def test_moves(spark, table, seqs, monkeypatch):
    rng = random.Random(5)
    for most in (512, 4):
        monkeypatch.setattr(C.Pieces, "MOST", most)
        edits = {}
        for i, s in seqs.items():
            n = len(s)
            for k in range(0 if i == "s5" else 60):
                loc = rng.randint(1, n + 1)
                shift = rng.choice([rng.randint(1, 20), -rng.randint(0, loc - 1)]) if n < 400 else -rng.randint(0, loc - 1)
                edits.setdefault(i, []).append((k, loc, shift))
                n += shift
        rows = [(i, *e) for i, mine in edits.items() for e in mine]
        rng.shuffle(rows)
        got = C.apply_moves(table, spark.createDataFrame(rows, "id string, ord int, loc long, shift int"), size=SIZE)
        assert strings(got) == {i: moved(s, edits.get(i, [])) for i, s in seqs.items()}
        # the same piece lists without Spark
        for i, s in seqs.items():
            made = C.Pieces(len(s))
            for _, loc, n in edits.get(i, []):
                if n > 0:
                    made.insert(loc - 1, n)
                else:
                    made.delete(loc - 1 + n, -n)
            assert "".join(s[a : a + n] if a >= 0 else "N" * n for a, n in made.all()) == moved(s, edits.get(i, []))


def test_features_move_with_their_bases(spark):
    """By hand: insert of 3 at 10, then a deletion of the 4 bases before 30."""
    moves = spark.createDataFrame([("c", 1, 10, 3), ("c", 2, 30, -4)], "seqid string, ord int, loc long, shift long")
    rows = [("before", 1, 9), ("from", 10, 12), ("around", 9, 12), ("cut", 20, 24), ("touch", 26, 40), ("edge", 15, 22), ("after", 27, 50)]
    want = {
        "before": (1, 9, True), "from": (13, 15, True), "around": (9, 15, False), "cut": (23, 27, False),
        "touch": (25, 39, True), "edge": (18, 25, True), "after": (26, 49, True),
    }
    got = FT.move_features(spark.createDataFrame([(i, "c", a, b) for i, a, b in rows], "id string, seqid string, start long, end long"), moves)
    assert {r.id: (r.start, r.end, r.valid) for r in got.collect()} == want


def test_tags_by_hand(spark, table, seqs):
    """80 bases, from 41 before the place (counted from 0) on, the end one short of the sequence's."""
    features = [("f1", "s8", 100, 120), ("f2", "s8", 5, 230), ("f3", "s7", 300, 61), ("f4", "s0", 1, 1), ("f5", "s1", 1, 1)]
    got = {(r.id, r.side): r.tag for r in C.sequence_tags(spark.createDataFrame(features, "id string, ref string, start long, end long"), table, size=SIZE).collect()}
    s = seqs["s8"]
    assert got["f1", "start"] == s[59:139] and len(s[59:139]) == 80 and got["f1", "end"] == s[79:159]
    assert got["f2", "start"] == s[0:44] and got["f2", "end"] == s[189:232]
    assert got["f3", "start"] == "" and got["f3", "end"] == seqs["s7"][20:99]
    assert got["f4", "start"] == got["f5", "start"] == "" and len(got) == 10


def test_spliced(spark, table, seqs):
    rows = [("m1", "+", "s8", "CDS", 10, 30), ("m1", "+", "s8", "CDS", 100, 109), ("m1", "+", "s8", "exon", 1, 5), ("m2", "-", "s7", "CDS", 50, 60), ("m2", "-", "s7", "CDS", 20, 27), ("m2", "-", "s7", "CDS", 20, 27)]
    got = {r.parent: (r.seq, r.regions) for r in C.spliced(spark.createDataFrame(rows, "parent string, strand string, seqid string, type string, start long, end long"), table, size=SIZE).collect()}
    a, b = seqs["s8"], seqs["s7"]
    assert got["m1"] == (a[9:30] + a[99:109], "10..30,100..109")
    assert got["m2"] == ((b[19:27] + b[19:27] + b[49:60])[::-1].translate(FLIP), "20..27,20..27,50..60")


def test_long_sequence(spark):
    """A sequence of 5,000,000 bases: no value of a result is longer than a chunk."""
    n = 5_000_000
    line = "".join(random.Random(6).choice("ACGT") for _ in range(1000))
    long = C.chunked(spark.createDataFrame([("c", line)], "id string, seq string").selectExpr("id", f"repeat(seq, {n // 1000}) AS seq"))
    edits = spark.createDataFrame([("c", k, 1 + 9_000 * k, 7 if k % 2 else -5) for k in range(1, 500)], "id string, ord int, loc long, shift int")
    got = C.apply_moves(long, edits)
    sizes = got.agg(F.max(F.length("bases")).alias("most"), F.sum(F.length("bases")).alias("all"), F.count("*").alias("n")).first()
    want = moved(line * (n // 1000), [tuple(r)[1:] for r in edits.collect()])
    assert (sizes["most"], sizes["all"]) == (C.SIZE, len(want))
    (r,) = C.whole(got, ["id"]).selectExpr("md5(seq) AS md5").collect()
    import hashlib

    assert r.md5 == hashlib.md5(want.encode()).hexdigest()


@pytest.mark.parametrize("block", [60, 150, 10**6])
def test_fasta_read_in_blocks(spark, tmp_path, seqs, block):
    parts = [f">{i} some text\n" + "".join(s[k : k + 11] + ("\r\n" if k % 2 else "\n") for k in range(0, len(s), 11)) for i, s in seqs.items()]
    (tmp_path / "one.fa").write_text("ACGT lost\n" + "".join(parts[:5]))
    (tmp_path / "two.fa").write_text("".join(parts[5:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        got = strings(C.read_fasta_chunks(spark, str(tmp_path), SIZE))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == seqs
    if block > 1000:
        (tmp_path / "one.fa").write_text("".join(parts[:5]))
        assert {r.id: r.seq for r in read_fasta(spark, str(tmp_path)).collect()} == seqs
