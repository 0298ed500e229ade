"""Registered queries that SQL cannot express, against plain Python over the same views."""

import itertools
import random

import pytest

from sporeline.operators import families as P
from sporeline.operators import hits as H
from sporeline.plans import registry
from sporeline.plans.adapters import view

FOLDER = "/root/testdata/sf0.001"


def query(spark, name):
    return registry.QUERIES[name](spark, FOLDER).collect()


@pytest.fixture(scope="module")
def edges(spark):
    return sorted((r.line_no, r.src, r.dst, r.weight) for r in view(spark, FOLDER, "edges").collect())


def components(pairs):
    near, out = {}, {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in sorted(near):
        if start not in out:
            todo = [start]
            while todo:
                n = todo.pop()
                if n not in out:
                    out[n] = start
                    todo += near[n]
    return near, out


def test_star_clusters(spark, edges):
    subjects, taken, want = {}, set(), set()
    for _, q, s, _ in edges:
        subjects.setdefault(q, []).append(s)
    for q in subjects:
        if q not in taken:
            members = list(dict.fromkeys([q, *(s for s in subjects[q] if s not in taken)]))
            taken.update(members)
            want |= {(f"{'singlet' if len(members) == 1 else 'cluster'}_{q}", m) for m in members}
    assert {tuple(r) for r in query(spark, "g3_star_clusters")} == want


def test_greedy_clusters(spark, edges):
    got = query(spark, "g4_greedy_clusters")
    most = 3
    of, size = {}, {}
    for _, q, s, _ in edges:
        if q not in of:
            of[q], size[q] = q, 1
        if s not in of:
            home = of[q]
            if size[home] < most:
                of[s] = home
                size[home] += 1
            else:
                of[s], size[s] = s, 1
    groups = {}
    for m, home in of.items():
        groups.setdefault(home, set()).add(m)
    mine = {}
    for r in got:
        mine.setdefault(r.cluster, set()).add(r.member)
        assert r.size == size[of[r.member]]
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in mine.values()}
    ranked = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    assert [mine[f"cluster_{i + 1}"] for i in range(len(ranked))] == ranked


def test_articulation_points(spark, edges):
    near, of = components([(a, b) for _, a, b, _ in edges])
    want = set()
    for n in near:
        rest = [(a, b) for a in near if of[a] == of[n] and a != n for b in near[a] if b != n and a < b]
        _, parts = components(rest)
        kin = {k for k in near if of[k] == of[n] and k != n}
        if len(set(parts.values()) | {("lone", k) for k in kin - set(parts)}) > 1:
            want.add((of[n], n))
    assert {tuple(r) for r in query(spark, "g6_articulation_points")} == want


def test_assembly_order(spark, edges):
    best = {}
    for _, a, b, w in edges:
        key = min(a, b), max(a, b)
        best[key] = max(w, best.get(key, w))
    near, of = components(best)
    want = set()
    for root in set(of.values()):
        mine = sorted((-w, a, b) for (a, b), w in best.items() if of[a] == root)
        seen, place = {mine[0][1]}, 0
        want.add((root, mine[0][1], None, None, 0))
        while fringe := [x for x in mine if (x[1] in seen) != (x[2] in seen)]:
            w, a, b = fringe[0]
            place += 1
            want.add((root, b, a, float(-w), place) if a in seen else (root, a, b, float(-w), place))
            seen |= {a, b}
    assert {tuple(r) for r in query(spark, "g7_assembly_order")} == want


def test_kmer_candidates_keep_frequent_words(spark):
    rng = random.Random(1)
    stem = "".join(rng.choice("ACGT") for _ in range(40))
    seqs = [stem[: rng.randint(20, 40)] + "".join(rng.choice("ACGT") for _ in range(rng.randint(5, 40))) for _ in range(60)] + ["ACG", "A" * 30, "A" * 30]
    rows = [(f"s{i:02d}", s) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "id string, seq string")
    words = {i: {s[j : j + 9] for j in range(len(s) - 8)} for i, s in {s: i for i, s in reversed(rows)}.items() for i, s in [(s, i)]}
    want = {(a, b, 9 * len(words[a] & words[b])) for a, b in itertools.combinations(sorted(words), 2) if 9 * len(words[a] & words[b]) >= 75}
    assert {tuple(r) for r in H.kmer_candidates(df).collect()} == want
    assert {tuple(r) for r in H.equal_sequences(df).collect()} == {(i, min(k for k, t in rows if t == s)) for i, s in rows}


# families


@pytest.fixture(scope="module")
def aligned(spark):
    out = {}
    for r in view(spark, FOLDER, "aligned").collect():
        out.setdefault(r.family, {})[r.member] = r.seq
    return out


@pytest.fixture(scope="module")
def strains(spark):
    return {r.member: r.strain for r in view(spark, FOLDER, "members").collect()}


@pytest.fixture(scope="module")
def distances(aligned):
    out = {}
    for f, rows in aligned.items():
        for a, b in itertools.combinations(sorted(rows), 2):
            both = [(x, y) for x, y in zip(rows[a], rows[b], strict=True) if x != "-" and y != "-"]
            out.setdefault(f, {})[a, b] = sum(x != y for x, y in both) / len(both) if both else None
    return {f: d for f, d in out.items() if None not in d.values()}


def paths(newick):
    """Distances between all leaves, and of each leaf from the root."""
    found, deep = {}, {}

    def walk(t):
        if isinstance(t[0], str):
            return {t[0]: 0.0}
        below = {}
        for c in t[0]:
            mine = {k: v + c[1] for k, v in walk(c).items()}
            for a, b in itertools.product(below, mine):
                found[tuple(sorted((a, b)))] = below[a] + mine[b]
            below |= mine
        return below

    deep.update(walk(P.parse_newick(newick)))
    return found, deep


def plain_nj(names, d):
    """Unrooted splits by neighbour joining over dictionaries."""
    nodes = {n: frozenset([n]) for n in names}
    d = {frozenset(k): v for k, v in d.items()}
    found, order, made = set(), list(names), 0
    while len(order) > 3:
        total = {x: sum(d[frozenset((x, y))] for y in order if y != x) for x in order}
        pairs = [(len(order) - 2) * d[frozenset((x, y))] - total[x] - total[y] for x, y in itertools.combinations(order, 2)]
        low = min(pairs)
        near = [p for p, v in zip(itertools.combinations(order, 2), pairs, strict=True) if v - low < 1e-9]
        if len(order) == 4:  # of the last four, a pair and the other two give one tree, and tie always
            near = near[:1] if len(near) == 2 and not set(near[0]) & set(near[1]) else near
        if len(near) > 1:
            return None  # a tie: any of them is right
        x, y = near[0]
        made += 1
        new = f"#{made}"
        for z in order:
            if z not in (x, y):
                d[frozenset((new, z))] = (d[frozenset((x, z))] + d[frozenset((y, z))] - d[frozenset((x, y))]) / 2
        nodes[new] = nodes[x] | nodes[y]
        order = [z for z in order if z not in (x, y)] + [new]
        every = frozenset(names)
        side = nodes[new] if min(every) not in nodes[new] else every - nodes[new]
        if 1 < len(side) < len(every) - 1:
            found.add(",".join(sorted(side)))
    return found


def test_trees(spark, distances):
    got = {r.family: r.newick for r in query(spark, "p10_trees")}
    assert set(got) == set(distances)
    plain = 0
    for f, d in distances.items():
        names = sorted({x for p in d for x in p})
        assert sorted(P.leaves(P.parse_newick(got[f]))) == names
        want = plain_nj(names, d)
        assert want is None or set(P.splits(got[f])) == want
        plain += want is not None
    assert plain
    rng = random.Random(4)
    for _ in range(50):
        names = [f"m{i}" for i in range(rng.randint(4, 9))]
        d = {p: rng.random() for p in itertools.combinations(names, 2)}
        matrix = P.np.array([[0.0 if a == b else d[tuple(sorted((a, b)))] for b in names] for a in names])
        assert set(P.splits(P.build_tree(names, matrix))) == plain_nj(names, d)
    # a tree's own leaf distances give the tree back
    text = "((A:1,B:2):3,(C:1.5,(D:1,E:2):1):0.5);"
    own, _ = paths(text)
    names = sorted("ABCDE")
    matrix = [[0.0 if a == b else own[tuple(sorted((a, b)))] for b in names] for a in names]
    again, _ = paths(P.build_tree(names, P.np.array(matrix)))
    assert {k: round(v, 4) for k, v in again.items()} == {k: round(v, 4) for k, v in own.items()}


def test_upgma_is_ultrametric(spark, distances):
    for r in query(spark, "p10_upgma"):
        _, deep = paths(r.newick)
        assert set(deep) == {x for p in distances[r.family] for x in p}
        assert max(deep.values()) - min(deep.values()) < 1e-4
        assert max(deep.values()) * 2 <= max(distances[r.family].values()) + 1e-4


@pytest.mark.parametrize("name", ["p10_midpoint", "p10_strain_root", "p10_longest_root"])
def test_rooting_keeps_the_tree(spark, aligned, strains, name):
    plain = {r.family: r.newick for r in query(spark, "p10_trees")}
    got = {r.family: r.newick for r in query(spark, name)}
    wanted = set(plain) if name != "p10_strain_root" else {f for f in plain if "st1" in {strains[m] for m in P.leaves(P.parse_newick(plain[f]))}}
    assert set(got) == wanted
    for f, t in got.items():
        was, deep_was = paths(plain[f])
        now, deep = paths(t)
        assert all(abs(now[k] - was[k]) < 1e-4 for k in was) and set(now) == set(was)
        if name == "p10_midpoint":
            far = max(was.values())
            assert abs(max(deep.values()) - far / 2) < 1e-4
        else:
            lone = [c[0] for c in P.parse_newick(t)[0] if isinstance(c[0], str) and c[1] == 0]
            if name == "p10_strain_root":
                own = [m for m in deep if strains[m] == "st1"]
                assert any(m in own and deep_was[m] >= max(deep_was[x] for x in own) - 1e-5 for m in lone)
            else:
                size = {m: len(s.replace("-", "")) for m, s in aligned[f].items()}
                assert max((size[m], m) for m in deep)[1] in lone


def test_bootstrap_and_filter(spark, aligned):
    support = {(r.family, r.split): r.support for r in query(spark, "p11_bootstrap")}
    assert all(0 < v <= 100 for v in support.values())
    assert {(r.family, r.split): r.support for r in query(spark, "p11_bootstrap")} == support
    for f, s in support:
        assert 1 < len(s.split(",")) < len(aligned[f]) - 1 and set(s.split(",")) < set(aligned[f])
    plain = {r.family: r.newick for r in query(spark, "p10_trees")}
    want = {f for f, t in plain.items() if all(support.get((f, s), 0) >= 20 for s in P.splits(t))}
    assert {r.family: r.newick for r in query(spark, "p12_filter_support")} == {f: plain[f] for f in want}
    clear = {"A": "AAAAAAAA", "B": "AAAAAAAA", "C": "CCCCCCCC", "D": "CCCCCCCC"}
    df = spark.createDataFrame([(1, m, s) for m, s in clear.items()], "family long, member string, seq string")
    assert [(r.split, r.support) for r in P.bootstrap_support(df, 20).collect()] == [("C,D", 100.0)]


def test_topotypes_and_tables(spark, strains):
    rooted = {r.family: r.newick for r in query(spark, "p10_midpoint")}
    shape = {f: P.canonical(t, strains, (0.05,)) for f, t in rooted.items()}
    n = {}
    for s in shape.values():
        n[s] = n.get(s, 0) + 1
    rank = {s: i + 1 for i, s in enumerate(sorted(n, key=lambda s: (-n[s], s)))}
    assert {tuple(r) for r in query(spark, "p13_topotypes")} == {(f, s, rank[s], n[s]) for f, s in shape.items()}
    by = {m: {r.family: P.canonical(r.newick, strains, (0.05,)) for r in query(spark, q)} for m, q in (("nj", "p10_trees"), ("upgma", "p10_upgma"))}
    assert {tuple(r) for r in query(spark, "p14_topology_table")} == {(f, by["nj"].get(f, "NA"), by["upgma"].get(f, "NA")) for f in {*by["nj"], *by["upgma"]}}
    counts = [list(v.values()) for v in by.values()]
    assert {tuple(r) for r in query(spark, "p14_topology_counts")} == {(s, counts[0].count(s), counts[1].count(s)) for s in {*counts[0], *counts[1]}}


def test_allele_parent(spark, strains):
    rooted = {r.family: r.newick for r in query(spark, "p10_midpoint")}
    good = {(r.family, r.a, r.b) for r in query(spark, "p2_member_overlaps") if r.length >= 10 and r.identity >= 20}
    want = set()

    def walk(f, t):
        if isinstance(t[0], str):
            return
        for i, c in enumerate(t[0]):
            walk(f, c)
            if isinstance(c[0], str) and strains[c[0]] == "st2":
                kin = [x for j, o in enumerate(t[0]) if j != i for x in P.leaves(o) if strains[x] in ("st0", "st1")]
                if len(kin) == 1 and (f, *sorted((c[0], kin[0]))) in good:
                    want.add((f, c[0], strains[kin[0]]))

    for f, t in rooted.items():
        walk(f, P.parse_newick(t))
    assert {tuple(r) for r in query(spark, "p15_allele_parent")} == want


def test_prune_by_strains(spark, distances, strains):
    want = set()
    for f, d in distances.items():
        need, kept = {"st0": 1, "st2": 1}, {}
        for (a, b), _ in sorted(d.items(), key=lambda x: ({strains[x[0][0]], strains[x[0][1]]} != {"st0", "st2"}, x[1], x[0])):
            for m in (a, b):
                if m not in kept and need.get(strains[m], 0):
                    kept[m] = strains[m]
                    need[strains[m]] -= 1
            if not any(need.values()):
                want |= {(f, m, s) for m, s in kept.items()}
                break
    assert {tuple(r) for r in query(spark, "p6_prune_by_strains") if r.family in distances} == want


def test_prune_by_overlaps(spark, strains):
    families = {}
    for r in query(spark, "p2_member_overlaps"):
        families.setdefault(r.family, {})[r.a, r.b] = r.score
    got = {}
    for r in query(spark, "p7_prune_by_overlaps"):
        got.setdefault(r.family, set()).add(r.member)
    for f, score in families.items():
        pairs = [p for p in score if {strains[p[0]], strains[p[1]]} == {"st0", "st2"}]
        assert (f in got) == bool(pairs)
        if pairs:
            assert len(got[f]) == 2 and abs(score[tuple(sorted(got[f]))] - max(score[p] for p in pairs)) < 1e-3
    sliced = {}
    for r in query(spark, "p7_pruned_slices"):
        sliced.setdefault(r.family, {})[r.member] = r.seq
    for f, rows in sliced.items():
        assert set(rows) <= got[f] and len({len(s) for s in rows.values()}) == 1


def test_feature_table(spark):
    import re

    described = {r.subject_id[1:]: r.description for r in view(spark, FOLDER, "subjects").collect()}
    genes = {}
    for r in view(spark, FOLDER, "hits").collect():
        genes.setdefault(r.query_id, set()).add(("CDS" if r.mismatches == 2 else "exon", r.q_start, r.q_end))
    want = set()
    for g, parts in genes.items():
        minus = int(g[1:]) % 2 == 0
        ends = lambda a, b, m=minus: (b, a) if m else (a, b)
        first, last = ends(min(p[1] for p in parts), max(p[2] for p in parts))
        want.add((g, "", 0, 0, f"{first}\t{last}\tgene"))
        m = f"{g}.1"
        for kind, k, name in (("exon", 1, "mRNA"), ("CDS", 3, "CDS")):
            mine = sorted((p for p in parts if p[0] == kind), key=lambda p: (-p[1], -p[2]) if minus else (p[1], p[2]))
            for i, (_, a, b) in enumerate(mine):
                a, b = ends(a, b)
                want.add((g, m, k, i, f"{'<' if kind == 'CDS' and i == 0 else ''}{a}\t{b}" + (f"\t{name}" if i == 0 else "")))
        text = described.get(g[1:])
        quals = [("protein_id", f"gnl|WGS:X|{g}.x.1"), ("transcript_id", f"gnl|WGS:X|mRNA:{g}.x.1")]
        if text is not None:
            tokens = re.findall(r"\w+|\W+", f"{text} Unknown Protein (EC 1.2.3) ".strip())
            low = [t.lower() if re.search("[A-Z][a-z]{2,}", t) else t for t in tokens]
            clean = "".join({"unknown": "hypothetical", "probable": "putative", "possible": "putative", "predicted": "putative", "potential": "putative"}.get(t, t) for t in low)
            quals += [("product", clean.replace(" (EC 1.2.3)", "").strip()), ("db_xref", "InterPro:IPR000001"), ("inference", "protein motif:InterPro:IPR000001"), ("note", "similar to Q9X")]
        quals += [("go_process", "growth|0001||ISS"), ("db_xref", "X:1")]
        for k, more in ((2, []), (4, [("EC_number", "1.2.3")] if text is not None else [])):
            want |= {(g, m, k, i, f"\t\t\t{a}\t{b}") for i, (a, b) in enumerate(quals + more)}
    assert {tuple(r) for r in query(spark, "i20_feature_table")} == want
