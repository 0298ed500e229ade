"""Gene families: aligned members, overlaps, pruning, distances, trees, topologies.

``aligned`` has family, member, seq, rows of one family equally long, gaps as
'-'. Helpers work on one family, pair or replicate at a time; families are
bounded by the clustering that makes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sporeline.functions.numbering import numbered
from sporeline.functions.storage import materialize


def _identity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Percent of columns, of those where neither has a gap, with the same letter."""
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = np.frombuffer(x.upper().encode(), np.uint8), np.frombuffer(y.upper().encode(), np.uint8)
        both = (p != 45) & (q != 45)
        out.append(100.0 * float((p == q)[both].sum()) / float(both.sum()) if both.any() else 0.0)
    return pd.Series(out)


def aligned_span(aligned: DataFrame) -> DataFrame:
    """(family, member, first, last): first and last column that is no gap, from 1; none for all-gap rows."""
    lead = F.length(F.regexp_extract("seq", "^(-*)", 1))
    tail = F.length(F.regexp_extract("seq", "(-*)$", 1))
    return aligned.where(F.length(F.replace("seq", F.lit("-"))) > 0).select("family", "member", (lead + 1).alias("first"), (F.length("seq") - tail).alias("last"))


def member_overlaps(aligned: DataFrame) -> DataFrame:
    """(family, a, b, start, end, length, identity, score) of pairs that share a column; score = length * (identity / 100) ** 2."""
    rows = aligned.join(aligned_span(aligned), ["family", "member"])
    left = rows.select("family", F.col("member").alias("a"), F.col("seq").alias("sa"), F.col("first").alias("fa"), F.col("last").alias("la"))
    right = rows.select("family", F.col("member").alias("b"), F.col("seq").alias("sb"), F.col("first").alias("fb"), F.col("last").alias("lb"))
    pairs = left.join(right, "family").where("a < b").withColumns({"start": F.greatest("fa", "fb"), "end": F.least("la", "lb")}).where("start <= end")
    n = F.col("end") - F.col("start") + 1
    cut = lambda c: F.substring(c, F.col("start"), n)
    found = pairs.select("family", "a", "b", "start", "end", n.alias("length"), F.pandas_udf(_identity, "double")(cut("sa"), cut("sb")).alias("identity"))
    return found.withColumn("score", F.col("length") * F.pow(F.col("identity") / 100, 2))


def ranked_pairs(overlaps: DataFrame, method: str = "score", min_length: int = 0, min_identity: float = 0) -> DataFrame:
    """Pairs over the minima with ``rank`` in their family by length, identity or score; ties to the least names."""
    kept = overlaps.where((F.col("length") >= min_length) & (F.col("identity") >= min_identity))
    by = Window.partitionBy("family").orderBy(F.col(method).desc(), "a", "b")
    return kept.withColumn("rank", F.row_number().over(by))


def seed_pairs(overlaps: DataFrame, method: str = "score", min_length: int = 0, min_identity: float = 0) -> DataFrame:
    """The best pair of each family by length, identity or score."""
    return ranked_pairs(overlaps, method, min_length, min_identity).where("rank = 1").drop("rank")


def common_overlap(spans: DataFrame) -> DataFrame:
    """(family, start, end) that all members share; families without one are left out."""
    return spans.groupBy("family").agg(F.max("first").alias("start"), F.min("last").alias("end")).where("start <= end")


def slice_alignment(aligned: DataFrame, windows: DataFrame) -> DataFrame:
    """Members cut to their family's (start, end), without columns that are gaps in every member; all-gap rows dropped."""
    cut = aligned.join(windows, "family").withColumn("seq", F.expr("substring(seq, start, end - start + 1)"))
    used = cut.select("family", F.posexplode(F.split("seq", "")).alias("i", "c")).where("c NOT IN ('-', '')").select("family", "i").distinct()
    kept = used.groupBy("family").agg(F.array_sort(F.collect_list("i")).alias("cols"))
    packed = F.array_join(F.transform("cols", lambda i: F.substring("seq", i + 1, F.lit(1))), "")
    return cut.join(kept, "family").select("family", "member", packed.alias("seq")).where("seq RLIKE '[^-]'")


def align_stats(aligned: DataFrame, strains: DataFrame) -> DataFrame:
    """(family, members, length, identity, composition, member_list); identity is the mean over overlapping pairs, null for one member."""
    n = aligned.groupBy("family").agg(F.count("*").alias("members"), F.max(F.length("seq")).alias("length"), F.array_join(F.array_sort(F.collect_list("member")), ",").alias("member_list"))
    ident = member_overlaps(aligned).groupBy("family").agg(F.avg("identity").alias("identity"))
    comp = aligned.join(strains, "member").groupBy("family", "strain").agg(F.count("*").alias("k"))
    comp = comp.groupBy("family").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "strain", F.col("k").cast("string")))), ",").alias("composition"))
    return n.join(ident, "family", "left").join(comp, "family", "left").select("family", "members", "length", "identity", "composition", "member_list")


def ace_to_alignment(ace_rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(family, member, seq): reads (contig_id, read_id, start, seq) padded with gaps to their contig (contig_id, length), clipped at its ends."""
    j = ace_rows.join(lengths, "contig_id")
    cut = F.when(F.col("start") < 1, F.expr("substring(seq, cast(2 - start as int))")).otherwise(F.col("seq"))
    left = F.concat(F.repeat(F.lit("-"), F.greatest(F.col("start") - 1, F.lit(0)).cast("int")), cut)
    return j.select(F.col("contig_id").alias("family"), F.col("read_id").alias("member"), F.rpad(left, F.col("length").cast("int"), F.lit("-")).alias("seq"))


def strain_composition(members: DataFrame, required: dict[str, int]) -> DataFrame:
    """P5: (family, composition, complete): members of each strain; complete when every required strain reaches its number."""
    per = members.groupBy("family", "strain").agg(F.count("*").alias("n"))
    enough = [F.max(F.when((F.col("strain") == s) & (F.col("n") >= k), 1).otherwise(0)) for s, k in sorted(required.items())]
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "strain", F.col("n").cast("string")))), ",")
    done = F.lit(True)
    for e in enough:
        done = done & (e == 1)
    return per.groupBy("family").agg(text.alias("composition"), done.alias("complete"))


def prune_by_strains(distances: DataFrame, strains: DataFrame, required: dict[str, int], farthest: bool = False, first: list[tuple[str, str]] | None = None) -> DataFrame:
    """(family, member, strain): members met while walking pairs from the closest (or farthest), until the composition is full; others drop out with incomplete families.

    Pairs of the strains in ``first`` are walked before all others, in that
    order, the closest (or farthest) of each first.
    """
    before = {frozenset(p): i for i, p in enumerate(first or [])}

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        need, kept = dict(required), {}
        turn = [before.get(frozenset(p), len(before)) for p in zip(pdf["strain_a"], pdf["strain_b"], strict=True)]
        for r in pdf.assign(t=turn, k=-pdf["distance"] if farthest else pdf["distance"]).sort_values(["t", "k", "a", "b"]).itertuples():
            for m, s in ((r.a, r.strain_a), (r.b, r.strain_b)):
                if m not in kept and need.get(s, 0) > 0:
                    kept[m], need[s] = s, need[s] - 1
            if not any(need.values()):
                break
        rows = [] if any(need.values()) else [(pdf["family"].iloc[0], m, s) for m, s in kept.items()]
        return pd.DataFrame(rows, columns=["family", "member", "strain"], dtype=object)

    s = strains.select("member", "strain")
    j = distances.join(s.withColumnsRenamed({"member": "a", "strain": "strain_a"}), "a").join(s.withColumnsRenamed({"member": "b", "strain": "strain_b"}), "b")
    kind = distances.schema["family"].dataType.simpleString()
    return j.select("family", "a", "b", "distance", "strain_a", "strain_b").groupBy("family").applyInPandas(rule, f"family {kind}, member string, strain string")


def grown(score: dict, strain: dict, required: dict[str, int], seed: tuple[str, str]) -> tuple[float, list[str]] | None:
    """(summed score, members) grown from a seed pair by the score with the members chosen so far; None where the composition stays short."""
    need, kept, total = dict(required), list(seed), score[seed]
    for m in seed:
        need[strain[m]] -= 1
    while any(need.values()):
        best = max(((sum(score.get((m, k), 0.0) for k in kept), m) for m in sorted(strain) if m not in kept and need.get(strain[m], 0) > 0), key=lambda x: x[0], default=None)
        if best is None or best[0] <= 0:
            return None
        total += best[0]
        kept.append(best[1])
        need[strain[best[1]]] -= 1
    return total, kept


def prune_by_overlaps(overlaps: DataFrame, strains: DataFrame, required: dict[str, int], seeds: int = 1) -> DataFrame:
    """(family, member, strain): grown from the family's best pair by overlap score with the members chosen so far until the composition is full.

    With more ``seeds``, that many pairs that fit the composition are grown and
    the set of the highest summed score wins, the earlier seed on ties. The
    members' alignment is cut to what they share by ``slice_alignment``.
    """

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        score, strain = {}, {}
        for r in pdf.itertuples():
            score[r.a, r.b] = score[r.b, r.a] = r.score
            strain[r.a], strain[r.b] = r.strain_a, r.strain_b
        wanted = lambda a, b: min(required.get(strain[a], 0), required.get(strain[b], 0)) > 0 and (strain[a] != strain[b] or required[strain[a]] > 1)
        pairs = [p for p, _ in sorted(score.items(), key=lambda x: (-x[1], x[0])) if p[0] < p[1] and wanted(*p)]
        sets = [s for s in (grown(score, strain, required, p) for p in pairs[:seeds]) if s]
        best = max(sets, key=lambda s: s[0])[1] if sets else []
        return pd.DataFrame([(pdf["family"].iloc[0], m, strain[m]) for m in best], columns=["family", "member", "strain"], dtype=object)

    s = strains.select("member", "strain")
    j = overlaps.join(s.withColumnsRenamed({"member": "a", "strain": "strain_a"}), "a").join(s.withColumnsRenamed({"member": "b", "strain": "strain_b"}), "b")
    kind = overlaps.schema["family"].dataType.simpleString()
    return j.select("family", "a", "b", "score", "strain_a", "strain_b").groupBy("family").applyInPandas(rule, f"family {kind}, member string, strain string")


def prune_by_align(stats: DataFrame, conditions: dict[str, tuple[str, float]]) -> DataFrame:
    """Family statistics without the families that meet a condition, such as {"members": ("<", 4), "identity": (">=", 95)}; a missing value meets none."""
    tests = {"<": "__lt__", "<=": "__le__", "==": "__eq__", "!=": "__ne__", ">=": "__ge__", ">": "__gt__"}
    for column, (sign, value) in conditions.items():
        stats = stats.where(~F.coalesce(getattr(F.col(column), tests[sign])(value), F.lit(False)))
    return stats


#: What an alignment's qualification says.
PASSED, LOW_COVERAGE, LOW_IDENTITY = "PASS", "NO PASS COVERAGE FILTER", "NO PASS IDENTITY FILTER"


def qualify_alignments(aligned: DataFrame, stats: DataFrame, min_coverage: float, min_identity: float) -> DataFrame:
    """(family, length, members, identity, coverage, qualification): coverage is the percent of columns in which one letter is in at least half of the rows."""
    columns = aligned.select("family", F.posexplode(F.split("seq", "")).alias("i", "c")).where("c <> ''")
    counts = columns.groupBy("family", "i", "c").agg(F.count("*").alias("n")).where("c <> '-'").groupBy("family", "i").agg(F.max("n").alias("n"))
    j = counts.join(stats.select("family", "members", "length", "identity"), "family")
    agreed = j.groupBy("family").agg(F.count_if(2 * F.col("n") >= F.col("members")).alias("agreed"))
    rows = stats.join(agreed, "family", "left").withColumn("coverage", 100 * F.coalesce("agreed", F.lit(0)) / F.col("length"))
    low, unlike = F.col("coverage") < min_coverage, F.coalesce(F.col("identity") < min_identity, F.lit(False))
    said = F.when(low & unlike, f"{LOW_COVERAGE}+ {LOW_IDENTITY}").when(low, LOW_COVERAGE).when(unlike, LOW_IDENTITY).otherwise(PASSED)
    return rows.select("family", "length", "members", "identity", "coverage", said.alias("qualification"))


def _counts(x: str, y: str) -> tuple[int, int, int]:
    """(compared columns, transitions, transversions)."""
    p, q = np.frombuffer(x.upper().encode(), np.uint8), np.frombuffer(y.upper().encode(), np.uint8)
    n = min(len(p), len(q))
    p, q = p[:n], q[:n]
    known = np.isin(p, (65, 67, 71, 84)) & np.isin(q, (65, 67, 71, 84))
    p, q = p[known], q[known]
    purine = np.isin(p, (65, 71)) == np.isin(q, (65, 71))
    differ = p != q
    return len(p), int((differ & purine).sum()), int((differ & ~purine).sum())


def distance_of(x: str, y: str, model: str) -> float | None:
    n, ts, tv = _counts(x, y)
    if not n:
        return None
    p, q = ts / n, tv / n
    try:
        if model == "uncorrected":
            return p + q
        if model == "jukes-cantor":
            return float(-0.75 * np.log(1 - 4 / 3 * (p + q))) if p + q < 0.75 else None
        return float(-0.5 * np.log(1 - 2 * p - q) - 0.25 * np.log(1 - 2 * q)) if 1 - 2 * p - q > 0 and 1 - 2 * q > 0 else None
    except ValueError:
        return None


def _by_model(n: np.ndarray, ts: np.ndarray, tv: np.ndarray, model: str) -> np.ndarray:
    """Distances of ``n`` compared columns with so many transitions and transversions; NaN where they are not defined."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = ts / n, tv / n
        if model == "uncorrected":
            return p + q
        if model == "jukes-cantor":
            return np.where(p + q < 0.75, -0.75 * np.log(1 - 4 / 3 * (p + q)), np.nan)
        return np.where((1 - 2 * p - q > 0) & (1 - 2 * q > 0), -0.5 * np.log(1 - 2 * p - q) - 0.25 * np.log(1 - 2 * q), np.nan)


def distances_of(left: list[str], right: list[str], model: str) -> np.ndarray:
    """``distance_of`` of many pairs, their columns laid end to end; NaN for None."""
    rows = [(x.upper().encode(), y.upper().encode()) for x, y in zip(left, right, strict=True)]
    size = np.array([min(len(x), len(y)) for x, y in rows], dtype=np.int64)
    p, q = (np.frombuffer(b"".join(r[k][:n] for r, n in zip(rows, size, strict=True)), np.uint8) for k in (0, 1))
    ends = np.cumsum(size)
    total = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[np.concatenate([[0], ends])]).astype(np.float64)
    known = np.isin(p, (65, 67, 71, 84)) & np.isin(q, (65, 67, 71, 84))
    same_ring = np.isin(p, (65, 71)) == np.isin(q, (65, 71))
    return _by_model(total(known), total(known & (p != q) & same_ring), total(known & (p != q) & ~same_ring), model)


def pair_distances(aligned: DataFrame, model: str = "uncorrected") -> DataFrame:
    """(family, a, b, distance) under uncorrected, jukes-cantor or kimura; null where it is not defined."""

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(distances_of(a.tolist(), b.tolist(), model))

    left = aligned.select("family", F.col("member").alias("a"), F.col("seq").alias("sa"))
    right = aligned.select("family", F.col("member").alias("b"), F.col("seq").alias("sb"))
    d = left.join(right, "family").where("a < b").select("family", "a", "b", distance("sa", "sb").alias("distance"))
    return d.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))


def nearest_member(distances: DataFrame) -> DataFrame:
    """(family, member, nearest, distance): the closest other member, least name on ties."""
    both = distances.select("family", F.col("a").alias("member"), F.col("b").alias("nearest"), "distance").unionByName(distances.select("family", F.col("b").alias("member"), F.col("a").alias("nearest"), "distance"))
    best = both.where("distance IS NOT NULL").groupBy("family", "member").agg(F.min(F.struct("distance", "nearest")).alias("m"))
    return best.select("family", "member", "m.nearest", "m.distance")


def _matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    left, right = pdf["a"].tolist(), pdf["b"].tolist()
    names = sorted({*left, *right})
    at = {m: i for i, m in enumerate(names)}
    i, j = [at[m] for m in left], [at[m] for m in right]
    d = np.zeros((len(names), len(names)))
    d[i, j] = d[j, i] = pdf["distance"].to_numpy()
    return names, d


def build_tree(names: list[str], d: np.ndarray, method: str = "nj") -> str:
    """Newick text by neighbour joining or UPGMA; ties to the first pair in name order."""
    labels, d, sizes, heights = list(names), d.astype(float).copy(), [1] * len(names), [0.0] * len(names)
    while len(labels) > 2 or (method == "upgma" and len(labels) > 1):
        n = len(labels)
        total = d.sum(axis=1)
        q = d.copy() if method == "upgma" else (n - 2) * d - total[:, None] - total[None, :]
        q[np.tril_indices(n)] = np.inf
        i, j = np.unravel_index(np.argmin(q), q.shape)
        if method == "upgma":
            h = d[i, j] / 2
            li, lj = h - heights[i], h - heights[j]
            row = (sizes[i] * d[i] + sizes[j] * d[j]) / (sizes[i] + sizes[j])
        else:
            li = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
            lj, h = d[i, j] - li, 0.0
            row = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        labels = [labels[k] for k in keep] + [f"({labels[i]}:{li:.6f},{labels[j]}:{lj:.6f})"]
        sizes = [sizes[k] for k in keep] + [sizes[i] + sizes[j]]
        heights = [heights[k] for k in keep] + [h]
        d = np.vstack([np.column_stack([d[np.ix_(keep, keep)], row[keep]]), np.append(row[keep], 0.0)])
    if len(labels) == 1:
        return labels[0] + ";"
    return f"({labels[0]}:{d[0, 1] / 2:.6f},{labels[1]}:{d[0, 1] / 2:.6f});"


#: Numbers of the distance matrices that are joined at once.
CELLS = 500_000


def joins(d: np.ndarray, method: str = "nj") -> Iterator[tuple[np.ndarray, ...]]:
    """(first, second, the others, branch to the first, to the second) of each step of ``build_tree`` for many matrices (trees, n, n) at once.

    The joined pair goes behind the others. After the last step of neighbour
    joining two labels are left; their distance is halved on both branches.
    """
    b, n, _ = d.shape
    each, sizes, heights = np.arange(b), np.ones((b, n)), np.zeros((b, n))
    while n > 2 or (method == "upgma" and n > 1):
        total = d.sum(axis=2)
        q = d.copy() if method == "upgma" else (n - 2) * d - total[:, :, None] - total[:, None, :]
        q[:, *np.tril_indices(n)] = np.inf
        i, j = np.divmod(q.reshape(b, -1).argmin(axis=1), n)
        apart = d[each, i, j]
        if method == "upgma":
            h = apart / 2
            li, lj = h - heights[each, i], h - heights[each, j]
            si, sj = sizes[each, i][:, None], sizes[each, j][:, None]
            row = (si * d[each, i] + sj * d[each, j]) / (si + sj)
        else:
            li, h = apart / 2 + (total[each, i] - total[each, j]) / (2 * (n - 2)), np.zeros(b)
            lj = apart - li
            row = (d[each, i] + d[each, j] - apart[:, None]) / 2
        keep = np.arange(n - 2)[None, :] + (np.arange(n - 2)[None, :] >= i[:, None])
        keep += keep >= j[:, None]
        yield i, j, keep, li, lj
        of = each[:, None]
        sizes = np.column_stack([sizes[of, keep], sizes[each, i] + sizes[each, j]])
        heights = np.column_stack([heights[of, keep], h])
        less = np.zeros((b, n - 1, n - 1))
        less[:, :-1, :-1] = d[each[:, None, None], keep[:, :, None], keep[:, None, :]]
        less[:, -1, :-1] = less[:, :-1, -1] = row[of, keep]
        d, n = less, n - 1
    if method != "upgma":
        half = d[:, 0, 1] / 2
        yield np.zeros(b, dtype=np.int64), np.ones(b, dtype=np.int64), np.zeros((b, 0), dtype=np.int64), half, half


def newicks(names: list[list[str]], d: np.ndarray, method: str = "nj") -> list[str]:
    """``build_tree`` of many matrices of one size."""
    labels = [list(x) for x in names]
    for i, j, keep, li, lj in joins(d, method):
        for t, (a, b, rest, x, y) in enumerate(zip(i.tolist(), j.tolist(), keep.tolist(), li.tolist(), lj.tolist(), strict=True)):
            old = labels[t]
            labels[t] = [old[k] for k in rest] + [f"({old[a]}:{x:.6f},{old[b]}:{y:.6f})"]
    return [x[0] + ";" for x in labels]


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each run of equal keys in sorted batches, one run held at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch), dtype=bool)
        for k in keys:
            new[1:] |= batch[k].to_numpy()[1:] != batch[k].to_numpy()[:-1]
            new[0] |= bool(held) and held[-1][k].iloc[-1] != batch[k].iloc[0]
        cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if k and held:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            if x < y:
                held.append(batch.iloc[x:y])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def trees(distances: DataFrame, method: str = "nj") -> DataFrame:
    """P10: (family, newick) of families whose distances are all defined."""
    return trees_by(distances, [method]).select("family", "newick")


def trees_by(distances: DataFrame, methods: list[str]) -> DataFrame:
    """P10: (family, method, newick), a row a method, from one pass over the distances.

    Families are walked in sorted partitions, without a call a family;
    matrices of one size are joined together, up to CELLS numbers at a time.
    """

    def rule(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[tuple]] = {}

        def made(n: int) -> pd.DataFrame:
            families, names, ds = zip(*waiting.pop(n), strict=True)
            parts = [pd.DataFrame({"family": families, "method": m, "newick": newicks(names, np.stack(ds), m)}) for m in methods]
            return pd.concat(parts)

        for pdf in _runs(batches, ["family"]):
            if pdf["distance"].isna().any():
                continue
            names, d = _matrix(pdf)
            held = waiting.setdefault(len(names), [])
            held.append((pdf["family"].iloc[0], names, d))
            if len(held) * len(names) ** 2 >= CELLS:
                yield made(len(names))
        for n in list(waiting):
            yield made(n)

    kind = distances.schema["family"].dataType.simpleString()
    rows = distances.where("family IS NOT NULL").repartition("family").sortWithinPartitions("family", "a", "b").select("family", "a", "b", "distance")
    return rows.mapInPandas(rule, f"family {kind}, method string, newick string")


def _graph(newick: str) -> tuple[dict[int, list[tuple[int, float]]], dict[int, str]]:
    """(neighbours with branch lengths, leaf names) of an unrooted tree; node 0 is the old root."""
    near: dict[int, list[tuple[int, float]]] = {}
    names: dict[int, str] = {}

    def add(t) -> int:
        me = len(near)
        near[me] = []
        if isinstance(t[0], str):
            names[me] = t[0]
        else:
            for c in t[0]:
                kid = add(c)
                near[me].append((kid, c[1]))
                near[kid].append((me, c[1]))
        return me

    add(parse_newick(newick))
    return near, names


def _distances(near: dict, start: int) -> dict[int, tuple[float, int]]:
    """(distance, node before) of every node from ``start``."""
    found, todo = {start: (0.0, -1)}, [start]
    for n in todo:
        for k, w in near[n]:
            if k not in found:
                found[k] = (found[n][0] + w, n)
                todo.append(k)
    return found


def rerooted(newick: str, leaf: str | None = None) -> str | None:
    """The tree with its root at a leaf, or at the middle of the path of its farthest leaf pair (least names on ties); None where there is no such leaf."""
    near, names = _graph(newick)

    def text(n: int, before: int, length: float) -> str:
        kids = [(k, w) for k, w in near[n] if k != before]
        if not kids:
            return f"{names[n]}:{length:.6f}"
        if len(kids) == 1:  # a former root with two branches is no node
            return text(kids[0][0], n, length + kids[0][1])
        return "(" + ",".join(text(k, n, w) for k, w in kids) + f"):{length:.6f}"

    def at(u: int, v: int, w: float, from_u: float) -> str:
        return f"({text(u, v, from_u)},{text(v, u, w - from_u)});"

    if leaf is not None:
        here = next((n for n, name in names.items() if name == leaf), None)
        return None if here is None or not near[here] else at(here, *near[here][0], 0.0)
    far = {n: _distances(near, n) for n in names}
    pairs = [(-round(far[a][b][0], 9), *sorted((names[a], names[b])), a, b) for a in names for b in names if names[a] < names[b]]
    if not pairs:
        return None
    *_, a, b = min(pairs)
    half, path = far[a][b][0] / 2, [b]
    while path[-1] != a:
        path.append(far[a][path[-1]][1])
    for v, u in zip(path, path[1:], strict=False):  # from b back to a: u is nearer to a
        if far[a][u][0] <= half + 1e-12:
            return at(u, v, far[a][v][0] - far[a][u][0], half - far[a][u][0])
    return None


def root_trees(trees_: DataFrame, members: DataFrame, method: str = "midpoint", strain: str | None = None) -> DataFrame:
    """P10: (family, newick) rooted at the 'midpoint' of the farthest leaf pair, at the leaf of a 'strain', or at the 'longest' member.

    ``members`` has family, member, strain, length. Of several leaves of the
    strain the one farthest from the root is taken, of equal ones the last
    name. Trees that have no such leaf are left out.
    """

    @F.pandas_udf("string")
    def rooted(newick: pd.Series, names: pd.Series, strains: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for t, n, s, size in zip(newick, names, strains, lengths, strict=True):
            near, leaf_names = _graph(t)
            depth = {leaf_names[k]: v[0] for k, v in _distances(near, 0).items() if k in leaf_names}
            if method == "midpoint":
                out.append(rerooted(t))
                continue
            if method == "strain":
                best = max(((round(depth[m], 9), m) for m, x in zip(n, s, strict=True) if x == strain and m in depth), default=None)
            else:
                best = max(((x, m) for m, x in zip(n, size, strict=True) if m in depth), default=None)
            out.append(rerooted(t, best[1]) if best else None)
        return pd.Series(out, dtype=object)

    rows = members.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("member", "strain", "length"))).alias("m"))
    j = trees_.join(rows, "family").select("family", rooted("newick", F.col("m.member"), F.col("m.strain"), F.col("m.length")).alias("newick"))
    return j.where("newick IS NOT NULL")


def parse_newick(text: str):
    """Nested (label or list of children, length)."""
    at = 0

    def node():
        nonlocal at
        children = []
        if text[at] == "(":
            while text[at] in "(,":
                at += 1
                children.append(node())
            at += 1
        begin = at
        while at < len(text) and text[at] not in ",():;":
            at += 1
        label, length = text[begin:at], 0.0
        if at < len(text) and text[at] == ":":
            begin = at = at + 1
            while at < len(text) and text[at] not in ",();":
                at += 1
            length = float(text[begin:at])
        return (children or label, length)

    return node()


def leaves(tree) -> list[str]:
    return [tree[0]] if isinstance(tree[0], str) else [x for c in tree[0] for x in leaves(c)]


def splits(newick: str) -> list[str]:
    """Each inner branch as the sorted leaves of the side without the least leaf."""
    tree = parse_newick(newick)
    every = frozenset(leaves(tree))
    found = set()

    def walk(t) -> None:
        if isinstance(t[0], str):
            return
        side = frozenset(leaves(t))
        if 1 < len(side) < len(every) - 1:
            found.add(",".join(sorted(every - side if min(every) in side else side)))
        for c in t[0]:
            walk(c)

    walk(tree)
    return sorted(found)


#: Replicates of a family that one task works out.
REPLICATE_BLOCK = 250


class SitePatterns:
    """An alignment as its distinct columns: for each pair of members, which columns both have, and which are transitions or transversions."""

    def __init__(self, rows: list[str]):
        sites = np.stack([np.frombuffer(r.upper().encode(), np.uint8) for r in rows])
        patterns, self.of_site = np.unique(sites, axis=1, return_inverse=True)
        self.of_site = self.of_site.ravel()
        self.size = patterns.shape[1]
        self.first, self.second = np.tril_indices(len(rows), -1)
        x, y = patterns[self.first], patterns[self.second]
        known = np.isin(x, (65, 67, 71, 84)) & np.isin(y, (65, 67, 71, 84))
        same_ring = np.isin(x, (65, 71)) == np.isin(y, (65, 71))
        self.both = known.astype(np.float64)
        self.transitions = (known & (x != y) & same_ring).astype(np.float64)
        self.transversions = (known & (x != y) & ~same_ring).astype(np.float64)

    def distances(self, weights: np.ndarray, model: str) -> np.ndarray:
        """(replicates, pairs): distances of columns counted ``weights`` times; 1 where they are not defined."""
        n, ts, tv = (weights @ m.T for m in (self.both, self.transitions, self.transversions))
        d = _by_model(n, ts, tv, model)
        return np.where(np.isnan(d), 1.0, d)


def tree_sides(d: np.ndarray) -> np.ndarray:
    """(trees, n - 2): the inner branches of the neighbour-joining trees of ``d``, as bits of the leaves on the side without leaf 0; 0 where there is none or it stands twice. n < 64."""
    b, n, _ = d.shape
    each, every = np.arange(b), (1 << n) - 1
    bits = np.tile(1 << np.arange(n, dtype=np.int64), (b, 1))
    found = []
    for i, j, keep, _, _ in joins(d):
        side = bits[each, i] | bits[each, j]
        bits = np.column_stack([bits[each[:, None], keep], side])
        side = np.where(side & 1, every ^ side, side)
        found.append(np.where(side & (side - 1) == 0, 0, side))  # one leaf is no inner branch, nor is all but leaf 0 ...
    sides = np.sort(np.stack(found, axis=1), axis=1)
    sides[sides == every ^ 1] = 0  # ... whose other side is leaf 0 alone
    sides[:, 1:][sides[:, 1:] == sides[:, :-1]] = 0
    return sides


_U32, _U64 = np.uint32, np.uint64


def _times(a: tuple[np.ndarray, np.ndarray], b: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Product of 128-bit numbers (high, low)."""
    low32 = _U64(0xFFFFFFFF)
    x0, x1, y0, y1 = a[1] & low32, a[1] >> _U64(32), _U64(b[1] & 0xFFFFFFFF), _U64(b[1] >> 32)
    cross = (x0 * y0 >> _U64(32)) + (x1 * y0 & low32) + x0 * y1
    return x1 * y1 + (x1 * y0 >> _U64(32)) + (cross >> _U64(32)) + a[0] * _U64(b[1]) + a[1] * _U64(b[0]), a[1] * _U64(b[1])


def _plus(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    low = a[1] + b[1]
    return a[0] + b[0] + (low < a[1]), low


def draws(seed: int, reps: np.ndarray, family: int, n: int) -> np.ndarray:
    """(replicates, n): ``default_rng([seed, rep, family]).integers(0, n, n)`` of each replicate, worked out together: making a generator costs more than a tree."""
    plain = lambda rep: np.random.default_rng([seed, int(rep), family]).integers(0, n, n)
    if n < 2 or n >= 1 << 32 or not 0 <= seed < 1 << 32:
        return np.stack([plain(r) for r in reps])
    mult = 0x43B0D7E5

    def hashed(x: np.ndarray, factor: int = 0x931E8875) -> np.ndarray:
        nonlocal mult
        x = x ^ _U32(mult)
        mult = mult * factor & 0xFFFFFFFF
        x = x * _U32(mult)
        return x ^ (x >> _U32(16))

    words = np.zeros((4, len(reps)), dtype=_U32)
    words[0], words[1], words[2] = seed, reps, family
    pool = [hashed(w) for w in words]
    for source in range(4):
        for target in range(4):
            if source != target:
                mixed = _U32(0xCA01F9DD) * pool[target] - _U32(0x4973F715) * hashed(pool[source])
                pool[target] = mixed ^ (mixed >> _U32(16))
    mult = 0x8B51F9DD
    state = [hashed(pool[k % 4], 0x58F38DED).astype(_U64) for k in range(8)]
    a, b, c, e = (state[k] | (state[k + 1] << _U64(32)) for k in (0, 2, 4, 6))
    step, factor = ((c << _U64(1)) | (e >> _U64(63)), (e << _U64(1)) | _U64(1)), (2549297995355413924, 4865540595714422341)
    at = _plus(_times(_plus(step, (a, b)), factor), step)
    out = np.empty((len(reps), n + n % 2), dtype=_U64)
    for k in range(0, n, 2):
        at = _plus(_times(at, factor), step)
        x, turn = at[0] ^ at[1], at[0] >> _U64(58)
        x = (x >> turn) | (x << ((_U64(64) - turn) & _U64(63)))
        out[:, k], out[:, k + 1] = x & _U64(0xFFFFFFFF), x >> _U64(32)
    scaled = out[:, :n] * _U64(n)
    picks = (scaled >> _U64(32)).astype(np.int64)
    for r in np.flatnonzero(((scaled & _U64(0xFFFFFFFF)) < _U64(n)).any(axis=1)):  # a draw that may be thrown again
        picks[r] = plain(reps[r])
    return picks


def bootstrap_support(aligned: DataFrame, replicates: int = 100, seed: int = 1, model: str = "uncorrected") -> DataFrame:
    """(family, split, support): percent of replicates, by resampled columns, whose tree has the split.

    A replicate is a count for each distinct column, so an alignment is sent
    once for REPLICATE_BLOCK replicates and all their distances are three
    products of matrices. The resampling is seeded by family and replicate, so
    a lost task gives the same trees again.
    """
    import zlib

    def counted(held: list[tuple]) -> Iterator[tuple]:
        """(family, split, n) of (family, names, distances of replicates) of one number of members."""
        sides = tree_sides(np.concatenate([d for _, _, d in held]))
        at = 0
        for family, names, d in held:
            found, times = np.unique(sides[at : at + len(d)], return_counts=True)
            at += len(d)
            for side, n in zip(found.tolist(), times.tolist(), strict=True):
                if side:
                    yield family, ",".join(m for k, m in enumerate(names) if side >> k & 1), n

    def plain(family, names: list[str], d: np.ndarray) -> list[tuple]:
        """The same for names that repeat or are too many for one number."""
        found: dict[str, int] = {}
        for one in d:
            for split in splits(build_tree(names, one)):
                found[split] = found.get(split, 0) + 1
        return [(family, s, n) for s, n in found.items()]

    def rule(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = lambda rows: pd.DataFrame(rows, columns=["family", "split", "n"])
        waiting: dict[int, list[tuple]] = {}
        for pdf in _runs(batches, ["family", "block"]):
            family, block = pdf["family"].iloc[0], int(pdf["block"].iloc[0])
            names, rows = pdf["member"].tolist(), pdf["seq"].tolist()
            n, columns = len(names), len(rows[0])
            if n < 4 or not columns:
                continue
            made = SitePatterns(rows)
            last = min((block + 1) * REPLICATE_BLOCK, replicates)
            step = max(1, CELLS // n**2)
            for first in range(block * REPLICATE_BLOCK + 1, last + 1, step):
                reps = np.arange(first, min(first + step - 1, last) + 1)
                picks = made.of_site[draws(seed, reps, zlib.crc32(str(family).encode()), columns)]
                weights = np.bincount((picks + np.arange(len(reps))[:, None] * made.size).ravel(), minlength=len(reps) * made.size)
                d = np.zeros((len(reps), n, n))
                d[:, made.first, made.second] = d[:, made.second, made.first] = made.distances(weights.reshape(len(reps), made.size).astype(np.float64), model)
                if n > 63 or len(set(names)) < n:
                    yield table(plain(family, names, d))
                    continue
                held = waiting.setdefault(n, [])
                held.append((family, names, d))
                if sum(x.size for _, _, x in held) >= CELLS:
                    yield table(list(counted(waiting.pop(n))))
        for held in waiting.values():
            yield table(list(counted(held)))

    kind = aligned.schema["family"].dataType.simpleString()
    blocks = aligned.where("family IS NOT NULL").select("family", "member", "seq", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // REPLICATE_BLOCK))).alias("block"))
    # a given number of partitions: these rows are few bytes and much work, and would be dealt to few tasks by size
    tasks = int(aligned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.repartition(tasks, "family", "block").sortWithinPartitions("family", "block", "member")
    found = rows.mapInPandas(rule, f"family {kind}, split string, n long")
    return found.groupBy("family", "split").agg((100 * F.sum("n") / replicates).alias("support"))


def filter_support(trees_: DataFrame, support: DataFrame, cutoff: float) -> DataFrame:
    """Trees whose every split has the support; families without splits stay."""

    @F.pandas_udf("array<string>")
    def of(newick: pd.Series) -> pd.Series:
        return pd.Series([splits(t) for t in newick], dtype=object)

    need = trees_.select("family", F.explode(of("newick")).alias("split")).join(support, ["family", "split"], "left")
    weak = need.where(F.coalesce("support", F.lit(0.0)) < cutoff).select("family").distinct()
    return trees_.join(weak, "family", "left_anti")


def canonical(newick: str, label: dict[str, str], cutoffs: tuple[float, ...]) -> str:
    """Strain-labelled text with branch lengths as bins and children in sorted order."""

    def text(t) -> str:
        bin_ = sum(t[1] >= c for c in cutoffs)
        own = label.get(t[0], t[0]) if isinstance(t[0], str) else "(" + ",".join(sorted(text(c) for c in t[0])) + ")"
        return f"{own}:{bin_}"

    return text(parse_newick(newick))


def topologies(trees_: DataFrame, members: DataFrame, cutoffs: tuple[float, ...] = (0.05,)) -> DataFrame:
    """``trees_`` with ``topology`` in place of the tree: its canonical text."""

    @F.pandas_udf("string")
    def shape(newick: pd.Series, names: pd.Series, strains: pd.Series) -> pd.Series:
        return pd.Series([canonical(t, dict(zip(n, s, strict=True)), cutoffs) for t, n, s in zip(newick, names, strains, strict=True)], dtype=object)

    labels = members.groupBy("family").agg(F.collect_list(F.struct("member", "strain")).alias("m"))
    own = [c for c in trees_.columns if c != "newick"]
    return trees_.join(labels, "family").select(*own, shape("newick", F.col("m.member"), F.col("m.strain")).alias("topology"))


def topotypes(trees_: DataFrame, members: DataFrame, cutoffs: tuple[float, ...] = (0.05,)) -> DataFrame:
    """(family, topology, topotype, families): topologies numbered by how many families have them, ties by text."""
    shaped = materialize(topologies(trees_, members, cutoffs))  # read for the counts and for the rows
    n = shaped.groupBy("topology").agg(F.count("*").alias("families"))
    ranked = numbered(n, [F.col("families").desc(), F.col("topology")], "topotype")
    return shaped.join(ranked, "topology").select("family", "topology", "topotype", "families")


def topology_counts(topotypes_: DataFrame, methods: list[str]) -> DataFrame:
    """(topology, a column a method): how many families have the topology by each method."""
    return topotypes_.groupBy("topology").pivot("method", methods).agg(F.count("topology")).fillna(0, subset=methods)


def topology_table(topotypes_: DataFrame, methods: list[str]) -> DataFrame:
    """(family, a column a method) with the topology, NA where absent; input has family, method, topology."""
    wide = topotypes_.groupBy("family").pivot("method", methods).agg(F.min("topology"))
    return wide.fillna("NA", subset=methods)


def allele_parent(trees_: DataFrame, members: DataFrame, parents: list[str], target: str, overlaps: DataFrame | None = None, min_length: int = 0, min_identity: float = 0) -> DataFrame:
    """(family, member, parent): target leaves whose sister clade holds exactly one leaf of a parental strain.

    With ``overlaps`` (the result of ``member_overlaps``) the two leaves must
    overlap by the length and identity given.
    """

    @F.pandas_udf("array<struct<member:string,parent:string,leaf:string>>")
    def assign(newick: pd.Series, names: pd.Series, strains: pd.Series) -> pd.Series:
        out = []
        for t, n, s in zip(newick, names, strains, strict=True):
            strain, rows = dict(zip(n, s, strict=True)), []

            def walk(node, strain=strain, rows=rows) -> None:
                if isinstance(node[0], str):
                    return
                for c in node[0]:
                    if isinstance(c[0], str) and strain.get(c[0]) == target:
                        kin = [x for o in node[0] if o is not c for x in leaves(o) if strain.get(x) in parents]
                        if len(kin) == 1:
                            rows.append({"member": c[0], "parent": strain[kin[0]], "leaf": kin[0]})
                    walk(c)

            walk(parse_newick(t))
            out.append(rows)
        return pd.Series(out, dtype=object)

    labels = members.groupBy("family").agg(F.collect_list(F.struct("member", "strain")).alias("m"))
    found = trees_.join(labels, "family").select("family", F.explode(assign("newick", F.col("m.member"), F.col("m.strain"))).alias("x"))
    found = found.select("family", "x.*")
    if overlaps is not None:
        kept = overlaps.where((F.col("length") >= min_length) & (F.col("identity") >= min_identity)).select("family", "a", "b")
        found = found.withColumns({"a": F.least("member", "leaf"), "b": F.greatest("member", "leaf")}).join(kept, ["family", "a", "b"], "left_semi")
    return found.select("family", "member", "parent")


def omega_bands(rows: DataFrame, cuts: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """(cutoff, pairs): sequence pairs (omega) at or under each cut-off; 99 is undefined and counts nowhere."""
    known = rows.where("omega <> 99")
    band = F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), (F.col("omega") <= c).alias("in")) for c in cuts])
    return known.select(F.explode(band).alias("b")).groupBy("b.cutoff").agg(F.count_if("b.in").alias("pairs"))


#: Selection classes, each with the omega that it lies above, from the highest.
SELECTION = (
    ("STRONG POSITIVE SELECTION", 1.5),
    ("POSITIVE SELECTION", 1.2),
    ("CLOSE NEUTRALITY", 1.0),
    ("NEUTRALITY", None),
    ("CLOSE NEUTRALITY", 0.8),
    ("NEGATIVE SELECTION", 0.5),
    ("STRONG NEGATIVE SELECTION", 0.0),
)
SAME_CDS, SAME_PROTEIN = "NA (SAME CDS SEQUENCE)", "NA (SAME PROTEIN, DIFFERENT CDS SEQUENCE)"


def selection_classes(rows: DataFrame) -> DataFrame:
    """Rows (contig, a, b, omega) with ``selection``: 99 is the same coding sequence, 0 the same protein, 1 neutral; a bound belongs to the class under it."""
    out = F.when(F.col("omega") == 99, SAME_CDS).when(F.col("omega") == 0, SAME_PROTEIN).when(F.col("omega") == 1, "NEUTRALITY")
    for name, low in SELECTION:
        out = out if low is None else out.when(F.col("omega") > low, name)
    return rows.withColumn("selection", out)


def pairs_by_contig(rows: DataFrame) -> DataFrame:
    """(contig, pairs, defined): sequence pairs of each contig, and those with an omega other than 99; a pair counts once whatever its order."""
    named = rows.select("contig", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "omega")
    once = named.groupBy("contig", "a", "b").agg(F.min("omega").alias("omega"))
    return once.groupBy("contig").agg(F.count("*").alias("pairs"), F.count_if(F.col("omega") != 99).alias("defined"))
