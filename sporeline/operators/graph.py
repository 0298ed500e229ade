"""Similarity graphs: neighbour lists, connected components, and rules on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeline.functions.numbering import numbered
from sporeline.functions.storage import discard, materialize
from sporeline.operators.forests import nearest_greater, roots_of, rooted, spanning_forest, subtree_least


#: Neighbours in one row of a neighbour list.
LIST_PART = 10_000


def adjacency(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight", order: str = "line_no", size: int = LIST_PART) -> DataFrame:
    """G1: (node, part, degree, neighbours): symmetric neighbour lists by name; of repeated edges the last weight wins.

    A list is cut into parts 0, 1, ... of ``size`` neighbours, which are told
    apart by a sort by range, so a hub's list is in no single row or task.
    """
    both = edges.select(F.col(src).alias("node"), F.col(dst).alias("other"), weight, order).unionByName(
        edges.select(F.col(dst).alias("node"), F.col(src).alias("other"), weight, order)
    )
    last = both.where("node <> other").groupBy("node", "other").agg(F.max_by(weight, order).alias("weight"))
    placed = numbered(last, [F.col("node"), F.col("other")], "_n")
    per = placed.groupBy("node").agg(F.min("_n").alias("_low"), F.count("*").alias("degree"))
    parts = placed.join(per, "node").withColumn("part", F.expr(f"cast((_n - _low) div {size} as int)"))
    return parts.groupBy("node", "part", "degree").agg(F.sort_array(F.collect_list(F.struct("other", "weight"))).alias("neighbours"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that can be reached; ``nodes`` adds unlinked ones.

    In each round every node points to the least of itself and its neighbours,
    the pointers are followed to their ends, and edges are renamed by them;
    those inside one group go. Only nodes that are the least around them stay,
    and of two rounds one at least halves them, so the rounds grow with the
    logarithm of the nodes and later ones work on what is left only. Each is
    written to the shared folder, so a lost executor costs one round. A hub
    meets its neighbours through map-side minima and skew-split joins, never in
    one task.
    """
    current = materialize(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v"))
    rounds: list[DataFrame] = []
    while not current.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        pointers = current.unionByName(current.select("v", F.col("v").alias("u"))).groupBy("u").agg(F.min("v").alias("to"))
        to = _followed(materialize(pointers))
        rounds.append(to)
        named = current.join(to, "u").select("v", F.col("to").alias("a")).join(to.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        last, current = current, materialize(named.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        discard(last)
    discard(current)
    found = edges.select(F.col(src).alias("node"), F.col(src).alias("component")).limit(0)
    for k, to in enumerate(reversed(rounds)):
        later = found.select(F.col("node").alias("to"), F.col("component").alias("_end"))
        found = to.select(F.col("u").alias("node"), F.col("to").alias("component")) if k == 0 else to.join(later, "to", "left").select(F.col("u").alias("node"), F.coalesce("_end", "to").alias("component"))
    if nodes is None:
        return found
    name = nodes.columns[0]
    return nodes.select(F.col(name).alias("node")).distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _followed(pointers: DataFrame) -> DataFrame:
    """Pointers (u, to; to <= u, every ``to`` is a u) followed to nodes that point to themselves, twice as far in each step."""
    while True:
        moving = pointers.where("u <> to")
        onward = moving.select(F.col("u").alias("to"), F.col("to").alias("_next"))
        if moving.join(onward, "to", "left_semi").isEmpty():
            return pointers
        last, pointers = pointers, materialize(pointers.join(onward, "to", "left").select("u", F.coalesce("_next", "to").alias("to")))
        discard(last)


def _components_of(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``edges`` with the component of each row."""
    found = connected_components(edges, src=a, dst=b)
    return edges.join(found.select(F.col("node").alias(a), "component"), a)


#: Edges of a component that one task takes; larger components go by rounds of joins. The result does not hang on it.
ONE_TASK = 200_000


def _by_size(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of components of up to ``limit`` rows, and of larger ones where there are any."""
    rows = materialize(rows)
    large = materialize(rows.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("component"))
    if large.isEmpty():
        return rows, None
    return rows.join(large, "component", "left_anti"), rows.join(large, "component", "left_semi")


def _each_component(rows: DataFrame, columns: list[str], order: list[str], rule: Callable[[str, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """What ``rule`` gives for the name and the rows (``columns``, by ``order``) of each component.

    Spark brings a component together and sorts it; a task walks over its
    sorted rows and holds one component at a time, so many small components
    cost no call each.
    """
    import pandas as pd

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = (r for b in batches for r in zip(*(b[c].tolist() for c in ["component", *columns]), strict=True))
        out: list[tuple] = []
        for component, group in groupby(every, key=itemgetter(0)):
            out += rule(component, [r[1:] for r in group])
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    names = [part.split()[0] for part in schema.split(",")]
    return rows.repartition("component").sortWithinPartitions("component", *order).select("component", *columns).mapInPandas(walk, schema)


def _numbers(names: DataFrame) -> DataFrame:
    """(name, n): distinct names numbered in their order."""
    return materialize(numbered(names.distinct(), [F.col("name")], "n"))


def _ends(rows: DataFrame, numbers: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with the numbers of the names ``a`` and ``b`` as u < v."""
    j = rows.join(numbers.select(F.col("name").alias(a), F.col("n").alias("_a")), a).join(numbers.select(F.col("name").alias(b), F.col("n").alias("_b")), b)
    return j.withColumns({"u": F.least("_a", "_b"), "v": F.greatest("_a", "_b")}).drop("_a", "_b")


def star_clusters(hits: DataFrame, limit: int = ONE_TASK) -> DataFrame:
    """(cluster, member): queries in line order; each that is no member yet takes its subjects, which stop being seeds.

    ``cluster`` is the seed with prefix singlet_ or cluster_ by size. The rule
    never crosses a component, so it runs for each component apart.
    """
    def rule(_: str, pairs: list[tuple]) -> list[tuple]:
        subjects: dict[str, list[str]] = {}
        for query, subject in pairs:
            subjects.setdefault(query, []).append(subject)
        taken, rows = set(), []
        for query, others in subjects.items():
            if query in taken:
                continue
            members = list(dict.fromkeys([query, *(s for s in others if s not in taken)]))
            taken.update(members)
            name = f"{'singlet' if len(members) == 1 else 'cluster'}_{query}"
            rows += [(name, m) for m in members]
        return rows

    linked = hits.where("query_id <> subject_id")
    small, large = _by_size(_components_of(linked.select("query_id", "subject_id", "line_no"), "query_id", "subject_id"), limit)
    grouped = _each_component(small, ["query_id", "subject_id"], ["line_no", "query_id", "subject_id"], rule, "cluster string, member string")
    if large is not None:
        grouped = grouped.unionByName(_stars_by_rounds(large, limit))
    own = materialize(hits.where("query_id = subject_id").select("query_id").distinct())
    if own.isEmpty():
        return grouped
    own = own.join(linked.select("query_id").union(linked.select("subject_id")), "query_id", "left_anti")
    return grouped.unionByName(own.select(F.concat(F.lit("singlet_"), "query_id").alias("cluster"), F.col("query_id").alias("member")))


def _stars_by_rounds(rows: DataFrame, limit: int) -> DataFrame:
    """The clusters of ``star_clusters``: a query is a seed once every earlier query that has it as a subject is known to be none.

    In a round all queries that wait for no earlier one become seeds, and the
    queries that they take are out. What still waits when it is no more than
    ``limit`` links is settled in one task.
    """
    turn = rows.groupBy("query_id").agg(F.min("line_no").alias("line")).select("query_id", F.struct("line", F.col("query_id").alias("q")).alias("at"))
    turn = materialize(turn)
    links = materialize(rows.select("query_id", "subject_id").distinct().join(turn, "query_id"))
    later = turn.select(F.col("query_id").alias("subject_id"), F.col("at").alias("_at"))
    waits = materialize(links.join(later, "subject_id").where("at < _at").select("query_id", "subject_id"))
    waiting = materialize(turn.select("query_id"))
    seeds: list[DataFrame] = []
    while not waiting.isEmpty():
        if waits.count() <= limit:
            seeds.append(materialize(_settle(waiting.join(turn, "query_id"), waits)))
            break
        free = materialize(waiting.join(waits.select(F.col("subject_id").alias("query_id")), "query_id", "left_anti"))
        taken = waits.join(free, "query_id").select(F.col("subject_id").alias("query_id")).distinct()
        decided = materialize(free.unionByName(taken))
        left = materialize(waiting.join(decided, "query_id", "left_anti"))
        still = materialize(waits.join(decided, "query_id", "left_anti").join(decided.select(F.col("query_id").alias("subject_id")), "subject_id", "left_anti"))
        seeds.append(free)
        discard(waiting, waits, decided)
        waiting, waits = left, still
    every = seeds[0]
    for more in seeds[1:]:
        every = every.unionByName(more)
    others = links.join(every, "query_id").join(every.select(F.col("query_id").alias("subject_id")), "subject_id", "left_anti")
    homes = others.groupBy("subject_id").agg(F.min_by("query_id", "at").alias("seed")).select("seed", F.col("subject_id").alias("member"))
    members = materialize(homes.unionByName(every.select(F.col("query_id").alias("seed"), F.col("query_id").alias("member"))))
    sizes = members.groupBy("seed").agg(F.count("*").alias("n"))
    named = members.join(sizes, "seed").select(F.concat(F.when(F.col("n") == 1, "singlet_").otherwise("cluster_"), "seed").alias("cluster"), "member")
    discard(turn, links, waits, waiting, *seeds)
    return named


def _settle(waiting: DataFrame, waits: DataFrame) -> DataFrame:
    """Seeds among the last waiting queries (query_id, at), in one task; queries that wait for nothing are seeds where they lie."""
    import pandas as pd

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        before: dict[str, list[str]] = {}
        for q, s in pdf[["query_id", "subject_id"]].itertuples(index=False):
            before.setdefault(s, []).append(q)
        order = {q: (line, q) for q, line in pdf[["query_id", "query_line"]].itertuples(index=False)} | {s: (line, s) for s, line in pdf[["subject_id", "subject_line"]].itertuples(index=False)}
        seeds: set[str] = set()
        for q in sorted(order, key=order.get):
            if not any(b in seeds for b in before.get(q, ())):
                seeds.add(q)
        return pd.DataFrame({"query_id": sorted(seeds)}, dtype=object)

    line = lambda c: waiting.select(F.col("query_id").alias(f"{c}_id"), F.col("at.line").alias(f"{c}_line"))
    ends = waits.select("query_id").unionByName(waits.select(F.col("subject_id").alias("query_id")))
    alone = waiting.select("query_id").join(ends, "query_id", "left_anti")
    rest = waits.join(line("query"), "query_id").join(line("subject"), "subject_id")
    return alone.unionByName(rest.groupBy(F.lit(0).alias("_all")).applyInPandas(rule, "query_id string"))


def greedy_clusters(hits: DataFrame, max_members: int | None = None, limit: int = ONE_TASK) -> DataFrame:
    """(cluster, member, size): in line order a subject joins its query's cluster while that is below ``max_members``, else opens its own.

    Clusters are named cluster_1, cluster_2, ... by size, largest first, ties by least member.
    """
    def rule(_: str, pairs: list[tuple]) -> list[tuple]:
        of, size = {}, {}
        for query, subject in pairs:
            if query not in of:
                of[query], size[query] = query, 1
            home = of[query]
            if subject not in of:
                if max_members is None or size[home] < max_members:
                    of[subject] = home
                    size[home] += 1
                else:
                    of[subject], size[subject] = subject, 1
        return [(seed, member) for member, seed in of.items()]

    small, large = _by_size(_components_of(hits.select("query_id", "subject_id", "line_no"), "query_id", "subject_id"), limit)
    found = _each_component(small, ["query_id", "subject_id"], ["line_no", "query_id", "subject_id"], rule, "seed string, member string")
    found = materialize(found if large is None else found.unionByName(_greedy_by_rounds(large, max_members, limit)))
    sizes = found.groupBy("seed").agg(F.count("*").alias("size"), F.min("member").alias("least"))
    return found.join(_numbered(sizes, ["size", "least"], "cluster_"), "seed").select("cluster", "member", "size")


def _greedy_by_rounds(rows: DataFrame, max_members: int | None, limit: int) -> DataFrame:
    """(seed, member) of ``greedy_clusters``: nodes point to the query of the line that they first stand in, queries of such a line to themselves.

    A tree's first ``max_members`` nodes in line order are its root's cluster,
    for a node's parent always comes before it. Of the others, those whose
    parent is in the cluster are roots of what is left; so every tree gives a
    cluster in each round. The last ``limit`` nodes are settled in one task.
    """
    import pandas as pd

    def rest_of(pdf: pd.DataFrame) -> pd.DataFrame:
        of, size = {}, {}
        for node, to in pdf.sort_values(["line", "role", "node"])[["node", "to"]].itertuples(index=False):
            home = of.get(to, node)
            if home == node or size[home] >= max_members:
                home = node
            of[node] = home
            size[home] = size.get(home, 0) + 1
        return pd.DataFrame({"seed": list(of.values()), "member": list(of.keys())}, dtype=object)

    asks = rows.select(F.col("query_id").alias("node"), F.struct(F.col("line_no").alias("line"), F.lit(0).alias("role"), F.col("query_id").alias("to")).alias("x"))
    meets = rows.select(F.col("subject_id").alias("node"), F.struct(F.col("line_no").alias("line"), F.lit(1).alias("role"), F.col("query_id").alias("to")).alias("x"))
    trees = materialize(asks.unionByName(meets).groupBy("node").agg(F.min("x").alias("x")).select("node", "x.to", "x.line", "x.role"))
    out: list[DataFrame] = []
    while not trees.isEmpty():
        if max_members is not None and trees.count() <= limit:
            out.append(materialize(trees.groupBy(F.lit(0).alias("_all")).applyInPandas(rest_of, "seed string, member string")))
            break
        homes = roots_of(trees.select("node", "to"))
        if max_members is None:
            out.append(materialize(homes.select(F.col("root").alias("seed"), F.col("node").alias("member"))))
            discard(homes)
            break
        ordered = materialize(numbered(trees.join(homes.select("node", "root"), "node"), [F.col(c) for c in ("root", "line", "role", "node")], "_n"))
        starts = ordered.groupBy("root").agg(F.min("_n").alias("_low"))
        placed = materialize(ordered.join(starts, "root").withColumn("_in", F.col("_n") - F.col("_low") < max_members))
        inside = materialize(placed.where("_in").select(F.col("root").alias("seed"), F.col("node").alias("member")))
        out.append(inside)
        parents = inside.select(F.col("member").alias("to"), F.lit(True).alias("_cut"))
        left = placed.where("NOT _in").join(parents, "to", "left").select("node", F.when(F.col("_cut"), F.col("node")).otherwise(F.col("to")).alias("to"), "line", "role")
        last, trees = trees, materialize(left)
        discard(last, homes, ordered, placed)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def _numbered(groups: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """``groups`` with a name by rank, largest first."""
    ranked = numbered(groups, [F.col(by[0]).desc(), *[F.col(c) for c in by[1:]]], "_rank")
    return ranked.withColumn("cluster", F.concat(F.lit(prefix), "_rank")).drop("_rank")


def cluster_sizes(members: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """(cluster_id, size) within [least, most]."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return sizes if most is None else sizes.where(F.col("size") <= most)


def size_histogram(members: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, smallest, largest, clusters): cluster sizes in equal bins up to the largest."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    top = sizes.agg(F.max("n").alias("m"))  # one row
    binned = sizes.crossJoin(F.broadcast(top)).withColumn("bin", F.expr(f"cast(least((n * {bins}) div (m + 1), {bins - 1}) as int)"))
    return binned.groupBy("bin").agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count("*").alias("clusters"))


def articulation_points(edges: DataFrame, limit: int = ONE_TASK) -> DataFrame:
    """(component, node): nodes whose loss parts their component."""
    def rule(component: str, pairs: list[tuple]) -> list[tuple]:
        near: dict[str, list[str]] = {}
        for a, b in pairs:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        order, low, cut = {}, {}, set()
        root = min(near)
        order[root] = low[root] = 0
        path, branches = [(root, None, iter(near[root]))], 0
        while path:
            node, parent, rest = path[-1]
            child = next(rest, None)
            if child is None:
                path.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    if parent != root and low[node] >= order[parent]:
                        cut.add(parent)
            elif child not in order:
                order[child] = low[child] = len(order)
                branches += node == root
                path.append((child, node, iter(near[child])))
            elif child != parent:
                low[node] = min(low[node], order[child])
        if branches > 1:
            cut.add(root)
        return [(component, n) for n in sorted(cut)]

    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    small, large = _by_size(_components_of(pairs, "src", "dst"), limit)
    found = _each_component(small, ["src", "dst"], ["src", "dst"], rule, "component string, node string")
    return found if large is None else found.unionByName(_articulation_by_rounds(large))


def _articulation_by_rounds(pairs: DataFrame) -> DataFrame:
    """(component, node) of pairs (component, src, dst), by the blocks of any spanning forest (Tarjan and Vishkin).

    Tree edges, named by their lower node, are of one block when an edge
    outside the tree closes a ring over both: when it links nodes neither of
    which lies above the other, or leads out of the subtree of a node's parent.
    A node is an articulation point when its tree edges are of several blocks.
    """
    numbers = _numbers(pairs.select(F.col("src").alias("name")).unionByName(pairs.select(F.col("dst").alias("name"))))
    all_edges = materialize(_ends(pairs, numbers, "src", "dst").select("u", "v"))
    forest = materialize(spanning_forest(all_edges.withColumn("key", F.struct("u", "v"))).select("u", "v"))
    roots = connected_components(forest, src="u", dst="v").select(F.col("component").alias("root")).distinct()
    nodes = materialize(rooted(forest, materialize(roots)).select("node", "parent", "root", "spot", "size"))
    at = lambda c: nodes.select(F.col("node").alias(c), F.col("spot").alias(f"{c}_spot"), F.col("size").alias(f"{c}_size"))
    others = materialize(all_edges.join(forest, ["u", "v"], "left_anti").join(at("u"), "u").join(at("v"), "v"))
    reach = others.select(F.col("u").alias("node"), F.col("v_spot").alias("to")).unionByName(others.select(F.col("v").alias("node"), F.col("u_spot").alias("to"))).unionByName(nodes.select("node", F.col("spot").alias("to")))
    reach = materialize(reach.groupBy("node").agg(F.min("to").alias("low"), (-F.max("to")).alias("high")))
    low, high = (subtree_least(nodes, reach.select("node", F.col(c).alias("value"))).withColumnRenamed("least", c) for c in ("low", "high"))
    first = F.when(F.col("u_spot") < F.col("v_spot"), F.col("u_spot") + F.col("u_size") <= F.col("v_spot")).otherwise(F.col("v_spot") + F.col("v_size") <= F.col("u_spot"))
    rings = others.where(first).select("u", "v")
    top = at("parent").join(nodes.where("parent IS NOT NULL").select(F.col("node").alias("parent")), "parent")
    inner = nodes.join(top, "parent").join(low, "node").join(high, "node")
    leads = inner.where((F.col("low") < F.col("parent_spot")) | (-F.col("high") >= F.col("parent_spot") + F.col("parent_size"))).select(F.col("node").alias("u"), F.col("parent").alias("v"))
    lower = nodes.where("parent IS NOT NULL").select("node")
    blocks = materialize(connected_components(rings.unionByName(leads), nodes=lower, src="u", dst="v"))
    touching = blocks.select("node", "component").unionByName(nodes.where("parent IS NOT NULL").join(blocks, "node").select(F.col("parent").alias("node"), "component"))
    cut = touching.groupBy("node").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("node")
    name = lambda c: numbers.select(F.col("n").alias(c), F.col("name").alias(f"{c}_name"))
    out = materialize(nodes.join(cut, "node").select("node", "root").join(name("node"), "node").join(name("root"), "root").select(F.col("root_name").alias("component"), F.col("node_name").alias("node")))
    discard(numbers, all_edges, forest, nodes, others, reach, blocks)
    return out


def assembly_order(edges: DataFrame, limit: int = ONE_TASK) -> DataFrame:
    """(component, node, joined_to, weight, place): maximum spanning tree grown from the heaviest edge.

    Of equally heavy edges the one of the lesser lower end, then the lesser
    higher end, is taken; of repeated edges the heaviest counts. The walk
    begins at the lower end of the first edge, which has no ``joined_to``.
    """
    import heapq

    def rule(component: str, pairs: list[tuple]) -> list[tuple]:
        near: dict[str, list] = {}
        for a, b, w in pairs:
            near.setdefault(a, []).append((-w, a, b, b))
            near.setdefault(b, []).append((-w, a, b, a))
        root = min(x for row in near.values() for x in row)[1]
        rows, seen, heap = [(root, None, None)], {root}, list(near[root])
        heapq.heapify(heap)
        while heap:
            w, a, b, new = heapq.heappop(heap)
            if new in seen:
                continue
            seen.add(new)
            rows.append((new, a if new == b else b, float(-w)))
            for x in near[new]:
                heapq.heappush(heap, x)
        return [(component, *row, place) for place, row in enumerate(rows)]

    best = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
    small, large = _by_size(_components_of(best, "src", "dst"), limit)
    found = _each_component(small, ["src", "dst", "weight"], ["src", "dst"], rule, "component string, node string, joined_to string, weight double, place long")
    return found if large is None else found.unionByName(_order_by_rounds(large))


def _order_by_rounds(edges: DataFrame) -> DataFrame:
    """The order of ``assembly_order`` for edges (component, src, dst, weight), without a queue.

    A node is joined along the edge to its parent in the tree, whose key is
    the edge's rank. The walk leaves a part that it has entered by an edge only
    when the part's own edges are used up, so a node comes after the nearest
    node above it that was joined by a later edge, as its child, by key: the
    walk is that other tree's, children in the order of keys.
    """
    numbers = _numbers(edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))))
    keyed = materialize(numbered(_ends(edges, numbers, "src", "dst").select("u", "v", "weight"), [F.col("weight").desc(), F.col("u"), F.col("v")], "key"))
    forest = materialize(spanning_forest(keyed))
    parts = materialize(connected_components(forest, src="u", dst="v"))
    roots = materialize(forest.join(parts.withColumnRenamed("node", "u"), "u").groupBy("component").agg(F.min_by("u", "key").alias("root")))
    nodes = rooted(forest, roots.select("root")).withColumns({"u": F.least("node", "parent"), "v": F.greatest("node", "parent")})
    nodes = materialize(nodes.join(forest, ["u", "v"], "left").select("node", "parent", F.when(F.col("parent").isNull(), 2**62).otherwise(F.col("key")).alias("key")))
    above = nearest_greater(nodes)
    order = above.join(nodes.select("node", "key"), "node").select(F.col("above").alias("u"), F.col("node").alias("v"), "key")
    places = rooted(materialize(order), roots.select("root"), order="key").select("node", "place")
    name = lambda c: numbers.select(F.col("n").alias(c), F.col("name").alias(f"{c}_name"))
    j = nodes.join(places, "node").join(parts, "node").join(keyed.select("key", "weight"), "key", "left")
    j = j.join(name("node"), "node").join(name("component"), "component").join(name("parent"), "parent", "left")
    out = materialize(j.select(F.col("component_name").alias("component"), F.col("node_name").alias("node"), F.col("parent_name").alias("joined_to"), "weight", "place"))
    discard(numbers, keyed, forest, parts, roots, nodes, above)
    return out


def relabel_clusters(clusters: DataFrame, mapping: DataFrame) -> DataFrame:
    """Clusters under their new names; a cluster without one fails the job. ``mapping`` has old, new."""
    j = clusters.join(mapping.select(F.col("old").alias("cluster_id"), "new"), "cluster_id", "left")
    checked = F.when(F.col("new").isNotNull(), F.col("new")).otherwise(F.raise_error(F.concat(F.lit("no new name for cluster "), F.col("cluster_id").cast("string"))))
    return j.select(checked.alias("cluster_id"), *[c for c in clusters.columns if c != "cluster_id"])


def threshold_clusters(pairs: DataFrame, ids: DataFrame, cutoff: float, likelihood: DataFrame | None = None) -> DataFrame:
    """(id, cluster, likelihood): groups of pairs (a, b, distance) within the cutoff as CL-1, CL-2, ... by least id, the rest as SG-1, SG-2, ... by id.

    ``likelihood`` has id, likelihood; null where it has none.
    """
    found = connected_components(pairs.where(F.col("distance") <= cutoff), src="a", dst="b")
    j = materialize(ids.select("id").distinct().join(found.withColumnRenamed("node", "id"), "id", "left"))
    groups = numbered(j.where("component IS NOT NULL").select("component").distinct(), [F.col("component")])
    grouped = j.join(groups, "component").select("id", F.concat(F.lit("CL-"), "n").alias("cluster"))
    single = numbered(j.where("component IS NULL").select("id"), [F.col("id")]).select("id", F.concat(F.lit("SG-"), "n").alias("cluster"))
    out = grouped.unionByName(single)
    return out.withColumn("likelihood", F.lit(None).cast("double")) if likelihood is None else out.join(likelihood.select("id", "likelihood"), "id", "left")


def family_members(families: DataFrame, protein_to_gene: DataFrame) -> DataFrame:
    """(family, gene, taxon, n_members, n_taxa) from 'protein(taxon) ...' lists, without proteins that have no gene."""
    each = families.select("family", F.explode(F.split("members", r"\s+")).alias("m"))
    each = each.select("family", F.regexp_extract("m", r"^(.*)\((.*)\)$", 1).alias("protein"), F.regexp_extract("m", r"^(.*)\((.*)\)$", 2).alias("taxon"))
    kept = each.join(protein_to_gene, "protein").select("family", "gene", "taxon")
    counts = kept.groupBy("family").agg(F.count("*").alias("n_members"), F.countDistinct("taxon").alias("n_taxa"))
    return kept.join(counts, "family")


def family_track(members: DataFrame, features: DataFrame, species: str, large: int = 20) -> DataFrame:
    """For each located member of a species one row per other member of its family, or one 'large family' row."""
    sizes = members.groupBy("family").agg(F.count("*").alias("n"))
    here = members.where(F.col("species") == species).join(features, "gene").join(sizes, "family").select("family", "gene", "ref", "start", "end", "n")
    few = here.where(F.col("n") <= large).drop("n")
    others = members.select("family", F.col("gene").alias("member"), "species")
    rows = few.join(others, "family").where("member <> gene").select("ref", "start", "end", "gene", "family", "member", "species")
    big = here.where(F.col("n") > large).select("ref", "start", "end", "gene", "family", F.lit(None).cast("string").alias("member"), F.lit("large family").alias("species"))
    return rows.unionByName(big)


def supported_orthologs(lines: DataFrame, least: int = 60) -> DataFrame:
    """(family, gene, ortholog, bootstrap) from lines (file, line_no, gene or null, ortholog, bootstrap): a gene line heads the lines below it."""
    from pyspark.sql import Window

    by = Window.partitionBy("file").orderBy("line_no")
    filled = lines.withColumn("gene", F.last("gene", ignorenulls=True).over(by))
    return filled.where((F.col("bootstrap") >= least) & F.col("ortholog").isNotNull()).select(F.col("file").alias("family"), "gene", "ortholog", "bootstrap")


def cluster_sequences(clusters: DataFrame, seqs: DataFrame, quals: DataFrame | None = None) -> DataFrame:
    """Members (cluster_id, id) with sequence and quality (null where unlisted) and the cluster's size."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))
    j = clusters.join(seqs.select("id", "seq"), "id", "left")
    j = j.withColumn("qual", F.lit(None).cast("array<int>")) if quals is None else j.join(quals.select("id", "qual"), "id", "left")
    return j.join(sizes, "cluster_id").select("cluster_id", "id", "seq", "qual", "size")


def unlisted_members(clusters: DataFrame, seqs: DataFrame) -> DataFrame:
    """Members that no sequence has."""
    return clusters.join(seqs.select("id"), "id", "left_anti")


def unigene_names(contigs: DataFrame, singlets: DataFrame, singletons: DataFrame) -> DataFrame:
    """(unigene, kind, seq): contigs (cluster_id, contig, seq) as cluster-contig, singlets of assembled clusters (cluster_id, id, seq) as cluster-S-id, pre-cluster singletons (id, seq) as X-S-id."""
    made = contigs.select(F.concat_ws("-", "cluster_id", "contig").alias("unigene"), F.lit("contig").alias("kind"), "seq")
    lone = singlets.select(F.concat_ws("-", "cluster_id", F.lit("S"), "id").alias("unigene"), F.lit("singlet").alias("kind"), "seq")
    return made.unionByName(lone).unionByName(singletons.select(F.concat(F.lit("X-S-"), "id").alias("unigene"), F.lit("singleton").alias("kind"), "seq"))
