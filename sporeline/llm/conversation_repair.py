"""Repair of conversation structure by iterative-deepening A*.

A conversation's rows are edited (D delete, I insert, K keep, R give another
role) until the initials of its roles read ``(s?(ua)+)?``. The search goes
depth first, tries edits in ASCII order, and cuts a path whose cost and least
further cost exceed the bound; the bound rises to the least excess until a
path is accepted, so the first accepted path is the cheapest and, of those,
the least in ASCII order. States (row, automaton state) that failed keep the
cost that they were shown to need at least, and are not entered again below
it. Long conversations are searched from their last stretch of rows to their
first: the costs from a stretch's end are then known, so work grows with the
number of rows and no path is deep.

Spark adds up equal rows of a conversation before they travel, so copies of a
row cost nothing; a conversation's different rows meet in one row of the
result, as its audit, one letter a row, must.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
STRETCH = 16
#: Automaton: nothing yet, after s, after u, after a. For each, where a letter leads; the letter that an insert or a new role takes; cost to end here.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TAKES = ("u", "u", "a", "u")
ENDING = (0, 2 * INSERT, INSERT, 0)
NAMES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"


class Search:
    """Cheapest edits of items (initial, rows, forced, truncated): a forced item is a run of rows that must go."""

    def __init__(self, items: list[tuple[str, int, bool, bool]]):
        self.items, self.path = items, []
        self.least = [0] * (len(items) + 1)  # what the rows from here on cost whatever is done
        for i in range(len(items) - 1, -1, -1):
            _, rows, forced, truncated = items[i]
            self.least[i] = self.least[i + 1] + (DELETE * rows if forced else min(DELETE, TRUNCATED) if truncated else 0)
        self.known: dict[int, list[int]] = {len(items): list(ENDING)}
        self.failed: dict[tuple[int, int], int] = {}

    def run(self) -> tuple[int, list[tuple[str, int, str]]]:
        """The cost and the path: (edits, item or -1, letter)."""
        starts = list(range(0, len(self.items), STRETCH))
        for begin in reversed(starts):
            self._open(begin)
            costs = [0] * len(MOVES)
            for state in range(len(MOVES)) if begin else (0,):
                while (need := self._descend(begin, state, bound := self._floor(begin, state), self._room(state))) > bound:
                    self.failed[begin, state] = need
                costs[state] = bound
                self.path.clear()
            self.known[begin] = costs
        cost = self.known[0][0]
        left, state, whole = cost, 0, []
        for begin in starts:
            self._open(begin)
            self._descend(begin, state, left, self._room(state))
            for edit, item, letter in self.path:
                left -= self._price(edit, item)
                state = MOVES[state][letter] if letter else state
            whole += self.path
            self.path.clear()
        return cost, whole

    def _open(self, begin: int) -> None:
        self.end = min(begin + STRETCH, len(self.items))
        self.beyond = min(self.known[self.end])
        self.failed.clear()

    def _floor(self, i: int, state: int) -> int:
        if i == self.end:
            return self.known[i][state]
        return self.failed.get((i, state), self.least[i] - self.least[self.end] + self.beyond)

    @staticmethod
    def _room(state: int) -> int:
        """Inserts in a row that can be of use: more come back to the same state."""
        return 2 if state < 2 else 1

    def _price(self, edit: str, item: int) -> int:
        if edit[0] == "I":
            return INSERT * len(edit)
        _, rows, _, truncated = self.items[item]
        return DELETE * rows if edit[0] == "D" else (edit == "R") * REROLE + truncated * TRUNCATED

    def _descend(self, i: int, state: int, left: int, room: int) -> int:
        """At most ``left`` if rows from ``i`` on can be mended for it, and then ``path`` holds the edits; else what they need at least."""
        if i == self.end:
            if i == len(self.items) and 0 < ENDING[state] <= left:
                for letter in ("u", "a")[2 - ENDING[state] // INSERT :]:
                    self.path.append(("I", -1, letter))
            return self.known[i][state]
        initial, rows, forced, truncated = self.items[i]
        need = None
        for edit in "DIKR":
            item, onward, after, letter, inserts = i, i + 1, state, "", None
            if edit == "D":
                price = DELETE * rows
            elif edit == "I":
                if not room:
                    continue
                price, item, onward, letter, inserts = INSERT, -1, i, TAKES[state], room - 1
            elif forced or (edit == "K" and initial not in MOVES[state]):
                continue
            else:
                letter = initial if edit == "K" else TAKES[state]
                price = (edit == "R") * REROLE + truncated * TRUNCATED
            if letter:
                after = MOVES[state][letter]
            further = self._floor(onward, after)
            if price + further <= left:
                self.path.append((edit * rows if edit == "D" else edit, item, letter))
                further = self._descend(onward, after, left - price, self._room(after) if inserts is None else inserts)
                if price + further <= left:
                    return price + further
                self.path.pop()
            need = price + further if need is None else min(need, price + further)
        if room == self._room(state):
            self.failed[i, state] = max(need, self._floor(i, state))
        return need


def mend(roles: list[str], texts: list[str], counts: list[int]) -> dict:
    """Faults and cheapest repair of a conversation's different rows in order; ``counts`` says how often each row stands there."""
    seen, items, entry = set(), [], []
    faults = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    last = None
    for k, (role, text, n) in enumerate(zip(roles, texts, counts, strict=True)):
        initial, bare = role[:1], text.rstrip(SPACE)
        if last is not None and last + initial not in ("su", "ua", "au"):
            faults["illegal"] += 1
        faults["illegal"] += n - 1  # a row next to its copy
        last = initial
        if not bare:
            faults["blank"] += n
            items.append(("", n, True, False))
            entry.append(k)
            continue
        new = (role, text) not in seen
        seen.add((role, text))
        faults["duplicate"] += n - new
        if new:
            cut = bare[-1] not in ".!?"
            faults["truncated"] += cut
            items.append((initial, 1, False, cut))
            entry.append(k)
        if n > new:
            items.append(("", n - new, True, False))
            entry.append(k)
    cost, path = Search(items).run() if items else (0, [])
    kept = [(entry[i] if i >= 0 else -1, roles[entry[i]] if edit == "K" else NAMES[letter]) for edit, i, letter in path if edit[0] != "D"]
    return faults | {"cost": cost, "audit": "".join(edit for edit, _, _ in path), "places": [k for k, _ in kept], "roles": [r for _, r in kept]}


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired, an array of (role, text).

    Rows stand by turn, null turns first, rows of one turn by role and text. A
    null role or text counts as one space; a null conversation is a
    conversation. Repeated rows are duplicates. With ``copies_col`` a row
    stands so many times; with 0 it only names its conversation, and one
    without other rows has no faults and an empty repair. Texts may have any
    length; other columns are left out; an empty table gives an empty one.
    """
    n = F.lit(1) if copies_col is None else F.col(f"`{copies_col}`")
    there = n > 0
    part = lambda c: F.when(there, F.coalesce(F.col(f"`{c}`"), F.lit(" ")))
    base = rows.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.when(there, F.col(f"`{turn_col}`").cast("long")).alias("turn"),
        part(role_col).alias("role"), part(text_col).alias("text"), n.cast("long").alias("n"),
    )
    different = base.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    listed = F.when(F.col("n") > 0, F.struct("turn", "role", "text", "n"))  # collect_list leaves nulls out
    gathered = different.groupBy("conv_id").agg(F.sort_array(F.collect_list(listed)).alias("e"))

    @F.pandas_udf("blank long, duplicate long, truncated long, illegal long, cost long, audit string, places array<int>, roles array<string>")
    def mended(roles: pd.Series, texts: pd.Series, counts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mend(list(r), list(t), [int(x) for x in c]) for r, t, c in zip(roles, texts, counts, strict=True)], columns=["blank", "duplicate", "truncated", "illegal", "cost", "audit", "places", "roles"])

    turns = F.array_distinct(F.filter(F.col("e.turn"), lambda t: t.isNotNull()))
    done = gathered.select("conv_id", F.col("e.text").alias("texts"), turns.alias("t"), mended(F.col("e.role"), F.col("e.text"), F.col("e.n")).alias("m"))
    gaps = F.when(F.size("t") > 0, F.array_max("t") - F.array_min("t") + 1 - F.size("t")).otherwise(0).cast("long")
    text = lambda k: F.when(k < 0, F.lit("")).otherwise(F.get("texts", k))
    repaired = F.transform(F.arrays_zip(F.col("m.places").alias("place"), F.col("m.roles").alias("role")), lambda x: F.struct(x["role"].alias("role"), text(x["place"]).alias("text")))
    return done.select("conv_id", gaps.alias("gaps"), "m.blank", "m.duplicate", "m.truncated", "m.illegal", "m.cost", "m.audit", repaired.alias("repaired"))


def damaged(rows: DataFrame, out: str = "copies") -> DataFrame:
    """Conversation rows with the contract's damage done; ``out`` says how many times each row stands (0: dropped)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    hurt = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), harm.alias("_harm"))
    text = F.when(F.col("_harm") == 1, "").when(F.col("_harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_harm") == 0, 0).when(F.col("_harm") == 3, 2).otherwise(1)
    return hurt.select("conv_id", "turn", F.when(F.col("_harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias(out))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every conversation of ``conversations``.

    Nulls, empty and very long texts, ties, repeated rows, further columns and
    empty tables are taken as ``repair_conversations`` says.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair_conversations(damaged(rows), copies_col="copies")
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))


#: Dynamic programming over the rows: the cheapest, then ASCII-least, edits into each automaton state.
OP13_SQL = r"""
WITH RECURSIVE step(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h, dense_rank() OVER (ORDER BY conv_id) AS cid FROM conversations),
harm AS (SELECT *, (xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT),
           lambda acc, x: xor(acc // 256, t[xor(acc % 256, x) + 1]), 4294967295), 4294967295) % 20)::INTEGER AS d FROM src CROSS JOIN tab),
hurt AS (SELECT cid, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM harm),
placed AS (SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
told AS (SELECT *, row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
           NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(r) OVER (PARTITION BY cid ORDER BY i) AS before FROM placed),
f AS (SELECT *, blank OR again AS forced FROM told),
moves(q, letter, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(q, q2, c, a, r) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
  (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:'])),
dp(cid, i, q, best) AS (
  SELECT cid, 0::BIGINT, 0, {'c': 0, 'a': '', 'r': []::VARCHAR[]} FROM (SELECT DISTINCT cid FROM src)
  UNION ALL
  SELECT cid, i, q, min({'c': c, 'a': a, 'r': r}) FROM (
    SELECT x.cid, f.i, x.q2 AS q, x.c + 2 AS c, x.a || 'D' AS a, x.r FROM
      (SELECT dp.cid, dp.i, ins.q2, best.c + ins.c AS c, best.a || ins.a AS a, best.r || ins.r AS r FROM dp JOIN ins USING (q)) x JOIN f ON f.cid = x.cid AND f.i = x.i + 1
    UNION ALL
    SELECT x.cid, f.i, m.q2, x.c + CASE WHEN cut THEN 5 ELSE 0 END, x.a || 'K', list_append(x.r, f.role || ':' || f.text) FROM
      (SELECT dp.cid, dp.i, ins.q2, best.c + ins.c AS c, best.a || ins.a AS a, best.r || ins.r AS r FROM dp JOIN ins USING (q)) x JOIN f ON f.cid = x.cid AND f.i = x.i + 1 AND NOT f.forced JOIN moves m ON m.q = x.q2 AND m.letter = f.r
    UNION ALL
    SELECT x.cid, f.i, m.q2, x.c + 1 + CASE WHEN cut THEN 5 ELSE 0 END, x.a || 'R', list_append(x.r, CASE m.letter WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text) FROM
      (SELECT dp.cid, dp.i, ins.q2, best.c + ins.c AS c, best.a || ins.a AS a, best.r || ins.r AS r FROM dp JOIN ins USING (q)) x JOIN f ON f.cid = x.cid AND f.i = x.i + 1 AND NOT f.forced JOIN moves m ON m.q = x.q2 AND m.letter <> 's'
  ) GROUP BY cid, i, q),
n AS (SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum((again AND NOT blank)::INT) AS duplicate,
        sum((cut AND NOT again AND NOT blank)::INT) AS truncated, sum((i > 1 AND before || r NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM f GROUP BY cid),
final AS (SELECT dp.cid, min({'c': best.c + ins.c, 'a': best.a || ins.a, 'r': best.r || ins.r}) AS best
          FROM dp JOIN ins USING (q) LEFT JOIN n USING (cid) WHERE dp.i = coalesce(n.n, 0) AND ins.q2 IN (0, 3) GROUP BY dp.cid)
SELECT s.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(array_to_string(best.r, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT cid, conv_id FROM src) s JOIN final USING (cid) LEFT JOIN n USING (cid)
"""
