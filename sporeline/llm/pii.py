"""Personal data: base patterns seed a bootstrapped contextual extraction.

Base spans of four kinds are seeds. The one and two words before an identifier
are lexical patterns. Every identifier-like string that is no seed (a number
run, a masked address) is a candidate instance of the same patterns. Spark
scores the pattern-instance graph in rounds. A pattern is active once MIN_SEEDS
distinct trusted instances of a kind follow it; its confidence is the trust of
what follows it, summed over places, against every place in the corpus where
its words stand. A candidate after an active pattern of high confidence is
trusted as much as the best of them, and counts as an instance in the next
round: so what was found induces patterns that no seed backs, and those find
more. Rounds end when no pattern is new. Frequent words are no patterns by
themselves, for most of what follows them is no identifier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeline.functions.storage import discard, materialize
from sporeline.llm.wordhash import U, chunks, mix, word_hashes

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.5
#: Bits of the filter that spares most of the corpus's word pairs the count; 2 MB however many patterns there are.
FILTER = 1 << 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"(?<![0-9])[0-9](?:[\x20()._-]{0,2}[0-9]){6,}")
# whole runs only, taken without giving back: linear in the text, and of any length
_MASKED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)*+"
)
_SPACES = " \t\n\x0b\f\r"
_SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each @, in linear time: the local part is the run before it, back to the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost and non-overlapping in each kind."""
    spans = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            spans.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                spans.append((3, *m.span()))
    return spans


def _candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of identifier-like strings that no base span touches; one string may be of several kinds."""
    marked = np.zeros(len(text) + 1, dtype=bool)
    for _, a, b in taken:
        marked[a:b] = True
    free = lambda a, b: not marked[a:b].any()
    if "@" in text or "(at)" in text or "[at]" in text:
        for m in _MASKED.finditer(text):
            if free(*m.span()):
                yield 0, *m.span()
    for m in _NUMBER.finditer(text):
        n = len(_DIGIT.findall(m[0]))
        if not free(*m.span()):
            continue
        if 7 <= n <= 15:
            yield 3, *m.span()
        if 13 <= n <= 19:
            yield 2, *m.span()
        if n <= 12 and len(re.findall(r"[0-9]+", m[0])) == 4:
            yield 1, *m.span()


def _context(text: str, start: int) -> list[str]:
    """The last two words before a place; none where the place is inside a word."""
    if not start or text[start - 1] not in _SPACES:
        return []
    size = 64
    while True:
        low = max(0, start - size)
        words = [w for w in _SPLIT.split(text[low:start]) if w]
        if not low or len(words) > 2:  # the first of more may be cut, the last two are whole
            return words[-2:]
        size *= 4


def _hash_words(words: list[str]) -> int:
    made, *_ = word_hashes([" ".join(words).encode("utf-8", "surrogatepass")])
    return int(_fold(made[:1], made[1:2]).view(np.int64)[0]) if len(made) == 2 else int(made.view(np.int64)[0]) if len(made) == 1 else 0


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(3) + b)


def _instance(value: str) -> str:
    return re.sub(r"[\x20()._-]", "", value).lower()


SCAN = (
    "row long, id string, base array<struct<kind:int,start:long,end:long>>, "
    "edges array<struct<kind:int,start:long,end:long,one:long,two:long,instance:string,seed:boolean>>"
)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        base, edges = [], []
        for text in batch["text"]:
            text = text or ""
            spans = base_spans(text)
            found = [(*s, True) for s in spans] + [(*s, False) for s in _candidates(text, spans)]
            rows = []
            for kind, a, b, seed in found:
                words = _context(text, a)
                rows.append({"kind": kind, "start": a, "end": b, "one": _hash_words(words[-1:]), "two": _hash_words(words) if len(words) == 2 else 0, "instance": _instance(text[a:b]), "seed": seed})
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            edges.append(rows)
        yield pd.DataFrame({"row": batch["row"], "id": batch["id"], "base": base, "edges": edges})


def _filter(patterns: DataFrame) -> np.ndarray:
    """Bits of the patterns' hashes: FILTER bits at most, made by partial bitmaps."""
    bit = F.pmod(F.col("pattern"), F.lit(FILTER)) + 1  # buckets start at 1
    parts = patterns.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros((FILTER >> 15, 1 << 15), dtype=bool)
    for row in parts.collect():  # FILTER / 32768 rows of 4 KB
        out[row["at"] - 1] = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), bitorder="little")
    return out.ravel()


def _occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): places in the corpus where the words of each of ``patterns`` stand."""
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(_filter(patterns)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maybe = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for _, raws in chunks(batch["text"].tolist()):
                words, first, _, _ = word_hashes(raws)
                owner = np.repeat(np.arange(len(raws)), np.diff(first))
                pairs = _fold(words[:-1], words[1:])[owner[:-1] == owner[1:]] if len(words) > 1 else words[:0]
                seen = np.concatenate([words, pairs])
                values, times = np.unique(seen[maybe[(seen & U(FILTER - 1)).astype(np.int64)]].view(np.int64), return_counts=True)
                yield pd.DataFrame({"pattern": values, "n": times})

    counted = texts.mapInPandas(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return counted.join(patterns, "pattern", "left_semi")


def learn_patterns(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, kind, confidence, support) of the patterns that reach the thresholds.

    ``edges`` has kind, pattern, instance, seed: one row an identifier-like
    string and pattern before it. ``support`` counts distinct trusted instances.
    """
    graph = edges.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    graph = materialize(graph)
    # a pattern that fewer distinct instances follow can never be active
    likely = graph.groupBy("kind", "pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("seen")).where(F.col("instances") >= MIN_SEEDS)
    likely = materialize(likely.select("kind", "pattern", "seen"))
    totals = _occurrences(texts, materialize(likely.select("pattern").distinct()))
    likely = materialize(likely.join(totals, "pattern", "left").select("kind", "pattern", F.greatest("seen", F.coalesce("total", F.lit(0))).alias("total")))
    graph = materialize(graph.join(likely, ["kind", "pattern"]))
    trusted = graph.where("seed").select("kind", "instance", F.lit(1.0).alias("trust")).distinct()
    active, before = None, -1
    # trust only grows and patterns are finite; each round reaches a step further from the seeds
    while True:
        last = active
        scored = graph.join(trusted, ["kind", "instance"]).groupBy("kind", "pattern").agg(
            (F.sum(F.col("n") * F.col("trust")) / F.first("total")).alias("confidence"), F.count("*").alias("support")
        )
        active = materialize(scored.where((F.col("support") >= MIN_SEEDS) & (F.col("confidence") >= MIN_CONFIDENCE)))
        now = active.count()
        discard(last)
        if now == before:
            break
        before = now
        best = graph.join(active.select("kind", "pattern", "confidence"), ["kind", "pattern"]).groupBy("kind", "instance").agg(F.max("confidence").alias("trust"))
        seeds = graph.where("seed").select("kind", "instance", F.lit(1.0).alias("trust"))
        trusted = best.unionByName(seeds).groupBy("kind", "instance").agg(F.max("trust").alias("trust"))
    discard(graph)
    return active.select("pattern", "kind", "confidence", "support")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, found) for every row of ``docs``: arrays of (kind, start, end).

    ``base`` holds the base spans by kind, then start; ``found`` what the
    patterns add, never touching a base span. A pattern's last word ends in
    white space before the identifier; an identifier inside a word has none.
    Places are code points, ends exclusive. Other columns are not used. Null and empty texts have none; repeated rows each get a row
    and count each as evidence; an empty table gives an empty one.
    """
    # numbers are given once, as the scan is written and read again from there
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    scanned = materialize(rows.mapInPandas(_scan, SCAN))
    each = scanned.select("row", F.explode("edges").alias("e")).select("row", "e.*")
    each = each.select("row", "kind", "start", "end", "instance", "seed", F.explode(F.array("one", "two")).alias("pattern")).where("pattern <> 0")
    good = learn_patterns(each, docs.select(F.col(text_col).alias("text")))
    added = each.where("NOT seed").join(good.select("pattern", "kind"), ["pattern", "kind"]).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("found"))
    empty = F.array().cast("array<struct<kind:int,start:long,end:long>>")
    joined = scanned.select("row", "id", "base").join(added, "row", "left")
    return joined.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "base", F.coalesce("found", empty).alias("found"))


def op4_bootstrapped_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of ``documents``; counts are of base spans.

    Nulls, empty and very long texts, repeated rows, further columns and empty
    tables are taken as ``personal_data`` says.
    """
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return found.select(
        "doc_id", *[count(i) for i in range(4)], F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_found"),
    )
