"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the whole text, so the rules run
inside the scan stage, with no shuffle and no user function. A null text
counts as the empty text; it has no words and so fails the length rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sporeline.functions.columns import let

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "with", "as", "was", "be", "by",
    "der", "die", "und", "das", "ist", "von", "den", "mit", "zu", "ein", "eine", "nicht", "sich", "auf", "für", "im",
    "le", "la", "les", "de", "et", "des", "un", "une", "du", "que", "est", "pour", "dans", "qui", "par", "sur",
    "el", "los", "las", "y", "se", "del", "por", "con", "no", "su", "al", "lo", "es", "para", "como", "o",
)


@dataclass(frozen=True)
class Rule:
    """Keep a text when ``low * base <= measure <= high * base`` (an open side is None)."""

    measure: str
    base: str
    low: float | None = None
    high: float | None = None


#: measure and base name columns of ``measures``; base "one" is the number 1.
RULES = (
    Rule("n_words", "one", low=50),
    Rule("word_chars", "n_words", low=2.0, high=15.0),
    Rule("n_symbols", "n_words", high=0.25),
    Rule("n_stop_words", "n_words", low=0.02),
    Rule("n_dup_lines", "n_lines", high=0.5),
    Rule("n_ellipsis_lines", "n_lines", high=0.5),
    Rule("n_bullet_lines", "n_lines", high=0.9),
    Rule("n_repeat_words", "n_words", high=0.5),
)


def words_of(text: Column) -> Column:
    """Words of ``text``: maximal runs of anything but space and the five controls after it."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more, the first included.

    Hashes answer the common case (no window twice) exactly: equal windows
    have equal hashes. Otherwise the windows themselves are sorted with their
    place and compared with their neighbours.
    """

    def window(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]

    def covered(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        ordered = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *window(w, i)).alias("t"), i.alias("i"))))
        return let(
            ordered,
            lambda s: F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["t"] == x["t"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["t"] == x["t"], F.lit(False))),
                            lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
                        )
                    )
                )
            ),
        )

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(*window(w, i)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(w) - 2, F.lit(0)).otherwise(covered(w))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(counted(w)))


def measures(text: Column) -> dict[str, Column]:
    """Each measure as an expression over the whole text."""
    text = F.coalesce(text, F.lit(""))
    words = words_of(text)
    full = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE_CHARS))) > 0)
    found = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        ),
    )
    lines = let(
        full,
        lambda a: F.struct(
            F.size(a).cast("long").alias("n_lines"),
            (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(a, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(a, lambda x: F.ltrim(x).startswith("- ") | F.ltrim(x).startswith("* ") | F.ltrim(x).startswith("•"))).cast("long").alias("n_bullet_lines"),
        ),
    )
    return {
        "by_word": found,
        "by_line": lines,
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }


def compile_rules(rules: tuple[Rule, ...], at) -> Column:
    """One boolean expression for the whole table; ``at(name)`` is a measure's column."""
    verdict = F.lit(True)
    for rule in rules:
        base = F.lit(1) if rule.base == "one" else F.greatest(at(rule.base), F.lit(1))
        if rule.low is not None:
            verdict = verdict & (at(rule.measure) >= F.lit(rule.low) * base)
        if rule.high is not None:
            verdict = verdict & (at(rule.measure) <= F.lit(rule.high) * base)
    return verdict


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out``: the measures, ``base_failed`` and ``kept``.

    A column already named ``out`` is replaced; all other columns pass through.
    Null and empty texts have zero in every measure and are not kept. Repeated
    rows each get their own, equal verdict; an empty table gives an empty one.
    """
    m = measures(F.col(text_col))
    flat = {
        **{k: lambda s, k=k: s["by_word"][k] for k in ("n_words", "n_repeat_words", "n_stop_words")},
        **{k: lambda s, k=k: s["by_line"][k] for k in ("n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines")},
        **{k: lambda s, k=k: s[k] for k in ("word_chars", "n_symbols")},
    }

    def verdict(s: Column) -> Column:
        at = lambda name: flat[name](s)
        failed = (at("n_words") < 50) | (100 * at("n_repeat_words") > 50 * at("n_words"))
        return F.struct(*[at(k).alias(k) for k in flat], failed.alias("base_failed"), (~failed & compile_rules(rules, at)).alias("kept"))

    return docs.withColumn(out, let(F.struct(*[v.alias(k) for k, v in m.items()]), verdict))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of ``documents``.

    Nulls, empty and very long texts, repeated rows, further columns and empty
    tables are taken as ``quality`` says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality(docs).select("doc_id", *[F.col("quality")[n].alias(n) for n in names])


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(t)::BIGINT - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS n_stop,
             len(list_filter(ls, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ell,
             len(list_filter(ls, lambda x: ltrim(x, ' ') LIKE '- %' OR ltrim(x, ' ') LIKE '* %' OR ltrim(x, ' ') LIKE '•%')) AS n_bul
      FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words >= 50
       AND word_chars >= 2.0 * greatest(n_words, 1) AND word_chars <= 15.0 * greatest(n_words, 1)
       AND n_symbols <= 0.25 * greatest(n_words, 1) AND n_stop >= 0.02 * greatest(n_words, 1)
       AND n_dup_lines <= 0.5 * greatest(n_lines, 1) AND n_ell <= 0.5 * greatest(n_lines, 1)
       AND n_bul <= 0.9 * greatest(n_lines, 1) AND n_repeat_words <= 0.5 * greatest(n_words, 1) AS kept
FROM f
"""
