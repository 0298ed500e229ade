"""Byte-level BPE encoding and decoding as a monoid tree reduction.

An element is a text with its token ids. Short texts are leaves. Two
neighbours join by re-encoding a window around their border and keeping the
tokens outside it. The window grows on each side, doubling, until its edge
lies where a run of other characters is followed by plain white space: no
match of the splitting pattern can span such a place, whatever stands around
it, so the tokens outside are provably those of the joined text. Joining is
associative, so halves may be encoded in any order and on any executor: texts
longer than a segment are cut by Spark, their segments are encoded by
different tasks, and one task per long text joins the encoded segments.
Decoding concatenates the halves' bytes up the same tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF = 8192
SEGMENT = 32768
#: Characters whose ids a worker holds at once, about, beside one text of any length.
RUN = 1 << 20
#: A character that is no white space, then plain white space: the second always starts a new match.
BREAK = re.compile(r"\S[ \t\r\n]")


class Codec:
    """Encoder of one vocabulary; made once in a worker process."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.width = np.zeros(max(table.values()) + 1, dtype=np.int64)
        for token, rank in table.items():
            self.width[rank] = len(token)

    def leaf(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_ordinary(text), dtype=np.int32)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= LEAF:
            return self.leaf(text)
        half = len(text) // 2
        return self.join((text[:half], self.encode(text[:half])), (text[half:], self.encode(text[half:])))[1]

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        a, b = left[0], right[0]
        start, stop = _last_break(a), _first_break(b)
        window = self.leaf(a[start:] + b[:stop])
        keep = len(left[1]) - self._tokens(left[1][::-1], len(a[start:].encode()))
        skip = self._tokens(right[1], len(b[:stop].encode()))
        return a + b, np.concatenate([left[1][:keep], window, right[1][skip:]])

    def _tokens(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many of the first ids make up exactly ``n_bytes`` bytes."""
        if not n_bytes:
            return 0
        near = np.cumsum(self.width[ids[:n_bytes]])  # a token has a byte at least
        return int(np.searchsorted(near, n_bytes)) + 1

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF:
            return self.encoding.decode_bytes(ids.tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _last_break(text: str) -> int:
    """Start of the window in the left text: its last provable border, or 0."""
    size = 32
    while size < len(text):
        found = [m.start() + 1 for m in BREAK.finditer(text, len(text) - size)]
        if found:
            return found[-1]
        size *= 2
    found = [m.start() + 1 for m in BREAK.finditer(text)]
    return found[-1] if found else 0


def _first_break(text: str) -> int:
    """End of the window in the right text: its first provable border, or its end."""
    found = BREAK.search(text)
    return found.start() + 1 if found else len(text)


_made: dict[tuple, Codec] = {}


def codec(shared: Broadcast) -> Codec:
    """The worker's encoder for a broadcast (ranks, pattern), made on first use."""
    ranks, pattern = shared.value
    key = (hash(ranks), pattern)
    if key not in _made:
        _made[key] = Codec(ranks, pattern)
    return _made[key]


def vocabulary(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """The rank file's bytes and the pattern, for the executors; a vocabulary is a fixed file of about 1 MB."""
    with open(path, "rb") as file:
        ranks = file.read()
    if len(ranks) > 64 << 20:
        raise ValueError("a rank file over 64 MB is not broadcast")
    return spark.sparkContext.broadcast((ranks, pattern))


def encode(docs: DataFrame, shared: Broadcast, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of the whole text in ``out`` (array<int>).

    With ``decoded``, that column holds the bytes that the ids stand for, made
    in the worker that has the ids, so that a task needs one worker and not two
    at once. Null and empty texts have no tokens. A column named ``out`` is replaced,
    others pass through; repeated rows are encoded each; an empty table gives
    an empty one. Row order is not kept.
    """

    # runs of a batch are given back one by one, so a worker never holds the ids of a whole batch
    @F.pandas_udf("array<int>")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = codec(shared)
        for texts in _runs(batches):
            yield pd.Series([made.encode(t) for t in texts], dtype=object)

    kind = "struct<ids:array<int>,bytes:binary>" if decoded else "struct<ids:array<int>>"

    def result(made: Codec, ids: list[np.ndarray]) -> pd.DataFrame:
        found = {"ids": pd.Series(ids, dtype=object)}
        if decoded:
            found["bytes"] = pd.Series([made.decode(i) for i in ids], dtype=object)
        return pd.DataFrame(found)

    @F.pandas_udf(kind)
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made = codec(shared)
        for texts in _runs(batches):
            yield result(made, [made.encode(t) for t in texts])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        made, rows = codec(shared), pdf.sort_values("_i")
        found = result(made, [_tree(made, list(zip(rows["_piece"], rows["_ids"], strict=True)))])
        return found.assign(_key=pdf["_key"].iloc[0])[["_key", *found.columns]]

    own = [c for c in docs.columns if c not in (out, decoded)]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), text.alias("_text"))
    plain = rows.where(F.length("_text") <= SEGMENT).select("_row", encoded("_text").alias("_ids"))

    # a long text is named by its content, so a task that runs again after a loss gives its segments the same name
    long = rows.where(F.length("_text") > SEGMENT).withColumn("_key", F.unhex(F.md5(F.col("_text").cast("binary"))))
    last = F.expr(f"cast((length(_text) - 1) div {SEGMENT} as int)")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("_text", i * SEGMENT + 1, F.lit(SEGMENT)))
    pieces = long.select("_key", "_text").dropDuplicates(["_key"]).select("_key", F.posexplode(cut).alias("_i", "_piece")).repartition("_key", "_i")
    pieces = pieces.select("_key", "_i", "_piece", ids_of("_piece").alias("_ids"))
    # a call a text, of two pieces or more: a worker holds one long text at a time, not a batch of them
    whole = pieces.groupBy("_key").applyInPandas(joined, f"_key binary, ids array<int>{', bytes binary' if decoded else ''}")
    whole = whole.select("_key", F.struct(*[c for c in whole.columns if c != "_key"]).alias("_ids"))
    whole = long.select("_key", "_row").join(whole, "_key").select("_row", "_ids")
    more = [F.col("_ids.bytes").alias(decoded)] if decoded else []
    return plain.unionByName(whole).select(*[F.col("_row")[c].alias(c) for c in own], F.col("_ids.ids").alias(out), *more)


def _runs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The texts of the batches in their order, in runs of about RUN characters."""
    for texts in batches:
        ends = texts.str.len().cumsum().to_numpy() // RUN
        cuts = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), len(texts)] if len(texts) else []
        for a, b in zip(cuts, cuts[1:]):
            yield texts.iloc[a:b]


def _tree(made: Codec, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Join encoded neighbours pairwise until one is left."""
    while len(parts) > 1:
        pairs = [made.join(*parts[i : i + 2]) for i in range(0, len(parts) - 1, 2)]
        parts = pairs + parts[len(pairs) * 2 :]
    return np.asarray(parts[0][1], dtype=np.int32)


def decode(ids, shared: Broadcast):
    """The bytes that a column of token ids stands for (binary); null ids give null."""

    @F.pandas_udf("binary")
    def bytes_of(lists: pd.Series) -> pd.Series:
        made = codec(shared)
        return pd.Series([None if x is None else made.decode(np.asarray(x)) for x in lists], dtype=object)

    return bytes_of(ids)


def digest(ids):
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)


def op3_bpe_tree(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of ``documents``.

    Nulls, empty and very long texts, repeated rows, further columns and empty
    tables are taken as ``encode`` says.
    """
    import public_tokenizers

    shared = vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode(docs, shared, decoded="decoded")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
