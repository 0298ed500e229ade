"""Token ids in binary files: one zstandard frame a document, one dictionary for all.

A dictionary is trained on the serialised ids of a bounded sample of documents
(it changes sizes, never contents). Every document's ids are compressed apart
with it, so that a short document can be read alone. Frames travel to the
order of ids by a sort by range, and each range is cut into files of bounded
size, which Spark's writers put into any store that Spark can write to.

A file, little-endian: a head of 48 bytes (``TOKZ``, version, bytes an id, two
zeros, number of the range, number of the file in it, SHA-256 of the
dictionary), the frames, then the index: for each document its id and whether
it has one, its frame's offset, its number of ids. The tail holds the number
of documents, the index's offset and checksum, and ``TOKZ``; one newline ends
the file. ``dictionary`` in the same folder holds the dictionary; its hash is
checked against every file's head.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sporeline.functions.storage import discard, materialize, shared_dir

MAGIC, VERSION = b"TOKZ", 1
HEAD, TAIL = struct.Struct("<4sBBHII32s"), struct.Struct("<QQI4s")
#: Bytes of frames in a file, about; and of one batch of rows that a reader hands on.
FILE_BYTES, BATCH_BYTES = 8 << 20, 4 << 20
#: The dictionary's sample: documents, expected; letters of each; bytes of the dictionary.
SAMPLE, SAMPLE_LETTERS, DICTIONARY_BYTES = 2000, 8192, 1 << 16
#: Words that a worker remembers, about 200 bytes each, and the longest of them; letters of texts split at once; new words in one call.
REMEMBERED, LONGEST, TEXTS_AT_ONCE, PER_CALL = 500_000, 64, 1 << 20, 1000
#: Totals of so many files are broadcast, at 24 bytes each; more are joined by a shuffle.
FILES_BROADCAST = 500_000


class WordCodec:
    """A tokenizer whose tokens neither hold white space nor look across it: words are encoded once and remembered.

    A word of small Latin letters passes the library's normaliser and
    pre-tokenizer unchanged but for the bytes' names, which are looked up
    letter by letter, and goes to its model at once; a point or comma after
    such a word is a token of its own. Other new words are encoded in one
    call, parted by a character that is a token of its own. Where the library
    writes capitals small, texts of Latin-1 alone, whose letters are neither
    joined nor parted by that, are written small first.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode())
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pack = struct.Struct("<H" if self.kind.itemsize == 2 else "<I").pack
        normal, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        same = lambda c: normal is None or normal.normalize_str(c) == c
        self.small = normal is not None and normal.normalize_str("AZ") == "az"
        named = {c: split.pre_tokenize_str(c) for c in map(chr, range(0x61, 0x250)) if c.isalpha() and same(c)} if split is not None else {}
        self.names = {ord(c): p[0][0] for c, p in named.items() if len(p) == 1}
        self.plain = all(self.names.get(c) == chr(c) for c in range(0x61, 0x7B))
        self.latin = re.compile(f"[{''.join(map(chr, self.names))}]+" if self.names else "(?!)").fullmatch
        mark = self._ids("\0")
        self.mark = mark[0] if len(mark) == 1 else None
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _small_latin(self, word: str) -> bool:
        if word.isascii():
            return self.plain and word.isalpha() and word.islower()
        return self.latin(word) is not None

    def _word(self, word: str) -> bytes:
        pack = self.pack
        return b"".join([pack(t.id) for t in self.model.tokenize(word if word.isascii() else word.translate(self.names))])

    def _learn(self, words: list[str]) -> None:
        known, rest, latin = self.known, [], self._small_latin
        point = {p: self._ids(p).tobytes() for p in ".,"}
        for w in words:
            if latin(w):
                known[w] = self._word(w)
            elif w[-1] in point and latin(w[:-1]):
                known[w] = (known.get(w[:-1]) or self._word(w[:-1])) + point[w[-1]]
            else:
                rest.append(w)
        marked = [] if self.mark is None else [w for w in rest if "\0" not in w]
        for k in range(0, len(marked), PER_CALL):
            part = marked[k : k + PER_CALL]
            ids = self._ids(" \0 ".join(part))
            raw, size, at = ids.tobytes(), ids.itemsize, np.flatnonzero(ids == self.mark)
            begins, ends = [0, *((at + 1) * size).tolist()], [*(at * size).tolist(), len(raw)]
            known.update(zip(part, (raw[a:b] for a, b in zip(begins, ends, strict=True)), strict=True))
        for w in rest:
            if w not in known:
                known[w] = self._ids(w).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Serialised ids of each whole text, some texts at a time."""
        for some in _runs(texts, TEXTS_AT_ONCE):
            parts = [(t.lower() if self.small and _narrow(t) else t).replace("\n", " ").split(" ") for t in some]
            new = list(set().union(*parts).difference(self.known))
            self._learn(new)
            for p in parts:
                yield b"".join(map(self.known.__getitem__, p))
            if len(self.known) > REMEMBERED:
                self.known = {"": b""}
            elif max(map(len, new), default=0) > LONGEST:
                for w in new:
                    if len(w) > LONGEST:
                        del self.known[w]


def _narrow(text: str) -> bool:
    """Whether all characters are of Latin-1."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def _runs(texts: list[str], letters: int) -> Iterator[list[str]]:
    """Runs of texts of about so many letters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > letters:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


_made: dict[int, WordCodec] = {}


def codec(shared: Broadcast) -> WordCodec:
    """The worker's tokenizer for a broadcast model, made on first use."""
    key = hash(shared.value)
    if key not in _made:
        _made[key] = WordCodec(shared.value)
    return _made[key]


def model(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file's bytes for the executors; such a file has a few MB."""
    with open(path, "rb") as file:
        made = file.read()
    if len(made) > 64 << 20:
        raise ValueError("a tokenizer file over 64 MB is not broadcast")
    return spark.sparkContext.broadcast(made)


def _whole(texts: pd.Series) -> list[str]:
    return ["" if t is None else t for t in texts]


def train(docs: DataFrame, shared: Broadcast, end_id: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from the starts of about ``sample`` documents chosen by a digest of their id; empty where they are too few to train on."""
    share = min(1.0, sample / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    starts = picked.select(F.substring(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 1, SAMPLE_LETTERS).alias("text")).limit(2 * sample)
    end = np.array([end_id], "<u4")

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        made = codec(shared)
        return pd.Series([x + end.astype(made.kind).tobytes() for x in made.encode(_whole(texts))], dtype=object)

    rows = sorted(bytes(r["ids"]) for r in starts.select(ids("text").alias("ids")).collect())  # bounded by sample and SAMPLE_LETTERS
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, rows)) // 8)), rows).as_bytes() if len(rows) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _tools(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def frames(docs: DataFrame, shared: Broadcast, dictionary: Broadcast, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, frame): the number of ids of the whole text with the end id, and the ids compressed."""

    @F.pandas_udf("n long, frame binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made, packer = codec(shared), zstandard.ZstdCompressor(level=3, dict_data=_tools(dictionary.value))
        end = np.array([end_id], made.kind).tobytes()
        for texts in batches:
            rows = [(len(x) // made.kind.itemsize + 1, packer.compress(x + end)) for x in made.encode(_whole(texts))]
            yield pd.DataFrame(rows, columns=["n", "frame"]).astype({"n": "int64"})

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), packed(F.col(f"`{text_col}`")).alias("x"))
    return rows.select("id", "x.n", "x.frame")


def pack(part: int, number: int, width: int, hashed: bytes, rows: list[tuple[int | None, int, bytes]]) -> bytes:
    """A file's bytes, without its newline, from (id, n, frame)."""
    ids = np.array([0 if r[0] is None else r[0] for r in rows], "<i8")
    known = np.array([r[0] is not None for r in rows], "u1")
    offsets = (HEAD.size + np.cumsum([0, *(len(r[2]) for r in rows)])).astype("<u8")
    index = ids.tobytes() + known.tobytes() + offsets.tobytes() + np.array([r[1] for r in rows], "<u8").tobytes()
    tail = TAIL.pack(len(rows), int(offsets[-1]), zlib.crc32(index), MAGIC)
    return b"".join([HEAD.pack(MAGIC, VERSION, width, 0, part, number, hashed), *(r[2] for r in rows), index, tail])


class TokenFile:
    """A file's bytes, read: ``document(k)`` touches one frame only."""

    def __init__(self, content: bytes, dictionary: bytes):
        magic, version, width, _, self.part, self.number, hashed = HEAD.unpack_from(content)
        self.n, at, crc, last = TAIL.unpack_from(content, len(content) - 1 - TAIL.size)
        if magic != MAGIC or last != MAGIC or version != VERSION:
            raise ValueError("no token file of this version")
        if hashed != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        if zlib.crc32(content[at : len(content) - 1 - TAIL.size]) != crc:
            raise ValueError("the index of a token file is damaged")
        n = self.n
        self.content, self.kind = content, np.dtype(f"<u{width}")
        self.ids, at = np.frombuffer(content, "<i8", n, at), at + 8 * n
        self.known, at = np.frombuffer(content, "u1", n, at), at + n
        self.offsets, at = np.frombuffer(content, "<u8", n + 1, at).astype(np.int64), at + 8 * n + 8
        self.tokens = np.frombuffer(content, "<u8", n, at).astype(np.int64)
        self.reader = zstandard.ZstdDecompressor(dict_data=_tools(dictionary))

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        raw = self.reader.decompress(self.content[self.offsets[k] : self.offsets[k + 1]])
        return np.frombuffer(raw, self.kind)


def write_token_files(
    docs: DataFrame, folder: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES,
) -> None:
    """Encode the whole texts of ``docs`` and write them to ``folder``, a new folder of a store that all executors reach, in ascending order of ids.

    Null ids come first; rows of one id stand in the order in which they were
    read. Null and empty texts have the end id alone. Repeated rows are written
    each; other columns are left out; an empty table gives a folder with a
    dictionary and no documents.
    """
    spark = docs.sparkSession
    shared = model(spark, path)
    trained = train(docs, shared, end_id, id_col, text_col)
    dictionary, hashed = spark.sparkContext.broadcast(trained), hashlib.sha256(trained).digest()
    with _small_batches(spark):
        encoded = materialize(frames(docs, shared, dictionary, end_id, id_col, text_col))

    width = WordCodec(shared.value).kind.itemsize

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _made.clear()  # words are no longer needed
        part, number, rows, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for known, key, n, frame in zip(batch["known"], batch["id"], batch["n"], batch["frame"], strict=True):
                rows.append((int(key) if known else None, int(n), bytes(frame)))
                held += len(frame)
                if held >= file_bytes:
                    yield pd.DataFrame({"file": [pack(part, number, width, hashed, rows)]})
                    number, rows, held = number + 1, [], 0
        if rows:
            yield pd.DataFrame({"file": [pack(part, number, width, hashed, rows)]})

    # the place in the written table parts rows of one id, so no id is one range
    keyed = encoded.select(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), "n", "frame", F.monotonically_increasing_id().alias("_at"))
    placed = keyed.repartitionByRange("known", "id", "_at").sortWithinPartitions("known", "id", "_at").drop("_at")
    with _small_batches(spark):
        _write(placed.mapInPandas(build, "file binary"), f"{folder}/files")
    _write(spark.createDataFrame([(bytearray(trained),)], "file binary"), f"{folder}/dictionary")
    discard(encoded)


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While texts and frames pass to Python, fewer rows at a time than Spark's 10,000: less memory beside each worker's words."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _write(files: DataFrame, folder: str) -> None:
    """One file for each row; the text writer takes bytes as they are and ends each file with a newline."""
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{folder}/files").where("length > 0").select("content")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(part, number, first, doc_id, n_tokens, ids): each document of the folder; ``ids`` are unsigned 32-bit little-endian numbers, ``first`` the ids before it in its file.

    A file that is damaged or was written with another dictionary fails the
    job. ``starts`` tells the ids in all files before.
    """
    dictionary = _dictionary(spark, folder)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _made.clear()
        for batch in batches:
            for content in batch["content"]:
                file = TokenFile(bytes(content), dictionary.value)
                first, begin = np.cumsum(file.tokens) - file.tokens, 0
                while begin < file.n:  # a batch of bounded size at a time
                    stop = max(begin + 1, int(np.searchsorted(first, first[begin] + BATCH_BYTES // 4)))
                    rows = slice(begin, stop)
                    yield pd.DataFrame({
                        "part": file.part, "number": file.number, "first": first[rows], "doc_id": pd.array(file.ids[rows], dtype="Int64").copy(),
                        "n_tokens": file.tokens[rows], "ids": [file.document(k).astype("<u4").tobytes() for k in range(begin, min(stop, file.n))],
                    }).assign(doc_id=lambda d, known=file.known[rows]: d["doc_id"].where(known.astype(bool)))
                    begin = stop

    return _files(spark, folder).mapInPandas(read, "part int, number int, first long, doc_id long, n_tokens long, ids binary")


def _dictionary(spark: SparkSession, folder: str) -> Broadcast:
    (row,) = spark.read.format("binaryFile").load(f"{folder}/dictionary").where("length > 0").select("content").collect()  # DICTIONARY_BYTES at most
    return spark.sparkContext.broadcast(bytes(row["content"])[:-1])


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, number, before): ids in all files before each file, from the files' indexes; frames stay compressed."""
    dictionary = _dictionary(spark, folder)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [TokenFile(bytes(c), dictionary.value) for c in batch["content"]]
            yield pd.DataFrame({"part": [f.part for f in made], "number": [f.number for f in made], "n": [int(f.tokens.sum()) for f in made]})

    each = _files(spark, folder).mapInPandas(totals, "part int, number int, n long")
    by_part = each.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))  # one row a range
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("number")) - F.col("n")
    return each.withColumn("inside", inside).join(F.broadcast(earlier), "part").select("part", "number", (F.col("earlier") + F.col("inside")).alias("before"))


def op11_token_files(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of ``documents``, from files written to the shared folder and read back.

    Nulls, empty and very long texts, ties, repeated rows, further columns and
    empty tables are taken as ``write_token_files`` says.
    """
    import public_tokenizers

    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    read = read_token_files(spark, folder).select("part", "number", "first", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    before = starts(spark, folder)
    before = F.broadcast(before) if len(_files(spark, folder).inputFiles()) <= FILES_BROADCAST else before
    return read.join(before, ["part", "number"]).select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
