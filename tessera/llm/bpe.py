"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts of up to `chunk` characters are encoded where they lie. Longer ones are cut into chunks that overlap; the chunks are
dealt to all tasks, pre-tokenised and encoded in parallel, and stitched by document: within each overlap the first
boundary that both neighbours found is where the left one stops and the right one takes over. The pattern looks ahead but
never behind, so two scans that share a boundary agree from there on. An overlap always reaches past a place where white
space follows a non-space, which is a boundary for every scan, so the neighbours always meet.

Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 32768, 256
#: The pattern's longest literal is three characters: boundaries nearer than this to the end of a slice may change with what follows.
MARGIN = 8
#: Pieces that a worker remembers, and the characters of the longest (so about 150 bytes each).
REMEMBERED, LONGEST = 200_000, 48


class Codec:
    """A rank file and a pattern, with the ids of the pieces met so far."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.known: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """The ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        found = self.known.get(piece)
        if found is None:
            found = np.array(self.core.encode_single_piece(piece.encode("utf-8", "replace")), "<u4").tobytes()
            if len(piece) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(rank_file: str, pattern: str) -> Codec:
    """One for each worker process."""
    return Codec(rank_file, pattern)


_SYNC = regex.compile(r"\S\s")


def slices(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int]]:
    """(start, end, start of the overlap with the next) of each chunk; the last has none and its overlap starts at its end."""
    start, n = 0, len(text)
    while True:
        core = start + chunk
        if core >= n:
            yield start, n, n
            return
        meet = _SYNC.search(text, core)
        end = n if meet is None else min(n, max(core + overlap, meet.end() + MARGIN))
        if end >= n:
            yield start, n, n
            return
        yield start, end, core
        start = core


def chunk_rows(long_docs: DataFrame, key: str, text: str, chunk: int, overlap: int) -> DataFrame:
    kind = long_docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t, copies in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                s = t.as_py()
                digest = hashlib.sha256(s.encode("utf-8", "replace")).digest()
                head = 0
                for i, (a, e, core) in enumerate(slices(s, chunk, overlap)):
                    columns = [pa.array([k.as_py()], batch.schema.field(0).type), *map(pa.array, ([digest], [i], [copies.as_py()], [a], [head], [core], [s[a:e]]))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "digest", "no", "copies", "start", "head", "core", "piece"])
                    head = e

    # rows that repeat a key and a text are one from here on, and are given back at the end
    once = long_docs.groupBy(key, text).agg(F.count("*").alias("_copies"))
    return once.select(key, text, "_copies").mapInArrow(cut, f"key {kind}, digest binary, no bigint, copies bigint, start bigint, head bigint, core bigint, piece string")


def scan(text: str, start: int, head: int, core: int, coder: Codec) -> dict:
    """One chunk's ids, and the boundaries in both its overlaps as (place in the text, number of ids before it)."""
    ends, ids, at, n = [start], [], start, 0
    before = [0]
    for m in coder.pattern.findall(text):
        got = coder.piece(m)
        at, n = at + len(m), n + len(got) // 4
        ids.append(got)
        ends.append(at)
        before.append(n)
    ends_, before_ = np.array(ends), np.array(before)
    first = ends_ <= head if head else ends_ < 0
    last = (ends_ >= core) & (ends_ <= start + len(text) - MARGIN)
    pack = lambda x: x.astype("<i8").tobytes()
    return {"ids": b"".join(ids), "head_at": pack(ends_[first]), "head_n": pack(before_[first]), "tail_at": pack(ends_[last]), "tail_n": pack(before_[last])}


def stitch(chunks: list[dict]) -> bytes:
    """The ids of a text from its chunks in order."""
    out, begin = [], 0
    for i, c in enumerate(chunks):
        stop = len(c["ids"]) // 4
        following = 0
        if i + 1 < len(chunks):
            tail_at, head_at = np.frombuffer(c["tail_at"], "<i8"), np.frombuffer(chunks[i + 1]["head_at"], "<i8")
            _, mine, its = np.intersect1d(tail_at, head_at, return_indices=True)
            if not len(mine):
                raise RuntimeError("neighbouring chunks share no boundary")
            stop = int(np.frombuffer(c["tail_n"], "<i8")[mine[0]])
            following = int(np.frombuffer(chunks[i + 1]["head_n"], "<i8")[its[0]])
        out.append(c["ids"][4 * begin : 4 * stop])
        begin = following
    return b"".join(out)


def _apply(docs: DataFrame, key: str, text: str, rank_file: str, pattern: str, out: Callable[[Codec, bytes], tuple], fields: list[tuple[str, str, pa.DataType]], chunk: int, overlap: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{n} {t}" for n, t, _ in fields)
    # names of its own inside, whatever the columns are called
    whole = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [out(c, c.encode(t.as_py())) for t in part.column(1)]
                columns = [pa.array(x, t) for x, (_, _, t) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["key", *(n for n, _, _ in fields)])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                x = row.to_pylist()[0]
                got = scan(x["piece"], x["start"], x["head"], x["core"], c)
                columns = [pa.array([got[n]], pa.binary()) for n in ("ids", "head_at", "head_n", "tail_at", "tail_n")]
                yield pa.RecordBatch.from_arrays([*row.columns[:4], *columns], ["key", "digest", "no", "copies", "ids", "head_at", "head_n", "tail_at", "tail_n"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        c = codec(rank_file, pattern)
        got = out(c, stitch(pdf.sort_values("no").to_dict("records")))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]]} | {n: [v] for (n, _, _), v in zip(fields, got, strict=True)} | {"_copies": [pdf["copies"].iloc[0]]})

    size = F.char_length("text")
    near = whole.where(size <= chunk).mapInArrow(short, schema)
    parts = chunk_rows(whole.where(size > chunk), "key", "text", chunk, overlap).repartition("digest", "no")
    parts = parts.mapInArrow(pieces, f"key {kind}, digest binary, no bigint, copies bigint, ids binary, head_at binary, head_n binary, tail_at binary, tail_n binary")
    far = parts.groupBy("key", "digest").applyInPandas(join, schema + ", _copies bigint")
    far = far.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies"))).drop("_copies")
    return near.unionByName(far).withColumnRenamed("key", key)


def encode(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens, ids binary): ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Rows that repeat a key and a text give as many results; an empty table gives none.
    Other columns are not read. A text may be of any length: a task holds one chunk of it, and in the end its ids.
    """
    return _apply(docs, key, text, rank_file, pattern, lambda c, ids: (len(ids) // 4, ids), [("n_tokens", "bigint", pa.int64()), ("ids", "binary", pa.binary())], chunk, overlap)


def decode(encoded: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes): the raw bytes of the ids, concatenated; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x.as_py() or b"") for x in batch.column(1)], pa.binary())], [key, "bytes"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode, then decode, keeping digests of both; as encode() otherwise."""

    def out(c: Codec, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    fields = [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _apply(docs, key, text, rank_file, pattern, out, fields, chunk, overlap)
