"""Packing documents into sequences: shortest pack first over the histogram of lengths.

A document gives full sequences of the length wanted, and a rest. Only how many rests have each length goes to the driver;
there lengths are placed, the longest first, into the pack with the fewest tokens if they fit, else into a new one. Packs that are
alike are one pattern with a count, so the plan is as large as there are lengths and patterns, however many documents there
are. Then the emptiest packs give way: their rests are cut to fill the room of the others. Each line of the plan holds for the
documents of one length whose rank, among those of that length, lies in an interval; a join by length and rank gives them
their places.
"""

from __future__ import annotations

import heapq
import re
import string
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.shared import materialise

LENGTH, END = 1024, 0
#: Room for fewer tokens than one in SPARE of a sequence isn't filled: that would cut many rests to shreds.
SPARE = 256
#: Units of a text longer than this aren't remembered; a worker remembers so many (about 200 bytes each).
UNIT, KNOWN = 48, 700_000
#: Where texts are cut: a space before anything but white space; whether other spaces are in a text.
_CUT, _ODD = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")
_LINE, _STOPS = re.compile(r"(?<=\S)\n(?=\S)"), string.punctuation


def _byte_signs() -> dict[int, int]:
    """The character that byte-level vocabularies write each byte as: itself where it can be seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip([b for b in range(256) if b not in seen], range(256, 512), strict=False))


_SIGNS = _byte_signs()


def _bytes(ids: list[int]) -> bytes:
    """As unsigned 32-bit integers, little end first."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Encoder:
    """Ids of whole texts by a tokenizer file of byte-level BPE.

    Its pre-tokens begin at a space before anything but white space, so a text may be cut there; a unit that was met
    before isn't encoded again. They also end around a line end between two other characters, and between a letter or digit
    and punctuation, so the lines of a unit, and the stops at the end of a line, are encoded apart.
    """

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        #: Ids of units with the space before them, by what follows it; of parts without one.
        self.tokenizer, self.known, self.bare = Tokenizer.from_file(file), {}, {}
        self.model = self.tokenizer.model
        #: By id, whether it begins with a space.
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith(chr(_SIGNS[32]))]] = True
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Added tokens stand whole wherever they are, so a unit with one isn't cut.
        self.added = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 1000):
            out += [_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)]
        return out

    def _words(self, words: list[str], head: str) -> list[bytes]:
        """Of words with what stands before each: one of letters alone is one pre-token, which goes to the tokenizer's model directly; many with spaces before them are one text, whose ids are cut where one begins with a space."""
        out, rest, model, letters = dict.fromkeys(words, b""), [], self.model, []
        for w in words:
            if not w.isalpha():
                rest.append(w)
            elif head == " ":
                letters.append(w)
            else:
                out[w] = _bytes([t.id for t in model.tokenize((head + w).encode().decode("latin-1").translate(_SIGNS))])
        for at in range(0, len(letters), 1000):
            some = letters[at : at + 1000]
            ids = np.frombuffer(self._encode([" " + " ".join(some)])[0], "<u4")
            ends = [*(4 * np.flatnonzero(self.spaced[ids])).tolist(), 4 * len(ids)]
            whole = ids.tobytes()
            out.update(zip(some, [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)], strict=True))
        out.update(zip(rest, self._encode([head + w for w in rest]), strict=True))
        return [out[w] for w in words]

    def _learn(self, new: set[str]) -> None:
        """Ids of units that aren't known, from those of their parts."""
        made, spaced, bare, tails = [], set(), set(), set()
        for u in new:
            if u.isalpha():
                spaced.add(u)
                continue
            parts = []
            whole = self.added.search(u) is not None
            for i, line in enumerate(_LINE.split(u) if "\n" in u and not whole else (u,)):
                word = line.rstrip(_STOPS)
                if whole or not (word and len(word) < len(line) and word[-1].isalnum()):
                    word = line
                parts.append((i, word, line[len(word) :]))
                if i:
                    if word not in self.bare:
                        bare.add(word)
                elif word not in self.known:
                    spaced.add(word)
                if (tail := parts[-1][2]) and tail not in self.bare:
                    tails.add(tail)
            made.append((u, parts))
        bare |= tails | {"\n"}
        for held, texts, head in ((self.known, list(spaced), " "), (self.bare, list(bare), "")):
            held.update(zip(texts, self._words(texts, head), strict=True))
        known, loose = self.known, self.bare
        for u, parts in made:
            if len(parts) > 1 or parts[0][2]:
                known[u] = b"".join([(loose["\n"] + loose[w] if i else known[w]) + (loose[tail] if tail else b"") for i, w, tail in parts])

    def _units(self, units: list[str]) -> list[bytes]:
        """Of different units, each with the space before it."""
        known = self.known
        got = list(map(known.get, units))
        if new := {u for u, x in zip(units, got, strict=True) if x is None}:
            self._learn(new)
            got = list(map(known.__getitem__, units))
            for u in new:
                if len(u) > UNIT:
                    known.pop(u, None)
        return got

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text, as unsigned 32-bit integers, little end first. Units that are met several times in these texts are looked up once."""
        if not texts:
            return []
        if len(self.known) + len(self.bare) > KNOWN:
            self.known.clear()
            self.bare.clear()
        odd = [i for i, t in enumerate(texts) if _ODD.search(t)]  # cut at fewer places
        even = sorted({*range(len(texts))}.difference(odd))
        kind = pa.large_list(pa.large_string())
        cuts = [pc.split_pattern(pa.array([texts[i] for i in even], pa.large_string()), " ").cast(kind), pa.array([_CUT.split(texts[i]) for i in odd], kind)]
        cut = pa.concat_arrays(cuts)
        ends, flat = cut.offsets.to_numpy(), cut.values
        later = np.ones(len(flat), bool)
        later[ends[:-1]] = False
        units = flat.filter(pa.array(later)).dictionary_encode()
        got = self._units(units.dictionary.to_pylist())
        own = units.indices.to_numpy()
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        begin = np.cumsum(size) - size
        many = size[own]
        upto = np.concatenate([[0], np.cumsum(many)])
        small = np.int32 if max(upto[-1], begin[-1] if len(got) else 0) < 2**31 else np.int64
        ids = np.frombuffer(b"".join(got), "<u4")[np.arange(upto[-1], dtype=small) + np.repeat((begin[own] - upto[:-1]).astype(small), many)]
        of_text = (4 * upto[ends - np.arange(len(ends))]).tolist()  # each text has one part that isn't a unit
        whole = ids.tobytes()
        firsts = self._encode(flat.take(pa.array(ends[:-1])).to_pylist())
        out = dict(zip([*even, *odd], [first + whole[a:b] for first, a, b in zip(firsts, of_text, of_text[1:], strict=False)], strict=True))
        return [out[i] for i in range(len(texts))]


@cache
def encoder(file: str) -> Encoder:
    """One for each worker process."""
    import gc
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    gc.set_threshold(200_000, 20, 20)  # parts of units are many small tuples, none in a cycle
    return Encoder(file)


@dataclass
class Place:
    """Rests of one length, from a rank on, that begin at `at` in their sequences."""

    length: int
    rank: int
    at: int


@dataclass
class Pack:
    """`count` sequences alike."""

    count: int
    fill: int = 0
    places: list[Place] = field(default_factory=list)

    def first(self, k: int) -> Pack:
        """Take k sequences off."""
        head = Pack(k, self.fill, [Place(p.length, p.rank, p.at) for p in self.places])
        self.count -= k
        for p in self.places:
            p.rank += k
        return head


def shortest_first(histogram: dict[int, int], size: int) -> list[Pack]:
    """Packs of whole rests: each length, from the longest, goes into the pack with the fewest tokens, or a new one if it doesn't fit."""
    heap: list[tuple[int, int, Pack]] = []
    made = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            pack = heapq.heappop(heap)[2] if heap and heap[0][0] + length <= size else Pack(left)
            use = min(left, pack.count)
            taken = pack.first(use)
            taken.places.append(Place(length, rank, taken.fill))
            taken.fill += length
            rank, left = rank + use, left - use
            for p in (taken, pack):
                if p.count:
                    made += 1
                    heapq.heappush(heap, (p.fill, made, p))
    return [p for _, _, p in heap]


@dataclass
class Room:
    """`count` stretches of `n` tokens each, from `at` on in sequences that follow each other, the first being `sequence`."""

    n: int
    count: int
    sequence: int
    at: int


#: Rests of a length with a rank from lo up to hi, laid end to end, are the tokens from x on of a stream; its tokens from g0 up to g1 go into stretches of g tokens, the first in `sequence`, all from `at` on.
LINE = "length int, lo bigint, hi bigint, x bigint, g0 bigint, g1 bigint, g int, sequence bigint, at int"


def plan(histogram: dict[int, int], size: int = LENGTH) -> tuple[list[tuple], int]:
    """Lines (see LINE), and the number of sequences.

    The emptiest packs give way: their rests, end to end, fill the room of the others, in the order of both. What is left of
    them makes full sequences, and then shorter ones of a power of two.
    """
    packs = sorted(shortest_first(histogram, size), key=lambda p: -p.fill)
    least = -(-size // SPARE)
    room = sum((size - p.fill) * p.count for p in packs if size - p.fill >= least)
    loose: list[Pack] = []
    while room > 0:
        pack = packs[-1]
        k = min(pack.count, -(-room // size))
        loose.append(pack.first(k))
        room -= k * size  # its own room, and its tokens
        if not pack.count:
            packs.pop()
    lines, sequence, rooms = [], 0, []
    for pack in packs:
        lines += [(p.length, p.rank, p.rank + pack.count, 0, 0, pack.count * p.length, p.length, sequence, p.at) for p in pack.places]
        if size - pack.fill >= least:
            rooms.append(Room(size - pack.fill, pack.count, sequence, pack.fill))
        sequence += pack.count
    left = sum(p.fill * p.count for p in loose) - sum(r.n * r.count for r in rooms)
    n = size
    while left:
        if k := left // n:
            rooms.append(Room(n, k, sequence, 0))
            sequence, left = sequence + k, left - k * n
        n //= 2
    at, i, x = 0, 0, 0
    for p, count in ((p, pack.count) for pack in loose for p in pack.places):
        end = x + p.length * count
        while x < end:
            lines.append((p.length, p.rank, p.rank + count, end - p.length * count, at, at + rooms[i].n * rooms[i].count, rooms[i].n, rooms[i].sequence, rooms[i].at))
            x = min(end, at + rooms[i].n * rooms[i].count)
            if x == at + rooms[i].n * rooms[i].count:
                at, i = x, i + 1
    return lines, sequence


#: Lines of the plan (about 80 bytes each) that are broadcast; more are joined by shuffle. They grow with the lengths there are, not with the documents.
MAX_LINES = 100_000
#: First ranks, one for each task and rest (24 bytes each), and first sequences, one for each task, that are broadcast; of more than some hundred tasks they are joined by shuffle.
MAX_RANKS = 500_000


#: Bytes of text that are encoded at once, besides the last text: of more, a unit met several times is looked up less often.
AT_ONCE = 1 << 22


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in turn, each slice with about AT_ONCE bytes of its second column."""
    upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


def tokens(docs: DataFrame, file: str, key: str, text: str, size: int, end: int) -> DataFrame:
    """(key, part, ids, n, rest, number, whole): ids of each text and the end, how many, what they leave beyond full sequences, the row's number among the rows of its task with that rest, and the full sequences of the task before it."""
    from pyspark import TaskContext

    names = ["key", "part", "ids", "n", "rest", "number", "whole"]
    stop = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(file), TaskContext.get().partitionId()
        seen, whole = np.zeros(size, np.int64), 0
        for batch in batches:
            for some in slices(batch):
                rows = []
                for ids in coder.ids(some.column(1).to_pylist()):
                    ids += stop
                    n = len(ids) // 4
                    rows.append((part, ids, n, n % size, int(seen[n % size]), whole))
                    seen[n % size] += 1
                    whole += n // size
                kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    own = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return own.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, part int, ids binary, n bigint, rest int, number bigint, whole bigint")


def pack(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text", size: int = LENGTH, end: int = END) -> DataFrame:
    """One row a piece: key, start (ids of its document before it), length, ids (32-bit unsigned integers, little end first), doc_tokens, sequence_id, offset.

    The ids of a document are those of its whole text and `end`. Every id lies in one piece, pieces of a sequence follow
    each other without a gap, and a sequence has `size` ids or lacks fewer than one in SPARE of them; only what is left over
    at the end goes into shorter ones, whose lengths are powers of two (at most one of each). `size` is a power of two.

    A null text is empty and gives the end alone. Repeated rows, and rows of a null key, are documents of their own. Texts
    are read whole, however long: a task holds one text and its ids. An empty table gives no rows. Other columns are not read.
    """
    made = materialise(tokens(docs, file, key, text, size, end), "tokens")
    # a row for each task and rest: which rank and which full sequence the task's first ones have
    ranks = made.where("rest > 0").groupBy("part", "rest").count()
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranks = materialise(ranks.select("part", "rest", "count", F.coalesce(F.sum("count").over(before.partitionBy("rest")), F.lit(0)).alias("base")), "ranks")
    lines, packed = plan({r["rest"]: r["n"] for r in ranks.groupBy("rest").agg(F.sum("count").alias("n")).collect()}, size)  # size - 1 rows at most
    spark = docs.sparkSession
    table = spark.createDataFrame(lines, LINE)
    table = F.broadcast(table) if len(lines) <= MAX_LINES else table
    base = ranks.drop("count")
    base = F.broadcast(base) if base.count() <= MAX_RANKS else base
    wholes = made.groupBy("part").agg(F.sum(F.expr(f"n div {size}")).alias("n"))  # a row for each task
    wholes = wholes.select("part", (F.lit(packed) + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first"))
    rest = made.where("rest > 0").join(base, ["part", "rest"]).withColumn("rank", F.col("base") + F.col("number"))
    rest = rest.join(table, (F.col("rest") == F.col("length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    rest = rest.withColumn("x", F.expr("x + (rank - lo) * length")).withColumn("y", F.expr("least(x + length, g1)")).where("x < g1 AND y > g0")
    rest = rest.withColumn("i", F.explode(F.expr("sequence((greatest(x, g0) - g0) div g, (y - 1 - g0) div g)")))
    rest = rest.withColumn("a", F.expr("greatest(x, g0 + i * g)")).withColumn("b", F.expr("least(y, g0 + (i + 1) * g)"))
    rest = rest.select("key", F.expr("n - rest + a - x").alias("start"), F.expr("b - a").alias("length"), "ids", F.col("n").alias("doc_tokens"), F.expr("sequence + i").alias("sequence_id"), F.expr("at + a - g0 - i * g").alias("offset"))
    wholes = F.broadcast(wholes) if wholes.count() <= MAX_RANKS else wholes
    full = made.where(F.col("n") >= size).join(wholes, "part").withColumn("i", F.explode(F.expr(f"sequence(0L, n div {size} - 1)")))
    full = full.select("key", (F.col("i") * size).alias("start"), F.lit(size).cast("bigint").alias("length"), "ids", F.col("n").alias("doc_tokens"), (F.col("first") + F.col("whole") + F.col("i")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    cut = F.expr("substring(ids, cast(4 * start + 1 AS int), cast(4 * length AS int))")
    return rest.unionByName(full).select(F.col("key").alias(key), "start", "length", cut.alias("ids"), "doc_tokens", "sequence_id", "offset")
