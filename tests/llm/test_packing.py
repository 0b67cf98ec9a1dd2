import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing as P
from tessera.llm import queries

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def texts():
    r = random.Random(5)
    out = [None, "", " ", "\n\n  \n", "don't we'll 'r 're", "x" * 900, " " * 700, "a b  c", "<|endoftext|>", "foo <|endoftext|> bar", "foo<|endoftext|>  bar \n<|endoftext|>", "🙂👍🏽 ok", "a  b 　 c d \x85e \x1cf"]
    for _ in range(60):
        out.append("".join(r.choice(["a", "don't", "'re", " ", "  ", " \n ", "\n", "12", "é", "!?", "-", "字", "\t", "word", "🙂", " ", "<|endoftext|>", "​"]) for _ in range(r.randrange(400))))
    return out


def checked(pieces, want, size):
    """Each id in one piece, sequences gapless and nearly full; the number of sequences that aren't."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p["doc_id"]].append(p)
        of_sequence[p["sequence_id"]].append(p)
    assert set(of_doc) == set(want)
    for k, ps in of_doc.items():
        ps.sort(key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in ps) == np.array(want[k], "<u4").tobytes()
        assert [p["start"] for p in ps] == [0, *np.cumsum([p["length"] for p in ps]).tolist()[:-1]]
        assert all(p["length"] > 0 and p["doc_tokens"] == len(want[k]) and len(p["ids"]) == 4 * p["length"] for p in ps)
    short = 0
    for ps in of_sequence.values():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == [0, *np.cumsum([p["length"] for p in ps]).tolist()[:-1]]
        n = sum(p["length"] for p in ps)
        assert n <= size and (size - n < size / P.SPARE or n & (n - 1) == 0)
        short += size - n >= size / P.SPARE
    assert short <= size.bit_length()
    return of_sequence


def test_ids_are_the_librarys():
    coder = P.Encoder(FILE)
    for t in texts() + texts():
        assert np.frombuffer(coder.ids([t or ""])[0], "<u4").tolist() == library_ids(t)[:-1]


def test_memory_of_units_is_bounded(monkeypatch):
    monkeypatch.setattr(P, "KNOWN", 20)
    coder = P.Encoder(FILE)
    for t in texts():
        assert np.frombuffer(coder.ids([t or ""])[0], "<u4").tolist() == library_ids(t)[:-1]
        assert len(coder.known) <= 20 + 2 * len((t or "").split(" "))
    coder.ids(["a " + "x" * 100 + ", b"])
    assert ("x" * 100 + ",") not in coder.known


def test_many_texts_at_once():
    assert [np.frombuffer(x, "<u4").tolist() for x in P.Encoder(FILE).ids([t or "" for t in texts()])] == [library_ids(t)[:-1] for t in texts()]
    assert P.Encoder(FILE).ids([]) == []


def test_ranks_by_shuffle(spark, monkeypatch):
    """The plan and the first ranks joined instead of broadcast."""
    monkeypatch.setattr(P, "MAX_LINES", 0)
    monkeypatch.setattr(P, "MAX_RANKS", 0)
    want = {i: library_ids(t) for i, t in enumerate(texts())}
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id int, text string").repartition(3)
    checked([r.asDict() for r in P.pack(df, FILE, size=64).collect()], want, 64)


def test_stops_at_the_end_of_units():
    coder = P.Encoder(FILE)
    for t in ("a, b. c! d?! e.; ... , .x x., don't. 5, 5. ²! é, 字. e\u0301, _. _, a_., <|endoftext|>, x<|endoftext|>. <|endoftext|>x, (a), 'd, ''s. a's, I'll! x...", "a,\n b. \n c,\t d", "z a.\nB c\nd, e\n\nf g\n<|endoftext|>\nh i***\nj### k'\ns. l\r\nm n\n o\xa0\np"):
        for _ in range(2):
            assert np.frombuffer(coder.ids([t])[0], "<u4").tolist() == library_ids(t)[:-1]


@pytest.mark.parametrize("size", [8, 64, 1024])
def test_packs(spark, size):
    want = {i: library_ids(t) for i, t in enumerate(texts())}
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts())], "doc_id int, text string, rest string, part int").repartition(3)
    got = [r.asDict() for r in P.pack(df, FILE, size=size).collect()]
    checked(got, want, size)


def test_copies_share_one_length(spark):
    """A third of all rows of one text: one length class, still one place each."""
    rows = [(i, "the same text again and again") for i in range(500)] + [(1000 + i, "w " * (i % 90)) for i in range(1000)]
    want = {i: library_ids(t) for i, t in rows}
    got = [r.asDict() for r in P.pack(spark.createDataFrame(rows, "doc_id int, text string").repartition(5), FILE, size=128).collect()]
    checked(got, want, 128)


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id int, text string")
    got = P.pack(df, FILE, size=8).collect()
    assert sum(r["length"] for r in got) == 3 + 3 + 2 + 1
    assert P.pack(spark.createDataFrame([], "doc_id int, text string"), FILE).collect() == []


def expand(lines):
    """What the join does with the lines, by loops."""
    for length, lo, hi, x0, g0, g1, g, sequence, at in lines:
        for r in range(lo, hi):
            x = x0 + (r - lo) * length
            for a, b in ((max(x, g0 + i * g), min(x + length, g1, g0 + (i + 1) * g)) for i in range(max(0, (x - g0) // g), (min(x + length, g1) - 1 - g0) // g + 1)):
                if a < b:
                    i = (a - g0) // g
                    yield length, r, a - x, b - a, sequence + i, at + a - g0 - i * g


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_everything_once(seed):
    r = random.Random(seed)
    size = r.choice([2, 8, 16, 64, 1024])
    histogram = {r.randint(1, size - 1): r.choice([1, 2, 3, 50, 300]) for _ in range(r.randint(0, min(size - 1, 60)))}
    lines, n = P.plan(histogram, size)
    rests, sequences = defaultdict(list), defaultdict(list)
    for length, rank, start, k, sequence, at in expand(lines):
        rests[length, rank].append((start, k))
        sequences[sequence].append((at, k))
    assert set(rests) == {(k, i) for k, c in histogram.items() for i in range(c)} and sorted(sequences) == list(range(n))
    for (length, _), ps in rests.items():
        ps.sort()
        assert [s for s, _ in ps] == [0, *np.cumsum([k for _, k in ps]).tolist()[:-1]] and sum(k for _, k in ps) == length
    for ps in sequences.values():
        ps.sort()
        total = sum(k for _, k in ps)
        assert [a for a, _ in ps] == [0, *np.cumsum([k for _, k in ps]).tolist()[:-1]]
        assert size - total < size / P.SPARE or total & (total - 1) == 0


def test_plan_is_small_however_many_documents():
    h = {i: int(10**9 * math.exp(-((i - 750) ** 2) / 20_000)) + 1 for i in range(1, 1024)}
    lines, n = P.plan(h)
    assert len(lines) < 10_000
    assert sum(k * c for k, c in h.items()) > 0.999 * 1024 * n


def test_longest_goes_first_into_the_shortest_pack():
    packs = P.shortest_first({7: 1, 5: 1, 3: 2, 1: 1}, 8)
    assert sorted((sorted(p.length for p in k.places), k.count) for k in packs) == [([1, 3], 1), ([3, 5], 1), ([7], 1)]


def test_query(spark, sf):
    """The whole table: ids by the library, digests, and padding."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: library_ids(r["text"]) for r in docs}
    got = [r.asDict() for r in queries.op13_packing(spark, sf).collect()]
    for p in got:
        p["ids"] = np.array(want[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes()
        assert p["ids_crc32"] == zlib.crc32(p["ids"])
    of_sequence = checked(got, want, 1024)
    padding = sum(1024 - n for n in (sum(p["length"] for p in ps) for ps in of_sequence.values()) if n & (n - 1))
    assert padding < 0.005 * sum(map(len, want.values()))


def test_units_are_looked_up_once_for_many_texts(monkeypatch):
    """A unit that stands in several texts of a slice is asked for once, and words of letters reach the tokenizer together."""
    coder, asked, sent = P.Encoder(FILE), [], []
    units, encode = coder._units, coder._encode
    monkeypatch.setattr(coder, "_units", lambda x: asked.extend(x) or units(x))
    monkeypatch.setattr(coder, "_encode", lambda x: sent.extend(x) or encode(x))
    given = [f"first{i} " + " ".join(f"wörd{'abcdef'[(i + j) % 6]}" for j in range(50)) + ("  two" if i % 3 else "") for i in range(40)]
    got = coder.ids(given)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library_ids(t)[:-1] for t in given]
    assert len(asked) == len(set(asked)) < 20 and len(sent) < len(given) + 10


def test_slices_hold_all_rows(monkeypatch):
    monkeypatch.setattr(P, "AT_ONCE", 10)
    batch = P.pa.RecordBatch.from_arrays([P.pa.array(range(7)), P.pa.array(["", "abc", "x" * 50, "", "abcdefgh", "ab", ""])], ["key", "text"])
    got = list(P.slices(batch))
    assert [r for b in got for r in b.to_pylist()] == batch.to_pylist() and len(got) > 2
    assert list(P.slices(batch.slice(0, 0))) == []
