import random

import numpy as np
import xxhash

from tessera.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    v = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return v - (1 << 64) if v >> 63 else v


def components(rows, radius=4):
    fps = [f for _, f in rows]
    low = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            for j in range(i):
                if low[i] != low[j] and ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= radius:
                    low[i] = low[j] = min(low[i], low[j])
                    moved = True
    least = {}
    for (k, _), c in zip(rows, low, strict=True):
        if k is not None:
            least[c] = min(least.get(c, k), k)
    return [least.get(c) for c in low]


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("aBcdé") for _ in range(r.randrange(1, 6)))
    out = ["", None, " \t\n", "one", "One", "a b c", "a b", "x " * 5000]
    for _ in range(40):
        base = [word() for _ in range(r.randrange(3, 120))]
        out.append(" ".join(base))
        for _ in range(r.randrange(4)):
            changed = list(base)
            changed[r.randrange(len(base))] = word()
            out.append("\x0b".join(changed))
    return out


def test_fingerprint():
    for t in texts():
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def check(spark, max_tree, blocks=None):
    rows = [(i if i != 9 else None, t) for i, t in enumerate(texts())]
    rows += rows[:12] + [(7, "one more text of many words here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS fp", "'x' AS component_id", "2 AS root")
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["fp"], x["component_id"]) for x in simhash.near_duplicates(df, max_tree=max_tree, blocks=blocks).collect())
    known = [(k, slow_fingerprint(t)) for k, t in rows]
    want = sorted((k is None, k or 0, f, c) for (k, f), c in zip(known, components(known), strict=True))
    assert got == want


def test_near_duplicates(spark):
    check(spark, simhash.MAX_TREE)


def test_heavy_shards_are_split_without_loss(spark):
    check(spark, 2)


def test_more_blocks_lose_nothing(spark):
    check(spark, simhash.MAX_TREE, 7)
    check(spark, simhash.MAX_TREE, 9)


def test_blocks_grow_with_the_fingerprints():
    assert [simhash.blocks_for(n, 4) for n in (0, 10**6, 10**8, 10**9, 10**10, 10**11)] == [6, 6, 6, 7, 8, 8]


def test_null_keys_alone_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e")], "doc_id bigint, text string")
    assert simhash.near_duplicates(df).collect()[0]["component_id"] is None
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_tree_search_is_exact():
    r = np.random.default_rng(0)
    base = r.integers(-(2**63), 2**63 - 1, 50)
    values = np.unique(np.concatenate([base, *[base ^ (1 << int(b)) for b in r.integers(0, 62, 6)]]))
    tree = simhash.BKTree(values)
    got = {(n, int(q)) for n, near in tree.search(values, 4) for q in near}
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if ((int(values[i]) ^ int(values[j])) & (1 << 64) - 1).bit_count() <= 4}
    assert got == want


def slow_prints(text):
    """The fingerprints of deduplicate(), bit by bit."""
    words = [w.encode() for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    m = (1 << 64) - 1

    def mixed(h, seed):
        h = (h ^ seed) * 0x9E3779B97F4A7C15 & m
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & m
        return h ^ h >> 32

    def print_of(hashes):
        v = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))
        return v - (1 << 64) if v >> 63 else v

    if not words:
        return [0] * 5
    h, k, shingles = [xxhash.xxh64_intdigest(w, 42) for w in words], min(5, len(words)), []
    for i in range(len(words) - k + 1):
        x = 0
        for j in range(k):
            x = mixed(x + h[i + j] & m, j + 1)
        shingles.append(x)
    return [print_of([mixed(x, s) for x in set(h)]) for s in simhash.WORD_SEEDS] + [print_of([mixed(x, s) for x in shingles]) for s in simhash.CHECK_SEEDS]


def linked(a, b):
    far = [((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True)]
    return min(far[:3]) <= simhash.RADIUS and far[3] + far[4] <= simhash.WITHIN


def groups(texts_):
    prints = [slow_prints(t) for t in texts_]
    low = list(range(len(texts_)))
    for i in range(len(low)):
        for j in range(i):
            if low[i] != low[j] and linked(prints[i], prints[j]):
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    return low


def kept_rows(rows):
    """(key, text) that stay if no component holds a key twice: each component's smallest key."""
    best = {}
    for (k, t), c in zip(rows, groups([t for _, t in rows]), strict=True):
        best[c] = min(best.get(c, (k, t)), (k, t))
    return list(best.values())


def copies_and_others():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    out = []
    for _ in range(30):
        base = [word() for _ in range(r.randrange(1, 200))]
        out.append(" ".join(base))
        for _ in range(r.randrange(4)):
            changed = [word() if r.random() < 0.015 else w for w in base]
            out.append("\n".join(changed).upper() if r.random() < 0.3 else " ".join(changed))
    return out + ["", None, " "]


def test_word_prints():
    for t in copies_and_others() + texts():
        assert sum(simhash.word_prints(t), []) == slow_prints(t)


def test_deduplicate_against_brute_force(spark):
    """Whatever the shards' size: exactly one row of each component, also where keys repeat, are null, or stand on unlike texts."""
    r = random.Random(9)
    rows = [(r.choice([None, *range(25)]), t, r.choice(["x", None])) for t in copies_and_others()]
    rows += [*rows[:9], (1, "A text about one thing alone", "y"), (1, "B which is about quite another", "y"), (2, "C and this is a third one", "y"), (3, "B which is about quite another", "y")]
    want = {}
    for row, c in zip(rows, groups([t for _, t, _ in rows]), strict=True):
        want.setdefault(c, []).append(row)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, content_hash string")
    for most, tree in ((simhash.MAX_BROADCAST, simhash.MAX_TREE), (0, 2)):
        got = [tuple(x) for x in simhash.deduplicate(df, max_tree=tree, max_broadcast=most).collect()]
        assert len(got) == len(want)
        for members in want.values():
            (one,) = [x for x in got if x in members]
            keys = [k for k, *_ in members if k is not None]
            assert one[0] == min(keys, default=None)


def test_deduplicate_named_cases(spark):
    a, b, c = "A text about one thing alone", "B which is about quite another", "C and this is a third one"
    df = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    texts_of = lambda rows: sorted(x["text"] or "" for x in simhash.deduplicate(df(rows)).collect())
    assert texts_of([(1, a), (1, b), (2, c), (3, b)]) == [a, b, c]
    assert texts_of([(1, None), (1, "abc")]) == ["", "abc"]
    assert texts_of([(None, a), (None, a), (None, None)]) == ["", a]
    assert simhash.deduplicate(df([(1, a)]).where("false")).count() == 0


def test_copies_of_similarity_80_are_found():
    r = random.Random(10)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    found = []
    while len(found) < 300:
        base = [r.choice(vocabulary) for _ in range(r.randrange(60, 500))]
        other = [r.choice(vocabulary) if r.random() < 0.015 else w for w in base]
        one, two = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, other))
        if len(one & two) >= 0.8 * len(one | two):
            x, y = (sum(simhash.word_prints(" ".join(t)), []) for t in (base, other))
            found.append(linked(x, y))
    assert np.mean(found) >= 0.9
