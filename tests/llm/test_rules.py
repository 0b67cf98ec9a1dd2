import math
import random
import re
from collections import Counter

import duckdb
import pytest

from tessera.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts():
    r = random.Random(9)
    words = ["the", "of", "Ünder", "x*y", "a|b", "<b>", "zebra", "and", "on", "字", "1.5"]
    out = ["", None, " \n\t", "one", "a b c d e a b c d e", "same\nsame\nsame\n\n \n \nother", "x " * 4000]
    return out + ["".join(r.choice(words) + r.choice([" ", "\n", "\x0b", "  ", "\t"]) for _ in range(r.randrange(300))) for _ in range(60)]


def test_base_counts():
    for t in texts():
        assert rules.base_counts((t or "").encode())[:5] == base(t)


def jensen_shannon(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    return math.sqrt(max(0, (part(p) + part(q)) / 2))


def classes(text):
    out = [0] * 11
    for c in text:
        k = "other" if ord(c) > 127 else "control" if ord(c) < 32 and c not in " \t\n\r" or ord(c) == 127 else "blank" if c in " \t" else "line" if c in "\n\r" else "stop" if c in ".,;:!?" else "quote" if c in "'\"()[]{}`-" else "digit" if c.isdigit() else "upper" if c.isupper() else "vowel" if c in "aeiouy" else "consonant" if c.isalpha() else "symbol"
        out[rules.CLASSES.index(k)] += 1
    return out


def test_judge_matches_brute_force(spark):
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts() * 3)] + [(None, "the of and " * 20, "rare"), (4, texts()[4], "en"), (4, texts()[4], "en"), (900, "SHOUT!! " * 90, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS words", "2 AS kept", "3 AS classes").repartition(3)
    got = sorted(rules.judge(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    hist, counts = {}, {}
    for _, t, g in rows:
        hist[g] = [a + b for a, b in zip(hist.get(g, [0] * 11), classes(t or ""), strict=True)]
        counts.setdefault(g, Counter()).update(w.encode().lower() for w in WORD.findall(t or ""))
    assert len(got) == len(rows)
    for r, (k, t, g) in zip(got, sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        n = base(t)
        assert (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (k, *n)
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        by_class = by_word = None
        if len(t or "") >= rules.MIN_CHARS and sum(hist[g]) >= rules.EVIDENCE_CHARS:
            by_class = jensen_shannon([x / len(t) for x in classes(t)], [x / sum(hist[g]) for x in hist[g]])
        if n[0] >= rules.MIN_WORDS and counts[g].total() >= rules.EVIDENCE_WORDS:
            common = sorted(w for w, c in counts[g].items() if c >= rules.COMMON * counts[g].total())
            own = Counter(w.encode().lower() for w in WORD.findall(t))
            p, q = [own[w] / n[0] for w in common], [counts[g][w] / counts[g].total() for w in common]
            by_word = jensen_shannon([*p, max(0, 1 - sum(p))], [*q, max(0, 1 - sum(q))])
        assert r["class_distance"] == (None if by_class is None else pytest.approx(by_class, abs=1e-6))
        assert r["word_distance"] == (None if by_word is None else pytest.approx(by_word, abs=1e-6))
        limit = rules.MAX_CLASS_DISTANCE + (rules.STRAY * (len(t) ** -0.5 - rules.STEADY**-0.5) if 0 < len(t or "") < rules.STEADY else 0)
        assert r["kept"] == (not r["base_failed"] and (by_class or 0) <= limit and (by_word or 0) <= rules.MAX_WORD_DISTANCE)


def test_the_list_of_words_is_bounded_and_holds_all_common_ones(spark):
    r = random.Random(3)
    rows = [(" ".join(f"w{int(r.paretovariate(0.5))}" for _ in range(400)), g) for g in ("en", None) for _ in range(60)] + [("only a few words", "rare")] * 3
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    got = rules.common_candidates(df, "text", "lang")
    assert len(got) <= 2 * 2 / rules.COMMON
    for g in ("en", None):
        counts = Counter(w for t, x in rows if x == g for w in t.split())
        assert {w for w, n in counts.items() if n >= rules.COMMON * counts.total()} <= set(got)


def test_empty_table(spark):
    assert rules.judge(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0


def test_base_against_sql(spark, sf):
    """The base columns of all documents, in DuckDB's SQL."""
    sql = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM w, range(1, len(w) - 3) r(i)), twice AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
        hit AS (SELECT DISTINCT doc_id, i + k AS at FROM win JOIN twice USING (doc_id, g), range(5) o(k)), rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)"""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(sql).fetchall()}
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == want
