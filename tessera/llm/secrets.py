"""Secret scans by a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query. The index holds a posting (trigram, text hash) for each
distinct text and each trigram that some query asks for. Postings are intersected for each alternative of a rule's query;
the texts that are left are the rule's candidates, and the expression is run on them alone. A rule without mandatory
trigrams scans all texts. A posting names a text by its 64-bit hash, so copies share postings, and a hash collision
only adds a candidate that the expression then rejects.

A text is first asked for one trigram of each clause, and for the rest only where that one stands. The candidates (16 bytes each) are
broadcast while they are at most MAX_BROADCAST; beyond that they are joined by shuffle. Places come from running totals in
blocks, so a text of very many matches costs in proportion to them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh
from tessera.llm.trigrams import trigram_query
from tessera.plans.shared import materialise

MAX_BROADCAST = 1_000_000


@dataclass(frozen=True)
class Rule:
    """A match of `pattern` counts if its `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int


BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
]
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]
RULES = BASE + MORE
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,first:bigint,last:bigint>>"
#: Elements that a running total adds up one by one.
BLOCK = 32


def leads(clauses: list[frozenset[str]]) -> dict[frozenset[str], str]:
    """A trigram of each clause, as few different ones as a greedy choice takes."""
    out: dict[frozenset[str], str] = {}
    while left := [c for c in clauses if c not in out]:
        best = max(sorted(set().union(*left)), key=lambda g: sum(g in c for c in left))
        out |= {c: best for c in left if best in c}
    return out


def postings(texts: DataFrame, text: str, clauses: list[frozenset[str]], grams: list[str]) -> DataFrame:
    """The index: distinct (gram, h), with gram as its place in the list and h as the text's hash.

    A trigram is looked for only in texts that have the lead of a clause that asks for it: in others its posting could
    meet nothing.
    """
    first = leads(clauses)
    columns = {g: F.col(f"lead{i}") for i, g in enumerate(sorted(set(first.values())))}
    low = texts.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.lower(text).alias("low"))
    led = low.select("h", "low", *[F.contains("low", F.lit(g)).alias(f"lead{i}") for i, g in enumerate(columns)])
    found = []
    for i, g in enumerate(grams):
        asked = {first[c] for c in clauses if g in c}
        any_lead = reduce(lambda a, b: a | b, [columns[x] for x in sorted(asked)])
        found.append(F.when(columns[g] if g in asked else any_lead & F.contains("low", F.lit(g)), F.lit(i)))
    return led.where(reduce(lambda a, b: a | b, columns.values())).select("h", F.explode(F.array_compact(F.array(*found))).alias("gram")).distinct()


def candidates(texts: DataFrame, text: str, rules: list[Rule]) -> tuple[DataFrame | None, dict[str, int]]:
    """(h, mask): hashes of the texts that some rule's query admits, with a bit for each such rule; the bits by kind. Rules that scan fully have no bit."""
    queries = {r.kind: q for r in rules if all(q := trigram_query(r.pattern))}
    if not queries:
        return None, {}
    grams = sorted({g for q in queries.values() for alternative in q for g in alternative})
    bits = {kind: i for i, kind in enumerate(queries)}
    clauses = [(bits[kind], n, len(alternative), grams.index(g)) for kind, q in queries.items() for n, alternative in enumerate(q) for g in sorted(alternative)]
    asked = F.broadcast(texts.sparkSession.createDataFrame(clauses, "bit int, alternative int, needs int, gram int"))
    meet = postings(texts, text, [c for q in queries.values() for c in q], grams).join(asked, "gram").groupBy("h", "bit", "alternative", "needs").count().where("count = needs")
    return meet.groupBy("h").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask")), bits


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def before(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element of an array, what op makes of all that stand before it: in blocks, and blocks of blocks, each of which is totalled once."""
    total = lambda a: F.aggregate(a, zero, lambda x, y: op(x, y))
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: total(F.slice(a, i + 1, F.lit(BLOCK))))
    own = lambda a, i: total(F.slice(a, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
    within = lambda a, over: F.transform(a, lambda _, i: op(F.get(over, F.floor(i / BLOCK).cast("int")), own(a, i)))
    whole = lambda a: F.transform(a, lambda _, i: total(F.slice(a, F.lit(1), i)))
    return _let(blocks(values), lambda one: _let(blocks(one), lambda two: _let(_let(whole(two), lambda top: within(one, top)), lambda mid: within(values, mid))))


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in a text, from the lengths of what lies between the matches and of the matches themselves, in code points and in bytes."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    both = lambda x: F.shiftleft(F.char_length(x).cast("bigint"), 32) + F.octet_length(x)
    chars, octets = (lambda x: F.shiftright(x, 32)), (lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)))
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), judged.alias("part"))
    sizes = F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), lambda x: F.struct(both(x["gap"]).alias("gap"), both(x["hit"]).alias("hit"), F.char_length(x["part"]).alias("part")))

    def spans(sized: Column) -> Column:
        lengths = F.transform(sized, lambda x: x["gap"] + x["hit"])
        starts = _let(lengths, lambda v: before(v, lambda a, b: a + b, F.lit(0).cast("bigint")))

        def span(x: Column, at: Column) -> Column:
            a, b = at + x["gap"], at + x["gap"] + x["hit"]
            found = F.struct(chars(a).alias("start"), F.lit(rank).alias("rank"), chars(b).alias("end"), F.lit(rule.kind).alias("kind"), octets(a).alias("first"), octets(b).alias("last"))
            return F.when(x["part"] >= rule.least, found)

        return F.array_compact(F.zip_with(sized, starts, span))

    return _let(sizes, spans)


def find(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, max_broadcast: int = MAX_BROADCAST) -> tuple[DataFrame, str]:
    """All rows and columns of docs, and a column of spans: array of (start, rank, end, kind, first, last), sorted by start, then by the rules' order.

    Places are code points, ends are exclusive; first and last are the same in bytes of UTF-8. Each rule finds leftmost matches that don't overlap; spans of different
    rules may. A null or empty text has no spans. Repeated rows are kept; an empty table gives an empty one. The new
    column's name is returned, as docs may have one called `spans`.
    """
    spans, h, mask = fresh(docs, "spans", "text_hash", "rule_mask")
    found, bits = candidates(docs.select(text), text, rules)
    rows = docs
    if found is not None:
        found = materialise(found, "candidates").select(F.col("h").alias(h), F.col("mask").alias(mask))
        found = F.broadcast(found) if found.count() <= max_broadcast else found
        rows = docs.withColumn(h, F.xxhash64(text)).join(found, h, "left")
    each = []
    for rank, rule in enumerate(rules):
        may = F.col(mask).bitwiseAND(F.lit(1 << bits[rule.kind])) != 0 if rule.kind in bits else F.lit(True)
        each.append(F.when(may & F.col(text).rlike(rule.pattern), _matches(F.col(text), rule, rank)).otherwise(F.array().cast(SPAN)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.array_sort(F.concat(*each)).alias(spans)), spans


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans): counts of the base rules, a digest of their spans, all spans."""
    found, spans = find(docs.select(key, text), text, rules)
    base = F.filter(F.col(spans), lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("bigint")
    counts = [count(r.kind).alias(f"n_{r.kind}") for r in BASE]
    return found.select(key, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col(spans)).alias("spans"))


def redact(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The rows and columns of docs; each secret in the text, with those that it overlaps, gives way to one mark.

    A null text stays null, an empty one empty; repeated rows are kept, and an empty table gives an empty one.
    """
    found, spans = find(docs, text, rules)

    def clean(all_: Column, raw: Column) -> Column:
        part = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
        ends = F.transform(all_, lambda s: s["last"])
        reached = _let(ends, lambda v: before(v, F.greatest, F.lit(0).cast("bigint")))
        # a secret that starts within an earlier one is under that one's mark
        pieces = F.zip_with(all_, reached, lambda s, at: F.when(s["first"] >= at, F.concat(part(at, s["first"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), part(F.array_max(ends), F.length(raw)))

    # the bytes are made once: a cast within the pieces would copy the whole text for each
    marked = _let(F.col(text).cast("binary"), lambda raw: _let(F.col(spans), lambda all_: clean(all_, raw)))
    made = F.when(F.size(spans) > 0, marked).otherwise(F.col(text))
    return found.select(*[made.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def _span_sql(rule: Rule, rank: int) -> str:
    quoted = rule.pattern.replace("'", "''")
    hits = f"regexp_extract_all(t, '{quoted}')"
    judged = f"regexp_extract_all(t, '{quoted}', {rule.group})"
    return f"""list_filter(list_transform(range(1, len({hits}) + 1), lambda i: {{
      's': list_sum(list_transform(g{rank}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({hits}[1:i - 1], lambda x: length(x))), 0),
      'r': {rank},
      'e': list_sum(list_transform(g{rank}[1:i], lambda x: length(x))) + list_sum(list_transform({hits}[1:i], lambda x: length(x))),
      'k': '{rule.kind}', 'n': length({judged}[i])}}), lambda x: x.n >= {rule.least})"""


def oracle_sql() -> str:
    """DuckDB's SQL for digest() over documents."""
    gaps = ", ".join(f"string_split_regex(t, '{r.pattern.replace(chr(39), chr(39) * 2)}') AS g{i}" for i, r in enumerate(RULES))
    every = ", ".join(_span_sql(r, i) for i, r in enumerate(RULES))
    say = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda s: s.k || ':' || CAST(s.s AS BIGINT) || ':' || CAST(s.e AS BIGINT)), ','), '')"
    counts = ", ".join(f"CAST(len(list_filter(a, lambda s: s.k = '{r.kind}')) AS BIGINT) AS n_{r.kind}" for r in BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT doc_id, t, {gaps} FROM d),
    f AS (SELECT doc_id, list_sort(flatten([{every}])) AS a FROM g)
    SELECT doc_id, {counts}, sha256({say(f"list_filter(a, lambda s: s.r < {len(BASE)})")}) AS base_sha256, {say("a")} AS spans FROM f"""
