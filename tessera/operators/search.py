"""Search over identities: predicates by the shape of the query, and posting tables for fuzzy search."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Boosts of the fields.
BOOSTS = {"name": 3.0, "edge_ngram": 2.0, "soundex": 1.0, "variant": 1.5, "anchor": 5.0, "pincode": 2.0}


def predicate(q: str) -> Column | None:
    """What a query asks for, by its shape: an id, an anchor, a pincode, or part of a name; nothing if empty."""
    if not q:
        return None
    u = q.strip().upper()
    if u.startswith("UBID-"):
        return F.col("ubid") == u
    if (len(u) == 10 and u[:5].isalpha()) or len(u) == 15:
        return F.col("anchor_value") == u
    if len(u) == 6 and u.isdigit():
        return F.col("primary_pincode") == u
    return F.col("primary_name").ilike(f"%{q}%")


def identity_search(masters: DataFrame, statuses: DataFrame, source_records: DataFrame, q: str = "", status: str | None = None, district: str | None = None, limit: int = 20) -> DataFrame:
    """Active identities that match, with status (UNKNOWN if none), score and number of source records, by id."""
    rows, asked = masters.where("status = 'ACTIVE'"), predicate(q)
    rows = rows if asked is None else rows.where(asked)
    if status:
        rows = rows.join(statuses.where(F.col("status") == status).select("ubid"), "ubid", "left_semi")
    if district:
        rows = rows.where(F.col("primary_district").ilike(f"%{district}%"))
    page = rows.orderBy("ubid").limit(limit)
    counts = source_records.groupBy("ubid").agg(F.count("*").alias("source_count"))
    state = statuses.select("ubid", F.col("status").alias("activity_status"), F.col("score").alias("activity_score"))
    out = page.join(state, "ubid", "left").join(counts, "ubid", "left")
    return out.select("ubid", "primary_name", "primary_pincode", "primary_district", F.coalesce("activity_status", F.lit("UNKNOWN")).alias("activity_status"), F.coalesce("activity_score", F.lit(0.0)).alias("activity_score"), F.coalesce("source_count", F.lit(0)).alias("source_count"))


def documents(masters: DataFrame, statuses: DataFrame, source_records: DataFrame, records: DataFrame) -> DataFrame:
    """One search document for each active identity: name, variants, anchor, pincode, district, status, score, number of source records."""
    named = source_records.join(records.select(F.col("id").alias("record_id"), "business_name"), "record_id", "left")
    per = named.groupBy("ubid").agg(F.array_sort(F.collect_set("business_name")).alias("name_variants"), F.count("*").alias("source_record_count"))
    state = statuses.select("ubid", F.col("status").alias("activity"), "score")
    rows = masters.where("status = 'ACTIVE'").join(per, "ubid", "left").join(state, "ubid", "left")
    return rows.select(
        "ubid", "primary_name", F.coalesce("name_variants", F.array().cast("array<string>")).alias("name_variants"), "anchor_type", "anchor_value", "primary_pincode", "primary_district",
        F.coalesce("activity", F.lit("UNKNOWN")).alias("status"), F.coalesce("score", F.lit(0.0)).alias("activity_score"), F.coalesce("source_record_count", F.lit(0)).alias("source_record_count"),
    )


# Letters with marks, and the plain letters that they are searched as.
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"


def words(c: Column) -> Column:
    """Words of plain letters and digits in lower case; letters with marks count as plain ones."""
    folded = F.translate(F.lower(F.coalesce(c, F.lit(""))), MARKED, PLAIN)
    return F.filter(F.split(folded, "[^a-z0-9]+"), lambda t: t != "")


def postings(docs: DataFrame) -> DataFrame:
    """(field, term, ubid): words, edge n-grams of 2 to 15 characters, sounds, variants, anchors and pincodes."""
    name = words(F.col("primary_name"))
    fields = {
        "name": name,
        "edge_ngram": F.flatten(F.transform(name, lambda t: T.edge_ngrams(t))),
        "soundex": F.transform(name, lambda t: F.soundex(t)),
        "variant": F.flatten(F.transform("name_variants", lambda v: words(v))),
        "anchor": F.array(F.upper("anchor_value")),
        "pincode": F.array("primary_pincode"),
    }
    entry = F.flatten(F.array(*[_entries(k, v) for k, v in fields.items()]))
    return docs.select("ubid", F.explode(F.array_distinct(entry)).alias("e")).select("e.field", "e.term", "ubid")


def _entries(field: str, terms: Column) -> Column:
    return F.transform(F.array_compact(terms), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))


def asked_words(q: str) -> list[str]:
    """The distinct words of a query, letters with marks as plain ones."""
    plain = q.lower().translate(str.maketrans(MARKED, PLAIN))
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in plain).split()))


def most_edits(word: str) -> int:
    return 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2


def _met(word: str) -> Column:
    """(word, near) if the posting's term meets the word, else null."""
    edits, field = F.levenshtein("term", F.lit(word), most_edits(word)), F.col("field")
    far = (
        F.when(field.isin("name", "variant") & (edits >= 0), edits)
        .when((field == "edge_ngram") & (F.col("term") == word[:15]), 0)
        .when((field == "soundex") & (F.col("term") == F.soundex(F.lit(word))), 0)
        .when(field.isin("anchor", "pincode") & (F.col("term") == word.upper()), 0)
    )
    return F.when(far.isNotNull(), F.struct(F.lit(word).alias("word"), (1 - far / F.lit(float(len(word)))).alias("near")))


def _hits(postings_: DataFrame, words_: list[str]) -> DataFrame:
    """Postings (field, term, ubid) to (field, term, ubid, word, near) of each word of the query that they meet."""
    each = F.explode(F.array_compact(F.array(*[_met(w) for w in words_])))
    return postings_.select("field", "term", "ubid", each.alias("hit")).select("field", "term", "ubid", "hit.word", "hit.near")


def ranked(hits: DataFrame, docs: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """(ubid, relevance) of all identities that the hits and filters leave. All postings of a term that is met must be among the hits."""
    boost = F.try_element_at(F.create_map(*[F.lit(x) for kv in BOOSTS.items() for x in kv]), F.col("field"))
    known = hits.groupBy("field", "term").agg(F.count_distinct("ubid").alias("n"))
    total = docs.agg(F.count("*").alias("total"))
    rare = F.log1p((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    scored = hits.join(known.join(F.broadcast(total)), ["field", "term"]).select("ubid", "field", "word", (boost * rare * F.col("near")).alias("s"))  # one row
    found = scored.groupBy("ubid", "field", "word").agg(F.max("s").alias("s")).groupBy("ubid", "field").agg(F.sum("s").alias("s")).groupBy("ubid").agg(F.max("s").alias("relevance"))
    rows = docs
    for column, value in (filters or {}).items():
        rows = rows.where(F.col(column) == value)
    return rows.join(found, "ubid").select("ubid", "relevance")


def fuzzy_search(index: DataFrame, docs: DataFrame, q: str, filters: dict[str, str] | None = None, limit: int = 20) -> DataFrame:
    """(ubid, relevance) of identities that one of the query's words meets, the best first.

    Words of names and variants may differ by 0, 1 or 2 edits as the query's word has up to 2, up to 5, or more letters.
    A field's score is the sum over the query's words of the best term met: the field's boost, times how rare the term is
    (ln(1 + (N - n + 0.5) / (n + 0.5)) for n of N identities), less the share of the word's letters that are edited. The
    best field counts. Filters keep the identities with the values given. All postings are read: see lookup().
    """
    words_ = asked_words(q)
    if not words_:
        return docs.limit(0).select("ubid", F.lit(0.0).alias("relevance"))
    return ranked(_hits(index, words_), docs, filters).orderBy(F.desc("relevance"), "ubid").limit(limit)


#: Buckets that terms and keys are dealt out to. A word of ten letters has 56 keys at most, so with many more buckets than that a query reads few of them.
BUCKETS = 256


def bucket(c: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(c.cast("binary")), F.lit(buckets)).cast("int")


def bucketed(postings_: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Postings with the bucket of their term, to be kept in partitions of field and bucket."""
    return postings_.withColumn("bucket", bucket(F.col("term"), buckets))


def term_keys(postings_: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(key, field, term, bucket): distinct terms of names and variants under each of their deletions, to be kept in partitions of bucket, which is that of the key."""
    terms = postings_.where(F.col("field").isin("name", "variant")).select("field", "term").distinct()
    keyed = terms.withColumn("key", F.explode(T.deletions(F.col("term"))))
    return keyed.select("key", "field", "term", bucket(F.col("key"), buckets).alias("bucket"))


def without(word: str, most: int) -> set[str]:
    """The word, and what is left of it without up to `most` of its characters."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def lookup(keys: DataFrame, index: DataFrame, docs: DataFrame, q: str, filters: dict[str, str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The same as fuzzy_search() without a limit or an order, from kept tables: term_keys() by bucket, and bucketed() postings by field and bucket. Only partitions that the query's words can meet are read.

    Which partitions have terms within the edits allowed goes to the driver: at most two fields of `buckets` numbers.
    """
    words_ = asked_words(q)
    if not words_:
        return docs.limit(0).select("ubid", F.lit(0.0).alias("relevance"))
    at = lambda s: zlib.crc32(s.encode()) % buckets
    wanted = sorted(set().union(*[without(w, most_edits(w)) for w in words_]))
    near = keys.where(F.col("bucket").isin(sorted({at(k) for k in wanted})) & F.col("key").isin(wanted)).select("field", "term").distinct()
    met = near.where(F.coalesce(*[_met(w)["near"] for w in words_]).isNotNull())
    places = {(r["field"], r["bucket"]) for r in met.select("field", bucket(F.col("term"), buckets).alias("bucket")).distinct().collect()}
    sounds = index.sparkSession.range(1).select(F.array(*[F.soundex(F.lit(w)) for w in words_])).first()[0]
    places |= {(f, at(t)) for w, sound in zip(words_, sounds, strict=True) for f, t in (("edge_ngram", w[:15]), ("soundex", sound), ("anchor", w.upper()), ("pincode", w.upper()))}
    by_field: dict[str, list[int]] = {}
    for f, b in sorted(places):
        by_field.setdefault(f, []).append(b)
    there = F.lit(False)
    for f, bs in by_field.items():
        there = there | ((F.col("field") == f) & F.col("bucket").isin(bs))
    return ranked(_hits(index.where(there), words_), docs, filters)
