"""Identities: assignment, merges, reversals, and chains of deprecated ids.

Assigning ids one record after another has a closed form over a fixed record order (two minima), and the merges of linked
ids are the components of their graph; only which id survives depends on the order of the pairs, which is replayed inside
each component.
"""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import blocking
from tessera.operators.components import connected_components
from tessera.plans.shared import materialise


def internal_id(key: Column) -> Column:
    return F.concat(F.lit("UBID-INT-"), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 12)))


def _anchors(p: str, g: str, key: str) -> Column:
    """The same for two rows of the same anchors; a row without any has the text of its key, so such rows don't meet in one task."""
    given = F.when(F.col(p).isNotNull() | F.col(g).isNotNull(), F.to_json(F.struct(F.col(p).alias("p"), F.col(g).alias("g")), {"ignoreNullFields": "false"}))
    return F.coalesce(given, F.col(key).cast("string"))


def assign(norm: DataFrame, existing: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """Normalised records (id, valid_pan, valid_gstin) in order of id to (id, ubid), and their columns in `keep`.

    A record joins the GSTIN's identity if there is one, else the PAN's, else it founds one (by GSTIN, then PAN, then an
    internal id). `existing` are masters (ubid, anchor_type, anchor_value, status): active ones come before all records; a
    deprecated one blocks its id, so a record that would found it gets an internal one, which no other record joins.

    Who founds what is told from the first record of each PAN and GSTIN that stand together; these are written, and all
    records look theirs up, so copies of a record are shuffled nowhere unless there are many different anchors. Records are
    read twice.
    """
    given = norm.select("id", F.col("valid_pan").alias("p"), F.col("valid_gstin").alias("g"), *(keep or []))
    rows = given.where("p IS NOT NULL OR g IS NOT NULL").groupBy("p", "g").agg(F.min("id").alias("id")).select("id", "p", "g", F.lit(1).alias("late"))
    free_p = free_g = F.lit(True)
    if existing is not None:
        old, gone = existing.where("status = 'ACTIVE'"), existing.where("status <> 'ACTIVE'")
        anchor = lambda kind: F.when(F.col("anchor_type") == kind, F.col("anchor_value"))
        no_id = F.lit(None).cast(norm.schema["id"].dataType)
        rows = rows.unionByName(old.select(no_id.alias("id"), anchor("PAN").alias("p"), anchor("GSTIN").alias("g"), F.lit(0).alias("late")).where("p IS NOT NULL OR g IS NOT NULL"))
        for c, prefix in (("p", "UBID-PAN-"), ("g", "UBID-GST-")):
            taken = gone.where(F.col("ubid").startswith(prefix)).select(F.col("ubid").substr(F.lit(len(prefix) + 1), F.length("ubid")).alias(c), F.lit(True).alias(f"gone_{c}"))
            rows = rows.join(taken.distinct(), c, "left")
        free_p, free_g = ((F.col("late") == 0) | F.col(f"gone_{c}").isNull() for c in "pg")
    at = F.struct("late", "id")
    first_p = rows.where(F.col("p").isNotNull() & F.col("g").isNull() & free_p).groupBy("p").agg(F.min(at).alias("first_p"))
    rows = rows.join(first_p, "p", "left")
    founders = rows.where(F.col("g").isNotNull() & free_g & (F.col("first_p").isNull() | (F.col("first_p") > at)))
    rows = rows.join(founders.groupBy("g").agg(F.min(at).alias("first_g")), "g", "left").where("late = 1")
    firsts = materialise(rows.select(_anchors("p", "g", "id").alias("_anchors"), "first_p", "first_g"), "anchors")
    rows = given.withColumn("_anchors", _anchors("p", "g", "id")).join(firsts, "_anchors", "left")
    at = F.struct(F.lit(1).alias("late"), "id")
    by_g, by_p = F.coalesce(F.col("first_g") <= at, F.lit(False)), F.coalesce(F.col("first_p") <= at, F.lit(False))
    founded = F.when(by_g, F.concat(F.lit("UBID-GST-"), "g")).when(by_p, F.concat(F.lit("UBID-PAN-"), "p"))
    return rows.select("id", F.coalesce(founded, internal_id(F.col("id"))).alias("ubid"), *(keep or []))


def masters(norm: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row an identity, with the fields of its first record."""
    rows = norm.join(assigned, "id")
    first = rows.groupBy("ubid").agg(F.min_by(F.struct("business_name", "address_locality", "address_city", "address_pincode", "address_district"), "id").alias("r"), F.count("*").alias("n_records"))
    kind = F.when(F.col("ubid").startswith("UBID-GST-"), "GSTIN").when(F.col("ubid").startswith("UBID-PAN-"), "PAN").otherwise("INTERNAL")
    value = F.when(kind != "INTERNAL", F.col("ubid").substr(F.lit(10), F.length("ubid")))
    address = F.concat_ws(", ", F.coalesce("r.address_locality", F.lit("")), F.coalesce("r.address_city", F.lit("")))
    return first.select("ubid", kind.alias("anchor_type"), value.alias("anchor_value"), F.col("r.business_name").alias("primary_name"), address.alias("primary_address"), F.col("r.address_pincode").alias("primary_pincode"), F.col("r.address_district").alias("primary_district"), F.lit("ACTIVE").alias("status"), F.lit(None).cast("string").alias("deprecated_by_ubid"), "n_records")


def _first_links(linked: DataFrame, placed: DataFrame) -> DataFrame:
    """Linked pairs of classes with the records, structs a and b (id, ubid, phone_key), that may be the first to link their identities. `placed`: (first, id, ubid), and phone_key if classes hold phones."""
    by_phone = "same_phone" in linked.columns
    ends = linked.select("record_a_id", "record_b_id", "score", "same_phone" if by_phone else F.lit(False).alias("same_phone"))
    rows = placed if by_phone else placed.withColumn("phone_key", F.lit(None).cast("string"))
    per = rows.groupBy("first", "ubid", "phone_key").agg(F.min("id").alias("id"))
    two = per.withColumn("_n", F.row_number().over(Window.partitionBy("first", "ubid").orderBy("id"))).where("_n <= 2")
    side = lambda rows, s, *also: rows.select(F.col("first").alias(f"record_{s}_id"), F.struct("id", "ubid", "phone_key").alias(s), *also)
    some = per.where("phone_key IS NOT NULL")
    alike = ends.where("same_phone").join(side(some, "a", "phone_key"), "record_a_id").join(side(some, "b", "phone_key"), ["record_b_id", "phone_key"])
    apart = ends.where("NOT same_phone").join(side(two, "a"), "record_a_id").join(side(two, "b"), "record_b_id").where("NOT coalesce(a.phone_key = b.phone_key, false)")
    return alike.select("a", "b", "score").unionByName(apart.select("a", "b", "score")).where("a.ubid <> b.ubid")


def ubid_links(scored: DataFrame, assigned: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """AUTO_LINK pairs of records as pairs of different identities: (ubid_a, ubid_b, score, record_a_id, record_b_id).

    With `members` (first, id), `scored` are pairs of classes of equal records; `assigned` may have `first` itself. Of each two identities only the link that
    comes first then is given: the replay merges by it or has them in one already, and skips all others. In a class the
    first record of an identity is what its first links have. Where a row says whether its pairs share a phone, it's the
    first record of the phone, or, of two that don't, one of the first two whose phones differ.
    """
    if members is not None or "first" in assigned.columns:
        linked = scored.where("decision = 'AUTO_LINK'")
        rows = _first_links(linked, assigned if members is None else members.join(assigned, "id"))
        x, y = F.least("a", "b"), F.greatest("a", "b")
        at = F.struct((-F.col("score")).alias("down"), x.getField("id").alias("record_a_id"), y.getField("id").alias("record_b_id"), x.getField("ubid").alias("ubid_a"), y.getField("ubid").alias("ubid_b"), "score")
        first = rows.groupBy(F.least("a.ubid", "b.ubid"), F.greatest("a.ubid", "b.ubid")).agg(F.min(at).alias("at"))
        return first.select("at.ubid_a", "at.ubid_b", "at.score", "at.record_a_id", "at.record_b_id")
    a, b = assigned.select(F.col("id").alias("record_a_id"), F.col("ubid").alias("ubid_a")), assigned.select(F.col("id").alias("record_b_id"), F.col("ubid").alias("ubid_b"))
    rows = scored.where("decision = 'AUTO_LINK'").join(a, "record_a_id").join(b, "record_b_id")
    return rows.where("ubid_a <> ubid_b").select("ubid_a", "ubid_b", "score", "record_a_id", "record_b_id")


#: Links of a component that one task sees at first.
LINKS_A_TASK = 50_000


def _forest(rows: DataFrame, most: int = LINKS_A_TASK) -> DataFrame:
    """Of components of over `most` links, those that can merge anything: parts of such a component go without the links whose ends stronger links of their part connect already. The replay skips these too, so nothing changes but the size of what it gets: a few links for each identity."""
    sizes = rows.groupBy("component").count().where(F.col("count") > most)
    large = materialise(sizes.select("component", F.ceil(F.col("count") / most).alias("parts")), "large")
    if large.isEmpty():
        return rows

    def strongest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "record_a_id", "record_b_id"], ascending=[False, True, True], kind="stable")
        up: dict[str, str] = {}

        def root(u: str) -> str:
            while (v := up.get(u, u)) != u:
                up[u] = up.get(v, v)
                u = v
            return u

        keep = []
        for a, b in zip(pdf["ubid_a"], pdf["ubid_b"], strict=True):
            x, y = root(a), root(b)
            keep.append(x != y)
            up[y] = x
        return pdf[keep]

    schema = rows.schema
    part = F.pmod(F.xxhash64("record_a_id", "record_b_id"), F.col("parts"))
    cut = rows.join(F.broadcast(large), "component").withColumn("part", part).groupBy("component", "part").applyInPandas(lambda pdf: strongest(pdf)[schema.names], schema)
    return rows.join(F.broadcast(large), "component", "left_anti").unionByName(cut)


def merge(links: DataFrame, counts: DataFrame) -> DataFrame:
    """Links (score, then records decide the order) and records an identity (ubid, n_records) to merges in order: component, step, winner, loser, score, record_a_id, record_b_id. The side with more records wins, side a if equal."""
    links = materialise(links, "links")
    roots = connected_components(links, "ubid_a", "ubid_b")
    n = counts.select("ubid", "n_records")
    rows = links.join(roots.select(F.col("node").alias("ubid_a"), F.col("root").alias("component")), "ubid_a")
    rows = rows.join(n.select(F.col("ubid").alias("ubid_a"), F.col("n_records").alias("n_a")), "ubid_a", "left").join(n.select(F.col("ubid").alias("ubid_b"), F.col("n_records").alias("n_b")), "ubid_b", "left")

    rows = _forest(rows)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "record_a_id", "record_b_id"], ascending=[False, True, True], kind="stable")
        size = dict(zip(pdf["ubid_a"], pdf["n_a"].fillna(0), strict=True)) | dict(zip(pdf["ubid_b"], pdf["n_b"].fillna(0), strict=True))
        up = {u: u for u in size}

        def active(u: str) -> str:
            while up[u] != u:
                up[u] = up[up[u]]
                u = up[u]
            return u

        out = []
        for r in pdf.itertuples(index=False):
            a, b = active(r.ubid_a), active(r.ubid_b)
            if a == b:
                continue
            winner, loser = (a, b) if size[a] >= size[b] else (b, a)
            size[winner] += size[loser]
            up[loser] = winner
            out.append((r.component, len(out), winner, loser, r.score, r.record_a_id, r.record_b_id))
        return pd.DataFrame(out, columns=["component", "step", "winner", "loser", "score", "record_a_id", "record_b_id"])

    kind = links.schema["record_a_id"].dataType.simpleString()
    done = rows.groupBy("component").applyInPandas(replay, f"component string, step int, winner string, loser string, score double, record_a_id {kind}, record_b_id {kind}")
    return done.withColumn("merge_id", F.sha2(F.concat_ws("|", "winner", "loser", F.col("score").cast("string")), 256))


def apply_merges(all_masters: DataFrame, merges: DataFrame) -> DataFrame:
    """The next snapshot of masters: losers are deprecated and name their winner."""
    lost = merges.groupBy(F.col("loser").alias("ubid")).agg(F.max_by("winner", "step").alias("winner"))
    rows = all_masters.join(lost, "ubid", "left")
    return rows.withColumns({"status": F.when(F.col("winner").isNotNull(), "DEPRECATED").otherwise(F.col("status")), "deprecated_by_ubid": F.coalesce("winner", "deprecated_by_ubid")}).drop("winner")


def active_of(all_masters: DataFrame) -> DataFrame:
    """(ubid, active_ubid): the end of each chain of deprecations. Pointers are doubled until none moves; a chain that comes back to itself stops at its first member, in order of ids, that it meets again."""
    links = materialise(all_masters.where("deprecated_by_ubid IS NOT NULL AND status <> 'ACTIVE'").groupBy("ubid").agg(F.min("deprecated_by_ubid").alias("to")), "chain")
    rounds = 0
    while True:
        ahead = links.select(F.col("ubid").alias("to"), F.col("to").alias("far"))
        nxt = materialise(links.join(ahead, "to", "left").select("ubid", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "chain")
        rounds += 1
        moved = not nxt.where("moved").isEmpty()
        links = nxt.select("ubid", "to")
        if not moved or rounds > 40:  # 2 ** 40 steps: only a cycle is left
            break
    return all_masters.select("ubid").join(links, "ubid", "left").select("ubid", F.coalesce("to", "ubid").alias("active_ubid"))


def repoint(source_records: DataFrame, all_masters: DataFrame) -> DataFrame:
    """Source records follow their identity's chain to the active one."""
    return source_records.join(active_of(all_masters), "ubid", "left").withColumn("ubid", F.coalesce("active_ubid", "ubid")).drop("active_ubid")


def reverse(all_masters: DataFrame, merges: DataFrame, merge_id: str, reason: str, by: str, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Undo one merge: (masters, merges, the reversal row). Source records stay with the winner. Raises ValueError if there's no such merge or it is reversed already."""
    row = merges.where(F.col("merge_id") == merge_id).select("loser", "reversed").first()
    if row is None:
        raise ValueError(f"no merge {merge_id}")
    if row["reversed"]:
        raise ValueError(f"merge {merge_id} is reversed already")
    hit = F.col("ubid") == row["loser"]
    back = all_masters.withColumns({"status": F.when(hit, "ACTIVE").otherwise(F.col("status")), "deprecated_by_ubid": F.when(~hit, F.col("deprecated_by_ubid"))})
    after = merges.withColumn("reversed", F.when(F.col("merge_id") == merge_id, True).otherwise(F.col("reversed")))
    values = (f"REV-{merge_id[:16]}", merge_id, reason, by, now)
    reversal = all_masters.sparkSession.createDataFrame([values], "reversal_id string, merge_id string, reason string, reversed_by string, reversed_at timestamp")
    return back, after, reversal


def resolve(norm: DataFrame, pairs: DataFrame, held_masters: DataFrame, held_sources: DataFrame, earlier: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One run over kept state: (created masters, merges, all masters, source records).

    A record whose source key (source_system, source_record_id) is held keeps its identity, whatever made it what it is:
    merges of reviewers stay, and so do reversals, as a reversed merge leaves its records with the winner. Other records are
    assigned after the identities there are. AUTO_LINK pairs merge only where their records' identities still differ, so the
    links, their components and the replay are those of what has changed. `earlier` are all merges so far (winner, loser):
    a merge of the same two gets an id of its own. `pairs` and `members` are those of ubid_links().
    """
    key = ["source_system", "source_record_id"]
    known = held_sources.groupBy(*key).agg(F.min("ubid").alias("ubid"))
    new = materialise(norm.join(known, key, "left_anti"), "new_records")
    placed = materialise(assign(new, held_masters), "assigned")
    created = materialise(masters(new, placed).drop("n_records").join(held_masters.select("ubid"), "ubid", "left_anti"), "created")
    attached = placed.join(new.select("id", *key, "content_hash"), "id").withColumnRenamed("id", "record_id")
    sources = materialise(held_sources.select("ubid", *key, "record_id", "content_hash").unionByName(attached), "sources")
    assigned = norm.join(known, key).select("id", "ubid").unionByName(placed)
    links = ubid_links(pairs, assigned, members)
    merges = merge(links, sources.groupBy("ubid").agg(F.count("*").alias("n_records")))
    again = earlier.groupBy("winner", "loser").agg(F.count("*").alias("times"))
    number = F.when(F.col("times").isNotNull(), F.sha2(F.concat_ws("|", "merge_id", F.col("times").cast("string")), 256)).otherwise(F.col("merge_id"))
    merges = materialise(merges.join(again, ["winner", "loser"], "left").withColumn("merge_id", number).drop("times"), "merges")
    every = held_masters.select(created.columns).unionByName(created)
    after = materialise(apply_merges(every, merges), "masters")
    lost = after.join(merges.select(F.col("loser").alias("ubid")).distinct(), "ubid", "left_semi")  # only what this run has merged moves
    return created, merges, after, repoint(sources, lost)


def cluster_edges(source_records: DataFrame) -> DataFrame:
    """All pairs of the source records of each identity, weight 0.8: the graph that is drawn of one identity. Filter to the identities wanted first."""
    rows = source_records.where("ubid IS NOT NULL").select("ubid", F.col("record_id").alias("id"))
    groups = rows.groupBy("ubid").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1")
    inside = groups.select("ubid", F.col("id").alias("record_a_id"), F.col("id").alias("record_b_id"), F.expr("n * (n - 1) div 2").alias("links"))
    pairs = blocking.expanded(inside, rows, groups.withColumn("class", blocking.class_of(["ubid"])), ["ubid"])
    return pairs.select("ubid", F.col("record_a_id").alias("source"), F.col("record_b_id").alias("target"), F.lit(0.8).alias("weight"))
