"""Resolution over kept state against the same done one record and one pair after the other."""

import hashlib
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import resolution
from tessera.plans.shared import materialise

MASTERS = "ubid string, anchor_type string, anchor_value string, primary_name string, primary_address string, primary_pincode string, primary_district string, status string, deprecated_by_ubid string"
SOURCES = "ubid string, source_system string, source_record_id string, record_id string, content_hash string"
NORM = "id string, valid_pan string, valid_gstin string, source_system string, source_record_id string, content_hash string, business_name string, address_locality string, address_city string, address_pincode string, address_district string"


class Plain:
    """The same, in dictionaries."""

    def __init__(self):
        self.masters, self.of, self.merges = {}, {}, []

    def active(self, u):
        while self.masters[u][2] != "ACTIVE" and self.masters[u][3]:
            u = self.masters[u][3]
        return u

    def assign(self, i, p, g):
        if i in self.of:
            return
        for kind, v in (("GSTIN", g), ("PAN", p)):
            hit = [u for u, (k, w, s, _) in self.masters.items() if v and (k, w, s) == (kind, v, "ACTIVE")]
            if hit:
                self.of[i] = hit[0]
                return
        u = f"UBID-GST-{g}" if g else f"UBID-PAN-{p}" if p else None
        kind, v = ("GSTIN", g) if g else ("PAN", p) if p else ("INTERNAL", None)
        if u is None or u in self.masters:
            u, kind, v = "UBID-INT-" + hashlib.sha256(i.encode()).hexdigest()[:12].upper(), "INTERNAL", None
        self.masters[u] = (kind, v, "ACTIVE", None)
        self.of[i] = u

    def merge(self, winner, loser):
        kind, v, _, _ = self.masters[loser]
        self.masters[loser] = (kind, v, "DEPRECATED", winner)
        self.of = {i: winner if u == loser else u for i, u in self.of.items()}
        self.merges.append((winner, loser))

    def run(self, records, pairs):
        for i, p, g in sorted(records):
            self.assign(i, p, g)
        for s, a, b in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
            x, y = self.of.get(a), self.of.get(b)
            if x and y and x != y:
                n = lambda u: sum(v == u for v in self.of.values())
                self.merge(*((x, y) if n(x) >= n(y) else (y, x)))

    def reverse(self, loser):
        kind, v, _, _ = self.masters[loser]
        self.masters[loser] = (kind, v, "ACTIVE", None)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_over_kept_state(spark, seed):
    """Three loads; a reviewer's merge and a reversal before each further run; and a run that finds nothing new."""
    r = random.Random(seed)
    records = [(f"R{i:03d}", r.choice([None, "P1", "P2", "P3", f"P{i}"]), r.choice([None, None, "G1", "G2", f"G{i}"])) for i in range(60)]
    linked = [(round(r.uniform(0.88, 1), 2), *sorted(r.sample([x[0] for x in records], 2))) for _ in range(40)]
    plain = Plain()
    masters, sources = spark.createDataFrame([], MASTERS), spark.createDataFrame([], SOURCES)
    done = spark.createDataFrame([], "winner string, loser string")
    ids = set()
    for upto in (40, 59, 60, 60):
        now = [x for x in r.sample(records, len(records)) if x in records[:upto]]
        pairs = [x for x in linked if {x[1], x[2]} <= {y[0] for y in now}]
        plain.run(now, pairs)
        norm = spark.createDataFrame([(i, p, g, "S", i, None, "name " + i, None, None, None, None) for i, p, g in now], NORM)
        scored = spark.createDataFrame([(a, b, s, "AUTO_LINK") for s, a, b in pairs] + [("R000", "R001", 0.6, "REVIEW")], "record_a_id string, record_b_id string, score double, decision string")
        created, merges, after, sources = resolution.resolve(norm, scored, masters, sources, done)
        got = merges.select("winner", "loser", "merge_id").collect()
        assert sorted((m["winner"], m["loser"]) for m in got) == sorted(plain.merges[done.count() :])
        assert not ids & {m["merge_id"] for m in got}
        ids |= {m["merge_id"] for m in got}
        assert {(x["ubid"]) for x in created.collect()} == set(plain.masters) - {x["ubid"] for x in masters.collect()}
        assert {(x["record_id"], x["ubid"]) for x in sources.collect()} == set(plain.of.items())
        assert {(x["ubid"], x["status"], x["deprecated_by_ubid"]) for x in after.collect()} == {(u, m[2], m[3]) for u, m in plain.masters.items()}
        masters, sources = materialise(after, "m"), materialise(sources, "s")
        done = materialise(done.unionByName(merges.select("winner", "loser")), "d")
        # a reviewer merges two identities, and undoes one merge
        live = sorted({u for u in plain.of.values()})
        if len(live) > 2:
            plain.merge(live[0], live[1])
            by_hand = spark.createDataFrame([(live[0], live[1], 0)], "winner string, loser string, step int")
            masters = resolution.apply_merges(masters, by_hand)
            sources = materialise(resolution.repoint(sources, masters), "s")
            done = materialise(done.unionByName(by_hand.select("winner", "loser")), "d")
        if plain.merges:
            winner, loser = r.choice(plain.merges)
            if plain.masters[loser][2] == "DEPRECATED":
                plain.reverse(loser)
                hit = F.col("ubid") == loser
                masters = masters.withColumns({"status": F.when(hit, "ACTIVE").otherwise(F.col("status")), "deprecated_by_ubid": F.when(~hit, F.col("deprecated_by_ubid"))})
        masters = materialise(masters, "m")


def test_a_reversal_needs_a_merge(spark):
    masters = spark.createDataFrame([], MASTERS)
    merges = spark.createDataFrame([], "merge_id string, winner string, loser string, reversed boolean")
    with pytest.raises(ValueError):
        resolution.reverse(masters, merges, "none", "", "", datetime(2024, 1, 1))
