"""Pair features, scores and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import blocking
from tessera.plans.shared import materialise

# Weights of the features, in the order they are summed in, and thresholds.
WEIGHTS = {"anchor_score": 0.40, "name_score": 0.25, "address_score": 0.20, "contact_score": 0.10, "date_proximity_score": 0.05}
AUTO_LINK, REVIEW = 0.88, 0.55
PUBLIC_DOMAINS = ["gmail.com", "yahoo.co.in", "outlook.com"]
MODEL_VERSION = "weighted-linear-v1"
FEATURES = list(WEIGHTS)


def anchor_score(pan_a: Column, pan_b: Column, gst_a: Column, gst_b: Column) -> Column:
    """Of valid anchors (null if not valid)."""
    return F.when(pan_a == pan_b, 1.0).when(gst_a == gst_b, 1.0).when(pan_a != pan_b, -0.5).when(gst_a != gst_b, -0.5).otherwise(0.0)


def name_score(a: Column, b: Column, ratio: Column) -> Column:
    """`ratio` is that of the names' sorted words."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(ratio)


def address_score(pin_a: Column, pin_b: Column, loc_a: Column, loc_b: Column, dist_a: Column, dist_b: Column, loc_ratio: Column, dist_ratio: Column) -> Column:
    """Of prepared pincodes, localities and districts, and the ratios of the last two."""
    given = lambda *cs: F.coalesce(F.length(cs[0]) > 0, F.lit(False)) & F.coalesce(F.length(cs[1]) > 0, F.lit(False))
    pin = F.when(given(pin_a, pin_b) & (pin_a == pin_b), 0.4).otherwise(0.0)
    place = F.when(given(loc_a, loc_b), 0.3 * loc_ratio).otherwise(0.0)
    district = F.when(given(dist_a, dist_b), 0.3 * dist_ratio).otherwise(0.0)
    return F.least(pin + place + district, F.lit(1.0))


def contact_score(phone_a: Column, phone_b: Column, clean_a: Column, clean_b: Column, mail_a: Column, mail_b: Column, local_a: Column, local_b: Column, domain_a: Column, domain_b: Column) -> Column:
    """Of phones and mail addresses, as given and prepared."""
    return contact_of((phone_a != "") & (phone_b != "") & (clean_a != "") & (clean_a == clean_b), mail_a, mail_b, local_a, local_b, domain_a, domain_b)


def contact_of(same_phone: Column, mail_a: Column, mail_b: Column, local_a: Column, local_b: Column, domain_a: Column, domain_b: Column) -> Column:
    """The same, where it's known whether the phone is the same."""
    mail = F.when((mail_a != "") & (mail_b != ""), F.when(local_a == local_b, F.when(domain_a == domain_b, 1.0).otherwise(0.7)).when((domain_a == domain_b) & ~domain_a.isin(PUBLIC_DOMAINS), 0.5))
    return F.greatest(F.when(same_phone, 1.0).otherwise(0.0), F.coalesce(mail, F.lit(0.0)))


def date_score(a: Column, b: Column) -> Column:
    days = F.abs(F.datediff(a, b))
    return F.when(days.isNull(), 0.3).when(days <= 90, 1.0).when(days >= 730, 0.0).otherwise(1.0 - (days - 90) / 640.0)


def linear_score(*features: Column) -> Column:
    """Weights times features, summed from the left, held between 0 and 1."""
    total = F.lit(0.0)
    for w, f in zip(WEIGHTS.values(), features, strict=True):
        total = total + F.lit(w) * f
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def route(score: Column, anchor: Column) -> Column:
    return F.when(anchor < 0, "HOLD").when(score >= AUTO_LINK, "AUTO_LINK").when(score >= REVIEW, "REVIEW").otherwise("HOLD")


def prepared(norm: DataFrame) -> DataFrame:
    """Normalised records with what the features compare, made once a record and not once a pair."""
    low = F.lower(T.stripped(F.coalesce(F.col("address_district"), F.lit(""))))
    return norm.withColumns(
        {
            "canonical": T.locality(F.col("address_locality")),
            "sorted_name": T.sorted_tokens(F.col("suffix_stripped")),
            "pin": T.stripped(F.coalesce(F.col("address_pincode"), F.lit(""))),
            "district": low,
            "mail_local": T.email_local(F.col("email")),
            "mail_domain": T.email_domain(F.col("email")),
            **({"clean_phone": T.clean_phone(F.col("phone"))} if "phone" in norm.columns else {}),  # classes may hold theirs beside
        }
    )


def with_records(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """Pairs joined with both their records, as structs a and b; a pair that lacks one is dropped."""
    used = ["id", "business_name", "suffix_stripped", "punct_stripped", "sound", "valid_pan", "valid_gstin", "phone", "email", "registration_date", "gt_id"]
    made = ["canonical", "sorted_name", "pin", "district", "clean_phone", "mail_local", "mail_domain"]
    rows = prepared(norm)
    rec = rows.select(F.struct(*[c for c in (*used, *made) if c in rows.columns]).alias("r"))
    a, b = rec.withColumnRenamed("r", "a"), rec.withColumnRenamed("r", "b")
    return pairs.join(a, F.col("record_a_id") == F.col("a.id")).join(b, F.col("record_b_id") == F.col("b.id"))


#: Pairs of different strings that are looked up by all tasks (some 100 bytes each), if there are no more.
LOOKED_UP = 200_000


def with_ratios(rows: DataFrame, of: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows with a column for each name in `of`: the ratio of its two strings, null if one is.

    However many rows there are, their strings are few, as records that meet in a block are alike: each two different strings
    are compared once and looked up. Where they are more than LOOKED_UP, they are compared row by row.
    """
    ends = {n: (F.least(a, b), F.greatest(a, b)) for n, (a, b) in of.items()}
    met = rows.select(F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ends.values()])).alias("t")).select("t.x", "t.y")
    told = materialise(met.where("x <> y").distinct(), "strings")
    if told.count() > LOOKED_UP:
        return rows.withColumns({n: T.ratio(a, b) for n, (a, b) in of.items()})
    held = materialise(told.withColumn("r", T.ratio(F.col("x"), F.col("y"))), "ratios")
    for n, (x, y) in ends.items():
        one = held.select(F.col("x").alias(f"_x_{n}"), F.col("y").alias(f"_y_{n}"), F.col("r").alias(f"_r_{n}"))
        rows = rows.join(F.broadcast(one), (x == F.col(f"_x_{n}")) & (y == F.col(f"_y_{n}")), "left")  # LOOKED_UP rows at most
    found = {n: F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, 1.0).otherwise(F.col(f"_r_{n}")) for n, (a, b) in of.items()}
    return rows.withColumns(found).drop(*[f"_{c}_{n}" for n in of for c in "xyr"])


def with_features(joined: DataFrame) -> DataFrame:
    """Read twice: write the pairs first if they are dear."""
    x = lambda c: (F.col(f"a.{c}"), F.col(f"b.{c}"))
    mail = [*x("email"), *x("mail_local"), *x("mail_domain")]
    contact = contact_of(F.col("same_phone"), *mail) if "same_phone" in joined.columns else contact_score(*x("phone"), *x("clean_phone"), *mail)
    joined = with_ratios(joined, {"name_ratio": x("sorted_name"), "locality_ratio": x("canonical"), "district_ratio": x("district")})
    return joined.withColumns(
        {
            "anchor_score": anchor_score(*x("valid_pan"), *x("valid_gstin")),
            "name_score": name_score(*x("suffix_stripped"), F.col("name_ratio")),
            "address_score": address_score(*x("pin"), *x("canonical"), *x("district"), F.col("locality_ratio"), F.col("district_ratio")),
            "contact_score": contact,
            "date_proximity_score": date_score(*x("registration_date")),
        }
    ).drop("name_ratio", "locality_ratio", "district_ratio")


def score_pairs(pairs: DataFrame, norm: DataFrame, model=None) -> DataFrame:
    """Pairs with their five features, score, decision and model version. `model`: a transformer of the features to a column `score`; none: the weights. Rows of `pairs` that have a score already are left out."""
    todo = pairs.where("score IS NULL").drop("score", "decision") if "score" in pairs.columns else pairs
    rows = with_features(with_records(todo, norm)).drop("a", "b")
    rows = model(rows) if model else rows.withColumn("score", linear_score(*map(F.col, FEATURES)))
    version = getattr(model, "version", "custom") if model else MODEL_VERSION
    return rows.withColumn("decision", route(F.col("score"), F.col("anchor_score"))).withColumn("model_version", F.lit(version))


#: Records that are equal in these are one class: their pairs with any record have the same features, score and label, but for what sharing a phone adds.
SAME = [*[c for c in blocking.CONTENT if c != blocking.APART], "gt_id"]


def score_classes(groups: DataFrame, model=None) -> DataFrame:
    """score_pairs() of the candidate pairs of classes: a row stands for `links` pairs of records, all of the same score. blocking.expanded(..., SAME) writes them out."""
    return score_pairs(materialise(blocking.class_pairs(groups), "class_pairs"), groups, model)


def class_features(groups: DataFrame) -> DataFrame:
    """Candidate pairs of classes with their records and features."""
    return with_features(with_records(materialise(blocking.class_pairs(groups), "class_pairs"), groups))


def field_flags(a: Column, b: Column) -> tuple[Column, Column]:
    """Whether a field matches (both given, equal but for case) and whether it differs."""
    both = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return both & (F.lower(a) == F.lower(b)), both & (F.lower(a) != F.lower(b))
