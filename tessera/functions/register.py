"""The scalar library as functions of SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions import pii
from tessera.functions import text as T


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\\s+|\\s+$', '')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bodies() -> dict[str, tuple[str, str, str]]:
    """Parameters, type and body of each function."""
    low = _strip("lower(coalesce(s, ''))")
    suffix = _quoted(T._SUFFIX)
    cut = rf"regexp_replace(regexp_replace({_strip(f'regexp_replace({low}, {suffix}, {chr(39) * 2})')}, ',+$', ''), '\\.+$', '')"
    names = "array(" + ", ".join(f"'{n}'" for n in pii.FAKE_NAMES) + ")"
    places = "array(" + ", ".join(f"'{n}'" for n in pii.FAKE_LOCALITIES) + ")"
    aliases = ", ".join(f"'{a}', '{k}'" for k, v in T.LOCALITIES.items() for a in v)
    return {
        "suffix_stripped": ("s STRING", "STRING", f"CASE WHEN {low} RLIKE {suffix} THEN {cut} ELSE {low} END"),
        "punct_stripped": ("s STRING", "STRING", _strip(r"regexp_replace(regexp_replace(s, '[^a-z0-9\\s]', ''), '\\s+', ' ')")),
        "phonetic": ("s STRING", "STRING", "CASE WHEN s = '' THEN '' WHEN s RLIKE '^[a-z]' THEN soundex(s) ELSE concat(left(s, 1), substring(soundex(concat('A', substring(s, 2))), 2, 3)) END"),
        "canonical_locality": ("s STRING", "STRING", f"coalesce(try_element_at(map({aliases}), {low}), {low})"),
        "valid_pan": ("s STRING", "STRING", f"CASE WHEN upper({_strip('s')}) RLIKE {_quoted(T.PAN)} THEN upper({_strip('s')}) END"),
        "valid_gstin": ("s STRING", "STRING", f"CASE WHEN upper({_strip('s')}) RLIKE {_quoted(T.GSTIN)} THEN upper({_strip('s')}) END"),
        "sorted_tokens": ("s STRING", "STRING", rf"array_join(array_sort(filter(split({_strip('s')}, '\\s+'), t -> t <> '')), ' ')"),
        "mask_pan": ("s STRING", "STRING", "CASE WHEN length(s) >= 5 THEN concat('XXX', substring(s, 4, 2), 'XXXX', CASE WHEN length(s) >= 10 THEN right(s, 1) ELSE 'X' END) END"),
        "mask_gstin": ("s STRING", "STRING", "CASE WHEN length(s) >= 6 THEN concat('XX', substring(s, 3, 2), repeat('X', 11)) END"),
        "mask_phone": ("s STRING", "STRING", "CASE WHEN length(s) >= 4 THEN concat('+91XXXXXXXX', right(s, 2)) WHEN length(s) > 0 THEN 'XXXX' END"),
        "mask_email": ("s STRING", "STRING", "CASE WHEN instr(s, '@') > 0 THEN concat(repeat('x', least(instr(s, '@') - 1, 8)), substring(s, instr(s, '@'))) END"),
        "fake_name": ("s STRING", "STRING", f"get({names}, CAST(pmod(crc32(CAST(coalesce(s, '') AS BINARY)), {len(pii.FAKE_NAMES)}) AS INT))"),
        "fake_locality": ("s STRING", "STRING", f"get({places}, CAST(pmod(crc32(CAST(coalesce(s, '') AS BINARY)), {len(pii.FAKE_LOCALITIES)}) AS INT))"),
        "signal_decay": ("age INT", "DOUBLE", "exp(-ln(2.0D) * greatest(age, 0) / 180.0D)"),
    }


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session, for the time of that session; the similarity is an Arrow function, the others are SQL."""
    made = bodies()
    for name, (parameters, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("indel_ratio", T._indel)
    return [*made, "indel_ratio"]
