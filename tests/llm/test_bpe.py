import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(5)
    out = ["", " ", "\n\n  \n", "don't we'll 'r 're", "x" * 900, " " * 700, "é" * 300 + " 12345 " * 40, "a b  c", "<|endoftext|>", "🙂👍🏽 ok"]
    for _ in range(30):
        out.append("".join(r.choice(["a", "don't", "'re", " ", "  ", "\n", "12", "é", "!?", "-", "字", "\t", "word", "🙂"]) for _ in range(r.randrange(400))))
    return out


def expected(t):
    ids = LIBRARY.encode_ordinary(t or "")
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


def run(spark, rows, chunk, overlap):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS key", "1 AS n_tokens")
    got = bpe.round_trip(df, PATH, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()
    return sorted((x["doc_id"] is None, x["doc_id"] or 0, x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in got)


def want(rows):
    return sorted((k is None, k or 0, *expected(t)) for k, t in rows)


def test_whole_and_chunked_texts_match_the_library(spark):
    rows = list(enumerate(texts())) + [(None, "null key " * 30), (3, None), (4, "x y " * 60), (4, "x y " * 60)]
    assert run(spark, rows, bpe.CHUNK, bpe.OVERLAP) == want(rows)
    for chunk, overlap in ((16, 2), (50, 12)):
        assert run(spark, rows, chunk, overlap) == want(rows)


def test_encode_then_decode(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    encoded = bpe.encode(df, PATH, public_tokenizers.PATTERN, chunk=64)
    assert {x["doc_id"]: bytes(x["bytes"]).decode() for x in bpe.decode(encoded, PATH, public_tokenizers.PATTERN).collect()} == dict(rows)
    assert bpe.encode(df.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_columns_of_any_name(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:12])]
    for key, text in (("_text", "key"), ("text", "_copies"), ("copies", "piece")):
        df = spark.createDataFrame(rows, f"{key} bigint, {text} string")
        got = bpe.round_trip(df, PATH, public_tokenizers.PATTERN, key=key, text=text, chunk=16, overlap=2).collect()
        assert sorted((x[key], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in got) == [(k, *expected(t)) for k, t in rows]
