import hashlib
import random

import numpy as np
import public_tokenizers

from tessera.llm import chat

FILE, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def talks():
    r = random.Random(2)
    bits = ["</turn>", "<turn>", "\\", "\\\\", "<", "a", " ", "\n", "é", "🙂", "### Assistant:", "<|endoftext|>", "hello", "  ", "字"]
    some = lambda: "".join(r.choice(bits) for _ in range(r.randrange(14)))
    out = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (2, None, None, None), (2, 0, "assistant", ""), (3, 5, "assistant", "only"), (3, 5, "assistant", "only"), (None, 0, "assistant", "null conversation"), (None, 1, "us\ner\\n", " x")]
    for k in range(10, 60):
        out += [(k, t, r.choice(["user", "assistant", "system", "assistant"]), some()) for t in range(r.randrange(1, 7))]
    return out + [(99, t, "assistant" if t % 2 else "user", "long words and text " * 700) for t in range(6)]


def test_digest_matches_brute_force(spark):
    rows = talks()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS ids", "2 AS loss").repartition(5)
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(df, FILE, PATTERN)).collect()}
    assert set(got) == {k for k, *_ in rows}
    for k, r in got.items():
        turns = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
        learned = "".join(t or "" for _, _, role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), sha(learned))


def test_escape_round_trip():
    for _, _, role, text in talks():
        assert chat.unescape(chat.escape(text or "")) == (text or "")
        assert chat.read(chat.render([(role or "", text or "")])[0]) == [(role or "", text or "")]


def test_mask_against_every_pair():
    r = np.random.default_rng(0)
    for _ in range(50):
        cuts = np.unique(r.integers(0, 60, 14))
        spans = [(int(a), int(b)) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
        ends = np.sort(r.integers(0, 62, 12))
        offsets = np.stack([np.append(0, ends[:-1]), ends], axis=1)
        on, _ = chat.mask(offsets, spans)
        assert on.tolist() == [any(max(a, s) < min(b, e) for s, e in spans) for a, b in offsets.tolist()]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digest(chat.format_chats(df, FILE, PATTERN)).count() == 0


def test_offsets_and_mask_against_every_token():
    """Offsets from the bytes of the tokens one by one; the text under a mask from every code point."""
    encoding, _ = chat.tokenizer(FILE, PATTERN)
    r = random.Random(5)
    for k in {k for k, *_ in talks()}:
        turns = [(role or "", text or "") for c, _, role, text in talks() if c == k]
        rendered, spans = chat.render(turns)
        ids, offsets = chat.encode(rendered, FILE, PATTERN)
        assert ids.tolist() == encoding.encode_ordinary(rendered)
        of = [i for i, c in enumerate(rendered) for _ in c.encode()]
        at = 0
        for n, (a, b) in zip(ids.tolist(), offsets.tolist(), strict=True):
            size = len(encoding.decode_single_token_bytes(n))
            assert (a, b) == (of[at], of[at + size - 1] + 1)
            at += size
        on = chat.mask(offsets, spans)[0] & np.array([r.random() < 0.8 for _ in ids], bool)
        under = {i for a, b in offsets[on].tolist() for i in range(a, b)}
        want = "".join(chat.unescape("".join(rendered[i] for i in range(a, b) if i in under)) for a, b in spans)
        assert chat.masked_text(rendered, offsets[on], spans) == want


def test_a_very_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", "no spaces here" * 2000 + "</turn>") for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    (got,) = chat.digest(chat.format_chats(df, FILE, PATTERN)).collect()
    learned = "".join(t for *_, role, t in rows if role == "assistant")
    assert (got["loss_chars"], got["loss_sha256"]) == (len(learned), sha(learned))
