"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one string, encoded once with offsets, and its tokens are masked by intersecting two sorted
lists, the spans of the turns to learn and the spans of the tokens, by binary search. A token that straddles the edge of
such a span is under the mask with the part inside.

The template writes a turn as <turn>, its role, a newline, its text, </turn>, and a newline. Within roles and texts a
backslash goes before each backslash and before the < of a control string, and a role's newlines become \\n, so reading
back what was written is exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>"
#: Characters of conversations that make a batch.
TOGETHER = 1 << 18
_CONTROL = regex.compile(r"\\|<(?=/?turn>)")
_MARK = regex.compile(r"\\.|<turn>|</turn>", regex.DOTALL)
_ESCAPED = regex.compile(r"\\(.)", regex.DOTALL)


def escape(s: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and where in it the escaped texts of the role to learn stand."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head = OPEN + escape(role).replace("\n", r"\n") + "\n"
        body = escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), spans


def read(rendered: str) -> list[tuple[str, str]]:
    """The turns that a rendered string holds."""
    turns, begin = [], 0
    for m in _MARK.finditer(rendered):
        if m[0] == OPEN:
            begin = m.end()
        elif m[0] == CLOSE:
            role, _, text = rendered[begin : m.start()].partition("\n")
            turns.append((_ESCAPED.sub(lambda e: "\n" if e[1] == "n" else e[1], role), unescape(text)))
    return turns


@cache
def tokenizer(file: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """One for each worker process: the encoding of a file of ranks, and the bytes of each id."""
    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = list(map(len, ranks))
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def encode(rendered: str, file: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and offsets (start, end) in code points. Tokens that share a code point each have it whole."""
    encoding, sizes = tokenizer(file, pattern)
    raw = rendered.encode("utf-8", "replace")
    ids = np.array(encoding.encode_ordinary(rendered), np.int64)
    ends = np.cumsum(sizes[ids])
    if len(raw) == len(rendered):
        return ids, np.stack([ends - sizes[ids], ends], axis=1)
    begun = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points that have begun by each byte
    return ids, np.stack([begun[ends - sizes[ids]] - 1, begun[ends - 1]], axis=1)


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens meet a span, and for each token the first such span (by binary search; both lists are sorted). A token of no code point meets none."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool), np.zeros(len(offsets), np.int64)
    starts, ends = np.array(spans).T
    first = np.searchsorted(ends, offsets[:, 0], "right")
    meets = (first < len(spans)) & (starts[np.minimum(first, len(spans) - 1)] < offsets[:, 1])
    return meets & (offsets[:, 0] < offsets[:, 1]), first


def masked_text(rendered: str, offsets: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """All text under the mask, in order, unescaped: what masked tokens (sorted) cover of each span, each code point once."""
    out = []
    starts, ends = offsets[:, 0], offsets[:, 1]
    low = np.searchsorted(ends, [a for a, _ in spans], "right")
    high = np.searchsorted(starts, [b for _, b in spans], "left")
    gap = np.append(False, starts[1:] > ends[:-1])
    for (a, b), i, j in zip(spans, low.tolist(), high.tolist(), strict=True):
        if i >= j:
            continue
        cuts = [i, *(np.flatnonzero(gap[i + 1 : j]) + i + 1).tolist(), j]  # runs of tokens without a gap
        out.append(unescape("".join(rendered[max(a, int(starts[x])) : min(b, int(ends[y - 1]))] for x, y in zip(cuts, cuts[1:], strict=False))))
    return "".join(out)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple[str, str]]]]:
    """Whole conversations from rows that are sorted by conversation and turn; one is held at a time."""
    key, turns = None, []
    for batch in batches:
        keys, _, roles, texts = (c.to_pylist() for c in batch.columns)
        for i, k in enumerate(keys):
            if key is None or k != key[1]:
                if key is not None:
                    yield key[0], turns
                key, turns = (batch.column(0).slice(i, 1), k), []
            turns.append((roles[i] or "", texts[i] or ""))
    if key is not None:
        yield key[0], turns


def _rows(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    return rows.select(key, turn, role, text).repartition(F.col(key)).sortWithinPartitions(key, turn, role, text)


def format_chats(rows: DataFrame, file: str, pattern: str, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row a conversation: key, text, ids, starts and ends (offsets of the tokens), loss (which tokens to learn), spans (where the learned texts stand).

    Turns are taken by number, nulls first; turns of one number by role, then text. A null role or text counts as empty;
    rows of a null key make one conversation. Repeated rows are turns of their own. An empty table gives no rows; other
    columns aren't read. A conversation is one string here, so a task holds its longest one whole.
    """
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    names = [key, "text", "ids", "starts", "ends", "loss", "spans"]

    def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32), pa.array(np.concatenate(parts), kind))

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        keys, texts, ids, offsets, loss, spans = zip(*held, strict=True)
        starts, ends = ([o[:, n] for o in offsets] for n in (0, 1))
        learned = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pair))
        columns = [pa.concat_arrays(keys), pa.array(texts, pa.string()), *(lists(x, pa.int64()) for x in (ids, starts, ends)), lists(loss, pa.bool_()), learned]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for k, turns in _conversations(batches):
            rendered, spans = render(turns, learn)
            ids, offsets = encode(rendered, file, pattern)
            held.append((k, rendered, ids, offsets, mask(offsets, spans)[0], spans))
            size += len(rendered)
            if size >= TOGETHER:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, text string, ids array<bigint>, starts array<bigint>, ends array<bigint>, loss array<boolean>, spans array<struct<start:bigint,end:bigint>>"
    return _rows(rows, key, turn, role, text).mapInArrow(run, schema)


def digest(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What can be read back from the rows of format_chats(): key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens. A row each, whatever the key; an empty table gives none."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            flat, cuts = {}, {}
            for name in ("starts", "ends", "loss", "spans"):
                column = batch.column(name)
                flat[name] = column.flatten()
                cuts[name] = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
            starts, ends, loss = (flat[n].to_numpy(zero_copy_only=False) for n in ("starts", "ends", "loss"))
            spans = np.stack([flat["spans"].field(n).to_numpy(zero_copy_only=False) for n in (0, 1)], axis=1)
            rows = []
            for i, t in enumerate(texts):
                turns = read(t)
                part, own = slice(*cuts["starts"][i : i + 2]), slice(*cuts["spans"][i : i + 2])
                on = loss[part].astype(bool)
                learned = masked_text(t, np.stack([starts[part], ends[part]], axis=1)[on], spans[own].tolist())
                rows.append((len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(learned), sha(learned), len(t), len(on), int(on.sum())))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
    kind = formatted.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint"
    return formatted.mapInArrow(run, schema)
