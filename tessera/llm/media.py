"""Copies among media columns by local image descriptors.

An image (binary PGM) gives corners at scales a third of an octave apart, each with an orientation from its patch's
intensity centroid, 256 binary tests of a patch turned to that orientation, and 128 of a patch twice as wide. The tests are
cut into BANDS bands; a Hamming table keys the corners by band and bits, so two corners that differ in fewer than BANDS
tests share a key at least. Two images meet if two of their corners share a key and differ in NEAR of 128 other tests and
in WIDE of the wider patch's at most: smooth pictures share many small patches, few with the same surroundings. They are
linked when corners, which now may differ in ALIKE tests whether they share a key or not, agree on one similarity
transform: CONSENSUS of them, or fewer that differ little.

Images of equal bytes are one class. In two bands the images of a key are first held against its least image alone, so a
large group of near copies is mostly one component at the price of a row an image. Then all pairs that meet and are still
of different components are decided, once each; a key of over MAX_BLOCK corners is dealt out in salted blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.plans.shared import materialise

#: Scales an octave, corners of each scale for every AREA pixels of the image, binary tests and the bands they are cut into.
SCALES, CORNERS, AREA, TESTS, BANDS = 3, 20, 64 * 64, 256, 8
STEP = 2 ** (1 / SCALES)
RADIUS, MARGIN, ANGLES = 7, 5, 36
#: Corners that must agree on a transform, the tests in which two may differ then, and how far off a place may be in pixels.
CONSENSUS, ALIKE, BIN = 7, 50, 2
#: Fewer corners are enough, FEWEST at least, if they differ in CLOSE tests at most in the mean.
FEWEST, CLOSE = 4, 28
#: Tests of 128, and of the wider patch's 128, in which two corners may differ for their images to be decided.
NEAR, WIDE = 20, 18
#: Pixels of its own scale that a corner keeps from others to count.
APART = 2.0
#: Likest pairs of corners whose transforms are tried on the others.
TRIED = 40
#: Corners of one key that are held against each other in one task, and one image in so many that large keys are estimated from.
MAX_BLOCK, LOOK = 8192, 16
#: Pairs of images, and rows of equal bytes, that are broadcast (16 bytes each); more are joined by shuffle. Pairs that are decided at a time.
MAX_BROADCAST, SLICE = 1_000_000, 60_000
#: Pixels that are described together.
TOGETHER = 1 << 16
#: Bits of a corner's scale and angle in one number.
STAND = 12


def _tests() -> np.ndarray:
    """Pairs of points within the patch, in half pixels, turned to each of the ANGLES orientations: (angle, test, end, y or x)."""
    r = np.random.default_rng(11)
    points = np.clip(r.normal(0, RADIUS / 2.2, (TESTS, 2, 2)), -MARGIN, MARGIN)
    turns = np.arange(ANGLES) * 2 * np.pi / ANGLES
    c, s = np.cos(turns)[:, None, None], np.sin(turns)[:, None, None]
    y, x = points[None, ..., 0], points[None, ..., 1]
    return np.rint(2 * np.stack([s * x + c * y, c * x - s * y], axis=-1)).astype(np.int64)


_PAIRS = _tests()
_GRID = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_GRID[0] ** 2 + _GRID[1] ** 2 <= RADIUS**2).astype(np.float64)


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    """The pixels of a binary PGM of one byte a pixel; None if it isn't one."""
    parts = (data or b"").split(None, 4)
    if len(parts) < 4 or parts[0] != b"P5" or not all(x.isdigit() for x in parts[1:4]) or int(parts[3]) > 255:
        return None
    w, h = int(parts[1]), int(parts[2])
    pixels = np.frombuffer(data[len(data) - w * h :] if w * h <= len(data) else b"", np.uint8)
    return pixels.reshape(h, w) if w * h and len(pixels) == w * h else None


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % pixels.shape[::-1] + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2 r + 1, of each image."""
    p = np.zeros((*a.shape[:-2], a.shape[-2] + 2 * r + 1, a.shape[-1] + 2 * r + 1))
    p[..., r + 1 : -r, r + 1 : -r] = a
    s = p.cumsum(-2).cumsum(-1)
    k = 2 * r + 1
    return s[..., k:, k:] - s[..., :-k, k:] - s[..., k:, :-k] + s[..., :-k, :-k]


def _highest(a: np.ndarray, r: int) -> np.ndarray:
    """The largest value over squares of side 2 r + 1."""
    for axis in (-2, -1):
        wide = [(0, 0)] * a.ndim
        wide[axis] = (r, r)
        p, n = np.pad(a, wide, constant_values=-np.inf), a.shape[axis]
        parts = [np.take(p, range(k, k + n), axis) if axis == -2 else p[..., k : k + n] for k in range(2 * r + 1)]
        a = np.maximum.reduce(parts)
    return a


@lru_cache(64)
def _taps(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n samples make each of m, and their weights (a triangle as wide as a new sample)."""
    ratio = n / m
    at = (np.arange(m) + 0.5) * ratio - 0.5
    wide = max(1.0, ratio)
    near = np.floor(at)[:, None].astype(np.int64) + np.arange(1 - int(np.ceil(wide)), 1 + int(np.ceil(wide)))
    weight = np.clip(1 - np.abs(near - at[:, None]) / wide, 0, None)
    return np.clip(near, 0, n - 1), weight / weight.sum(axis=1, keepdims=True)


def resized(a: np.ndarray, h: int, w: int) -> np.ndarray:
    near, weight = _taps(a.shape[-2], h)
    a = sum(weight[:, n, None] * a[..., near[:, n], :] for n in range(near.shape[1]))
    near, weight = _taps(a.shape[-1], w)
    return sum(weight[:, n] * a[..., near[:, n]] for n in range(near.shape[1]))


def _halves(a: np.ndarray) -> np.ndarray:
    """The images with the means of neighbours between their pixels."""
    out = np.empty((a.shape[0], 2 * a.shape[1] - 1, 2 * a.shape[2] - 1))
    out[:, ::2, ::2] = a
    out[:, 1::2, ::2] = (a[:, :-1] + a[:, 1:]) / 2
    out[:, :, 1::2] = (out[:, :, :-1:2] + out[:, :, 2::2]) / 2
    return out


Corner = tuple[float, float, int, int, bytes, bytes]


def describe(pixels: np.ndarray) -> list[Corner]:
    """Corners of an image: (y, x, scale, angle, bits, bits of the wider patch), y and x in pixels of the image itself. Beyond the image its edge goes on."""
    return describe_all(pixels[None])[0]


def describe_all(pixels: np.ndarray) -> list[list[Corner]]:
    """The corners of images of one size."""
    out: list[list[Corner]] = [[] for _ in pixels]
    whole, scale, r = pixels.astype(np.float64), 0, RADIUS
    most = -(-CORNERS * max(AREA, whole[0].size) // AREA)
    while True:
        h, w = (round(n / STEP**scale) for n in whole.shape[1:])
        if min(h, w) < 2 * r + 3:
            return out
        level = resized(whole, h, w) if scale else whole
        gy, gx = np.gradient(level, axis=(1, 2))
        a, b, c = _box(gy * gy, 2), _box(gx * gx, 2), _box(gy * gx, 2)
        corner = a * b - c * c - 0.05 * (a + b) ** 2
        inner = corner[:, r:-r, r:-r]
        least = 1e-6 * np.maximum(1.0, corner.max(axis=(1, 2)))[:, None, None]
        of, ys, xs = np.nonzero((inner >= _highest(inner, 2)) & (inner > least))
        order = np.lexsort((xs, ys, -inner[of, ys, xs], of))
        of = of[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        of, ys, xs = of[rank < most], ys[order][rank < most] + r, xs[order][rank < most] + r
        if len(of):
            smooth = _box(level, 1) / 9
            patches = smooth[of[:, None, None], ys[:, None, None] + _GRID[0], xs[:, None, None] + _GRID[1]] * _DISC
            turn = np.arctan2((patches * _GRID[0]).sum(axis=(1, 2)), (patches * _GRID[1]).sum(axis=(1, 2)))
            angle = np.rint(turn / (2 * np.pi / ANGLES)).astype(np.int64) % ANGLES
            at, fine = _PAIRS[angle], _halves(smooth)
            ends = fine[of[:, None, None], 2 * ys[:, None, None] + at[..., 0], 2 * xs[:, None, None] + at[..., 1]]
            bits = np.packbits(ends[:, :, 0] < ends[:, :, 1] - 1e-6, axis=1)
            blurred = _box(np.pad(level, ((0, 0), (2, 2), (2, 2)), mode="edge"), 2)[:, 2:-2, 2:-2]
            at = at[:, : TESTS // 2]
            ends = blurred[of[:, None, None], np.clip(ys[:, None, None] + at[..., 0], 0, h - 1), np.clip(xs[:, None, None] + at[..., 1], 0, w - 1)]
            around = np.packbits(ends[:, :, 0] < ends[:, :, 1] - 1e-6, axis=1)
            py, px = ((v + 0.5) * n / m - 0.5 for v, n, m in ((ys, whole.shape[1], h), (xs, whole.shape[2], w)))
            for k, y, x, g, one, two in zip(of.tolist(), py.tolist(), px.tolist(), angle.tolist(), bits, around, strict=True):
                out[k].append((y, x, scale, g, one.tobytes(), two.tobytes()))
        scale += 1


def descriptors(images: DataFrame, key: str, image: str) -> DataFrame:
    """(key, row, id, words, around, places): a number of the row, a hash of the bytes, the tests of each corner in turn, 64 in a word, those of the wider patches, and y, x (in quarters of a pixel), scale and angle of each corner in one number. An image that can't be read has none."""
    lists = ["words", "around", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows, every = [], [decode_pgm(data.as_py()) for data in part.column(3)]
                described: list[list[Corner]] = [[] for _ in every]
                for shape in {p.shape for p in every if p is not None}:
                    same = [n for n, p in enumerate(every) if p is not None and p.shape == shape]
                    some = max(1, TOGETHER // (shape[0] * shape[1]))
                    for k in range(0, len(same), some):
                        for n, found in zip(same[k : k + some], describe_all(np.stack([every[n] for n in same[k : k + some]])), strict=True):
                            described[n] = found
                for found in described:
                    bits = [np.frombuffer(b"".join(d[n] for d in found), "<i8") for n in (4, 5)]
                    rows.append((*bits, [(round(4 * y) << 24 | round(4 * x)) << STAND | scale * ANGLES + angle for y, x, scale, angle, *_ in found]))
                columns = [pa.array(c, pa.list_(pa.int64())) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], [key, "row", "id", *lists])

    chosen = images.select(F.col(key).cast("bigint").alias(key), F.monotonically_increasing_id().alias("row"), F.xxhash64(image).alias("id"), image)
    return chosen.mapInArrow(run, f"`{key}` bigint, row bigint, id bigint, " + ", ".join(f"{n} array<bigint>" for n in lists))


def unpacked(words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of words for each corner, and its (y, x, scale, angle)."""
    scale, angle = np.divmod(places & (1 << STAND) - 1, ANGLES)
    return words.reshape(-1, TESTS // 64), np.stack([(places >> STAND + 24) / 4, (places >> STAND & (1 << 24) - 1) / 4, scale, angle], axis=1)


def agree(words: np.ndarray, places: np.ndarray, their_words: np.ndarray, their_places: np.ndarray) -> bool:
    """Whether CONSENSUS corners of the first image (or FEWEST that are close) are alike corners of the second, and one transform takes these to them."""
    step = max(1, 1_000_000 // max(1, len(their_words)))  # large images have many corners: a part of the table at a time
    met = []
    for a in range(0, len(words), step):
        differ = sum(np.bitwise_count((words[a : a + step, None, n] ^ their_words[None, :, n]).view(np.uint64)).astype(np.int16) for n in range(words.shape[1]))
        i, j = np.nonzero(differ <= ALIKE)
        met.append(np.stack([i + a, j, differ[i, j]]))
    i, j, differ = np.concatenate(met, axis=1)
    if len(set(i.tolist())) < FEWEST or len(set(j.tolist())) < FEWEST:
        return False
    q, p = places[i, 1] + 1j * places[i, 0], their_places[j, 1] + 1j * their_places[j, 0]
    # of each two corners one transform
    change = STEP ** (places[i, 2] - their_places[j, 2]).astype(np.float64) * np.exp(2j * np.pi / ANGLES * (places[i, 3] - their_places[j, 3]))
    first = np.argsort(differ, kind="stable")[:TRIED]
    ratio, sizes = change[None] / change[first, None], np.maximum(1.0, np.abs(change[first]))
    nears = (np.abs(np.angle(ratio)) < np.pi / 9) & (np.abs(np.log(np.abs(ratio))) < 0.35)
    fitting = nears & (np.abs(q[None] - q[first, None] - change[first, None] * (p[None] - p[first, None])) < 3 * BIN * sizes[:, None])
    best = [(int(f.sum()), -int(n), near, f, float(size), complex(change[n])) for n, near, f, size in zip(first, nears, fitting, sizes, strict=True) if f.sum() >= FEWEST - 2]
    for _, _, near, fits, size, around in sorted(best, key=lambda b: b[:2], reverse=True)[:3]:
        for wide in (2, 1, 1):  # least squares over those that fit
            if fits.sum() < 3:
                break
            of, to = p[fits] - p[fits].mean(), q[fits] - q[fits].mean()
            spread = float((np.abs(of) ** 2).sum())
            if not spread:
                break
            z = (to * of.conj()).sum() / spread
            if abs(np.log(max(1e-9, abs(z)) / abs(around))) > 0.2 or abs(np.angle(z / around)) > np.pi / 12:
                fits[:] = False
                break
            fits = near & (np.abs(q - q[fits].mean() - z * (p - p[fits].mean())) < wide * BIN * size)
        # finest first, a corner counts if it isn't beside one that counts: those of one spot at several scales see the same
        apart: list[complex] = []
        for n in np.flatnonzero(fits)[np.argsort(places[i[fits], 2], kind="stable")]:
            if not apart or np.abs(np.array(apart) - q[n]).min() >= APART * STEP ** float(places[i[n], 2]):
                apart.append(q[n])
        n = min(len(set(j[fits].tolist())), len(apart))
        if n >= CONSENSUS or n >= FEWEST and float(differ[fits].mean()) <= CLOSE:
            return True
    return False


def _agreed(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs of images (id, pid), those of which the first agrees with the second. Both come to one task by the pair, so an image of many pairs doesn't burden one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            done = held.num_rows // 2 * 2 if held.num_rows else 0
            high, low = (held.column(n).to_numpy() for n in (0, 1))
            (words, at), (places, of) = ((c.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(c.value_lengths().to_numpy()))) for c in (held.column(3), held.column(4)))
            mine = [unpacked(words[at[r] : at[r + 1]], places[of[r] : of[r + 1]]) for r in range(done)]
            good = [r for r in range(0, done, 2) if agree(*mine[r], *mine[r + 1])]
            yield pa.RecordBatch.from_arrays([pa.array(high[good]), pa.array(low[good])], ["id", "pid"])
            held = held.slice(done)

    pairs, out = materialise(pairs, "pairs"), None
    slices = max(1, -(-pairs.count() // SLICE))
    for n in range(slices):
        some = pairs.where(F.pmod(F.xxhash64("id", "pid"), F.lit(slices)) == n)
        each = some.select(F.explode(F.array(F.struct(F.col("id").alias("at"), F.lit(0).alias("side")), F.struct(F.col("pid").alias("at"), F.lit(1).alias("side")))).alias("e"), "id", "pid").select("id", "pid", "e.side", F.col("e.at").alias("at"))
        both = features.select(F.col("id").alias("at"), "words", "places").join(F.broadcast(each), "at").select("id", "pid", "side", "words", "places")
        found = materialise(both.repartition("id", "pid").sortWithinPartitions("id", "pid", "side").mapInArrow(run, "id bigint, pid bigint"), "links")
        out = found if out is None else out.unionByName(found)
        del both
        _let_go(features)
    return out


def _word(words: np.ndarray, band: int) -> np.ndarray:
    """The key of each corner in one band."""
    return np.ascontiguousarray(words).view(f"<i{TESTS // BANDS // 8}")[:, band].astype(np.int64)


def _keyed(features: DataFrame, band: int) -> DataFrame:
    """(word, id, root, b0, b1, c0, c1): a row for each corner, with its key in one band, 128 tests beside the key's, and those of the wider patch."""
    names = ["word", "id", "root", "b0", "b1", "c0", "c1"]
    per = TESTS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                bits, around = (part.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for k, n in ((2, per), (3, 2)))
                of = np.repeat(np.arange(part.num_rows), part.column(3).value_lengths().to_numpy(zero_copy_only=False) // 2)
                ids = [part.column(n).to_numpy(zero_copy_only=False)[of] for n in (0, 1)]
                other = [(band * per // BANDS + k) % per for k in (1, 2)]
                columns = [_word(bits, band), *ids, *bits[:, other].T, *around.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    return features.select("id", "root", "words", "around").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _keys(features: DataFrame) -> DataFrame:
    """(band, word, id) of all corners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                bits = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, TESTS // 64)
                each = part.column(1).value_lengths().to_numpy(zero_copy_only=False) // (TESTS // 64)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), each)
                for band in range(BANDS):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), band)), pa.array(_word(bits, band)), pa.array(ids)], ["band", "word", "id"])

    return features.select("id", "words").mapInArrow(run, "band bigint, word bigint, id bigint")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _keyed() and a side, sorted by word, to (id, pid): images of different roots that meet within a word, of sides that aren't the same (side 0 meets any)."""

    def pairs(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        word, id_, root, *bits, side = held
        ends = np.append(np.flatnonzero(word[1:] != word[:-1]) + 1, len(word))
        end = np.repeat(ends, np.diff(ends, prepend=0))
        i, d, found = np.arange(len(word)), 0, []
        while len(i):
            d += 1
            i = i[i + d < end[i]]
            a = i[(root[i] != root[i + d]) & ((side[i] == 0) | (side[i] != side[i + d]))]
            a = a[_near([c[a] for c in bits], [c[a + d] for c in bits])]
            if len(a):
                found.append(np.stack([np.maximum(id_[a], id_[a + d]), np.minimum(id_[a], id_[a + d])]))
        if found:
            every = np.concatenate(found, axis=1)
            every = every[:, np.lexsort(every)]
            new = np.append(True, (every[:, 1:] != every[:, :-1]).any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in every[:, new]], ["id", "pid"])

    held = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if len(held[0]):
            rest = int(np.searchsorted(held[0], held[0][-1]))  # the last word may go on in the next batch
            yield from pairs([c[:rest] for c in held]) if rest else ()
            held = [c[rest:] for c in held]
    if held is not None and len(held[0]):
        yield from pairs(held)


def _meetings(features: DataFrame, heavy: DataFrame) -> DataFrame:
    """Pairs of images (id, pid) of different roots that have corners of one key that differ in NEAR and WIDE tests at most."""
    out, any_heavy = None, not heavy.isEmpty()
    for band in range(BANDS):
        rows = _keyed(features, band)
        task = rows.withColumn("side", F.lit(0).cast("bigint"))
        if any_heavy:
            large = heavy.where(F.col("band") == band).select("word", "k")
            mine = F.pmod(F.xxhash64("id"), F.col("k"))
            cut = rows.join(F.broadcast(large), "word").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
            low, high = F.least("mine", "other"), F.greatest("mine", "other")
            side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("bigint")
            cut = cut.select(F.xxhash64("word", low, high).alias("word"), *rows.columns[1:], side.alias("side"))
            task = task.join(F.broadcast(large.select("word")), "word", "left_anti").select(cut.columns).unionByName(cut)
        found = materialise(task.repartition("word").sortWithinPartitions("word").mapInArrow(_met, "id bigint, pid bigint").distinct(), "seeds")
        out = found if out is None else out.unionByName(found)
        del rows, task
        _let_go(features)
    return out.distinct()


def _near(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Which of two corners, each given by b0, b1, c0 and c1, differ in NEAR and WIDE tests at most."""
    far = [np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int16) for x, y in zip(one, other, strict=True)]
    return (far[0] + far[1] <= NEAR) & (far[2] + far[3] <= WIDE)


def _beside_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, id, b0, b1, c0, c1), sorted by word and id, to (id, pid): the images that meet the least image of a word."""
    first: list[np.ndarray] | None = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(rows[0]):
            continue
        if first is not None:
            rows = [np.concatenate(x) for x in zip(first, rows, strict=True)]
        new = np.append(True, rows[0][1:] != rows[0][:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        met = (rows[1] != rows[1][lead]) & _near(rows[2:], [c[lead] for c in rows[2:]])
        pairs = np.unique(np.stack([rows[1][met], rows[1][lead][met]]), axis=1)
        first = [c[lead[-1:]] for c in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs], ["id", "pid"])


def _with_pivots(features: DataFrame, heavy: DataFrame) -> DataFrame:
    """Of the keys of two bands, the images that meet the key's least image: (id, pid). A large key has several such, one a part."""
    out = None
    for band in range(0, BANDS, BANDS // 2):
        rows = _keyed(features.withColumn("root", F.col("id")), band).drop("root")
        large = F.broadcast(heavy.where(F.col("band") == band).select("word", "k"))
        part = F.when(F.col("k").isNull(), F.col("word")).otherwise(F.xxhash64("word", F.pmod(F.xxhash64("id"), F.col("k"))))
        rows = rows.join(large, "word", "left").select(part.alias("word"), *rows.columns[1:])
        found = rows.repartition("word").sortWithinPartitions("word", "id").mapInArrow(_beside_first, "id bigint, pid bigint").distinct()
        found = materialise(found, "tried")
        out = found if out is None else out.unionByName(found)
        del rows
        _let_go(features)
    return out.distinct()


def _let_go(df: DataFrame) -> None:
    """Lets Spark remove the shuffles that no plan refers to any more."""
    df.sparkSession._jvm.System.gc()


def _linked(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.col("id").alias("src"), F.col("pid").alias("dst"))).withColumnRenamed("node", "id")


def copies(media: DataFrame, key: str = "media_id", image: str = "image", max_block: int = MAX_BLOCK, look: int = LOOK) -> DataFrame:
    """One row an image: key, copy_of (the smallest key of its component), n_corners.

    Images of equal bytes are copies, unreadable, empty and null ones too (null with null). Repeated rows and null keys
    keep rows of their own; a null key is never the smallest, unless alone. An empty table gives none; other columns
    aren't read. Keys are whole numbers, images under 2^24 pixels a side.
    """
    every = materialise(descriptors(media, key, image), "corners")
    classes = materialise(every.groupBy("id").agg(F.min(key).alias("least"), F.min("row").alias("first"), F.count("*").alias("n")), "classes")
    again = materialise(every.select("id", "row").join(classes.where("n > 1"), "id").where("row <> first").select("row"), "again")
    n = again.count()
    features = every.where(F.size("words") > 0).select("id", "row", "words", "around", "places")
    features = features.join(F.broadcast(again) if n <= MAX_BROADCAST else again, "row", "left_anti") if n else features
    # sizes of keys are only for speed: they are estimated from one image in `look`
    looked = _keys(features.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(look)) == 0)).groupBy("band", "word").agg((F.count("*") * look).alias("n")).where(F.col("n") > max_block)
    heavy = materialise(looked.select("band", "word", F.ceil(F.col("n") / max_block).alias("k")), "heavy")
    tried = _with_pivots(features, heavy)
    links = _agreed(features, tried)
    first = _linked(links)
    k = first.count()
    first = F.broadcast(first) if k <= MAX_BROADCAST else first
    rooted = features.join(first, "id", "left").withColumn("root", F.coalesce("root", "id"))
    # every pair that meets and is of two components still
    met = _meetings(rooted, heavy)
    links = links.unionByName(_agreed(features, met))
    rooted = classes.select("id", "least").join(_linked(links), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = materialise(rooted, "rooted")
    of_root = materialise(rooted.groupBy("root").agg(F.min("least").alias("copy_of")), "components")
    members = rooted.join(of_root, "root").select("id", "copy_of")
    corners = every.select(key, "id", F.size("places").cast("bigint").alias("n_corners"))
    return corners.join(members, "id").select(key, "copy_of", "n_corners")


def rendered(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A media column from vectors, as there are no images among the tables: (media_id, image).

    Each row gives two images: a texture that its values weigh together (media_id 2 x key), and an edited copy of it (2 x key + 1), cropped,
    darkened, or turned by a right angle as key modulo 3 has it. A null key gives two images of null id, a null or empty
    vector a plain picture; of more than 64 values each goes to the texture of its number modulo 64.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                ids, images = [], []
                for k, v in zip(batch.column(0).slice(a, 256).to_pylist(), batch.column(1).slice(a, 256).to_pylist(), strict=True):
                    one = texture(v)
                    ids += [None, None] if k is None else [2 * k, 2 * k + 1]
                    images += [encode_pgm(one), encode_pgm(edited(one, (k or 0) % 3))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], ["media_id", "image"])

    small = embeddings.select(F.col(key).cast("bigint").alias(key), vector)
    tasks = 4 * embeddings.sparkSession.sparkContext.defaultParallelism
    if small.rdd.getNumPartitions() < tasks:  # few vectors make many images
        small = small.repartition(tasks)
    return small.mapInArrow(run, "media_id bigint, image binary")


def _textures(n: int, side: int) -> np.ndarray:
    """Smooth noise, the same in every run."""
    r = np.random.default_rng(5)
    return np.stack([_box(_box(r.normal(size=(side, side)), 1), 1) for _ in range(n)])


_TEXTURES = _textures(64, 64)


def texture(values: list[float | None] | None) -> np.ndarray:
    """A picture of 64 by 64 pixels: near vectors give near pictures."""
    v = np.zeros(64)
    given = np.nan_to_num(np.array([x or 0.0 for x in values or []], np.float64))
    np.add.at(v, np.arange(len(given)) % 64, given)
    sums = np.tensordot(v, _TEXTURES, 1)
    return np.rint(np.clip(127.5 + 127.5 * sums / max(1e-9, 2.5 * float(sums.std())), 0, 255)).astype(np.uint8)


def edited(pixels: np.ndarray, kind: int) -> np.ndarray:
    if kind == 0:
        return pixels[5:, 3:-2]
    if kind == 1:
        return np.rint(pixels * 0.8 + 12).astype(np.uint8)
    return np.rot90(pixels)
