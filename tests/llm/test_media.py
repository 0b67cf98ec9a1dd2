import numpy as np

from tessera.llm import media


def test_pgm_round_trip():
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode_pgm(media.encode_pgm(a)) == a).all()
    for bad in (None, b"", b"P5", b"P6 1 1 255\nx", b"P5 9 9 255\nx", b"P5 0 0 255\n"):
        assert media.decode_pgm(bad) is None


def picture(seed):
    r = np.random.default_rng(seed)
    return media.texture(r.normal(size=64).tolist())


def test_turning_an_image_turns_its_corners():
    one = picture(0)
    bits = {d[4] for d in media.describe(one)}
    for k in (1, 2, 3):
        assert len(bits & {d[4] for d in media.describe(np.rot90(one, k))}) >= 0.5 * len(bits)


def brute(images, order):
    """Components of all pairs of images with CONSENSUS corners that share a band and one transform."""
    described = [media.describe(p) if (p := media.decode_pgm(b)) is not None else [] for b in images]
    low = list(range(len(images)))

    def linked(i, j):
        if images[i] == images[j]:
            return True
        votes = {}
        for n, (y, x, s, g, b, _) in enumerate(described[i]):
            for py, px, ps, pg, pb, _ in described[j]:
                if (np.frombuffer(b, "<i8") == np.frombuffer(pb, "<i8")).any():
                    turn, size = (g - pg) % media.ANGLES, 2.0 ** (s - ps)
                    t = turn * 2 * np.pi / media.ANGLES
                    ty, tx = y - size * (np.sin(t) * px + np.cos(t) * py), x - size * (np.cos(t) * px - np.sin(t) * py)
                    for half in (0, 0.5):
                        votes.setdefault((turn, s - ps, half, int(np.floor(ty / media.BIN + half)), int(np.floor(tx / media.BIN + half))), set()).add(n)
        return any(len(v) >= media.CONSENSUS for v in votes.values())

    for i in range(len(images)):
        for j in range(i):
            if low[i] != low[j] and (linked(i, j) if order[i] > order[j] else linked(j, i)):
                low = [min(low[i], low[j]) if x in (low[i], low[j]) else x for x in low]
    return low


def test_edited_copies_are_found(spark):
    images = []
    for k in range(10):
        one = picture(k)
        images += [media.encode_pgm(one), media.encode_pgm(media.edited(one, k % 3))]
    images += [images[0], None, None, b"junk", b""]
    rows = list(enumerate(images))
    df = spark.createDataFrame(rows, "media_id bigint, image binary").selectExpr("*", "1 AS id", "2 AS word", "'x' AS content")
    got = {r["media_id"]: r for r in media.copies(df).collect()}
    hashes = df.selectExpr("media_id", "xxhash64(coalesce(sha2(image, 256), '')) AS h").collect()
    want = brute(images, {r["media_id"]: r["h"] for r in hashes})
    assert {k: r["copy_of"] for k, r in got.items()} == {k: want[k] for k in got}
    for k in range(10):
        assert got[2 * k + 1]["copy_of"] == 2 * k
    assert got[20]["copy_of"] == 0 and got[22]["copy_of"] == 21 and got[23]["n_corners"] == 0


def test_a_large_group_of_near_copies(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=64)
    near = [media.encode_pgm(media.texture((base + r.normal(0, 0.004, 64)).tolist())) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(near + [media.encode_pgm(picture(77))])), "media_id bigint, image binary")
    got = {x["media_id"]: x["copy_of"] for x in media.copies(df).collect()}
    assert {got[k] for k in range(60)} == {0} and got[60] == 60


def test_empty_and_rendered(spark):
    df = spark.createDataFrame([(0, [0.1] * 64, 1), (1, None, 1), (None, [0.2], 2)], "vec_id bigint, embedding array<float>, label int")
    made = media.rendered(df)
    assert sorted(str(r["media_id"]) for r in made.collect()) == ["0", "1", "2", "3", "None", "None"]
    assert media.copies(made).count() == 6
    assert media.copies(made.where("false")).count() == 0


def noise(seed, side):
    """Smooth noise of any size, with details as the textures have."""
    a = np.random.default_rng(seed).normal(size=(side, side))
    a = media._box(media._box(a, 1), 1)
    return np.rint(np.clip(127.5 + 51 * a / a.std(), 0, 255)).astype(np.uint8)


def found(spark, pairs):
    """Of pairs (image, other), whether copies() puts each in one component of its own."""
    rows = [(n, media.encode_pgm(p)) for n, p in enumerate(p for pair in pairs for p in pair)]
    got = {r["media_id"]: r["copy_of"] for r in media.copies(spark.createDataFrame(rows, "media_id bigint, image binary")).collect()}
    assert all(got[n] in (n, n // 2 * 2) for n in got)
    return [got[2 * n + 1] == 2 * n for n in range(len(pairs))]


def test_corners_grow_with_the_area_so_crops_are_found(spark):
    big = [noise(k, 256) for k in range(25)]
    assert len(media.describe(big[0])) > 8 * len(media.describe(big[0][:64, :64]))
    assert all(found(spark, [(b, b[64:192, 64:192]) for b in big]))


def test_images_that_are_no_pivot_meet(spark, monkeypatch):
    """Two large images share keys that crops of both hold too, of smaller ids, so that every pivot is a crop. A crop is linked with its own image, and has too few corners of the other."""
    wide, few, own = media.TESTS // 64, media.FEWEST - 1, 2 * media.CONSENSUS
    r = np.random.default_rng(1)
    words, around = (r.integers(-(2**62), 2**62, (3 * few + 6 * own, n)).tolist() for n in (wide, 2))
    shared = [list(range(n * few, n * few + few)) for n in range(3)]
    private = [list(range(3 * few + n * own, 3 * few + n * own + own)) for n in range(6)]
    crops = [shared[n % 3] + private[n] for n in range(6)]
    corners = [*crops, sum(shared, []) + sum(private[:3], []), sum(shared, []) + sum(private[3:], [])]
    place = lambda v: (20 * v << 24 | 28 * v % 200) << media.STAND
    described = [(n, n, n, [w for v in c for w in words[v]], [w for v in c for w in around[v]], [place(v) for v in c]) for n, c in enumerate(corners)]
    lists = "words array<bigint>, around array<bigint>, places array<bigint>"
    monkeypatch.setattr(media, "descriptors", lambda *_: spark.createDataFrame(described, f"media_id bigint, row bigint, id bigint, {lists}"))
    for block in (3, 100):
        assert {x["copy_of"] for x in media.copies(None, max_block=block, look=1).collect()} == {0}
    features = spark.createDataFrame([(n, n % 4, *rest) for n, _, _, *rest in described], f"id bigint, root bigint, {lists}")
    heavy = media._keys(features).groupBy("band", "word").count().where("count > 2").selectExpr("band", "word", "ceil(count / 2) AS k")
    want = {(a, b) for a in range(8) for b in range(a) if a % 4 != b % 4 and set(corners[a]) & set(corners[b])}
    for large in (heavy, heavy.where("false")):
        assert {(x["id"], x["pid"]) for x in media._meetings(features, large).collect()} == want


def slow_describe(pixels):
    """media.describe(), one pixel after the other."""
    h0, w0 = pixels.shape
    found, scale, r = [], 0, media.RADIUS
    at = lambda a, y, x: a[y][x] if 0 <= y < len(a) and 0 <= x < len(a[0]) else 0.0

    def shrunk(row, m):
        ratio, out = len(row) / m, []
        for k in range(m):
            c = (k + 0.5) * ratio - 0.5
            near = [n for n in range(int(np.floor(c)) + 1 - int(np.ceil(max(1, ratio))), int(np.floor(c)) + 1 + int(np.ceil(max(1, ratio))))]
            weights = [max(0.0, 1 - abs(n - c) / max(1, ratio)) for n in near]
            out.append(sum(w * row[min(max(n, 0), len(row) - 1)] for n, w in zip(near, weights, strict=True)) / sum(weights))
        return out

    while True:
        h, w = round(h0 / media.STEP**scale), round(w0 / media.STEP**scale)
        if min(h, w) < 2 * r + 3:
            return found
        a = pixels.astype(float).tolist()
        if scale:
            a = np.array([shrunk(c, h) for c in np.array(a).T]).T
            a = [shrunk(row, w) for row in a.tolist()]
        slope = lambda v, k: (v[1] - v[0]) if k == 0 else (v[-1] - v[-2]) if k == len(v) - 1 else (v[k + 1] - v[k - 1]) / 2
        gy = [[slope([row[x] for row in a], y) for x in range(w)] for y in range(h)]
        gx = [[slope(a[y], x) for x in range(w)] for y in range(h)]
        strength = [[0.0] * w for _ in range(h)]
        for y in range(h):
            for x in range(w):
                square = [(at(gy, y + i, x + j), at(gx, y + i, x + j)) for i in range(-2, 3) for j in range(-2, 3)]
                p, q, s = sum(u * u for u, _ in square), sum(v * v for _, v in square), sum(u * v for u, v in square)
                strength[y][x] = p * q - s * s - 0.05 * (p + q) ** 2
        top = max(map(max, strength))
        inside = [(y, x) for y in range(r, h - r) for x in range(r, w - r)]
        peaks = [(y, x) for y, x in inside if strength[y][x] > 1e-6 * max(1, top) and all(strength[y][x] >= strength[i][j] for i, j in inside if abs(i - y) <= 2 and abs(j - x) <= 2)]
        peaks = sorted(peaks, key=lambda c: (-strength[c[0]][c[1]], c))[: -(-media.CORNERS * max(media.AREA, h0 * w0) // media.AREA)]
        smooth = [[sum(at(a, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) / 9 for x in range(w)] for y in range(h)]
        edge = lambda y, x: a[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]

        def half(y, x):
            """A value between pixels: the mean of its neighbours, first down, then across."""
            down = lambda y, x: smooth[y // 2][x] if y % 2 == 0 else (smooth[y // 2][x] + smooth[y // 2 + 1][x]) / 2
            return down(y, x // 2) if x % 2 == 0 else (down(y, x // 2) + down(y, x // 2 + 1)) / 2

        for y, x in peaks:
            disc = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= r * r]
            my, mx = (sum(smooth[y + i][x + j] * c for (i, j), c in zip(disc, cs, strict=True)) for cs in ([i for i, _ in disc], [j for _, j in disc]))
            angle = round(np.arctan2(my, mx) / (2 * np.pi / media.ANGLES)) % media.ANGLES
            tests = media._PAIRS[angle].tolist()
            bits = [half(2 * y + p[0], 2 * x + p[1]) < half(2 * y + q[0], 2 * x + q[1]) - 1e-6 for p, q in tests]
            blur = lambda p: sum(edge(min(max(y + p[0], 0), h - 1) + i, min(max(x + p[1], 0), w - 1) + j) for i in range(-2, 3) for j in range(-2, 3))  # noqa: E731, B023
            wide = [blur(p) < blur(q) - 1e-6 for p, q in tests[: media.TESTS // 2]]
            found.append(((y + 0.5) * h0 / h - 0.5, (x + 0.5) * w0 / w - 0.5, scale, angle, np.packbits(bits).tobytes(), np.packbits(wide).tobytes()))
        scale += 1


def test_descriptors_against_a_plain_version():
    for pixels in (picture(5)[:30, :34], picture(6)[10:38, 3:40], np.full((20, 20), 7, np.uint8)):
        got, want = media.describe(pixels), slow_describe(pixels)
        assert [d[2:4] for d in got] == [d[2:4] for d in want] and np.allclose([d[:2] for d in got], [d[:2] for d in want])
        for one, two in zip(got, want, strict=True):  # sums in another order may tip a test of two equal points
            assert sum((x ^ y).bit_count() for x, y in zip(one[4] + one[5], two[4] + two[5], strict=True)) <= 2
    both = media.describe_all(np.stack([picture(5), picture(6)]))
    assert both == [media.describe(picture(5)), media.describe(picture(6))]


def test_agree_needs_one_transform():
    r = np.random.default_rng(2)
    words = r.integers(-(2**62), 2**62, (30, media.TESTS // 64))
    places = np.column_stack([r.uniform(0, 200, (30, 2)), np.zeros((30, 2))])
    moved = places + [7, -3, 0, 0]
    assert media.agree(words, places, words, moved)
    assert not media.agree(words, places, words, np.column_stack([r.uniform(0, 200, (30, 2)), np.zeros((30, 2))]))
    assert not media.agree(words, places, r.integers(-(2**62), 2**62, (30, media.TESTS // 64)), moved)


def turned(pixels, degrees):
    """A turn about the middle by linear interpolation; what comes from outside repeats the edge."""
    a, (h, w), p = np.deg2rad(degrees), pixels.shape, pixels.astype(float)
    y, x = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    y, x = np.cos(a) * y + np.sin(a) * x + (h - 1) / 2, np.cos(a) * x - np.sin(a) * y + (w - 1) / 2
    y, x = np.clip(y, 0, h - 1.001), np.clip(x, 0, w - 1.001)
    i, j = y.astype(int), x.astype(int)
    top, low = p[i, j] * (1 - x + j) + p[i, j + 1] * (x - j), p[i + 1, j] * (1 - x + j) + p[i + 1, j + 1] * (x - j)
    return np.rint(top * (1 - y + i) + low * (y - i)).astype(np.uint8)


def sized(pixels, by):
    h, w = (round(n * by) for n in pixels.shape)
    near = lambda n, m: np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1.001)
    y, x, p = near(pixels.shape[0], h)[:, None], near(pixels.shape[1], w)[None], pixels.astype(float)
    i, j = y.astype(int), x.astype(int)
    top, low = p[i, j] * (1 - x + j) + p[i, j + 1] * (x - j), p[i + 1, j] * (1 - x + j) + p[i + 1, j + 1] * (x - j)
    return np.rint(top * (1 - y + i) + low * (y - i)).astype(np.uint8)


def test_resized_turned_and_noisy_copies_are_found(spark):
    r = np.random.default_rng(4)
    edits = [*(lambda p, by=by: sized(p, by) for by in (0.75, 0.9, 0.95, 1.5)), *(lambda p, by=by: turned(p, by) for by in (3, 10, 30))]
    edits.append(lambda p: np.rint(np.clip(p + r.normal(0, 8, p.shape), 0, 255)).astype(np.uint8))
    edits += [lambda p: sized(p, 0.8), lambda p: p[12:52, 12:52], lambda p: np.rint(media._box(np.pad(p.astype(float), 1, mode="edge"), 1)[1:-1, 1:-1] / 9).astype(np.uint8)]
    got = found(spark, [(picture(10 * k + n), edit(picture(10 * k + n))) for k, edit in enumerate(edits) for n in range(10)])
    assert all(sum(got[10 * k : 10 * k + 10]) >= 8 for k in range(len(edits))) and np.mean(got) >= 0.9
