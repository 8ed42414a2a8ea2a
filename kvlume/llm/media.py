"""Cropped or edited copies of images by local descriptors.

Each image gives corners at several scales (Harris responses, local maxima), an
orientation for each (intensity centroid) and 128 binary tests in the corner's
own frame.  Descriptors meet in Hamming tables: each of the four tables is keyed
by 32 of the bits, so near descriptors share a key in some table.  Pairs of
images with enough near descriptors are kept if one similarity transform
explains several of them and a fair share of the smaller image's corners.

Images of equal pixels form a class; class representatives enter the search,
and the result names each image's class.  The stated queries go in blocks of at
most ``BLOCK_POINTS`` corners: a block's four tables are broadcast, and every
task looks its own images' corners up in them.  So neither images nor corners
are shuffled, a key that many images share costs no more than its candidates,
and no candidate is left out, whatever the table's size.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlume.llm.arrow import chunks, share
from kvlume.llm.store import cut

#: Each scale against the one before it; there are as many as an image has room for.
STEP = 0.8
CORNERS = 20  # for each scale and each 96 x 96 pixels, and at least
RADIUS = 15
ANGLES = 36
BITS = 128
MAX_DISTANCE = 18
MIN_INLIERS = 5
#: Inliers against the corners of the image with fewer of them.
MIN_SHARE = 0.17
#: Longer images are scaled down to this side first.
MAX_SIDE = 512
#: Share of the smallest image side by which a point may miss its place.
TOLERANCE = 0.06
#: Corners of the queries that are broadcast at a time.
BLOCK_POINTS = 400_000
#: Candidates, or matches against hypotheses, in hand at a time.
IN_HAND = 1_000_000

_rng = np.random.default_rng(20240101)
_disc = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])
_tests = np.clip(_rng.normal(0, RADIUS / 2, (4 * BITS, 2, 2)), -RADIUS, RADIUS)
_tests = _tests[(np.hypot(_tests[..., 0], _tests[..., 1]) <= RADIUS - 0.5).all(axis=1)][:BITS]


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM or an 8-bit, non-interlaced PNG; None
    for anything else."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                end = at
                while not data[end : end + 1].isspace():
                    if end >= len(data):
                        return None
                    end += 1
                fields.append(int(data[at:end]))
                at = end
            w, h, top = fields
            depth = 1 if data[:2] == b"P5" else 3
            if top > 255 or min(w, h) < 1:
                return None
            a = np.frombuffer(data, np.uint8, w * h * depth, at + 1).reshape(h, w, depth)
        elif data and data[:8] == b"\x89PNG\r\n\x1a\n":
            a = _png(data)
        else:
            return None
        a = a.astype(np.float32)
        return a[..., 0] if a.shape[2] < 3 else a[..., :3] @ np.array([0.299, 0.587, 0.114], np.float32)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        return None


def _png(data: bytes) -> np.ndarray:
    at, body, head = 8, [], None
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, own = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", own)
        elif kind == b"IDAT":
            body.append(own)
        at += 12 + size
    w, h, bits, colour, _, _, interlace = head
    depth = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if bits != 8 or interlace:
        raise ValueError("only 8-bit, non-interlaced PNG")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * depth)
    out = np.zeros((h, w * depth), np.uint8)
    for y in range(h):
        line, kind = rows[y, 1:].astype(int), rows[y, 0]
        up = out[y - 1].astype(int) if y else np.zeros(w * depth, int)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        elif kind == 1:
            out[y] = (np.cumsum(line.reshape(w, depth), axis=0) & 255).ravel()
        else:
            now = np.zeros(w * depth, int)
            for i in range(w * depth):
                a, b, c = (now[i - depth] if i >= depth else 0), up[i], (up[i - depth] if i >= depth else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                now[i] = (line[i] + guess) & 255
            out[y] = now
    return out.reshape(h, w, depth)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2 r + 1, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis, dtype=np.float64)
        n = a.shape[axis]
        take = lambda lo: c[:, lo : lo + n] if axis == 1 else c[:, :, lo : lo + n]  # noqa: B023, E731
        a = ((take(2 * r + 1) - take(0)) / (2 * r + 1)).astype(np.float32)
    return a


def _resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    def weights(n, m):
        x = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.minimum(x.astype(int), max(n - 2, 0))
        out = np.zeros((m, n), np.float32)
        out[np.arange(m), lo] += 1 - (x - lo)
        out[np.arange(m), np.minimum(lo + 1, n - 1)] += x - lo
        return out

    return weights(a.shape[1], h) @ a @ weights(a.shape[2], w).T


def digest(a: np.ndarray) -> bytes:
    """Of an image's pixels, 16 bytes; all blank images have one."""
    from xxhash import xxh3_128

    if a.min() == a.max():
        return bytes(16)
    h = xxh3_128(np.array(a.shape, np.int64).tobytes())
    h.update(np.ascontiguousarray(a).tobytes())
    return h.digest()


def features(stack: np.ndarray) -> list[np.ndarray]:
    """For each image of a stack of one size: rows of the two descriptor words and
    the packed place of a corner."""
    n, h, w = stack.shape
    out: list[list] = [[] for _ in range(n)]
    turn = 2 * np.pi / ANGLES
    rotated = np.zeros((ANGLES, len(_tests), 2, 2), int)
    for k in range(ANGLES):
        c, s = np.cos(k * turn), np.sin(k * turn)
        rotated[k] = np.round(_tests @ np.array([[c, -s], [s, c]]).T)
    margin = RADIUS + 1
    for level in range(256):
        scale = STEP**level
        sh, sw = round(h * scale), round(w * scale)
        if min(sh, sw) < 2 * margin + 3:
            break
        a = _box(stack if level == 0 else _resize(stack, sh, sw), 1)
        gx, gy = np.zeros_like(a), np.zeros_like(a)
        gx[:, :, 1:-1], gy[:, 1:-1] = a[:, :, 2:] - a[:, :, :-2], a[:, 2:] - a[:, :-2]
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        top = r.copy()
        for axis in (1, 2):
            top = np.max([np.roll(top, k, axis) for k in range(-2, 3)], axis=0)
        own = np.where((r == top) & (r > 1.0), r, 0)
        inner = np.zeros_like(own)
        cut_ = np.s_[:, margin:-margin, margin:-margin]
        inner[cut_] = own[cut_]
        flat = inner.reshape(n, -1)
        most = max(CORNERS, round(CORNERS * sh * sw / 96**2))
        best = np.argsort(-flat, axis=1, kind="stable")[:, :most] if flat.shape[1] <= 4096 else _top(flat, most)
        img, col = np.nonzero(np.take_along_axis(flat, best, axis=1) > 0)
        at = best[img, col]
        y, x = at // sw, at % sw
        disc = a[img[:, None], y[:, None] + _disc[:, 0], x[:, None] + _disc[:, 1]]
        disc = disc - disc.mean(axis=1, keepdims=True)
        angle = np.arctan2(disc @ _disc[:, 0], disc @ _disc[:, 1])
        t = rotated[np.round(angle / turn).astype(int) % ANGLES]
        first = a[img[:, None], y[:, None] + t[:, :, 0, 1], x[:, None] + t[:, :, 0, 0]]
        second = a[img[:, None], y[:, None] + t[:, :, 1, 1], x[:, None] + t[:, :, 1, 0]]
        words = np.packbits(first < second, axis=1).view(">i8").astype(np.int64)
        rows = np.column_stack([words, pack_point(x / scale, y / scale, angle, level)])
        for i, (lo, hi) in enumerate(zip(*(np.searchsorted(img, np.arange(n) + k) for k in (0, 1)), strict=True)):
            out[i].append(rows[lo:hi])
    return [np.concatenate(z) if z else np.zeros((0, 3), np.int64) for z in out]


def _top(flat: np.ndarray, k: int) -> np.ndarray:
    part = np.sort(np.argpartition(-flat, k, axis=1)[:, :k], axis=1)
    order = np.argsort(-np.take_along_axis(flat, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


def pack_point(x, y, angle, level: int) -> np.ndarray:
    """Place (1/64 of a pixel), angle and number of the scale in one long."""
    turn = np.round((angle % (2 * np.pi)) / (2 * np.pi) * 4096).astype(np.int64) % 4096
    return np.round(x * 64).astype(np.int64) << 36 | np.round(y * 64).astype(np.int64) << 20 | turn << 8 | level


def unpack_point(geo: np.ndarray) -> np.ndarray:
    """Columns x, y, angle, scale."""
    return np.column_stack([(geo >> 36) / 64, (geo >> 20 & 0xFFFF) / 64, (geo >> 8 & 4095) * (2 * np.pi / 4096), STEP ** (geo & 255)])


def described(media: DataFrame, id_col: str, image_col: str, asked: Column, batch: int = 32) -> DataFrame:
    """id, asked, digest (null if the image can't be decoded), side and points:
    three little-endian longs for each corner, as ``features`` gives them."""
    rows = media.select(F.col(id_col).alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), F.col(image_col).cast("binary").alias("image"))
    schema = T.StructType([rows.schema["id"], rows.schema["asked"], T.StructField("digest", T.BinaryType()), T.StructField("side", T.LongType()), T.StructField("points", T.BinaryType())])

    def run(batches):
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in chunks(whole, sizes, 400_000):
                images = [_bounded(decode(x)) for x in part.column(2).to_pylist()]
                n = len(images)
                side, points = [None] * n, [b""] * n
                by: dict[tuple, list[int]] = {}
                for i, a in enumerate(images):
                    if a is not None:
                        by.setdefault(a.shape, []).append(i)
                for own in by.values():
                    step = max(1, min(batch, 1_000_000 // images[own[0]].size))
                    for k in range(0, len(own), step):
                        some = own[k : k + step]
                        stack = np.stack([images[i] for i in some])
                        for i, f in zip(some, features(stack), strict=True):
                            side[i], points[i] = min(stack.shape[1:]), f.astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([None if a is None else digest(a) for a in images], pa.binary()), pa.array(side, pa.int64()), pa.array(points, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _bounded(a: np.ndarray | None) -> np.ndarray | None:
    if a is None or max(a.shape) <= MAX_SIDE:
        return a
    k = MAX_SIDE / max(a.shape)
    return _resize(_box(a[None], max(1, int(0.5 / k))), max(1, round(a.shape[0] * k)), max(1, round(a.shape[1] * k)))[0]


def consensus(pair: np.ndarray, query: np.ndarray, match: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each pair of images the similarity transform that most of its matches
    agree on, each match's own scales and angles giving a hypothesis: inliers
    (different corners on both sides), scale, angle and shift.

    ``pair``: each match's pair, from 0 and ascending; ``query`` and ``match``:
    packed places; ``side``: the searched image's side, by pair. Ties go to the
    first match. Work is done in slices of about ``IN_HAND`` judgements.
    """
    n = len(side)
    q, m = unpack_point(query), unpack_point(match)
    # a corner found at a smaller scale of its image covers a larger patch there
    grow, turn = q[:, 3] / m[:, 3], m[:, 2] - q[:, 2]
    c, s = grow * np.cos(turn), grow * np.sin(turn)
    dx, dy = m[:, 0] - (c * q[:, 0] - s * q[:, 1]), m[:, 1] - (s * q[:, 0] + c * q[:, 1])
    place = lambda z: np.round(z[:, 0]).astype(np.int64) << 20 | np.round(z[:, 1]).astype(np.int64)
    corners = [np.unique(place(z), return_inverse=True)[1].ravel() for z in (q, m)]
    size = np.bincount(pair, minlength=n)
    first = np.concatenate(([0], np.cumsum(size)))
    load = np.cumsum(size[pair])
    count = np.zeros(len(pair), np.int64)
    at = 0
    while at < len(pair):
        to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + IN_HAND, side="right")))
        k = size[pair[at:to]]
        i = np.repeat(np.arange(at, to), k)
        j = np.repeat(first[pair[at:to]] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(len(i))
        off = np.hypot(c[i] * q[j, 0] - s[i] * q[j, 1] + dx[i] - m[j, 0], s[i] * q[j, 0] + c[i] * q[j, 1] + dy[i] - m[j, 1])
        good = off <= TOLERANCE * side[pair[i]] * np.maximum(1, grow[i])
        i, j = i[good], j[good]
        bend = np.abs((turn[i] - turn[j] + np.pi) % (2 * np.pi) - np.pi)
        good = (bend <= 0.5) & (np.abs(np.log(grow[i] / grow[j])) <= 0.5)
        i, j = i[good], j[good]
        different = [np.bincount(np.unique((i - at) * len(pair) + z[j]) // len(pair), minlength=to - at) for z in corners]
        count[at:to] = np.minimum(*different)
        at = to
    best = np.lexsort((np.arange(len(pair)), -count, pair))[first[:-1]] if n else np.zeros(0, np.int64)
    return count[best], grow[best], (turn[best] + np.pi) % (2 * np.pi) - np.pi, dx[best], dy[best]


class Block:
    """Hamming tables over the corners of a block of query images."""

    def __init__(self, rows: np.ndarray, points: list[bytes]):
        self.rows = rows
        self.size = np.array([len(p) // 24 for p in points], np.int64)
        self.image = np.repeat(np.arange(len(rows)), self.size)
        own = np.frombuffer(b"".join(points), "<i8").reshape(-1, 3)
        self.words, self.geo = [np.ascontiguousarray(own[:, k]).view(np.uint64) for k in (0, 1)], np.ascontiguousarray(own[:, 2])
        self.tables = []
        for t in range(4):
            key = _key(self.words, t)
            order = np.argsort(key, kind="stable")
            self.tables.append((key[order], order))

    def ranges(self, words: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By table: where each corner's key begins in it and how often it occurs."""
        out = []
        for t, (key, _) in enumerate(self.tables):
            own = _key(words, t)
            lo = np.searchsorted(key, own)
            out.append((lo, np.searchsorted(key, own, side="right") - lo))
        return out

    def near(self, words: list[np.ndarray], ranges: list, begin: int, end: int):
        """(corner, query corner) pairs of the corners from ``begin`` to ``end``
        that share a key and are near, each once; about ``IN_HAND`` candidates at
        a time."""
        load = np.cumsum(sum(n[begin:end] for _, n in ranges))
        at = 0
        while at < len(load):
            to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + IN_HAND, side="right")))
            some = slice(begin + at, begin + to)
            for t, ((_, order), (lo, n)) in enumerate(zip(self.tables, ranges, strict=True)):
                k = n[some]
                i = np.repeat(np.arange(some.start, some.stop), k)
                j = order[np.repeat(lo[some] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(len(i))]
                x = [np.repeat(w[some], k) ^ v[j] for w, v in zip(words, self.words, strict=True)]
                good = np.bitwise_count(x[0]).astype(np.int64) + np.bitwise_count(x[1]) <= MAX_DISTANCE
                for before in range(t):  # met in an earlier table already
                    good &= _key(x, before) != 0
                yield i[good], j[good]
            at = to


def _key(words: list[np.ndarray], table: int) -> np.ndarray:
    w = words[table // 2]
    return ((w >> np.uint64(32)) if table % 2 == 0 else w).astype(np.uint32)


def matches(rows: np.ndarray, side: np.ndarray, points: list[bytes], block: Block, min_inliers: int = MIN_INLIERS):
    """Of some images against a block of queries: columns row, query row, matches
    and the consensus of each pair that stands; a few images at a time."""
    size = np.array([len(p) // 24 for p in points], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    own = np.frombuffer(b"".join(points), "<i8").reshape(-1, 3)
    words, geo = [np.ascontiguousarray(own[:, k]).view(np.uint64) for k in (0, 1)], own[:, 2]
    ranges = block.ranges(words)
    load = np.concatenate(([0], np.cumsum(sum(n for _, n in ranges))))[first]
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(load, load[at] + IN_HAND, side="right")) - 1)
        image = np.repeat(np.arange(to - at), size[at:to])
        n_q = len(block.rows)

        def met(at=at, to=to, image=image, n_q=n_q):
            for i, j in block.near(words, ranges, first[at], first[to]):
                yield i, j, image[i - first[at]] * n_q + block.image[j]

        # an image with more candidates than fit in hand is searched twice
        again = load[to] - load[at] > 4 * IN_HAND
        n, held = np.zeros((to - at) * n_q, np.int64), []
        for found in met():
            n += np.bincount(found[2], minlength=len(n))
            if not again:
                held.append(found)
        least = np.maximum(min_inliers, MIN_SHARE * np.minimum.outer(size[at:to], block.size)).ravel()
        stand = (n >= least) & (rows[at:to, None] != block.rows).ravel()
        kept = [[z[stand[pair]] for z in (i, j, pair)] for i, j, pair in (met() if again else held)]
        if kept and stand.any():
            i, j, pair = (np.concatenate(z) for z in zip(*kept, strict=True))
            order = np.lexsort((j, i, pair))
            i, j, pair = i[order], j[order], pair[order]
            which, number = np.unique(pair, return_inverse=True)
            got = consensus(number.ravel(), block.geo[j], geo[i], side[at + which // n_q])
            good = got[0] >= least[which]
            which = which[good]
            yield rows[at + which // n_q], which % n_q, n[which], *[g[good] for g in got]
        at = to


def _placed(own: DataFrame) -> DataFrame:
    """``own`` with the class each image belongs to: class_id, class_row (the row
    that represents it) and class_asked (whether any of its images is)."""
    one = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    same = own.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(one).alias("first"), F.max("asked").alias("any"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("digest", "first", "any")
    alone = F.when(F.col("digest").isNotNull(), F.struct(F.col("id").alias("id"), F.col("row").alias("row")))
    first = F.when(F.col("first").isNotNull(), F.struct(F.col("first.id").alias("id"), F.col("first.row").alias("row"))).otherwise(alone)
    return own.join(same, "digest", "left").select("id", "row", "side", "points", first["id"].alias("class_id"), first["row"].alias("class_row"), F.coalesce("any", "asked").alias("class_asked"))


def search(media: DataFrame, queries: Column, id_col: str = "id", image_col: str = "image", min_inliers: int = MIN_INLIERS, block_points: int = BLOCK_POINTS) -> DataFrame:
    """A row per image and match: id, class_id, query_class, inliers, n_matches,
    scale, angle, dx, dy.

    Queries are the classes with a row for which ``queries`` holds, against all
    others. Each image has a row that names its class, the smallest id of the
    images with equal pixels; matches stand at the row that represents a class,
    one row each; query_class is null where there is none. Null, empty and
    unreadable images (anything but binary PGM or PPM and 8-bit PNG without
    interlacing) have class null and no matches; repeated rows share a class; a
    null id is nobody's class name as long as the class has another id. Columns
    other than the two named ones are not looked at, whatever their names. An
    empty table gives an empty result.
    """
    spark = media.sparkSession
    own = cut(described(media, id_col, image_col, queries).withColumn("row", F.monotonically_increasing_id()))
    placed = _placed(own)
    reps = placed.where(F.col("row") == F.col("class_row")).select("id", "row", "side", "points", "class_asked")
    asked = reps.where(F.col("class_asked") & (F.octet_length("points") >= 24 * min_inliers))
    total = asked.agg(F.coalesce(F.sum(F.octet_length("points")), F.lit(0)).alias("b")).first()["b"] // 24
    n_blocks = max(1, -(-total // block_points))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("query_class", own.schema["id"].dataType), *[T.StructField(c, T.LongType()) for c in ("inliers", "n_matches")], *[T.StructField(c, T.DoubleType()) for c in ("scale", "angle", "dx", "dy")]])
    found = None
    for k in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == k).select("id", "row", "points").toArrow()
        shared = share(spark, (part["id"].combine_chunks(), Block(part["row"].to_numpy(), part["points"].to_pylist())))

        def run(batches, shared=shared):
            names, block = shared()
            for whole in batches:
                for b in chunks(whole, pc.binary_length(whole.column(2)).to_numpy(zero_copy_only=False).astype(np.int64), 256_000):
                    for row, query, n, inliers, *rest in matches(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist(), block, min_inliers):
                        yield pa.RecordBatch.from_arrays([pa.array(row), names.take(pa.array(query)), pa.array(inliers), pa.array(n), *[pa.array(r) for r in rest]], names=schema.names)

        got = reps.where(F.octet_length("points") >= 24 * min_inliers).select("row", "side", "points").mapInArrow(run, schema)
        got = cut(got) if n_blocks > 1 else got
        found = got if found is None else found.unionByName(got)
    return placed.select("id", "row", "class_id").join(found, "row", "left").select(F.col("id").alias(id_col), "class_id", "query_class", "inliers", "n_matches", "scale", "angle", "dx", "dy")
