"""Operator 5, media columns: local image descriptors that find cropped or edited copies.

Each greyscale image gives its corners (local maxima of the Harris response, at scales a factor `STEP` apart
down to the smallest that holds a patch; their number grows with the image), each with an orientation from
the intensity centroid and 128 binary tests in the turned frame. Equal images (same pixels) are one class and
are described once. Descriptors meet in Hamming tables, each on a part of the tests; a key takes the tests of a
point and of a neighbour with their places to one another. Two classes that share `SEEDS` keys or more are compared
whole: each descriptor with the nearest of the other image within `DISTANCE` bits, and the pair is a copy if a similarity
transform (scale, turn, shift) that one of these matches proposes agrees with `LEAST` of them or more. So a copy need only
share a few keys, and is then judged by all its corners.

Smooth images share single keys by chance in a good part of all pairs, so shared keys are not shuffled as rows: the
queried classes are dealt to blocks and all classes to parts of bounded size, and each part meets each block by a
shuffled cogroup, where the keys are looked up, counted by pair and the pairs compared. What is read grows with the number
of blocks times the images, one block for each `BLOCK` bytes of queries; nothing but two sums is collected and nothing is
sent to all workers. Images are dealt by hash, so an image's many edits are spread over the parts, and a row for each
image keeps the result as long as the input.

Defined results: a null or malformed image has no class and matches nothing; a flat image has no corners, and
only equal images match it; repeated rows are equal images. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, only

TESTS, STEP, DISTANCE, SEEDS, LEAST = 128, 0.8, 28, 4, 10
#: How far a match's own turn (radians) and scale (logarithm) may be from the transform's.
TURN, RESIZE = 0.5, 0.4
#: Rows whose results leave a worker at once; bytes of points in a block of queries, and in a part of all images at least.
ROWS, BLOCK, PART = 512, 16 << 20, 4 << 20
#: Hamming tables, the tests in each, and how many neighbours of a point make a key with it.
TABLES, BITS, NEAR = 2, 26, 2
RADIUS = 7
_rng = np.random.default_rng(7)
PAIRS = np.clip(_rng.normal(0, RADIUS / 2.2, (TESTS, 4)), -RADIUS + 1, RADIUS - 1)
_OFFSET = np.arange(-RADIUS, RADIUS + 1)
_DISC = (_OFFSET[:, None] ** 2 + _OFFSET[None, :] ** 2) <= RADIUS**2
#: A point: place, scale, angle, and the tests as two words.
POINT = np.dtype([("x", "f4"), ("y", "f4"), ("scale", "f4"), ("angle", "f4"), ("words", "u8", (2,))])


def smoothed(x: np.ndarray) -> np.ndarray:
    """Five-tap binomial blur in both directions."""
    for axis in (0, 1):
        n = x.shape[axis]
        first, last = (x[:1], x[-1:]) if axis == 0 else (x[:, :1], x[:, -1:])
        p = np.concatenate([first, first, x, last, last], axis=axis)
        s = [p[i : i + n] if axis == 0 else p[:, i : i + n] for i in range(5)]
        x = (s[0] + 4 * s[1] + 6 * s[2] + 4 * s[3] + s[4]) / 16
    return x


def scaled(x: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear resampling."""
    h, w = (max(1, round(n * factor)) for n in x.shape)
    r, c = ((np.arange(n) + 0.5) / factor - 0.5 for n in (h, w))
    r, c = np.clip(r, 0, x.shape[0] - 1), np.clip(c, 0, x.shape[1] - 1)
    r0, c0 = r.astype(int), c.astype(int)
    r1, c1 = np.minimum(r0 + 1, x.shape[0] - 1), np.minimum(c0 + 1, x.shape[1] - 1)
    a, b = (r - r0)[:, None], (c - c0)[None, :]
    top, low = x[r0], x[r1]
    return (1 - a) * ((1 - b) * top[:, c0] + b * top[:, c1]) + a * ((1 - b) * low[:, c0] + b * low[:, c1])


def describe(image: np.ndarray) -> np.ndarray:
    """The image's points."""
    out, factor = [np.empty(0, POINT)], 1.0
    while min(image.shape) * factor > 2 * RADIUS + 2.5:
        x = smoothed(scaled(image, factor) if factor != 1 else image.astype(float))
        gy, gx = np.gradient(x)
        xx, yy, xy = smoothed(gx * gx), smoothed(gy * gy), smoothed(gx * gy)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[RADIUS:-RADIUS, RADIUS:-RADIUS]
        p = np.pad(inner, 1, constant_values=-np.inf)
        h, w = inner.shape
        peak = inner > 1e-3
        for i in range(3):
            for j in range(3):
                if (i, j) != (1, 1):
                    peak &= inner >= p[i : i + h, j : j + w]
        r, c = np.nonzero(peak)
        if len(r):
            r, c = r + RADIUS, c + RADIUS
            patch = x[r[:, None, None] + _OFFSET[None, :, None], c[:, None, None] + _OFFSET[None, None, :]] * _DISC
            angle = np.arctan2((patch * _OFFSET[:, None]).sum(axis=(1, 2)), (patch * _OFFSET[None, :]).sum(axis=(1, 2)))
            cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
            turned = [PAIRS[:, 0] * sin + PAIRS[:, 1] * cos, PAIRS[:, 0] * cos - PAIRS[:, 1] * sin, PAIRS[:, 2] * sin + PAIRS[:, 3] * cos, PAIRS[:, 2] * cos - PAIRS[:, 3] * sin]
            t = [np.clip(np.rint(v), -RADIUS, RADIUS).astype(int) for v in turned]
            bits = x[r[:, None] + t[0], c[:, None] + t[1]] < x[r[:, None] + t[2], c[:, None] + t[3]]
            points = np.zeros(len(r), POINT)
            points["x"], points["y"], points["scale"], points["angle"] = (c + 0.5) / factor, (r + 0.5) / factor, 1 / factor, angle
            points["words"] = np.packbits(bits, axis=1).view("<u8")
            out.append(points)
        factor *= STEP
    return np.concatenate(out)


def keys_of(points: np.ndarray) -> np.ndarray:
    """The distinct keys of an image in the Hamming tables.

    A key is a table's tests of a point and of one of its NEAR nearest points of the same scale, how much the one is
    turned against the other, and where it stands in the other's frame, all in eighths of a turn. One point's tests alone
    would meet in most pairs of smooth images.
    """
    out = [np.empty(0, np.int64)]
    for scale in np.unique(points["scale"]):
        p = points[points["scale"] == scale]
        if len(p) < 2:
            continue
        codes = [(p["words"][:, 0] >> np.uint64(t * BITS)) & np.uint64((1 << BITS) - 1) for t in range(TABLES)]
        for i in range(0, len(p), 256):
            dx, dy = (p[c][None, :] - p[c][i : i + 256, None] for c in ("x", "y"))
            d = np.hypot(dx, dy) / scale
            d[d < RADIUS / 2] = np.inf
            one = np.repeat(np.arange(i, i + len(d)), min(NEAR, len(p)))
            two = np.argsort(d, axis=1, kind="stable")[:, :NEAR].ravel()
            fine = np.isfinite(d[one - i, two])
            one, two = one[fine], two[fine]
            eighth = lambda a: (np.floor(a / (np.pi / 4) + 0.5) % 8).astype(np.uint64)
            turn = eighth(p["angle"][two] - p["angle"][one])
            side = eighth(np.arctan2(dy[one - i, two], dx[one - i, two]) - p["angle"][one])
            for t, code in enumerate(codes):
                out.append(((((np.uint64(t) << np.uint64(BITS) | code[one]) << np.uint64(BITS) | code[two]) << np.uint64(6)) | turn << np.uint64(3) | side).astype(np.int64))
    return np.unique(np.concatenate(out))


def pixels(data: bytes | None, width: int | None, height: int | None) -> np.ndarray | None:
    if not data or not width or not height or len(data) != width * height:
        return None
    return np.frombuffer(data, np.uint8).reshape(height, width)


def image_key() -> F.Column:
    """What equal images share; null for null and malformed ones."""
    sound = (F.col("width") > 0) & (F.col("height") > 0) & (F.octet_length("pixels") == F.col("width").cast("long") * F.col("height"))
    return F.when(sound, F.xxhash64("width", "height", "pixels"))


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ROWS rows."""
    return (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))


def descriptors(images: DataFrame) -> DataFrame:
    """(image, points) of images(image, width, height, pixels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            points = [describe(pixels(d.as_py(), w, h)).tobytes() for d, w, h in zip(batch.column("pixels"), batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("image"), pa.array(points, pa.binary())], ["image", "points"])

    return images.select("image", "width", "height", "pixels").mapInArrow(run, "image long, points binary")


def keyed(described: DataFrame) -> DataFrame:
    """(query, points, keys) of images(image, points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            keys = [keys_of(np.frombuffer(p.as_py(), POINT)).tobytes() for p in batch.column("points")]
            yield pa.RecordBatch.from_arrays([batch.column("image"), batch.column("points"), pa.array(keys, pa.binary())], ["query", "points", "keys"])

    return described.select("image", "points").mapInArrow(run, "query long, points binary, keys binary")


def agreement(p: np.ndarray, q: np.ndarray) -> int:
    """The most matches that one match's similarity transform brings within a few pixels, with about its own turn and scale; each place of either image counts once."""
    s = q["scale"].astype(float) / p["scale"]
    t = q["angle"].astype(float) - p["angle"]
    cos, sin = s * np.cos(t), s * np.sin(t)
    px, py, qx, qy = (v.astype(float) for v in (p["x"], p["y"], q["x"], q["y"]))
    x = cos[:, None] * px[None, :] - sin[:, None] * py[None, :] + (qx - cos * px + sin * py)[:, None]
    y = sin[:, None] * px[None, :] + cos[:, None] * py[None, :] + (qy - sin * px - cos * py)[:, None]
    good = np.hypot(x - qx[None, :], y - qy[None, :]) <= 3.0 * np.maximum(1.0, s)[:, None]
    good &= np.abs((t[None, :] - t[:, None] + np.pi) % (2 * np.pi) - np.pi) <= TURN
    good &= np.abs(np.log(s)[None, :] - np.log(s)[:, None]) <= RESIZE
    best = good[int(good.sum(axis=1).argmax())]
    spots = lambda x, y: len(np.unique(np.rint(x[best] / 3) * 1e5 + np.rint(y[best] / 3)))  # noqa: E731  scales repeat corners
    return min(spots(px, py), spots(qx, qy))


def inliers(a: np.ndarray, b: np.ndarray) -> int:
    """How many of two images' points agree on one transform."""
    if len(a) > len(b):
        a, b = b, a
    nearest, far = np.zeros(len(a), int), np.zeros(len(a), int)
    for i in range(0, len(a), 256):
        d = np.bitwise_count(a["words"][i : i + 256, None, :] ^ b["words"][None, :, :]).sum(axis=2, dtype=np.int64)
        nearest[i : i + 256] = d.argmin(axis=1)
        far[i : i + 256] = d.min(axis=1)
    near = np.flatnonzero(far <= DISTANCE)
    return agreement(a[near], b[nearest[near]]) if len(near) >= LEAST else 0


def compared(images: pa.Table, queries: pa.Table) -> pa.Table:
    """(query, image, inliers) of the pairs that are copies, of a part images(image, points) and a block queries(query, points, keys)."""
    each = [np.frombuffer(k.as_py(), np.int64) for k in queries.column("keys")]
    keys, owner = np.concatenate([np.empty(0, np.int64), *each]), np.repeat(np.arange(len(each)), np.array([len(k) for k in each], np.int64))
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    ids, points = queries.column("query").to_pylist(), queries.column("points")
    found: list[tuple[int, int, int]] = []
    for image, data in zip(images.column("image").to_pylist(), images.column("points"), strict=True) if len(keys) else ():
        b = np.frombuffer(data.as_py(), POINT)
        mine = keys_of(b)
        first, last = np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right")
        n = last - first
        met = owner[np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())]
        for q in np.flatnonzero(np.bincount(met) >= SEEDS).tolist():
            if ids[q] != image and (agreeing := inliers(np.frombuffer(points[q].as_py(), POINT), b)) >= LEAST:
                found.append((ids[q], image, agreeing))
    return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["query", "image", "inliers"])


def meetings(described: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, image, inliers) of the pairs of asked(query, points, keys) and described(image, points) that are copies."""
    held = lambda df: df.agg(F.coalesce(F.sum(F.octet_length("points")), F.lit(0))).first()[0]
    all_bytes, query_bytes = held(described), held(asked)
    blocks = -(-query_bytes // BLOCK) or 1
    parts = -(-all_bytes // max(PART, query_bytes // blocks)) or 1
    place = lambda c, n: F.pmod(F.xxhash64(c, F.lit(n)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = described.select(every(blocks).alias("block"), place("image", parts).alias("part"), "image", "points")
    right = asked.select(place("query", blocks).alias("block"), every(parts).alias("part"), "query", "points", "keys")
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(compared, "query long, image long, inliers long")


def pairs(queries: F.Column, images: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, image, asked), classes (image, class_id, copies, n_queries) and pairs (query, image, inliers) of classes.

    Queries are those images for which `queries`, a condition on id, holds.
    """
    known = only(images, "id", "width", "height", "pixels").withColumn("image", image_key())
    rows = scratch.keep(known.select("id", "image", F.coalesce(queries, F.lit(False)).alias("asked")))
    classes = rows.where("image is not null").groupBy("image").agg(F.min("id").alias("class_id"), F.min(F.struct(F.col("id").isNull(), "id")).alias("top"), F.count("*").alias("copies"), F.sum(F.col("asked").cast("long")).alias("n_queries"))
    classes = scratch.keep(classes)
    one = classes.select("image", F.col("top.id").alias("id"))
    first = known.join(one.withColumnRenamed("id", "top_id").withColumnRenamed("image", "top"), (F.col("image") == F.col("top")) & F.col("id").eqNullSafe(F.col("top_id")), "left_semi")
    described = scratch.keep(descriptors(first).dropDuplicates(["image"]))
    asked = scratch.keep(keyed(described.join(classes.where("n_queries > 0").select("image"), "image", "left_semi")))
    found = scratch.keep(meetings(described, asked))
    return rows, classes, found


MATCHES = "array<struct<class_id:long,inliers:long,n_queries:long>>"


def matched(queries: F.Column, images: DataFrame) -> DataFrame:
    """One row for each image: (id, class_id, n_matches, matches).

    class_id is the least id of the equal images; matches holds the classes with queries that the image is a copy of, with
    the number of queries in each; n_matches counts these queries and those equal to the image, itself aside.
    """
    scratch = Scratch(images.sparkSession, "op5")
    rows, classes, found = pairs(queries, images, scratch)
    named = found.join(classes.select(F.col("image").alias("query"), "class_id", "n_queries"), "query")
    per = named.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("class_id", "inliers", "n_queries"))).alias("matches"))  # rows are pairs of different images
    known = classes.join(per, "image", "left").select(F.col("image").alias("key"), "class_id", "n_queries", F.coalesce("matches", F.array().cast(MATCHES)).alias("matches"))
    out = rows.join(known, rows["image"] == known["key"], "left")
    others = F.aggregate("matches", F.lit(0).cast("long"), lambda s, m: s + m["n_queries"])
    n = F.coalesce(F.col("n_queries") - F.col("asked").cast("long") + others, F.lit(0))
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), n.cast("long").alias("n_matches"), F.coalesce("matches", F.array().cast(MATCHES)).alias("matches"))


def search(queries: F.Column, images: DataFrame) -> DataFrame:
    """(query_id, match_id, inliers): the pairs of different images, by the class_id of each."""
    _, classes, found = pairs(queries, images, Scratch(images.sparkSession, "op5"))
    named = lambda a, b: classes.select(F.col("image").alias(a), F.col("class_id").alias(b))
    return found.join(named("query", "query_id"), "query").join(named("image", "match_id"), "image").select("query_id", "match_id", "inliers")


def drawn(vectors: DataFrame, cell: int = 8) -> DataFrame:
    """Images from vectors(vec_id, embedding): the vector as a square grid of grey values (filled up with zeros), spread to the full range and enlarged smoothly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            sizes, data = [], []
            for v in batch.column("embedding"):
                x = np.array([f if f is not None else 0.0 for f in v.as_py() or ()])
                side = int(np.ceil(len(x) ** 0.5))
                x = np.nan_to_num(np.concatenate([x, np.zeros(side * side - len(x))]).reshape(side, side))
                spread = np.abs(x).max() if side else 0
                grey = np.rint(127.5 + 127.5 * x / spread).astype(np.uint8) if spread else np.zeros((side, side), np.uint8)
                image = np.rint(scaled(grey.astype(float), cell)).astype(np.uint8) if side else grey
                sizes.append(side * cell)
                data.append(image.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(sizes, pa.int32()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], ["id", "width", "height", "pixels"])

    return only(vectors, "vec_id", "embedding").mapInArrow(run, "id long, width int, height int, pixels binary")
