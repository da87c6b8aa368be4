"""Media columns: edited and cropped copies of images, found by local descriptors.

An image's descriptors are corners of several scales (a Harris response on a pyramid with steps of the root of two),
each with an orientation (towards the centroid of brightness) and 128 binary brightness tests on a pattern that is turned
by it. Descriptors meet in Hamming tables: the bits are cut into four parts, and descriptors of two images that agree in
a part are a match if they differ in at most `distance` bits. Each match votes for a change of size, a turn and a shift;
images with at least `consensus` matches for one such change are copies. Images of equal bytes are one node.

image_groups() finds the components of these links. First each image is compared with the first and the last image of
each part's value that it has, so a group of copies costs its size, not its square. Then, wherever a value is shared by
images of different components, all such pairs are compared; those of the value's most frequent component meet the others
only. So no link between components is missed, however many images share a value.

image_copies() also counts the direct links of each image, for which all images that agree in a part meet; its work
grows with the square of a group of copies.

Cases: null, empty and unreadable images have no corners and no copies; rows with equal images are one node, and a row
without an id has no result of its own node but is returned; an empty table gives an empty result; other columns are
ignored. Images are binary PGM (P5) or PNG of 8 bits without interlacing, which need no library; others are unreadable.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .spark_tools import components, join_checked, stage, table, text_batches
from .text_kernels import released

#: Corners kept for each AREA pixels of an image, and at least; levels of the pyramid; binary tests; descriptors in a
#: block of a part's value.
CORNERS, AREA, LEVELS, BITS, BLOCK = 48, 128 * 128, 5, 128, 256
#: Most pixels of a PNG that is read.
PIXELS = 1 << 26
#: Radius of the pattern and of the disc that gives the orientation; least distance of two points that are compared.
RADIUS, DISC, APART = 11, 7, 7
BORDER = RADIUS + 2


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """The pixels of a binary PGM image with 8 bits, else None."""
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not m or len(data) < m.end() + int(m[1]) * int(m[2]):
        return None
    return np.frombuffer(data, np.uint8, int(m[1]) * int(m[2]), m.end()).reshape(int(m[2]), int(m[1]))


def read_png(data: bytes | None) -> np.ndarray | None:
    """The brightness of a PNG image with 8 bits a channel and without palette or interlacing, else None."""
    if not data or len(data) < 29 or data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR":
        return None
    w, h, depth, kind, *_, laced = (*(int.from_bytes(data[i : i + 4], "big") for i in (16, 20)), *data[24:29])
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(kind)
    if depth != 8 or laced or not channels or not w or not h or w * h > PIXELS:
        return None
    parts, at = [], 8
    while at + 8 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += n + 12
    size = h * (1 + w * channels)
    unpack = zlib.decompressobj()
    try:  # about as much as the header says is unpacked, and no more
        raw = np.frombuffer(unpack.decompress(b"".join(parts), size + 1), np.uint8)
    except zlib.error:
        return None
    if len(raw) < size or len(raw) == size and not unpack.eof:
        return None
    lines = raw[:size].reshape(h, -1)
    if lines[:, 0].max() > 4:
        return None
    pixels = _unfiltered(lines[:, 0], lines[:, 1:].reshape(h, w, channels))
    return pixels[:, :, 0].copy() if channels < 3 else np.rint(pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _unfiltered(how: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The pixels of PNG lines (h, w, channels), with the filter of each line.

    A pixel needs the one before it, the one above it and the one before that, so all pixels of a diagonal are done
    together: step t has pixel t - y of each line y. Lines are skewed for it, with a pixel of zeros before them and a
    line of zeros above.
    """
    h, w, channels = lines.shape
    if not (how > 2).any():  # sums along the lines or down the columns only
        out = np.zeros((h + 1, w, channels), np.uint8)
        for y in range(h):
            line = np.cumsum(lines[y], 0, dtype=np.uint8) if how[y] == 1 else lines[y]
            out[y + 1] = line + out[y] if how[y] == 2 else line
        return out[1:]
    out = np.zeros((h + 1, w + 1, channels), np.int16)
    kinds = how.astype(np.int64)
    for t in range(h + w - 1):
        y = np.arange(max(0, t - w + 1), min(h, t + 1))
        x = t - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]  # before, above, before above
        q = a + b - c
        da, db, dc = abs(q - a), abs(q - b), abs(q - c)
        near = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        guess = np.choose(kinds[y][:, None], [np.zeros_like(a), a, b, (a + b) // 2, near])
        out[y + 1, x + 1] = (lines[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def read_image(data: bytes | None) -> np.ndarray | None:
    pixels = read_pgm(data)
    return read_png(data) if pixels is None else pixels


def write_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def _blur(a: np.ndarray) -> np.ndarray:
    """A 1-2-1 smoothing in the last two directions."""
    p = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(1, 1), (1, 1)], mode="edge")
    a = (p[..., :-2, :] + 2 * p[..., 1:-1, :] + p[..., 2:, :]) / 4
    return (a[..., :-2] + 2 * a[..., 1:-1] + a[..., 2:]) / 4


def _shrinking(n: int, m: int) -> np.ndarray:
    """m x n: each of m pixels as a mean of n ones, weighted by a triangle."""
    at, width = (np.arange(m) + 0.5) * n / m - 0.5, max(1.0, n / m)
    w = np.maximum(0, 1 - np.abs(np.arange(n)[None] - at[:, None]) / width)
    return (w / w.sum(1, keepdims=True)).astype(np.float32)


def _resized(a: np.ndarray, h: int, w: int) -> np.ndarray:
    return _shrinking(a.shape[-2], h) @ a @ _shrinking(a.shape[-1], w).T


def _pattern() -> np.ndarray:
    """Pairs of points within RADIUS pixels of the corner, from a fixed seed."""
    rng, out = np.random.default_rng(7), []
    while len(out) < BITS:
        r, t = RADIUS * np.sqrt(rng.uniform(0.02, 1, 2)), rng.uniform(0, 2 * np.pi, 2)
        pair = np.stack([r * np.cos(t), r * np.sin(t)], -1)
        if np.hypot(*(pair[0] - pair[1])) >= APART:
            out.append(pair)
    return np.array(out)


def _disc() -> np.ndarray:
    y, x = np.mgrid[-DISC : DISC + 1, -DISC : DISC + 1]
    inside = x * x + y * y <= DISC * DISC
    return np.stack([x[inside], y[inside]], 1)


PATTERN, ROUND = _pattern(), _disc()


def _peak(before: np.ndarray, here: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Where between -0.5 and 0.5 a parabola through three values has its top."""
    bend = before - 2 * here + behind
    return np.where(bend < -1e-9, np.clip((before - behind) / np.minimum(2 * bend, -2e-9), -0.5, 0.5), 0.0)


def stacked(images: np.ndarray) -> dict[str, np.ndarray]:
    """Corners of images of one size (n, h, w), by image: image, x, y (pixels), scale, angle, lo and hi (the bits).

    An image's corners are the strongest of each level, of finer levels more than of coarser ones.
    """
    base = images.astype(np.float32)
    _, height, width = base.shape
    most = max(CORNERS, CORNERS * height * width // AREA)
    levels, corners = [], []
    for k in range(LEVELS):
        scale = 2 ** (k / 2)
        h, w = round(height / scale), round(width / scale)
        if min(h, w) < 2 * BORDER + 4:
            break
        level = _blur(_resized(base, h, w) if k else base)
        gy, gx = np.gradient(level, axis=(1, 2))
        xx, yy, xy = (_blur(_blur(v)) for v in (gx * gx, gy * gy, gx * gy))
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[:, BORDER:-BORDER, BORDER:-BORDER]
        ok = inner > 1
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                ok &= inner >= response[:, BORDER + dy : h - BORDER + dy, BORDER + dx : w - BORDER + dx]
        i, y, x = np.nonzero(ok)
        y, x = y + BORDER, x + BORDER
        order = np.lexsort((-response[i, y, x], i))
        i, y, x = i[order], y[order], x[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        dx, dy = _peak(response[i, y, x - 1], response[i, y, x], response[i, y, x + 1]), _peak(response[i, y - 1, x], response[i, y, x], response[i, y + 1, x])
        levels.append(_blur(_blur(level)))
        corners.append((i, x, y, dx, dy, np.full(len(i), k), (rank + 1) * scale))
    names = ("image", "x", "y", "scale", "angle", "lo", "hi")
    if not corners:
        return {n: np.zeros(0, np.int64) for n in names}
    i, x, y, dx, dy, k, place = map(np.concatenate, zip(*corners, strict=True))
    order = np.lexsort((place, i))
    order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < most]
    i, x, y, dx, dy, k = (v[order] for v in (i, x, y, dx, dy, k))
    out = {"image": i, "x": np.zeros(len(i)), "y": np.zeros(len(i)), "scale": 2 ** (k / 2), "angle": np.zeros(len(i)), "lo": np.zeros(len(i), np.int64), "hi": np.zeros(len(i), np.int64)}
    for at, smooth in enumerate(levels):
        _, h, w = smooth.shape
        mine = np.flatnonzero(k == at)
        for lo in range(0, len(mine), 1024):
            own = mine[lo : lo + 1024]
            a, b, c, ex, ey = (v[own] for v in (i, y, x, dx, dy))
            disc = smooth[a[:, None], b[:, None] + ROUND[:, 1], c[:, None] + ROUND[:, 0]]
            angle = np.arctan2(disc @ ROUND[:, 1], disc @ ROUND[:, 0])
            cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            px = np.clip((c + ex)[:, None, None] + cos * PATTERN[:, :, 0] - sin * PATTERN[:, :, 1], 0, w - 1.001)
            py = np.clip((b + ey)[:, None, None] + sin * PATTERN[:, :, 0] + cos * PATTERN[:, :, 1], 0, h - 1.001)
            x0, y0, n = px.astype(np.int32), py.astype(np.int32), a[:, None, None]
            fx, fy = (px - x0).astype(np.float32), (py - y0).astype(np.float32)
            upper, lower = (smooth[n, y0 + d, x0] * (1 - fx) + smooth[n, y0 + d, x0 + 1] * fx for d in (0, 1))
            value = upper * (1 - fy) + lower * fy
            bits = np.packbits(value[:, :, 0] < value[:, :, 1], axis=1).view(">i8").astype(np.int64)
            for name, v in zip(names[1:], ((c + ex + 0.5) * width / w - 0.5, (b + ey + 0.5) * height / h - 0.5, out["scale"][own], angle, bits[:, 0], bits[:, 1]), strict=True):
                out[name][own] = v
    return out


def descriptors(pixels: np.ndarray) -> list[dict]:
    """Corners of one image with x, y and scale in its pixels, the angle, and the bits as two longs."""
    found = stacked(pixels[None])
    return [dict(zip(("x", "y", "scale", "angle", "lo", "hi"), values, strict=True)) for values in zip(*(found[n].tolist() for n in ("x", "y", "scale", "angle", "lo", "hi")), strict=True)]


POINT = {"x": "float", "y": "float", "cx": "float", "cy": "float", "scale": "float", "angle": "float", "lo": "bigint", "hi": "bigint"}
POINTS = f"array<struct<{','.join(f'{n}:{k}' for n, k in POINT.items())}>>"


def describe(images: DataFrame, image: str = "image", fields: tuple[str, ...] = tuple(POINT)) -> DataFrame:
    """The other columns of images with found, an array of descriptors with these fields of POINT; cx and cy are x and y
    from the image's middle."""
    others = [c for c in images.columns if c != image]
    point = {n: POINT[n] for n in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(image)
            pixels = [read_image(x) for x in batch.column(at).to_pylist()]
            sizes: dict[tuple, list[int]] = {}
            for i, p in enumerate(pixels):
                if p is not None and p.size:
                    sizes.setdefault(p.shape, []).append(i)
            parts = []
            for (h, w), rows in sizes.items():
                step = max(1, (1 << 20) // (h * w))  # about a million pixels together
                for lo in range(0, len(rows), step):
                    some = np.array(rows[lo : lo + step])
                    found = stacked(np.stack([pixels[i] for i in some]))
                    parts.append(found | {"image": some[found["image"].astype(np.int64)], "cx": found["x"] - w / 2, "cy": found["y"] - h / 2})
            all_ = {n: np.concatenate([p[n] for p in parts]) if parts else np.zeros(0) for n in ("image", *point)}
            order = np.argsort(all_["image"], kind="stable")
            kinds = {"float": pa.float32(), "bigint": pa.int64()}
            inner = pa.StructArray.from_arrays([pa.array(all_[n][order], kinds[k]) for n, k in point.items()], list(point))
            offsets = np.r_[0, np.cumsum(np.bincount(all_["image"].astype(np.int64), minlength=batch.num_rows))]
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)], [*others, "found"])
        released()

    found = T.StructField("found", T.ArrayType(T.StructType([T.StructField(n, T.LongType() if k == "bigint" else T.FloatType()) for n, k in point.items()])))
    return images.mapInArrow(run, T.StructType([*(f for f in images.schema if f.name != image), found]))


def _part(i: int, lo: str = "lo", hi: str = "hi") -> Column:
    """Thirty-two bits of a descriptor."""
    return F.shiftrightunsigned(lo if i < 2 else hi, 32 * (i % 2)).bitwiseAND(F.lit(0xFFFFFFFF))


def meet(points: DataFrame, distance: int) -> DataFrame:
    """(a, ia, p, b, q) for each two descriptors of images a < b that agree in a part and differ in at most distance
    bits; p and q are their places. points: (node, i, lo, hi, x, y, scale)."""
    parts = F.array(*[F.struct(F.lit(p).alias("p"), _part(p).alias("v")) for p in range(4)])
    probes = stage(points.withColumn("k", F.explode(parts)).select("k.*", "node", "i", "lo", "hi", F.struct(*[c for c in points.columns if c not in ("node", "i", "lo", "hi")]).alias("at")))
    # counts are combined before the shuffle; a value that one image has is done
    sizes = probes.groupBy("p", "v").agg(F.min("node").alias("n0"), F.max("node").alias("n1"), F.count("*").alias("m")).where("n0 < n1")
    sizes = stage(sizes.select("p", "v", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    placed = stage(join_checked(probes, sizes, ["p", "v"], "inner").withColumn("block", F.pmod(F.xxhash64("node", "i"), "blocks").cast("int")))
    # a descriptor goes to each pair of blocks (g, h), g <= h, that has its own
    own = F.struct("node", "i", "lo", "hi", "at")
    left = placed.select("p", "v", F.col("block").alias("g"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("h"), own.alias("l"))
    right = placed.select("p", "v", F.explode(F.sequence(F.lit(0), "block")).alias("g"), F.col("block").alias("h"), own.alias("r"))
    both = left.hint("merge").join(right, ["p", "v", "g", "h"]).where("l.node < r.node or g < h and l.node > r.node")
    both = both.withColumn("xl", F.col("l.lo").bitwiseXOR(F.col("r.lo"))).withColumn("xh", F.col("l.hi").bitwiseXOR(F.col("r.hi")))
    # two descriptors that agree in several parts meet by the first of them
    first = F.lit(True)
    for p in range(3):
        first &= (F.col("p") <= p) | (_part(p, "xl", "xh") != 0)
    both = both.where((F.bit_count("xl") + F.bit_count("xh") <= distance) & first)
    swap = F.col("l.node") > F.col("r.node")
    both = both.select(F.when(swap, F.col("r")).otherwise(F.col("l")).alias("l"), F.when(swap, F.col("l")).otherwise(F.col("r")).alias("r"))
    return both.select(F.col("l.node").alias("a"), F.col("l.i").alias("ia"), F.col("l.at").alias("p"), F.col("r.node").alias("b"), F.col("r.at").alias("q"))


def _described(images: DataFrame, id_col: str, image: str, fields: tuple[str, ...] = tuple(POINT)) -> tuple[DataFrame, DataFrame]:
    """Rows (id, digest), and (node, digest, found) for each different image: the smallest id and the descriptors."""
    keyed = text_batches(images, 256).select(F.col(id_col).cast("long").alias("node"), F.when(F.length(image) > 0, F.sha2(F.col(image), 256)).alias("digest"), F.col(image).alias("image"))
    # images stay where they are: digests are grouped, and one image of each is described in a second pass
    rows = stage(keyed.select(F.col("node").alias("id"), "digest"))
    each = rows.where("digest is not null and id is not null").groupBy("digest", "id").agg(F.count("*").alias("n"))
    first = stage(each.groupBy("digest").agg(F.min("id").alias("node"), F.max("n").alias("n")))
    seen = describe(join_checked(keyed, first.select("node", "digest"), ["node", "digest"], "left_semi"), fields=fields)
    # descriptors move only if an id may have the same image twice
    return rows, stage(seen if first.where("n > 1").isEmpty() else seen.dropDuplicates(["node", "digest"]))


def image_groups(images: DataFrame, id_col: str, image: str = "image", distance: int = 12, consensus: int = 4) -> DataFrame:
    """(id, n_corners, component_id) for each row."""
    rows, seen = _described(images, id_col, image, ("cx", "cy", "scale", "angle", "lo", "hi"))
    # a corner's number and level are one column, so that both sides of the joins below need the same columns and share a
    # shuffle; its place comes along, so that matches need no further join
    level = F.round(2 * F.log2("d.scale")).cast("int")
    corners = seen.select("node", F.posexplode("found").alias("i", "d")).select("node", (F.col("i") * LEVELS + level).alias("corner"), "d.lo", "d.hi", "d.cx", "d.cy", "d.angle")
    points = corners.withColumn("key", F.explode(F.array(*[F.lit(p).cast("long") * (1 << 32) + _part(p) for p in range(4)])))
    near = lambda p, q: F.bit_count(F.col(f"{p}.lo").bitwiseXOR(F.col(f"{q}.lo"))) + F.bit_count(F.col(f"{p}.hi").bitwiseXOR(F.col(f"{q}.hi"))) <= distance
    body = (
        "node", (F.col("corner") / LEVELS).cast("int").alias("i"), "lo", "hi", F.col("cx").alias("x"), F.col("cy").alias("y"), "angle",
        F.pow(F.lit(2.0), F.pmod("corner", F.lit(LEVELS)) / 2).alias("scale"),
    )

    def links(met: DataFrame) -> DataFrame:
        """Pairs (a, b) of images whose matches p, q agree on a change of size, a turn and a shift."""
        matches = met.select(F.col("p.node").alias("a"), F.col("p.i").alias("ia"), "p", F.col("q.node").alias("b"), "q")
        # a pair's matches move once, as numbers of cells; all counts are made where they are
        return stage(_agreeing(_cells(matches).repartition("a", "b"), consensus))

    # 1. all images meet the first and the last image of each value; both sides lie by the value, so they move once
    value = Window.partitionBy("key")
    shared = points.withColumn("first", F.min("node").over(value)).withColumn("last", F.max("node").over(value)).where("first < last")
    hubs = shared.where("node = first or node = last").select("key", F.struct(*body).alias("p"))
    stars = hubs.hint("merge").join(shared.select("key", F.struct(*body).alias("q")), "key").where(near("p", "q") & (F.col("p.node") != F.col("q.node")))
    known = links(stars)
    comps = stage(components(known, "a", "b").select("node", F.col("component").alias("comp")))

    # 2. pairs of different components; the most frequent component of a value only meets the others. Values of one
    # component are done and don't move
    owned = join_checked(points, comps, ["node"]).withColumn("comp", F.coalesce("comp", "node"))
    several = stage(owned.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key"))
    mixed = join_checked(owned, several, ["key"], "left_semi")
    counts = mixed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    main = counts.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"))
    mixed = mixed.hint("merge").join(main, "key")
    body = (*body, "comp", (F.col("comp") == F.col("main")).alias("main"))
    left, right = mixed.where("comp <> main").select("key", F.struct(*body).alias("p")), mixed.select("key", F.struct(*body).alias("q"))
    rest = left.hint("merge").join(right, "key").where(near("p", "q") & (F.col("p.comp") != F.col("q.comp")) & (F.col("q.main") | (F.col("p.node") < F.col("q.node"))))
    # either image may be p, by the value's main component; a pair's matches count together
    swap = F.col("p.node") > F.col("q.node")
    more = links(rest.select(F.when(swap, F.col("q")).otherwise(F.col("p")).alias("p"), F.when(swap, F.col("p")).otherwise(F.col("q")).alias("q")))

    groups = components(known.union(more), "a", "b")
    out = seen.select("digest", "node", F.size("found").alias("n_corners")).join(groups, "node", "left")
    out = stage(out.select("digest", "n_corners", F.coalesce("component", "node").alias("component")))
    final = rows.hint("merge").join(out, "digest", "left")
    return final.select(F.col("id").alias(id_col), F.coalesce("n_corners", F.lit(0)).alias("n_corners"), F.coalesce("component", "id").alias("component_id"))


#: Cells of shifts in pixels and of turns in degrees.
CELL, TURN = 12, 30


def _cells(both: DataFrame) -> DataFrame:
    """(a, b, ia, size, turn, x, y): each match's change of size in half octaves, turn and shift in half cells.

    both: a, ia, p, b, q; p and q are x, y, scale and angle.
    """
    ratio, by = F.col("p.scale") / F.col("q.scale"), F.col("p.angle") - F.col("q.angle")
    degrees = F.pmod(F.degrees(by), F.lit(360.0))
    return both.select("a", "b", "ia", F.round(2 * F.log2(ratio)).cast("int").alias("size"), F.floor(degrees / (TURN / 2)).cast("int").alias("turn"), *[
        F.floor((F.col(f"p.{c}") - ratio * (F.cos(by) * F.col(f"q.{c}") + sign * F.sin(by) * F.col(f"q.{d}"))) / (CELL / 2)).cast("int").alias(c) for c, d, sign in (("x", "y", -1), ("y", "x", 1))
    ])


def _agreeing(cells: DataFrame, consensus: int) -> DataFrame:
    """Pairs (a, b) with at least consensus corners ia whose matches lie in one cell of size, turn and shift.

    cells: those of _cells(). Cells of turns and of shifts lie on two overlapping grids, so each is two half cells.
    """
    half = lambda c, o: F.floor((F.col(c) + o) / 2).cast("int")
    turns = [F.floor(F.pmod(F.col("turn") + t, F.lit(720 // TURN)) / 2).cast("int").alias("t") for t in (0, 1)]
    grids = [F.struct(F.lit(2 * t + o).alias("grid"), turns[t], *[half(c, o).alias(c) for c in ("x", "y")]) for t in (0, 1) for o in (0, 1)]
    votes = cells.select("a", "b", "ia", "size", F.explode(F.array(*grids)).alias("c")).distinct().groupBy("a", "b", "size", "c").agg(F.count("*").alias("n"))
    return votes.where(F.col("n") >= consensus).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def image_copies(images: DataFrame, id_col: str, image: str = "image", distance: int = 24, consensus: int = 4) -> DataFrame:
    """(id, n_corners, n_links, component_id) for each row; n_links: other images found as copies directly."""
    rows, seen = _described(images, id_col, image)
    points = seen.select("node", F.posexplode("found").alias("i", "d")).select("node", "i", "d.lo", "d.hi", "d.x", "d.y", "d.scale", "d.cx", "d.cy", "d.angle")

    # geometric consensus: votes for scale and shift in cells of two overlapping grids; a pair's votes stay in one place
    one = meet(points, distance).repartition("a", "b")
    ratio = F.col("p.scale") / F.col("q.scale")
    shift = lambda c, o: F.floor((F.col(f"p.{c}") - ratio * F.col(f"q.{c}") + o) / 12).cast("int")
    cells = F.array(*[F.struct(F.lit(o).alias("o"), shift("x", o).alias("dx"), shift("y", o).alias("dy")) for o in (0, 6)])
    votes = one.select("a", "b", "ia", ratio.alias("s"), F.explode(cells).alias("c")).groupBy("a", "b", "s", "c").agg(F.count_distinct("ia").alias("n"))
    links = votes.where(F.col("n") >= consensus).select("a", "b")
    # and for turns, beside those within the scatter of angles
    middle = lambda c: F.struct(F.col(f"{c}.cx").alias("x"), F.col(f"{c}.cy").alias("y"), f"{c}.scale", f"{c}.angle").alias(c)
    turned = one.where(F.cos(F.col("p.angle") - F.col("q.angle")) < math.cos(math.radians(12))).select("a", "ia", "b", middle("p"), middle("q"))
    links = stage(links.union(_agreeing(_cells(turned), consensus)).distinct())

    both = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    out = seen.select("digest", "node", F.size("found").alias("n_corners")).join(both, "node", "left").join(components(links, "a", "b"), "node", "left")
    out = stage(out.select("digest", "n_corners", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "node").alias("component")))
    final = rows.select("id", "digest").hint("merge").join(out, "digest", "left")
    return final.select(F.col("id").alias(id_col), F.coalesce("n_corners", F.lit(0)).alias("n_corners"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))


CANVAS, FRAME, EDITS = 160, 104, 11


def _turned(scene: np.ndarray, degrees: float) -> np.ndarray:
    """The middle FRAME x FRAME pixels of a scene that is turned about its middle."""
    t, middle = np.deg2rad(degrees), (len(scene) - 1) / 2
    y, x = np.mgrid[:FRAME, :FRAME] - (FRAME - 1) / 2
    px, py = middle + np.cos(t) * x - np.sin(t) * y, middle + np.sin(t) * x + np.cos(t) * y
    x0, y0 = px.astype(int), py.astype(int)
    fx, fy = px - x0, py - y0
    upper, lower = (scene[y0 + d, x0] * (1 - fx) + scene[y0 + d, x0 + 1] * fx for d in (0, 1))
    return upper * (1 - fy) + lower * fy


def edited(scene: np.ndarray, kind: int) -> np.ndarray:
    """A version of a scene: plain, shifted, cropped, brighter, softer, smaller, larger, turned by 90, 180 and 15 degrees, noisy."""
    o = (len(scene) - FRAME) // 2
    plain, small = scene[o : o + FRAME, o : o + FRAME], FRAME * 7 // 10
    versions = [
        lambda: plain, lambda: scene[o + 9 : o + 9 + FRAME, o - 7 : o - 7 + FRAME], lambda: plain[16 : 16 + small, 16 : 16 + small], lambda: plain * 1.1 + 12, lambda: _blur(plain),
        lambda: _resized(plain, small, small), lambda: _resized(plain, FRAME * 3 // 2, FRAME * 3 // 2), lambda: np.rot90(plain), lambda: np.rot90(plain, 2), lambda: _turned(scene, 15),
        lambda: plain + np.random.default_rng(13).normal(0, 4, plain.shape),
    ]
    return np.clip(np.rint(versions[kind % EDITS]()), 0, 255).astype(np.uint8)


def render(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, image): a media column made from vectors. A vector weighs fixed textures, so equal vectors are one scene; the
    id picks one of EDITS versions of it. Bad vectors have a null image."""
    rows = text_batches(vectors, 256).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases: dict[int, np.ndarray] = {}

        def draw(key: int | None, v: list | None) -> bytes | None:
            if v is None or key is None or not v or not np.isfinite(x := np.array([np.nan if y is None else y for y in v], float)).all() or not x.any():
                return None
            if len(x) not in bases:
                noise = np.random.default_rng(11).standard_normal((len(x), CANVAS, CANVAS)).astype(np.float32)
                total = np.zeros_like(noise)
                for step in range(7):
                    noise = _blur(noise)
                    if step in (2, 4, 6):
                        total += noise / noise.std()
                bases[len(x)] = total.reshape(len(x), -1)
            scene = (x.astype(np.float32) @ bases[len(x)]).reshape(CANVAS, CANVAS)
            return write_pgm(edited(128 + 45 * scene / scene.std(), key))

        for b in batches:
            keys = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(draw, keys, b.column(1).to_pylist())), pa.binary())], ["id", "image"])
        bases.clear()
        released()

    return rows.mapInArrow(run, "id long, image binary").withColumnRenamed("id", id_col)


def planted(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vectors, where each EDITS ids in a row have the vector of the first of them: the versions of one scene."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).withColumn("group", F.floor(F.col("id") / EDITS))
    first = rows.where("v is not null and id is not null").groupBy("group").agg(F.min(F.struct("id", "v")).alias("first"))
    out = rows.select("id", "group").hint("merge").join(first, "group", "left").select(F.col("id").alias(id_col), F.col("first.v").alias(vector_col))
    # few bytes, but much to draw: dealt to all cores
    spark = vectors.sparkSession
    return out.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def op9_media_copies(spark, sf_dir: str) -> DataFrame:
    """Copies among the images that all vectors render to; the ids 0 to 10, 11 to 21, ... are versions of one scene each."""
    return image_groups(render(planted(table(spark, sf_dir, "embeddings"))), "vec_id")
