"""Visual features of images, and their roll-up to items.

Images come as Spark's image source reads them: rows of blue, green, red bytes. One Arrow pass over an image makes all its
features with NumPy. Hough lines and circles are approximations of their published methods (Matas 2000, gradient voting).
An unreadable image has counts of 0 and other features null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ("visual_total_shapes", "visual_line_count", "visual_circle_count")
MAXIMA = ("visual_width", "visual_height")
MEANS = ("visual_contrast", "visual_mean", "visual_edge_ratio", "visual_aspect_ratio", "visual_high_freq_ratio", "visual_low_freq_ratio")
# Flat feature and its place in the nested record.
FLAT = {
    "visual_contrast": "pixel_statistics.contrast",
    "visual_mean": "pixel_statistics.mean",
    "visual_edge_ratio": "edge_metrics.edge_ratio",
    "visual_aspect_ratio": "dimensions.aspect_ratio",
    "visual_high_freq_ratio": "frequency_domain.high_freq_ratio",
    "visual_low_freq_ratio": "frequency_domain.low_freq_ratio",
    "visual_total_shapes": "structural_elements.total_shapes",
    "visual_line_count": "structural_elements.line_count",
    "visual_circle_count": "structural_elements.circle_count",
    "visual_width": "dimensions.width",
    "visual_height": "dimensions.height",
}
FLAT_FEATURES = tuple(FLAT)
SCHEMA = (
    "dimensions struct<width:int,height:int,aspect_ratio:double,total_pixels:long,channels:int>, "
    "pixel_statistics struct<mean:double,std:double,min:double,max:double,median:double,contrast:double>, "
    "edge_metrics struct<edge_pixels:long,edge_ratio:double,sobel_mean:double,sobel_max:double,laplacian_mean:double,laplacian_std:double>, "
    "structural_elements struct<line_count:int,circle_count:int,contour_count:int,shapes:struct<triangles:int,rectangles:int,circles:int,polygons:int>,total_shapes:int>, "
    "frequency_domain struct<total_energy:double,low_freq_ratio:double,mid_freq_ratio:double,high_freq_ratio:double>, "
    "complexity_score struct<edge_ratio:double,total_shapes:int,high_freq_ratio:double>"
)
PARTS = ("dimensions", "pixel_statistics", "edge_metrics", "structural_elements", "frequency_domain", "complexity_score")


# ---------------------------------------------------------------- pixels


def luma(bgr: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(bgr @ np.array([0.114, 0.587, 0.299])), 0, 255).astype(np.uint8)


def _padded(gray: np.ndarray) -> np.ndarray:
    """A border that mirrors without repeating the edge; single rows and columns repeat."""
    rows, cols = gray.shape
    pad = np.pad(gray.astype(float), ((1, 1), (0, 0)), "reflect" if rows > 1 else "edge")
    return np.pad(pad, ((0, 0), (1, 1)), "reflect" if cols > 1 else "edge")


def sobel(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = _padded(gray)
    across = p[:, 2:] - p[:, :-2]
    down = p[2:] - p[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def smooth(values: np.ndarray) -> np.ndarray:
    """Means of 3 x 3."""
    p = np.pad(values, 1, "edge")
    rows = p[:-2] + p[1:-1] + p[2:]
    return (rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]) / 9


def laplacian(gray: np.ndarray) -> np.ndarray:
    p = _padded(gray)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def canny(gray: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: gradient maxima along the gradient above high, and those above low that touch them (Canny 1986)."""
    gx, gy = sobel(gray)
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    at = lambda dy, dx: p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay < 0.41421356 * ax, ay > 2.41421356 * ax
    same = (gx * gy) >= 0
    peak = np.where(flat, (size > at(0, -1)) & (size >= at(0, 1)), np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), np.where(same, (size > at(-1, -1)) & (size > at(1, 1)), (size > at(-1, 1)) & (size > at(1, -1)))))
    weak = peak & (size > low)
    label = regions(weak)
    strong = np.zeros(weak.size + 1, bool)
    strong[label[weak & (size > high)]] = True
    return weak & strong[label]


def line_count(edges: np.ndarray, votes: int = 100, least: int = 50, gap: int = 10, seed: int = 7) -> int:
    """Progressive probabilistic Hough lines (Matas 2000): random edge points vote; a bin over the threshold is walked along."""
    ys, xs = np.nonzero(edges)
    if not len(ys):
        return 0
    rows, cols = edges.shape
    angles = np.arange(180) * np.pi / 180
    cos, sin = np.cos(angles), np.sin(angles)
    shift = rows + cols
    width = 2 * shift + 1
    heap = np.zeros(180 * width, np.int32)
    left, voted = edges.copy(), np.zeros(edges.shape, bool)
    found, base = 0, np.arange(180) * width + shift
    bins = lambda x, y: np.rint(np.multiply.outer(x, cos) + np.multiply.outer(y, sin)).astype(np.int64) + base
    order = np.random.default_rng(seed).permutation(len(ys))
    # votes are taken back but never given twice, so without a bin of so many in all there is no line
    most = np.zeros(180 * width, np.int64)
    for k in range(0, len(ys), 4096):
        most += np.bincount(bins(xs[k : k + 4096], ys[k : k + 4096]).reshape(-1), minlength=len(most))
    if most.max() < votes:
        return 0
    for at, i in enumerate(order.tolist()):
        if at % 4096 == 0:  # the bins of so many points at a time
            chunk = order[at : at + 4096]
            table = bins(xs[chunk], ys[chunk])
        x, y = int(xs[i]), int(ys[i])
        if not left[y, x]:
            continue
        own = table[at % 4096]
        now = heap[own] + 1
        heap[own] = now
        voted[y, x] = True
        k = int(now.argmax())
        if now[k] < votes:
            continue
        dx, dy = -sin[k], cos[k]
        scale = max(abs(dx), abs(dy))
        dx, dy = dx / scale, dy / scale
        ends, walked = [], []
        for sign in (1, -1):
            fx, fy, miss, end = float(x), float(y), 0, (x, y)
            while True:
                px, py = round(fx), round(fy)
                if not (0 <= px < cols and 0 <= py < rows):
                    break
                if left[py, px]:
                    miss, end = 0, (px, py)
                    walked.append((px, py))
                else:
                    miss += 1
                    if miss > gap:
                        break
                fx, fy = fx + sign * dx, fy + sign * dy
            ends.append(end)
        good = max(abs(ends[0][0] - ends[1][0]), abs(ends[0][1] - ends[1][1])) >= least
        for px, py in walked:
            if left[py, px]:
                if good and voted[py, px]:
                    heap[bins(px, py)] -= 1
                left[py, px] = False
        found += good
    return int(found)


def circle_count(gray: np.ndarray, distance: int = 20, strong: int = 50, votes: int = 30, least: int = 10, most: int = 100) -> int:
    """Circles by gradient voting: edge points vote along their gradients; peaks with enough support at one radius count."""
    edges = canny(gray, strong // 2, strong)
    ys, xs = np.nonzero(edges)
    if not len(ys):
        return 0
    gx, gy = (smooth(smooth(g)) for g in sobel(gray))  # a pixel's own direction is too coarse on a sharp edge
    vx, vy = gx[ys, xs], gy[ys, xs]
    norm = np.hypot(vx, vy)
    ok = norm > 0
    ys, xs, vx, vy = ys[ok], xs[ok], vx[ok] / norm[ok], vy[ok] / norm[ok]
    rows, cols = gray.shape
    heap = np.zeros(rows * cols, np.int64)
    reach = min(most, int(np.hypot(rows, cols)) + 2)  # centres farther off lie outside the image
    ways = np.concatenate([np.arange(least, reach + 1), -np.arange(least, reach + 1)])
    for k in range(0, len(ys), 1 << 14):  # so many edge points at a time, at every radius to either side
        part = slice(k, k + (1 << 14))
        cx, cy = np.rint(xs[part] + np.outer(ways, vx[part])), np.rint(ys[part] + np.outer(ways, vy[part]))
        inside = (cx >= 0) & (cx < cols) & (cy >= 0) & (cy < rows)
        heap += np.bincount((cy[inside] * cols + cx[inside]).astype(int), minlength=rows * cols)
    p = np.pad(heap.reshape(rows, cols), 1)
    own = p[1:-1, 1:-1]
    peak = (own > votes) & (own > p[1:-1, :-2]) & (own >= p[1:-1, 2:]) & (own > p[:-2, 1:-1]) & (own >= p[2:, 1:-1])
    py, px = np.nonzero(peak)
    kept: list[tuple[int, int]] = []
    for i in np.argsort(-own[py, px], kind="stable").tolist():
        y, x = int(py[i]), int(px[i])
        if any((y - a) ** 2 + (x - b) ** 2 < distance**2 for a, b in kept):
            continue
        radius = np.rint(np.hypot(ys - y, xs - x)).astype(int)
        support = np.bincount(radius[(radius >= least) & (radius <= most)], minlength=most + 1)
        if len(support) and support.max() > votes:
            kept.append((y, x))
    return len(kept)


# ---------------------------------------------------------------- contours


def regions(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Connected regions (8 neighbours, or 4) by number, 0 outside; the first pixel in reading order gives the number.

    Runs of each row are joined with the runs below that they touch; joined runs take the least number, halving the way each round.
    """
    rows, cols = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]  # exclusive
    if not len(row):
        return np.zeros(mask.shape, np.int64)
    # a run meets the runs of the next row that start before its end and end behind its start
    wide = cols + 3
    reach = 1 if diagonal else 0
    low = np.searchsorted((row * wide + end), (row + 1) * wide + start - reach, "right")
    high = np.searchsorted((row * wide + start), (row + 1) * wide + end + reach, "left")
    count = np.maximum(high - low, 0)
    above = np.repeat(np.arange(len(row)), count)
    below = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    root = np.arange(len(row))
    while len(above):
        a, b = root[above], root[below]
        least = np.minimum(a, b)
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        while (root != (up := root[root])).any():
            root = up
        left = root[above] != root[below]
        above, below = above[left], below[left]
    number = (row * cols + start + 1)[root]
    out = np.zeros(mask.size + 1, np.int64)
    out[row * cols + start] += number
    out[row * cols + end] -= number  # the runs of a row never touch, but one may end where the next row's starts
    return np.cumsum(out[:-1]).reshape(mask.shape)


# The eight neighbours clockwise from the left, as row and column steps.
_AROUND = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def border(mask: np.ndarray, y: int, x: int) -> np.ndarray:
    """The outer border from its topmost, leftmost pixel, by following it clockwise (Suzuki and Abe 1985)."""
    rows, cols = mask.shape
    inside = lambda a, b: 0 <= a < rows and 0 <= b < cols and mask[a, b]
    points, here, back = [(x, y)], (y, x), 0
    first = None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            a, b = here[0] + _AROUND[d][0], here[1] + _AROUND[d][1]
            if inside(a, b):
                break
        else:
            break
        if (here, d) == first:
            break
        if first is None:
            first = (here, d)
        here, back = (a, b), (d + 4) % 8
        points.append((b, a))
    return np.array(points[:-1] if len(points) > 1 and points[-1] == points[0] else points)


def polygon_area(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())) / 2


def perimeter(p: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(p, -1, axis=0) - p).T).sum())


def corners(p: np.ndarray, epsilon: float) -> int:
    """Vertices of a closed curve after simplification (Douglas and Peucker 1973) from its two farthest points."""
    if len(p) < 3:
        return len(p)
    a = int(np.argmax(np.hypot(*(p - p[0]).T)))
    a, b = sorted((a, int(np.argmax(np.hypot(*(p - p[a]).T)))))
    kept = {a, b}
    todo = [(a, b), (b, a + len(p))]
    while todo:
        s, e = todo.pop()
        if e - s < 2:
            continue
        inner = p[np.arange(s + 1, e) % len(p)].astype(float)
        start, way = p[s % len(p)].astype(float), (p[e % len(p)] - p[s % len(p)]).astype(float)
        length = np.hypot(*way)
        far = np.abs(way[0] * (inner - start)[:, 1] - way[1] * (inner - start)[:, 0]) / length if length else np.hypot(*(inner - start).T)
        k = int(np.argmax(far))
        if far[k] > epsilon:
            m = s + 1 + k
            kept.add(m % len(p))
            todo += [(s, m), (m, e)]
    return len(kept)


def structure(gray: np.ndarray) -> dict:
    mask = gray > 127
    label = regions(mask)
    shapes = {"triangles": 0, "rectangles": 0, "circles": 0, "polygons": 0}
    outer = outside(mask)
    count = 0
    for n, y, x, box in boxes(label):
        if not outer[y + 1, x]:  # what lies in the hole of another region is no external contour
            continue
        count += 1
        if (box[0].stop - box[0].start - 1) * (box[1].stop - box[1].start - 1) <= 100:
            continue  # so is its area
        p = border(label[box] == n, y - box[0].start, x - box[1].start) + (box[1].start, box[0].start)
        area = polygon_area(p)
        if area <= 100:
            continue
        around = perimeter(p)
        vertices = corners(p, 0.04 * around)
        round_ = around > 0 and 4 * np.pi * area / around**2 > 0.8
        shapes["triangles" if vertices == 3 else "rectangles" if vertices == 4 else "circles" if vertices > 6 and round_ else "polygons"] += 1
    return {"line_count": line_count(canny(gray, 50, 150)), "circle_count": circle_count(gray), "contour_count": count, "shapes": shapes, "total_shapes": sum(shapes.values())}


def boxes(label: np.ndarray) -> Iterator[tuple[int, int, int, tuple[slice, slice]]]:
    """Each region's number, its topmost, leftmost pixel, and the rows and columns that it spans."""
    at = np.flatnonzero(label)
    at = at[np.argsort(label.ravel()[at], kind="stable")]
    numbers = label.ravel()[at]
    cuts = np.flatnonzero(np.diff(numbers, prepend=0))
    if not len(cuts):
        return
    y, x = np.divmod(at, label.shape[1])
    spans = [f.reduceat(v, cuts).tolist() for v in (y, x) for f in (np.minimum, np.maximum)]
    for k, (top, bottom, left, right) in zip(cuts.tolist(), zip(*spans, strict=True), strict=True):
        yield int(numbers[k]), int(y[k]), int(x[k]), (slice(top, bottom + 1), slice(left, right + 1))


def outside(mask: np.ndarray) -> np.ndarray:
    """The background that reaches the frame (4-connected), on a frame one pixel wider."""
    label = regions(np.pad(~mask, 1, constant_values=True), diagonal=False)
    return label == label[0, 0]


# ---------------------------------------------------------------- records


def pixel_features(bgr: np.ndarray) -> dict:
    """Dimensions and pixel statistics."""
    rows, cols, channels = bgr.shape
    plain = bgr.astype(float).mean(axis=2)
    return {
        "dimensions": {"width": cols, "height": rows, "aspect_ratio": round(cols / rows, 3), "total_pixels": rows * cols, "channels": channels},
        "pixel_statistics": {"mean": float(plain.mean()), "std": float(plain.std()), "min": float(plain.min()), "max": float(plain.max()), "median": float(np.median(plain)), "contrast": float(plain.max() - plain.min())},
    }


def features(bgr: np.ndarray) -> dict:
    rows, cols, channels = bgr.shape
    gray = luma(bgr) if channels >= 3 else bgr[:, :, 0]
    middle = float(np.median(gray))
    edges = canny(gray, int(max(0, 0.67 * middle)), int(min(255, 1.33 * middle)))
    gx, gy = sobel(gray)
    size, second = np.sqrt(gx**2 + gy**2), laplacian(gray)
    energy = np.abs(np.fft.fftshift(np.fft.fft2(gray.astype(float))))
    y, x = np.ogrid[:rows, :cols]
    far = np.sqrt((x - cols // 2) ** 2 + (y - rows // 2) ** 2)
    near, wide = min(rows, cols) // 8, min(rows, cols) // 4
    total = float(energy.sum())
    low, mid = float(energy[far <= near].sum()), float(energy[(far <= wide) & (far > near)].sum())
    part = lambda v: v / total if total > 0 else 0.0
    found = pixel_features(bgr) | {
        "edge_metrics": {"edge_pixels": int(edges.sum()), "edge_ratio": float(edges.mean()), "sobel_mean": float(size.mean()), "sobel_max": float(size.max()), "laplacian_mean": float(np.abs(second).mean()), "laplacian_std": float(second.std())},
        "structural_elements": structure(gray),
        "frequency_domain": {"total_energy": total, "low_freq_ratio": part(low), "mid_freq_ratio": part(mid), "high_freq_ratio": part(total - low - mid)},
    }
    found["complexity_score"] = {"edge_ratio": found["edge_metrics"]["edge_ratio"], "total_shapes": found["structural_elements"]["total_shapes"], "high_freq_ratio": found["frequency_domain"]["high_freq_ratio"]}
    return found


def empty_features() -> dict:
    return dict.fromkeys(PARTS) | {"complexity_score": {"edge_ratio": 0.0, "total_shapes": 0, "high_freq_ratio": 0.0}}


def decode(image: dict | None) -> np.ndarray | None:
    """Rows, columns and three channels of an image row; one channel becomes three, alpha goes. None if it can't be read."""
    if not image or (image["height"] or -1) < 1 or (image["width"] or -1) < 1 or not image["data"]:
        return None
    n = image["nChannels"]
    if len(image["data"]) != image["height"] * image["width"] * n:
        return None
    pixels = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], n)
    return np.repeat(pixels, 3, axis=2) if n == 1 else pixels[:, :, :3]


def image_features(images: DataFrame, key: str, image: str = "image", to: str = "visual", pixels_only: bool = False) -> DataFrame:
    """key and the nested features of each image. image: the struct of Spark's image source.

    pixels_only: dimensions and pixel statistics only; the other parts are null, and nothing is computed for them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    schema = StructType([images.schema[key], StructField(to, _parse_datatype_string(SCHEMA))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # an image at a time, so that a batch is never held twice
            read = (decode(r.as_py()) for r in batch.column(1))
            found = [dict.fromkeys(PARTS) | ({} if x is None else pixel_features(x)) if pixels_only else empty_features() if x is None else features(x) for x in read]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(found, arrow.field(1).type)], schema=arrow)

    return images.select(key, F.col(image).alias("image")).mapInArrow(run, schema)


def flat(nested: Column | str = "visual") -> list[Column]:
    """The 11 flat features of a nested record: counts default to 0, others to null."""
    base = F.col(nested) if isinstance(nested, str) else nested
    out = []
    for name, place in FLAT.items():
        part, field = place.split(".")
        value = base[part][field]
        out.append((F.coalesce(value, F.lit(0)) if name in SUMS else value).alias(name))
    return out


def rollup(images: DataFrame, item: str = "item_id") -> DataFrame:
    """One row for each item: counts are summed, sizes are maxima, others are means; over what isn't null."""
    kinds = {n: F.sum for n in SUMS} | {n: F.max for n in MAXIMA} | {n: F.avg for n in MEANS}
    return images.groupBy(item).agg(*[kinds[n](n).alias(n) for n in FLAT_FEATURES])
