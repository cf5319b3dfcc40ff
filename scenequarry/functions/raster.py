"""Polygons as expressions over arrays of points, and bitmaps where pixels are needed: numpy on Arrow batches.

A point is a struct of x and y. Bitmaps travel as run lengths (size [height, width], counts column by column).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def points(*pairs: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in pairs))


def each_point(p: Column, x, y) -> Column:
    """The polygon with its points' coordinates put through x(point) and y(point)."""
    return F.transform(p, lambda v: F.struct(x(v).alias("x"), y(v).alias("y")))


def polygon_area(p: Column) -> Column:
    """Shoelace area; null under three points."""
    turned = F.concat(F.slice(p, 2, 1 << 20), F.slice(p, 1, 1))
    cross = F.zip_with(p, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(p) >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2)


def polygon_bounds(p: Column) -> dict[str, Column]:
    xs, ys = F.transform(p, lambda v: v["x"]), F.transform(p, lambda v: v["y"])
    return {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}


def flipped(p: Column, w, h, direction: str) -> Column:
    across, over = direction in ("horizontal", "diagonal"), direction in ("vertical", "diagonal")
    return each_point(p, lambda v: w - v["x"] if across else v["x"], lambda v: h - v["y"] if over else v["y"])


def resized(p: Column, sx, sy) -> Column:
    return each_point(p, lambda v: v["x"] * sx, lambda v: v["y"] * sy)


def translated(p: Column, dx, dy, w: float, h: float) -> Column:
    """Moved and held inside a w x h image."""
    lim = lambda c, m: F.least(F.greatest(c, F.lit(0.0)), F.lit(m))
    return each_point(p, lambda v: lim(v["x"] + dx, w), lambda v: lim(v["y"] + dy, h))


def cropped(p: Column, x1, y1) -> Column:
    """Coordinates from a crop's corner; what lies outside stays outside."""
    return each_point(p, lambda v: v["x"] - x1, lambda v: v["y"] - y1)


def sheared(p: Column, factor: float, horizontal: bool = True) -> Column:
    return each_point(p, lambda v: v["x"] + factor * v["y"] if horizontal else v["x"], lambda v: v["y"] if horizontal else v["y"] + factor * v["x"])


def split_by_lengths(flat: Column, lengths: Column) -> Column:
    """An array cut into pieces of the given lengths; what is left over is not in any."""
    before = lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, n: a + n)
    return F.transform(lengths, lambda n, i: F.slice(flat, before(i) + 1, n))


def stability(logits: Column, threshold: float = 0.0, offset: float = 1.0) -> Column:
    """Share of the pixels over threshold - offset that are over threshold + offset too; null without any."""
    count = lambda at: F.size(F.filter(logits, lambda v: v > at))
    return count(threshold + offset) / F.nullif(count(threshold - offset), F.lit(0))


def runs_of(bitmap: np.ndarray) -> list[int]:
    """Column-major run lengths, the first of zeros."""
    flat = bitmap.T.ravel().astype(np.int8)
    at = np.flatnonzero(np.diff(flat)) + 1
    n = np.diff(np.concatenate([[0], at, [len(flat)]]))
    return ([0] if len(flat) and flat[0] else []) + n[n > 0].tolist()


def bitmap_of(counts, height: int, width: int) -> np.ndarray:
    values = np.arange(len(counts)) % 2
    return np.repeat(values, np.asarray(counts, int)).reshape(width, height).T.astype(bool)


def _first_center(v: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The first pixel whose center isn't before v, `most` if none of that many is."""
    k = np.clip(np.ceil(v - 0.5), 0, most).astype(int)
    k += (k < most) & (k + 0.5 < v)
    k -= (k > 0) & (k - 0.5 >= v)
    return k


def polygon_runs(xs: np.ndarray, ys: np.ndarray, n: np.ndarray, height: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run lengths of the bitmaps of polygons of n points each, one after another, and how many runs each has.

    Pixels are set whose center lies inside, by the even-odd rule: along a row each edge before a pixel turns it over. There
    is no bitmap: a turn that the row above has too changes nothing down a column, so the others tell where runs begin.
    """
    area = height * width
    stop = np.cumsum(area)
    start, last = stop - area, np.cumsum(n)
    of, after = np.repeat(np.arange(len(n)), n), np.arange(1, len(xs) + 1)
    after[last[n > 0] - 1] = (last - n)[n > 0]
    x2, y2 = xs[after], ys[after]
    low, high = _first_center(np.minimum(ys, y2), height[of]), _first_center(np.maximum(ys, y2), height[of])
    straight = xs == x2  # turns the same pixel in all its rows: one is enough
    m = np.where(straight, np.minimum(high - low, 1), high - low)
    edge = np.repeat(np.arange(len(m)), m)
    y = np.arange(len(edge)) + np.repeat(low - np.cumsum(m) + m, m)
    x = _first_center(xs[edge] + (y + 0.5 - ys[edge]) * (x2[edge] - xs[edge]) / (y2[edge] - ys[edge]), width[of[edge]])
    same = (edge[1:] == edge[:-1]) & (x[1:] == x[:-1])
    turns = []
    for row, new in ((y, np.append(True, ~same)[: len(x)]), (np.where(straight[edge], high[edge], y + 1), np.append(~same, True)[-len(x) :])):  # its own, and the one below
        new = np.flatnonzero(new & (x < width[of[edge]]))
        at, row, p = x[new], row[new], of[edge[new]]
        at, row = np.where(row < height[p], at, at + 1), np.where(row < height[p], row, 0)  # below the lowest pixel is the next column's first
        turns.append((start[p] + row * width[p] + at)[at < width[p]])
    turn = np.sort(np.concatenate(turns))
    first = np.flatnonzero(np.diff(turn, prepend=-1))
    turn = turn[first[np.diff(first, append=len(turn)) % 2 == 1]]
    of = np.searchsorted(stop, turn, side="right")
    y, x = np.divmod(turn - start[of], width[of])
    line = turn - x
    begin = np.flatnonzero(np.diff(line, prepend=-1))
    place = np.arange(len(line)) - np.repeat(begin, np.diff(begin, append=len(line)))
    opens = np.flatnonzero(place % 2 == 0)
    of, x, y, ends = of[opens], x[opens], y[opens], np.append(x, 0)[opens + 1]
    ends = np.where(np.append(line, -1)[opens + 1] == line[opens], ends, width[of])
    m = ends - x
    change = np.repeat(start[of] + x * height[of] + y, m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)) * np.repeat(height[of], m)
    at = np.sort(np.concatenate([change, start[area > 0]]))
    return np.diff(at, append=area.sum()), np.where(area > 0, 1, 0) + np.bincount(of, weights=m, minlength=len(n)).astype(int)


def inside_polygon(xs, ys, height: int, width: int) -> np.ndarray:
    """A polygon's bitmap."""
    return bitmap_of(polygon_runs(np.asarray(xs, float), np.asarray(ys, float), *(np.array([v]) for v in (len(xs), height, width)))[0], height, width)


def in_chunks(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to `most` at most, or one row."""
    ends, low = np.cumsum(size), 0
    while low < len(size):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield low, high
        low = high


def rasterized(p: Column, height: Column, width: Column, cells: int = 1 << 20) -> Column:
    """Run lengths of a polygon's bitmap. Polygons are filled together, up to `cells` pixels or one."""

    @F.arrow_udf("array<int>")
    def run(p: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        n, flat = p.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int), p.flatten()
        xs, ys = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        there = p.is_valid().to_numpy(zero_copy_only=False)
        h, w = (np.where(there, v.to_numpy(zero_copy_only=False), 0).astype(int) for v in (h, w))
        at, runs, many = np.concatenate([[0], np.cumsum(n)]), [np.zeros(0, int)], [np.zeros(0, int)]
        for low, high in in_chunks(h * w, cells):
            points = slice(at[low], at[high])
            some, each = polygon_runs(xs[points], ys[points], n[low:high], h[low:high], w[low:high])
            runs.append(some)
            many.append(each)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(many))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(runs), pa.int32()), mask=pa.array(~there))

    return run(p, height, width)


def pixels_set(counts: Column) -> Column:
    """masks.run_area of runs that are made here: they stay in the Python worker that made them."""

    @F.arrow_udf("long")
    def run(counts: pa.Array) -> pa.Array:
        n, flat = counts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int), counts.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(n)
        odd = (np.arange(len(flat)) - np.repeat(ends - n, n)) % 2 == 1
        total = np.concatenate([[0], np.cumsum(np.where(odd, flat, 0), dtype=int)])
        return pa.array(total[ends] - total[ends - n], mask=~counts.is_valid().to_numpy(zero_copy_only=False))

    return run(counts)


def labelled(bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (from 1) of 8-connected components and their sizes, by joining the runs of neighbouring rows."""
    turn = np.diff(np.pad(bitmap, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, begin), end = np.nonzero(turn == 1), np.nonzero(turn == -1)[1]
    above, wide = (row - 1) * (bitmap.shape[1] + 2), bitmap.shape[1] + 2
    low = np.searchsorted(row * wide + end, above + begin)
    n = np.maximum(np.searchsorted(row * wide + begin, above + end, side="right") - low, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = np.arange(len(row))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    names, label = np.unique(root, return_inverse=True)
    out = np.zeros(bitmap.shape, int)
    out[bitmap] = np.repeat(label + 1, end - begin)
    return out, np.bincount(label, weights=end - begin, minlength=len(names)).astype(int)


def without_small_regions(counts: Column, size: Column, least: int, holes: bool, cells: int = 1 << 22) -> Column:
    """Run lengths of a bitmap with holes filled or islands removed that have fewer pixels than `least`; of islands that
    are all small the largest stays, the first by rows of equal ones. Bitmaps are done together, up to `cells` pixels or one."""

    @F.pandas_udf("array<int>")
    def run(counts: pd.Series, size: pd.Series) -> pd.Series:
        counts, size = counts.tolist(), size.tolist()
        out, at = [None] * len(counts), [k for k, c in enumerate(counts) if c is not None]
        area = [int(size[k][0]) * int(size[k][1]) for k in at]
        while at:
            n, total = 0, 0
            while n < len(at) and (not n or total + area[n] <= cells):
                total, n = total + area[n], n + 1
            for k, c in zip(at[:n], cleaned([counts[k] for k in at[:n]], np.array([size[k] for k in at[:n]], int), least, holes), strict=True):
                out[k] = c
            at, area = at[n:], area[n:]
        return pd.Series(out, dtype=object)

    return run(counts, size)


def cleaned(counts: list, size: np.ndarray, least: int, holes: bool) -> list[np.ndarray]:
    """Run lengths without small regions of bitmaps that stand beside one another, an empty column between them."""
    height, width = size[:, 0], size[:, 1]
    n = np.array([len(c) for c in counts])
    turn = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) % 2 == 1
    pixels = np.repeat(turn, np.concatenate(counts).astype(int))
    first = np.concatenate([[0], np.cumsum(width + 1)])  # a mask's first column
    column = np.repeat(np.arange(len(n)), width + 1)
    tall = np.where(np.arange(first[-1]) - first[column] < width[column], height[column], 0)
    there = np.arange(max(height.max(), 1)) < tall[:, None]
    board = np.zeros(there.shape, bool)
    board[there] = ~pixels if holes else pixels
    parts, sizes = labelled(board)
    small = sizes < least
    if not holes and len(sizes):
        x, y = np.nonzero(board)
        part, mask = parts[board] - 1, column[x]
        begin = np.full(len(sizes), np.iinfo(np.int64).max)
        np.minimum.at(begin, part, y * width[mask] + x - first[mask])
        of = np.zeros(len(sizes), int)
        of[part] = mask
        order = np.lexsort((begin, -sizes, of))
        small[order[np.flatnonzero(np.diff(of[order], prepend=-1))]] = False
    gone = np.concatenate([[False], small])[parts][there]
    pixels = pixels | gone if holes else pixels & ~gone
    area = height * width
    start = (np.cumsum(area) - area)[area > 0]
    change = np.concatenate([[True], pixels[1:] != pixels[:-1]]) if len(pixels) else np.zeros(0, bool)
    change[start] = True
    at = np.flatnonzero(change)
    runs = np.diff(np.append(at, len(pixels)))
    lead = np.searchsorted(at, start)
    set_first = pixels[start]
    runs = np.insert(runs, lead[set_first], 0)
    many = np.zeros(len(n), int)
    many[area > 0] = np.diff(np.append(lead, len(at))) + set_first
    return np.split(runs, np.cumsum(many)[:-1])
