"""The bucket coder: each side of a box is told by the bucket of a widened proposal in which it lies and an offset in it.

Arrow batches are coded in numpy: buckets lie on the first axis of an array, sides on the second and boxes on the last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry as g

#: A side and the corner field that it sets.
SIDES = {"left": "x1", "right": "x2", "top": "y1", "bottom": "y2"}


def _largest(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Along the first axis the place of the largest value, the first of equal ones, and the value."""
    at, best = np.zeros(v.shape[1:], int), np.full(v.shape[1:], -np.inf)
    for i, x in enumerate(v):
        better = x > best
        np.copyto(at, i, where=better)
        np.copyto(best, x, where=better)
    return at, best


def _corners(box: pa.StructArray) -> np.ndarray:
    return np.array([box.field(f).to_numpy(zero_copy_only=False) for f in g.FIELDS], float)


def _lists(sides: pa.StructArray, n: int) -> np.ndarray:
    return np.array([sides.field(s).flatten().to_numpy(zero_copy_only=False).reshape(len(sides), (n + 1) // 2).T for s in SIDES], float).swapaxes(0, 1)


def _known(values: np.ndarray) -> pa.Array:
    """Null for what isn't a number."""
    return pa.array(values, from_pandas=True)


def _places(box: np.ndarray, n: int, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a side's buckets begin, how they follow each other inwards, and their width."""
    middle, half = (box[:2] + box[2:]) / 2, (box[2:] - box[:2]) * scale / 2
    low, high = middle - half, middle + half
    step = np.repeat((high - low) / n, 2, axis=0)
    return np.array([low[0], high[0], low[1], high[1]]), step * np.array([[1], [-1], [1], [-1]]), step


def coded(box: np.ndarray, truth: np.ndarray, n: int, scale: float, nearest: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each side's bucket, and of all buckets the offsets, which have a weight, and which others are less than one width off."""
    start, move, step = _places(box, n, scale)
    i = np.arange((n + 1) // 2)[:, None, None]
    with np.errstate(all="ignore"):
        offsets = (start + (i + 0.5) * move - truth[[g.FIELDS.index(f) for f in SIDES.values()]]) / step
    far = np.abs(offsets)
    near = -far
    bucket, _ = _largest(near)
    weighed = i == bucket
    close = (far < 1) & ~weighed
    np.copyto(near, -np.inf, where=weighed)
    for _ in range(nearest - 1):
        other = i == _largest(near)[0]
        weighed |= other & (far < reach)
        np.copyto(near, -np.inf, where=other)
    return bucket, offsets, weighed, close


def decoded(box: np.ndarray, scores: np.ndarray, offsets: np.ndarray, n: int, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each side's corner, how sure it is, and the offset that was taken."""
    start, move, step = _places(box, n, scale)
    at, best = _largest(scores)
    taken = np.take_along_axis(offsets, at[None], 0)[0]
    with np.errstate(all="ignore"):
        shares = np.exp(scores - best)
        total = shares.sum(axis=0)
        np.put_along_axis(shares, at[None], -np.inf, 0)
        second, share = _largest(shares)
        return start + (at + 0.5) * move - taken * step, (1 + np.where(np.abs(second - at) == 1, share, 0.0)) / total, taken


def bucket_targets(proposal: g.Box, truth: g.Box, n: int = 14, scale: float = 1.7, nearest: int = 2, reach: float = 1.0, spare_neighbours: bool = True) -> dict[str, Column]:
    """For each side a struct: bucket (the nearest; of equals the outer), offsets to all buckets in widths, the weights of
    these (1 for the bucket itself, and for the others of the `nearest` within `reach`), and the weights of the classes
    (0 for a bucket less than one width off that isn't the nearest, if neighbours are spared)."""

    @F.arrow_udf(", ".join(f"{s} struct<bucket: int, offsets: array<double>, weights: array<double>, classes: array<double>>" for s in SIDES))
    def run(proposal: pa.Array, truth: pa.Array) -> pa.Array:
        bucket, *lists = coded(_corners(proposal), _corners(truth), n, scale, nearest, reach)
        if not spare_neighbours:
            lists[2][:] = False
        lists[2] = ~lists[2]
        ends = pa.array(np.arange(len(proposal) + 1) * ((n + 1) // 2), pa.int32())
        arrays = lambda k: [pa.ListArray.from_arrays(ends, _known(v[:, k].T.ravel().astype(float))) for v in lists]
        return pa.StructArray.from_arrays([pa.StructArray.from_arrays([pa.array(bucket[k], pa.int32()), *arrays(k)], ["bucket", "offsets", "weights", "classes"]) for k in range(4)], list(SIDES))

    sides = run(g.struct(proposal), g.struct(truth))
    return {s: sides[s] for s in SIDES}


def bucket_boxes(proposal: g.Box, scores: dict[str, Column], offsets: dict[str, Column], n: int = 14, scale: float = 1.7, size: tuple | None = None) -> tuple[g.Box, Column]:
    """The box of the highest-scored buckets moved by their offsets, clipped to the last pixel of an image of this size,
    and its confidence: the mean over the sides of the best bucket's soft-max, with the second's if that lies beside it."""

    @F.arrow_udf("x1 double, x2 double, y1 double, y2 double, sure double")
    def run(proposal: pa.Array, scores: pa.Array, offsets: pa.Array) -> pa.Array:
        scores, offsets = _lists(scores, n), _lists(offsets, n)
        offsets[:, np.isnan(scores).all(axis=0)] = np.nan
        corners, sure, _ = decoded(_corners(proposal), scores, offsets, n, scale)
        return pa.StructArray.from_arrays([*map(_known, corners), _known(sum(sure) / 4)], [*SIDES.values(), "sure"])

    unknown = F.array(*[F.lit(None).cast("double")] * ((n + 1) // 2))
    sides = lambda of: F.struct(*(F.coalesce(of[s].cast("array<double>"), unknown).alias(s) for s in SIDES))
    read = run(g.struct(proposal), sides(scores), sides(offsets))
    out = g.of(*(read[f] for f in g.FIELDS))
    if size is not None:
        out = g.clipped(out, size[0] - 1, size[1] - 1)
    return out, read["sure"]


def round_trip(proposal: g.Box, truth: g.Box, n: int = 14, scale: float = 1.7, rows: int = 1 << 11) -> Column:
    """A box coded and read back, with nearness as the buckets' scores: a struct of each side's bucket, how many buckets are
    weighed and spared, the sum of the sides' offsets, the corners, and sure. No arrays leave the task, and `rows` boxes are
    coded at once."""

    @F.arrow_udf(", ".join([*(f"{s} int" for s in SIDES), "weighed long", "spared long", "offsets double", *(f"{f} double" for f in SIDES.values()), "sure double"]))
    def run(proposal: pa.Array, truth: pa.Array) -> pa.Array:
        box, goal, parts = _corners(proposal), _corners(truth), []
        for low in range(0, max(len(proposal), 1), rows):
            some = box[:, low : low + rows]
            bucket, offsets, weighed, close = coded(some, goal[:, low : low + rows], n, scale, 2, 1.0)
            corners, sure, taken = decoded(some, -np.abs(offsets), offsets, n, scale)
            parts.append([*bucket, weighed.sum((0, 1)), close.sum((0, 1)), sum(taken), *corners, sum(sure) / 4])
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns[:4]] + [*map(_known, columns[4:])], [*SIDES, "weighed", "spared", "offsets", *SIDES.values(), "sure"])

    return run(g.struct(proposal), g.struct(truth))
