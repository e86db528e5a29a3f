"""Rasters as lines: one row for each run of pixels along a line, its colours packed in bytes.

A line of pixels is one row of a few bytes a pixel where the pixel table has one
row for each. Pixels are collected into pieces of lines before any shuffle, so what
travels are runs. Crops cut bytes, flips turn them round, nearest resizes pick them, all
without a shuffle. Whatever needs lines side by side deals runs into bands of
lines, or blocks of columns, of bounded area: one image is many tasks.

Columns are ``image_id, width, height, y, x0, data``: pixels x0, x0 + 1, ... of line
y as R, G, B, A bytes. Runs of a line may come apart in any way and order.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import cut, with_few

CHANNELS = ["r", "g", "b", "a"]
RUN = ["image_id", "width", "height", "y", "x0", "data"]
#: Pixels of a band or block, besides what its edges need; and lines of a band at most.
AREA, BAND = 1 << 21, 256
#: Pixels of a run that is packed, and pieces of lines that are packed together, at most.
PIECE, PIECES = 1024, 1024
#: Weights of a resize are whole numbers of this unit, so that sums are exact in any order.
UNIT = 1 << 14
SUPPORT = {"Bilinear": 1.0, "CatmullRom": 2.0, "Mitchell": 2.0, "Lanczos3": 3.0}


def _kind(df: DataFrame) -> str:
    return df.schema["image_id"].dataType.simpleString()


def _schema(df: DataFrame, more: str = "") -> str:
    return f"image_id {_kind(df)}, width int, height int, y int, x0 int, data binary{more}"


def _ints(t: pa.Table | pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    return tuple(t.column(c).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(c).to_numpy() for c in names)


def _binary(starts: np.ndarray, data: np.ndarray) -> pa.Array:
    """Consecutive pieces of bytes, each from its start to the next."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All pixels of a column of runs as rows of four bytes, and the number of each run."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 4), np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return flat.reshape(-1, 4), np.diff(offsets) // 4


def _spread(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every pixel of some runs: the run it belongs to, its y and x, and its colour."""
    data, sizes = _bytes(t.column("data"))
    y, x0 = _ints(t, "y", "x0")
    run = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    return run, y[run], x0[run] + np.arange(len(data)) - first[run], data


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


#: Rows of small results that go back to Spark together.
ROWS = 4096


def grouped(df: DataFrame, keys: list[str], run: Callable[[tuple, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on the rows of each value of the keys, one group at a time.

    As ``groupBy().applyInArrow()``, but a task's groups come sorted in common batches:
    a corpus of small images has very many groups, and a stream of its own for each
    costs more than the work on it. A window asks for whole groups one after another,
    so rows that are dealt by the keys already are not shuffled again.
    """

    def go(batches: Iterator[pa.RecordBatch]):
        left, done, rows = None, [], 0
        for batch in _and_then(batches, None):
            if batch is not None:
                t = pa.Table.from_batches([batch])
                t = t if left is None else pa.concat_tables([left, t])
                left = None
            elif left is None:
                break
            else:
                t, left = left, None
            if not t.num_rows:
                continue
            codes = [t.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
            starts = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in codes])))
            stops = np.append(starts[1:], t.num_rows)
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                if b == t.num_rows and batch is not None:  # may go on in the next batch
                    left = t.slice(a)
                    break
                own = t.slice(a, b - a).combine_chunks()
                done.append(run(tuple(own.column(k)[0] for k in keys), own))
                rows += done[-1].num_rows
                if rows >= ROWS:
                    yield from pa.concat_tables(done).combine_chunks().to_batches()
                    done, rows = [], 0
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    return df.withColumn("place", place).mapInArrow(go, schema)


def _and_then(items: Iterator, last) -> Iterator:
    yield from items
    yield last


def pack(pixels: DataFrame) -> DataFrame:
    """Runs of a pixel table, of at most ``PIECE`` pixels.

    Pixels are collected into pieces of lines, each as one number, before anything goes to
    Python: what costs there is the row, not its pixels. Those that are dealt by image
    already are not shuffled for it.
    """
    byte = lambda c, bits: F.shiftleft(F.col(c).cast("long").bitwiseAND(255), bits)
    value = F.shiftleft(F.col("x").cast("long"), 32)
    for k, c in enumerate(CHANNELS):
        value = value.bitwiseOR(byte(c, 8 * k))
    ints = [F.col(c).cast("int").alias(c) for c in ("width", "height", "y")]
    pieces = pixels.groupBy("image_id", *ints, F.floor(F.col("x") / PIECE).alias("piece")).agg(F.sort_array(F.collect_list(value)).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for b in (whole.slice(at, PIECES) for at in range(0, whole.num_rows, PIECES)):
                cells = b.column("cells")
                sizes, values = np.diff(cells.offsets.to_numpy()), cells.flatten().to_numpy()
                of, x = np.repeat(np.arange(len(sizes)), sizes), values >> 32
                starts = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (x[1:] != x[:-1] + 1)))
                data = values.astype(np.uint32).view(np.uint8)  # lowest byte first: R, G, B, A
                rows = pa.array(of[starts])
                yield _batch([*(b.column(c).take(rows) for c in ("image_id", "width", "height", "y")), pa.array(x[starts].astype(np.int32)), _binary(starts * 4, data)], RUN)

    return pieces.select("image_id", "width", "height", "y", "cells").mapInArrow(run, _schema(pixels))


def unpack(lines: DataFrame) -> DataFrame:
    """The pixel table of runs."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            of, y, x, data = _spread(b)
            ids, (width, height) = b.column("image_id").take(pa.array(of)), _ints(b, "width", "height")
            yield _batch([ids, *(pa.array(c.astype(np.int32)) for c in (width[of], height[of], x, y)), *(pa.array(data[:, k].astype(np.int32)) for k in range(4))], ["image_id", "width", "height", "x", "y", *CHANNELS])

    return lines.select(*RUN).mapInArrow(run, f"image_id {_kind(lines)}, width int, height int, x int, y int, r int, g int, b int, a int")


def _size() -> Column:
    return (F.octet_length("data") / 4).cast("int")


def _piece(low: Column, high: Column) -> Column:
    """The pixels of a run from column low up to high (not included)."""
    return F.substring("data", (low - F.col("x0")) * 4 + 1, (high - low) * 4)


def crop_lines(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """G1 over lines: each image's box (``image_id, x, y, w, h``), cut to the image; images without a box go."""
    box = boxes.select("image_id", *(F.col(c).cast("int").alias(f"b_{c}") for c in ("x", "y", "w", "h")))
    both = with_few(lines, box, "image_id").where((F.col("y") >= F.col("b_y")) & (F.col("y") < F.col("b_y") + F.col("b_h")))
    low, high = F.greatest("x0", "b_x"), F.least(F.col("x0") + _size(), F.col("b_x") + F.col("b_w"))
    left, top = F.greatest("b_x", F.lit(0)), F.greatest("b_y", F.lit(0))
    both = both.withColumns({"low": low, "high": high}).where("low < high")
    width, height = F.least(F.col("b_x") + F.col("b_w"), "width") - left, F.least(F.col("b_y") + F.col("b_h"), "height") - top
    return both.select("image_id", width.alias("width"), height.alias("height"), (F.col("y") - top).alias("y"), (F.col("low") - left).alias("x0"), _piece(F.col("low"), F.col("high")).alias("data"))


def bounds_of_lines(lines: DataFrame, threshold: int = 25) -> DataFrame:
    """A10 over lines: ``image_id, x, y, w, h`` of what differs from the corners' mean; no row if all does, or nothing."""
    ends = lines.where((F.col("y") == 0) | (F.col("y") == F.col("height") - 1))

    def corners(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            of, y, x, data = _spread(b)
            width, height = _ints(b, "width", "height")
            times = ((y == 0).astype(int) + (y == height[of] - 1)) * ((x == 0).astype(int) + (x == width[of] - 1))
            at = np.flatnonzero(times)
            yield _batch([b.column("image_id").take(pa.array(of[at])), *(pa.array(data[at, k].astype(np.int64) * times[at]) for k in range(3))], ["image_id", "r", "g", "b"])

    back = ends.select(*RUN).mapInArrow(corners, f"image_id {_kind(lines)}, r long, g long, b long").groupBy("image_id").agg(*(F.floor(F.sum(c) / 4).alias(f"b{c}") for c in "rgb"))

    def other(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            of, y, x, data = _spread(b)
            means = np.stack(_ints(b, "br", "bg", "bb"), axis=1)
            far = (np.abs(data[:, :3].astype(np.int64) - means[of]) > threshold).any(axis=1)
            of, y, x = of[far], y[far], x[far]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, int)
            last = np.append(first[1:], len(of)) - 1 if len(of) else first
            runs, (width, height) = of[first], _ints(b, "width", "height")
            yield _batch([b.column("image_id").take(pa.array(runs)), *(pa.array(c.astype(np.int32)) for c in (width[runs], height[runs], x[first], x[last], y[first]))], ["image_id", "width", "height", "x", "x2", "y"])

    found = with_few(lines, back, "image_id").select(*RUN, "br", "bg", "bb").mapInArrow(other, f"image_id {_kind(lines)}, width int, height int, x int, x2 int, y int")
    box = found.groupBy("image_id", "width", "height").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x2") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    return box.where(~((F.col("w") == F.col("width")) & (F.col("h") == F.col("height")))).select("image_id", "x", "y", "w", "h")


def trim_lines(lines: DataFrame, threshold: int = 25) -> DataFrame:
    """G3 over lines: each image cut to its content; images without bounds stay whole."""
    box = bounds_of_lines(lines, threshold).select("image_id", *(F.col(c).alias(f"b_{c}") for c in ("x", "y", "w", "h")))
    some = with_few(lines, box, "image_id", "left")
    whole = {"x": F.lit(0), "y": F.lit(0), "w": F.col("width"), "h": F.col("height")}
    some = some.withColumns({f"b_{c}": F.coalesce(F.col(f"b_{c}"), d).cast("int") for c, d in whole.items()})
    low, high = F.greatest("x0", "b_x"), F.least(F.col("x0") + _size(), F.col("b_x") + F.col("b_w"))
    some = some.withColumns({"low": low, "high": high}).where((F.col("y") >= F.col("b_y")) & (F.col("y") < F.col("b_y") + F.col("b_h")) & (F.col("low") < F.col("high")))
    return some.select("image_id", F.col("b_w").alias("width"), F.col("b_h").alias("height"), (F.col("y") - F.col("b_y")).alias("y"), (F.col("low") - F.col("b_x")).alias("x0"), _piece(F.col("low"), F.col("high")).alias("data"))


def _grid(t: pa.Table, width: int, low: int, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines ``low`` and on of one image from its runs, and which pixels are there."""
    _, y, x, data = _spread(t)
    grid, there = np.zeros((lines, width, 4), np.int64), np.zeros((lines, width), bool)
    grid[y - low, x], there[y - low, x] = data, True
    return grid, there


def _runs(image: pa.Scalar, kind: pa.DataType, width: int, height: int, top: int, left: int, grid: np.ndarray, there: np.ndarray | None = None) -> pa.Table:
    """Runs of a part of an image whose corner lies at ``left, top``."""
    if there is None or there.all():
        n = len(grid)
        y, x, starts, data = top + np.arange(n), np.full(n, left), np.arange(n) * grid.shape[1] * 4, grid.astype(np.uint8)
    else:
        y, x = np.nonzero(there)
        data = grid[y, x].astype(np.uint8)
        first = np.flatnonzero(np.append(True, (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1))) if len(y) else np.zeros(0, int)
        y, x, starts = top + y[first], left + x[first], first * 4
    n = len(y)
    ids = pa.repeat(image, n) if image.is_valid else pa.nulls(n, kind)
    return pa.table([ids.cast(kind), *(pa.array(np.broadcast_to(c, n).astype(np.int32)) for c in (width, height, y, x)), _binary(starts, data.ravel())], names=RUN)


def _band(area: int = AREA) -> Column:
    """Lines of a band of an image of this width."""
    return F.greatest(F.lit(1), F.least(F.lit(BAND), F.floor(F.lit(area) / F.greatest("width", F.lit(1))))).cast("int")


def _sums(values: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """Sums over windows of ``2 * radius + 1`` places along an axis, cut at the edges."""
    n = values.shape[axis]
    total = np.concatenate([np.zeros_like(values.take([0], axis)), values.cumsum(axis)], axis)
    at = np.arange(n)
    return total.take(np.minimum(at + radius + 1, n), axis) - total.take(np.maximum(at - radius, 0), axis)


def _filtered(grid: np.ndarray, there: np.ndarray, amount: float, radius: int, width: int, height: int) -> np.ndarray:
    """W2 then W1 over lines side by side of an image of this size."""
    if amount > 0 and width > 2 and len(grid) > 2:
        middle = grid[1:-1, 1:-1, :3].astype(np.float64)
        around = (grid[1:-1, :-2, :3] + grid[1:-1, 2:, :3] + grid[:-2, 1:-1, :3] + grid[2:, 1:-1, :3]).astype(np.float64)
        grid = grid.copy()
        grid[1:-1, 1:-1, :3] = np.floor(np.clip(middle + (4.0 * middle - around) * amount, 0.0, 255.0))
    if radius > 0 and width >= 3 and height >= 3:
        here = there[:, :, None].astype(np.int64)
        for axis in (1, 0):
            grid = _sums(grid * here, radius, axis) // np.maximum(_sums(here, radius, axis), 1)
    return grid


def filter_lines(lines: DataFrame, amount: float = 0.0, radius: int = 0) -> DataFrame:
    """W2 then W1 over lines, one shuffle: bands of lines, each with the lines around it that its edges need."""
    amount, radius = min(amount, 1.0), min(radius, 50)
    if amount <= 0 and radius <= 0:
        return lines
    halo = max(radius, 0) + (amount > 0)
    dealt = lines.select(*RUN).withColumn("lines", _band())
    first, last = F.floor(F.greatest(F.col("y") - halo, F.lit(0)) / F.col("lines")), F.floor(F.least(F.col("y") + halo, F.col("height") - 1) / F.col("lines"))
    dealt = dealt.withColumn("band", F.explode(F.sequence(first, last)))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        width, height, size = (t.column(c)[0].as_py() for c in ("width", "height", "lines"))
        y = t.column("y").to_numpy()
        low = int(y.min())
        grid, there = _grid(t, width, low, int(y.max()) - low + 1)
        grid = _filtered(grid, there, amount, radius, width, height)
        top = key[1].as_py() * size
        own = slice(max(top - low, 0), top + size - low)
        return _runs(key[0], t.schema.field("image_id").type, width, height, max(top, low), 0, grid[own], there[own])

    return grouped(dealt, ["image_id", "band"], run, _schema(lines))


def _kernel(name: str, t: np.ndarray) -> np.ndarray:
    d = np.abs(t)
    if name == "Bilinear":
        return np.where(d < 1, 1 - d, 0.0)
    if name == "Lanczos3":
        s = lambda v: np.where(v == 0, 1.0, np.sin(math.pi * v) / np.where(v == 0, 1.0, math.pi * v))
        return np.where(d < 3, s(t) * s(t / 3), 0.0)
    b, c = (0.0, 0.5) if name == "CatmullRom" else (1 / 3, 1 / 3)
    near = ((12 - 9 * b - 6 * c) * d * d * d + (-18 + 12 * b + 6 * c) * d * d + (6 - 2 * b)) / 6
    far = ((-b - 6 * c) * d * d * d + (6 * b + 30 * c) * d * d + (-12 * b - 48 * c) * d + (8 * b + 24 * c)) / 6
    return np.where(d < 1, near, np.where(d < 2, far, 0.0))


@functools.lru_cache(64)
def taps(src: int, dst: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the result: the source places that it takes from, and their whole weights (0 for none)."""
    scale = src / dst
    wide = max(1.0, scale)
    centre = (np.arange(dst) + 0.5) * scale
    reach = SUPPORT[name] * wide
    low, high = np.maximum(0, np.floor(centre - reach).astype(int)), np.minimum(src - 1, np.ceil(centre + reach).astype(int))
    places = low[:, None] + np.arange((high - low).max() + 1)
    k = np.where(places <= high[:, None], _kernel(name, (places + 0.5 - centre[:, None]) / wide), 0.0)
    total = np.array([sum(row) for row in k.tolist()])  # one after another
    return np.minimum(places, src - 1), np.floor(k / total[:, None] * UNIT + 0.5).astype(np.int64)


def _resampled(grid: np.ndarray, axis: int, dst: int, name: str) -> np.ndarray:
    """Sums of weighted lines or columns, tap by tap, in whole numbers."""
    places, weights = taps(grid.shape[axis], dst, name)
    shape = [1, 1, 1]
    shape[axis] = dst
    total = sum(grid.take(places[:, k], axis) * weights[:, k].reshape(shape) for k in range(places.shape[1]))
    return np.clip((total + UNIT // 2) // UNIT, 0, 255)


def _premultiplied(grid: np.ndarray) -> np.ndarray:
    out = grid.copy()
    out[..., :3] = np.floor(grid[..., :3] * (grid[..., 3:] / 255.0) + 0.5)
    return out


def _unpremultiplied(grid: np.ndarray) -> np.ndarray:
    out, a = grid.copy(), grid[..., 3:]
    share = np.where(a == 0, 1.0, a / 255.0)
    out[..., :3] = np.where(a == 0, 0, np.minimum(255, np.floor(np.minimum(grid[..., :3], a) / share + 0.5)))
    return out


def resize_lines(lines: DataFrame, dims: DataFrame, name: str = "Lanczos3") -> DataFrame:
    """G4 and G5 over lines: to ``image_id, out_w, out_h``; images without sizes go.

    Nearest takes whole runs apart where they are. The other filters work on
    premultiplied colour: bands of whole lines are resampled along x, what comes out
    goes to blocks of columns, and those are resampled along y. Pixels that are not
    there count as transparent black.
    """
    size = dims.select("image_id", F.col("out_w").cast("int").alias("out_w"), F.col("out_h").cast("int").alias("out_h"))
    both = with_few(lines.select(*RUN), size, "image_id")
    if name == "Nearest":

        def pick(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                width, height, y, x0, out_w, out_h = _ints(b, "width", "height", "y", "x0", "out_w", "out_h")
                data, sizes = _bytes(b.column("data"))
                first = np.cumsum(sizes) - sizes
                # results whose middle falls into these columns, and into this line
                nearest = lambda n, src, dst: np.ceil(n * dst / src - 0.5).astype(np.int64)
                guess = lambda n, src, dst: _from(nearest(n, src, dst), n, src, dst)
                left, right = guess(x0, width, out_w), guess(x0 + sizes, width, out_w)
                top, low = guess(y, height, out_h), guess(y + 1, height, out_h)
                lines_, columns = low - top, right - left
                keep = np.flatnonzero((lines_ > 0) & (columns > 0))
                run = np.repeat(keep, lines_[keep])  # one row for each line of the result
                if not len(run):
                    continue
                ny = top[run] + np.arange(len(run)) - np.repeat(np.cumsum(lines_[keep]) - lines_[keep], lines_[keep])
                n = columns[run]
                starts = np.cumsum(n) - n
                each = np.repeat(run, n)
                nx = left[each] + np.arange(len(each)) - np.repeat(starts, n)
                at = first[each] + np.floor((nx + 0.5) * width[each] / out_w[each]).astype(np.int64) - x0[each]
                yield _batch([b.column("image_id").take(pa.array(run)), *(pa.array(c.astype(np.int32)) for c in (out_w[run], out_h[run], ny, left[run])), _binary(starts * 4, data[at].ravel())], RUN)

        return both.mapInArrow(pick, _schema(lines))

    def along_x(key: tuple, t: pa.Table) -> pa.Table:
        width, height, out_w, out_h = (t.column(c)[0].as_py() for c in ("width", "height", "out_w", "out_h"))
        y = np.unique(t.column("y").to_numpy())
        low = int(y.min())
        grid, _ = _grid(t, width, low, int(y.max()) - low + 1)
        done = _resampled(_premultiplied(grid[y - low]), 1, out_w, name).astype(np.uint8)
        step = max(1, min(out_w, AREA // max(height, out_h)))
        parts = []
        for block in range(-(-out_w // step)):
            piece = np.ascontiguousarray(done[:, block * step : (block + 1) * step])
            n, ids = len(y), pa.repeat(key[0], len(y)) if key[0].is_valid else pa.nulls(len(y), t.schema.field("image_id").type)
            numbers = (np.full(n, c, np.int32) for c in (out_w, out_h, height, block, block * step))
            parts.append(pa.table([ids.cast(t.schema.field("image_id").type), *map(pa.array, numbers), pa.array(y.astype(np.int32)), _binary(np.arange(n) * piece.shape[1] * 4, piece.ravel())], names=["image_id", "out_w", "out_h", "height", "block", "x0", "y", "data"]))
        return pa.concat_tables(parts)

    def along_y(key: tuple, t: pa.Table) -> pa.Table:
        out_w, out_h, height, x0 = (t.column(c)[0].as_py() for c in ("out_w", "out_h", "height", "x0"))
        data, sizes = _bytes(t.column("data"))
        grid = np.zeros((height, int(sizes[0]), 4), np.int64)
        grid[t.column("y").to_numpy()] = data.reshape(len(sizes), -1, 4)
        done = _unpremultiplied(_resampled(grid, 0, out_h, name))
        return _runs(key[0], t.schema.field("image_id").type, out_w, out_h, 0, x0, done)

    banded = both.withColumn("band", F.floor(F.col("y") / _band()).cast("int"))
    blocks = grouped(banded, ["image_id", "band"], along_x, f"image_id {_kind(lines)}, out_w int, out_h int, height int, block int, x0 int, y int, data binary")
    return grouped(blocks, ["image_id", "block"], along_y, _schema(lines))


def _from(guess: np.ndarray, n: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The first place of the result whose source ``floor((place + 0.5) * src / dst)`` is n or more."""
    source = lambda p: np.floor((p + 0.5) * src / dst)
    guess = np.where(source(guess - 1) >= n, guess - 1, guess)
    guess = np.where(source(guess) < n, guess + 1, guess)
    return np.clip(guess, 0, dst)


def _asked(many: DataFrame, ops: DataFrame) -> DataFrame:
    """Rows with what ``ops`` asks for their image, ``rotate, fh, fv``; nothing where it has no row."""
    asked = ops.select("image_id", F.coalesce("rotate", F.lit(0)).cast("int").alias("rotate"), F.coalesce("flip_h", F.lit(False)).alias("fh"), F.coalesce("flip_v", F.lit(False)).alias("fv"))
    return with_few(many, asked, "image_id", "left").withColumns({"rotate": F.coalesce("rotate", F.lit(0)), "fh": F.coalesce("fh", F.lit(False)), "fv": F.coalesce("fv", F.lit(False))})


def transform_lines(lines: DataFrame, ops: DataFrame) -> DataFrame:
    """G2 over lines: rotate clockwise by 0, 90, 180 or 270, then flip; ``ops`` is ``image_id, rotate, flip_h, flip_v``.

    Only quarter turns shuffle: pieces of lines go to blocks of columns, which are the new lines.
    """
    both = cut(_asked(lines.select(*RUN), ops))

    def turn(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            width, height, y, x0, rotate = _ints(b, "width", "height", "y", "x0", "rotate")
            back, down = ((rotate == 180) != f for f in _ints(b, "fh", "fv"))
            data, sizes = _bytes(b.column("data"))
            first = np.cumsum(sizes) - sizes
            run = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(data)) - first[run]
            data = data[first[run] + np.where(back[run], sizes[run] - 1 - at, at)]
            left = np.where(back, width - x0 - sizes, x0)
            yield _batch([b.column("image_id"), b.column("width"), b.column("height"), *(pa.array(c.astype(np.int32)) for c in (np.where(down, height - 1 - y, y), left)), _binary(first * 4, data.ravel())], RUN)

    step = F.greatest(F.lit(1), F.floor(F.lit(AREA) / F.greatest("height", F.lit(1)))).cast("int")
    quarter = both.where(F.col("rotate").isin(90, 270)).withColumn("step", step).withColumn("block", F.explode(F.sequence(F.floor(F.col("x0") / F.col("step")), F.floor((F.col("x0") + _size() - 1) / F.col("step")))))
    low, high = F.greatest(F.col("x0"), (F.col("block") * F.col("step")).cast("int")), F.least(F.col("x0") + _size(), ((F.col("block") + 1) * F.col("step")).cast("int"))
    quarter = quarter.withColumns({"low": low, "high": high}).withColumn("data", _piece(F.col("low"), F.col("high"))).withColumn("x0", F.col("low")).drop("low", "high")

    def quarters(key: tuple, t: pa.Table) -> pa.Table:
        width, height, rotate, fh, fv = (t.column(c)[0].as_py() for c in ("width", "height", "rotate", "fh", "fv"))
        _, y, x, data = _spread(t)
        ny, nx = (x, height - 1 - y) if rotate == 90 else (width - 1 - x, y)
        nx, ny = (height - 1 - nx) if fh else nx, (width - 1 - ny) if fv else ny
        top = int(ny.min())
        grid, there = np.zeros((int(ny.max()) - top + 1, height, 4), np.int64), np.zeros((int(ny.max()) - top + 1, height), bool)
        grid[ny - top, nx], there[ny - top, nx] = data, True
        return _runs(key[0], t.schema.field("image_id").type, height, width, top, 0, grid, there)

    turned = grouped(quarter.select(*RUN, "rotate", "fh", "fv", "block"), ["image_id", "block"], quarters, _schema(lines))
    return both.where(~F.col("rotate").isin(90, 270)).mapInArrow(turn, _schema(lines)).unionByName(turned)


#: Pixels of an image that is edited as a whole, at most; and of a batch of results, nearly.
WHOLE, OUT = 1 << 14, 1 << 16


def _content(grid: np.ndarray, there: np.ndarray, threshold: int) -> tuple[slice, slice]:
    """Lines and columns of what differs from the corners' mean; all of them if nothing does, or no corner is there."""
    height, width = there.shape
    corners = [(y, x) for y in (0, height - 1) for x in (0, width - 1) if there[y, x]]
    if corners:
        mean = sum(grid[y, x, :3] for y, x in corners) // 4
        far = there & (np.abs(grid[..., :3] - mean) > threshold).any(axis=2)
        lines, columns = np.flatnonzero(far.any(axis=1)), np.flatnonzero(far.any(axis=0))
        if len(lines):
            return slice(lines[0], lines[-1] + 1), slice(columns[0], columns[-1] + 1)
    return slice(None), slice(None)


def edit_images(pixels: DataFrame, trim: int | None = None, ops: DataFrame | None = None, amount: float = 0.0, radius: int = 0) -> DataFrame:
    """G8 over the pixels of images of at most ``WHOLE`` pixels: each is put together, and trimmed, turned and filtered where it is.

    Nothing but ``ops`` is written or shuffled if the pixels are dealt by image.
    """
    amount, radius = min(amount, 1.0), min(radius, 50)
    value = F.shiftleft(F.col("y").cast("long") * F.col("width") + F.col("x"), 32)
    for k, c in enumerate(CHANNELS):
        value = value.bitwiseOR(F.shiftleft(F.col(c).cast("long").bitwiseAND(255), 8 * k))
    images = pixels.groupBy("image_id", *(F.col(c).cast("int").alias(c) for c in ("width", "height"))).agg(F.sort_array(F.collect_list(value)).alias("cells"))
    images = images.withColumns({"rotate": F.lit(0), "fh": F.lit(False), "fv": F.lit(False)}) if ops is None else _asked(images, ops)

    def edited(width: int, height: int, values: np.ndarray, rotate: int, fh: bool, fv: bool) -> tuple[np.ndarray, np.ndarray]:
        grid, there = np.zeros((height, width, 4), np.int64), np.zeros((height, width), bool)
        y, x = np.divmod(values >> 32, width)
        grid[y, x], there[y, x] = values.astype(np.uint32).view(np.uint8).reshape(-1, 4), True
        if trim is not None:
            own = _content(grid, there, trim)
            grid, there = grid[own], there[own]
        turns = {90: -1, 180: 2, 270: 1}.get(rotate, 0)
        grid, there = np.rot90(grid, turns), np.rot90(there, turns)
        across, down = slice(None, None, -1 if fh else 1), slice(None, None, -1 if fv else 1)
        grid, there = grid[down, across], there[down, across]
        if amount > 0 or radius > 0:
            lines = np.flatnonzero(there.any(axis=1))
            own = slice(lines[0], lines[-1] + 1)
            grid = grid.copy()
            grid[own] = _filtered(grid[own], there[own], amount, radius, grid.shape[1], grid.shape[0])
        return grid, there

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            cells, at, parts, size = b.column("cells"), [], [], 0
            bounds, values = cells.offsets.to_numpy() - cells.offsets[0].as_py(), cells.flatten().to_numpy()
            heads = zip(*(b.column(c).to_pylist() for c in ("width", "height", "rotate", "fh", "fv")), strict=True)
            for k, (width, height, *asked) in enumerate(heads):
                grid, there = edited(width, height, values[bounds[k] : bounds[k + 1]], *asked)
                y, x = np.nonzero(there)
                at.append(k)
                parts.append((np.full(len(y), grid.shape[1]), np.full(len(y), grid.shape[0]), x, y, *grid[y, x].astype(np.uint8).T))
                size += len(y)
                if size >= OUT or k == b.num_rows - 1:
                    ids = b.column("image_id").take(pa.array(np.repeat(at, [len(p[0]) for p in parts])))
                    yield _batch([ids, *(pa.array(np.concatenate(c).astype(np.int32)) for c in zip(*parts, strict=True))], ["image_id", "width", "height", "x", "y", *CHANNELS])
                    at, parts, size = [], [], 0

    return images.mapInArrow(run, f"image_id {_kind(pixels)}, width int, height int, x int, y int, r int, g int, b int, a int")
