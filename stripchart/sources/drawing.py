"""Polylines from the drawing operators of pages.

Operators are rows (page_id, op_pos, op, args array<double>, sub_ops array<string>) in drawing
order. Keeping a stack of transforms is sequential within a page, so pages are dealt by their id,
sorted, and read one after another in Arrow batches; a page may go on in the next batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripchart.session import parts_of, ship

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
SCHEMA = "page_id long, poly_id int, pts array<struct<x:double,y:double>>, r double, g double, b double, w double"
_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_ARROW = pa.schema([("page_id", pa.int64()), ("poly_id", pa.int32()), ("pts", _POINTS), ("r", pa.float64()), ("g", pa.float64()), ("b", pa.float64()), ("w", pa.float64())])


def _product(a, b):
    return (
        a[0] * b[0] + a[2] * b[1],
        a[1] * b[0] + a[3] * b[1],
        a[0] * b[2] + a[2] * b[3],
        a[1] * b[2] + a[3] * b[3],
        a[0] * b[4] + a[2] * b[5] + a[4],
        a[1] * b[4] + a[3] * b[5] + a[5],
    )


#: Numbers an operator of a path takes; the last two are its end.
TAKES = {"moveTo": 2, "lineTo": 2, "curveTo": 6, "curveTo2": 4, "curveTo3": 4, "rectangle": 4}
#: Points that a batch of polylines holds before it is handed on.
HELD = 200_000


class Pen:
    """State while one page is read. Points are the ends of strokes in page coordinates, as arrays
    of (x, y); a curve gives its end only, a rectangle drops the path, filling drops it, stroking
    keeps it."""

    def __init__(self, page_id: int, viewport, follow: bool):
        self.page_id, self.viewport, self.follow = page_id, tuple(viewport or IDENTITY), follow
        self.ctm, self.stack = IDENTITY, []
        self.colour, self.width = (0.0, 0.0, 0.0), 1.0
        self.path: list[np.ndarray] = []
        self.done: list[tuple] = []

    def copy(self, follow: bool) -> Pen:
        other = Pen(self.page_id, self.viewport, follow)
        other.colour, other.width, other.path, other.done = self.colour, self.width, list(self.path), list(self.done)
        other.ctm, other.stack = self.ctm, list(self.stack)
        return other

    def flush(self) -> None:
        if sum(map(len, self.path)) > 1:
            self.done.append((np.concatenate(self.path), *self.colour, self.width))
        self.path = []

    def add(self, ends: np.ndarray) -> None:
        m = _product(self.viewport, self.ctm) if self.follow else self.viewport
        if m == IDENTITY:
            self.path.append(ends + 0.0)  # as the product would, of a negative zero too
            return
        x, y = ends[:, 0], ends[:, 1]
        placed = np.empty_like(ends)
        placed[:, 0], placed[:, 1] = m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]
        self.path.append(placed)

    def strokes(self, ends: np.ndarray, breaks: list[tuple[int, bool]]) -> None:
        """The parts of a path by their ends; breaks: places of moves (True) and rectangles."""
        at = 0
        for i, moves in breaks:
            if i > at:
                self.add(ends[at:i])
            at = i
            if moves:
                self.flush()
            else:
                self.path, at = [], i + 1
        if len(ends) > at:
            self.add(ends[at:])

    def paint(self, parts: list[float]) -> None:
        self.colour = tuple(c / 255 for c in parts) if max(parts) > 1 else tuple(parts)

    def step(self, op: str, args: np.ndarray) -> None:
        match op:
            case "save" if self.follow:
                self.stack.append(self.ctm)
            case "restore" if self.follow:
                self.ctm = self.stack.pop() if self.stack else self.ctm
            case "transform" if self.follow:
                self.ctm = _product(self.ctm, args.tolist())
            case "setStrokeRGBColor":
                self.paint(args[:3].tolist())
            case "setStrokeGray":
                self.paint([float(args[0])] * 3)
            case "setStrokeColorN" if len(args) >= 3:
                self.paint(args[:3].tolist())
            case "setStrokeColorN" if len(args) == 1:
                self.paint([float(args[0])] * 3)
            case "setLineWidth":
                self.width = float(args[0])
            case "moveTo" | "lineTo":
                if op == "moveTo":
                    self.flush()
                self.add(args[-2:].reshape(1, 2))
            case "stroke" | "closeStroke" | "fillStroke":
                self.flush()
            case "endPath" | "fill" | "eoFill":
                self.path = []


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, stops) of a column of lists; a null list is an empty one."""
    offsets = column.offsets.to_numpy()
    values = column.values
    values = values.to_numpy(zero_copy_only=False) if pa.types.is_floating(values.type) else _names(values)
    starts = offsets[:-1]
    return values, starts, np.where(column.is_valid().to_numpy(zero_copy_only=False), offsets[1:], starts)


def _names(values: pa.Array) -> np.ndarray:
    """Strings as an array of objects, each different one made once."""
    coded = values.dictionary_encode()
    known = np.array([*coded.dictionary.to_pylist(), None], object)
    return known[coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)]


def _paths(batch: pa.RecordBatch) -> tuple[np.ndarray, list[int], list[int], list[tuple[int, bool]], list[int]]:
    """The ends of all paths of a batch, where those of each row start and stop, the places of
    moves (True) and rectangles among them, and where those of each row start."""
    args, a0, a1 = _lists(batch.column("args"))
    names, s0, s1 = _lists(batch.column("sub_ops"))
    s1 = np.where(_names(batch.column("op")) == "constructPath", s1, s0)
    row = np.repeat(np.arange(len(s0)), s1 - s0)
    at = np.arange(len(row)) - np.repeat(np.cumsum(s1 - s0) - (s1 - s0), s1 - s0) + s0[row]
    coded, of = np.unique(names[at].astype(str), return_inverse=True)
    takes = np.array([TAKES.get(n, 0) for n in coded], np.int64)[of] if len(at) else np.zeros(0, np.int64)
    total = np.r_[0, np.cumsum(takes)]
    first = total[np.r_[0, np.cumsum(s1 - s0)][:-1]]
    stop = total[1:] - first[row] + a0[row]
    known = takes > 0
    if (stop[known] > a1[row[known]]).any():
        raise IndexError("a path has fewer numbers than its parts take")
    ends = np.stack([args[stop[known] - 2], args[stop[known] - 1]], axis=1)
    starts = np.searchsorted(row[known], np.arange(len(s0) + 1))
    kind = np.isin(coded, ["moveTo", "rectangle"])[of[known]] if len(at) else np.zeros(0, bool)
    places = np.flatnonzero(kind)
    moves = (coded == "moveTo")[of[known][places]] if len(at) else places
    breaks = list(zip((places - starts[row[known][places]]).tolist(), moves.tolist()))
    return ends, starts[:-1].tolist(), starts[1:].tolist(), breaks, np.searchsorted(places, starts).tolist()


def _batch(pages: list[Pen]) -> pa.RecordBatch:
    """The polylines of pages as rows."""
    done = [(pen.page_id, i, *line) for pen in pages for i, line in enumerate(pen.done)]
    page_id, poly_id, pts, r, g, b, w = zip(*done) if done else ([],) * 7
    offsets = np.r_[0, np.cumsum([len(p) for p in pts], dtype=np.int64)].astype(np.int32)
    flat = np.concatenate(pts) if done else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in (0, 1)], fields=list(_POINTS.value_type))
    columns = [pa.array(page_id, pa.int64()), pa.array(poly_id, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), points, type=_POINTS), *(pa.array(c, pa.float64()) for c in (r, g, b, w))]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def polylines(ops: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, poly_id (drawing order), pts, r, g, b, w of each page of `pages` (page_id, width,
    height, viewport array of 6). Transforms are followed; where at most half of the first points
    (to the end of the polyline that passes 500) then lie on the page or within half its longer
    side of it, the page is read again without them."""
    ship(ops.sparkSession)
    n = parts_of(pages)
    # operators look few where they are made of few rows: pages are hashed part by part, never sent
    known = pages.select("page_id", "width", "height", "viewport").repartition(n, "page_id").hint("shuffle_hash")
    joined = ops.repartition(n, "page_id").join(known, "page_id").select("page_id", "op_pos", "op", "args", "sub_ops", "width", "height", "viewport")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pens: list[Pen] = []  # one that follows transforms and, once there is one, another that does not
        size = (0.0, 0.0)
        held: list[Pen] = []
        points = 0

        def finished() -> Pen:
            for pen in pens:
                pen.flush()
            return pens[0] if len(pens) == 1 or _mostly_inside(pens[0].done, *size) else pens[1]

        for batch in batches:
            page_ids, ops_of = batch.column("page_id").to_pylist(), _names(batch.column("op"))
            args, a0, a1 = _lists(batch.column("args"))
            ends, e0, e1, breaks, b0 = _paths(batch)
            for i, page_id in enumerate(page_ids):
                if not pens or pens[0].page_id != page_id:
                    if pens:
                        held.append(finished())
                        points += sum(len(line[0]) for line in held[-1].done)
                        if points >= HELD:
                            yield _batch(held)
                            held, points = [], 0
                    pens = [Pen(page_id, batch.column("viewport")[i].as_py(), True)]
                    size = (batch.column("width")[i].as_py(), batch.column("height")[i].as_py())
                op = ops_of[i]
                if op == "transform" and len(pens) == 1:
                    pens.append(pens[0].copy(False))
                for pen in pens:
                    if op == "constructPath":
                        pen.strokes(ends[e0[i] : e1[i]], breaks[b0[i] : b0[i + 1]])
                    else:
                        pen.step(op, args[a0[i] : a1[i]])
        if pens:
            held.append(finished())
        if held:
            yield _batch(held)

    return joined.sortWithinPartitions("page_id", "op_pos").mapInArrow(read, SCHEMA)


def _mostly_inside(done: list[tuple], width: float, height: float) -> bool:
    margin, inside, total = max(width, height) * 0.5, 0, 0
    for pts, *_ in done:
        total += len(pts)
        inside += int(((pts >= -margin) & (pts <= (width + margin, height + margin))).all(axis=1).sum())
        if total > 500:
            break
    return total > 0 and inside / total > 0.5


def labels(texts: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Lead labels among the texts of pages (page_id, pos, text, x, y): exact tokens and aliases
    under their standard names, of repeated ones the first."""
    from stripchart.functions.text import normal_lead

    named = texts.withColumn("text", normal_lead(F.col("text"), aliases)).where("text is not null")
    return named.groupBy("page_id", "text").agg(F.min_by(F.struct("pos", "x", "y"), "pos").alias("v")).select("page_id", "text", "v.pos", "v.x", "v.y")
