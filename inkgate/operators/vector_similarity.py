"""Dense vectors compared by cosine in blocks, exactly.

Vectors lie in cells around pivot vectors; a cell knows its radius, the widest angle of a member
to the pivot. By the triangle inequality on angles, two cells can hold similar vectors only when
their pivots are no further apart than both radii and the threshold angle; other pairs of cells
never meet.

One table is dealt out in parts of whole cells, or of pieces of a large one, which tasks hold; the
rows of the other stream past them, each sent once to every part with a cell that it can meet, and
never past cells that it cannot. Parts are as large as a task may hold, so a row is sent a few
times however many vectors there are, and it costs no more memory. A block of the stream against the
cells of a part is one matrix product; a table compared with itself meets every pair of rows once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgate.functions.vectors import norm, unit
from inkgate.operators.first_wins import Matcher
from inkgate.session import cut

MIN_CELLS = 4
MAX_CELLS = 1024
ROWS_PER_CELL = 4096
BLOCK_ROWS = 2048
# What a task holds of one table, about: twice that where a cell is cut in two.
PART_BYTES = 128 << 20
# Parts and streams are not made smaller than this for the sake of more tasks.
PART_ROWS = 1024
# Pairs of a block whose cosines are computed at once.
PAIRS_AT_ONCE = 1 << 16
# Products differ in the last digits with the place in a block; closer ones are computed pair by pair.
PRODUCT_SLACK = 1e-12
# Angles are widened by this much before cells are ruled out, far above rounding errors.
ANGLE_SLACK = 1e-6


@dataclass(frozen=True)
class Cells:
    """Pivots as rows of a matrix, and the radius of each cell (-inf: empty). At most MAX_CELLS."""

    pivots: np.ndarray
    radii: np.ndarray

    def near(self, angle: float) -> np.ndarray:
        """Which cells may hold vectors within ``angle`` of each other: cells x cells."""
        return _angles(self.pivots, self.pivots) <= self.radii[:, None] + self.radii[None, :] + angle + ANGLE_SLACK

    def meeting(self, angle: float) -> list[tuple[int, int]]:
        """Pairs of cells that may hold vectors within ``angle`` of each other, both ways round."""
        return list(zip(*(x.tolist() for x in np.nonzero(self.near(angle))), strict=True))

    def reached(self, radii: np.ndarray, threshold: float) -> list[int]:
        """Cells in which a table with ``radii`` may hold vectors similar to one of these cells."""
        apart = _angles(self.pivots, self.pivots)
        near = apart <= self.radii[:, None] + radii[None, :] + math.acos(threshold) + ANGLE_SLACK
        return np.flatnonzero(near.any(axis=0)).tolist()

    def beside(self, radii: np.ndarray) -> Cells:
        """The cells of this table and one with ``radii`` together."""
        return Cells(self.pivots, np.maximum(self.radii, radii))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(id, vec) with unit length; vectors without length have no neighbours."""
    return vectors.where(norm(F.col("vec")) > 0).select("id", unit(F.col("vec")).alias("vec"))


def choose_pivots(units: DataFrame, *, cells: int | None = None) -> np.ndarray:
    """At most ``MAX_CELLS`` vectors, far apart: out of a sample by hash order, of 4 for each, the
    one farthest from those picked so far is next. Groups of similar vectors then have a pivot of
    their own and cells are narrow.

    They decide only which blocks are compared, not what is found.
    """
    if cells is None:
        cells = min(MAX_CELLS, max(MIN_CELLS, units.count() // ROWS_PER_CELL))
    rows = units.orderBy(F.xxhash64("id"), "id").limit(4 * cells).select("vec").collect()
    if not rows:
        return np.zeros((1, 1))
    sample = np.array([row["vec"] for row in rows], dtype=np.float64)
    picked, near = [0], sample @ sample[0]
    while len(picked) < min(cells, len(sample)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[picked[-1]])
    return sample[picked]


def _angles(block: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(block @ pivots.T, -1.0, 1.0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def in_cells(units: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, cell, angle, vec): the nearest pivot of each vector and the angle to it. Write it."""
    id_type = units.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angles = _angles(_matrix(batch.column("vec")), pivots)
            cell = angles.argmin(axis=1).astype(np.int32)
            own = angles[np.arange(len(cell)), cell]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(cell), pa.array(own), batch.column("vec")],
                names=["id", "cell", "angle", "vec"],
            )

    return units.select("id", "vec").mapInArrow(place, f"id {id_type}, cell int, angle double, vec array<double>")


def measure(placed: DataFrame, pivots: np.ndarray) -> Cells:
    """The radii of the cells of ``in_cells``: one number for each of at most MAX_CELLS."""
    radii = np.full(len(pivots), -np.inf)
    for row in placed.groupBy("cell").agg(F.max("angle").alias("r")).collect():
        radii[row["cell"]] = row["r"]
    return Cells(pivots, radii)


@dataclass(frozen=True)
class _Layout:
    """One table over ``parts`` that tasks hold, the other in ``streams`` past each of them. The rows
    of a cell lie in the parts ``first`` to ``last``."""

    first: np.ndarray
    last: np.ndarray
    parts: int
    streams: int

    def part(self, ids: np.ndarray, cells: np.ndarray) -> np.ndarray:
        low = self.first[cells]
        return low + (_mixed(ids) % (self.last[cells] - low + 1).astype(np.uint64)).astype(np.int64)

    def stream(self, ids: np.ndarray) -> np.ndarray:
        return ((_mixed(ids) >> np.uint64(24)) % np.uint64(self.streams)).astype(np.int64)

    def holds(self) -> np.ndarray:
        """Which cells each part has rows of: cells x parts."""
        part = np.arange(self.parts)[None, :]
        return (self.first[:, None] <= part) & (part <= self.last[:, None])


def _mixed(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)


def _rows_of_cells(placed: DataFrame, cells: int) -> np.ndarray:
    counts = np.zeros(cells, np.int64)
    for row in placed.groupBy("cell").count().collect():
        counts[row["cell"]] = row["count"]
    return counts


def _lay_out(held: DataFrame, streamed: DataFrame, cells: Cells, *, at_home: bool = False) -> _Layout:
    """Parts and streams of a comparison: two tasks for each core with as few copies as that takes.
    ``at_home``: rows meet their own cell only."""
    counts = _rows_of_cells(held, len(cells.pivots))
    n, m = int(counts.sum()), int(counts.sum()) if streamed is held else streamed.count()
    tasks = 2 * held.sparkSession.sparkContext.defaultParallelism
    least = math.ceil(n * cells.pivots.shape[1] * 8 / PART_BYTES)
    wanted = tasks if at_home else round(math.sqrt(tasks * n / max(m, 1)))
    parts = max(1, least, min(wanted, math.ceil(n / PART_ROWS)))
    streams = 1 if at_home else max(1, min(math.ceil(tasks / parts), math.ceil(m / PART_ROWS)))
    share = max(1, math.ceil(n / parts))
    ends = np.cumsum(counts)
    return _Layout((ends - counts) // share, np.maximum(ends - 1, ends - counts) // share, parts, streams)


Route = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _meet(held: DataFrame, streamed: DataFrame, layout: _Layout, route: Route, compare, schema: str) -> DataFrame:
    """``compare(part ids, part cells, part matrix, blocks)`` in every task: the rows of its part, by
    cell and id, and the blocks (ids, cells, least, own part, matrix) that stream past, by cell.

    ``route(ids, cells, least, own part, matrix)`` says which parts each row of the stream meets. Where the stream has
    no column ``least`` that is NaN.
    """
    parts, streams, block = layout.parts, layout.streams, BLOCK_ROWS
    fields = "task int, streamed boolean, id long, cell int, least double, own int, vec array<double>"

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, cells = batch.column("id").to_numpy(), batch.column("cell").to_numpy()
        least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
        return ids, cells, least, layout.part(ids, cells)

    def sent(batch: pa.RecordBatch, streamed: bool, rows: np.ndarray, task: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        part = batch.take(pa.array(rows))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(task.astype(np.int32)),
                pa.array(np.full(len(rows), streamed)),
                part.column("id"),
                part.column("cell"),
                part.column("least"),
                pa.array(own[rows].astype(np.int32)),
                part.column("vec"),
            ],
            names=["task", "streamed", "id", "cell", "least", "own", "vec"],
        )

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, rows = columns(batch)[3], np.arange(batch.num_rows)
                for stream in range(streams):
                    yield sent(batch, False, rows, own * streams + stream, own)

    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, cells, least, own = columns(batch)
                meets = route(ids, cells, least, own, _matrix(batch.column("vec")))
                stream = layout.stream(ids)
                for part in range(parts):
                    rows = np.flatnonzero(meets[:, part])
                    if len(rows):
                        yield sent(batch, True, rows, part * streams + stream[rows], own)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, int(np.count_nonzero(~b.column("streamed").to_numpy(zero_copy_only=False)))) for b in batches if b.num_rows)
        mine: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch, n in rows:
            if n:
                own = batch.slice(0, n)
                mine.append((own.column("id").to_numpy(), own.column("cell").to_numpy(), _matrix(own.column("vec"))))
            if n < batch.num_rows:
                break
        else:
            return
        if not mine:
            return
        part = [np.concatenate(x) for x in zip(*mine, strict=True)]
        mine.clear()

        def blocks() -> Iterator[tuple[np.ndarray, ...]]:
            following, skip = batch, n
            while following is not None:
                for low in range(skip, following.num_rows, block):
                    piece = following.slice(low, block)
                    least = piece.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                    yield (
                        piece.column("id").to_numpy(),
                        piece.column("cell").to_numpy(),
                        least,
                        piece.column("own").to_numpy(),
                        _matrix(piece.column("vec")),
                    )
                following, skip = next(rows, (None, 0))

        yield from compare(*part, blocks())

    def named(table: DataFrame) -> DataFrame:
        least = F.col("least") if "least" in table.columns else F.lit(None)
        return table.select("id", "cell", least.cast("double").alias("least"), "vec")

    dealt = named(held).mapInArrow(hold, fields).unionByName(named(streamed).mapInArrow(flow, fields))
    tasks = dealt.repartitionById(parts * streams, F.col("task"))
    return tasks.sortWithinPartitions("streamed", "cell", "id").mapInArrow(work, schema)


def _spans(cells: np.ndarray, wanted: np.ndarray, most: int) -> Iterator[slice]:
    """Rows of the sorted ``cells`` whose cell is ``wanted``, in runs of ``most`` at most."""
    edges = np.diff(wanted[cells].astype(np.int8), prepend=0, append=0)
    for low, high in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        for start in range(low, high, most):
            yield slice(start, min(start + most, high))


def _cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, each alike wherever it stands."""
    return np.einsum("ij,ij->i", left, right)


def _compared(cells: Cells, threshold: float, compare, schema: str) -> Matcher:
    """``compare(alone, ids, matrix, products)`` in every task, of the rows it holds and the blocks (ids, matrix, away,
    (span of held rows, products)) that stream past them. ``alone``: both tables are one."""
    meeting = cells.near(math.acos(threshold))

    def match(left: DataFrame, right: DataFrame) -> DataFrame:
        alone = left is right
        layout = _lay_out(left, right, cells)
        reach = meeting @ layout.holds()

        def route(ids: np.ndarray, of: np.ndarray, least: np.ndarray, own: np.ndarray, matrix: np.ndarray) -> np.ndarray:
            meets = reach[of]
            return meets & (np.arange(layout.parts)[None, :] <= own[:, None]) if alone else meets

        def work(ids: np.ndarray, part_cells: np.ndarray, matrix: np.ndarray, blocks) -> Iterator[pa.RecordBatch]:
            here = layout.part(ids[:1], part_cells[:1])[0]

            def products() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[tuple[slice, np.ndarray]]]]:
                for others, of, _, own, stream in blocks:
                    spans = _spans(part_cells, meeting[np.unique(of)].any(axis=0), 2 * BLOCK_ROWS)
                    # a row of another part meets this one here only, one of this part both ways
                    away = own != here if alone else np.zeros(len(own), bool)
                    yield others, stream, away, ((span, stream @ matrix[span].T) for span in spans)

            yield from compare(alone, ids, matrix, products())

        return _meet(left, right, layout, route, work, schema)

    return match


def vector_matcher(cells: Cells, threshold: float, *, any_order: bool = False) -> Matcher:
    """Pairs (a, b, cosine) with cosine >= threshold, a < b, among rows(id, cell, vec) of
    ``in_cells``. With ``any_order`` the left side is taken as it is, whatever its ids."""
    most = PAIRS_AT_ONCE

    def compare(alone: bool, ids: np.ndarray, matrix: np.ndarray, products) -> Iterator[pa.RecordBatch]:
        for others, stream, away, spans in products:
            for span, near in spans:
                hits = np.flatnonzero(near >= threshold - PRODUCT_SLACK)
                for low in range(0, len(hits), most):
                    rows, cols = np.divmod(hits[low : low + most], near.shape[1])
                    cols += span.start
                    cosine = _cosines(stream[rows], matrix[cols])
                    first, second = ids[cols], others[rows]
                    keep = cosine >= threshold
                    if alone:
                        keep &= (first < second) | ((first > second) & away[rows])
                        first, second = np.minimum(first, second), np.maximum(first, second)
                    elif not any_order:
                        keep &= first < second
                    yield pa.RecordBatch.from_pydict({"a": first[keep], "b": second[keep], "cosine": cosine[keep]})

    return _compared(cells, threshold, compare, "a long, b long, cosine double")


def vector_follower(cells: Cells, threshold: float) -> Matcher:
    """(id), the ``b`` of ``vector_matcher``'s pairs, each told about once by a task however many pairs it is in."""
    most = PAIRS_AT_ONCE

    def compare(alone: bool, ids: np.ndarray, matrix: np.ndarray, products) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(ids), bool)
        for others, stream, away, spans in products:
            found = np.zeros(len(others), bool)
            for span, near in spans:
                similar = near >= threshold + PRODUCT_SLACK
                close = np.flatnonzero(np.abs(near - threshold) <= PRODUCT_SLACK)
                for low in range(0, len(close), most):
                    rows, cols = np.divmod(close[low : low + most], near.shape[1])
                    similar[rows, cols] = _cosines(stream[rows], matrix[cols + span.start]) >= threshold
                found |= (similar & (ids[span][None, :] < others[:, None])).any(axis=1)
                if away.any():
                    held[span] |= (similar[away] & (ids[span][None, :] > others[away][:, None])).any(axis=0)
            yield pa.RecordBatch.from_pydict({"id": others[found]})
        yield pa.RecordBatch.from_pydict({"id": ids[held]})

    return _compared(cells, threshold, compare, "id long")


# ---- nearest neighbours ----------------------------------------------------------------------


def _few_copies(ids: np.ndarray, cells: np.ndarray, matrix: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that ``k + 1`` equal vectors with lower ids precede: at equal cosines the
    lower ids win, and one of them can be the probe itself. Rows stay in their order."""
    _, group = np.unique(np.ascontiguousarray(matrix).view(f"V{matrix.shape[1] * 8}").ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    group, ids = group[order], ids[order]
    new_group = np.diff(group, prepend=-1) != 0
    new_id = new_group | (np.diff(ids, prepend=0) != 0)
    number = np.cumsum(new_id)
    starts = number[new_group][np.cumsum(new_group) - 1]
    return np.sort(order[number - starts <= k])


def _best(rows: np.ndarray, ids: np.ndarray, cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` highest of each row, ties by the lower id."""
    order = np.lexsort((ids, -cosines, rows))
    rows, ids, cosines = rows[order], ids[order], cosines[order]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(starts, append=len(rows)))
    return rows[rank < k], ids[rank < k], cosines[rank < k]


def _search(probes: DataFrame, store: DataFrame, cells: Cells, k: int, *, at_home: bool) -> DataFrame:
    """(id, neighbour_id, cosine): the ``k`` best of each part for each probe, in its own cell or in
    the others that may hold one nearer than its ``least``."""
    pivots, radii, block = cells.pivots, cells.radii, 2 * BLOCK_ROWS
    layout = _lay_out(store, probes, cells, at_home=at_home)
    holds = layout.holds()

    def open_cells(of: np.ndarray, least: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        reach = np.arccos(np.clip(np.where(np.isnan(least), -1.0, least), -1.0, 1.0))
        maybe = bounds <= reach[:, None] + ANGLE_SLACK
        maybe[np.arange(len(of)), of] = False
        return maybe

    def route(ids: np.ndarray, of: np.ndarray, least: np.ndarray, own: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        if at_home:
            return holds[of]
        return open_cells(of, least, _angles(matrix, pivots) - radii[None, :]) @ holds

    def compare(ids: np.ndarray, part_cells: np.ndarray, matrix: np.ndarray, blocks) -> Iterator[pa.RecordBatch]:
        few = _few_copies(ids, part_cells, matrix, k)
        ids, part_cells, matrix = ids[few], part_cells[few], matrix[few]
        present, known = np.unique(part_cells), np.sort(ids)
        for asked, of, least, _, stream in blocks:
            floor = np.where(np.isnan(least), -np.inf, least)
            at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            itself = bool((known[at] == asked).any())
            bounds = None if at_home else _angles(stream, pivots) - radii[None, :]
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for cell in present:
                if at_home:
                    rows = np.flatnonzero(of == cell)
                else:
                    reach = np.arccos(np.clip(floor, -1.0, 1.0))
                    rows = np.flatnonzero((bounds[:, cell] <= reach + ANGLE_SLACK) & (of != cell))
                if not len(rows):
                    continue
                asking = stream if len(rows) == len(stream) else stream[rows]
                for span in _spans(part_cells, np.arange(len(radii)) == cell, block):
                    near = asking @ matrix[span].T
                    if itself:
                        near[asked[rows][:, None] == ids[span][None, :]] = -np.inf
                    least_here = floor[rows]
                    new = np.flatnonzero(np.isneginf(least_here))
                    if len(new) and near.shape[1] > k:
                        least_here[new] = np.partition(near[new], near.shape[1] - k, axis=1)[:, near.shape[1] - k]
                    # a row without a bound takes all there is but itself
                    hit, cols = np.nonzero((near >= least_here[:, None] - PRODUCT_SLACK) & (near > -np.inf))
                    if not len(hit):
                        continue
                    cols += span.start
                    more = (rows[hit], ids[cols], _cosines(asking[hit], matrix[cols]))
                    found = _best(*(np.concatenate(x) for x in zip(found, more, strict=True)), k)
                    last = np.flatnonzero(np.diff(found[0], append=-1))
                    full = np.bincount(found[0], minlength=len(floor))[found[0][last]] == k
                    last = last[full]
                    floor[found[0][last]] = np.maximum(floor[found[0][last]], found[2][last])
            yield pa.RecordBatch.from_pydict({"id": asked[found[0]], "neighbour_id": found[1], "cosine": found[2]})

    return _meet(store, probes, layout, route, compare, "id long, neighbour_id long, cosine double")


def _merge(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(probes: DataFrame, store: DataFrame, cells: Cells, *, k: int = 1) -> DataFrame:
    """(id, rank, neighbour_id, cosine): the ``k`` most similar stored vectors of each probe
    (itself excluded), exactly; equal cosines by the lower id.

    First within the probe's own cell, which gives a similarity to beat; then in the cells that
    could still hold a nearer one, judged by their radius. Each part gives its ``k`` best of a
    probe, ranked away before the shuffle where they are too many. Both inputs are rows(id, cell,
    vec) of ``in_cells`` over the same pivots, ``cells`` measured over the store; write them.
    """
    first = cut(_merge(_search(probes, store, cells, k, at_home=True), k), "first")
    beat = first.groupBy("id").agg(F.min("cosine").alias("least"), F.count(F.lit(1)).alias("n"))
    beat = beat.select(F.col("id").alias("of"), F.when(F.col("n") == k, F.col("least")).alias("least"))
    waiting = probes.join(beat, F.col("id") == F.col("of"), "left").select("id", "cell", "vec", "least")
    second = _search(waiting, store, cells, k, at_home=False)
    return _merge(first.select("id", "neighbour_id", "cosine").unionByName(second), k).select(
        "id", "rank", "neighbour_id", "cosine"
    )
