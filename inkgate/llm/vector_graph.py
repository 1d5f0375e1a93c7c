"""Approximate nearest neighbours of vectors by cosine: robust-pruned directed graphs in shards.

Vectors are dealt to shards of bounded size. In each, vectors join a directed graph in growing
batches: a greedy beam search over the graph so far proposes neighbours, relaxed distance pruning
keeps those that no kept one stands before, and kept neighbours link back. A query walks the graph
of every shard with a beam; the nearest of all shards are the answer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgate.functions.vectors import norm
from inkgate.session import cut

SHARD_ROWS = 8192
# Queries that walk one shard's graph in one call.
QUERY_BLOCK = 2048
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
# Squared distances a kept neighbour may be further off and still stand before another.
RELAXED = 1.2**2
_LOOK = 512  # searches that walk together

# ---- one shard -------------------------------------------------------------------------------


def beam_search(units: np.ndarray, edges: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, similarities), nearest first, -1 behind the last: greedy walks from position 0.

    Each walk keeps the ``beam`` nearest seen so far and goes on from the nearest it has not been
    to, until it has been to all of them.
    """
    count = len(queries)
    found = np.full((count, beam), -1, np.int32)
    near = np.full((count, beam), -np.inf, np.float32)
    been = np.zeros((count, beam), bool)
    seen = np.zeros((count, len(units)), bool)
    found[:, 0], near[:, 0], seen[:, 0] = 0, queries @ units[0], True
    while True:
        fresh = ~been & (found >= 0)
        rows = np.flatnonzero(fresh.any(axis=1))
        if not len(rows):
            return found, near
        pick = fresh[rows].argmax(axis=1)
        been[rows, pick] = True
        to = edges[found[rows, pick]]
        new = (to >= 0) & ~seen[rows[:, None], to]
        to = np.where(new, to, 0)
        seen[rows[:, None], to] = True
        close = np.einsum("ad,ard->ar", queries[rows], units[to])
        close[~new] = -np.inf
        ids = np.concatenate([found[rows], np.where(new, to, -1)], axis=1)
        sims = np.concatenate([near[rows], close], axis=1)
        marks = np.concatenate([been[rows], np.zeros(to.shape, bool)], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        found[rows] = np.take_along_axis(ids, order, axis=1)
        near[rows] = np.take_along_axis(sims, order, axis=1)
        been[rows] = np.take_along_axis(marks, order, axis=1)


def robust_prune(units: np.ndarray, at: np.ndarray, proposed: np.ndarray, degree: int, relaxed: float = RELAXED) -> np.ndarray:
    """At most ``degree`` of the proposed neighbours of each vector ``at``, -1 behind the last.

    The nearest is kept, and all that lie closer to it than, relaxed, to the vector itself go;
    again with what is left.
    """
    held = units[proposed]
    own = 2 - 2 * np.einsum("ad,acd->ac", units[at], held)
    alive = (proposed >= 0) & (proposed != at[:, None])
    own[~alive] = np.inf
    order = np.argsort(own, axis=1, kind="stable")
    own, proposed = np.take_along_axis(own, order, axis=1), np.take_along_axis(proposed, order, axis=1)
    alive, held = np.take_along_axis(alive, order, axis=1), np.take_along_axis(held, order[:, :, None], axis=1)
    # the same neighbour proposed twice lies next to itself or at its own distance: 0 apart
    apart = 2 - 2 * (held @ held.transpose(0, 2, 1))
    rows = np.arange(len(at))
    kept = np.full((len(at), degree), -1, np.int32)
    for turn in range(degree):
        going = alive.any(axis=1)
        if not going.any():
            break
        first = alive.argmax(axis=1)
        kept[going, turn] = proposed[rows, first][going]
        alive &= relaxed * apart[rows, first] > own
        alive &= proposed != proposed[rows, first][:, None]
        alive[rows, first] = False
    return kept


def _link_back(units: np.ndarray, edges: np.ndarray, batch: np.ndarray, degree: int) -> None:
    """Every kept neighbour gets an edge back; one with too many prunes again."""
    source = np.repeat(batch, degree)
    target = edges[batch, :degree].ravel()
    source, target = source[target >= 0], target[target >= 0]
    close = np.einsum("ad,ad->a", units[source], units[target])
    order = np.lexsort((-close, target))
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    turn = np.arange(len(target)) - np.repeat(first, count)
    most = 2 * degree  # the nearest that ask; graph edges only, no vector is lost
    asks = np.full((len(nodes), most), -1, np.int32)
    asked = turn < most
    asks[np.repeat(np.arange(len(nodes)), count)[asked], turn[asked]] = source[asked]
    for low in range(0, len(nodes), _LOOK):
        part = slice(low, low + _LOOK)
        proposed = np.concatenate([edges[nodes[part], :degree], asks[part]], axis=1)
        edges[nodes[part], :degree] = robust_prune(units, nodes[part], proposed, degree)


def build_graph(units: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> np.ndarray:
    """Edges of each vector, -1 where there are fewer; walks start at position 0.

    One more edge leads to the next position, so that every vector can be reached.
    """
    n = len(units)
    edges = np.full((n, degree + 1), -1, np.int32)
    done = 1
    while done < n:
        batch = np.arange(done, min(n, done + min(done, _LOOK)))
        found, _ = beam_search(units[:done], edges[:done], units[batch], beam)
        edges[batch, :degree] = robust_prune(units, batch, found, degree)
        _link_back(units, edges, batch, degree)
        done = int(batch[-1]) + 1
    following = (np.arange(n, dtype=np.int32) + 1) % n
    known = (edges == following[:, None]).any(axis=1) | (n == 1)
    edges[:, degree] = np.where(known, -1, following)
    return edges


# ---- tables ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class VectorIndex:
    """``nodes`` (dim, shard, place, id, vec, edges): one row per distinct vector.
    ``copies`` (node, id): rows whose vector equals that of an earlier id. Both are written."""

    nodes: DataFrame
    copies: DataFrame
    shards: int


def usable(vectors: DataFrame) -> DataFrame:
    """(id, vec) of rows with an id and a vector of finite components that has a length."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    length = norm(F.col("vec"))
    fit = F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False))
    return vectors.select("id", "vec").where(fit).where((length > 0) & (length < F.lit(float("inf"))))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _units(matrix: np.ndarray) -> np.ndarray:
    return (matrix / np.sqrt(np.einsum("ad,ad->a", matrix, matrix))[:, None]).astype(np.float32)


def build_index(
    vectors: DataFrame, *, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BUILD_BEAM
) -> VectorIndex:
    """The searchable graphs of vectors(id, vec), all rows indexed.

    Equal vectors are one node, so that very many copies neither crowd a graph nor a shard. A
    shard is dealt by the hash of the id and holds about ``shard_rows`` vectors: what one task
    needs in memory. Vectors of different length lie in different shards.

    Rows without an id, and vectors that are null, without length or with null or non-finite
    components, take no part. Other columns are ignored. No rows in, an empty index out.
    """
    rows = cut(usable(vectors), "vectors")
    groups = rows.groupBy("vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.withColumn("dim", F.size("vec")), "nodes")
    several = groups.where("n > 1").select("vec", "node")
    copies = cut(rows.join(several, "vec").where("id <> node").select("node", "id"), "copies")
    shards = -(-groups.count() // shard_rows)
    dealt = groups.select("dim", _shard("node", shards).alias("shard"), F.col("node").alias("id"), "vec")
    id_type = dealt.schema["id"].dataType.simpleString()
    vec_type = dealt.schema["vec"].dataType.simpleString()

    def grow(table: pa.Table) -> pa.Table:
        order = table.column("id").to_pandas().argsort(kind="stable").to_numpy()
        matrix = _matrix(table.column("vec"))
        order = order[np.random.default_rng(len(order)).permutation(len(order))]
        units = _units(matrix[order])
        # walks start in the middle
        middle = int((units @ units.mean(axis=0)).argmax())
        order[[0, middle]], units[[0, middle]] = order[[middle, 0]], units[[middle, 0]]
        edges = build_graph(units, degree, beam)
        table = table.take(pa.array(order))
        lists = pa.array([e[e >= 0] for e in edges], pa.list_(pa.int32()))
        place = pa.array(np.arange(len(order), dtype=np.int32))
        return table.append_column("place", place).append_column("edges", lists)

    schema = f"dim int, shard int, id {id_type}, vec {vec_type}, place int, edges array<int>"
    nodes = cut(dealt.groupBy("dim", "shard").applyInArrow(grow, schema), "graph")
    return VectorIndex(nodes, copies, shards)


def _shard(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(max(parts, 1))).cast("int")


def _walk(nodes: pa.Table, queries: pa.Table, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, node row, cosine) of the ``k`` nearest nodes of one shard."""
    order = np.argsort(nodes.column("place").to_numpy())
    nodes_in_order = _matrix(nodes.column("vec"))[order]
    lists = nodes.column("edges").combine_chunks().take(pa.array(order))
    sizes = np.diff(lists.offsets.to_numpy())
    edges = np.full((len(order), max(1, int(sizes.max()))), -1, np.int32)
    edges[np.repeat(np.arange(len(order)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    units, asked = _units(nodes_in_order), _matrix(queries.column("vec"))
    lengths = np.sqrt(np.einsum("ad,ad->a", nodes_in_order, nodes_in_order))
    rank = np.empty(len(order), np.int64)
    rank[nodes.column("id").to_pandas().iloc[order].argsort(kind="stable").to_numpy()] = np.arange(len(order))
    out = []
    for low in range(0, len(asked), _LOOK):
        part = asked[low : low + _LOOK]
        found, _ = beam_search(units, edges, _units(part), max(beam, k))
        # measured anew on the vectors as given, in double precision
        exact = np.einsum("ad,acd->ac", part, nodes_in_order[found])
        exact /= np.sqrt(np.einsum("ad,ad->a", part, part))[:, None] * lengths[found]
        exact[found < 0] = -np.inf
        best = np.lexsort((rank[found], -exact), axis=1)[:, :k]
        found, exact = np.take_along_axis(found, best, axis=1), np.take_along_axis(exact, best, axis=1)
        query, turn = np.nonzero(found >= 0)
        out.append((query + low, order[found[query, turn]], exact[query, turn]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(index: VectorIndex, queries: DataFrame, *, k: int = 5, beam: int = SEARCH_BEAM) -> DataFrame:
    """The ``k`` nearest found of every query(id, vec) by cosine: id, rank, neighbour_id, cosine.

    A query does not find rows of its own id. Nearest first, equal cosines by the smaller id; with
    fewer candidates, all of them. Cosines are computed in double precision from the vectors as
    given. Queries that ``build_index`` would leave out have no rows; nor have vectors of a length
    that the index doesn't hold. Rows that repeat an id are one query, with the least vector; as
    candidates they stay apart. Queries visit every shard, in blocks of about ``QUERY_BLOCK``.
    """
    asked = usable(queries).groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    left = index.nodes.withColumn("block", every(blocks))
    right = asked.withColumn("block", _shard("id", blocks)).withColumn("shard", every(index.shards))
    right = right.select(*(F.col(c).alias(c) for c in ("dim", "shard", "block", "id", "vec")))
    id_type = index.nodes.schema["id"].dataType.simpleString()
    query_type = asked.schema["id"].dataType.simpleString()

    def walk(nodes: pa.Table, wanted: pa.Table) -> pa.Table:
        if not nodes.num_rows or not wanted.num_rows:
            none = np.zeros(0, np.int64)
            query, node, cosine = none, none, none.astype(np.float64)
        else:
            query, node, cosine = _walk(nodes, wanted, k + 1, beam)
        return pa.table({"id": wanted.column("id").take(pa.array(query)), "node": nodes.column("id").take(pa.array(node)), "cosine": cosine})

    keys = ("dim", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(walk, f"id {query_type}, node {id_type}, cosine double")
    # k + 1 nodes are enough: each brings its own id at least, and one may be the query's own
    found = cut(_first(found, "id", [F.desc("cosine"), F.col("node")], k + 1), "found")
    copies = _first(index.copies, "node", [F.col("id")], k + 1).select(F.col("node").alias("of"), F.col("id").alias("neighbour_id"))
    own = found.select("id", F.col("node").alias("neighbour_id"), "cosine")
    more = found.join(copies, F.col("node") == F.col("of")).select("id", "neighbour_id", "cosine")
    several = own.unionByName(more).where("id <> neighbour_id")
    ranked = _first(several, "id", [F.desc("cosine"), F.col("neighbour_id")], k, keep="rank")
    return ranked.select("id", "rank", "neighbour_id", "cosine")


def _first(table: DataFrame, key: str, order: list[Column], n: int, keep: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key; what lies behind is left out before the shuffle."""
    ranked = table.withColumn(keep or "_turn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    ranked = ranked.where(F.col(keep or "_turn") <= n)
    return ranked if keep else ranked.drop("_turn")
