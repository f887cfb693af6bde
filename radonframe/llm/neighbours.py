"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, a greedy search over it answers queries.

1. Nodes: equal vectors are one node, kept with the ``members`` rows of least id, more than which no answer can hold. So copies, however
   many, cost one node and lose nothing.
2. Start of the graph: sign codes of random projections deal the nodes into blocks of about ``BLOCK``; each node takes the nearest of its block,
   in ``TABLES`` tables. A code with more nodes than a block is dealt into several by a hash.
3. NN-descent: neighbours of neighbours meet at the node between them. A node, its neighbours and a block of the nodes that have it as theirs
   are a unit; in each unit all pairs with an edge that is new since the last round are compared, and each node takes the nearest it has met. A node
   that very many have as theirs has several units, dealt anew each round, so that nobody is left out and work stays in proportion to edges.
   Units near each other (``PART`` nodes of a block of the first table) are computed together, so that a vector travels to them once, in half
   precision. Rounds end when fewer
   than ``SETTLED`` of the edges are new, or after ``ROUNDS``.
4. Search: a query starts at the node of its own vector, if there is one, and at ``ENTRIES`` fixed nodes. Each step is a join: the nearest ``STEP``
   nodes of its beam that are not yet expanded give their neighbours (edges both ways; of those that point at a node the nearest 2 * ``K``),
   which are scored; the nearest ``BEAM`` stay. A query is done when its whole beam is expanded.
5. The nearest of the beam are scored again in double precision on the given vectors.

Defined cases: vectors that are null, empty, zero or of another dimension than most, or hold null or non-finite components, take no part;
rows with a null id do, and come last among ties; repeated rows are rows of their own, so a query finds its other copies; an empty table gives an
empty result; further columns are ignored. Given the same tables, nodes and starts do not change; ties of equal scores go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, stage

K = 32
BLOCK = 1024
PART = 256  # nodes whose units are computed together
TABLES = 2
ROUNDS, SETTLED = 8, 0.08
BEAM, STEP, ENTRIES = 192, 64, 64
QUERIES = 256  # of a part of the search
EDGES = "a long, b long, s float"
UNITS = "node long, unit binary, half binary, codes array<long>, embedding array<double>"
_SEED = 20


@dataclass
class Index:
    """Staged tables: rows (row, vec_id, node), vectors (node, home, unit, half, embedding), graph (a, b, s, fresh), search edges (a, b)."""

    rows: DataFrame
    vectors: DataFrame
    graph: DataFrame
    edges: DataFrame
    entries: list[int]
    dim: int
    rounds: int

    def remove(self) -> None:
        drop(self.rows, self.vectors, self.graph, self.edges)


def _floats(column: pa.Array | pa.ChunkedArray, kind: str = "<f4") -> np.ndarray:
    """A matrix of the vectors that are stored as bytes, in single precision."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float32, copy=False)


def _numbers(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; cosines do not change."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _units(bits: int, dim: int):
    planes = np.random.default_rng(_SEED).standard_normal((TABLES * bits, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = scaled(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            signs = (x @ planes.T > 0).reshape(len(x), TABLES, bits)
            codes = (signs << np.arange(bits)).sum(axis=2, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * TABLES, pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([v.tobytes() for v in x.astype(t)], pa.binary()) for t in ("<f4", "<f2")], lists, b.column(1)], ["node", "unit", "half", "codes", "embedding"])

    return run


def whole(vectors: DataFrame) -> DataFrame:
    """Those of (embedding array) whose cosine is defined, in double precision."""
    x = F.col("embedding")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.withColumn("embedding", x.cast("array<double>")).filter(good)


def _top(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> pa.Table:
    """The k nearest b of each a, each once."""
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    _, first = np.unique(np.stack([a, b]), axis=1, return_index=True) if len(a) else (None, np.empty(0, np.int64))
    first.sort()
    a, b, s = a[first], b[first], s[first]
    begin = np.flatnonzero(np.diff(a, prepend=-1)) if len(a) else np.empty(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
    keep = rank < k
    return pa.table({"a": pa.array(a[keep]), "b": pa.array(b[keep]), "s": pa.array(s[keep].astype(np.float32))})


def _within(k: int):
    def run(t: pa.Table) -> pa.Table:
        ids, x = _numbers(t, "node"), _floats(t.column("unit"))
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        n = min(k, len(ids) - 1)
        if n < 1:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "s": pa.array([], pa.float32())})
        at = np.argpartition(-s, n - 1, axis=1)[:, :n]
        return pa.table({"a": pa.array(np.repeat(ids, n)), "b": pa.array(ids[at.ravel()]), "s": pa.array(np.take_along_axis(s, at, 1).ravel())})

    return run


def _meet(k: int):
    """New edges of the nodes that meet in the units of one part."""

    def run(edges: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = _numbers(vectors, "node")
        order = np.argsort(ids)
        ids, x, low = ids[order], _floats(vectors.column("half"), "<f2")[order], _numbers(vectors, "low")[order]
        v, block, u, fresh = (_numbers(edges, c) for c in ("v", "block", "u", "fresh"))
        order = np.lexsort((block, v))
        v, block, u, fresh = v[order], block[order], np.searchsorted(ids, u[order]), fresh[order]
        begin = np.flatnonzero((np.diff(v, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        sizes = np.diff(np.append(begin, len(v)))
        found = []
        some = np.add.reduceat(fresh.astype(np.int64), begin) > 0 if len(begin) else np.empty(0, bool)
        for at in np.array_split(np.flatnonzero(some), -(-int(some.sum()) // 128) or 1):
            if not len(at):
                continue
            width = int(sizes[at].max())
            cell = begin[at, None] + np.minimum(np.arange(width), sizes[at, None] - 1)
            there = np.arange(width) < sizes[at, None]
            m, new = u[cell], fresh[cell] & there
            s = np.matmul(x[m], x[m].transpose(0, 2, 1))
            ok = (new[:, :, None] | new[:, None, :]) & there[:, :, None] & there[:, None, :] & (m[:, :, None] != m[:, None, :]) & (s > low[m][:, :, None])
            n, i, j = np.nonzero(ok)
            found.append((ids[m[n, i]], ids[m[n, j]], s[n, i, j]))
        a, b, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        return _top(a, b, s, k)

    return run


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node of edges (a, b, s, old): (a, b, s, fresh)."""
    once = edges.groupBy("a", "b").agg(F.max("s").alias("s"), (~F.bool_or("old")).alias("fresh"))
    order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def _start(vectors: DataFrame, k: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Vectors with the block of their first table as ``home``, and the first graph; both staged."""
    key, dealt = F.struct("table", "code"), []
    codes = vectors.select("node", F.posexplode("codes").alias("table", "code"))
    counts = codes.groupBy("table", "code").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    placed = stage(codes.join(counts, ["table", "code"]).select("node", "table", F.xxhash64(key, F.pmod(F.xxhash64("node", "table"), "blocks")).alias("home")), "neighbours")
    out = stage(vectors.join(placed.filter("table = 0").select("node", "home"), "node").select("node", "home", "unit", "half", "embedding"), "neighbours")
    dealt = placed.join(out.select("node", "unit"), "node")
    graph = _nearest(dealt.groupBy("table", "home").applyInArrow(_within(k), EDGES).withColumn("old", F.lit(False)), k)
    graph = stage(graph, "neighbours")
    drop(placed)
    return out, graph


def _round(vectors: DataFrame, graph: DataFrame, k: int, parts: int, number: int) -> DataFrame:
    """The graph after one round."""
    low = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("low")).withColumnRenamed("a", "node")
    theirs = graph.groupBy("b").agg(F.ceil(F.count("*") / F.lit(2 * k)).alias("blocks")).withColumnRenamed("b", "node")
    nodes = vectors.select("node", "home", "half").join(low, "node", "left").join(theirs, "node", "left")
    nodes = stage(nodes.select(F.col("node").alias("u"), "home", "half", F.coalesce("low", F.lit(-2.0).cast("float")).alias("low"), F.coalesce("blocks", F.lit(1)).alias("blocks")), "neighbours")
    at = nodes.select(F.col("u").alias("v"), "home", "blocks")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    forward = graph.select(F.col("a").alias("v"), F.col("b").alias("u"), "fresh").join(at, "v").select("v", "home", "u", "fresh", every)
    backward = graph.select(F.col("b").alias("v"), F.col("a").alias("u"), "fresh").join(at, "v").select("v", "home", "u", "fresh", F.pmod(F.xxhash64("u", F.lit(number)), "blocks").alias("block"))
    own = at.select("v", "home", F.col("v").alias("u"), F.lit(False).alias("fresh"), every)
    within = F.pmod(F.xxhash64("v"), F.lit(-(-BLOCK // PART)))
    part = F.when(F.col("block") == 0, F.xxhash64("home", within)).otherwise(F.pmod(F.xxhash64("v", "block"), F.lit(parts)))
    edges = forward.unionByName(backward).unionByName(own).select(part.alias("part"), "v", "block", "u", "fresh").distinct()
    edges = stage(edges, "neighbours")
    needed = edges.select(F.col("part").alias("to"), F.col("u").alias("node")).distinct().join(nodes.select(F.col("u").alias("node"), "half", "low"), "node")
    met = edges.groupBy("part").cogroup(needed.groupBy("to")).applyInArrow(_meet(k), EDGES)
    out = stage(_nearest(met.withColumn("old", F.lit(False)).unionByName(graph.select("a", "b", "s", F.lit(True).alias("old"))), k), "neighbours")
    drop(nodes, edges)
    return out


def build(rows: DataFrame, k: int = K, members: int = 6, block: int = BLOCK, rounds: int = ROUNDS) -> Index:
    """The index of ``rows`` (row long, vec_id long, embedding array); ``members`` is one more than the neighbours that queries will ask for."""
    good = stage(whole(rows.select("row", F.col("vec_id").cast("long"), "embedding")), "neighbours")
    most = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = most["n"] if most else 1
    copies = Window.partitionBy("embedding").orderBy(F.col("vec_id").asc_nulls_last(), "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = stage(good.select("row", "vec_id", F.first("row").over(copies).alias("node"), F.row_number().over(copies).alias("rank"), "embedding").filter((F.size("embedding") == dim) & (F.col("rank") <= members)), "neighbours")
    nodes = kept.filter("rank = 1").select("node", "embedding")
    n = nodes.count()
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / block))))
    vectors = stage(nodes.mapInArrow(_units(bits, dim), UNITS), "neighbours")
    placed, graph = _start(vectors, k, block)
    done, fresh = 0, n * k
    while done < rounds and fresh > SETTLED * n * k:
        old, done = graph, done + 1
        graph = _round(placed, old, k, 1 + n // PART, done)
        drop(old)
        fresh = graph.filter("fresh").count()
    order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    pointing = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "s").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 2 * k)
    edges = stage(graph.select("a", "b").unionByName(pointing.select("a", "b")).distinct(), "neighbours")
    entries = [r["node"] for r in placed.select("node").orderBy(F.xxhash64("node"), "node").limit(ENTRIES).collect()]
    own = stage(kept.select("row", "vec_id", "node"), "neighbours")
    drop(good, kept, vectors)
    return Index(own, placed, graph, edges, entries, dim, done)


BEAMS = "part long, q long, id long, s float, state int"  # state: 1 to be expanded next, 2 expanded, 0 neither


def _advance(beam: int, step: int):
    """The beams of a part after scoring the rows that have no score yet."""

    def run(rows: pa.Table, vectors: pa.Table) -> pa.Table:
        is_query = _numbers(vectors, "query")
        ids, x = _numbers(vectors, "node"), _floats(vectors.column("unit"))
        sides = []
        for side in (is_query, ~is_query):
            order = np.flatnonzero(side)[np.argsort(ids[side])]
            sides.append((ids[order], x[order]))
        q, node, state = (_numbers(rows, c) for c in ("q", "id", "state"))
        s = rows.column("s").to_numpy().astype(np.float32)
        order = np.lexsort((-state, node, q))  # a node that is in the beam already comes before its new copies
        once = order[np.flatnonzero((np.diff(q[order], prepend=-1) != 0) | (np.diff(node[order], prepend=-1) != 0))]
        q, node, state, s = q[once], node[once], state[once], s[once]
        new = np.flatnonzero(state == -1)
        for at in np.array_split(new, -(-len(new) // (1 << 16)) or 1):
            a, b = (f[np.searchsorted(of, c[at])] for (of, f), c in zip(sides, (q, node), strict=True))
            s[at] = np.einsum("ij,ij->i", a, b)
        state = np.maximum(state, 0)
        order = np.lexsort((node, -s, q))
        q, node, state, s = q[order], node[order], state[order], s[order]
        begin = np.flatnonzero(np.diff(q, prepend=-1))
        keep = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q)))) < beam
        q, node, state, s = q[keep], node[keep], state[keep], s[keep]
        state[state == 1] = 2
        begin, open_ = np.flatnonzero(np.diff(q, prepend=-1)), np.cumsum(state == 0)
        before = np.repeat(open_[begin] - (state[begin] == 0), np.diff(np.append(begin, len(q))))
        state[(state == 0) & (open_ - before <= step)] = 1
        part = rows.column("part")[0].as_py()
        return pa.table({"part": pa.array(np.full(len(q), part)), "q": pa.array(q), "id": pa.array(node), "s": pa.array(s), "state": pa.array(state.astype(np.int32))})

    return run


def search(index: Index, queries: DataFrame, beam: int = BEAM, step: int = STEP) -> DataFrame:
    """(q, id, s): the beam of each of ``queries`` (q long, unit binary, node long or null), a staged table. ``q`` are not negative."""
    number = max(1, -(-queries.count() // QUERIES))
    queries = stage(queries.select(F.pmod(F.xxhash64("q"), F.lit(number)).alias("part"), "q", "unit", "node"), "search")
    starts = F.array_distinct(F.concat(F.when(F.col("node").isNotNull(), F.array("node")).otherwise(F.array().cast("array<long>")), F.array(*[F.lit(x).cast("long") for x in index.entries]).cast("array<long>")))
    rows = queries.select("part", "q", F.explode(starts).alias("id"))
    asked = queries.select(F.col("part").alias("to"), F.col("q").alias("node"), "unit", F.lit(True).alias("query"))
    beams = None
    while True:
        new = rows.select("part", "q", "id", F.lit(None).cast("float").alias("s"), F.lit(-1).alias("state"))
        needed = rows.select(F.col("part").alias("to"), F.col("id").alias("node")).distinct().join(index.vectors.select("node", "unit"), "node").select("to", "node", "unit", F.lit(False).alias("query"))
        every = new if beams is None else beams.unionByName(new)
        out = every.groupBy("part").cogroup(asked.unionByName(needed).groupBy("to")).applyInArrow(_advance(beam, step), BEAMS)
        last, beams = beams, stage(out, "search")
        if last is not None:
            drop(last)
        if not beams.filter("state = 1").limit(1).count():
            break
        rows = beams.filter("state = 1").select("part", "q", F.col("id").alias("a")).join(index.edges, "a").select("part", "q", F.col("b").alias("id"))
    drop(queries)
    return beams.select("q", "id", "s")


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (scaled(b.column(c).flatten().to_numpy().reshape(b.num_rows, -1)) for c in ("asked", "embedding"))
            s = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("id"), pa.array(s)], ["q", "id", "score"])


def nearest(index: Index, queries: DataFrame, neighbours: int = 5, beam: int = BEAM, step: int = STEP) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of the index for ``queries`` (query_id, embedding, row), which leave out the row of the index
    that ``row`` names (null: none). Queries whose vector has no cosine, or another dimension than the index, have no neighbours."""
    good = whole(queries.select("query_id", "row", "embedding")).filter(F.size("embedding") == index.dim)
    asked = good.join(index.vectors.select("embedding", "node"), "embedding", "left")
    asked = stage(asked.select(F.monotonically_increasing_id().alias("number"), "query_id", "row", "node", "embedding"), "search")
    # vectors that are not in the index get numbers beyond its own
    top = 1 + (index.vectors.agg(F.max("node")).first()[0] or 0)
    named = asked.select(F.coalesce("node", F.lit(top) + F.col("number")).alias("q"), "number", "query_id", "row", "node", "embedding")
    known = named.filter("node is not null").select("node").distinct().join(index.vectors, "node").select(F.col("node").alias("q"), "unit", "node", "embedding")
    foreign = named.filter("node is null").select(F.col("q").alias("node"), "embedding").mapInArrow(_units(0, index.dim), UNITS)
    own = stage(known.unionByName(foreign.select(F.col("node").alias("q"), "unit", F.lit(None).cast("long").alias("node"), "embedding")), "search")
    found = search(index, own.select("q", "unit", "node"), beam, step)
    best = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    few = found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= 4 * (neighbours + 1)).select("q", "id")
    exact = few.join(own.select("q", F.col("embedding").alias("asked")), "q").join(index.vectors.select(F.col("node").alias("id"), "embedding"), "id").mapInArrow(_cosines, "q long, id long, score double")
    rows = exact.join(index.rows.select(F.col("node").alias("id"), "vec_id", F.col("row").alias("other")), "id")
    # for a distinct vector the first rows, one more than asked for, as one of them can be the query's own
    order = [F.desc("score"), F.col("vec_id").asc_nulls_last(), "other"]
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("at") <= neighbours + 1)
    first = stage(first.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("at", "other", "vec_id", "score"))).alias("near")), "search")
    near = F.slice(F.filter("near", lambda x: ~x["other"].eqNullSafe(F.col("row"))), 1, neighbours)
    out = named.join(first, "q").select("query_id", F.posexplode(near).alias("at", "x"))
    out = stage(out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"), "search")
    drop(asked, own, found, first)
    return out


def nearest_rows(vectors: DataFrame, every: int, neighbours: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest other rows of each row of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``."""
    rows = stage(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), "embedding"), "neighbours")
    index = build(rows, max(K, neighbours), neighbours + 1)
    asked = rows.filter(F.col("vec_id") % every == 0).select("row", F.col("vec_id").alias("query_id"), "embedding")
    out = nearest(index, asked, neighbours)
    index.remove()
    drop(rows)
    return out.select("query_id", "rank", "vec_id", "score")
