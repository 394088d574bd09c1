"""Approximate nearest neighbours: NN-descent builds a graph over all vectors, queries walk it greedily.

The graph starts from blocks: vectors sorted by the signs of a few random projections and cut into blocks of fixed
size, a few times over. Each round of NN-descent then brings together, at every node, the nodes that have it as
neighbour, compares them with one another and keeps each node's nearest; this is a join of neighbours of
neighbours, one shuffle out and one back. Where more nodes meet than fit one block, they are dealt to blocks anew each round.
A query starts at its own node's neighbours and repeatedly scores
the neighbours of the best nodes it has, until its best list stays the same.

Equal vectors are one node, named by their smallest id, so a vector that a third of all rows hold is no hub.
Norms differ in general, so the graph is built on vectors with one more component that makes all norms
equal; nearness is then the same as the largest inner product. The graph works on rounded vectors; scores
are computed from the original ones, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import count_for, cut, parts, tidy

#: Centres of one group. A node goes to each group that has a centre of its, so to no more groups than it has centres, however many groups there are.
CENTRES = 256
GRAPH = "u long, nbrs array<long>, sims array<float>"


def _lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def _nearest(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each owner its k most similar distinct others: owners, list sizes, others and similarities."""
    order = np.lexsort((other, owner))
    o, v, s = owner[order], other[order], sim[order]
    keep = np.r_[True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])] & (o != v) if len(o) else np.zeros(0, bool)
    o, v, s = o[keep], v[keep], s[keep]
    order = np.lexsort((v, -s, o))
    o, v, s = o[order], v[order], s[order]
    first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(o)])
    keep = np.arange(len(o)) - np.repeat(first, sizes) < k
    return o[first], np.minimum(sizes, k), v[keep], s[keep]


def _graph_table(owner, sizes, other, sim) -> pa.Table:
    return pa.table({"u": pa.array(owner, pa.int64()), "nbrs": _lists(other, sizes, pa.int64()), "sims": _lists(sim.astype(np.float32), sizes, pa.float32())})


def _block_pairs(ids: np.ndarray, vecs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's k most similar others within one block."""
    sim = vecs @ vecs.T
    np.fill_diagonal(sim, -np.inf)
    k = min(k, len(ids) - 1)
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), np.int64)
    return np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(sim, near, 1).ravel()


def dealt(ids: np.ndarray, turn: int) -> np.ndarray:
    """A key for each id by which ids fall into another order in each turn."""
    x = (ids.astype(np.uint64) + np.uint64(1 + turn)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64((turn + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _vectors(blobs: list) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float16).reshape(len(blobs), -1).astype(np.float32)


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id long, v array<double>): rows with an id and a vector that is finite, without null parts and not zero."""
    v = rows.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    return v.where("not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(v, x -> x <> 0)")


def build_graph(nodes: DataFrame, n: int, largest: float, degree: int = 40, trees: int = 3, rounds: int = 8, block: int = 128) -> DataFrame:
    """GRAPH rows over ``nodes`` (u long, v array<double>): each node's nearest by NN-descent, best first.

    Rounds end when fewer than one in a hundred list entries are new.
    """
    spark = nodes.sparkSession
    groups, homes, p = count_for(n, CENTRES), count_for(n, 1500), parts(spark)
    dims = nodes.select(F.size("v")).first()
    d = (dims[0] if dims else 0) + 1
    bits = max(1, int(np.ceil(np.log2(max(2, n / block)))))
    planes = [np.random.default_rng(31 + t).standard_normal((d, bits + 1)) for t in range(trees)]

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) / largest
            v = np.concatenate([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1)))[:, None]], axis=1)
            code = []
            for pl in planes:
                at = v @ pl
                bit = at[:, :bits] > 0
                gray = np.logical_xor.accumulate(bit, axis=1)
                code.append(gray @ (2.0 ** np.arange(bits - 1, -1, -1)) + (np.tanh(at[:, bits]) + 1) / 2.0001)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v.astype(np.float16)], pa.binary()), *(pa.array(c, pa.float64()) for c in code)], ["u", "h", *(f"c{t}" for t in range(trees))])

    points = cut(nodes.mapInArrow(rounded, "u long, h binary, " + ", ".join(f"c{t} double" for t in range(trees))))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, block):
                ids, v = b.column(0).to_numpy()[a : a + block], _vectors(b.column(1).to_pylist()[a : a + block])
                yield from _graph_table(*_nearest(*_block_pairs(ids, v, degree), degree)).to_batches()

    found = None
    for t in range(trees):
        some = points.repartitionByRange(p, f"c{t}").sortWithinPartitions(f"c{t}", "u").select("u", "h").mapInArrow(blocks, GRAPH)
        found = some if found is None else found.union(some)

    def merged(rows: pa.Table) -> pa.Table:
        sizes = np.diff(rows.column("nbrs").combine_chunks().offsets.to_numpy())
        flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy()
        return _graph_table(*_nearest(np.repeat(rows.column("u").to_numpy(), sizes), flat("nbrs"), flat("sims"), degree))

    def meeting(turn: int):
        return lambda rows: met(rows, turn)

    def met(rows: pa.Table, turn: int) -> pa.Table:
        centres = rows.column("cs").combine_chunks()
        owner = np.repeat(np.arange(len(rows)), np.diff(centres.offsets.to_numpy()))
        centre, ids, vecs, kth = centres.flatten().to_numpy(), rows.column("u").to_numpy(), _vectors(rows.column("h").to_pylist()), rows.column("kth").to_numpy()
        order = np.lexsort((dealt(ids, turn)[owner], centre))  # other blocks of a hub's members in each round
        cuts = np.flatnonzero(np.r_[True, centre[order][1:] != centre[order][:-1]])
        got = []
        for a, z in zip(cuts, [*cuts[1:], len(order)], strict=False):
            for x in range(a, z, block):
                at = owner[order[x : min(z, x + block)]]
                i, j, sim = _block_pairs(at, vecs[at], degree)
                new = sim > kth[i]  # others would not enter the list
                got.append((ids[i[new]], ids[j[new]], sim[new]))
        return _graph_table(*_nearest(*(np.concatenate(x) for x in zip(*got, strict=True)), degree))

    grouped = lambda df: df.withColumn("_g", F.pmod(F.xxhash64("u"), F.lit(homes))).groupBy("_g").applyInArrow(merged, GRAPH)
    graph = cut(grouped(found))
    for turn in range(rounds):
        out = graph.select("u", F.explode("nbrs").alias("c"))
        edges = out.union(out.select(F.col("c").alias("u"), F.col("u").alias("c"))).union(graph.select("u", F.col("u").alias("c"))).repartition(p, "u")
        sent = edges.groupBy("u", F.pmod(F.xxhash64("c"), F.lit(groups)).alias("_g")).agg(F.collect_set("c").alias("cs"))
        known = points.select("u", "h").join(graph.select("u", F.when(F.size("sims") >= degree, F.array_min("sims")).otherwise(F.lit(-2.0)).cast("float").alias("kth")), "u")
        near = sent.join(known, "u").groupBy("_g").applyInArrow(meeting(turn), GRAPH)
        after = cut(grouped(near.union(graph)))
        new = after.join(graph.select("u", F.col("nbrs").alias("old")), "u").agg(F.sum(F.size(F.array_except("nbrs", "old")))).first()[0] or 0
        graph = after
        tidy(spark)
        if new < 0.01 * n * degree:
            break
    return graph


def search(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, degree: int = 40, beam: int = 90) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row whose id ``every`` divides, the k others of largest inner product.

    A query walks until no node of its best ``beam`` is left unvisited. Ties go to the smaller id. Vectors that are null, zero, or hold null or
    non-finite parts take no part. Vectors of different lengths have no inner product: each length, of which there may be up to 16, is searched
    by itself. Rows that repeat an id are one, with the smallest of their vectors. No usable vectors give no rows. Other columns are not read.
    """
    good = usable(rows, id, vector).groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = sorted(r[0] for r in good.select(F.size("v")).distinct().limit(17).collect())
    if len(lengths) > 16:
        raise ValueError("vectors of more than 16 lengths")
    found = [_searched(good.where(F.size("v") == d), every, k, degree, beam) for d in lengths]
    return reduce(DataFrame.union, found) if found else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _searched(good: DataFrame, every: int, k: int, degree: int, beam: int) -> DataFrame:
    """``search`` among vectors of one length."""
    spark = good.sparkSession
    classes = good.groupBy("v").agg(F.min("vec_id").alias("u"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("asks"))
    nodes = cut(classes)
    n, largest = nodes.agg(F.count("*"), F.max(F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))"))).first()
    graph = build_graph(nodes.select("u", "v"), n, largest or 1.0, degree)
    groups = count_for(n, 4096)

    homes = nodes.select(F.pmod(F.xxhash64("u"), F.lit(groups)).alias("_g"), "u", "v")

    def scores(asked: pa.Table, home: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], pa.int64()), "w": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(asked):
            return empty
        lists = asked.column("ws").combine_chunks()
        owner, w = np.repeat(np.arange(len(asked)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        u = home.column("u").to_numpy()
        order = np.argsort(u)
        at = order[np.searchsorted(u[order], w)]
        x, y = (t.column(c).combine_chunks().flatten().to_numpy().reshape(len(t), -1) for t, c in ((asked, "qv"), (home, "v")))
        dots = np.concatenate([np.einsum("ij,ij->i", x[owner[a : a + 20_000]], y[at[a : a + 20_000]]) for a in range(0, len(w), 20_000)])
        return pa.table({"q": pa.array(asked.column("q").to_numpy()[owner], pa.int64()), "w": pa.array(w, pa.int64()), "score": dots})

    def scored(pairs: DataFrame) -> DataFrame:
        """(q, w, score) of pairs (q, w), in double precision from the original vectors; a query's vector goes to each group of nodes once."""
        asked = pairs.groupBy("q", F.pmod(F.xxhash64("w"), F.lit(groups)).alias("_g")).agg(F.collect_set("w").alias("ws"))
        asked = asked.join(nodes.select(F.col("u").alias("q"), F.col("v").alias("qv")), "q")
        return asked.groupBy("_g").cogroup(homes.groupBy("_g")).applyInArrow(scores, "q long, w long, score double")

    keep = max(k + 4, beam)

    def best(rows_: pa.Table) -> pa.Table:
        q, w, s, e = (rows_.column(c).to_numpy(zero_copy_only=False) for c in ("q", "w", "score", "open"))
        order = np.lexsort((e, w, q))
        q, w, s, e = q[order], w[order], s[order], e[order]
        one = np.r_[True, (q[1:] != q[:-1]) | (w[1:] != w[:-1])]
        q, w, s, e = q[one], w[one], s[one], e[one]
        order = np.lexsort((w, -s, q))
        q, w, s, e = q[order], w[order], s[order], e[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        top = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < keep
        return pa.table({"q": q[top], "w": w[top], "score": s[top], "open": e[top]})

    shape = "q long, w long, score double, open int"
    pick = lambda df: cut(df.withColumn("_g", F.pmod(F.xxhash64("q"), F.lit(groups))).groupBy("_g").applyInArrow(best, shape))
    asking = nodes.where("asks = 1").select(F.col("u").alias("q"))
    start = asking.join(graph, asking["q"] == graph["u"]).select("q", F.explode("nbrs").alias("w")).union(asking.select("q", F.col("q").alias("w")))
    state = pick(scored(start).withColumn("open", F.lit(1)))
    while not state.where("open = 1 and q <> w").isEmpty():
        wave = state.where("open = 1 and q <> w").join(graph, F.col("w") == F.col("u")).select("q", F.explode("nbrs").alias("w"))
        state = pick(state.withColumn("open", F.lit(0)).union(scored(wave).withColumn("open", F.lit(1))))
        tidy(spark)
    # Every node stands for its rows; of each, the smallest ids are enough.
    rows_of = good.join(classes.select("v", "u"), "v").select("u", "vec_id").distinct()
    some = rows_of.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
    short = state.select("q", "score", F.col("w").alias("u")).join(some, "u").select("q", "score", "vec_id")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    short = short.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    asked = rows_of.where(F.col("vec_id") % every == 0).select(F.col("u").alias("q"), F.col("vec_id").alias("query_id"))
    mine = asked.join(short, "q").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return mine.select("query_id", F.posexplode("found").alias("p", "f")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
