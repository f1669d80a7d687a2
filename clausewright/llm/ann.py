"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, kept as flat neighbour arrays.

Equal vectors are one node, so any number of copies is one row with its smallest ids. Nodes are dealt to shards by a hash, a
shard's graph is built in one task, and the index is written to the shared folder, one row a shard. Query blocks are sent to every
shard; a task loads one graph at a time, walks it for a whole block of queries in step, and the shards' best are merged."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.llm.common import read, staged

#: Links of a node in the upper layers, and twice as many in the lowest.
LINKS = 16
#: Width of the beam when building and when searching.
EF_BUILD, EF = 64, 128
#: Distinct vectors of a shard and bytes of them, on average, and the least number of shards.
SHARD, SHARD_BYTES, LEAST_SHARDS = 65_536, 128 << 20, 8
#: Queries sent together, and walked together.
SENT, TOGETHER = 16, 256


def _sims(x: np.ndarray, ids: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.matmul(x[ids], to[:, :, None])[:, :, 0]


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef nodes nearest to each query that a best-first walk finds, and their cosines, best first; -1 and -inf where there are fewer."""
    q = len(queries)
    ids = np.full((q, ef), -1, np.int32)
    sims = np.full((q, ef), -np.inf, np.float32)
    fresh = np.zeros((q, ef), bool)
    seen = np.zeros((q, len(x)), bool)
    rows = np.arange(q)
    ids[:, 0], sims[:, 0], fresh[:, 0] = entry, np.einsum("qd,qd->q", x[entry], queries), True
    seen[rows, entry] = True
    while len(rows):
        best = np.where(fresh[rows], sims[rows], -np.inf).argmax(1)
        going = fresh[rows, best]
        rows, best = rows[going], best[going]
        if not len(rows):
            break
        fresh[rows, best] = False
        near = links[ids[rows, best]]
        near_ok = (near >= 0) & ~seen[rows[:, None], near]
        seen[np.repeat(rows, near_ok.sum(1)), near[near_ok]] = True
        s = np.where(near_ok, _sims(x, near, queries[rows]), -np.inf).astype(np.float32)
        all_s = np.concatenate([sims[rows], s], 1)
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        sims[rows] = np.take_along_axis(all_s, top, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(near_ok, near, -1)], 1), top, 1)
        fresh[rows] = np.take_along_axis(np.concatenate([fresh[rows], near_ok], 1), top, 1)
    order = np.argsort(-sims, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def choose(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of each row's candidates (best first): those nearer to the row's own node than to any chosen one, then the best of the rest."""
    ok = ids >= 0
    v = x[np.maximum(ids, 0)]
    among = np.matmul(v, v.transpose(0, 2, 1))
    taken = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        nearest = np.where(taken, among[:, c, :], -np.inf).max(1)
        taken[:, c] = ok[:, c] & (sims[:, c] >= nearest) & (taken.sum(1) < most)
    rank = np.where(taken, 0, np.where(ok, 1, 2))
    order = np.argsort(rank, 1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)


class Graph:
    """Unit vectors in the order of their top layers, so that each layer is a prefix; layers[l]: neighbour places, -1 for none."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 0) -> tuple[Graph, np.ndarray]:
        """The graph, and which row of x each of its nodes is."""
        n = len(x)
        top = np.floor(-np.log(np.random.default_rng([seed, n]).random(n)) / np.log(LINKS)).astype(int)
        order = np.argsort(-top, kind="stable")
        made = cls(np.ascontiguousarray(x[order]), [])
        sizes = [int((top >= k).sum()) for k in range(top.max() + 1)]
        for size in reversed(sizes):
            made.layers.insert(0, np.empty((0, 0), np.int32))
            made.layers[0] = made._layer(size, LINKS * 2 if size == n else LINKS)
        return made, order

    def _enter(self, queries: np.ndarray, below: int) -> np.ndarray:
        """Greedy descent to the layer above `below`."""
        at = np.zeros(len(queries), np.int32)
        for layer in reversed(self.layers[below + 1 :]):
            at = beam(self.x[: len(layer)], layer, queries, at, 1)[0][:, 0]
        return at

    def _layer(self, n: int, most: int) -> np.ndarray:
        x, links = self.x[:n], np.full((n, most), -1, np.int32)
        first = min(n, 128)
        s = x[:first] @ x[:first].T
        np.fill_diagonal(s, -np.inf)
        order = np.argsort(-s, 1, kind="stable")[:, : first - 1]
        if first > 1:
            got = choose(x, order, np.take_along_axis(s, order, 1), most)
            links[:first, : got.shape[1]] = got
        i = first
        while i < n:
            size = min(n - i, max(64, min(TOGETHER * 2, i // 2)))
            new = x[i : i + size]
            entry = self._enter(new, 0) if len(self.layers) > 1 else np.zeros(size, np.int32)
            ids, sims = beam(x[:i], links, new, np.where(entry < i, entry, 0), min(EF_BUILD, i))
            own = np.where(np.tri(size, k=-1, dtype=bool), new @ new.T, -np.inf)
            near = np.argsort(-own, 1, kind="stable")[:, :16]
            near_s = np.take_along_axis(own, near, 1)
            ids = np.concatenate([ids, np.where(np.isfinite(near_s), near + i, -1)], 1)
            sims = np.concatenate([sims, near_s.astype(np.float32)], 1)
            best = np.argsort(-sims, 1, kind="stable")
            got = choose(x, np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1), LINKS)
            links[i : i + size, : got.shape[1]] = got
            self._back(x, links, got, i, most)
            i += size
        return links

    @staticmethod
    def _back(x: np.ndarray, links: np.ndarray, got: np.ndarray, start: int, most: int) -> None:
        """Each chosen neighbour links back; one with too many links chooses anew among all of them."""
        source, target = np.repeat(np.arange(start, start + len(got)), got.shape[1]), got.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, at, count = np.unique(target, return_index=True, return_counts=True)
        for a in range(0, len(nodes), 1024):
            node, c = nodes[a : a + 1024], count[a : a + 1024]
            added = np.full((len(node), c.max()), -1, np.int32)
            row = np.repeat(np.arange(len(node)), c)
            added[row, np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)] = source[at[a] : at[a] + c.sum()]
            ids = np.concatenate([links[node], added], 1)
            sims = np.where(ids >= 0, _sims(x, ids, x[node]), -np.inf)
            best = np.argsort(-sims, 1, kind="stable")
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            full = (ids >= 0).sum(1) > most
            out = ids[:, :most].copy()
            if full.any():
                out[full] = choose(x, ids[full], sims[full], most)
            links[node, : out.shape[1]] = out

    def search(self, queries: np.ndarray, ef: int = EF) -> np.ndarray:
        """Places of the nodes found for each query, nearest first, -1 where there are fewer."""
        out = [np.zeros((0, ef), np.int32)]
        for a in range(0, len(queries), TOGETHER):
            q = queries[a : a + TOGETHER]
            out.append(beam(self.x, self.layers[0], q, self._enter(q, 0), ef)[0])
        return np.concatenate(out)


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), dim of the rows whose id and components are there, finite and not all 0; equal rows once."""
    v = F.col("embedding").cast("array<double>")
    largest = F.aggregate("v", F.lit(0.0), lambda a, b: F.greatest(a, F.abs(b)))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(fine).where(largest > 0).withColumn("dim", F.size("v")).distinct()


def build_index(rows: DataFrame, k: int, shard: int = SHARD) -> tuple[DataFrame, int]:
    """The index, one row a shard and dimension, as written to the shared folder, and the number of shards. rows: vec_id, v, dim."""
    import pyarrow as pa

    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = staged(rows.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("v", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    n, values = nodes.agg(F.count("*"), F.sum("dim")).first()
    n_shards = max(LEAST_SHARDS, -(-n // shard), -(-8 * (values or 0) // SHARD_BYTES))
    schema = "dim int, shard long, ids array<array<long>>, vectors binary, sizes array<int>, links binary"

    def build(table):
        d = table.drop_columns(["v"]).to_pydict()
        first_id = sorted(range(len(d["ids"])), key=lambda i: d["ids"][i])
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d["dim"][0])[first_id]
        graph, order = Graph.build(_unit(v / np.abs(v).max(1)[:, None]), seed=int(d["shard"][0]))
        sizes = [s for layer in graph.layers for s in layer.shape]
        row = [d["dim"][:1], d["shard"][:1], [[d["ids"][first_id[i]] for i in order.tolist()]], [v[order].tobytes()], [sizes], [b"".join(x.tobytes() for x in graph.layers)]]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.list_(pa.int32()), pa.binary()]
        return pa.table({f.split()[0]: pa.array(x, t) for f, x, t in zip(schema.split(", "), row, kinds)})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(n_shards)))
    return staged(dealt.groupBy("dim", "shard").applyInArrow(build, schema), "index"), n_shards


class _Loaded:
    def __init__(self, row: dict):
        self.v = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
        self.ids = row["ids"]
        layers, at, flat = [], 0, np.frombuffer(row["links"], np.int32)
        for n, m in zip(row["sizes"][::2], row["sizes"][1::2]):
            layers.append(flat[at : at + n * m].reshape(n, m))
            at += n * m
        self.graph = Graph(_unit(self.v / np.abs(self.v).max(1)[:, None]), layers)

    def nearest(self, ids: list[int], v: np.ndarray, k: int):
        """query id, vec_id, cosine of the k nearest ids found for each query but its own; cosines anew in double precision."""
        found = self.graph.search(_unit(v / np.abs(v).max(1)[:, None]))[:, : max(4 * k, k + 8)]
        a, b = v / np.abs(v).max(1)[:, None], self.v[found] / np.abs(self.v[found]).max(2)[:, :, None]
        cos = np.einsum("qcd,qd->qc", b, a) / np.sqrt(np.einsum("qd,qd->q", a, a))[:, None] / np.sqrt(np.einsum("qcd,qcd->qc", b, b))
        for q, own in enumerate(ids):
            best = sorted((-c, x) for c, p in zip(cos[q].tolist(), found[q].tolist()) if p >= 0 for x in self.ids[p] if x != own)[:k]
            yield from ((own, x, -c) for c, x in best)


def search(queries: DataFrame, index: DataFrame, n_shards: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found over all shards, ties to the smaller vec_id. queries: vec_id, v, dim."""
    import pyarrow as pa

    sent = (
        queries.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-queries.count() // SENT)))))
        .groupBy("dim", "b").agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)).cast("array<long>"))).drop("b")
    )
    both = index.withColumn("kind", F.lit(0)).unionByName(sent.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(n, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")

    def run(batches):
        now, loaded, ids, v = None, None, [], []

        def answer():
            out = list(loaded.nearest(ids, np.array(v), k)) if loaded and ids else []
            ids.clear()
            v.clear()
            cols = list(zip(*out)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["dim"], row["shard"]) != now:
                    yield answer()
                    now, loaded = (row["dim"], row["shard"]), None
                if row["kind"] == 0:
                    loaded = _Loaded(row)
                else:
                    ids += [x["vec_id"] for x in row["q"]]
                    v += [x["v"] for x in row["q"]]
                    if len(ids) >= TOGETHER:
                        yield answer()
        yield answer()

    found = ordered.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of each embedding whose vec_id is divisible by 50, among all others.

    Vectors that are null, zero or have null or non-finite components, and rows without vec_id, take no part; rows equal in vec_id and
    vector count once, and a vec_id with several vectors is a candidate with each, its best counting. Ties in cosine go to the smaller
    vec_id. Vectors of different lengths don't meet. With fewer candidates all are returned; an empty table gives an empty result."""
    k = 5
    rows = staged(usable(read(spark, sf_dir, "embeddings")), "vectors")
    index, n_shards = build_index(rows, k)
    return search(rows.where(F.col("vec_id") % 50 == 0), index, n_shards, k)
