"""Near-duplicate documents by SetSketch registers.

A register is a truncated minimum, on a scale of powers of BASE, of exponential variables of a document's shingles, so sketches
of parts merge by maxima and equal registers tell of common shingles. Bands of registers propose pairs, the registers' joint
likelihood estimates their similarity, and the full shingle sets decide.

Documents of equal sets are one node from the start, known by the digest of the set, so any number of copies is one row with one
set. In each band bucket every node is held against the bucket's smallest (a star, linear in the bucket); then nodes of a bucket
that are still in different components are compared in blocks bounded in nodes and bytes: first by sizes and registers alone, and
only the nodes that have a likely partner in a block meet there again with their sets. No link between different texts that the
bands propose is lost and no list of all pairs is written. Components come from alternating large and small stars over the links.

exact=True proposes by prefixes instead of bands: of two sets that are similar enough each has a common shingle among its rarest
few, so no link is missed at all, at the cost of counting every shingle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.llm.common import mix64, read, row_key, staged, tokens

#: Words of a shingle, and a link: 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 5, 80
#: Bands and registers in each. At similarity 0.8 a pair shares no band with a chance of 2e-7.
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: Scale and rate of the registers.
BASE, RATE = 1.02, 20.0
#: Estimates have a standard deviation of about 0.03; a pair estimated this much below the threshold isn't verified.
MARGIN = 0.15
#: Nodes of a bucket on either side of a block, and bytes of their sets; both are means, as nodes are dealt by hash.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: A digest of more than this share of all rows is met by broadcast; there can't be more than 1 / HOT of them.
HOT = 0.001

_RNG = np.random.default_rng(4)
_MUL = _RNG.integers(0, 2**31, REGISTERS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_PLACE = _RNG.integers(1, 2**63, 32, dtype=np.uint64) | np.uint64(1)
_BAND = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingles as 64-bit codes: runs of so many words, or the whole text if it has fewer; none without words."""
    codes, counts = tokens(texts)
    n = max(0, len(codes) - shingle + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(shingle):
        rolled += codes[j : j + n] * _PLACE[j]
    rolled = mix64(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= shingle:
            out.append(np.unique(rolled[at : at + c - shingle + 1]))
        elif c:
            out.append(mix64(np.array([(codes[at : at + c] * _PLACE[:c]).sum() + np.uint64(c)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set, as uint16; zeros for an empty one."""
    least = np.full((len(sets), REGISTERS), 0xFFFFFFFF, np.uint32)
    lengths = np.array([len(s) for s in sets])
    full = np.flatnonzero(lengths)
    if len(full):
        items = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        ends = np.cumsum(lengths[full])
        step, a = 1 << 15, 0
        buffer = np.empty(step, np.uint32)
        for a in range(0, len(items), step):
            part = items[a : a + step]
            b, held = a + len(part), buffer[: len(part)]
            lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left")
            edges = np.concatenate([[0], ends[lo:hi] - a])
            rows = full[lo : hi + 1][: len(edges)]
            found = np.empty((REGISTERS, len(edges)), np.uint32)
            for i in range(REGISTERS):
                np.multiply(part, _MUL[i], out=held)
                np.add(held, _ADD[i], out=held)
                np.minimum.reduceat(held, edges, out=found[i])
            least[rows] = np.minimum(least[rows], found.T)
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    k = np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE))
    k[lengths == 0] = 0
    return np.clip(k, 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    return mix64((parts * _BAND).sum(2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def estimate(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest similarity of pairs of known sizes with so many registers above and below each other; the rest are equal.

    The log-likelihood is concave in the similarity, so a ternary search finds its maximum."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    tiny = 1e-12

    def likelihood(j):
        a, b = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        return above * np.log(a + tiny) + below * np.log(b + tiny) + (REGISTERS - above - below) * np.log(np.maximum(1 - a - b, tiny))

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(24):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = likelihood(x) < likelihood(y)
        lo, hi = np.where(left, x, lo), np.where(left, hi, y)
    return (lo + hi) / 2


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _row(docs: DataFrame) -> DataFrame:
    """doc_id, h (a code of the text), text: rows equal in doc_id and h have one text."""
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text")


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, h, n_shingles, digest, regs of each row of docs (doc_id, text)."""
    import hashlib

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = shingle_sets(part.column(2).to_pylist(), shingle)
                regs = registers(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    ["doc_id", "h", "n_shingles", "digest", "regs"],
                )

    return _row(docs).mapInArrow(run, "doc_id long, h long, n_shingles long, digest binary, regs binary")


def _bands(nodes: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                regs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                keys = band_keys(regs)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids, pa.int64())], ["key", "node"])

    return nodes.select("node", "regs").mapInArrow(run, "key long, node long")


def _prefixes(full: DataFrame, percent: int) -> DataFrame:
    """key, node: the shingles among each set's rarest n - ceil(n * percent / 100) + 1 that other sets have too. Of two linked sets both have one of them."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                items = np.frombuffer(batch.column(1)[i].as_py(), np.int64)
                for a in range(0, len(items), 65536):
                    part = items[a : a + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), batch.column(0)[i].as_py()))], ["key", "node"])

    rows = full.select("node", "items").mapInArrow(run, "key long, node long")
    common = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    met = rows.join(common, "key")
    shared = met.groupBy("node").agg(F.count("*").alias("shared"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("c", "key"))
    due = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("shared"))
    return met.withColumn("place", place).join(full.select("node", "n").join(shared, "node"), "node").where(F.col("place") <= due).select("key", "node")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, n, regs and items (the full set) of the nodes in wanted (node, doc_id, h, rows, n, regs): one row each, from one text of the node."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = shingle_sets(part.column(3).to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "regs", "items"])

    met = lambda where: _row(docs).join(wanted.where(where).hint("shuffle_hash"), ["doc_id", "h"]).select("node", "n", "regs", "text")
    # A node's text stands in one row but where rows repeat.
    once, again = met("rows = 1"), met("rows > 1").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "regs", "text")])
    return once.unionByName(again).mapInArrow(run, "node long, n long, regs binary, items binary")


def _sized(percent: int):
    return (100 * F.least("n_a", "n_b")) >= percent * F.greatest("n_a", "n_b")


def _verify(pairs: DataFrame, full: DataFrame, percent: int, margin: float | None) -> DataFrame:
    """The pairs a, b that are links: sizes and registers are met first, and sets only for the pairs that these leave."""
    import pyarrow as pa

    side = lambda x, columns: full.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    meet = lambda pairs, columns: pairs.join(side("b", columns), "b").join(side("a", columns), "a")

    def likely(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                d = batch.slice(i, 2048).to_pydict()
                ra, rb = (np.frombuffer(b"".join(d[c]), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
                e = estimate((ra > rb).sum(1), (ra < rb).sum(1), np.array(d["n_a"], float), np.array(d["n_b"], float))
                keep = np.flatnonzero(e >= percent / 100 - margin)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(d[c], np.int64)[keep]) for c in ("a", "b")], ["a", "b"])

    def sure(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                d = batch.slice(i, 256).to_pydict()
                keep = np.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(d["items_a"], d["items_b"])], bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(d[c], np.int64)[keep]) for c in ("a", "b")], ["a", "b"])

    if margin is not None:
        sized = meet(pairs, ("n", "regs")).where(_sized(percent)).select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
        pairs = staged(sized.mapInArrow(likely, "a long, b long"), "likely")
    else:
        pairs = meet(pairs, ("n",)).where(_sized(percent)).select("a", "b")
    return meet(pairs, ("items",)).select("a", "b", "items_a", "items_b").mapInArrow(sure, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in the edges a, b. Alternates large and small stars until nothing changes; each round is written to the shared folder."""
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = state
        ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        now = staged(small.where("a <> b").distinct(), "edges")


def _blocks(members: DataFrame, full: DataFrame, percent: int, margin: float | None) -> DataFrame:
    """Links between nodes of one bucket in different components. members: key, node, component, n.

    The largest component of a bucket is cut into chunks that meet only the others' chunks, the others' chunks also each other."""
    import pyarrow as pa

    kinds = members.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    of = lambda c, m: F.ceil(F.greatest(c / BLOCK, 8 * m / BLOCK_BYTES)).cast("int")
    big = F.max(F.struct("c", "component", "m")).alias("b")
    buckets = (
        kinds.groupBy("key").agg(big, F.sum("c").alias("c"), F.sum("m").alias("m")).where("c > b.c")
        .select("key", F.col("b.component").alias("big"), of(F.col("c") - F.col("b.c"), F.col("m") - F.col("b.m")).alias("k_rest"), of(F.col("b.c"), F.col("b.m")).alias("k_big"))
    )
    # Written first, so that the join's sides are plain exchanges, of which Spark can split a hot bucket's.
    rows = members.select("key", "node", "component").join(staged(buckets, "buckets"), "key").withColumn("inside", F.col("component") == F.col("big"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("k_big")).otherwise(F.col("k_rest"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("k_rest") - 1)
    meets_big = F.transform(others, lambda x: F.struct(x.alias("x"), F.col("chunk").alias("y"), F.lit(True).alias("with_big")))
    meets = F.concat(
        F.transform(others, lambda x: F.struct(F.least(x, F.col("chunk")).alias("x"), F.greatest(x, F.col("chunk")).alias("y"), F.lit(False).alias("with_big"))),
        F.transform(F.sequence(F.lit(0), F.col("k_big") - 1), lambda y: F.struct(F.col("chunk").alias("x"), y.alias("y"), F.lit(True).alias("with_big"))),
    )
    dealt = rows.select("key", "node", "component", "inside", F.explode(F.when(F.col("inside"), meets_big).otherwise(meets)).alias("at")).select("key", "at.*", "inside", "node", "component")
    by = ("key", "x", "y", "with_big")
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    banded = margin is not None

    def met(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        got = rows.join(full.select("node", *columns), "node").select(*by, "inside", "node", "component", *columns)
        return got.repartition(n, *by).sortWithinPartitions(*by)

    def likely(batches):
        for g in _groups(batches, by):
            keep = sorted({x for i, js in _likely(g, percent, margin) for x in (i, *js.tolist())})
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([g[c][i] for i in keep], t) for c, t in zip((*by, "inside", "node", "component"), (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()))], [*by, "inside", "node", "component"])

    def sure(batches):
        for g in _groups(batches, by):
            found = _links(g, percent, margin)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    if banded:
        dealt = staged(met(dealt, ("n", "regs")).mapInArrow(likely, "key long, x int, y int, with_big boolean, inside boolean, node long, component long"), "likely")
    return met(dealt, ("n", "regs", "items")).mapInArrow(sure, "a long, b long")


def _groups(batches, by: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Runs of rows with equal keys, across batches."""
    held: dict[str, list] | None = None
    now = None
    for batch in batches:
        d = batch.to_pydict()
        keys = list(zip(*(d[c] for c in by)))
        i = 0
        while i < len(keys):
            j = i
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            if held is not None and keys[i] == now:
                for c in d:
                    held[c] += d[c][i:j]
            else:
                if held is not None:
                    yield held
                held, now = {c: d[c][i:j] for c in d}, keys[i]
            i = j
    if held is not None:
        yield held


def _likely(g: dict[str, list], percent: int, margin: float | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each place in a block the later places that may be linked with it. Without a margin sizes alone decide.

    A pair that shares an earlier band is left to that band's bucket."""
    n, comp, inside = np.array(g["n"], float), np.array(g["component"]), np.array(g["inside"])
    if margin is not None:
        regs = np.frombuffer(b"".join(g["regs"]), np.uint16).reshape(-1, REGISTERS)
        keys = band_keys(regs)
        band = int(np.flatnonzero(keys[0] == g["key"][0])[0])
    for i in range(len(n) - 1):
        j = np.arange(i + 1, len(n))
        possible = 100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])
        j = j[(comp[j] != comp[i]) & possible & ((inside[j] != inside[i]) if g["with_big"][0] else True)]
        if margin is not None and len(j):
            j = j[~(keys[j, :band] == keys[i, :band]).any(1)]
            e = estimate((regs[i] > regs[j]).sum(1), (regs[i] < regs[j]).sum(1), np.full(len(j), n[i]), n[j]) if len(j) else np.zeros(0)
            j = j[e >= percent / 100 - margin]
        if len(j):
            yield i, j


def _links(g: dict[str, list], percent: int, margin: float | None) -> list[tuple[int, int]]:
    """Links that join the block's components; pairs already in one component are skipped, all others that may be links are verified."""
    comp = g["component"]
    top = {c: c for c in comp}

    def root(c):
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    out, items = [], [np.frombuffer(x, np.uint64) for x in g["items"]]
    for i, js in _likely(g, percent, margin):
        for k in js.tolist():
            a, b = root(comp[i]), root(comp[k])
            if a != b and linked(items[i], items[k], percent):
                top[max(a, b)] = min(a, b)
                out.append((g["node"][i], g["node"][k]))
    return out


def near_rows(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """doc_id, h (a code of the text), n_shingles, component_id and component of each row of docs (doc_id long, text).

    component tells groups apart that have one smallest doc_id by different texts; it is null for rows that are linked with nothing."""
    margin = None if exact else MARGIN
    known = staged(sketches(docs, shingle), "sketches")
    shaped = known.where("doc_id is not null and n_shingles > 0")
    # The row whose text stands for the node, and how many rows are equal to it.
    same = shaped.groupBy("digest", "doc_id", "h").agg(F.count("*").alias("rows"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    nodes = same.groupBy("digest").agg(F.min(F.struct("doc_id", "h", "rows")).alias("r"), F.sum("rows").alias("of_all"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "r.*", "of_all", "n", "regs"), "nodes")
    full = None
    if exact:
        full = staged(_sets(docs, nodes, shingle), "full")
    bands = _prefixes(full, percent) if exact else _bands(nodes)
    shared = bands.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("c")).where("c > 1")
    members = staged(bands.join(shared, "key").select("key", "node", "center", "c"), "members")
    if not exact:
        full = staged(_sets(docs, nodes.join(members.select("node").distinct().hint("shuffle_hash"), "node", "left_semi"), shingle), "full")
    star = staged(_verify(members.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct(), full, percent, margin), "star")
    first = staged(components(star), "first").withColumnRenamed("id", "node")
    left = members.where("c > 2 and node <> center").join(first, "node", "left").join(full.select("node", "n"), "node").select("key", "node", F.coalesce("component", "node").alias("component"), "n")
    links = star.unionByName(_blocks(staged(left, "left"), full, percent, margin))
    of_node = nodes.join(components(links).withColumnRenamed("id", "node"), "node", "left").select("digest", "doc_id", "of_all", F.coalesce("component", "node").alias("component"))
    of_node = staged(of_node, "of_node")
    least = of_node.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_digest = staged(of_node.join(least, "component").select("digest", "of_all", "component_id", "component"), "of_digest")
    # Digests of many rows, at most 1 / HOT of them, are met by broadcast, so that their rows aren't all sent to one task.
    many = f"of_all > {HOT} * {known.count()}"
    names = ["doc_id", "h", "n_shingles", "component_id", "component"]
    by_hot = shaped.select("doc_id", "h", "n_shingles", "digest").join(F.broadcast(of_digest.where(many).select("digest", "component_id", "component")), "digest", "left")
    others = by_hot.where("component is null").drop("component_id", "component").join(of_digest.where(f"not ({many})"), "digest")
    alone = known.where("doc_id is null or n_shingles = 0").select("doc_id", "h", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return others.select(*names).unionByName(by_hot.where("component is not null").select(*names)).unionByName(alone)


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs (doc_id long, text).

    A document without words is linked with nothing. A null doc_id is linked with nothing, its component is null and it is kept.
    Rows of one doc_id are linked as their texts are, each by itself. An empty table gives an empty result. Extra columns are left
    out. exact=True misses no link; without it a pair at the threshold is missed with a chance of about 2e-7 by the bands and less by
    the estimate."""
    rows = near_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), shingle, percent, exact)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=4)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near texts, that of the smallest doc_id, with its own columns; shingles are of five words.

    Rows are told apart by doc_id and text, so different texts of one doc_id stand or fall each by itself; of a doc_id's texts in one
    group the one with the smallest code stays, of rows equal in both the smallest in the order of their columns, maps aside. Rows of
    null doc_id, and rows without words, all stay."""
    ordered = F.struct(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind], row_key(docs))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), ordered.alias("k"))
    found = near_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).where("doc_id is not null and n_shingles > 0")
    texts = staged(found.groupBy("component", F.col("doc_id").alias("id"), "h").agg(F.count("*").alias("rows")), "texts")
    first = texts.groupBy("component").agg(F.min(F.struct("id", "h", "rows")).alias("s")).select("s.*")
    dropped = texts.select("id", "h").join(first.select("id", "h").hint("shuffle_hash"), ["id", "h"], "left_anti")
    alike = first.where("rows > 1").select("id", "h")
    out = dropped.withColumn("alike", F.lit(False)).unionByName(alike.withColumn("alike", F.lit(True)))
    out = staged(out, "dropped")
    stay = keyed.join(out.select("id", "h").hint("shuffle_hash"), ["id", "h"], "left_anti").select("row")
    again = keyed.join(out.where("alike").select("id", "h").hint("shuffle_hash"), ["id", "h"], "left_semi").groupBy("id", "h").agg(F.min_by("row", "k").alias("row"))
    return stay.unionByName(again.select("row")).select("row.*")
