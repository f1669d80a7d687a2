"""Mixing sources to target weights by the cube method.

Each source takes target / size of its words: every document goes in whole floor(rate) times, and once more with the rest as
inclusion probability. The flight phase moves these probabilities through the null space of two constraints, the number of
documents and of words, until each is 0 or 1; the landing goes through all ways for the few that are left, at most RESERVE + 2 a
source: among the ways whose words come within SLACK of the sum due, or the nearest way if none does, one is drawn with weights
that keep each document's inclusion probability as well as these ways allow.

Flights run on groups of at most about GROUP documents of a source, so a hot source is many groups; what each leaves (two
documents and its reserve of RESERVE, drawn from all sizes) meets in flights of the next level. A source of one group has nothing
to fly there, so it lands with the same documents however large the largest source is. Only keys, sources and sizes are shuffled
for the draw; whatever the keys are, they pass through it as they came."""

from __future__ import annotations

import math
import random
import zlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.llm.common import prefix_sums, read, row_key, staged

#: Weights that the sources get in turn, in the order of their names; null comes last.
WEIGHTS = (1.0, 2.0, 3.0)
#: Times a document may be taken at most.
MOST = 3
#: Documents in a flight, on average.
GROUP = 4096
#: Leftover groups that meet in one flight of the next level.
FAN = 1024
#: Documents of each group kept for the next level or the landing, besides the two that a flight leaves.
RESERVE = 12
#: Equal rows that one task numbers or repeats.
CHUNK = 4096
#: Share of a source's target by which the words of the ways to choose from may miss the sum due.
SLACK = 0.0005
SEED = 7

_SPACES = "\t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of runs of other characters than space and the controls 9 to 13; 0 for null."""
    one = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(" ")), _SPACES, F.coalesce(text, F.lit("")))
    return F.size(F.array_remove(F.split(one, " "), "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """source, source_size, n_docs, target: `share` of all words dealt by weight, no target above `most` times its source's size.

    What a capped source can't take is dealt again by weight: the sources in order of cap by weight fill up one after the
    other, so the capped ones are a prefix of that order and sums of that prefix find them. One row a source, null being a source;
    both orders are range-partitioned, so no task has all sources."""
    totals = staged(sizes.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"), F.count("*").alias("n_docs")), "totals")
    placed = prefix_sums(totals, [F.col("source").asc_nulls_last()], {"place": F.lit(1.0)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    caps = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    words, weight_of_all = caps.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight_of_all = (words or 0.0) * share, weight_of_all or 0.0
    filled = prefix_sums(caps, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], {"filled": F.col("cap"), "gone": F.col("weight")})
    level = (F.lit(total) - F.col("filled")) / (F.lit(weight_of_all) - F.col("gone"))
    found = filled.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    dealt = found.where("open").agg(F.min(F.struct(F.col("cap") / F.col("weight"), "level"))["level"]).first()[0]
    target = F.col("cap") if dealt is None else F.least(F.col("cap"), F.lit(dealt) * F.col("weight"))
    return found.select("source", F.col("source_size").cast("long").alias("source_size"), "n_docs", target.alias("target"))


def flight(sizes: list[int], chances: list[float], rng: random.Random) -> list[float]:
    """The chances after the flight: all but two of them 0 or 1, with the same sum and the same sum times sizes."""
    eps = 1e-9
    pi = list(chances)
    pool: list[int] = []
    for k in range(len(pi)):
        if not eps < pi[k] < 1 - eps:
            pi[k] = float(round(pi[k]))
            continue
        pool.append(k)
        while len(pool) == 3:
            a, b, c = (sizes[i] for i in pool)
            u = (b - c, c - a, a - b) if not a == b == c else (1, -1, 0)
            _move(pi, pool, u, rng, eps)
    return pi


def _move(pi: list[float], pool: list[int], u: tuple, rng: random.Random, eps: float) -> None:
    """One step along u to a face of the cube, up or down with the chances that keep each expectation; drops what has landed from pool."""
    up = min((((1 - pi[i]) / d) if d > 0 else (pi[i] / -d)) for i, d in zip(pool, u) if d)
    down = min(((pi[i] / d) if d > 0 else ((1 - pi[i]) / -d)) for i, d in zip(pool, u) if d)
    step = up if rng.random() * (up + down) < down else -down
    for i, d in zip(pool, u):
        pi[i] += step * d
        if pi[i] < eps or pi[i] > 1 - eps:
            pi[i] = float(round(pi[i]))
    pool[:] = [i for i in pool if eps < pi[i] < 1 - eps]


def landing(sizes: list[int], chances: list[float], rng: random.Random, slack: float = 0.0) -> list[float]:
    """The few chances left, made 0 or 1: of all ways those whose words come within slack of the sum due, or else the nearest; one of them is drawn."""
    left = [i for i, p in enumerate(chances) if 1e-9 < p < 1 - 1e-9]
    if not left:
        return chances
    ways = ((np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1).astype(float)
    size, pi = np.array([sizes[i] for i in left], float), np.array([chances[i] for i in left])
    off, count = np.round(np.abs(ways @ size - pi @ size), 6), np.abs(ways.sum(1) - pi.sum())
    near = off <= max(off.min(), slack)
    if off.min() >= slack:
        near &= count <= count[near].min() + 1e-9
    ways = ways[near]
    best = ways[rng.choices(range(len(ways)), _weights(ways, pi))[0]]
    out = list(chances)
    for i, x in zip(left, best.tolist()):
        out[i] = float(x)
    return out


def _weights(ways: np.ndarray, pi: np.ndarray) -> list[float]:
    """Of the chances of the ways that give each document its own, or come near where none can, those of the largest entropy, by Newton's method."""
    at = np.zeros(len(pi))
    for _ in range(40):
        p = np.exp(ways @ at - (ways @ at).max())
        p /= p.sum()
        mean = p @ ways
        spread = (ways * p[:, None]).T @ ways - np.outer(mean, mean) + 1e-3 * np.eye(len(pi))
        at += np.clip(np.linalg.solve(spread, pi - mean - 1e-3 * at), -1, 1)
    return p.tolist()


def held_flight(sizes: list[int], chances: list[float], rng: random.Random) -> list[float]:
    """A flight that RESERVE documents stay out of, one drawn from each of as many runs of sizes, so that the landing has small and large ones to choose from, in whichever level it is."""
    free = [i for i, p in enumerate(chances) if 1e-9 < p < 1 - 1e-9]
    cuts = [round(j * len(free) / RESERVE) for j in range(RESERVE + 1)]
    held = {free[rng.randrange(a, b)] for a, b in zip(cuts, cuts[1:]) if b > a}
    going = [i for i in range(len(chances)) if i not in held]
    out = list(chances)
    for i, p in zip(going, flight([sizes[i] for i in going], [chances[i] for i in going], rng)):
        out[i] = p
    return out


def fly_and_land(sizes: list[int], chances: list[float], rng: random.Random, slack: float = 0.0) -> list[float]:
    """The last flight of a source."""
    return landing(sizes, held_flight(sizes, chances, rng), rng, slack)


def _fly(units: DataFrame, group: Column, level: int, last: bool) -> DataFrame:
    """chance moved within each (source, group). Of a unit only size, order and chance are read; all else goes on as it is."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        size, order, chance = (table.column(c).to_numpy() for c in ("size", "order", "chance"))
        place = np.lexsort((order, -size))
        name = table.column("source")[0].as_py()
        rng = random.Random(zlib.crc32(f"{SEED}/{level}/{name!r}/{table.column('g')[0].as_py()}".encode()))
        sizes, chances = size[place].tolist(), chance[place].tolist()
        moved = np.empty(len(place))
        moved[place] = fly_and_land(sizes, chances, rng, SLACK * table.column("target")[0].as_py()) if last else held_flight(sizes, chances, rng)
        return table.set_column(table.column_names.index("chance"), "chance", pa.array(moved)).select(names)

    names = units.columns
    return units.withColumn("g", group.cast("long")).groupBy("source", "g").applyInArrow(run, units.schema)


def repeated(rows: DataFrame, times: Column, number: str) -> DataFrame:
    """Each row as often as it says, numbered from 0. A row that comes more than CHUNK times is dealt to tasks in chunks, so no task or array holds all of one row's repeats."""
    counted = rows.withColumn("_times", times.cast("long")).where("_times > 0")
    few = counted.where(F.col("_times") <= CHUNK).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    chunks = counted.where(F.col("_times") > CHUNK).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / CHUNK))))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(n, "_chunk").withColumn(number, F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least(F.col("_times"), (F.col("_chunk") + 1) * CHUNK) - 1)))
    return few.drop("_times").unionByName(dealt.drop("_times", "_chunk"))


def mix(sizes: DataFrame, keys: tuple[str, ...] = ("doc_id",), weights: tuple[float, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """The columns `keys`, then source, size, source_size, target, copies and taken, for each row of sizes (keys, source, size).

    Rows are units: repeated rows are drawn one by one, null keys and sources are like any other, a null size is 0, documents of no words are
    never taken, an empty table gives an empty one. Other columns are left out, so their names can't clash; keys may be of any
    type that can be grouped and come back as they were. The draw depends on keys, sources and sizes alone, not on the order of rows
    or partitions. Rows that are equal in all three are counted and then numbered, so they are spread over as many flights as others."""
    sizes = sizes.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("key"), "source", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    sizes = staged(repeated(sizes.groupBy("key", "source", "size").agg(F.count("*").alias("n")), F.col("n"), "i").drop("n"), "numbered")
    targets = staged(source_targets(sizes, weights, most, share), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        sizes.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select("s.*", "source_size", "n_docs", "target")
        .withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
        .withColumn("whole", F.floor(F.col("rate") + 1e-12).cast("long"))
        .withColumn("chance", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
        .withColumn("order", F.when(F.col("i") == 0, F.xxhash64("key", "size")).otherwise(F.xxhash64("key", "size", "i")))
        .withColumn("bucket", F.pmod(F.col("order"), F.ceil(F.col("n_docs") / GROUP)))
        .drop("rate", "i")
    )
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    levels = 1 + (0 if most_docs <= GROUP else math.ceil(math.log(math.ceil(most_docs / GROUP), FAN)))
    settled, group = [], F.col("bucket")
    for level in range(levels):
        last = level == levels - 1
        flown = _fly(units, group, level, last)
        if last:
            settled.append(flown)
            break
        flown = staged(flown, f"flight{level}")
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        settled.append(flown.where(~open_))
        units, group = flown.where(open_), F.floor(group / FAN)
    copies = F.col("whole") + F.round("chance").cast("long")
    out = reduce(DataFrame.unionByName, settled).select("key", "source", "size", "source_size", "target", copies.alias("copies"))
    return out.select(*[F.col("key")[k].alias(k) for k in keys], "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, as mix() says with its defaults."""
    docs = read(spark, sf_dir, "documents")
    sizes = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return mix(sizes).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with its own columns.

    A row is known by two hashes of all its columns, so null and repeated doc_ids are no trouble; rows equal in everything are
    drawn one by one and come out as often as the draw says in all. Texts are shuffled once, when the decisions meet them."""
    columns = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), row_key(docs).alias("k"), F.col("source"), F.col("text"))
    drawn = mix(staged(keyed.select("k", "source", n_words(F.col("text")).alias("size")), "sizes"), ("k",))
    drawn = staged(drawn.groupBy("k").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"), "drawn")
    whole = keyed.select("row", "k")
    once = whole.join(drawn.where("rows = 1").hint("shuffle_hash"), "k")
    alike = whole.join(drawn.where("rows > 1").hint("shuffle_hash"), "k").groupBy("k").agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    return repeated(once.select("row", "copies").unionByName(alike.select("row", "copies")), F.col("copies"), "copy").select("row.*")
