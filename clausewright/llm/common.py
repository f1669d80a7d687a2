"""What several training-data operators share."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that ends a word: space and the controls 9 to 13. Words are runs of anything else.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text whose words are coded at a time.
RUN = 4 << 20
_powers: dict[str, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which every executor of a cluster can reach."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        top = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(top)
    return f"{str(top).rstrip('/')}/clausewright-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "t") -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame) -> Column:
    """Two independent 64-bit hashes of all columns of a row, never null: equal for rows that are equal in everything."""
    odd = lambda kind: "map<" in kind or "variant" in kind
    plain = [F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) if odd(kind) else F.col(f"`{c}`") for c, kind in df.dtypes]
    empty = [F.isnull(F.col(f"`{c}`")) for c in df.columns]
    return F.struct(F.xxhash64(F.lit(1), *plain, *empty).alias("a"), F.xxhash64(F.lit("second"), *plain, *empty).alias("b"))


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each of `sums`, the sum over the rows before it in that order. The order is range-partitioned and written; a task sums up its own range, and one row a range comes to the driver."""
    ranged = df.select("*", *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(sums.values())])
    ranged = ranged.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id())
    ranged = staged(ranged, "ranged")
    before, at = {}, [0.0] * len(sums)
    for r in ranged.groupBy("_range").agg(*[F.sum(f"_v{i}") for i in range(len(sums))]).orderBy("_range").collect():
        before[r[0]] = at
        at = [a + (b or 0.0) for a, b in zip(at, r[1:])]
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v[i])]), F.col("_range")) if before else F.lit(0.0)
    return ranged.select(*df.columns, *[(start(i) + F.coalesce(F.sum(f"_v{i}").over(own), F.lit(0.0))).alias(name) for i, name in enumerate(sums)])


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, so that nearby values part."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words of all texts, A-Z lower-cased, one text after the other, and how many words each text has.

    A word's code depends on its bytes alone. Texts are worked on in runs of about 4 MB, long ones cut between words, so memory
    follows the longest word, not the longest text."""
    codes, counts, run, held = [], np.zeros(len(texts), np.int64), [], 0

    def work() -> None:
        got, n = _codes_of([b for _, b in run])
        codes.append(got)
        np.add.at(counts, [i for i, _ in run], n)
        run.clear()

    for i, text in enumerate(texts):
        for b in _cut((text or "").encode("utf-8", "surrogatepass")):
            run.append((i, b))
            held += len(b) + 1
            if held >= RUN:
                work()
                held = 0
    if run:
        work()
    return (np.concatenate(codes) if codes else np.zeros(0, np.uint64)), counts


def _cut(b: bytes):
    at = 0
    while len(b) - at > RUN:
        m = _SPACE.search(b, at + RUN)
        if m is None:
            break
        yield b[at : m.start()]
        at = m.start()
    yield b[at:]


def _codes_of(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(raw) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    terms = _BYTE_CODES[_LOWER[raw]]
    terms *= up[: len(raw)]
    np.cumsum(terms, out=sums[1:])
    codes = (sums[ends] - sums[starts]) * down[starts]
    codes = mix64(codes + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(b) + 1 for b in run])
    upto = np.searchsorted(starts, bounds)
    return codes, np.diff(np.concatenate([[0], upto]))
