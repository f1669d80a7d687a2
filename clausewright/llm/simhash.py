"""Near-duplicate documents by SimHash fingerprints, compared around the anchors of a covering code.

A fingerprint's bit tells whether more than half of the hashes of a document's shingles have it. The anchors are the 2^36 words of a
direct sum of perfect codes over the 64 bits: two Golay codes of 23 bits (covering radius 3), a Hamming code of 15 and one of 3 (radius
1 each). Every fingerprint is within radius 8 of one anchor, its home, and a perfect code has just one such word in each part. A
fingerprint near another one is within radius plus threshold of that one's home, no part further off than its own radius plus its
share of the threshold; so each is copied to all anchors that near, about 165, and compared with those whose home the anchor is.

Equal fingerprints are one row from the start. An anchor that is the home of many different fingerprints isn't compared pair by pair:
for the fingerprints around it every point of the space is an anchor (covering radius 0). Two of them at a distance of 2 or less
both lie within 1 of a common point, and all around one point are linked with the smallest, which is linear in their number."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.common import read, staged
from clausewright.llm.near_dup import components

SHINGLE, SEED, NEAR = 3, 42, 2
#: An anchor that is home to more fingerprints than this isn't compared pair by pair.
CROWD = 64
#: A fingerprint of more than this share of all rows is met by broadcast; there can't be more than 1 / HOT of them.
HOT = 0.001
#: Bytes of a text, and fingerprints, worked on at a time.
RUN, FEW = 4 << 20, 1024
#: The generator polynomial of the Golay code of 23 bits.
GOLAY = 0b110001110101


def _pieces(b: bytes):
    """b cut behind white space into pieces of about RUN bytes."""
    at = 0
    while len(b) - at > RUN:
        ends = [x for x in (b.find(s, at + RUN) for s in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) if x >= 0]
        if not ends:
            break
        yield b[at : min(ends)]
        at = min(ends)
    yield b[at:]


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of the text's shingles, repeats included, by XXH64; 0 without words. The text is UTF-8; A-Z are lower-cased."""
    from xxhash import xxh64_intdigest

    counts, n, held = np.zeros(64, np.int64), 0, []

    def add(hashes: list[int]) -> None:
        nonlocal n, counts
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(hashes)

    for piece in _pieces(text or b""):
        words = held + piece.lower().split()
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        for a in range(0, len(words) - shingle + 1, 65536):
            last = min(a + 65536, len(words) - shingle + 1)
            add([xxh64_intdigest(joined[i:j], seed) for i, j in zip(starts[a:last].tolist(), ends[a + shingle - 1 : last + shingle - 1].tolist())])
        held = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not n and held:
        add([xxh64_intdigest(b" ".join(held), seed)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a long) of each row of docs."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            fps = [fingerprint(batch.column(1)[i].as_py(), shingle) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Code:
    """A perfect binary code, given by its syndrome of each bit: for every syndrome, the differences to the words within radius + NEAR."""

    def __init__(self, columns: list[int], radius: int):
        self.columns, self.bits = columns, len(columns)
        found: list[list[tuple[int, int]]] = [[] for _ in range(NEAR + 1)]
        for weight in range(min(self.bits, radius + NEAR) + 1):
            for places in combinations(range(self.bits), weight):
                syndrome = 0
                for p in places:
                    syndrome ^= columns[p]
                found[max(0, weight - radius)].append((syndrome, sum(1 << p for p in places)))
        size = 1 << max(columns).bit_length()
        self.first, self.count, self.differences = [], [], []
        for rows in found:
            rows.sort()
            syndromes = np.array([s for s, _ in rows], np.int64)
            self.first.append(np.searchsorted(syndromes, np.arange(size)))
            self.count.append(np.bincount(syndromes, minlength=size))
            self.differences.append(np.array([d for _, d in rows], np.uint64))
        # Syndromes of the low and the high half of the bits.
        half = 1 << ((self.bits + 1) // 2)
        self.tables = [self._table(columns[: (self.bits + 1) // 2], half), self._table(columns[(self.bits + 1) // 2 :], half)]

    @staticmethod
    def _table(columns: list[int], size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        for bit, c in enumerate(columns):
            out[(np.arange(size) >> bit) & 1 == 1] ^= c
        return out

    def syndromes(self, x: np.ndarray) -> np.ndarray:
        low = (self.bits + 1) // 2
        return self.tables[0][(x & np.uint64((1 << low) - 1)).astype(np.int64)] ^ self.tables[1][(x >> np.uint64(low)).astype(np.int64)]


@cache
def codes() -> tuple[tuple[int, Code], ...]:
    """The parts of the covering code and the bit where each starts."""
    step, golay = 1, []
    for _ in range(23):
        golay.append(step)
        step <<= 1
        step ^= GOLAY * (step >> 11)
    golay_code = Code(golay, 3)
    return ((0, golay_code), (23, golay_code), (46, Code(list(range(1, 16)), 1)), (61, Code([1, 2, 3], 1)))


def anchors(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Which fingerprint (its place) is within each part's radius plus its share of `reach` of which anchor. With reach 0: its home."""
    ways = {0: (np.arange(len(fps)), fps.copy())}
    for start, code in codes():
        syndromes = code.syndromes((fps >> np.uint64(start)) & np.uint64((1 << code.bits) - 1))
        after: dict[int, list] = {}
        for used, (row, anchor) in ways.items():
            for more in range(reach - used + 1):
                s = syndromes[row]
                count = code.count[more][s]
                again = np.repeat(np.arange(len(row)), count)
                place = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count) + code.first[more][s[again]]
                after.setdefault(used + more, []).append((row[again], anchor[again] ^ (code.differences[more][place] << np.uint64(start))))
        ways = {used: tuple(map(np.concatenate, zip(*parts))) for used, parts in after.items()}
    return np.concatenate([r for r, _ in ways.values()]), np.concatenate([a for _, a in ways.values()])


def _mapped(fps: DataFrame, names: str, rows) -> DataFrame:
    """fps (fp) with the pairs that rows(fps as unsigned) gives for each: places and keys."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(fp), FEW):
                part = fp[a : a + FEW]
                place, key = rows(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[place])], names.split(", "))

    return fps.select("fp").mapInArrow(run, ", ".join(f"{x} long" for x in names.split(", ")))


def _around(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every point within 1 of each fingerprint."""
    steps = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    return np.repeat(np.arange(len(fps)), 65), (fps[:, None] ^ steps).ravel()


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: of distinct fingerprints fp, pairs within NEAR bits that join all that such pairs join."""
    home = _mapped(fps, "anchor, fp", lambda x: anchors(x, 0))
    copies = _mapped(fps, "anchor, fp", lambda x: anchors(x, NEAR))
    crowded = staged(home.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor"), "crowded")
    calm = home.join(crowded, "anchor", "left_anti").withColumnRenamed("fp", "b")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR) & (F.col("b") < F.col("a"))
    few = copies.withColumnRenamed("fp", "a").join(calm.hint("shuffle_hash"), "anchor").where(near).select("a", "b")
    if not crowded.count():
        return few
    inside = copies.join(crowded, "anchor", "left_semi").select("fp").distinct()
    points = _mapped(inside, "point, fp", _around).groupBy("point").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    many = points.select(F.explode("all").alias("a"), "b").where("a <> b").distinct()
    return few.unionByName(many)


def simhash_duplicates(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of docs (doc_id, text).

    Fingerprints link at NEAR or fewer differing bits and component_id is the smallest doc_id that links reach; every link is found.
    A null text is an empty one; without words the fingerprint is zero and links like any other. A row without doc_id is linked as its
    text is but names no component; where no row of a component has an id, component_id is null. Repeated rows stay rows of their
    own. An empty table gives an empty result; other columns are left out."""
    rows = staged(fingerprints(docs, text, shingle), "fingerprints")
    known = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "known")
    of = components(staged(links(known, crowd), "links")).withColumnRenamed("id", "fp")
    nodes = staged(known.join(of, "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component")), "nodes")
    named = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = staged(nodes.join(named, "component").select("fp", "n", "component_id"), "named")
    many = f"n > {HOT} * {rows.count()}"
    hot = F.broadcast(named.where(many).select("fp", "component_id", F.lit(True).alias("hot")))
    met = rows.join(hot, "fp", "left")
    rest = met.where("hot is null").drop("component_id", "hot").join(named.where(f"not ({many})").select("fp", "component_id"), "fp")
    both = met.where("hot").select("doc_id", "fp", "component_id").unionByName(rest.select("doc_id", "fp", "component_id"))
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents, as simhash_duplicates() says with its defaults."""
    return simhash_duplicates(read(spark, sf_dir, "documents"))
