"""Importance resampling towards a target: documents drawn by how much their hashed word runs are like the target's.

Buckets of word runs are CRC-32 values modulo BUCKETS. A CRC is affine over the bits of its text, so the CRC of a span of bytes is
the XOR of what each byte gives by its distance from the span's end, read from a table, and of a constant of the span's length. All
spans of a block of texts are worked on together: the table's entries of their bytes, one span after the other, are reduced by
bitwise_xor.reduceat. A span longer than the table is cut into blocks, which are folded one after the other.

The texts are read twice, once for the counts of all buckets (a fixed number of rows for each task) and once for the weights; only a
few numbers for each document are written. The draw sorts by ranges and adds up the ranges before, so no task ranks all documents."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.common import prefix_sums, read, staged

BUCKETS, WORDS, LEAST_WORDS, DRAWN_PERCENT, SEED = 10_000, 3, 20, 5, "42"
#: Distances of the table, bytes of text worked on together, and bytes of spans reduced at a time.
DEPTH, RUN, SPANS = 128, 1 << 18, 1 << 20
_FULL = np.uint32(0xFFFFFFFF)
#: Reversed polynomial of CRC-32.
_POLYNOMIAL = np.uint32(0xEDB88320)


def _position_table() -> np.ndarray:
    """[distance, byte]: what a byte that many bytes before the end gives to the register."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> np.uint32(1)) ^ _POLYNOMIAL, one >> np.uint32(1))
    out = np.empty((DEPTH, 256), np.uint32)
    out[0] = one
    for d in range(1, DEPTH):
        out[d] = (out[d - 1] >> np.uint32(8)) ^ one[out[d - 1] & np.uint32(255)]
    return out


def _length_constants() -> np.ndarray:
    """[length]: the CRC of so many zero bytes, that is what the register's start and end give."""
    out = np.zeros(DEPTH + 1, np.uint32)
    for n in range(1, DEPTH + 1):
        start = _FULL ^ out[n - 1]
        out[n] = ((start >> np.uint32(8)) ^ TABLE[0][start & np.uint32(255)]) ^ _FULL
    return out


TABLE = _position_table()
CONSTANTS = _length_constants()
#: A-Z to a-z, bytes outside words to spaces. Words are runs of 0-9, letters and all bytes above 127.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _linear(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The XOR of the table's entries over each span; no span is empty or longer than DEPTH."""
    out, lengths = np.empty(len(starts), np.uint32), ends - starts
    upto = np.cumsum(lengths)
    a = 0
    while a < len(starts):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + SPANS, "right")))
        n = lengths[a:b]
        first = upto[a:b] - n - done
        place = np.arange(upto[b - 1] - done) + np.repeat(starts[a:b] - first, n)
        entry = ((np.repeat(ends[a:b] - 1, n) - place) << 8) | raw[place]
        out[a:b] = np.bitwise_xor.reduceat(TABLE.ravel()[entry], first)
        a = b
    return out


def _past_block(register: np.ndarray) -> np.ndarray:
    """The register after DEPTH zero bytes."""
    r = register
    return TABLE[-1][r & np.uint32(255)] ^ TABLE[-2][(r >> np.uint32(8)) & np.uint32(255)] ^ TABLE[-3][(r >> np.uint32(16)) & np.uint32(255)] ^ TABLE[-4][r >> np.uint32(24)]


def crc_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes of each span [start, end) of raw, none empty."""
    lengths = ends - starts
    # A long span's first block is what is left over when the others are full.
    first = (lengths - 1) % DEPTH + 1
    short = lengths <= DEPTH
    register = _linear(raw, starts, starts + first) ^ CONSTANTS[first]
    if short.all():
        return register
    long = np.flatnonzero(~short)
    blocks = (lengths[long] - first[long]) // DEPTH
    begin = np.repeat(starts[long] + first[long], blocks) + DEPTH * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    each = _linear(raw, begin, begin + DEPTH)
    at, r = np.cumsum(blocks) - blocks, register[long] ^ _FULL
    for j in range(int(blocks.max())):
        on = np.flatnonzero(blocks > j)
        r[on] = _past_block(r[on]) ^ each[at[on] + j]
    register[long] = r ^ _FULL
    return register


def _pieces(b: bytes):
    """The cleaned text in pieces of about RUN bytes, each with the last words of the one before, and how many these are."""
    clean, at, held = b.translate(_CLEAN), 0, []
    while True:
        end = clean.find(b" ", at + RUN) if len(clean) - at > RUN else -1
        piece = b" ".join([*held, clean[at : end if end >= 0 else len(clean)]])
        yield piece, len(held)
        if end < 0:
            return
        held, at = piece.rsplit(None, WORDS - 1)[-(WORDS - 1) :], end


def features(texts: list[bytes | None]):
    """Blocks of (text's place, words in the run, CRC of the run) over all runs of 1 to WORDS words of all texts."""
    run, held = [], 0
    for i, b in enumerate(texts):
        for piece, again in _pieces(b or b""):
            run.append((i, piece, again))
            held += len(piece) + 1
            if held >= RUN:
                yield from _features(run)
                run, held = [], 0
    yield from _features(run)


def _features(run: list[tuple[int, bytes, int]]):
    raw = np.frombuffer(b" ".join(p for _, p, _ in run) + b" ", np.uint8)
    word = raw != 32
    begins = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    n_words = np.diff(np.searchsorted(begins, np.cumsum([0, *(len(p) + 1 for _, p, _ in run)])))
    if not len(begins):
        return
    # Words with one space behind each.
    plain = raw[word | np.concatenate([[False], word[:-1]])]
    ends = np.flatnonzero(plain == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    piece = np.repeat(np.arange(len(run)), n_words)
    place = np.arange(len(ends)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    text, again = np.array([i for i, _, _ in run]), np.array([a for _, _, a in run])
    for n in range(1, WORDS + 1):
        last = slice(n - 1, None)
        fine = (place[last] >= n - 1) & (place[last] >= again[piece[last]])
        yield text[piece[last][fine]], n, crc_spans(plain, starts[: max(0, len(starts) - n + 1)][fine], ends[last][fine])


def _binary(df: DataFrame, text: str) -> F.Column:
    return F.col(f"`{text}`").cast("string").cast("binary").alias("text")


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many word runs of all texts fall into each bucket."""
    import pyarrow as pa

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                for _, _, crc in features(batch.column(0).slice(a, 256).to_pylist()):
                    counts += np.bincount(crc % np.uint32(BUCKETS), minlength=BUCKETS)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select(_binary(docs, text)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths: floor of 1000 times the logarithm of its smoothed shares' quotient."""
    s, t = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(b + 1) * float(s + BUCKETS)) / (float(a + 1) * float(t + BUCKETS)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of docs."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                words, runs, weight = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                for i, n, crc in features(part.column(1).to_pylist()):
                    count = np.bincount(i, minlength=part.num_rows)
                    words += count * (n == 1)
                    runs += count
                    # Sums of whole numbers far below 2^53, so exact.
                    weight += np.bincount(i, gain[crc % np.uint32(BUCKETS)], part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(runs), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _binary(docs, text)).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs (doc_id, text); rank is null for what isn't drawn.

    Drawn are the floor(percent * N / 100) highest scores among the N documents of at least least_words words, ties to smaller
    doc_ids, then fewer features, then smaller weights; rows equal in all of these are alike. Null texts have no features and weight
    0. A row without doc_id has no random number: its score is null, it isn't drawn and not one of the N. Repeated rows are
    documents of their own. Empty tables count nothing and give an empty result or draw; other columns are left out."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = staged(weights(docs, gain, text).withColumn("score", F.col("weight") + noise), "weights")
    fit = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    drawn = percent * rows.where(fit).count() // 100
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = prefix_sums(rows.where(fit), order, {"before": F.lit(1)}).withColumn("before", F.col("before").cast("long"))
    ranked = placed.withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1)).drop("before")
    return ranked.unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighted and drawn towards the texts of `benchmark`, as resampled() says with its defaults."""
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
