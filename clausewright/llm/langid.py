"""Language identification by prediction by partial matching.

Each language is a tree of byte contexts of 0 to ORDER bytes with symbol counts; a byte's code length is that of the longest
context known, or its escape and the next shorter one's, down to 8 bits (escape method C, no exclusions). The statistics are
frozen after training, so every code length is worked out once, for all languages at a time; scoring looks up each position's
bytes and adds. Training takes about SAMPLE_BYTES of text a language, and TOTAL_BYTES of all together, dealt evenly: documented bounds
on a classifier's training rows, so the model is bounded too, and nothing of it is cut. All of each text is scored."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.common import read, staged

#: Longest context, in bytes; at most 3, as four bytes are one number.
ORDER = 3
#: Bytes of training text a language, on average; whole documents are drawn by a hash of their ids.
SAMPLE_BYTES = 4_000_000
#: Bytes of training text of all languages together: with more than a dozen of them each has a smaller sample.
TOTAL_BYTES = 48_000_000
#: A language's share of this many bins, drawn by hash.
BINS = 1_000_000
#: Languages whose sizes are broadcast; more are joined by a shuffle.
LANGS = 100_000
#: Groups of a language's training text that are counted apart and then added up.
PARTS = 16

_PAD = b"\n" * ORDER


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """The k bytes that end at each position from ORDER on, as one number."""
    n = len(data) - ORDER
    out = np.zeros(n, np.uint32)
    for j in range(k):
        out |= data[ORDER - j : ORDER - j + n].astype(np.uint32) << np.uint32(8 * j)
    return out


def count_grams(texts: list[str]) -> pd.DataFrame:
    """order, gram, n: how often each context of `order` bytes and its symbol occur; a text begins after ORDER line ends."""
    held = []
    for t in texts:
        data = np.frombuffer(_PAD + t.encode("utf-8", "surrogatepass"), np.uint8)
        held.append(_grams(data, ORDER + 1))
    full = np.concatenate(held) if held else np.zeros(0, np.uint32)
    keys, counts = np.unique(full, return_counts=True)
    out = []
    for k in range(ORDER, -1, -1):
        if k < ORDER:
            keys, at = np.unique(keys & np.uint32((1 << (8 * (k + 1))) - 1), return_inverse=True)
            counts = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
        out.append(pd.DataFrame({"order": k, "gram": keys.astype(np.int64), "n": counts}))
    return pd.concat(out)


class Lookup:
    """Places of uint32 keys in an open-addressing table."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros(1 << self.bits, np.uint32)
        todo = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(todo):
            free = self.at[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            won = np.flatnonzero(free)[first]
            self.at[slot[won]], self.keys[slot[won]] = todo[won], keys[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, slot = todo[rest], (slot[rest] + 1) & (len(self.at) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that aren't there."""
        slot = self._slot(keys)
        got = self.at[slot]
        wrong = np.flatnonzero((got >= 0) & (self.keys[slot] != keys))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & (len(self.at) - 1)
            got[wrong] = self.at[slot]
            more = (got[wrong] >= 0) & (self.keys[slot] != keys[wrong])
            wrong, slot = wrong[more], slot[more]
        return got


class Model:
    """Frozen code lengths. counts: lang, order, gram, n."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        self.grams: list[Lookup] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[Lookup] = []
        self.escape: list[np.ndarray] = []
        place = {x: i for i, x in enumerate(self.langs)}
        n_langs = len(self.langs)
        if not n_langs:
            return
        for k in range(ORDER + 1):
            own = counts[counts["order"] == k]
            gram = own["gram"].to_numpy().astype(np.uint32)
            lang = own["lang"].map(place).to_numpy()
            n = own["n"].to_numpy().astype(float)
            contexts, c_at = np.unique(gram >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), n_langs)), np.zeros((len(contexts), n_langs))
            np.add.at(total, (c_at, lang), n)
            np.add.at(kinds, (c_at, lang), 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
            keys, g_at = np.unique(gram, return_inverse=True)
            key_context = np.searchsorted(contexts, keys >> np.uint32(8))
            shorter = self.bits[k - 1][self.grams[k - 1](keys & np.uint32((1 << (8 * k)) - 1))] if k else np.full((len(keys), n_langs), 8.0)
            bits = escape[key_context] + shorter
            bits[g_at, lang] = -np.log2(n / (total + kinds)[c_at, lang])
            self.grams.append(Lookup(keys))
            self.bits.append(bits.astype(np.float32))
            self.contexts.append(Lookup(contexts))
            self.escape.append(escape.astype(np.float32))

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        most = max(1 << 14, (1 << 23) // max(1, len(self.langs)) // 4)
        run, held = [], 0
        for i, b in enumerate(raw):
            run.append(i)
            held += len(b) + ORDER
            if held >= most or i == len(raw) - 1:
                self._add(np.frombuffer(b"".join(_PAD + raw[j] for j in run), np.uint8), np.cumsum([len(raw[j]) + ORDER for j in run]), np.array(run), out, most)
                run, held = [], 0
        return out

    def _add(self, data: np.ndarray, ends: np.ndarray, rows: np.ndarray, out: np.ndarray, most: int) -> None:
        starts = np.concatenate([[0], ends[:-1]])
        for a in range(ORDER, len(data), most):
            b = min(len(data), a + most)
            bits = self._position_bits(data[a - ORDER : b])
            first = np.clip(np.maximum(starts + ORDER, a) - a, 0, b - a)
            last = np.clip(ends - a, 0, b - a)
            full = np.flatnonzero(last > first)
            if len(full):
                edges = np.stack([first[full], last[full]], 1).ravel()
                if edges[-1] == b - a:
                    edges = edges[:-1]
                out[rows[full]] += np.add.reduceat(bits, edges, axis=0, dtype=np.float64)[::2]

    def _position_bits(self, data: np.ndarray) -> np.ndarray:
        gram = _grams(data, ORDER + 1)
        at = self.grams[ORDER](gram)
        bits = self.bits[ORDER][at]
        missed = np.flatnonzero(at < 0)
        if len(missed):
            bits[missed] = self._shorter(gram[missed])
        return bits

    def _shorter(self, gram: np.ndarray) -> np.ndarray:
        out = np.zeros((len(gram), len(self.langs)), np.float32)
        open_ = np.arange(len(gram))
        for k in range(ORDER, -1, -1):
            key = gram[open_] & np.uint32(0xFFFFFFFF >> (8 * (3 - k)))
            at = self.grams[k](key)
            hit = at >= 0
            out[open_[hit]] += self.bits[k][at[hit]]
            open_, key = open_[~hit], key[~hit]
            c = self.contexts[k](key >> np.uint32(8))
            known = c >= 0
            out[open_[known]] += self.escape[k][c[known]]
        out[open_] += 8.0
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of least bits and its posterior under equal priors; `und` and 0 without a letter or without languages."""
        known = [i for i, t in enumerate(texts) if self.langs and t and any(map(str.isalpha, t))]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if known:
            bits = self.lengths([texts[i] for i in known])
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
            for i, j, s in zip(known, best.tolist(), share.tolist()):
                langs[i], scores[i] = self.langs[j], s
        return langs, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """lang, order, gram, n from labelled rows doc_id, text, lang. Each language has its own share of rows, drawn by a hash of doc_id and text, so that it has about sample_bytes, or its even part of TOTAL_BYTES if that is less; so what reaches the driver is bounded, whatever the table's size and the number of languages."""
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = usable.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    # Two values a language; a shuffled join, for too many of them, would send every text to its language's task before the draw.
    sizes = staged(sizes, "sizes")
    n_langs = sizes.count()
    few, share = n_langs <= LANGS, min(float(sample_bytes), TOTAL_BYTES / max(1, n_langs))
    keep = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(BINS)) < F.ceil(F.lit(share * BINS) / F.greatest(F.col("bytes"), F.lit(1)))
    drawn = usable.join(F.broadcast(sizes) if few else sizes, "lang").where(keep).select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(PARTS)).alias("part"))
    counted = drawn.groupBy("lang", "part").applyInPandas(
        lambda pdf: count_grams(pdf["text"].tolist()).assign(lang=pdf["lang"].iloc[0])[["lang", "order", "gram", "n"]],
        "lang string, order int, gram long, n long",
    )
    return counted.groupBy("lang", "order", "gram").agg(F.sum("n").alias("n")).toPandas()


#: The model that a worker process has at hand.
_built: dict[str, Model] = {}


def identify(docs: DataFrame, counts: pd.DataFrame) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text). Null texts and texts without a letter are `und`; ties go to the smaller name; null and repeated doc_ids stay."""
    import pyarrow as pa

    sent, key = docs.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        if key not in _built:
            _built.clear()
            _built[key] = Model(sent.value)
        model = _built[key]
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                langs, scores = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from those not held out, as train() and identify() say. A null doc_id isn't held out; rows with a null text or lang aren't learnt from; without any every document is `und`."""
    docs = read(spark, sf_dir, "documents")
    counts = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = identify(docs, counts)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
