"""Language-model scores from a trigram trie that is spread over the cluster.

Texts are cut into blocks of about BLOCK bytes, each with its own small vocabulary. A block sends its distinct words, then its
distinct contexts of two words with all that they go on with, to shards; a shard adds up the training counts of all blocks and builds an
Elias-Fano trie of its part (context words, monotone pointers, successors told relative to the shorter context from the third level on,
quantised probabilities and back-off weights). It answers each run that the blocks asked for by a search among its context's successors.
Nothing of the model is collected or broadcast: what moves is a block's distinct words and runs, once to the shards and once
back. Blocks lie in buckets on the shared folder, so they are read three times but never shuffled. A context of two words lies in one
shard with all its successors, so their counts add up to its own, and pairs need no messages besides. One of two words that each have a
large share of all tokens has only its sum there, and its successors are spread over all shards.

p(w | t u) = (c(t u w) + KAPPA p(w | u)) / (c(t u) + KAPPA), p(w | u) = (c(u w) + KAPPA p(w)) / (c(u) + KAPPA), p(w) = (c(w) + 1) / (N + V + 1).
A trie has the shares c(t u) / N and c(t u w) / N of pairs and triples, which blocks divide by their contexts', and KAPPA / (c + KAPPA)
as a pair's back-off weight. Words are told apart by 64-bit codes. All words are in the third level. A caller may restrict it to words that make at least
a share `third` of all training tokens each, and the beginning of a text: then c(t u w) is 0 for any other w, and how often such a context
goes on with them is added to KAPPA in the weight; a context that has another word has the weight 1.

The number of shards grows with the blocks, as a shard has to fit in memory, but the messages of a block don't: no sender parts what it
sends in more than 2^FAN_BITS. Where there are more shards, messages go by relays, one for each beginning of the shards' numbers and each
2^FAN_BITS senders or so: a relay adds up what they send, which comes to no more than a block, sends it on by the next bits of the
numbers, and parts the answer among them. So rows follow bytes, times the number of steps: one to 256 shards, two to 65,536, three to
16.7 million."""

from __future__ import annotations

import itertools
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.common import mix64, read, shared_folder, staged, tokens

#: Weight of the shorter context, in tokens.
KAPPA = 50.0
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 6 << 20
#: Least share of the training tokens of a word of the third level. 0: all words are, as in the query; a caller may ask for fewer.
THIRD = 0.0
#: A context of two words that each have more than this share of a shard's mean load is spread over all shards.
HOT = 0.25
#: What contexts go on with, besides words (2 * id, and 1 more where the context is spread; ids from 1): words that aren't in the third
#: level, and words that are told where they lie by themselves.
_OTHER, _APART = 0, 1
#: Shards, and from how many blocks a shard there are more of them.
SHARDS, EACH = 256, 2
#: Bits of a shard's number that a step of a message's way decides at most.
FAN_BITS = 8

_END = np.uint64(0xE0F)

_BLOCK_SCHEMA = "block long, doc_ids array<long>, n array<long>, held array<boolean>, words binary, local binary"
_WORD_SCHEMA = "shard int, block long, ids binary, counts binary"
_PART_SCHEMA = "shard int, block long, ids binary, counts binary, tokens long, kinds long"
_ASK_SCHEMA = "shard int, block long, first binary, second binary, each binary, words binary, counts binary"
_TOLD_SCHEMA = "block long, shard int, p binary, b binary, q binary"


def _zip(x: np.ndarray) -> bytes:
    """Compressed integers, byte planes apart; nothing below 0."""
    import zstandard

    width = 1 if not len(x) else max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unzip(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view("<i8").ravel()


def blocks(docs: DataFrame, training: Column) -> DataFrame:
    """One row for each block of docs (doc_id, text): its documents, its sorted vocabulary and its tokens as places in it."""
    import pyarrow as pa
    from pyspark import TaskContext

    def block(number: int, ids: list, texts: list, train: list) -> pa.RecordBatch:
        codes, n = tokens(texts)
        ends = np.cumsum(n)
        stream = np.insert(codes, ends, _END)
        words, local = np.unique(stream, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([(n + 1).tolist()], pa.list_(pa.int64())), pa.array([[not t for t in train]], pa.list_(pa.bool_())), pa.array([words.tobytes()], pa.binary()), pa.array([_zip(local)], pa.binary())],
            ["block", "doc_ids", "n", "held", "words", "local"],
        )

    def run(batches):
        number, size, held = TaskContext.get().partitionId() << 32, 0, ([], [], [])
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                for doc_id, text, train in zip(*(c.to_pylist() for c in batch.slice(i, 128).columns)):
                    for x, y in zip(held, (doc_id, text, train)):
                        x.append(y)
                    size += len(text or "")
                    if size >= BLOCK:
                        yield block(number, *held)
                        number, size, held = number + 1, 0, ([], [], [])
        if held[0]:
            yield block(number, *held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", training.alias("train")).mapInArrow(run, _BLOCK_SCHEMA)


def _batch(schema: str, rows: list[dict]):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields})


def _digits(n_shards: int) -> list[int]:
    """Bits of a shard's number that each step of the way decides, alike as far as they can be."""
    bits = n_shards.bit_length() - 1
    steps = max(1, -(-bits // FAN_BITS))
    return [bits // steps + (i < bits % steps) for i in range(steps)]


def _through(sent: DataFrame, n_shards: int, n_blocks: int, relay, shard, back, told_schema: str) -> tuple[DataFrame, DataFrame]:
    """What each sender of `sent` is told, and what the shards said. Messages (shard: the first bits of its number) go by relay(bits) at
    each step but the last, to `shard`, and answers return by back(bits)."""
    digits = _digits(n_shards)
    ends, room, steps, way = list(itertools.accumulate(digits)), sum(digits) + 2, [], sent
    for at, then in itertools.pairwise(ends):
        number = F.pmod(F.xxhash64("block"), F.lit(max(1, n_blocks >> at)).cast("long"))
        way = staged(way.withColumn("relay", F.shiftleft(number, room) + F.col("shard")), "sent")
        steps.append((way, then))
        way = way.groupBy("relay").applyInArrow(relay(then), sent.schema)
    said = told = staged(way.groupBy("shard").applyInArrow(shard, told_schema), "told")
    for way, then in reversed(steps):
        answers = told.where("block is not null").groupBy("block")
        told = staged(way.groupBy("relay").cogroup(answers).applyInArrow(back(then), told_schema), "told")
    return told, said


def _word_messages(sender: int, words: np.ndarray, counts: np.ndarray, bits: int):
    """Sorted words and their counts, a message for each beginning of so many bits, which names the shard."""
    to, at = np.unique(words >> np.uint64(64 - bits), return_index=True)
    for s, i, j in zip(to.tolist(), at, np.append(at[1:], len(words))):
        yield {"shard": s, "block": sender, "ids": words[i:j].tobytes(), "counts": _zip(counts[i:j])}


def _word_sums(d: dict):
    """The distinct words of many messages in order, their counts, where each message's words are among them and where it begins."""
    codes = [np.frombuffer(x, np.uint64) for x in d["ids"]]
    words, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([_unzip(x) for x in d["counts"]])).astype(np.int64)
    return words, total, at, np.cumsum([0, *map(len, codes)])


def _block_words(made: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], np.uint64)
                train = np.repeat(~np.array(row["held"], bool), row["n"])
                counts = np.bincount(_unzip(row["local"])[train], minlength=len(words))
                yield from _batch(_WORD_SCHEMA, list(_word_messages(row["block"], words, counts, bits))).to_batches()

    return made.select("block", "n", "held", "words", "local").mapInArrow(run, _WORD_SCHEMA)


def _add_words(made: DataFrame, n_shards: int, n_blocks: int) -> tuple[DataFrame, DataFrame]:
    """Each block's words as global ids with their training counts, and the shards' sums, in rows without block."""

    def shard(table):
        d = table.to_pydict()
        _, total, at, edges = _word_sums(d)
        # Frequent words have small ids, which take less room in messages.
        number, rank = d["shard"][0], np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        ids = rank[at] * n_shards + number
        rows = [{"shard": number, "block": k, "ids": _zip(ids[a:b]), "counts": _zip(total[at[a:b]])} for k, a, b in zip(d["block"], edges[:-1], edges[1:])]
        return _batch(_PART_SCHEMA, [*rows, {"shard": number, "tokens": int(total.sum()), "kinds": int((total > 0).sum())}])

    def relay(bits):
        def run(table):
            d = table.to_pydict()
            words, total, _, _ = _word_sums(d)
            return _batch(_WORD_SCHEMA, list(_word_messages(d["relay"][0], words, total, bits)))

        return run

    def back(bits):
        def run(own, answers):
            d, told = own.to_pydict(), answers.to_pydict()
            _, _, at, edges = _word_sums(d)
            order = sorted(range(len(told["shard"])), key=lambda i: told["shard"][i])
            ids, counts = (np.concatenate([_unzip(told[c][i]) for i in order])[at] for c in ("ids", "counts"))
            return _batch(_PART_SCHEMA, [{"shard": s, "block": k, "ids": _zip(ids[a:b]), "counts": _zip(counts[a:b])} for k, s, a, b in zip(d["block"], d["shard"], edges[:-1], edges[1:])])

        return run

    return _through(_block_words(made, _digits(n_shards)[0]), n_shards, n_blocks, relay, shard, back, _PART_SCHEMA)


def _distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first of each distinct (x, y) is, in their order, and which of them each is."""
    top = lambda z: int(z.max()).bit_length() if len(z) else 0
    if top(x) + top(y) > 63:
        x, y = (np.unique(z, return_inverse=True)[1].astype(np.int64) for z in (x, y))
    code = (x << top(y)) | y
    order = np.argsort(code)
    code = code[order]
    new = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _home(words: np.ndarray) -> np.ndarray:
    """Whether a run lies with its context, and not by itself."""
    return (words <= _APART) | (words & 1 == 0)


class _Dealt:
    """Distinct contexts of two words (ids from 1, 0 for none) in order, and the runs of contexts (places) and words that they go on with,
    in the order in which they are sent, by the first bits of their shards. A spread context's words lie by themselves."""

    def __init__(self, first: np.ndarray, second: np.ndarray, context: np.ndarray, words: np.ndarray, n_shards: int, bits: int):
        one = np.uint64(1)
        key = mix64(mix64((first.astype(np.uint64) - one) << one) + second.astype(np.uint64) - one)[context]
        home = _home(words)
        key[~home] = mix64(key[~home] + words[~home].astype(np.uint64))
        to = (key % np.uint64(n_shards)).astype(np.int64) >> (n_shards.bit_length() - 1 - bits)
        by_context = np.argsort(context, kind="stable")
        to = to[by_context]
        order = np.argsort(to.astype(np.uint16) if bits <= 16 else to, kind="stable")
        self.run_order, to = by_context[order], to[order]
        # An entry is a context in a message.
        context = context[self.run_order]
        entry = np.flatnonzero((np.diff(to, prepend=-1) != 0) | (np.diff(context, prepend=-1) != 0))
        self.context, self.each = context[entry], np.diff(np.append(entry, len(context)))
        self.home = np.logical_or.reduceat(home[self.run_order], entry)
        at = np.flatnonzero(np.diff(to[entry], prepend=-1))
        self.to, self.edges = to[entry][at], np.append(at, len(entry))
        self.run_edges = np.append(entry, len(context))[self.edges]
        self.first, self.second, self.words = first, second, words

    def messages(self, sender: int, counts: np.ndarray):
        first, second, words, counts = self.first[self.context], self.second[self.context], self.words[self.run_order], counts[self.run_order]
        for s, i, j, a, b in zip(self.to.tolist(), self.edges[:-1], self.edges[1:], self.run_edges[:-1], self.run_edges[1:]):
            yield {"shard": s, "block": sender, "first": _zip(np.diff(first[i:j], prepend=0)), "second": _zip(second[i:j]), "each": _zip(self.each[i:j]), "words": _zip(words[a:b]), "counts": _zip(counts[a:b])}

    def told(self, rows: dict) -> list[np.ndarray]:
        """What was said of the contexts where they lie, p and b, and of the runs, q, in their own order."""
        at = sorted((i for i, x in enumerate(rows["q"]) if x is not None), key=lambda i: rows["shard"][i])
        p, b, said = (np.concatenate([_unzip(rows[column][i]) for i in at]) for column in ("p", "b", "q"))
        out = [np.zeros(len(self.first), np.int64), np.zeros(len(self.first), np.int64), np.zeros(len(self.words), np.int64)]
        out[0][self.context[self.home]], out[1][self.context[self.home]], out[2][self.run_order] = p[self.home], b[self.home], said
        return out


class _Sums:
    """The distinct contexts of many messages in order, what each goes on with, and how often."""

    def __init__(self, d: dict):
        get = lambda name: [_unzip(x) for x in d[name]]
        first, second, words = [np.cumsum(x) for x in get("first")], get("second"), get("words")
        #: Where each message's contexts and runs begin, and which of the distinct ones each of them is.
        self.edges, self.run_edges = (np.cumsum([0, *map(len, x)]) for x in (second, words))
        first, second, words = map(np.concatenate, (first, second, words))
        at, self.place = _distinct(first, second)
        self.first, self.second = first[at], second[at]
        context = np.repeat(self.place, np.concatenate(get("each")))
        at, self.run_place = _distinct(context, words)
        self.context, self.words = context[at], words[at]
        self.total = np.bincount(self.run_place, weights=np.concatenate(get("counts"))).astype(np.int64)

    def answers(self, d: dict, p: np.ndarray, b: np.ndarray, q: np.ndarray):
        p, b, q = p[self.place], b[self.place], q[self.run_place]
        edges = zip(d["block"], d["shard"], self.edges[:-1], self.edges[1:], self.run_edges[:-1], self.run_edges[1:])
        return _batch(_TOLD_SCHEMA, [{"block": k, "shard": s, "p": _zip(p[i:j]), "b": _zip(b[i:j]), "q": _zip(q[x:y])} for k, s, i, j, x, y in edges])


def _run_relays(n_shards: int):
    """Relays of runs and their way back."""

    def added(table, bits):
        d = table.to_pydict()
        sums = _Sums(d)
        return d, sums, _Dealt(sums.first, sums.second, sums.context, sums.words, n_shards, bits)

    def relay(bits):
        def run(table):
            d, sums, dealt = added(table, bits)
            return _batch(_ASK_SCHEMA, list(dealt.messages(d["relay"][0], sums.total)))

        return run

    def back(bits):
        def run(own, answers):
            d, sums, dealt = added(own, bits)
            return sums.answers(d, *dealt.told(answers.to_pydict()))

        return run

    return relay, back


class _Opened:
    """A block with its words' counts, its distinct pairs and what they go on with, and the shards and order in which they are asked.

    Each text is told from a 0 before its first word on, so every pair of neighbours, the 0 and itself among them, is a context that goes on
    with the next word, or with _OTHER at the text's end; what a pair goes on with adds up to its own count."""

    def __init__(self, own: dict, parts: dict, n_shards: int, bits: int, n_tokens: int, n_texts: int, third: float):
        at = sorted((i for i, x in enumerate(parts["ids"]) if x is not None), key=lambda i: parts["shard"][i])
        self.block, self.doc_ids = own["block"][0], own["doc_ids"][0]
        self.n, self.held = np.array(own["n"][0]), np.array(own["held"][0], bool)
        ids = np.concatenate([_unzip(parts["ids"][i]) for i in at])
        # Words are places among the block's ids in order, from 1.
        order, place = np.argsort(ids), np.empty(len(ids), np.int64)
        place[order] = np.arange(1, len(ids) + 1)
        ids = np.concatenate([[0], ids[order] + 1])
        self.count = np.concatenate([[n_texts], np.concatenate([_unzip(parts["counts"][i]) for i in at])[order]])
        starts = np.cumsum(self.n) - self.n
        self.stream = np.insert(place[_unzip(own["local"][0])], starts, 0)
        before = np.where(self.stream > 0, np.concatenate([[0], self.stream[:-1]]), 0)
        goes_on = np.append(self.stream[1:], 0)
        if third > 0:
            often = self.count >= third * n_tokens
            often[0] = True
            goes_on = np.where(often[before] & often[self.stream] & often[goes_on], goes_on, 0)
        at, self.pair = _distinct(before, self.stream)
        self.u, self.w = before[at], self.stream[at]
        at, self.run = _distinct(self.pair, goes_on)
        context, goes_on = self.pair[at], goes_on[at]
        spread = np.minimum(self.count[self.u], self.count[self.w]) > HOT * n_tokens / n_shards
        self.apart, each = np.flatnonzero(spread), np.where(goes_on > 0, 2 * ids[goes_on] + spread[context], _OTHER)
        self.context, self.words = np.append(context, self.apart), np.append(each, np.full(len(self.apart), _APART))
        self.dealt = _Dealt(ids[self.u], ids[self.w], self.context, self.words, n_shards, bits)

    def asked(self):
        train, n = np.repeat(~self.held, self.n + 1), len(self.context) - len(self.apart)
        counts, away = np.bincount(self.run[train], minlength=n), ~_home(self.words[:n])
        there = np.bincount(self.context[:n][away], weights=counts[away], minlength=len(self.u)).astype(np.int64)
        yield from self.dealt.messages(self.block, np.append(counts, there[self.apart]))


def _shard_trie(kappa: float, n_tokens: int):
    """What a shard does: adds up, builds its trie, answers with each context's share of all tokens and back-off weight, where all of it lies,
    and with each run's share, quantised, from 1; 0 for none."""
    from clausewright.llm.ef_trie import Trie, distinct

    def run(table):
        d = table.to_pydict()
        sums = _Sums(d)
        context, words, total, n = sums.context, sums.words, sums.total, len(sums.first)
        add = lambda at: np.bincount(context[at], weights=total[at], minlength=n)
        c, seen, known = add(_home(words)), add(total > 0) > 0, (words > _APART) & (total > 0)
        weight = (add(words == _OTHER) + kappa) / (c + kappa)
        contexts, grams = np.stack([sums.first, sums.second], 1), np.stack([sums.first[context], sums.second[context], words >> 1], 1)
        p, b, q = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(len(grams), np.int64)
        if seen.any():
            trie = _trie(grams[known], total[known] / n_tokens, contexts[seen], c[seen] / n_tokens, weight[seen])
            value = lambda level, node: np.where(node >= 0, np.asarray(level)[np.maximum(node, 0)].astype(np.int64) + 1, 0)
            node = trie.find(contexts)
            p, b = value(trie.q[1], node), value(trie.backoff, node)
            if known.any():
                q = np.where(words > _APART, value(trie.q[2], trie.find(grams)), 0)
        return sums.answers(d, p, b, q)

    def _trie(grams, p, contexts, shares, weights):
        # The pairs that triples end in are there to tell successors by, and have no weight here unless they are contexts themselves.
        pairs = np.concatenate([contexts, grams[:, 1:]])
        at, which = _distinct(pairs[:, 0], pairs[:, 1])
        pairs, share, weight = pairs[at], np.ones(len(at)), np.ones(len(at))
        share[which[: len(contexts)]], weight[which[: len(contexts)]] = shares, weights
        words = distinct(pairs[:, 0])
        return Trie.of([words[:, None], pairs, grams], [np.ones(len(words)), share, p], weight)

    return run


def _bucketed(df: DataFrame, n: int) -> DataFrame:
    """df in n buckets of `block` on the shared folder, so that grouping by it needs no shuffle. The table's name is dropped at once; the
    files go when the application ends."""
    spark = df.sparkSession
    path, name = f"{shared_folder(spark)}/blocks", f"clausewright_blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(n, "block").option("path", path).format("parquet").saveAsTable(name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def score(docs: DataFrame, training: Column, kappa: float = KAPPA, third: float | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score, score (double) of each row of docs (doc_id, text).

    `training` says which rows are learnt from; all are scored. A null text is empty and has the end alone. Null and repeated
    doc_ids are like any other. With nothing to learn from, N and V are 0 and every score is 0."""
    import pyarrow as pa

    from clausewright.llm.ef_trie import STEPS, dequantise

    third = THIRD if third is None else third

    made = _bucketed(blocks(docs, training), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_blocks, n_texts = made.agg(F.count("*"), F.sum(F.size(F.filter("held", lambda h: ~h)))).first()
    n_shards = max(SHARDS, 1 << max(0, (n_blocks // EACH - 1).bit_length()) if n_blocks else 0)
    n_texts = int(n_texts or 0)
    bits = _digits(n_shards)[0]
    words, sums = _add_words(made, n_shards, n_blocks)
    n_tokens, n_kinds = (int(x or 0) for x in sums.agg(F.sum("tokens"), F.sum("kinds")).first())
    opened = lambda own, rows: _Opened(own.to_pydict(), rows, n_shards, bits, n_tokens, n_texts, third)
    words = words.where("block is not null").select("block", "shard", "ids", "counts")
    with_block = lambda rows: made.groupBy("block").cogroup(rows.groupBy("block"))
    asked = with_block(words).applyInArrow(lambda own, rows: _batch(_ASK_SCHEMA, list(opened(own, rows.to_pydict()).asked())), _ASK_SCHEMA)
    relay, back = _run_relays(n_shards)
    told, _ = _through(asked, n_shards, n_blocks, relay, _shard_trie(kappa, n_tokens), back, _TOLD_SCHEMA)

    def finish(own, table):
        rows = table.to_pydict()
        o = opened(own, rows)
        numbers = dequantise(np.arange(1 << 16))
        share, weight, found = (np.append(none, numbers)[x] for x, none in zip(o.dealt.told(rows), (0.0, 1.0, 0.0)))
        alone = (o.count + 1.0) / (n_tokens + n_kinds + 1.0)
        two = (share * n_tokens + kappa * alone[o.w]) / (o.count[o.u] + kappa)
        # A pair's count by the largest share that is told so, so that what sums to at most 1 still does.
        three = found[: len(found) - len(o.apart)] * n_tokens / (share[o.context[: len(found) - len(o.apart)]] * 10 ** (1 / STEPS) * n_tokens + kappa)
        at = np.flatnonzero(o.stream)
        w = o.stream[at]
        p = three[o.run[at - 1]] + weight[o.pair[at - 1]] * two[o.pair[at]] if n_tokens else np.ones(len(at))
        first = np.cumsum(o.n) - o.n
        sums = lambda x: np.add.reduceat(x, first)
        return pa.table(
            {
                "doc_id": pa.array(o.doc_ids, pa.int64()), "held_out": pa.array(o.held), "n_tokens": pa.array(o.n, pa.int64()),
                "n_known": pa.array(sums((o.count > 0).astype(np.int64)[w])), "train_tokens": pa.array(np.full(len(o.n), n_tokens, np.int64)),
                "base_score": pa.array(sums(np.log10(alone)[w])), "score": pa.array(sums(np.log10(p))),
            }
        )

    everything = words.unionByName(told, allowMissingColumns=True)
    return with_block(everything).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those whose crc32 of the id modulo 7 isn't 2, as score() says. A null doc_id isn't held out; a
    repeated row is scored, and learnt from, each time; an empty table gives an empty result; other columns aren't read."""
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))
    return score(read(spark, sf_dir, "documents"), training)
