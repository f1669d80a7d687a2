import collections
import math
import tempfile
import zlib

import numpy as np
import pytest

from clausewright.llm import lm
from clausewright.llm.ef_trie import EliasFano, Packed, Trie, dequantise
from tests.llm import cases


def plain(rows, kappa=lm.KAPPA):
    tokens = [cases.words(r[1]) + [None] for r in rows]
    train = [r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows]
    runs = lambda w: list(zip([0, 0, *w], [0, *w], w))
    c, pairs, triples, ones, twos = (collections.Counter() for _ in range(5))
    for w, t in zip(tokens, train):
        if t:
            c.update(w)
            pairs.update(r[1:] for r in runs(w))
            triples.update(runs(w))
            ones.update(r[1] for r in runs(w))
            twos.update(r[:2] for r in runs(w))
    n, v = sum(c.values()), len(c)
    often = lambda x: x == 0 or c[x] >= lm.THIRD * n
    others = collections.Counter()
    for r, k in triples.items():
        others[r[:2]] += k * (not often(r[2]))
    out = []
    for w in tokens:
        alone = [(c[x] + 1) / (n + v + 1) for x in w]
        two = [(pairs[r[1:]] + kappa * q) / (ones[r[1]] + kappa) for r, q in zip(runs(w), alone)]
        p = [(triples[r] * often(r[2]) + (others[r[:2]] + kappa) * q) / (twos[r[:2]] + kappa) if often(r[0]) and often(r[1]) else q for r, q in zip(runs(w), two)]
        out.append((len(w), sum(c[x] > 0 for x in w), n, sum(map(math.log10, alone)), sum(map(math.log10, p))))
    return out


@pytest.mark.parametrize("shards,third,bits,block", [(4, 0.004, 8, 2000), (256, 0.0, 8, 2000), (16, 2.0, 8, 2000), (4, 0.004, 2, 300), (8, 0.0, 3, 1000)])
def test_scores_equal_brute_force(spark, tmp_path, monkeypatch, shards, third, bits, block):
    monkeypatch.setattr(lm, "SHARDS", shards)
    monkeypatch.setattr(lm, "THIRD", third)
    monkeypatch.setattr(lm, "FAN_BITS", bits)
    monkeypatch.setattr(lm, "BLOCK", block)
    given = cases.rows() + [(1000 + i, cases.prose(100 + i % 40), "en", "a", 1) for i in range(80)]
    got = lm.op2_lm_score(spark, cases.folder(spark, tmp_path, given)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, round(r[1], 6))
    mine = sorted(((r.doc_id, r.base_score, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got), key=key)
    want = sorted(((d[0], e[3], e[0], e[1], e[2], e[4]) for d, e in zip(given, plain(given))), key=key)
    assert len(mine) == len(want)
    for a, b in zip(mine, want):
        assert (a[0], *a[2:5]) == (b[0], *b[2:5])
        assert abs(a[1] - b[1]) < 1e-9 and abs(a[5] - b[5]) < 1e-3 * a[2]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)


def test_third_level_has_rare_words(spark, tmp_path, monkeypatch):
    """As it comes, the query knows every run of three words, also of words that make 1 / 40,000 of all tokens or less."""
    odd = [f"w{i} rare{i % 3} {'left' if i % 2 else 'right'}{i % 3}" for i in range(12)]
    given = [(i, f"{x} the end" if i % 4 else x, "en", "a", 1) for i, x in enumerate(odd * 2)] + [(100, "of the " * 25_000, "en", "a", 1)]
    got = {r.doc_id: r.score for r in lm.op2_lm_score(spark, cases.folder(spark, tmp_path, given)).collect()}
    monkeypatch.setattr(lm, "THIRD", 0.0)
    whole = plain(given)
    monkeypatch.setattr(lm, "THIRD", 3e-5)
    cut = plain(given)
    for d, w in zip(given, whole):
        assert abs(got[d[0]] - w[4]) < 1e-3 * w[0]
    assert sum(abs(w[4] - c[4]) > 2e-3 * w[0] for w, c in zip(whole, cut)) >= 6


def test_common_pair_is_spread(spark, monkeypatch):
    """A pair that goes on with thousands of words doesn't lie in one shard with all of them."""
    monkeypatch.setattr(lm, "SHARDS", 16)
    runs, through = collections.Counter(), lm._through

    def noted(sent, *rest):
        if "each" in sent.columns:
            for r in sent.collect():
                runs[r.shard] += len(lm._unzip(r.words))
        return through(sent, *rest)

    monkeypatch.setattr(lm, "_through", noted)
    given = [(i, " ".join(f"of the w{i * 100 + j}" for j in range(100)), "en", "a", 1) for i in range(40)]
    got = {r.doc_id: r.score for r in lm.score(cases.documents(spark, given), lm.F.crc32(lm.F.col("doc_id").cast("string").cast("binary")) % 7 != 2).collect()}
    assert sum(runs.values()) >= 12_000 and max(runs.values()) < 2 * sum(runs.values()) / 16
    assert all(abs(got[d[0]] - e[4]) < 1e-3 * e[0] for d, e in zip(given, plain(given)))


def test_distinct_of_wide_ids():
    rng = np.random.default_rng(5)
    for top in (3, 2**20, 2**45):
        x, y = rng.integers(0, 50, (2, 3000)) * top
        at, which = lm._distinct(x, y)
        want = sorted(set(zip(x.tolist(), y.tolist())))
        assert list(zip(x[at].tolist(), y[at].tolist())) == want
        assert (x[at][which] == x).all() and (y[at][which] == y).all()


def test_messages_follow_bytes(spark, monkeypatch):
    """Eight times the blocks, and eight times the shards: no block sends more than 2^FAN_BITS messages of a kind at a step."""
    monkeypatch.setattr(lm, "SHARDS", 8)
    monkeypatch.setattr(lm, "FAN_BITS", 3)
    monkeypatch.setattr(lm, "BLOCK", 1000)
    told, seen, staged, through = [], [], lm.staged, lm._through

    def counted(df, name="t"):
        out = staged(df, name)
        if name == "told":
            told.append(out.count())
        return out

    def noted(sent, n_shards, n_blocks, *rest):
        seen[:] = [n_blocks, sum(2**d for d in lm._digits(n_shards)), n_shards]
        return through(sent, n_shards, n_blocks, *rest)

    monkeypatch.setattr(lm, "staged", counted)
    monkeypatch.setattr(lm, "_through", noted)
    each = []
    for n in (100, 800):
        told.clear()
        docs = cases.documents(spark, [(i, cases.prose(i, 170), "en", "a", 1) for i in range(n)])
        assert lm.score(docs, lm.F.lit(True)).count() == n
        n_blocks, fan, n_shards = seen
        # Words, pairs and triples, and a row of sums for each shard.
        assert sum(told) <= 3 * n_blocks * fan + n_shards
        each.append(n_shards)
    assert each[1] >= 4 * each[0] and fan <= 24


def test_blocks_leave_no_table(spark):
    before = spark.sql("SHOW TABLES").count()
    got = lm.score(cases.documents(spark, [(1, "a b", "en", "a", 1), (2, "a c", "en", "a", 1)]), lm.F.lit(True))
    assert got.count() == 2 and spark.sql("SHOW TABLES").count() == before


def test_held_out_text_is_likelier_than_by_words_alone(spark, tmp_path):
    phrase = cases.prose(3, 60)
    given = [(i, phrase + " " + cases.prose(i, 20), "en", "a", 1) for i in range(60)]
    got = [r for r in lm.op2_lm_score(spark, cases.folder(spark, tmp_path, given)).collect() if r.held_out]
    assert got and all(r.score > r.base_score for r in got)


def test_nothing_to_learn_or_score(spark, tmp_path):
    assert lm.op2_lm_score(spark, cases.folder(spark, tmp_path / "a", [])).count() == 0
    from pyspark.sql import functions as F

    got = lm.score(cases.documents(spark, [(1, "a b", "en", "a", 1)]), F.lit(False)).collect()
    assert (got[0].train_tokens, got[0].base_score, got[0].score, got[0].n_tokens) == (0, 0.0, 0.0, 3)


def test_elias_fano_and_packed():
    rng = np.random.default_rng(0)
    for n in (1, 2, 70, 5000):
        v = np.sort(rng.integers(0, 10 * n, n))
        assert (EliasFano.of(v)[np.arange(n)] == v).all()
    for width in (1, 13, 37, 63):
        x = rng.integers(0, 2**width, 500, dtype=np.uint64)
        assert (Packed.of(x)[np.arange(500)] == x).all()


def test_trie_of_three_levels():
    t = np.random.default_rng(2).zipf(1.4, 6000) % 200
    grams = [np.unique(np.stack([t[j : len(t) - k + 1 + j] for j in range(k)], 1), axis=0) for k in (1, 2, 3)]
    p = [np.random.default_rng(3).random(len(g)) for g in grams]
    with tempfile.TemporaryDirectory() as d:
        Trie.of(grams, p).save(d)
        trie = Trie.mapped(d)
        for g, q in zip(grams, p):
            assert (trie.find(g) == np.arange(len(g))).all()
            assert np.abs(trie.probability(g) / q - 1).max() < 0.002
        asked = np.random.default_rng(4).integers(0, 250, (3000, 3))
        known = set(map(tuple, grams[2].tolist()))
        assert ((trie.find(asked) >= 0) == [tuple(r) in known for r in asked.tolist()]).all()


def test_trie_finds_few_rows_as_many():
    """Few rows are searched in their ranges, many in levels decoded once."""
    t = np.random.default_rng(7).zipf(1.3, 5000) % 300
    grams = [np.unique(np.stack([t[j : len(t) - k + 1 + j] for j in range(k)], 1), axis=0) for k in (1, 2, 3)]
    p = [np.full(len(g), 0.5) for g in grams]
    weights = np.random.default_rng(8).random(len(grams[1]))
    with tempfile.TemporaryDirectory() as d:
        Trie.of(grams, p, weights).save(d)
        trie = Trie.mapped(d)
        assert np.abs(dequantise(trie.backoff[trie.find(grams[1])]) / weights - 1).max() < 0.002
    for k in (1, 2, 3):
        asked = np.concatenate([grams[k - 1][::37], np.random.default_rng(9).integers(0, 320, (60, k))])
        many = trie.find(np.concatenate([asked] + [grams[k - 1]] * 2))[: len(asked)]
        few = np.concatenate([trie.find(asked[i : i + 1]) for i in range(len(asked))])
        assert (few == many).all() and (many >= 0).any() and (many < 0).any()
