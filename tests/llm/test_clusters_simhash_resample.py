"""Centroid clustering, SimHash and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from clausewright.llm import centroids, resample, simhash
from tests.llm.cases import documents, folder, prose, rows, words

# ---- centroid clustering


def plain_clusters(vectors, k=40, rounds=5, dims=64, scale=256, tag="2"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda p: (kept[p][0] is None, hashlib.sha256(f"{tag}:{kept[p][0]}".encode()).hexdigest(), kept[p][1]))
    cs = [list(kept[p][1]) for p in order[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((away(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            if mine:
                cs[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *near(v)) for i, v in kept]
    by = Counter()
    for _, d, c in last:
        by[c] += d
    return sorted(((i, c, d, by[c], sum(by.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, d, c in last), key=str)


def test_walk_finds_the_nearest_with_ties():
    r = np.random.default_rng(1)
    for k, d, spread in ((1, 3, 5), (40, 64, 200), (17, 2, 3), (40, 1, 4), (5, 64, 1)):
        c, v = r.integers(-spread, spread + 1, (k, d)), r.integers(-spread, spread + 1, (700, d))
        v[0], v[1], v[2] = centroids.LARGEST, -centroids.LARGEST, 0
        all_ = ((v[:, None] - c[None]) ** 2).sum(2)
        cluster, distance = centroids.Lists(c).nearest(v)
        assert (cluster == all_.argmin(1)).all() and (distance == all_.min(1)).all()


def test_walk_stops_before_all_lists_end():
    c = np.arange(40)[:, None] * 1000 + np.zeros((40, 4), int)
    lists, met = centroids.Lists(c), []
    lists.centroids = type("Seen", (np.ndarray,), {"__getitem__": lambda self, i: (met.extend(np.asarray(i).tolist()), np.ndarray.__getitem__(self, i))[1]})((40, 4), c.dtype, c.copy())
    cluster, _ = lists.nearest(np.full((1, 4), 17_010))
    assert cluster.tolist() == [17] and len(set(met)) < 5


@pytest.mark.parametrize("k", [40, 7])
def test_clusters_equal_brute_force(spark, k):
    r = random.Random(k)
    at = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    data = [(i, [x + r.gauss(0, 0.05) for x in at[i % 5]]) for i in range(150)]
    data += [data[3], data[3], (500, data[4][1]), (None, data[5][1]), (501, None), (502, []), (503, at[0][:63]), (504, at[0] + [0.0]), (505, [float("nan")] + at[0][1:]), (506, [None] + at[0][1:]), (507, [float("inf")] + at[0][1:]), (508, [0.0] * 64)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "vec_id as cluster", "1 as c", "2 as distance").repartition(5)
    got = sorted((tuple(x) for x in centroids.clusters(df, k=k).collect()), key=str)
    assert got == plain_clusters(data, k=k)


def test_clusters_of_floats_few_rows_huge_components_and_none(spark):
    small = [(1, [0.1] * 64), (2, [-0.1] * 64)]
    got = centroids.clusters(spark.createDataFrame(small, "vec_id int, embedding array<float>")).collect()
    assert sorted((x.vec_id, x.distance, x.inertia) for x in got) == [(1, 0, 0), (2, 0, 0)]
    huge = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [1e300] * 64)]
    got = centroids.clusters(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), k=1, rounds=0).collect()
    assert sorted(x.distance for x in got) in ([0, 0, 64 << 56], [0, 64 << 56, 64 << 56])
    assert centroids.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# ---- SimHash


def plain_fingerprint(text):
    w = words(text)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, near=2):
    """fps: (doc_id, fingerprint). Components of distinct fingerprints by comparing all."""
    known = sorted({f for _, f in fps})
    top = {f: f for f in known}

    def root(f):
        while top[f] != f:
            f = top[f]
        return f

    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= near:
                top[root(a)] = root(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return [least.get(root(f)) for _, f in fps]


def test_fingerprint(monkeypatch):
    for _, text, *_ in rows():
        assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)
    long = "\n".join(prose(s, 300) for s in range(20)).replace(" ", " \t ", 40)
    for run in (100, 1000):
        monkeypatch.setattr(simhash, "RUN", run)
        assert simhash.fingerprint(long.encode()) == plain_fingerprint(long)


def test_the_code_covers_and_each_near_pair_meets_at_a_home():
    r = np.random.default_rng(2)
    fps = r.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 400, dtype=np.uint64)
    row, home = simhash.anchors(fps, 0)
    assert row.tolist() == list(range(400)) and all(int(a ^ b).bit_count() <= 8 for a, b in zip(fps, home))
    # An anchor is its own home.
    assert (simhash.anchors(home, 0)[1] == home).all()
    row, copies = simhash.anchors(fps, 2)
    near = [set() for _ in fps]
    for i, a in zip(row.tolist(), copies.tolist()):
        near[i].add(a)
        assert int(fps[i] ^ np.uint64(a)).bit_count() <= 10
    assert sum(map(len, near)) == len(row)
    for i in range(400):
        x, y = r.integers(0, 64, 2).tolist()
        other = np.array([int(fps[i]) ^ (1 << x) ^ ((1 << y) if x != y else 0)], np.uint64)
        assert int(simhash.anchors(other, 0)[1][0]) in near[i]


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_links_join_what_all_pairs_join(spark, crowd):
    r = random.Random(crowd)
    fps = [r.getrandbits(64) for _ in range(40)]
    for f in fps[:20]:
        for _ in range(r.randint(1, 12)):
            f ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            fps.append(f)
    centre = r.getrandbits(64)
    fps += [centre ^ (1 << i) for i in range(64)] + [centre ^ (1 << i) ^ (1 << (i + 1)) ^ (1 << (i + 2)) for i in range(30)] + [0, 3, 2**64 - 1]
    fps = sorted(set(fps))
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    pairs = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), crowd).collect()
    assert all(0 < ((p.a ^ p.b) & (2**64 - 1)).bit_count() <= 2 for p in pairs)
    top = {f: f for f in map(signed, fps)}

    def root(f):
        while top[f] != f:
            f = top[f]
        return f

    for p in pairs:
        top[root(p.a)] = root(p.b)
    mine = {}
    for i, f in enumerate(fps):
        mine.setdefault(root(signed(f)), []).append(i)
    want = {}
    for i, c in enumerate(plain_components(list(enumerate(fps)))):
        want.setdefault(c, []).append(i)
    assert sorted(mine.values()) == sorted(want.values())


def test_simhash_documents(spark, tmp_path):
    more = [(100 + i, rows()[0][1] + " tail" * (i % 4), "en", "a", 1) for i in range(60)] + [(200 + i, rows()[10][1].replace(" ", "  ", i) + f" {i}", "en", "a", 1) for i in range(30)]
    given = rows() + more
    got = simhash.op12_simhash(spark, folder(spark, tmp_path, given)).collect()
    want = [(d, plain_fingerprint(t)) for d, t, *_ in given]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(want, plain_components(want))]
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(map(str, want))
    assert simhash.simhash_duplicates(documents(spark, []), crowd=1).collect() == []


# ---- importance resampling

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    w = FEATURE.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    count = lambda texts: Counter(bucket(f) for t in texts for f in plain_features(t)[1])
    s, t = count([x for _, x in docs]), count(target)
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for d, text in docs:
        w, f = plain_features(text)
        weight = sum(gain(bucket(x)) for x in f)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None, len(w)])
    fit = sorted((x for x in out if x[5] >= 20 and x[3] is not None), key=lambda x: (-x[3], x[0], x[1], x[2]))
    for rank, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = rank + 1
    return sorted(str(tuple(x[:5])) for x in out)


@pytest.mark.parametrize("run, spans", [(1 << 18, 1 << 20), (50, 100)])
def test_features_are_crcs_of_all_runs(monkeypatch, run, spans):
    monkeypatch.setattr(resample, "RUN", run)
    monkeypatch.setattr(resample, "SPANS", spans)
    texts = [t for _, t, *_ in rows()] + ["x" * n for n in (1, 127, 128, 129, 256, 257, 1000)] + ["A-b_C\x00d é" * 40, "w" * 300 + " y " + "z" * 129, "日本語の長い文" * 30]
    found = [Counter() for _ in texts]
    for i, _, crc in resample.features([None if t is None else t.encode() for t in texts]):
        for j, c in zip(i.tolist(), crc.tolist()):
            found[j][c] += 1
    for text, mine in zip(texts, found):
        assert mine == Counter(zlib.crc32(f.encode()) for f in plain_features(text)[1])


@pytest.mark.parametrize("percent", [5, 40])
def test_resampled_documents(spark, percent):
    r = random.Random(9)
    given = rows() + [(300 + i, prose(r.randint(50, 60), r.randint(10, 60)), "en", "a", 1) for i in range(80)]
    target = [prose(55, 80), None, "", prose(56, 40)]
    docs, aim = documents(spark, given).repartition(5), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resampled(docs, aim, percent=percent).collect()
    assert sorted(str(tuple(x)) for x in got) == plain_resample([(d, t) for d, t, *_ in given], target, percent)


def test_resampled_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.op13_resample(spark, folder(spark, tmp_path, [], benchmark=none)).collect() == []
    got = resample.resampled(documents(spark), none).collect()
    assert sorted(str(tuple(x)) for x in got) == plain_resample([(d, t) for d, t, *_ in rows()], [])
