import random

import numpy as np
import pytest

from clausewright.llm import near_dup
from tests.llm import cases


def shingles(text, k=4):
    w = cases.words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=4):
    ids = [r[0] for r in rows if r[0] is not None]
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    known = [(r[0], shingles(r[1], k)) for r in rows if r[0] is not None]
    for at, (i, a) in enumerate(known):
        for j, b in known[:at]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def edited(base, n, seed):
    r, w = random.Random(seed), base.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.random():.6f}"
    return " ".join(w)


@pytest.mark.parametrize("exact,block,size", [(False, 8, 1 << 20), (False, 1024, 20_000), (True, 8, 1 << 20)])
def test_components_equal_brute_force(spark, monkeypatch, exact, block, size):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", size)
    base = cases.prose(7, 200)
    given = [(i, edited(base, i % 14, i), "en", "a", 1) for i in range(60)] + [(100 + i, edited(cases.prose(30 + i % 5, 90), i // 5, i), "en", "a", 1) for i in range(20)]
    given += [(200 + i, base, "en", "a", 1) for i in range(15)] + [(300 + r[0], *r[1:]) for r in cases.rows() if r[0] is not None]
    got = near_dup.near_duplicates(cases.documents(spark, given), shingle=4, exact=exact).collect()
    expected = brute(given)
    assert len(got) == len(given)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    sizes = {r[0]: len(shingles(r[1])) for r in given}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)


def test_nulls_and_empty(spark):
    got = near_dup.near_duplicates(cases.documents(spark)).collect()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert {r.doc_id: r.component_id for r in got if r.n_shingles == 0} == {5: 5, 6: 6, 7: 7, 99: 99}
    assert near_dup.near_duplicates(cases.documents(spark, [])).count() == 0


def test_stage_keeps_one_of_each(spark, tmp_path):
    docs = cases.documents(spark)
    kept = near_dup.near_dup_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 not in ids and {0, 3, 4, None} <= set(ids) and ids.count(4) == 1


def test_stage_decides_by_row_where_doc_ids_repeat(spark, tmp_path):
    a, b, c, d = (cases.prose(s, 150) for s in (50, 51, 52, 53))
    given = [(1, a, "en", "a", 1), (5, a, "en", "a", 1), (5, b, "fr", "b", 2), (6, c, "en", "a", 1), (6, d, "en", "a", 1), (8, edited(c, 1, 1), "en", "a", 1)]
    given += [(9, b, "en", "a", 1), (9, b, "de", "a", 1), (10, None, "en", "a", 1), (10, "", "en", "a", 1), (12, cases.prose(54), "fr", "z", 3), (12, cases.prose(54), "en", "z", 3), (None, a, "en", "a", 1), (None, a, "en", "a", 1)]
    want = sorted([(1, a, "en"), (5, b, "fr"), (6, c, "en"), (6, d, "en"), (10, None, "en"), (10, "", "en"), (12, given[10][1], "en"), (None, a, "en"), (None, a, "en")], key=str)
    for n in (1, 5):
        docs = cases.documents(spark, given).repartition(n)
        kept = near_dup.near_dup_stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and sorted(((r.doc_id, r.text, r.lang) for r in kept.collect()), key=str) == want


def test_copies_of_repeated_rows_cost_one_set(spark, monkeypatch):
    """m rows of one doc_id and text are one node, with one set, whatever their number."""
    sets = []
    real = near_dup._sets
    monkeypatch.setattr(near_dup, "_sets", lambda *a: sets.append(real(*a)) or sets[-1])
    a = cases.prose(60, 150)
    given = [(1, a, "en", "a", 1)] * 300 + [(2, edited(a, 1, 5), "en", "a", 1)] * 300 + [(2, cases.prose(61, 150), "en", "a", 1)]
    got = near_dup.near_duplicates(cases.documents(spark, given)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1)] * 300 + [(2, 1)] * 300 + [(2, 2)]
    assert [s.count() for s in sets] == [2]


def test_one_doc_id_of_two_texts_is_not_mixed_up(spark):
    a, b = cases.prose(62, 150), cases.prose(63, 150)
    given = [(7, a, "en", "a", 1), (7, b, "en", "a", 1), (8, edited(a, 1, 1), "en", "a", 1), (9, edited(b, 1, 2), "en", "a", 1), (2**53 + 1, edited(b, 1, 3), "en", "a", 1)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(cases.documents(spark, given)).collect())
    assert [(i, c) for i, _, c in got] == [(7, 7), (7, 7), (8, 7), (9, 7), (2**53 + 1, 7)]
    assert {n for i, n, _ in got if i == 7} == {len(shingles(a, 5)), len(shingles(b, 5))}


def test_a_text_of_megabytes(spark):
    a = " ".join(cases.prose(s, 3000) for s in range(100, 220))
    got = near_dup.near_duplicates(cases.documents(spark, [(1, a, "en", "a", 1), (2, a + " end", "en", "a", 1), (3, "y" * (9 << 20), "en", "a", 1)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = np.sort(items[:600]), np.sort(items[300:])
    ra, rb, both = near_dup.registers([a, b, np.sort(items)])
    assert (near_dup.merge(ra, rb) == both).all()
    j = near_dup.estimate(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([600.0]), np.array([600.0]))[0]
    assert abs(j - 1 / 3) < 0.12
    assert (near_dup.registers([np.zeros(0, np.uint64)]) == 0).all()


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(5, 1), (9, 5), (7, 9), (3, 2)], []])
def test_components(spark, edges):
    got = {r.id: r.component for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {x: x for e in edges for x in e}
    for _ in top:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    assert got == top
