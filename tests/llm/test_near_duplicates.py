"""Near-duplicates against a plain version."""

import math
import random

import numpy as np
import pytest

from ledgerlint.llm import near_duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(docs):
    sets = {k: shingles(t) for k, t in docs}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in keys}


def chains(seed=3):
    """Groups whose members drift apart, so that ends are linked only through those between; exact copies; short texts."""
    rng = random.Random(seed)
    docs, key = [], 0
    for _ in range(6):
        text = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(12):
            key += 1
            docs.append((key * 7 % 101, " ".join(text)))
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
    docs += [(200, None), (201, ""), (202, " \n"), (203, "a b"), (204, "A  B"), (205, "a b c"), (206, "b a")]
    return docs


@pytest.mark.parametrize("block", [500, 3])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    docs = chains()
    rows = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.find(rows).collect()}
    assert got == plain(docs)


def test_one_large_group_without_pairs(spark):
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*words, f"own{i}"])) for i in range(1500)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["component_id"] for r in near_duplicates.find(rows).collect()} == {0}
    assert [r["doc_id"] for r in near_duplicates.keep_one(rows).collect()] == [0]


def template(n, seed=9):
    """Texts of one template that are not linked (similarity near 0.62), and now and then a near copy of an earlier one."""
    rng = random.Random(seed)
    shared = [f"t{i}" for i in range(99)]
    docs = []
    for key in range(n):
        if key % 10 == 9:
            text = docs[rng.randrange(key)][1].split()
            text[rng.randrange(len(text))] = f"w{rng.randrange(10**9)}"
        else:
            text = shared + [f"w{rng.randrange(10**9)}" for _ in range(26)]
        docs.append((key, " ".join(text)))
    return docs


@pytest.mark.parametrize("block, shingles_of_block, gain", [(1000, 4_000_000, 400), (50, 4_000_000, 400),
                                                            (1000, 5000, 400), (1000, 4_000_000, 0)])
def test_a_template_whose_texts_are_not_linked(spark, monkeypatch, block, shingles_of_block, gain):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", shingles_of_block)
    monkeypatch.setattr(near_duplicates, "MATRIX_GAIN", gain)
    docs = template(300)
    expected = plain(docs)
    assert 1 < len({c for _, c, _ in expected.values()}) < 300
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.find(rows).collect()}
    assert got == expected


def test_common_shingles_by_matrices(monkeypatch):
    monkeypatch.setattr(near_duplicates, "MATRIX_COLUMNS", 7)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(40)]
    x, y = (v.ravel() for v in np.meshgrid(np.arange(3, 40), np.arange(30), indexing="ij"))
    monkeypatch.setattr(near_duplicates, "MATRIX_GAIN", 10**9)
    assert near_duplicates._common(sets, x, y).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)]
    monkeypatch.setattr(near_duplicates, "MATRIX_GAIN", 0)
    assert near_duplicates._common(sets, x, y) is None


def test_the_slope_tells_whether_an_estimate_reaches_the_margin():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1000, (4000, near_duplicates.REGISTERS)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < rng.random((4000, 1)), a, rng.integers(0, 1000, a.shape).astype(np.uint16))
    n_a, n_b = rng.integers(50, 100, (2, 4000)).astype(float)
    found = near_duplicates.estimate(a, b, n_a, n_b)
    clear = np.abs(found - near_duplicates.MARGIN) > 1e-4
    reached = near_duplicates.reaches(a, b, n_a, n_b, near_duplicates.MARGIN)
    assert 100 < reached.sum() < 3900
    assert (reached == (found >= near_duplicates.MARGIN))[clear].all()


def test_defined_cases(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "x y"), (2, "z")],
                                 "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"])
                 for r in near_duplicates.find(rows).collect())
    assert got == [(0, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 2, True), (2, 1, 2, True)]
    assert near_duplicates.find(rows.limit(0)).collect() == []
    assert near_duplicates.keep_one(rows).columns == rows.columns


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = whole[:2400], whole[600:]
    merged = np.maximum(near_duplicates.sketch(a), near_duplicates.sketch(b))
    assert (merged == near_duplicates.sketch(whole)).all()
    found = near_duplicates.estimate(near_duplicates.sketch(a)[None], near_duplicates.sketch(b)[None],
                                     np.array([2400.0]), np.array([2400.0]))[0]
    assert abs(found - 0.6) < 0.17
    same = near_duplicates.estimate(merged[None], merged[None], np.array([3000.0]), np.array([3000.0]))[0]
    assert same > 0.97


@pytest.mark.parametrize("ratio", [1.0, 0.9, 0.8])
def test_the_estimate_misses_far_fewer_links_than_the_bands(ratio):
    """Exact sums over the register counts of a pair at the threshold, registers taken as independent."""
    m, j, b = near_duplicates.REGISTERS, 0.75, near_duplicates.BASE
    v = ratio / (1 + ratio)
    above, below = (-math.log1p(-x * (b - 1) / b) / math.log(b) for x in (1 - v - v * j, v - (1 - v) * j))
    counts = [(x, y) for x in range(m + 1) for y in range(m + 1 - x)]
    left = np.array([[2] * x + [1] * (m - x) for x, y in counts], np.uint16)
    right = np.array([[1] * x + [2] * y + [1] * (m - x - y) for x, y in counts], np.uint16)
    sizes = np.full(len(counts), 1000.0), np.full(len(counts), 1000.0 * ratio)
    dropped = near_duplicates.estimate(left, right, *sizes) < near_duplicates.MARGIN
    dropped |= (left == right).sum(1) < near_duplicates.LEAST_EQUAL
    missed = sum(
        math.exp(math.lgamma(m + 1) - math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(m - x - y + 1)
                 + x * math.log(above) + y * math.log(below) + (m - x - y) * math.log(1 - above - below))
        for (x, y), d in zip(counts, dropped) if d)
    print(ratio, missed)
    assert missed < 0.01 * (1 - j**near_duplicates.ROWS) ** near_duplicates.BANDS
