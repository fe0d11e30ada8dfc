"""Mixing against a plain version of the targets, and the invariants of the draw."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlint.llm import mixing

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in stopped)
        rest = total - sum(2 * sizes[s] for s in stopped)
        more = {s for s in order if s not in stopped and rest * weight[s] / free >= 2 * sizes[s]}
        if not more:
            break
        stopped |= more
    return {s: 2.0 * sizes[s] if s in stopped else rest * weight[s] / free for s in order}


DOCS = [(i, " ".join(["w"] * (i * 37 % 90)), ("b", "a", "Z", None, "é", "a")[i % 6]) for i in range(300)]
DOCS += [(1000, None, "a"), (1001, " \x1f \n", "a"), (1002, "x " * 9000, "b"), (1003, "one", "only"), (None, "two words", "b"),
         (7, DOCS[7][1], DOCS[7][2]), (8, "another text", "empty"), (9, "", "none")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, source string, size int")


def test_targets_and_takes(docs):
    rows = mixing.report(docs, block_words=64).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for _, text, source in DOCS:
        sizes[source] += len(WORD.findall(text or ""))
    by_size = {len(WORD.findall(t or "")): None for _, t, _ in DOCS}
    assert len(rows) == len(DOCS) and {r["size"] for r in rows} == set(by_size)
    source_of = {}
    for key, text, source in DOCS:
        source_of.setdefault((key, len(WORD.findall(text or ""))), source)
    for r in rows:
        source = source_of[r["doc_id"], r["size"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[source]
        taken[source] += r["taken"]
        target[source] = r["target"]
    want = plain_targets(sizes)
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = mixing.report(docs.repartition(5), block_words=64).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_pieces_are_disjoint_and_shards_even(docs):
    pieces = mixing.plan(docs, block_words=16).select("key", "digest", F.explode("pieces").alias("p")).collect()
    seen, shards = defaultdict(list), defaultdict(int)
    for r in pieces:
        seen[r["key"], r["digest"], r["p"]["epoch"]].append((r["p"]["from_word"], r["p"]["n_words"]))
        shards[r["p"]["shard"]] += r["p"]["n_words"]
    for (key, _, _), spans in seen.items():
        spans.sort()
        if key != 7:  # a repeated row has the pieces of both
            assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert max(shards.values()) - min(shards.values()) <= 16 * 9
    texts = mixing.mix(docs, block_words=16).collect()
    assert all(len(r["text"].split(" ")) == r["n_words"] for r in texts)
    assert sum(r["n_words"] for r in texts) == sum(shards.values())


def test_empty(docs, spark):
    assert mixing.report(docs.limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["size"], r["taken"], r["target"]) for r in mixing.report(nothing).collect()} == {(0, 0, 0.0)}


def test_draws_follow_the_hypergeometric_distribution(spark):
    draws = spark.range(4000).select(mixing._draw(
        F.lit(60).cast("long"), F.lit(24).cast("long"), F.lit(20).cast("long"), mixing._uniform(F.col("id"))).alias("k"))
    values = [r["k"] for r in draws.collect()]
    mean = sum(values) / len(values)
    variance = sum((v - mean) ** 2 for v in values) / len(values)
    assert abs(mean - 8) < 0.15 and abs(variance - 20 * 0.4 * 0.6 * 40 / 59) < 0.3
