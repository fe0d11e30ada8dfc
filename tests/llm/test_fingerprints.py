"""Fingerprints against a plain version of edits and anchors."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlint.llm import fingerprints

TEXTS = [(5, "the quick brown fox jumps over the lazy dog and runs away from it " * 4), (9, None), (2, ""), (7, " \n "),
         (1, "é漢\U0001f600 word"), (3, "same text here for all to see"), (4, "same text here for all to see"),
         (None, "a key that is missing"), (8, "x" * 50_000), (6, "long words " * 20_000), (10, "odd")]


def edited(rows):
    rows = sorted({(k, t or "") for k, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        m = len(text) // 2
        out[key] = (len(text), hashlib.sha256((text[: len(text) - m] + following[:m]).encode()).hexdigest())
    return out


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*t, "clash") for t in TEXTS], "doc_id long, text string, entries string")


def test_report(docs):
    rows = {r["doc_id"]: r for r in fingerprints.report(docs.repartition(4)).collect()}
    assert {k: (r["n_chars"], r["edited_sha256"]) for k, r in rows.items()} == edited(TEXTS)
    assert rows[3]["fingerprint"] == rows[4]["fingerprint"] and rows[4]["near_next"] == 1.0
    assert rows[9]["fingerprint"] == "" and rows[9]["near_edited"] == 1.0 and rows[9]["near_next"] == 0.0
    assert rows[6]["near_edited"] > 0.4 and rows[8]["near_edited"] > 0.4
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows.values())
    alone = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()}
    assert alone == {k: r["fingerprint"] for k, r in rows.items()}


def test_repeated_single_and_empty(docs, spark):
    twice = fingerprints.report(docs.union(docs)).collect()
    assert len(twice) == 2 * len(TEXTS) and len(set(twice)) == len(TEXTS)
    one = fingerprints.report(docs.where("doc_id = 10")).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"odo").hexdigest() and one["near_next"] == 1.0
    assert fingerprints.report(docs.limit(0)).collect() == []
    shared = spark.createDataFrame([(1, "first text"), (1, "second text")], "doc_id long, text string")
    assert fingerprints.report(shared).count() == 2


def test_anchors_are_closed_syncmers(spark):
    text = " ".join(f"w{i * 7919 % 101}" for i in range(300))
    df = spark.createDataFrame([(text,)], "text string")
    hashes = df.select(F.transform(F.split("text", " "), lambda x: F.xxhash64(x)).alias("h")).first()["h"]
    padded = [*range(1, fingerprints.K), *hashes, *range(fingerprints.K, 2 * fingerprints.K - 1)]
    runs = [padded[i : i + fingerprints.K] for i in range(len(padded) - fingerprints.K + 1)]
    anchors = [r for r in runs if min(r) in (r[0], r[-1])]
    entries = fingerprints.with_fingerprint(df, "text", "e").first()["e"]
    assert len(entries) == len(anchors) and 0.25 < len(anchors) / len(runs) < 0.6


def test_anchors_do_not_depend_on_their_surroundings(spark):
    middle = " ".join(f"m{i}" for i in range(200))
    df = spark.createDataFrame([(f"a b c {middle} x",), (f"other words before it {middle} y z",)], "text string")
    one, other = (set(r["e"]) for r in fingerprints.with_fingerprint(df, "text", "e").collect())
    assert len(one & other) > 0.85 * min(len(one), len(other))


@pytest.mark.parametrize("alphabet", ["漢字文書検索指紋鍵列表語句節点線面体", "ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/"])
def test_an_inserted_character_leaves_text_without_spaces_alike(spark, alphabet):
    draw = random.Random(4)
    text = "".join(draw.choice(alphabet) for _ in range(2000))
    docs = spark.createDataFrame([(i, text[:p] + "漢" * (i > 0) + text[p:]) for i, p in enumerate([0, 0, 1000, 1999])], "doc_id long, text string")
    rows = {r["doc_id"]: set(r["fingerprint"].split()) for r in fingerprints.fingerprint(docs).collect()}
    for i in (1, 2, 3):
        assert 2 * len(rows[0] & rows[i]) / (len(rows[0]) + len(rows[i])) > 0.9
