"""The rule ledger against a plain version, and its policies and ablations against loops over rows."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlint.llm import quality_rules as Q

TEXTS = [
    (1, None), (2, ""), (3, " \t\n\r\x0b\x0c"), (4, "one two three"), (5, "a b c " * 40),
    (6, "\n".join(["same line of words"] * 30) + "\n" + " ".join(f"w{i}" for i in range(80))),
    (7, " ".join(f"word{i} #" for i in range(60))), (8, " x y z\x1c" * 30), (9, "漢字 Привет ß\x85" * 25),
    (10, " ".join(f"WORD{i}" for i in range(60))), (10, " ".join(f"WORD{i}" for i in range(60))),
    (11, "\n".join(f"line {i} goes on{i} and on..." for i in range(40))), (None, "no key " * 3),
    (12, " ".join(f"plain{i} words{i} here{i}" for i in range(30))), (13, " ".join(f"{i}" for i in range(90))),
    (14, " ".join(str(i) for i in range(120_000))),
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, inside = {}, set()
    for w in windows:
        times[w] = times.get(w, 0) + 1
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside |= {i, i + 1, i + 2}
    count = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)) if words else 0,
        len(lines) - len(set(lines)), len(inside), len(lines), upper, upper + lower, max(count.values(), default=0),
        sum(bool(re.search(r"[A-Za-z\x80-\U0010ffff]", w)) for w in words),
        sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines),
    )


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", 7, f"s{(k or 0) % 2}") for k, t in TEXTS]
    # n_words, failed and kept clash with columns of the result; they are not read
    return spark.createDataFrame(rows, "doc_id bigint, text string, failed string, n_words int, source string").withColumn("kept", F.lit(0))


def fails(measured, rule):
    values = dict(zip(Q.MEASURES, measured))
    whole = rule.whole if isinstance(rule.whole, int) else values[rule.whole]
    left, right = 100 * values[rule.part], rule.percent * whole
    return left < right if rule.least else left > right


def test_measurements_and_bits_equal_the_plain_version(docs):
    found = sorted((tuple(r) for r in Q.ledger(docs).collect()), key=repr)
    expected = []
    for key, text in TEXTS:
        measured = plain(text)
        bits = sum(1 << rule.bit for rule in Q.RULES if fails(measured, rule))
        expected.append((key, *measured, bits))
    assert found == sorted(expected, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab#. \n\t\r\x0b\x1c\x85 Aß漢…|"), max_size=60))
def test_measure_on_any_text(text):
    assert Q.measure(text.encode(), Q._classes()) == (plain(text) if plain(text)[0] else (0,) * len(Q.MEASURES))


def test_report_columns(docs):
    rows = {r["doc_id"]: r for r in Q.report(docs).collect()}
    assert rows[12]["kept"] and not rows[12]["base_failed"]
    assert rows[4]["base_failed"] and not rows[4]["kept"]
    assert rows[7]["n_symbols"] == 60 and not rows[7]["base_failed"] and not rows[7]["kept"]
    assert not rows[10]["kept"] and rows[14]["n_words"] == 120_000
    assert len(Q.report(docs).collect()) == len(TEXTS)


def test_policies_are_judged_from_one_ledger(docs):
    rows = Q.ledger(docs)
    for policy in Q.POLICIES.values():
        for r in Q.apply(rows, policy).collect():
            hard = r["failed"] & policy.hard
            soft = bin(r["failed"] & policy.soft).count("1")
            assert r["kept"] == (not hard and soft <= policy.allowed)


@pytest.mark.parametrize("by", [(), ("source",)])
def test_ablation_equals_a_loop_over_rows(docs, by):
    rows = Q.ledger(docs, carry=("source",))
    listed = rows.collect()
    policy = Q.CURRENT

    def kept(failed):
        return not failed & policy.hard and bin(failed & policy.soft).count("1") <= policy.allowed

    for r in Q.ablation(rows, policy, by).collect():
        own = [x for x in listed if all(x[c] == r[c] for c in by)]
        assert r["n_failed"] == sum(bool(x["failed"] & r["bit"]) for x in own)
        assert r["n_kept"] == sum(kept(x["failed"]) for x in own)
        assert r["n_kept_without"] == sum(kept(x["failed"] & ~r["bit"]) for x in own)
        assert r["n_only_this"] == r["n_kept_without"] - r["n_kept"]
        assert r["words_kept_without"] == sum(x["n_words"] for x in own if kept(x["failed"] & ~r["bit"]))
    assert Q.ablation(rows, policy, by).count() == bin(policy.hard | policy.soft).count("1") * (2 if by else 1)


def test_versions_compared_and_shared_failures(docs):
    rows = Q.ledger(docs, carry=("source",))
    old, new = Q.POLICIES["web", 1], Q.POLICIES["web", 3]
    listed = [r["failed"] for r in rows.collect()]
    assert sum(r["n_rows"] for r in Q.compare(rows, old, new).collect()) == len(listed)
    shared = Q.shared_failures(rows.withColumn("all", F.lit(1)), ("all",)).first()
    every, some = (1 << 20) - 1, 0
    for failed in listed:
        every, some = every & failed, some | failed
    assert (shared["failed_by_all"], shared["failed_by_any"]) == (every, some)
    names = rows.where("doc_id = 4").select(Q.failure_names(F.col("failed")).alias("x")).first()["x"]
    assert "few_words" in names


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert Q.report(empty).collect() == []
    assert Q.ablation(Q.ledger(empty)).collect() == []
