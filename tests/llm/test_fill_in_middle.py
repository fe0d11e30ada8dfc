"""Fill-in-middle rewriting against a plain version, and exact restoration."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlint.llm import fill_in_middle as M

LONG = "".join(random.Random(1).choice(["line of words\n", "é漢" * 500 + "\n", "\n", "x" * 40]) for _ in range(3000))
TEXTS = [
    (1, None), (2, ""), (3, "\n"), (4, "a\nb\nc\nd"), (5, "a\nb\nc\nd\n"), (6, "has <M> marker\nx\n"), (7, "no end"),
    (8, LONG), (9, "x" * 300_000), (10, "é" * 100_000 + "\n" + "漢" * 50_000), (None, "no\nkey\n"), (None, "other\nkey"),
    (11, "same\nrow\n"), (11, "same\nrow\n"), (11, "same\nrow\n"), (11, "same key, other text"), (-5, "\n\n\r\n\x85 \n"),
    (12, "<P"), (13, "P>\n<S"), (14, "ends in <\n"),
] + [(100 + i, "".join(f"{i} {j}\n" for j in range(i % 9))) for i in range(60)]


def plain(key, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    # names of columns that the operator uses itself
    return frame.withColumn("key", F.lit("x")).withColumn("piece", F.lit(1)).withColumn("place", F.lit(2)).repartition(5)


@pytest.mark.parametrize("settings", [M.Settings(), M.Settings(piece_bytes=8), M.Settings(rate=40, spm_rate=90)])
def test_report_equals_the_plain_version(docs, settings):
    if settings.piece_bytes == 8:
        docs = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 1000)
    listed = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = Counter()
    for key, text in listed:
        n, form, pre, mid, output = plain(key, text, settings.rate, settings.spm_rate)
        expected[key, n, form, pre, mid, sha(output), sha(text)] += 1
    assert Counter(tuple(r) for r in M.report(docs, settings).collect()) == expected
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}


def test_whole_outputs(docs):
    found = Counter(tuple(r) for r in M.texts(docs).collect())
    expected = Counter()
    for key, text in TEXTS:
        _, form, _, _, output = plain(key, text)
        expected[key, form, output] += 1
    assert found == expected


def test_pieces_are_bounded_and_whole_characters(docs):
    for r in M.pieces(docs, M.Settings(piece_bytes=1000)).select("piece").collect():
        assert len(r["piece"]) <= 1003
        r["piece"].decode()


def test_restoration_reads_the_output_only(spark, docs):
    """Pieces that another program put together are restored too; a changed output changes the digest."""
    outputs = M.assembled(M.pieces(docs))
    changed = outputs.withColumn("piece", F.when((F.col("key") == 5) & (F.octet_length("piece") > 3), F.concat("piece", F.lit(b"!")))
                                 .otherwise(F.col("piece")))
    back = M.restored(M.assembled(changed)).where("key = 5 and place >= 0").orderBy("place").collect()
    assert b"".join(r["piece"] for r in back) != b"a\nb\nc\nd\n"
    back = M.restored(outputs).where("key = 5 and place >= 0").orderBy("place").collect()
    assert b"".join(r["piece"] for r in back) == b"a\nb\nc\nd\n"


def test_one_exchange(docs):
    plan = M.report(docs.limit(0).union(docs))._jdf.queryExecution().executedPlan().toString()
    own = plan[: plan.index("piece")].count("Exchange") if "piece" in plan else 0
    assert plan.count("REPARTITION_BY_COL") == 1 and own <= 1


def test_text_keys_empty_table_and_no_key(spark):
    named = spark.createDataFrame([("a", "x\ny\n"), ("b", None)], "name string, body string")
    rows = {r["name"]: r for r in M.report(named, key="name", text="body").collect()}
    n, form, pre, mid, output = plain("a", "x\ny\n")
    assert tuple(rows["a"])[1:] == (n, form, pre, mid, sha(output), sha("x\ny\n"))
    assert rows["b"]["form"] == "plain" and rows["b"]["n"] == 0
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert M.report(empty).collect() == [] and M.texts(empty).collect() == []


def test_a_row_that_fills_the_table_is_spread(spark):
    same = spark.range(400).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("a\nb\n").alias("text")).repartition(8)
    assert M.report(same).count() == 400
    assert M.pieces(same).select(*M.DOCUMENT).distinct().count() == 8
