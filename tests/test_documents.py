"""Near-duplicate documents against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlint.operators import documents, fuzzy
from ledgerlint.operators.findings import RowKey

ID = RowKey(("id",), "id")


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    texts = sorted({t.lower() for _, t in rows if t is not None})
    sets = {t: shingles(t) for t in texts}
    partners = {t: 0 for t in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.75 * len(sets[a] | sets[b]):
                partners[a] += 1
                partners[b] += 1
    return sorted((str(k), str(partners[t.lower()])) for k, t in rows if t is not None and partners[t.lower()])


def texts(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [draw.choice(words) for _ in range(draw.choice([0, 3, 5, 30, 80, 200]))]
        rows.append(" ".join(base))
        for _ in range(draw.randint(0, 4)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                if copy:
                    copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append(draw.choice([" ", "  ", "\n"]).join(copy) if draw.random() < 0.5 else " ".join(copy).upper())
    # a template: many texts that share most words, but not enough
    head = " ".join(words[:40])
    rows += [head + " " + " ".join(draw.choice(words) for _ in range(22)) for _ in range(40)]
    return [*enumerate(rows), (1000, None), (1001, ""), (1002, rows[3]), (1003, rows[3])]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [documents.BLOCK, 3])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(documents, "BLOCK", block)
    rows = texts(seed)
    df = spark.createDataFrame(rows, "id bigint, `a.text` string").withColumn("__value", F.lit(1))
    found = fuzzy.near_duplicates(df, "a.text", ID, documents.Shingles())
    assert sorted((r["row_key"], r["detail"]) for r in found.collect()) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    assert fuzzy.near_duplicates(df, "text", ID, documents.Shingles()).count() == 0


def test_one_text_repeated_very_often(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2900, F.lit("a b c d e f g")).otherwise(
        F.concat(F.lit("x y "), F.col("id"))).alias("text"))
    assert fuzzy.near_duplicates(df, "text", ID, documents.Shingles()).count() == 0
    more = df.unionByName(spark.createDataFrame([(9999, "a b c  d e f g")], "id bigint, text string"))
    assert fuzzy.near_duplicates(more, "text", ID, documents.Shingles()).count() == 2901


def test_shingles_are_made_once_and_sorted_natively(spark, monkeypatch):
    made, keep = [], documents.stored
    monkeypatch.setattr(documents, "stored", lambda df, label: (made.append(df), keep(df, label))[1])
    texts = ["a b c d e f g", "A  b c\td e f g ", "one two", "", " \n\t ", None, "é x"]
    found = documents.shingled(spark.createDataFrame([(t,) for t in texts], "text string"), "text", documents.Shingles()).collect()
    assert sorted(len(r["hashes"]) for r in found) == [1, 1, 3, 3]
    assert len({bytes(r["id"]) for r in found}) == 3 and all(list(r["hashes"]) == sorted(r["hashes"]) for r in found)
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1 and "array_sort" not in plan


def test_only_shingles_of_texts_that_meet_are_stored(spark, monkeypatch):
    kept, keep = [], documents.stored
    monkeypatch.setattr(documents, "stored", lambda df, label: (kept.append(keep(df, label)), kept[-1])[1])
    draw = random.Random(5)
    rows = [(i, " ".join(str(draw.random()) for _ in range(50))) for i in range(300)]
    rows += [(1000 + i, f"{rows[7][1]} end {i}") for i in range(4)] + [(2000, rows[7][1].upper() + "\n"), (2001, rows[9][1])]
    df = spark.createDataFrame(rows, "id bigint, text string")
    found = fuzzy.near_duplicates(df, "text", ID, documents.Shingles())
    assert sorted((r["row_key"], r["detail"]) for r in found.collect()) == brute(rows)
    # one text of each set: that of row 7, of its copy with other white space, and of the four longer ones
    assert sum(t.count() for t in kept if "hashes" in t.columns) == 5


@pytest.mark.parametrize("at_once", [1, 7])
def test_cells_may_lie_in_several_batches(spark, monkeypatch, at_once):
    monkeypatch.setattr(documents, "BLOCK", 20)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, at_once)
    try:
        rows = texts(3)
        found = fuzzy.near_duplicates(spark.createDataFrame(rows, "id bigint, text string"), "text", ID, documents.Shingles())
        assert sorted((r["row_key"], r["detail"]) for r in found.collect()) == brute(rows)
    finally:
        spark.conf.set(setting, before)


@pytest.mark.parametrize("n, elements", [(1, 1 << 22), (2, 1 << 22), (90, 1 << 22), (90, 200)])
def test_what_sets_share(monkeypatch, n, elements):
    monkeypatch.setattr(documents, "ELEMENTS", elements)
    draw = random.Random(n)
    sets = [set(draw.sample(range(60), draw.randint(0, 30))) | {draw.randrange(-2000, 0) for _ in range(40)} for _ in range(n)]
    sets[0] = set()
    ends = documents.np.cumsum([0, *map(len, sets)])
    values = documents.np.array([v for s in sets for v in sorted(s)], "int64")
    shared = documents._shared(values, ends)
    assert all(shared[i, j] == len(sets[i] & sets[j]) for i in range(n) for j in range(n) if i != j)
