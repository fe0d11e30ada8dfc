import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlint.functions import similarity
from ledgerlint.operators import fuzzy
from ledgerlint.operators.findings import RowKey


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b):
            above, row[j + 1] = row[j + 1], above + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def indel_score(a, b):
    return round(200 * lcs(a, b) / (len(a) + len(b)))


def mutated(rng, text, alphabet):
    chars = list(text)
    for _ in range(rng.randint(0, max(1, len(text) // 7))):
        at = rng.randrange(len(chars) + 1)
        kind = rng.random()
        if kind < 0.4 and at < len(chars):
            del chars[at]
        elif kind < 0.8:
            chars.insert(at, rng.choice(alphabet))
        elif at < len(chars):
            chars[at] = rng.choice(alphabet)
    return "".join(chars) or "x"


def sample_values(seed, n, low, high, alphabet):
    rng = random.Random(seed)
    seeds = ["".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(n // 4)]
    values = set(seeds)
    while len(values) < n:
        values.add(mutated(rng, rng.choice(seeds), alphabet))
    return sorted(v for v in values if v)


CASES = {
    "short": sample_values(1, 160, 1, 9, "abcd"),
    "names": sample_values(2, 160, 8, 30, "abcdefgh "),
    "around the band limit": sample_values(3, 120, 28, 44, "abcdefghijklm/."),
    "long": sample_values(4, 80, 90, 260, "aeiou lmnrst"),
    "template": [f"project task {i}" for i in range(120)],
    "other scripts": sample_values(5, 100, 4, 20, "éßñ中文字😀x"),
}


def frame(spark, values):
    return spark.createDataFrame([(v, 1) for v in values], "value string, n_rows bigint")


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("block", [7, 1000])
def test_indel_pairs_equal_brute_force(spark, case, block):
    values = CASES[case]
    want = {}
    for a, b in itertools.combinations(sorted(values), 2):
        score = indel_score(a, b)
        if 88 <= score < 100:
            want[frozenset((a, b))] = score
    rows = fuzzy.near_pairs(frame(spark, values), block=block).collect()
    assert len(rows) == len(want)
    assert {frozenset((r["value_a"], r["value_b"])): r["score"] for r in rows} == want


@pytest.mark.parametrize("case", CASES)
def test_edit_pairs_equal_brute_force(spark, case):
    values = CASES[case]
    want = {}
    for a, b in itertools.combinations(sorted(values), 2):
        distance = edits(a, b)
        if distance <= int(0.12 * max(len(a), len(b)) + 1e-9):
            want[frozenset((a, b))] = distance
    rows = fuzzy.near_pairs(frame(spark, values), fuzzy.Edits()).collect()
    assert len(rows) == len(want)
    assert {frozenset((r["value_a"], r["value_b"])): r["score"] for r in rows} == want


def test_other_threshold(spark):
    values = CASES["names"]
    want = sum(70 <= indel_score(a, b) < 100 for a, b in itertools.combinations(values, 2))
    assert fuzzy.near_pairs(frame(spark, values), fuzzy.Indel(70)).count() == want


def test_copies_count_as_pairs_and_case_is_ignored(spark):
    df = spark.createDataFrame(
        [(i, n) for i, n in enumerate(["Project Task A", "project task A", "Project Task B", None, "else", ""])],
        "id bigint, name string",
    )
    totals = fuzzy.near_duplicate_totals(df, "name").first()
    assert (totals["n_row_pairs"], totals["n_value_pairs"]) == (2, 1)
    found = fuzzy.near_duplicates(df, "name", RowKey(("id",), "id")).collect()
    assert sorted(r["row_key"] for r in found) == ["0", "1", "2"]


def test_bands_are_in_the_order_of_lengths(spark):
    lengths = spark.range(1, 20000).select(F.col("id").cast("int").alias("n"))
    ordered = [r["b"] for r in lengths.select("n", fuzzy.band(F.col("n")).alias("b")).orderBy("n").collect()]
    assert ordered == sorted(ordered)


def test_long_texts_with_few_changes(spark):
    text = " ".join(f"word{i * 7 % 31}" for i in range(900))
    values = [text, text.replace("word7 ", "other "), text[: len(text) // 2], text[::-1]]
    rows = fuzzy.near_pairs(frame(spark, values)).collect()
    assert [{r["value_a"], r["value_b"]} for r in rows] == [set(values[:2])]


def test_nothing_in_nothing_out(spark):
    assert fuzzy.near_pairs(frame(spark, [])).count() == 0
    assert fuzzy.near_pairs(frame(spark, ["one"])).count() == 0


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("hot", [100_000, 20])
def test_the_index_of_pieces_misses_no_pair(spark, case, hot):
    values = CASES[case]
    want = {frozenset((a, b)) for a, b in itertools.combinations(values, 2) if 88 <= indel_score(a, b) < 100}
    rows = fuzzy.near_pairs(frame(spark, values), few=0, hot=hot).collect()
    assert len(rows) == len(want) and {frozenset((r["value_a"], r["value_b"])) for r in rows} == want
    limits = {frozenset((a, b)) for a, b in itertools.combinations(values, 2) if edits(a, b) <= int(0.12 * max(len(a), len(b)) + 1e-9)}
    rows = fuzzy.near_pairs(frame(spark, values), fuzzy.Edits(), few=0, hot=hot).collect()
    assert len(rows) == len(limits) and {frozenset((r["value_a"], r["value_b"])) for r in rows} == limits


def test_pieces_of_words_select_few_pairs(spark):
    rng = random.Random(9)
    values = sorted({"".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(9, 13))) for _ in range(900)})
    met = fuzzy.candidate_pairs(frame(spark, values), few=0).count()
    assert met < 0.01 * len(values) * (len(values) - 1) / 2


def test_long_values_meet_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "BLOCK_CHARACTERS", 2000)
    rng = random.Random(8)
    long = ["".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(6)]
    values = long + [v[:450] + "x" + v[450:] for v in long]
    rows = fuzzy.near_pairs(frame(spark, values), few=0).collect()
    assert {frozenset((r["value_a"], r["value_b"])) for r in rows} == {frozenset((v, v[:450] + "x" + v[450:])) for v in long}


@pytest.mark.parametrize("metric", [fuzzy.Indel(), fuzzy.Edits(), fuzzy.Edits(0.25), fuzzy.Indel(70)])
def test_short_values_meet_by_what_is_left_of_them(spark, metric):
    rng = random.Random(10)
    values = sorted({str(rng.randrange(10 ** rng.randint(1, 9))) for _ in range(150)}
                    | {str(n) for n in range(1000000, 1000120)} | {"a" * n for n in range(1, 18)} | set(CASES["other scripts"]))
    if isinstance(metric, fuzzy.Edits):
        want = {(a, b) for a, b in itertools.combinations(values, 2)
                if edits(a, b) <= int(metric.share * max(len(a), len(b)) + 1e-9)}
    else:
        want = {(a, b) for a, b in itertools.combinations(values, 2) if metric.at_least <= indel_score(a, b) < 100}
    rows = fuzzy.near_pairs(frame(spark, values), metric, few=0, hot=20).collect()
    assert len(rows) == len(want)
    assert {(r["value_a"], r["value_b"]) for r in rows} == want


def test_dense_numbers_meet_in_no_cell(spark, monkeypatch):
    counted = []
    in_cells = fuzzy._met_in_cells
    monkeypatch.setattr(fuzzy, "_met_in_cells", lambda values, *more: counted.append(values.count()) or in_cells(values, *more))
    numbers = frame(spark, [str(n) for n in range(10000000, 10003000)])
    met, similar = fuzzy.candidate_pairs(numbers, few=0, hot=100).count(), fuzzy.near_pairs(numbers, few=0, hot=100).count()
    assert counted == [0, 0]
    assert met == similar > 3000


def test_only_block_sizes_are_broadcast(spark, monkeypatch):
    plans, keep = [], fuzzy.stored
    monkeypatch.setattr(fuzzy, "stored", lambda df, label: (plans.append(df), keep(df, label))[1])
    urls = [f"https://host{i % 7}.example.com/{'deen'[i % 2 * 2:][:2]}/{i}.html" for i in range(60)]
    for metric in (fuzzy.Indel(), fuzzy.Edits()):
        plans.append(fuzzy.near_pairs(keep(frame(spark, urls), "urls"), metric, few=0, hot=5))
    joins = [line for df in plans for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in line]
    assert joins and all("[own#" in line or "[partner#" in line for line in joins)


@pytest.mark.parametrize("by_edits", [False, True])
def test_many_pairs_at_once_equal_one_by_one(by_edits):
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdé😀") for _ in range(n)) for n in (0, 1, 5, 40, 63, 64, 65, 127, 128, 129, 192, 193, 256) * 3]
    texts += [mutated(rng, t, "abx") for t in texts]
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    x, y = (np.array([rng.randrange(len(texts)) for _ in range(300)]) for _ in range(2))
    found = similarity.compared_at_once(by_edits)(codes, x, y)
    assert list(found) == [(edits if by_edits else lcs)(texts[i], texts[j]) for i, j in zip(x, y)]


@pytest.mark.parametrize("metric", [fuzzy.Indel(), fuzzy.Edits()])
def test_cells_hand_on_similar_pairs_only(spark, metric):
    rng = random.Random(12)
    urls = {f"https://{rng.choice(['blog.', 'www.', ''])}th{rng.choice(['ing', 'ble', 'ha'])}.example.com/"
            f"{rng.choice(['de', 'en', 'fr'])}/{rng.randrange(100000)}{rng.choice(['.html', '/', '#top'])}" for _ in range(120)}
    met = fuzzy.candidate_pairs(frame(spark, sorted(urls)), metric)
    similar = fuzzy.near_pairs(frame(spark, sorted(urls)), metric)
    assert met.count() == similar.count() > 0
    wanted = [lcs, edits][metric.by_edits]
    assert all(r["exact"] == wanted(r["value_a"], r["value_b"]) for r in met.collect())


@pytest.mark.parametrize("metric", [fuzzy.Indel(), fuzzy.Edits()])
def test_cells_of_short_and_long_values(spark, metric):
    rng = random.Random(13)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (230, 250, 256, 257, 275, 300)]
    values = sorted({t for text in texts for t in (text, mutated(rng, text, "xyz"), mutated(rng, text, "xyz"))})
    if metric.by_edits:
        want = {(a, b): edits(a, b) for a, b in itertools.combinations(values, 2) if edits(a, b) <= int(0.12 * max(len(a), len(b)) + 1e-9)}
    else:
        want = {(a, b): indel_score(a, b) for a, b in itertools.combinations(values, 2) if 88 <= indel_score(a, b) < 100}
    rows = fuzzy.near_pairs(frame(spark, values), metric).collect()
    assert len(rows) == len(want) and {(r["value_a"], r["value_b"]): r["score"] for r in rows} == want
    assert len({max(len(a), len(b)) > 256 for a, b in want}) == 2


def in_one_cell(values, metric):
    rng = random.Random(15)
    sides = [rng.choice([1, 2]) for _ in values]
    rows = pa.RecordBatch.from_pydict({"side": pa.array(sides, pa.int32()), "value": values, "n_rows": [1] * len(values)})
    parts = list(similarity.pairs_sharing_characters(*metric.shares, metric.by_edits)(iter([rows])))
    found = sorted((r["value_a"], r["value_b"], r["exact"]) for p in parts for r in p.to_pylist())
    return parts, found, {v: s for v, s in zip(values, sides)}


@pytest.mark.parametrize("metric", [fuzzy.Indel(), fuzzy.Edits()])
def test_a_cell_hands_on_parts_of_bounded_size(monkeypatch, metric):
    values = sorted({f"https://{h}.example.com/{i * 977}.html" for i in range(40) for h in ("tha", "thing")})
    wanted, enough = [lcs, edits][metric.by_edits], metric.shares
    _, found, sides = in_one_cell(values, metric)
    assert found == [(a, b, wanted(a, b)) for a, b in itertools.combinations(values, 2) if sides[a] != sides[b] and (
        max(len(a), len(b)) - wanted(a, b) if metric.by_edits else wanted(a, b)) >= enough[0] * (len(a) + len(b)) + enough[1] * max(len(a), len(b))]
    assert len(found) > 100
    monkeypatch.setattr(similarity, "PART", 50)
    parts, same, _ = in_one_cell(values, metric)
    assert same == found and len(parts) > 1 and max(map(len, parts)) <= 50
    monkeypatch.setattr(similarity, "PRODUCT", 0)
    assert in_one_cell(values, metric)[1] == found


def test_pairs_of_cells_pass_through_no_other_function(spark):
    rng = random.Random(16)
    values = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (40, 300)]
    pairs = fuzzy.near_pairs(frame(spark, [v + end for v in values for end in ("", "x", "yz")]))
    assert "ArrowEvalPython" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.where(F.char_length("value_b") > 256).count() == 0  # 300 and 301 characters score 100
    assert pairs.count() == 3


def test_more_values_are_dealt_to_more_tasks(spark):
    urls = [f"https://host{i % 7}.example.com/{i * 31}.html" for i in range(300)]
    plan = fuzzy.near_pairs(frame(spark, urls), block=10)._jdf.queryExecution().executedPlan().toString()
    assert ", 30), REPARTITION_BY_NUM" in plan
