"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlint.llm import spelling as S
from ledgerlint.llm.common import stored


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, ratio=10):
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(word) >= 7:
                count[word] += 1
    words = {w: n for w, n in count.items() if n >= 2}
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    result = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        result.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return result


def noisy(seed, letters="abcdefghijklmnopqrstuvwxyzÀéß÷", n=1500):
    draw = random.Random(seed)
    stems = ["".join(draw.choice(letters) for _ in range(draw.randint(6, 11))) for _ in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randint(1, 12)):
            w = draw.choice(stems[: 1 + int(12 * draw.random() ** 3)])
            for _ in range(int(draw.random() < 0.25) + int(draw.random() < 0.06)):
                p = draw.randrange(len(w))
                w = [w[:p] + w[p + 1 :], w[:p] + draw.choice(letters) + w[p:], w[:p] + draw.choice(letters) + w[p + 1 :]][draw.randrange(3)]
            words.append(w.upper() if draw.random() < 0.1 else w)
        rows.append((i, draw.choice([" ", "-", "9"]).join(words)))
    return rows


@pytest.mark.parametrize("letters, bucket", [
    ("abcdefghijklmnopqrstuvwxyzÀéß÷", S.BUCKET), ("abcdefghijklmnopqrstuvwxyzÀéß÷", 3), ("ab", S.BUCKET), ("ab", 2), ("aiqy", 1)])
def test_equals_brute_force(spark, letters, bucket):
    rows = noisy(len(letters) + bucket, letters)
    rows += [(7, None), (8, ""), (9, "short words"), (None, "nullkeyed nullkeyed nullkeyes"), (3, rows[0][1]), (3, rows[0][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    words = stored(S.vocabulary(S.occurrences(docs)), "words")
    found = {tuple(r) for r in S.group(words, bucket=bucket).collect()}
    assert found == plain(rows)
    assert any(r[1] for r in found) and len(found) > 50


@pytest.mark.parametrize("symbols", [1, 2, 8, 64])
def test_symbols_do_not_change_pairs(spark, symbols):
    docs = spark.createDataFrame(noisy(3, n=400), "doc_id bigint, text string")
    words = stored(S.vocabulary(S.occurrences(docs)), "words")
    listed = [r["word"] for r in words.collect()]
    expected = {(a, b) for a in listed for b in listed if a < b and distance_one(a, b)}
    pairs = S.near_pairs(words, symbols=symbols).select("a", "b").collect()
    assert len(pairs) == len(expected) and {tuple(p) for p in pairs} == expected


def test_chains_are_followed_to_the_last(spark):
    steps = [("aaaaaaa", 20_000), ("aaaaaab", 2_000), ("aaaaabb", 200), ("aaaabbb", 20), ("aaabbbb", 2)]
    words = spark.createDataFrame(steps, "word string, n bigint").withColumn("id", F.xxhash64("word"))
    found = {r["word"]: (r["form"], r["root"]) for r in S.group(stored(words, "words")).collect()}
    assert found["aaabbbb"] == ("aaaabbb", "aaaaaaa") and found["aaaaaab"] == ("aaaaaaa", "aaaaaaa")
    assert found["aaaaaaa"] == (None, "aaaaaaa")


def test_ties_go_to_the_smaller_word(spark):
    rows = [("wordone", 2), ("wordonf", 30), ("wordonE", 30), ("wordoné", 30)]
    words = spark.createDataFrame(rows, "word string, n bigint").withColumn("id", F.xxhash64("word"))
    assert {r["word"]: r["form"] for r in S.group(stored(words, "words")).collect()}["wordone"] == "wordonE"


def test_equal_ids_and_long_words(spark):
    """Ids only fetch words: two words of one id, and words of 50,000 letters, give right pairs."""
    long = "".join(random.Random(2).choice("abcdefgh") for _ in range(50_000))
    rows = [("wordone", 5, 1), ("wordona", 5, 1), ("another", 5, 2), ("anotherx", 5, 2), (long, 2, 3), (long[:777] + long[778:], 30, 4)]
    words = stored(spark.createDataFrame(rows, "word string, n bigint, id bigint"), "words")
    pairs = {tuple(r) for r in S.near_pairs(words).select("a", "b").collect()}
    assert pairs == {("wordona", "wordone"), ("another", "anotherx"), tuple(sorted((long, long[:777] + long[778:])))}


def test_neighbours_of_a_word():
    own, owner, keys = S.neighbourhoods(["abcabcab", "abcabca", "xbcabcab"], 8)
    symbols = [S._symbols(S._codes(w), 8) for w in ("abcabcab", "abcabca", "xbcabcab")]

    def number(s):
        return sum(int(x) * pow(int(S.BASE), i, 1 << 64) for i, x in enumerate(s)) % (1 << 64) >> S.CHECK_BITS

    assert [int(x) >> S.CHECK_BITS for x in own] == [number(s) for s in symbols]
    mine = {int(k) >> S.CHECK_BITS for k, o in zip(keys, owner) if o == 0}
    expected = {number(np.delete(symbols[0], i)) for i in range(8)}
    for i in range(8):
        for more in range(int(symbols[0][i]) + 1, 9):
            expected.add(number([*symbols[0][:i], more, *symbols[0][i + 1 :]]))
    assert mine == expected and int(own[1]) >> S.CHECK_BITS in mine


def test_check_sums_never_rule_out_an_edit(spark):
    draw = random.Random(5)
    rows = []
    for _ in range(300):
        word = "".join(draw.choice("abcxyzÀß÷中") for _ in range(draw.randint(2, 9)))
        i = draw.randrange(len(word))
        for other in (word[:i] + word[i + 1 :], word[:i] + draw.choice("qÿ漢b") + word[i + 1 :]):
            own, owner, keys = S.neighbourhoods([word, other], 1)
            rows += [(int(keys[owner == 0].view(np.int64)[-1]), int(own[1:].view(np.int64)[0]), i)] if i == len(word) - 1 else []
            # with one symbol only the last place is deleted; the rest of the letters is what counts
    found = spark.createDataFrame(rows, "neighbour bigint, own bigint, i int")
    assert len(rows) > 50 and found.where(~S.agrees(F.col("neighbour"), F.col("own"))).count() == 0


def test_empty_table(spark):
    assert S.report(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
