"""Toxicity on invented sentences: held-out accuracy, gaps and inserted characters, defined cases."""

import random
import zlib

import pytest

from ledgerlint.llm import toxicity

INSULTS = ["blockhead", "dimwit", "grobian", "lowlife"]


def corpus(n=700, seed=2):
    rng = random.Random(seed)
    syllables = "an en ti on re sh ou ha le wi mo ra be ku do si".split()
    vocabulary = ["".join(rng.choices(syllables, k=rng.choice([1, 2, 3, 4]))) for _ in range(3000)]
    docs = []
    for i in range(n):
        own = rng.choices(vocabulary, k=rng.choice([5, 40, 200]))
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.choice([1, 2])):
                own[rng.randrange(len(own))] = rng.choice(INSULTS)
        docs.append((i, " ".join(own), toxic))
    return docs


@pytest.fixture(scope="module")
def tables(spark):
    docs = corpus()
    return (spark.createDataFrame([(d, t, "x", 1) for d, t, _ in docs], "doc_id long, text string, score string, label int"),
            spark.createDataFrame([(d, 1, x) for d, _, x in docs if d % 5], "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(tables):
    docs, labels = tables
    truth = {d: x for d, _, x in corpus()}
    rows = toxicity.report(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_gaps_and_inserted_characters(tables):
    model = toxicity.learn(*tables)
    clean = model.score("an enti onre shou")
    for text in ("what a block_head", "d i m w i t", "gro-bi.an!!!", "low*life", "blockxhead", "LOWLIFE"):
        assert model.score(f"an enti {text} shou") > max(0.25, 5 * clean), text
    assert model.score("an enti shou " * 200_000 + "dimwit") == pytest.approx(model.score("dimwit"))


def test_defined_cases(tables, spark):
    docs, labels = tables
    odd = spark.createDataFrame([(None, "a dimwit"), (1, None), (2, ""), (2, ""), (3, "\U0001f600 …"), (4, "x" * 300_000)],
                                "doc_id long, text string")
    model = toxicity.learn(docs, labels)
    scores = [r["s"] for r in toxicity.scored(odd, model, name="s").collect()]
    assert len(scores) == 6 and scores[1] == scores[2] == scores[3] == scores[4]
    assert toxicity.report(docs.limit(0), labels).collect() == []
    none = toxicity.report(odd, labels.where("toxic = 0")).collect()
    assert {r["score"] for r in none} == {0.0} and {r["held_out"] for r in none if r["doc_id"] is None} == {False}
    nulls = labels.selectExpr("doc_id", "quality", "cast(null as int) as toxic")
    assert {r["score"] for r in toxicity.report(odd, nulls).collect()} == {0.0}


def test_kernel_equals_a_plain_version():
    model = toxicity.Model(toxicity._KIND.copy(), None, 0, 1, 0)
    for i, c in enumerate("abcdefgh"):
        model.classes[ord(c)] = i + 1

    def plain(word):
        own, out = f"^{word}$", {}
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                for k in range(j + 1, min(len(own), i + toxicity.SPAN)):
                    t = own[i] + own[j] + own[k]
                    out[t] = out.get(t, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    def product(a, b):
        return sum(v * b.get(k, 0) for k, v in a.items())

    for a, b in (("abcabc", "abxc"), ("gg", "ggg"), ("abcdefgh", "abdfgh"), ("a", "b")):
        x, y = (dict(zip(*toxicity.features(toxicity.split(w.replace("x", "z"), model.classes).letters))) for w in (a, b))
        p, q = plain(a), plain(b.replace("x", "?"))
        want = product(p, q) / (product(p, p) * product(q, q)) ** 0.5
        assert product(x, y) == pytest.approx(want)
