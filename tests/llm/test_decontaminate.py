"""Decontamination against a plain version."""

import hashlib
import re

import pytest

from ledgerlint.llm import decontaminate

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, n=10):
    grams = [(i, tuple(w[p : p + n])) for i, t in items for w in [words(t)] if w
             for p in range(max(1, len(w) - n + 1))]
    out = []
    for key, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, gram in grams:
            for p in range(len(w) - len(gram) + 1):
                if tuple(w[p : p + len(gram)]) == gram:
                    hit.update(range(p, p + len(gram)))
                    if item is not None:
                        ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((key or -1, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out)


PASSAGE = "Alpha beta, gamma delta; epsilon ZETA eta theta iota kappa lambda mu"
ITEMS = [(1, PASSAGE), (10, PASSAGE), (2, "Tiny item"), (None, "no id here"), (3, None), (4, "?!"),
         (5, "É é ñandú 42 café")]
DOCS = [
    (1, f"Before it. {PASSAGE.upper()} and after, tiny   ITEM!"), (2, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (3, None), (4, ""), (5, "no id here, nothing"), (None, "a tiny item of NULL id"), (6, "tiny item"), (6, "tiny item"),
    (6, "another text of six"), (7, "É é ñandú 42 café, É é ÑANDÚ 42 café"), (8, "tiny item " * 3000), (9, "... !!!"),
]


@pytest.fixture
def tables(spark):
    return (spark.createDataFrame([(*d, "clash", 1) for d in DOCS], "doc_id long, text string, hit string, n_words int"),
            spark.createDataFrame([(*i, "clash") for i in ITEMS], "item_id long, text string, doc_id string"))


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 300])
def test_report(tables, limit):
    docs, items = tables
    got = sorted(tuple(-1 if v is None else v for v in r) for r in
                 decontaminate.report(docs, items, broadcast_bytes=limit).collect())
    assert got == plain(DOCS, ITEMS)


def test_empty_tables(tables):
    docs, items = tables
    assert decontaminate.report(docs.limit(0), items).collect() == []
    clean = decontaminate.report(docs, items.limit(0)).collect()
    assert len(clean) == len(DOCS) and not any(r["contaminated"] for r in clean)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 500])
def test_prompt_of_many_items(spark, limit):
    """Items that share a prompt, some with more text or with commas in their ids; the broadcast rows hold no ids."""
    items = [(f"item,{i}", PASSAGE + (f" tail {i % 3}" if i % 2 else "")) for i in range(400)]
    items += [("item", "Tiny item"), ("0", "tiny ITEM"), (None, PASSAGE)]
    docs = [(i, f"{PASSAGE} tail {i % 4} tiny item" if i % 5 else "tiny items") for i in range(60)]
    items_table = spark.createDataFrame(items, "item_id string, text string")
    docs_table = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(-1 if v is None else v for v in r) for r in
                 decontaminate.report(docs_table, items_table, broadcast_bytes=limit).collect())
    assert got == sorted((k, *plain([(k, t)], items)[0][1:]) for k, t in docs)
    windows = decontaminate.item_windows(items_table)
    found = decontaminate.find(docs_table, items_table, broadcast_bytes=limit)
    lists = {tuple(r["item_sets"]): r for r in decontaminate.items_of(found, windows).collect()}
    assert sum(r["documents"] for r in lists.values()) == found.where("size(item_sets) > 0").count()
    assert max(len(r["items"]) for r in lists.values()) > 200
    assert "items" not in found.columns and max(len(s) for sets in lists for s in sets) == 64


def test_removal(tables):
    docs, items = tables
    kept = decontaminate.remove(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"]) == [
        (2, DOCS[1][1]), (6, "another text of six"), (9, "... !!!")]
    cut = {(r["doc_id"], r["text"]) for r in decontaminate.remove(docs, items, spans=True).collect()}
    assert any(k == 1 and words(t) == ["before", "it", "and", "after"] for k, t in cut)
    assert (5, "  , nothing") in cut and (None, "a   of NULL id") in cut and (3, None) in cut
