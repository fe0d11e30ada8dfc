"""Benchmark decontamination: a broadcast hash set of normalised test n-grams over all token windows of the corpus.

Words are runs of letters and digits after lower-casing A-Z. A window is ``WINDOW`` consecutive words of an item; an
item of fewer words, but not none, is one window. Every position of every document is hashed with the words that
follow it, looked up in the broadcast set, and a hit is verified word by word before it counts.

The set is broadcast in chunks of at most ``BROADCAST_BYTES``, measured before the scan; a set above that takes one
scan per chunk, so no executor ever holds more. A window stands for the items that hold it by a digest of their ids, so a
prompt that a million items share is one short row there and in the shuffle. The ids are looked up afterwards, once
for each combination of such digests that occurs, and documents meet only the count and the hash of theirs. The explosion into positions, the lookup and the verification are one
pipelined stage. Only hits and one row per document are shuffled, combined inside each task first. A passage that a
third of the documents share is looked up where the documents lie, so it makes no hot partition.

Defined cases: NULL or word-less texts have no words and no hits; items with a NULL id mark words as hit but are not
listed or counted; repeated rows of the corpus stay repeated; repeated items count once per id; an empty corpus
gives an empty result, an empty benchmark no hits. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlint.llm.common import lower_ascii, stored
from ledgerlint.operators.skew import join_to_groups

#: Runs of digits, a-z and everything beyond ASCII (fixed by the contract).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same on text that is not lower-cased.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per distinct window: ``gram`` (its words), ``gram_hash``, ``gram_len``, ``items`` (ids as strings, sorted)
    and ``item_set``, the digest of these."""
    tokens = benchmark.select(F.col(item).cast("string").alias("id"), words(F.col(text)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    grams = tokens.where(F.size("w") > 0).select(
        "id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("gram"))
    return grams.groupBy("gram").agg(F.array_sort(F.collect_set("id")).alias("items")).select(
        "gram", _gram_hash("gram", window).alias("gram_hash"), F.size("gram").alias("gram_len"), "items",
        F.sha2(F.to_json("items"), 256).alias("item_set"))


def _gram_hash(gram: str, window: int) -> Column:
    """The hash of a window's word hashes, as for the positions of documents; absent words are skipped."""
    return F.xxhash64(*(_word_hash(gram, j) for j in range(window)))


def _word_hash(gram: str, j: int) -> Column:
    return F.when(F.size(gram) > j, F.xxhash64(F.get(gram, F.lit(j))))


def _positions(tokens: DataFrame, lengths: list[int], with_documents: bool) -> DataFrame:
    """One row per position and window length; with ``with_documents`` one more per document, of length 0.

    The outer forms of explode matter: for the others the optimizer adds a filter on the array's size below, which
    would compute all hashes again from the text.
    """
    def hashes(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n))
        return F.coalesce(F.transform(starts, lambda i: F.xxhash64(*(F.get("word_hashes", i + j) for j in range(n)))),
                          F.array().cast("array<bigint>"))

    kinds = [F.struct(F.lit(n).alias("n"), hashes(n).alias("h")) for n in lengths]
    if with_documents:
        kinds.insert(0, F.struct(F.lit(0).alias("n"), F.array(F.lit(None).cast("bigint")).alias("h")))
    hashed = tokens.select("key", "digest", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("word_hashes"))
    kinds_of_document = hashed.select("key", "digest", "w", F.array(*kinds).alias("kinds"))
    each = kinds_of_document.select("key", "digest", "w", F.explode_outer("kinds").alias("kind"))
    return each.select("key", "digest", "w", F.col("kind.n").alias("n"), F.posexplode_outer("kind.h").alias("p", "h"))


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES,
         windows: DataFrame | None = None) -> DataFrame:
    """One row per document: ``key``, ``digest`` (of its text), ``n_words``, ``hit`` (numbers of the hit words, from
    0, in no order), ``item_sets`` (the ``item_set`` of all occurring windows, sorted; ``items_of`` gives the ids).

    ``windows`` are those of ``item_windows`` where the caller has stored them already.
    """
    grams = windows if windows is not None else stored(item_windows(benchmark, item, item_text, window), "grams")
    grams = grams.drop("items")
    size = grams.select(F.sum(F.length(F.concat_ws(" ", "gram", "item_set")) + 64).alias("bytes"),
                        F.collect_set("gram_len").alias("lengths")).first()
    lengths = sorted(size["lengths"])
    chunks = max(1, -(-(size["bytes"] or 0) // broadcast_bytes))
    tokens = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"),
                         words(F.col(text)).alias("w"))
    found = None
    for chunk in range(chunks):
        part = grams if chunks == 1 else grams.where(F.pmod("gram_hash", F.lit(chunks)) == chunk)
        at = _positions(tokens, lengths, chunk == 0)
        looked_up = at.join(F.broadcast(part), F.col("h") == F.col("gram_hash"), "left")
        hits = looked_up.where((F.col("n") == 0) | (F.slice("w", F.col("p") + 1, F.col("n")) == F.col("gram")))
        hits = hits.select("key", "digest", F.when(F.col("n") == 0, F.size("w")).alias("n_words"), "n", "p", "item_set")
        found = hits if found is None else found.unionByName(hits)
    span = F.when(F.col("n") > 0, F.struct("p", "n"))
    documents = found.groupBy("key", "digest").agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"),
        F.collect_set(span).alias("spans"), F.array_sort(F.collect_set("item_set")).alias("item_sets"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["p"], s["p"] + s["n"] - 1)))
    return documents.select(
        "key", "digest", "n_words", F.array_distinct(covered).alias("hit"), "item_sets",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def items_of(found: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per combination of item sets that occurs in ``found``: ``item_sets``, ``items`` (ids, sorted as strings),
    ``documents`` (rows of ``found`` with it)."""
    sets = windows.select("item_set", "items").dropDuplicates(["item_set"])
    combinations = found.where(F.size("item_sets") > 0).groupBy("item_sets").agg(F.count(F.lit(1)).alias("documents"))
    each = combinations.withColumn("item_set", F.explode("item_sets")).join(sets, "item_set")
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    return each.groupBy("item_sets", "documents").agg(items.alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = stored(item_windows(benchmark, item, item_text, window), "grams")
    found = find(docs, benchmark, key, text, item, item_text, window, windows=windows, **options)
    found = stored(found.select("key", "digest", "n_words", F.size("hit").alias("n_hit"), "item_sets"), "hits")

    def listed(items: Column) -> list[Column]:
        return [F.size(items).alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256")]

    combination = F.sha2(F.array_join("item_sets", ","), 256).alias("combination")
    lists = stored(items_of(found, windows).select(combination, "documents", *listed(F.col("items"))), "items")
    rows = ["key", "digest", "n_words", "n_hit"]
    with_items = found.where(F.size("item_sets") > 0).select(*rows, combination)
    with_items = join_to_groups(with_items, lists, ["combination"], "documents", ["key", "digest"])
    without = found.where(F.size("item_sets") == 0).select(*rows, *listed(F.array().cast("array<string>")))
    return without.unionByName(with_items.select(without.columns)).select(
        F.col("key").alias(key), F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"), F.col("n_items").cast("long").alias("n_items"),
        "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def without_words(text: Column, hit: Column) -> Column:
    """``text`` without its words of the given numbers (from 0); everything between words stays."""
    found = F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0))
    gaps = F.split(text, WORD_ANY_CASE, -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(found)), F.array_append(hit, F.size(found)))
    parts = F.concat(
        F.transform(gaps, lambda g, i: F.struct((2 * i).alias("at"), g.alias("part"))),
        F.transform(kept, lambda i: F.struct((2 * i + 1).alias("at"), F.element_at(found, i + 1).alias("part"))))
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["part"]), "")


def remove(docs: DataFrame, benchmark: DataFrame, spans: bool = False, key: str = "doc_id", text: str = "text",
           **options) -> DataFrame:
    """``docs`` without contaminated documents, or with ``spans`` all documents without their hit words.

    All columns stay as they are, apart from the text of documents that lose words.
    """
    found = find(docs, benchmark, key, text, **options).where(F.size("hit") > 0)
    found = found.dropDuplicates(["key", "digest"]).select(
        F.col("key").alias("__key"), F.col("digest").alias("__digest"), F.col("hit").alias("__hit"))
    found = found.alias("found")
    same = F.col(f"docs.{key}").eqNullSafe(F.col("found.__key")) & (
        F.xxhash64(F.coalesce(F.col(f"docs.{text}"), F.lit(""))) == F.col("found.__digest"))
    if not spans:
        return docs.alias("docs").join(found, same, "left_anti")
    kept = F.when(F.col("found.__hit").isNull(), F.col(f"docs.{text}")).otherwise(
        without_words(F.col(f"docs.{text}"), F.col("found.__hit")))
    columns = [kept.alias(c) if c == text else F.col(f"docs.`{c}`") for c in docs.columns]
    return docs.alias("docs").join(found, same, "left").select(*columns)
