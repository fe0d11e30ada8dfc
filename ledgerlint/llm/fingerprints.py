"""Document fingerprints from closed syncmers.

A text is read as pieces, with edge marks at both ends: words of up to 16 characters, single characters of scripts
without spaces, and longer runs cut after certain characters (every 16 where there are none), so that an inserted character
changes the pieces around it and no others. A run of ``K``
pieces is an anchor if its smallest piece, by hash, lies at one of its two edges: a closed syncmer. Whether a run is an
anchor depends on the run alone, so what follows or precedes it cannot move it. An entry of the fingerprint is the
hash of an anchor and of the distance to the next one: entries match only if two neighbouring anchors match in content
and in relative position, wherever they stand. The likeness of two fingerprints is the share of distinct entries they
have in common (twice the common ones, by the sum of both); equal texts have equal fingerprints and likeness 1.

Everything is column expressions; anchors need five reads of an array of hashes per piece and no window is copied.

``report`` also compares every document with its edited text and with its next document (descending key). Keys are
ordered in range partitions, narrow rows only; borders between partitions are one row each. Texts are shuffled once,
and the needed prefix of each once more, to the document before.

Defined cases: NULL text is empty; an empty or blank text has an empty fingerprint, which is like another empty one (1)
and unlike all others (0); NULL keys come last; rows that share a key are ordered by a hash of their text; equal rows
are one document for "next" and get equal results, one row each; a single document is its own next; an empty table
gives an empty result. Only the key and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlint.llm.common import globally_ordered, stored

K = 5
#: Characters of scripts without spaces; and those after which a long run is cut, about a quarter of its characters.
UNSPACED = r"\u0E00-\u0EFF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF"
CUTS = r"AEIOUaeiou0369+/=.,;:&?_-"
PIECE = rf"(?<!\S)[^\s{UNSPACED}]{{1,16}}(?!\S)|[{UNSPACED}]|[^\s{UNSPACED}]{{2,15}}?[{CUTS}]|[^\s{UNSPACED}]{{1,16}}"


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the entries of the fingerprint of ``text`` as an array of integers under ``name``.

    The steps are columns of their own, since each is used many times by the next.
    """
    pieces = F.transform(F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x))
    edge = [F.lit(i).cast("long") for i in range(1, 2 * K - 1)]
    df = df.withColumn("__pieces", pieces)
    df = df.withColumn("__marked", F.when(F.size("__pieces") > 0, F.concat(
        F.array(*edge[: K - 1]), "__pieces", F.array(*edge[K - 1:]))).otherwise(F.array().cast("array<bigint>")))
    run = [lambda i, j=j: F.get("__marked", i + j) for j in range(K)]
    starts = F.when(F.size("__marked") >= K, F.sequence(F.lit(0), F.size("__marked") - K)).otherwise(
        F.array().cast("array<int>"))
    df = df.withColumn("__anchors", F.filter(starts, lambda i: F.least(run[0](i), run[-1](i)) <= F.least(
        *(r(i) for r in run[1:-1]))))
    entry = F.transform("__anchors", lambda p, j: F.hash(
        *(r(p) for r in run), F.coalesce(F.get("__anchors", j + 1) - p, F.lit(0))))
    return df.withColumn(name, entry).drop("__pieces", "__marked", "__anchors")


def likeness(one: str, other: str) -> Column:
    both = F.size(F.array_distinct(one)) + F.size(F.array_distinct(other))
    return F.when(both == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(one, other)) / both)


def as_text(entries: str) -> Column:
    return F.array_join(F.col(entries).cast("array<string>"), " ")


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key and ``fingerprint``."""
    own = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return with_fingerprint(own, "__text", "__entries").select(
        F.col("__key").alias(key), as_text("__entries").alias("fingerprint"))


def following(ids: DataFrame) -> DataFrame:
    """``ids`` with ``next``: the id of the next row by ``key`` descending (NULL last), then ``digest``; after the
    last the first."""
    ordered = globally_ordered(ids, [F.col("key").desc_nulls_last(), F.col("digest"), F.col("id")])
    firsts = ordered.where(F.col("__at") == 1).select("__part", F.col("id").alias("first"))
    over = Window.orderBy("__part")  # one row per partition
    borders = firsts.select("__part", F.coalesce(F.lead("first").over(over), F.first("first").over(
        over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("beyond"))
    inside = Window.partitionBy("__part").orderBy("__at")
    return ordered.join(F.broadcast(borders), "__part").select(
        "id", "key", "n", "copies", F.coalesce(F.lead("id").over(inside), "beyond").alias("next"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_chars, edited_sha256, both fingerprints, near_edited, near_next.

    The edited text is the text with its last floor(n / 2) characters replaced by as many first characters of the
    next document, or by all it has.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("digest", F.xxhash64("text"))
    own = own.withColumn("id", F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("")), "digest"))
    ids = own.select("id", "key", "digest", F.length("text").alias("n")).groupBy("id").agg(
        F.min("key").alias("key"), F.min("digest").alias("digest"), F.min("n").alias("n"),
        F.count(F.lit(1)).alias("copies"))
    wanted = stored(following(ids), "next").select(
        F.col("next").alias("id"), F.col("id").alias("before"), "key", "copies",
        F.floor(F.col("n") / 2).cast("int").alias("m"))

    # Both joins read the same two columns, so the texts are shuffled once.
    texts = own.groupBy("id").agg(F.first("text").alias("text"))
    sent = with_fingerprint(texts.join(wanted, "id"), "text", "next_entries").select(
        F.col("before").alias("id"), "key", "copies", F.expr("substring(text, 1, m)").alias("tail"), "next_entries")
    pairs = texts.join(sent, "id").withColumn("n_chars", F.length("text").cast("long"))
    pairs = pairs.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 2))"), "tail"))
    pairs = with_fingerprint(pairs, "text", "entries")
    pairs = with_fingerprint(pairs, "edited", "edited_entries")
    measured = pairs.select(
        F.col("key").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text("entries").alias("fingerprint"), as_text("edited_entries").alias("edited_fingerprint"),
        likeness("entries", "edited_entries").alias("near_edited"), likeness("entries", "next_entries").alias("near_next"),
        F.explode_outer(F.sequence(F.lit(1), F.col("copies"))).alias("__copy"))
    return measured.drop("__copy")
