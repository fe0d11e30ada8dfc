"""Near-duplicate documents: long texts that share most of their word shingles.

Edit distances of long texts say little and cost much; two documents are near here if the sets of their shingles (runs of
``words`` words) have a Jaccard similarity of at least ``at_least``. A text of fewer words is one shingle; a text without
words is near to nothing.

Every text is read twice and never kept. The first time it becomes a digest, the digest of its set and the ``bands`` keys of the
set, each made of the smallest hashes of its shingles under ``rows`` hash functions. Equal sets are brought together by
their digest, so one stands for all. Similar sets share no key with a probability below 1 in 100,000 (0.75, 32 bands of 4 rows).

The sets of a key go to the cell of the key's leader, the least of their numbers; keys of one leader are one cell, so that a set
travels once to each of its leaders and not once to each of its keys. Only texts of sets that share a key are read again
(a bitmap of fixed size tells most others apart), and only their shingles are stored and sent to cells. A cell counts what its sets
share, all of them at once, so no shingles travel by pairs. Pairs are verified on the whole sets, so no pair is
reported that is not near, and a pair of several cells counts in the one of its least common leader.

A cell of very many sets (a template) is no hot partition: its sets are dealt into blocks of about ``BLOCK`` sets and at most about
``BLOCK_SHINGLES`` shingles, and each pair of blocks is a cell of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlint.functions.values import named, value_digest
from ledgerlint.operators.skew import join_to_groups
from ledgerlint.session import stored

BLOCK = 512
BLOCK_SHINGLES = 1 << 19
#: Shingle hashes whose smallest values are computed at once.
SLICE = 1 << 14
#: Elements of the matrices by which a cell counts, and rows that it hands on at once.
ELEMENTS = 1 << 20
ROWS = 4096
#: 64-bit words of the bitmap that tells most texts without a partner apart.
WORDS = 1 << 17


@dataclass(frozen=True)
class Shingles:
    """Sets of word runs with a Jaccard similarity of at least ``at_least``."""

    words: int = 5
    at_least: float = 0.75
    bands: int = 32
    rows: int = 4

    def near_values(self, df: DataFrame, column: str) -> DataFrame:
        """(__value, __partners, __n_rows): digest of every text with a near one, the number of near texts, its rows."""
        texts = signed(df, column, self)
        sets = stored(texts.groupBy("id").agg(
            F.count("*").alias("n_texts"), F.min("digest").alias("digest"),
            F.any_value(F.struct("size", "keys")).alias("signature")).select("id", "n_texts", "digest", "signature.*"), "sets")
        met = stored(led(sets), "met")
        again = shingled(among(df.select(named(column).alias("text")), met), "text", self)
        around = near_counts(met, again, self)
        own = sets.select("id", "n_texts")
        # A set stands for all texts that have it: near are those of other sets, and the others of its own.
        groups = own.join(around, "id", "left").select(
            "id", "n_texts", (F.coalesce("near", F.lit(0)) + F.col("n_texts") - 1).alias("__partners")).where("__partners > 0")
        members = join_to_groups(texts.select("id", "digest", "n_rows"), groups, ["id"], "n_texts", ["digest"])
        return members.select(F.col("digest").alias("__value"), "__partners", F.col("n_rows").alias("__n_rows"))


def shingle_hashes(text: Column, words: int) -> Column:
    """The distinct 64-bit hashes of the shingles of a text, made of the hashes of their words."""
    def runs(hashed: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(hashed) - words, F.lit(0)))
        run = lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(words)])
        return F.when(F.size(hashed) > 0, F.array_distinct(F.transform(places, run))).otherwise(F.array().cast("array<bigint>"))

    # The hashes are the variable of an outer function, so they are made once and not again for every run.
    own = F.filter(F.split(text, r"[\s]+"), lambda w: w != "")
    return F.transform(F.array(F.transform(own, lambda w: F.xxhash64(w))), runs)[0]


def _set(text: Column, metric: Shingles) -> Column:
    return F.sort_array(shingle_hashes(text, metric.words))


def _set_id(hashes: Column) -> Column:
    return F.unhex(F.sha2(hashes.cast("string"), 256))


def shingled(df: DataFrame, column: str, metric: Shingles) -> DataFrame:
    """(digest, n_rows, hashes, id): every distinct text that has words, its shingles and an id of their set; stored."""
    lowered = F.lower(named(column).cast("string"))
    # A filter on the shingles would make them once more: texts without words go by a pattern.
    rows = df.where(lowered.rlike(r"[^\s]")).select(lowered.alias("text"))
    texts = rows.groupBy(value_digest(F.col("text")).alias("digest")).agg(
        F.count("*").alias("n_rows"), F.any_value("text").alias("text"))
    sets = texts.select("digest", "n_rows", _set(F.col("text"), metric).alias("hashes"))
    return stored(sets.withColumn("id", _set_id(F.col("hashes"))), "texts")


def signed(df: DataFrame, column: str, metric: Shingles) -> DataFrame:
    """(digest, n_rows, id, size, keys): every distinct text that has words, id, size and band keys of its set; stored."""
    lowered = F.lower(named(column).cast("string"))
    rows = df.where(lowered.rlike(r"[^\s]")).select(lowered.alias("text"))
    hashed = rows.select(value_digest(F.col("text")).alias("digest"), _set(F.col("text"), metric).alias("hashes"))
    keys = hashed.withColumn("id", _set_id(F.col("hashes"))).select("digest", "id", "hashes").mapInArrow(
        _keys(metric), "digest binary, id binary, size int, keys array<bigint>")
    texts = keys.groupBy("digest").agg(F.count("*").alias("n_rows"), F.any_value(F.struct("id", "size", "keys")).alias("set"))
    return stored(texts.select("digest", "n_rows", "set.*"), "signed")


def _keys(metric: Shingles):
    """An Arrow function from (digest, id, hashes) to (digest, id, size, keys)."""
    draw = np.random.default_rng(20)
    factor = draw.integers(1, 1 << 63, metric.bands * metric.rows, np.uint64) * np.uint64(2) + np.uint64(1)
    offset = draw.integers(0, 1 << 63, metric.bands * metric.rows, np.uint64)
    mixer = draw.integers(1, 1 << 63, metric.rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def smallest(hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), SLICE):
            mixed = hashes[at : at + SLICE, None] * factor + offset
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
        return least

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, ends = _flat(batch.column(2), np.uint64)
            with np.errstate(over="ignore"):
                least = np.stack([smallest(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])])
                parts = least.reshape(-1, metric.bands, metric.rows)
                keys = (((parts ^ (parts >> np.uint64(31))) * mixer).sum(axis=2)).astype(np.uint64)
            keys = pa.ListArray.from_arrays(
                np.arange(batch.num_rows + 1, dtype=np.int32) * metric.bands, keys.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int32)), keys],
                names=["digest", "id", "size", "keys"])

    return work


def _flat(lists: pa.ListArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all lists, and where each list ends, from 0."""
    return lists.flatten().to_numpy().view(kind), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))


def led(sets: DataFrame) -> DataFrame:
    """(digest, n_texts, size, leaders): the sets that share a key with another, with the leaders of those keys in order."""
    number = F.xxhash64("id")  # sets of the same number go to each other's cells, which changes no result
    keys = sets.select(number.alias("number"), F.explode("keys").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("number").alias("leader"), F.count("*").alias("members")).where("members > 1")
    own = keys.join(leaders, "key").groupBy("number").agg(F.sort_array(F.collect_set("leader")).alias("leaders"))
    light = sets.select("digest", "n_texts", "size", number.alias("number"))
    return light.join(own, "number").drop("number")


def among(texts: DataFrame, met: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose text may stand for one of the sets ``met``: all of those, and few others."""
    def place(digest: Column) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(WORDS * 64))

    word, bit = F.shiftright("place", 6), F.expr("shiftleft(1L, cast(place & 63 as int))")
    bits = met.select(place(F.col("digest")).alias("place")).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    rows = texts.withColumn("place", place(value_digest(F.lower(F.col("text").cast("string")))))
    return rows.join(F.broadcast(bits), word == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0).select("text")


def near_counts(met: DataFrame, texts: DataFrame, metric: Shingles) -> DataFrame:
    """(id, near): how many texts are in sets near to each set; only of sets that have one."""
    placed = met.withColumn("cell", F.explode("leaders"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    cells = placed.groupBy("cell").agg(blocks.alias("blocks"))
    # A set is in all pairs of blocks that hold its own.
    placed = placed.join(cells, "cell").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("digest", "n_texts", "leaders", "cell", F.least("own", "other").alias("low"),
                           F.greatest("own", "other").alias("high"), "own")
    rows = placed.join(texts.select("digest", "id", "hashes"), "digest").drop("digest")
    rows = rows.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    rows = rows.select("cell", "low", "high", "own", "id", "n_texts", "leaders", "hashes")
    found = rows.mapInArrow(_near_in_cells(metric), "id binary, near long")
    return found.groupBy("id").agg(F.sum("near").alias("near"))


def _shared(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many values each two sets share, exactly; the values of the i-th set lie from ``ends[i]`` to ``ends[i + 1]``.

    What a set shares with itself is not counted in full.
    """
    n = len(ends) - 1
    # Sums of ones are exact below 2 ** 24.
    kind = np.float32 if np.diff(ends).max(initial=0) < 1 << 24 else np.float64
    shared = np.zeros((n, n), kind)
    if not len(values):
        return shared
    order = np.argsort(values)
    owner, values = np.repeat(np.arange(n), np.diff(ends))[order], values[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    degree = np.diff(np.concatenate((starts, [len(values)])))
    # Values of many sets are counted as products of matrices, the others pair by pair.
    often = (degree > 1) & (degree * 16 >= n)
    at, width = np.flatnonzero(often), max(ELEMENTS // n, 1)
    for i in range(0, len(at), width):
        some = at[i : i + width]
        column = np.repeat(np.arange(len(some)), degree[some])
        inside = np.arange(len(column)) - np.repeat(np.cumsum(degree[some]) - degree[some], degree[some])
        ones = np.zeros((n, len(some)), kind)
        ones[owner[np.repeat(starts[some], degree[some]) + inside], column] = 1
        shared += ones @ ones.T
    for d in np.unique(degree[(degree > 1) & ~often]):
        at, width = starts[~often & (degree == d)], max(ELEMENTS // int(d) ** 2, 1)
        for i in range(0, len(at), width):
            sets = owner[at[i : i + width, None] + np.arange(d)]
            pairs = (sets[:, :, None] * n + sets[:, None, :]).ravel()
            shared += np.bincount(pairs, minlength=n * n).reshape(n, n).astype(kind)
    return shared


def _near_in_cells(metric: Shingles):
    """An Arrow function from the sets of cells, in order of cells, to (id, near), one row per cell and set with a near one."""

    def near(cell: int, low: int, high: int, own: np.ndarray, n_texts: np.ndarray, leaders, hashes) -> np.ndarray:
        shared = _shared(*hashes).astype(np.float64)
        size = np.diff(hashes[1]).astype(np.float64)
        pairs = shared >= (size[:, None] + size - shared) * metric.at_least - 1e-9
        np.fill_diagonal(pairs, False)
        if low < high:
            pairs &= own[:, None] != own
        if pairs.any():  # a pair with a lesser common leader counts there
            lesser = leaders[0] < cell
            ends = np.concatenate(([0], np.cumsum(lesser)))[leaders[1]]
            pairs &= _shared(leaders[0][lesser], ends) == 0
        return pairs @ n_texts

    def cells(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Of a batch of whole cells: ids and the texts near to them."""
        cell, low, high, own, _, n_texts = (batch.column(i).to_numpy() if i != 4 else None for i in range(6))
        (leaders, led_to), (hashes, ends) = _flat(batch.column(6), np.int64), _flat(batch.column(7), np.int64)
        edges = [*_edges(batch), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            found = near(
                cell[a], low[a], high[a], own[a:b], n_texts[a:b],
                (leaders[led_to[a] : led_to[b]], led_to[a : b + 1] - led_to[a]), (hashes[ends[a] : ends[b]], ends[a : b + 1] - ends[a]))
            some = np.flatnonzero(found)
            yield batch.column(4).take(pa.array(some + a)), found[some]

    def packed(done: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x for x, _ in done]), pa.array(np.concatenate([y for _, y in done]))],
                                          names=["id", "near"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same rows, cut between cells."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = _edges(batch)
            if held and not all(held[-1].column(i)[-1] == batch.column(i)[0] for i in range(3)):
                yield pa.concat_batches(held)
                held = []
            if held and len(edges) > 1:
                yield pa.concat_batches([*held, batch.slice(0, edges[1])])
                held, batch, edges = [], batch.slice(edges[1]), edges[1:] - edges[1]
            if edges[-1]:
                yield batch.slice(0, edges[-1])
            held.append(batch.slice(edges[-1]))
        if held:
            yield pa.concat_batches(held)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, rows = [], 0
        for batch in whole(batches):
            for ids, found in cells(batch):
                done.append((ids, found))
                rows += len(found)
                if rows >= ROWS:
                    yield packed(done)
                    done, rows = [], 0
        if rows:
            yield packed(done)

    return work


def _edges(batch: pa.RecordBatch) -> np.ndarray:
    """The rows of a batch at which its cells begin."""
    keys = [batch.column(i).to_numpy() for i in range(3)]
    return np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))))
