"""Spelling variants: words one edit apart, found through a reduced alphabet.

Letters are hashed to a few symbols. Two words one edit apart have reduced words that are equal or one edit apart, so each
reduced word's one-edit neighbourhood is generated and joined with the reduced vocabulary; a candidate counts if the words
themselves are one edit apart. The neighbourhood of a word does not depend on the size of its alphabet. Every pair is
generated from one side only: an insertion is a deletion seen from the other word, and of two reduced words that differ in
one symbol the one with the smaller symbol makes the other. Reduced words are 64-bit numbers, computed for all neighbours
of a word from running sums, so that a word of any length costs work in proportion to its length; equal numbers of different
words only cost a comparison.

Nothing grows with the square of a group. Occurrences are counted inside tasks first, so a word that fills a third of the
table sends one row per task. A reduced word that more than ``BUCKET`` words share (a vocabulary in few letters) is not joined:
the words in and around it are joined by exact keys instead, a word without its i-th character beside i, which only
words that differ in that character share, and a word without a character beside whole words.

A word's form is its near word with the most occurrences if these are many times its own; following forms to their end by
doubling steps gives its root. Counts grow at each step, so there is no cycle and few rounds.

NULL and empty texts have no words; a NULL key counts as empty where occurrences are drawn. Ties go to the word that is
smaller in code-point order. Repeated rows count as often as they occur. Texts and runs of any length are read whole. An
empty table gives an empty result. Only key and text are read, so other columns cannot clash. The vocabulary and the rounds
are stored below the shared folder, so nothing is recomputed from the texts when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlint.llm.common import lower_ascii, stored

LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH = 7
MIN_COUNT = 2
DROP_ONE_IN = 31
RATIO = 10
SYMBOLS = 8
BUCKET = 1000
#: Characters whose neighbours are computed at once.
SLICE = 20_000
#: Low bits of a reduced word's number that hold a check sum of the word's letters; the others are joined on.
CHECK_BITS = 16
#: One byte per letter (by its low byte) for the check sums, scattered so that sums of letters do not add up by chance.
_WEIGHTS = (np.arange(256, dtype=np.uint32) ** 3 * np.uint32(2654435761) >> np.uint32(20)) & np.uint32(0xFF)
#: An odd number and its inverse: reduced words are polynomials in it, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """One row per run of letters, lower-cased (A-Z); a fixed share of them loses one character.

    Runs below ``least`` characters cannot become words and are left to the pattern.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))
    found = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.explode(runs).alias("run"))
    run, h = lower_ascii(F.col("run")), F.col("h")
    drawn = found.select(run.alias("run"), F.crc32(F.concat("name", F.lit(":"), run)).alias("h"))
    place = F.pmod(h, F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    return drawn.select(F.when(h % DROP_ONE_IN == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least: int = MIN_LENGTH, times: int = MIN_COUNT) -> DataFrame:
    """(word, n, id) of the words that are long and frequent enough."""
    return (
        words.where(F.char_length("word") >= least)
        .groupBy("word").agg(F.count("*").alias("n"))
        .where(F.col("n") >= times)
        .select("word", "n", F.xxhash64("word").alias("id"))
    )


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _symbols(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The symbols 1 to ``symbols`` of code points."""
    return (((codes * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(symbols) + np.uint32(1)).astype(np.uint64)


def neighbourhoods(words: list[str], symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, owner, keys): the reduced words as numbers, and the neighbours that each word generates.

    These are all deletions, each once (of equal letters in a row the last goes), and all replacements by greater symbols.
    The low ``CHECK_BITS`` of a number are no part of the reduced word: they sum up the letters themselves, in a neighbour
    those but the letter edited, so that most words that meet by chance are told apart without their letters.
    """
    length = np.array([len(w) for w in words])
    codes = _codes("".join(words))
    s = _symbols(codes, symbols)
    letters = codes & np.uint32(0xFF)
    weight = (_WEIGHTS[letters] << 8 | letters).astype(np.uint64)
    start = np.concatenate(([0], np.cumsum(length)))
    owner = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(s)) - start[owner]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(length.max(initial=1)), BASE))))[place]
        term = s * power
        total = np.concatenate(([np.uint64(0)], np.cumsum(term)))
        before = total[:-1] - total[start[owner]]
        own = total[start[1:]] - total[start[:-1]]
        sums = _byte_sums(weight, start)
        last = np.ones(len(s), bool)
        last[:-1] = (codes[:-1] != codes[1:]) | (owner[:-1] != owner[1:])
        gone = before + (own[owner] - before - term) * INVERSE
        rest = _byte_difference(sums[owner], weight)
        owners, keys, checks = [owner[last]], [gone[last]], [rest[last]]
        for more in range(1, symbols):
            room = s + np.uint64(more) <= symbols
            owners.append(owner[room])
            keys.append((own[owner] + np.uint64(more) * power)[room])
            checks.append(rest[room])
    low = np.uint64((1 << CHECK_BITS) - 1)
    return own & ~low | sums, np.concatenate(owners), np.concatenate(keys) & ~low | np.concatenate(checks)


def _byte_sums(weights: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per word the sums of both bytes of its letters' weights, each modulo 256."""
    parts = []
    for byte in (weights >> np.uint64(8), weights & np.uint64(0xFF)):
        total = np.concatenate(([np.uint64(0)], np.cumsum(byte)))
        parts.append((total[start[1:]] - total[start[:-1]]) & np.uint64(0xFF))
    return parts[0] << np.uint64(8) | parts[1]


def _byte_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    high = ((a >> np.uint64(8)) - (b >> np.uint64(8))) & np.uint64(0xFF)
    return high << np.uint64(8) | (a - b) & np.uint64(0xFF)


def agrees(neighbour: Column, own: Column) -> Column:
    """Whether the letters may be one edit apart, by the low bits: they leave nothing (a letter deleted) or one letter."""
    low, high = (
        (F.shiftrightunsigned(own, n).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(neighbour, n).bitwiseAND(F.lit(255)) + 256) % 256
        for n in (0, 8))
    weights = F.array(*[F.lit(int(w)) for w in _WEIGHTS])
    return ((low == 0) & (high == 0)) | (F.get(weights, low.cast("int")) == high)


def _slices(words: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The words from a place on, some at a time: about ``SLICE`` characters, or one word."""
    texts, start, held = words.to_pylist(), 0, 0
    for i, word in enumerate(texts):
        if i > start and held + len(word) > SLICE:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(word)
    if texts:
        yield start, texts[start:]


def _reduced(words: DataFrame, symbols: int) -> DataFrame:
    """The vocabulary with ``key``, each word's reduced word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [neighbourhoods(some, symbols)[0] for _, some in _slices(batch.column(0))]
            if keys:
                found = pa.array(np.concatenate(keys).view(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], ["word", "n", "id", "key"])

    return words.mapInArrow(work, "word string, n bigint, id bigint, key bigint")


def _around(words: DataFrame, symbols: int) -> DataFrame:
    """(id, key): the neighbours that each reduced word generates."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_numpy()
            for at, some in _slices(batch.column(0)):
                _, owner, keys = neighbourhoods(some, symbols)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + owner]), pa.array(keys.view(np.int64))], ["id", "key"])

    return words.select("word", "id").mapInArrow(work, "id bigint, key bigint")


def one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def _ordered(a: Column, n_a: Column, b: Column, n_b: Column) -> list[Column]:
    first = a < b
    return [F.when(first, a).otherwise(b).alias("a"), F.when(first, n_a).otherwise(n_b).alias("n_a"),
            F.when(first, b).otherwise(a).alias("b"), F.when(first, n_b).otherwise(n_a).alias("n_b")]


def _exact_pairs(words: DataFrame) -> DataFrame:
    """All pairs one edit apart, by exact keys: for words whose reduced words say too little."""
    places = F.sequence(F.lit(1), F.char_length("word"))
    without = words.select(
        "word", "n", F.explode(places).alias("i")).withColumn(
        "rest", F.concat(F.substring("word", F.lit(1), F.col("i") - 1), F.substring("word", F.col("i") + 1, F.char_length("word"))))
    other = without.select(F.col("word").alias("other"), F.col("n").alias("n_other"), "i", "rest")
    replaced = without.join(other, ["i", "rest"]).where(F.col("word") < F.col("other"))
    whole = words.select(F.col("word").alias("rest"), F.col("n").alias("n_other"))
    longer = without.join(whole, "rest").withColumn("other", F.col("rest"))
    columns = _ordered(F.col("word"), F.col("n"), F.col("other"), F.col("n_other"))
    return replaced.select(*columns).unionByName(longer.select(*columns))


def near_pairs(words: DataFrame, symbols: int = SYMBOLS, bucket: int = BUCKET) -> DataFrame:
    """(a, n_a, b, n_b) with a < b: every pair of words of a stored vocabulary one edit apart, once.

    ``symbols`` and ``bucket`` change the work, never the result.
    """
    bare = F.shiftrightunsigned("key", CHECK_BITS)
    own = stored(_reduced(words, symbols).withColumns({"key": bare, "check": F.col("key")}), "reduced")
    around = _around(words, symbols)
    around = around.select("id", F.col("key").alias("neighbour"), bare.alias("key"))
    full = stored(own.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > bucket).select("key"), "full")
    crowded = not full.isEmpty()
    exact = None
    if crowded:
        inside = own.join(full, "key", "left_semi").select("id").unionByName(
            around.join(full, "key", "left_semi").select("id")).distinct()
        exact = _exact_pairs(words.join(inside, "id", "left_semi"))
        own = own.join(full, "key", "left_anti")
    other = own.select("key", F.col("word").alias("other"), F.col("n").alias("n_other"), "check")
    columns = _ordered(F.col("word"), F.col("n"), F.col("other"), F.col("n_other"))
    same = own.drop("check").join(other, "key").where(F.col("word") < F.col("other"))
    met = around.join(other, "key").where(agrees(F.col("neighbour"), F.col("check"))).select(
        "id", "other", "n_other").join(words, "id")
    pairs = same.where(one_edit(F.col("word"), F.col("other"))).select(*columns).unionByName(
        met.where(one_edit(F.col("word"), F.col("other"))).select(*columns))
    # Two routes to one pair: equal numbers of different neighbours, or a word of a full bucket.
    return (pairs.unionByName(exact) if exact is not None else pairs).dropDuplicates(["a", "b"])


def variants(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of all words that have a near word."""
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("n_other")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))))
    best = F.min(F.struct((-F.col("n_other")).alias("rank"), F.col("other").alias("word"))).alias("best")
    found = both.groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best)
    enough = -F.col("best.rank") >= ratio * F.col("n")
    return found.select("word", "n", "n_near", F.when(enough, F.col("best.word")).alias("form"),
                        F.when(enough, -F.col("best.rank")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of stored rows (word, form): forms followed to the last, in steps that double."""
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(reached.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def group(words: DataFrame, symbols: int = SYMBOLS, bucket: int = BUCKET, ratio: int = RATIO) -> DataFrame:
    """One row per word of a stored vocabulary (word, n, id): form, root, n, n_near, form_n."""
    found = stored(variants(words, near_pairs(words, symbols, bucket), ratio), "variants")
    ends = roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    known = found.drop("n").join(ends, "word", "left")
    return words.join(known, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def report(docs: DataFrame) -> DataFrame:
    """The words of whole texts with their spelling variants."""
    return group(stored(vocabulary(occurrences(docs)), "words"))
