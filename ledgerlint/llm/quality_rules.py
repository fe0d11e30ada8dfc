"""Quality rules as a bitmask ledger: every rule is evaluated once, its outcome is one bit beside what was measured.

``ledger`` measures each whole text in one streamed pass and sets bit i of ``failed`` where rule i fails. The table can be
stored. A policy is then a number: ``apply`` decides by bitwise tests, any number of policies and versions from one ledger.
``ablation`` says what each rule of a policy does: rows are first summed by their failure bits (combined inside each
task, so a hot source or pattern of bits sends one row per task), and all leave-one-out counts follow from these few sums.

A rule compares whole numbers, so its outcome is the same everywhere. Bits never change their meaning: a changed rule
gets a new bit, a changed policy a new version.

Words are runs of characters other than space and U+0009 to U+000D. NULL or empty texts have no words and fail
``few_words``; all measurements are 0. Texts of any length are measured whole, one at a time. NULL keys and repeated rows
are kept, each with its own row. An empty table gives an empty result. Only the key, the text and the columns asked
for are read, so other columns cannot clash; ``carry`` columns must not have the names of measurements.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_cased",
            "n_top_word", "n_letter_words", "n_ellipsis_lines")
SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """Fails where 100 * part > percent * whole, or, with ``least``, where 100 * part < percent * whole."""

    bit: int
    name: str
    part: str
    percent: int
    whole: str | int
    least: bool = False

    def fails(self) -> Column:
        part = F.col(self.part) * 100
        bound = (F.lit(self.whole) if isinstance(self.whole, int) else F.col(self.whole)) * self.percent
        return part < bound if self.least else part > bound

    def sql(self) -> str:
        return f"100 * {self.part} {'<' if self.least else '>'} {self.percent} * {self.whole}"


#: The bits, in order. Shares are of the words, lines or ASCII letters of the text.
RULES = (
    Rule(0, "few_words", "n_words", 5000, 1, least=True),
    Rule(1, "repeated_windows", "n_repeat_words", 50, "n_words"),
    Rule(2, "symbols", "n_symbols", 10, "n_words"),
    Rule(3, "duplicate_lines", "n_dup_lines", 50, "n_lines"),
    Rule(4, "short_words", "word_chars", 300, "n_words", least=True),
    Rule(5, "long_words", "word_chars", 1000, "n_words"),
    Rule(6, "capitals", "n_upper", 50, "n_cased"),
    Rule(7, "one_word", "n_top_word", 30, "n_words"),
    Rule(8, "few_letters", "n_letter_words", 60, "n_words", least=True),
    Rule(9, "ellipsis_lines", "n_ellipsis_lines", 30, "n_lines"),
    Rule(10, "many_symbols", "n_symbols", 30, "n_words"),
)
BITS = {rule.name: 1 << rule.bit for rule in RULES}
BASE = ("few_words", "repeated_windows")


def mask(*names: str) -> int:
    return sum(BITS[name] for name in names)


@dataclass(frozen=True)
class Policy:
    """Rejects a row that fails any rule of ``hard``, or more than ``allowed`` of the rules of ``soft``."""

    name: str
    version: int
    hard: int
    soft: int = 0
    allowed: int = 0

    def rejects(self, failed: Column, without: Column | int = 0) -> Column:
        """Whether these failures reject a row when the rules ``without`` do not count."""
        left = failed.bitwiseAND(F.bitwise_not(F.lit(without) if isinstance(without, int) else without).cast("bigint"))
        hard = left.bitwiseAND(F.lit(self.hard).cast("bigint")) != 0
        return hard | (F.bit_count(left.bitwiseAND(F.lit(self.soft).cast("bigint"))) > self.allowed)

    def sql(self, failed: str = "failed") -> str:
        return f"(({failed} & {self.hard}) <> 0 OR bit_count({failed} & {self.soft}) > {self.allowed})"


#: All versions stay, so that an old ledger can be judged as it was.
POLICIES = {
    (p.name, p.version): p
    for p in (
        Policy("web", 1, mask(*BASE, "symbols", "duplicate_lines", "capitals")),
        Policy("web", 2, mask(*BASE, "many_symbols", "duplicate_lines", "capitals", "one_word"),
               mask("symbols", "short_words", "long_words", "few_letters", "ellipsis_lines"), 1),
        Policy("web", 3, mask(*BASE, "symbols", "duplicate_lines", "capitals", "one_word"),
               mask("short_words", "long_words", "few_letters", "ellipsis_lines"), 1),
    )
}
CURRENT = POLICIES["web", 3]


def _classes() -> np.ndarray:
    """Per byte of UTF-8: 1 for blanks, 2 for letters (every non-ASCII character counts as one), else 0."""
    kind = np.zeros(256, np.uint8)
    kind[list(BLANK)] = 1
    kind[0x41:0x5B] = kind[0x61:0x7B] = 2
    kind[0x80:] = 2
    return kind


def _repeated(ids: np.ndarray, n_ids: int) -> int:
    """Words that lie in a window of three words which occurs twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * n_ids + ids[1:]
    if n_ids > 2_000_000:  # three numbers no longer fit into 63 bits: number the pairs first
        pair = np.unique(pair, return_inverse=True)[1]
    _, place, times = np.unique(pair[:-1] * n_ids + ids[2:], return_inverse=True, return_counts=True)
    again = times[place] > 1
    if not again.any():
        return 0
    inside = np.zeros(len(ids), bool)
    for shift in range(3):
        inside[shift : len(ids) - 2 + shift] |= again
    return int(inside.sum())


def measure(data: bytes, kind: np.ndarray) -> tuple[int, ...]:
    """The measurements of one text, given as UTF-8, in the order of MEASURES."""
    words = data.split()  # bytes are split at exactly the six blanks
    if not words:
        return (0,) * len(MEASURES)
    octets = np.frombuffer(data, np.uint8)
    seen = np.bincount(octets, minlength=256)
    characters = len(octets) - int(seen[0x80:0xC0].sum())
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    kinds = kind[octets]
    inside = kinds != 1
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    lettered = int(np.count_nonzero(np.maximum.reduceat(kinds, starts) == 2))
    upper, lower = int(seen[0x41:0x5B].sum()), int(seen[0x61:0x7B].sum())
    return (
        len(words), characters - int(seen[list(BLANK)].sum()), int(seen[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)), _repeated(ids, len(numbers)), len(lines), upper, upper + lower,
        int(np.bincount(ids).max()), lettered,
        sum(line.rstrip().endswith((b"...", "…".encode())) for line in lines),
    )


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: key, ``carry`` columns, the measurements, and ``failed``, one bit per rule."""
    names = [key, *carry]
    source = docs.select(*[F.col(c) for c in names], F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))
    schema = docs.select(*[F.col(c) for c in names], *[F.lit(0).cast("bigint").alias(m) for m in MEASURES]).schema

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _classes()
        for batch in batches:
            texts = batch.column(len(names))
            rows = np.array([measure(t.as_buffer().to_pybytes(), kind) for t in texts], np.int64)
            rows = rows.reshape(len(texts), len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], *[pa.array(rows[:, i]) for i in range(len(MEASURES))]],
                names=[*names, *MEASURES])

    bits = [F.when(rule.fails(), F.lit(1 << rule.bit).cast("bigint")).otherwise(0) for rule in RULES]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return source.mapInArrow(measured, schema).withColumn("failed", total)


def apply(rows: DataFrame, policy: Policy = CURRENT, name: str = "kept") -> DataFrame:
    """A ledger with the verdict of a policy."""
    return rows.withColumn(name, ~policy.rejects(F.col("failed")))


def failure_names(failed: Column) -> Column:
    """The names of the failed rules, in the order of their bits."""
    return F.array_compact(F.array(*[
        F.when(failed.bitwiseAND(F.lit(BITS[r.name]).cast("bigint")) != 0, r.name) for r in RULES]))


def patterns(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, failed, n_rows, n_words): a ledger summed by its failure bits, at most one row per pattern that occurs."""
    return rows.groupBy(*by, "failed").agg(F.count("*").alias("n_rows"), F.sum("n_words").alias("n_words"))


def ablation(rows: DataFrame, policy: Policy = CURRENT, by: tuple[str, ...] = ()) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows only it rejects, and what is kept with and without it.

    Every rule is judged on the same few sums, by clearing its bit: no row is looked at again.
    """
    used = [r for r in RULES if (policy.hard | policy.soft) >> r.bit & 1]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit"))
                               for r in used]))
    judged = patterns(rows, by).select("*", each.alias("r")).select(*by, "failed", "n_rows", "n_words", "r.*")
    kept, without = ~policy.rejects(F.col("failed")), ~policy.rejects(F.col("failed"), F.col("bit"))

    def total(condition: Column, of: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(of))), F.lit(0))

    return judged.groupBy(*by, "rule", "bit").agg(
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0, "n_rows").alias("n_failed"),
        total(~kept & without, "n_rows").alias("n_only_this"),
        total(kept, "n_rows").alias("n_kept"),
        total(without, "n_rows").alias("n_kept_without"),
        total(kept, "n_words").alias("words_kept"),
        total(without, "n_words").alias("words_kept_without"),
    )


def compare(rows: DataFrame, old: Policy, new: Policy, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows by their verdict under two policies, from the same sums."""
    was, is_now = ~old.rejects(F.col("failed")), ~new.rejects(F.col("failed"))
    return patterns(rows, by).groupBy(*by, was.alias("kept_before"), is_now.alias("kept_now")).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_words").alias("n_words"))


def shared_failures(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Per group: the rules that every row fails, and those that any row fails."""
    return patterns(rows, by).groupBy(*by).agg(
        F.bit_and("failed").alias("failed_by_all"), F.bit_or("failed").alias("failed_by_any"),
        F.sum("n_rows").alias("n_rows"))


def report(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Per document: the measurements, whether it fails the base rules, and the verdict of the policy."""
    failed_base = F.col("failed").bitwiseAND(F.lit(mask(*BASE)).cast("bigint")) != 0
    judged = apply(ledger(docs), policy).withColumn("base_failed", failed_base)
    return judged.select(
        "doc_id", *MEASURES[:5], "base_failed", (~F.col("base_failed") & F.col("kept")).alias("kept"),
        *MEASURES[5:], "failed")
