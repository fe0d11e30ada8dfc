"""Near-duplicate text: pairs of values that are almost, but not exactly, equal.

The comparison works on distinct lower-cased values, so copies cost nothing: a pair of values that
occur n and m times stands for n*m pairs of rows. No pair is missed and no value has a limit on its partners.

Short values, up to the length where this takes ``VARIANTS`` rows a value (12 characters for Indel, 16 for Edits), meet by what
is left of them: two values of given lengths are similar only if they have a certain number of characters in common, in
order, so each leaves out as many as it has more, in all possible ways, and equal remainders meet. Such pairs are
(nearly) the result, however dense the values are: numbers, codes and words have no template to fear there.

Pairs with a longer value come from a segment index. The shorter value of a pair is cut into one more piece than the edits its longest
partner may need, so one piece at least is unchanged; and there is one whose number bounds the edits before it, and with them
how far it has moved. The longer value therefore looks up only the pieces that can be meant: per possible length of a
partner, piece number and shift, the characters at that place. Pairs that meet are scored, first by a bounded edit
distance in the JVM.

Some pieces say nothing: those of a template ("https://", "Task ") are in most values, and a piece that joins more than
``HOT_PAIRS`` pairs is not joined. Values with such a piece, and values above ``LONGEST`` characters, whose pieces would be
too many, meet in cells instead. They are dealt into blocks of bounded size, in rows and in characters, by length; two blocks
meet only if their lengths allow similar values. A cell (a pair of blocks) compares character counts as matrices: two similar
values share, with multiplicity, at least t characters, where t follows from the two lengths. Pairs that do are
scored there too, those of values of up to 256 characters many at once, and handed on in parts of bounded size, so that a cell gives
the result (but for edits between longer values, which the JVM counts). Cells are of equal size
whatever the values look like, and nothing is shuffled there but the values. Their counting grows with the square of the
values concerned, at some hundred million pairs of short values per second and core; short values take no part in it but as partners of longer ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlint.functions.similarity import indel_score, pairs_sharing_characters
from ledgerlint.functions.values import named, value_digest
from ledgerlint.operators.findings import RowKey, member_findings
from ledgerlint.operators.skew import join_to_groups
from ledgerlint.session import stored

#: Values above this length, and those that can be their partners, are not cut into pieces.
LONGEST = 48
#: Up to so many remainders a value, short values meet by these. Results do not depend on it.
VARIANTS = 100
#: A piece that would join more pairs than this is left to the cells.
HOT_PAIRS = 100_000
#: Up to so many values, a few cells are cheaper than an index. Results do not depend on it.
FEW_VALUES = 2000
#: The most characters in one block of a cell.
BLOCK_CHARACTERS = 2_000_000
BAND_WIDTH = 1.1
BLOCK = 1000
CELL = ("low_band", "low_block", "high_band", "high_block")
TINY = 1e-9


@dataclass(frozen=True)
class Indel:
    """Whole-number similarity from insertions and deletions; at_least <= score < 100."""

    at_least: int = 88

    @property
    def ratio(self) -> float:
        return (self.at_least - 0.5) / 100

    def edits(self, shorter: Column, longer: Column) -> Column:
        """The most insertions and deletions between similar values of these lengths."""
        return F.floor((shorter + longer) * F.lit(1 - self.ratio) + TINY).cast("int")

    def in_common(self, shorter: int, longer: int) -> int:
        """The fewest characters, in order, that similar values of these lengths have in common."""
        return math.ceil((shorter + longer - math.floor((shorter + longer) * (1 - self.ratio) + TINY)) / 2)

    def partner_lengths(self, length: Column) -> tuple[Column, Column]:
        share = self.ratio / (2 - self.ratio)
        return F.ceil(length * F.lit(share) - TINY), F.floor(length / F.lit(share) + TINY)

    @property
    def shares(self) -> tuple[float, float]:
        """Two values have at least x times both lengths plus y times the longer one in common."""
        return self.ratio / 2, 0.0

    by_edits = False

    def score(self, a: Column, b: Column, exact: Column | None = None, sizes: tuple[Column, Column] | None = None) -> Column:
        """The similarity; ``exact`` has the characters in common, in order, and ``sizes`` both lengths, if they are known."""
        return indel_score(a, b, self.ratio, exact, None if sizes is None else sizes[0] + sizes[1])

    def accepts(self, score: Column, a: Column, b: Column) -> Column:
        return (score >= self.at_least) & (score < 100)


@dataclass(frozen=True)
class Edits:
    """Levenshtein distance of at most ``share`` of the longer length."""

    share: float = 0.12

    def limit(self, length: Column) -> Column:
        return F.floor(length * F.lit(self.share) + TINY).cast("int")

    def edits(self, shorter: Column, longer: Column) -> Column:
        """The most edits between similar values of these lengths."""
        return self.limit(longer)

    def in_common(self, shorter: int, longer: int) -> int:
        """The fewest characters, in order, that similar values of these lengths have in common."""
        return longer - math.floor(longer * self.share + TINY)

    def partner_lengths(self, length: Column) -> tuple[Column, Column]:
        return F.ceil(length * F.lit(1 - self.share) - TINY), F.floor(length / F.lit(1 - self.share) + TINY)

    @property
    def shares(self) -> tuple[float, float]:
        return 0.0, 1 - self.share

    by_edits = True

    def score(self, a: Column, b: Column, exact: Column | None = None, sizes: tuple[Column, Column] | None = None) -> Column:
        """The distance, or -1 as soon as it is certain to exceed the limit; ``exact`` has it where it is known, ``sizes``
        both lengths if they are known."""
        limit = self.limit(F.greatest(*(sizes or (F.char_length(a), F.char_length(b)))))
        counted = F.call_function("levenshtein", a, b, limit)
        return counted if exact is None else F.when(exact.isNull(), counted).when(exact <= limit, exact).otherwise(-1)

    def accepts(self, score: Column, a: Column, b: Column) -> Column:
        return score >= 0


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """(value, n_rows): lower-cased non-null values with their frequency."""
    return (
        df.where(named(column).isNotNull())
        .groupBy(F.lower(named(column).cast("string")).alias("value"))
        .agg(F.count("*").alias("n_rows"))
        .where(F.col("value") != "")
    )


def lowered_counts(counts: DataFrame, column: str) -> DataFrame:
    """The same from value counts of several columns."""
    own = counts.where((F.col("column") == column) & F.col("value").isNotNull())
    return own.groupBy(F.lower("value").alias("value")).agg(F.sum("n").alias("n_rows")).where(F.col("value") != "")


def _int(column: Column) -> Column:
    return column.cast("int")


def _places(piece: Column, pieces: Column, length: Column) -> tuple[Column, Column]:
    """(start, length) of a piece, from 0, of a value of this length cut into equal pieces."""
    start = _int(F.floor(piece * length / pieces))
    return start, _int(F.floor((piece + 1) * length / pieces)) - start


def _own_pieces(values: DataFrame, metric) -> DataFrame:
    """Each value's pieces as ``key``, made of the value's length, the number of the piece and its characters."""
    length, piece = F.col("length"), F.col("piece")
    most = metric.edits(length, _int(F.greatest(metric.partner_lengths(length)[1], length)))
    cut = values.select("*", (most + 1).alias("pieces")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    start, size = _places(piece, F.col("pieces"), length)
    return cut.select(F.xxhash64(length, piece, F.substring("value", start + 1, size)).alias("key"), *values.columns)


def _looked_up(values: DataFrame, metric) -> DataFrame:
    """All pieces, as ``key``, that a value of no more characters may have left unchanged in this one.

    A piece may come up more than once, where the same characters stand at several places.
    """
    carried = values.columns
    low = _int(F.greatest(metric.partner_lengths(F.col("length"))[0], F.lit(1)))
    partner, piece, longer = F.col("partner"), F.col("piece"), F.col("length")
    edits = metric.edits(partner, longer)
    most = metric.edits(partner, _int(F.greatest(metric.partner_lengths(partner)[1], partner)))
    met = values.select("*", F.explode(F.sequence(F.least(low, longer), longer)).alias("partner"))
    met = met.select("*", (most + 1).alias("pieces"), edits.alias("edits"), (longer - partner).alias("more"))
    met = met.where("more <= edits").select("*", F.explode(F.sequence(F.lit(0), F.least("edits", F.col("pieces") - 1))).alias("piece"))
    # Of the first pieces, one is unchanged with as many edits before it as its number, so at most edits - number after it;
    # and in all there are (edits - more) / 2 deletions and (edits + more) / 2 insertions at most.
    edits, more = F.col("edits"), F.col("more")
    back = F.greatest(-piece, more - (edits - piece), -_int(F.floor((edits - more) / 2)))
    on = F.least(piece, more + (edits - piece), _int(F.floor((edits + more) / 2)))
    start, size = _places(piece, F.col("pieces"), partner)
    met = met.where(back <= on).select(
        *met.columns, size.alias("size"), F.greatest(start + back, F.lit(0)).alias("first"),
        F.least(start + on, longer - size).alias("last"))
    met = met.where("first <= last").select("*", F.explode(F.sequence("first", "last")).alias("at"))
    found = F.substring("value", F.col("at") + 1, F.col("size"))
    return met.select(F.xxhash64(partner, piece, found).alias("key"), *carried)


def _left_out(metric) -> dict[int, list[tuple[int, int]]]:
    """{length: [(a partner's length, characters to leave out)]} of the values that meet by remainders."""
    known: dict = {}
    for longest in range(1, LONGEST + 1):
        common = {(n, m): metric.in_common(min(n, m), max(n, m)) for n in range(1, longest + 1) for m in range(1, longest + 1)}
        tried = {n: [(m, n - common[n, m]) for m in range(1, longest + 1) if common[n, m] <= min(n, m) and (n, n) != (m, common[n, m])]
                 for n in range(1, longest + 1)}
        if min(common.values()) < 1 or any(sum(math.comb(n, out) for _, out in partners) > VARIANTS for n, partners in tried.items()):
            break
        known = tried
    return known


def _remainders(values: DataFrame, known: dict) -> DataFrame:
    """Each value once per remainder and partner's length, as ``key``, made of the two lengths and the remainder."""
    per_length = F.create_map(*[x for n, partners in known.items() for x in (F.lit(n), F.array(*[
        F.struct(F.lit(m).alias("partner"), F.lit(out).alias("out")) for m, out in partners]).cast("array<struct<partner:int,out:int>>"))])
    rest, out, at, place = (F.col(c) for c in ("rest", "out", "at", "place"))
    cut = values.select("*", F.inline(per_length[F.col("length")])).select("*", F.col("value").alias("rest"), F.lit(1).alias("at"))
    for _ in range(max((out for partners in known.values() for _, out in partners), default=0)):
        size = F.char_length("rest")
        places = cut.select("*", F.explode(F.when(out > 0, F.sequence(at, size - out + 1)).otherwise(F.array(F.lit(0)))).alias("place"))
        # Of equal characters in a row the first ones are left out: any remainder comes about that way.
        places = places.where((place == 0) | (place == at) | (F.substring(rest, place, 1) != F.substring(rest, place - 1, 1)))
        shorter = F.concat(F.substring(rest, F.lit(1), place - 1), F.substring(rest, place + 1, size))
        cut = places.select(
            *values.columns, "partner", (out - 1).alias("out"), F.when(place > 0, shorter).otherwise(rest).alias("rest"),
            F.greatest(place, F.lit(1)).alias("at"))
    lengths = F.least("length", "partner"), F.greatest("length", "partner")
    return cut.select(F.xxhash64(*lengths, "rest").alias("key"), "partner", *values.columns)


def _met_by_remainders(values: DataFrame, known: dict) -> DataFrame:
    """(value_a, value_b, n_a, n_b): pairs of values with an equal remainder; a pair may come up several times."""
    cut = _remainders(values, known)
    return _met(cut.where("length <= partner"), cut.where("length >= partner"))


def _met(owners: DataFrame, seekers: DataFrame, more: Column | None = None) -> DataFrame:
    """(value_a, value_b, n_a, n_b): owners and seekers with the same key, where the seeker is the longer value."""
    a, b = owners.alias("a"), seekers.hint("merge").alias("b")
    value_a, value_b = F.col("a.value"), F.col("b.value")
    longer = (F.col("a.length") < F.col("b.length")) | ((F.col("a.length") == F.col("b.length")) & (value_a < value_b))
    met = a.join(b, F.col("a.key") == F.col("b.key")).where(longer if more is None else longer & more)
    first = value_a < value_b
    return met.select(
        F.when(first, value_a).otherwise(value_b).alias("value_a"), F.when(first, value_b).otherwise(value_a).alias("value_b"),
        F.when(first, F.col("a.n_rows")).otherwise(F.col("b.n_rows")).alias("n_a"),
        F.when(first, F.col("b.n_rows")).otherwise(F.col("a.n_rows")).alias("n_b"))


def band(length: Column) -> Column:
    """Number of the length band; bands have a constant ratio, at every length."""
    return F.floor(F.log(length.cast("double")) / F.lit(math.log(BAND_WIDTH))).cast("int")


def _cells(values: DataFrame, metric, block: int) -> DataFrame:
    """Every value in all cells where it can meet a partner: the cell's two blocks, the value's side, the value."""
    length = F.char_length("value")
    low, high = metric.partner_lengths(length)
    banded = values.select("value", "n_rows", band(length).alias("own"), F.sequence(
        band(F.greatest(low, F.lit(1))), band(F.greatest(high, F.lit(1)))).alias("span"))
    # One row per band, a few hundred at any size of the table: bands grow by a tenth. Blocks of long values hold fewer.
    longest = F.pow(F.lit(BAND_WIDTH), F.col("own") + 1)
    held = F.greatest(F.least(F.lit(float(block)), F.lit(BLOCK_CHARACTERS) / longest), F.lit(1.0))
    sizes = banded.groupBy("own").agg(F.count("*").alias("n")).select("own", F.ceil(F.col("n") / held).cast("int").alias("blocks"))
    own = F.broadcast(sizes.select("own", "blocks"))
    other = F.broadcast(sizes.select(F.col("own").alias("partner"), F.col("blocks").alias("partner_blocks")))
    dealt = banded.join(own, "own").withColumn(
        "block", F.pmod(F.xxhash64("value"), F.col("blocks").cast("bigint")).cast("int"))
    dealt = dealt.withColumn("partner", F.explode("span")).join(other, "partner")
    dealt = dealt.withColumn("partner_block", F.explode(F.sequence(F.lit(0), F.col("partner_blocks") - 1)))
    here = F.struct(F.col("own").alias("band"), "block")
    there = F.struct(F.col("partner").alias("band"), F.col("partner_block").alias("block"))
    return dealt.select(
        F.least(here, there).alias("low"), F.greatest(here, there).alias("high"),
        F.when(here == there, 0).when(here < there, 1).otherwise(2).alias("side"), "value", "n_rows",
    ).select(*[F.col(f"{end}.{part}").alias(f"{end}_{part}") for end in ("low", "high") for part in ("band", "block")],
             "side", "value", "n_rows")


def _met_in_cells(values: DataFrame, metric, block: int, n_values: int) -> DataFrame:
    """(value_a, value_b, n_a, n_b, exact, shorter, longer): pairs of values that share enough characters, in order if they
    are not long, and their lengths."""
    # Cells take far more time than their bytes suggest: keep all partitions, and one per block at least, so that a task's
    # share of the pairs grows no faster than the table.
    partitions = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_values // block))
    cells = _cells(values, metric, block).repartition(partitions, *CELL)
    return cells.groupBy(*CELL).applyInArrow(
        pairs_sharing_characters(*metric.shares, metric.by_edits),
        "value_a string, value_b string, n_a bigint, n_b bigint, exact int, shorter int, longer int")


def _hot_pieces(short: DataFrame, metric, hot: int, known: int) -> DataFrame:
    """Keys that join more than ``hot`` pairs; stored."""
    owners = _own_pieces(short, metric).groupBy("key").agg(F.count("*").alias("n_own"))
    seekers = _looked_up(short.where(F.col("length") > known), metric).groupBy("key").agg(F.count("*").alias("n_looked_up"))
    crowds = owners.join(seekers.hint("merge"), "key").where(F.col("n_own") * F.col("n_looked_up") > hot)
    return stored(crowds.select("key"), "pieces")


def _met_in_index(short: DataFrame, metric, hot: DataFrame | None, known: int) -> DataFrame:
    """(value_a, value_b, n_a, n_b): pairs of values with a piece in common, but for pairs of crowded values; a pair may
    come up several times."""
    owners, seekers = _own_pieces(short, metric), _looked_up(short.where(F.col("length") > known), metric)
    if hot is not None:
        owners = owners.join(hot.hint("merge"), "key", "left_anti")
    return _met(owners, seekers, ~(F.col("a.crowded") & F.col("b.crowded")))


def _crowded(values: DataFrame, metric, longest: int, hot: int, known: int) -> tuple[DataFrame, DataFrame | None]:
    """The values with ``crowded``: whether they meet each other in cells; and the pieces that are not joined."""
    long = metric.partner_lengths(F.col("length"))[1] > longest
    short = values.where(F.col("length") <= longest)
    pieces = _hot_pieces(short, metric, hot, known)
    if pieces.isEmpty():
        return values.withColumn("crowded", long), None
    with_hot = _own_pieces(short, metric).join(pieces.hint("merge"), "key", "left_semi").select("value").unionByName(
        _looked_up(short.where(F.col("length") > known), metric).join(pieces.hint("merge"), "key", "left_semi").select("value")).distinct()
    flagged = values.join(with_hot.withColumn("hot", F.lit(True)).hint("merge"), "value", "left")
    return stored(flagged.select(*values.columns, (long | F.col("hot").isNotNull()).alias("crowded")), "values"), pieces


def _candidates(
    values: DataFrame, metric, block: int = BLOCK, longest: int = LONGEST, hot: int = HOT_PAIRS, few: int = FEW_VALUES,
) -> tuple[DataFrame | None, DataFrame]:
    """Pairs that met by pieces or remainders (value_a, value_b, n_a, n_b), and those of the cells (_met_in_cells)."""
    values = stored(values.select("value", "n_rows", F.char_length("value").alias("length")), "values")
    n_values = values.count()
    if n_values <= few:
        return None, _met_in_cells(values, metric, block, n_values)
    left_out = _left_out(metric)
    known = max(left_out, default=0)
    value_a, value_b = F.col("value_a"), F.col("value_b")
    sizes = F.char_length(value_a), F.char_length(value_b)
    # The others are longer than ``known``, or have a partner that is.
    others = values.where(F.greatest(metric.partner_lengths(F.col("length"))[1], F.col("length")) > known)
    others, pieces = _crowded(others, metric, longest, hot, known)
    met = _met_in_index(others.where(F.col("length") <= longest), metric, pieces, known)
    if known:
        met = met.unionByName(_met_by_remainders(values.where(F.col("length") <= known), left_out))
    close = F.call_function("levenshtein", value_a, value_b, metric.edits(F.least(*sizes), F.greatest(*sizes))) >= 0
    in_cells = _met_in_cells(others.where("crowded"), metric, block, n_values).where(F.col("longer") > known)
    return met.where(close).dropDuplicates(["value_a", "value_b"]), in_cells


def candidate_pairs(values: DataFrame, metric=Indel(), **work) -> DataFrame:
    """(value_a, value_b, n_a, n_b, exact): pairs among which all similar ones are, each once; ``exact`` is what the cells
    have found about a pair, if anything (pairs_sharing_characters). The values are stored first.

    ``work`` (``block``, ``longest``, ``hot`` and ``few``) changes the work and these pairs, never which of them are similar.
    """
    met, in_cells = _candidates(values, metric, **work)
    in_cells = in_cells.drop("shorter", "longer")
    return in_cells if met is None else met.withColumn("exact", F.lit(None).cast("int")).unionByName(in_cells)


def near_pairs(values: DataFrame, metric=Indel(), **work) -> DataFrame:
    """(value_a, value_b, score, n_a, n_b) with value_a < value_b, over distinct values.

    ``work`` is that of candidate_pairs; the result does not depend on it. Pairs of the cells are scored by what these have
    found, so they do not pass through the function that scores the others.
    """
    value_a, value_b = F.col("value_a"), F.col("value_b")

    def scored(pairs: DataFrame, *found) -> DataFrame:
        return (
            pairs.withColumn("score", metric.score(value_a, value_b, *found))
            .where(metric.accepts(F.col("score"), value_a, value_b))
            .select("value_a", "value_b", "score", "n_a", "n_b")
        )

    met, in_cells = _candidates(values, metric, **work)
    in_cells = scored(in_cells, F.col("exact"), (F.col("shorter"), F.col("longer")))
    return in_cells if met is None else scored(met).unionByName(in_cells)


def near_values(pairs: DataFrame) -> DataFrame:
    """(value, partners): every value with a near-duplicate and its number of partner values."""
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("value_a").alias("value"), F.col("n_a").alias("n_rows")),
        F.struct(F.col("value_b").alias("value"), F.col("n_b").alias("n_rows")),
    )))
    return both.groupBy("value").agg(F.count("*").alias("partners"), F.max("n_rows").alias("n_rows"))


def near_duplicate_totals(df: DataFrame, column: str, metric=Indel()) -> DataFrame:
    """One row: row pairs, distinct-value pairs."""
    pairs = near_pairs(distinct_values(df, column), metric)
    return pairs.agg(
        F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("n_row_pairs"),
        F.count("*").alias("n_value_pairs"),
    )


def near_duplicates(df: DataFrame, column: str, key: RowKey, metric=Indel(), counts: DataFrame | None = None) -> DataFrame:
    """Findings for every row whose value has a near-duplicate in another row.

    ``metric`` compares values (Indel, Edits) or documents (documents.Shingles); ``counts`` are value counts
    (column, value, n) if an earlier pass has them. Rows meet their value by its digest, so
    long texts cross the network once, while they are made distinct.
    """
    if hasattr(metric, "near_values"):
        near = metric.near_values(df, column)
    else:
        values = distinct_values(df, column) if counts is None else lowered_counts(counts, column)
        near = near_values(near_pairs(values, metric)).select(
            value_digest(F.col("value")).alias("__value"), F.col("partners").alias("__partners"),
            F.col("n_rows").alias("__n_rows"))
    text = F.lower(named(column).cast("string"))
    rows = df.where(named(column).isNotNull()).select(*map(named, key.needed), value_digest(text).alias("__value"))
    return member_findings(
        join_to_groups(rows, near, ["__value"], "__n_rows", key.needed),
        key, "D3", "duplicate_hunter", "near_duplicates", [column], detail=F.col("__partners"))
