"""Near-duplicate documents by SetSketch registers, banding, joint likelihood estimates and full verification.

1. A document's set is its distinct 5-word shingles (64-bit hashes); documents with equal sets form a class, and only
   the class with the smallest id goes on. Copies are never compared with each other.
2. A sketch holds ``REGISTERS`` exponentially spaced truncated minima: register i is floor(1 - log_b h_i) of the
   smallest exponential variate h_i over the set, so registers merge by maximum. Bands of ``ROWS`` registers are
   hashed; documents that share a band are candidates. With 32 bands of 4, a pair at similarity 0.75 is missed with
   probability 5e-6 (a pair at 0.9 with 1e-15), and a link is only lost if no other path joins its ends.
3. No bucket is expanded into pairs. A bucket has a pivot (its smallest hash of id and band, so pivots differ between
   bands) and every member is paired with it. The similarity of a pair is estimated from both sketches and set sizes
   by maximum likelihood; pairs far below the threshold (``MARGIN``, more than six standard errors) are dropped. Of
   the others the likeliest of each document are verified on the full sets.
4. Components of the verified links are found by alternating star contraction. In buckets that still hold several
   components, members of the largest are held against the others, and the others against each other, in cells of
   at most two blocks of about ``BLOCK`` rows and ``BLOCK_SHINGLES`` shingles. A cell estimates pairs from the sketches
   in memory, a second pass brings the full sets of the documents in likely pairs and verifies them there, likeliest
   first. Where many likely pairs turn out not to be linked, as in a family of texts from one template, the rest of the
   cell is verified at once by products of membership matrices. Cells return links that join components, never pairs.
   This finishes the job: every pair that shares a band was either joined already, ruled out by its estimate, or
   verified.

Everything is keyed by class or band, pre-aggregated before it is shuffled, and joined with joins that the adaptive
skew handling can split. Stage results are tables below the shared folder; nothing is collected to the driver but
counts of links.

Defined cases: NULL or word-less texts have an empty set, no links and are kept; fewer than five words make one
shingle; rows that repeat an id are one node with several texts, so they share its component; a NULL id takes no part in links and keeps a NULL component. An
empty table gives an empty result. Only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlint.llm.common import stored

SHINGLE = 5
SIMILARITY = (75, 100)
ROWS = 4
BANDS = 32
REGISTERS = ROWS * BANDS
BASE = 1.001
TOP = 2**16 - 2
MARGIN = 0.5
LEAST_EQUAL = int(0.5 * REGISTERS)
BLOCK = 1000
#: Shingles of a block, 8 bytes each; a single longer document is a block of its own.
BLOCK_SHINGLES = 4_000_000
#: Shingles that one membership matrix of a cell covers.
MATRIX_COLUMNS = 4096
#: A step of a matrix product costs this part of a step of the comparison of two sorted sets.
MATRIX_GAIN = 400
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20
IDS_TO_BROADCAST = 1_000_000
_RANDOM = np.random.default_rng(4)
_OFFSET, _MULTIPLIER, _SECOND = _RANDOM.integers(0, 2**32, (3, REGISTERS, 1), dtype=np.uint32) | np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of ``text``."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(size, len(found))
    with np.errstate(over="ignore"):
        rolled = hashes[: len(found) - n + 1].copy()
        for i in range(1, n):
            rolled = _mix(rolled + np.uint64(0x9E3779B97F4A7C15)) + hashes[i : len(found) - n + 1 + i]
        return np.unique(_mix(rolled + np.uint64(n)))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes, as uint16; of a union, the maximum of the registers."""
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    narrow = (hashes >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(narrow), 512):  # a block of registers by elements stays in the cache
        spread = (narrow[start : start + 512] ^ _OFFSET) * _MULTIPLIER
        spread ^= spread >> np.uint32(15)
        spread *= _SECOND
        spread ^= spread >> np.uint32(16)
        np.minimum(least, spread.min(axis=1), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**32
    smallest = -np.log1p(-uniform) / 20.0  # rate 20 keeps sets of up to e^60 elements inside the registers
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def bands(registers: np.ndarray) -> list[int]:
    raw = registers.tobytes()
    step = 2 * ROWS
    return [xxhash.xxh3_64_intdigest(raw[i * step : (i + 1) * step], seed=i) - 2**63 for i in range(BANDS)]


def _likelihood(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
    """The logarithm of the likelihood of similarities, row by row, by the counts of larger, smaller and equal registers;
    and the largest similarity that the set sizes allow."""
    larger, smaller = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - larger - smaller
    u = n_a / (n_a + n_b)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def of(j: np.ndarray | float) -> np.ndarray:
        above, below = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return larger * np.log(above) + smaller * np.log(below) + equal * np.log(np.maximum(1 - above - below, 1e-12))

    return of, np.minimum(u / v, v / u)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity by maximum likelihood, row by row."""
    likelihood, high = _likelihood(a, b, n_a, n_b)
    low = np.zeros(len(high))
    for _ in range(40):  # the likelihood has one maximum
        left, right = low + (high - low) / 3, high - (high - low) / 3
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def reaches(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether ``estimate`` is at least ``least``: the likelihood has one maximum, so its slope there tells."""
    likelihood, high = _likelihood(a, b, n_a, n_b)
    return (high >= least) & (likelihood(least + 1e-6) >= likelihood(least - 1e-6))


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text in zip(batch["key"], batch["text"]):
            found = shingles(text)
            if len(found):
                registers = sketch(found)
                rows.append((key, len(found), xxhash.xxh3_128_digest(found.tobytes()), registers.tobytes(),
                             bands(registers)))
            else:
                rows.append((key, 0, None, None, []))
        yield pd.DataFrame(rows, columns=["key", "n", "class", "registers", "bands"])


def _shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"key": batch["key"], "set": [shingles(t).tobytes() for t in batch["text"]]})


def _hash(*columns) -> Column:
    return F.xxhash64(*columns)


def _likely(pairs: DataFrame) -> DataFrame:
    """``a``, ``b`` of the pairs whose estimated similarity is not far below the threshold."""
    least = MARGIN

    @F.pandas_udf("double")
    def estimated(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(ra):
            return pd.Series([], dtype="float64")
        left = np.frombuffer(b"".join(ra), np.uint16).reshape(len(ra), -1)
        right = np.frombuffer(b"".join(rb), np.uint16).reshape(len(rb), -1)
        return pd.Series(estimate(left, right, na.to_numpy(float), nb.to_numpy(float)))

    sizes = 100 * F.least("n_a", "n_b") >= SIMILARITY[0] * F.greatest("n_a", "n_b")
    scored = pairs.where(sizes).withColumn("likeness", estimated("r_a", "r_b", "n_a", "n_b"))
    return scored.where(F.col("likeness") >= least).select("a", "b", "likeness")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILARITY[1] * common >= SIMILARITY[0] * (len(x) + len(y) - common)


def _sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``key``, ``set`` of the given documents. The ids are broadcast only where they are counted to be few."""
    ids = stored(ids, "ids")
    ids = F.broadcast(ids) if ids.count() <= IDS_TO_BROADCAST else ids
    return stored(texts.join(ids, "key", "left_semi").mapInPandas(_shingled, "key long, set binary"), "sets")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that reach the similarity on their full sets."""
    sets = _sets(texts, pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("s_a")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("set").alias("s_b")), "b")

    @F.pandas_udf("boolean")
    def linked(one: pd.Series, other: pd.Series) -> pd.Series:
        sets = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(one, other))
        return pd.Series([_linked(x, y) for x, y in sets], dtype=bool)

    return both.where(linked("s_a", "s_b")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``key``, ``component`` (the smallest key reachable) of every key in ``links`` (a, b), by star contraction.

    Alternates connecting larger neighbours, then smaller ones, to the smallest neighbour until nothing changes; the
    number of rounds grows with the logarithm of the longest path. Rows per round never exceed the links.
    """
    edges = stored(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(_hash("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("key"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("key"), F.col("v").alias("component")).distinct())


def _star_pairs(sketches: DataFrame) -> DataFrame:
    """Every member of a bucket beside the bucket's pivot, once per pair."""
    members = sketches.select("key", F.posexplode("bands").alias("at", "h"))
    members = members.select("key", _hash("at", "h").alias("band"))
    pivot = members.groupBy("band").agg(
        F.min(F.struct(_hash("key", "band").alias("order"), "key")).alias("p"), F.count(F.lit(1)).alias("m"))
    pivot = pivot.where(F.col("m") > 1).select("band", F.col("p.key").alias("pivot"))
    return members.join(pivot, "band").where(F.col("key") != F.col("pivot")).select(
        F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()


def _with_sketches(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(
            F.col("key").alias(side), F.col("registers").alias(f"r_{side}"), F.col("n").alias(f"n_{side}")), side)
    return pairs


def _open_cells(sketches: DataFrame, joined: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, dealt into cells of at most two blocks.

    Members of a bucket's largest component never meet each other: the cells are pairs of a block of the others with
    a block of the largest component, or with another block of the others. A bucket with few others costs one copy
    of its members.
    """
    members = sketches.join(joined, "key", "left").select(
        "key", "n", F.coalesce("component", "key").alias("component"), F.posexplode("bands").alias("at", "h"))
    members = members.select("key", "n", "component", "at", _hash("at", "h").alias("band"))
    parts = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"))
    buckets = parts.groupBy("band").agg(
        F.max(F.struct("m", "component", "size")).alias("main"), F.sum("m").alias("m"), F.sum("size").alias("size"),
        F.count(F.lit(1)).alias("parts")).where(F.col("parts") > 1)
    rest = [F.col(c) - F.col(f"main.{c}") for c in ("m", "size")]
    blocks = [F.greatest(F.ceil(m / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_SHINGLES))).cast("int")
              for m, size in ((F.col("main.m"), F.col("main.size")), rest)]
    buckets = buckets.select("band", F.col("main.component").alias("main"), blocks[0].alias("mains"),
                             blocks[1].alias("others"))
    in_main = F.col("component") == F.col("main")
    dealt = members.join(buckets, "band").withColumn("block", F.when(
        in_main, F.pmod(_hash("key", "band"), F.col("mains").cast("long"))).otherwise(
        F.col("mains") + F.pmod(_hash("key", "band"), F.col("others").cast("long"))).cast("int"))
    others = F.sequence(F.col("mains"), F.col("mains") + F.col("others") - 1)
    partners = F.when(in_main, others).otherwise(F.concat(F.sequence(F.lit(0), F.col("mains") - 1), others))
    dealt = dealt.select("band", "at", "key", "component", "block", F.explode_outer(partners).alias("partner"))
    return dealt.select("band", "at", F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"),
                        "key", "component", "block").join(sketches.select("key", "n", "registers"), "key")


CELL = "band long, at int, i int, j int, key long, component long, block int, n long, registers binary"


CELL_COLUMNS = [c.split()[0] for c in CELL.split(", ")]
CELL_KEY = ("band", "i", "j")


def _by_cell(work, columns: list[str]):
    """A function over partitions sorted by cell: ``work`` gets a cell's rows, as slices of arrays, cell after cell.

    Most cells are tiny, so they are cut out of whole batches; a cell that goes over a batch's end waits for the rest.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def worked(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
            arrays = {c: rows[c].to_numpy() for c in rows.columns if c not in ("registers", "set")}
            arrays["registers"] = np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(len(rows), -1)
            if "set" in rows:
                arrays["set"] = rows["set"].to_numpy()
            found: list[tuple] = []
            for start, end in zip(cuts[:-1], cuts[1:]):
                if end - start > 1:
                    found += work({c: v[start:end] for c, v in arrays.items()})
            return pd.DataFrame(found, columns=columns)

        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            keys = rows[list(CELL_KEY)].to_numpy()
            starts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if len(starts):
                yield worked(rows.iloc[: starts[-1]], np.concatenate(([0], starts)))
                held = rows.iloc[starts[-1] :].reset_index(drop=True)
            else:
                held = rows
        if held is not None and len(held):
            yield worked(held, np.array([0, len(held)]))

    return run


def _cell_pairs(cell: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x, y and equal registers of a cell's likely pairs across components whose first common band is the cell's.

    Equal registers alone rule out nearly all pairs; the likelihood decides on the rest, some thousand at a time.
    """
    registers, component, block = cell["registers"], cell["component"], cell["block"]
    n, at = cell["n"].astype(float), int(cell["at"][0])
    size, diagonal = len(n), cell["i"][0] == cell["j"][0]
    # A band of four registers is one 64-bit number; pairs that share an earlier one are told apart before their registers.
    earlier = np.ascontiguousarray(np.ascontiguousarray(registers).view(np.uint64)[:, :at])
    xs, ys, scores = [], [], []
    step = max(1, 20_000 // size)
    for first in range(0, size, step):
        x, y = (v.ravel() for v in np.meshgrid(np.arange(first, min(size, first + step)), np.arange(size), indexing="ij"))
        keep = (component[x] != component[y]) & (4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y]))
        keep &= (y > x) if diagonal else (block[y] > block[x])
        x, y = x[keep], y[keep]
        if len(x) and at:
            keep = ~(earlier[x] == earlier[y]).any(1)
            x, y = x[keep], y[keep]
        if not len(x):
            continue
        same = registers[x] == registers[y]
        keep = same.sum(1) >= LEAST_EQUAL
        x, y, same = x[keep], y[keep], same[keep]
        if len(x):
            keep = reaches(registers[x], registers[y], n[x], n[y], MARGIN)
            xs.append(x[keep])
            ys.append(y[keep])
            scores.append(same[keep].sum(1))
    if not xs:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(scores)


def _needed(cell: dict) -> list[tuple]:
    """The rows of a cell that are in a likely pair."""
    x, y, _ = _cell_pairs(cell)
    return [tuple(cell[c][r].tobytes() if c == "registers" else cell[c][r] for c in CELL_COLUMNS)
            for r in np.unique(np.concatenate([x, y])).astype(np.int64)]


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Exact sizes of the intersections of all pairs x, y of the sets, by products of membership matrices.

    None where that would cost more than comparing the sorted sets. Only shingles of several sets are columns.
    """
    rows = np.unique(np.concatenate([x, y]))
    sizes = np.array([len(sets[r]) for r in rows])
    _, column, held = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    number = np.cumsum(held > 1) - 1
    columns = int((held > 1).sum())
    compared = sizes[np.searchsorted(rows, x)].sum() + sizes[np.searchsorted(rows, y)].sum()
    if len(rows) ** 2 * columns > MATRIX_GAIN * compared:
        return None
    row, column = np.repeat(np.arange(len(rows)), sizes), np.where(held[column] > 1, number[column], -1)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(rows), len(rows)), np.float32)  # whole numbers below 2 ** 24 for each product
    total = np.zeros(len(x), np.int64)
    for first in range(0, columns, MATRIX_COLUMNS):
        low, high = np.searchsorted(column, [first, first + MATRIX_COLUMNS])
        member = np.zeros((len(rows), min(MATRIX_COLUMNS, columns - first)), np.float32)
        member[row[low:high], column[low:high] - first] = 1
        np.matmul(member, member.T, out=common)
        total += common[np.searchsorted(rows, x), np.searchsorted(rows, y)].astype(np.int64)
    return total


def _links_of_cell(cell: dict) -> list[tuple]:
    """Verified links of a cell, likeliest pairs first; components that a link has joined are not compared again.

    After as many refusals as the cell has rows, the pairs that are left are verified together.
    """
    x, y, scores = _cell_pairs(cell)
    sets = [np.frombuffer(s, np.uint64) for s in cell["set"]]
    keys, component = cell["key"], cell["component"]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c

    found: list[tuple] = []

    def join(i: int, a: int, b: int) -> None:
        root[max(a, b)] = min(a, b)
        found.append((min(keys[x[i]], keys[y[i]]), max(keys[x[i]], keys[y[i]])))

    refused, matrix = 0, True
    order = np.argsort(-scores, kind="stable")
    for at, i in enumerate(order):
        a, b = find(component[x[i]]), find(component[y[i]])
        if a == b:
            continue
        if _linked(sets[x[i]], sets[y[i]]):
            join(i, a, b)
            continue
        refused += 1
        if matrix and refused >= len(keys):
            rest = order[at + 1 :]
            both = _common(sets, x[rest], y[rest]) if len(rest) else None
            if both is None:
                matrix = False
                continue
            sizes = np.array([len(s) for s in sets])
            union = sizes[x[rest]] + sizes[y[rest]] - both
            for j in rest[SIMILARITY[1] * both >= SIMILARITY[0] * union]:
                a, b = find(component[x[j]]), find(component[y[j]])
                if a != b:
                    join(j, a, b)
            break
    return found


def _cellwise(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on every cell. The number of partitions is kept: cells take more time than their bytes suggest."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(partitions, *CELL_KEY).sortWithinPartitions(*CELL_KEY)
    return dealt.mapInPandas(_by_cell(work, [c.split()[0] for c in schema.split(", ")]), schema)


def _rest(sketches: DataFrame, joined: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links between different components of the same buckets."""
    needed = stored(_cellwise(_open_cells(sketches, joined).select(*CELL_COLUMNS), _needed, CELL), "needed")
    with_sets = needed.join(_sets(texts, needed.select("key").distinct()), "key").select(*CELL_COLUMNS, "set")
    return _cellwise(with_sets, _links_of_cell, "a long, b long").distinct()


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Sets and sketches are wide: batches of ``BATCH_ROWS`` and ``BATCH_BYTES`` keep a Python worker small."""
    limits = {"maxRecordsPerBatch": BATCH_ROWS, "maxBytesPerBatch": BATCH_BYTES}
    names = {f"spark.sql.execution.arrow.{name}": str(value) for name, value in limits.items()}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``n_shingles``, ``component_id``, ``kept``; ``key`` must be a whole number.

    All stages that need Python run, and are stored, before this returns.
    """
    with _small_batches(docs.sparkSession):
        return _find(docs, key, text)


def _find(docs: DataFrame, key: str, text: str) -> DataFrame:
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    schema = "key long, n long, class binary, registers binary, bands array<long>"
    with_key = source.where(F.col("key").isNotNull())
    unkeyed = stored(source.where(F.col("key").isNull()).mapInPandas(_sketched, schema).select("key", "n"), "unkeyed")
    sketched = stored(with_key.mapInPandas(_sketched, schema), "sketches")
    classes = sketched.where(F.col("n") > 0).groupBy("class").agg(
        F.min("key").alias("key"), F.first("n").alias("n"), F.first("registers").alias("registers"),
        F.first("bands").alias("bands"))
    sketches = stored(classes.drop("class"), "classes")
    texts = with_key
    pairs = stored(_likely(_with_sketches(_star_pairs(sketches), sketches)), "pairs")
    best = pairs.groupBy("b").agg(F.max(F.struct("likeness", "a")).alias("best")).select("best.a", "b")
    links = stored(_verified(best, texts), "links")
    more = stored(_rest(sketches, components(links), texts), "more")
    joined = components(links.union(more))
    class_of = sketched.where(F.col("n") > 0).groupBy("class").agg(F.min("key").alias("first"))
    label = class_of.join(joined.withColumnRenamed("key", "first"), "first", "left").select(
        "class", F.coalesce("component", "first").alias("component"))
    rows = sketched.select("key", "n", "class").join(label, "class", "left")
    found = rows.select("key", "n", F.coalesce("component", "key").alias("component")).union(
        unkeyed.select("key", "n", F.lit(None).cast("long")))
    return found.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("key") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. All columns stay."""
    gone = find(docs, key, text).where(~F.col("kept")).select(F.col(key).alias("__gone"))
    return docs.join(gone, F.col(key) == F.col("__gone"), "left_anti")
