"""String similarity for the near-duplicate check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Texts above this length are not compared many at once.
LONGEST_AT_ONCE = 256
#: Counts up to which a cell compares values by a product of matrices.
PRODUCT = 1000
#: A cell hands on its pairs in parts of so many pairs, and of about so many characters.
PART, PART_CHARACTERS = 65_536, 8_000_000


def numbered(codes: np.ndarray) -> tuple[int, np.ndarray]:
    """How many different characters there are, and the number of each, from 0, in their order."""
    there = np.zeros(int(codes.max(initial=0)) + 1, bool)
    there[codes] = True
    return int(there.sum()), (np.cumsum(there) - 1)[codes]


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence of two texts of any length: one bit per character of the shorter
    text; one step of whole-number arithmetic per character of the longer one."""
    if len(a) > len(b):
        a, b = b, a
    places: dict = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    unmatched = full
    for ch in b:
        hit = unmatched & places.get(ch, 0)
        unmatched = ((unmatched + hit) | (unmatched - hit)) & full
    return len(a) - unmatched.bit_count()


def compared_at_once(edits: bool = False):
    """A function of many pairs of texts, given as arrays of their characters and two arrays of their numbers: the lengths of
    the pairs' longest common subsequences, or with ``edits`` their Levenshtein distances.

    One bit per character of the first text of a pair, in words of 64, and one step per character of the second text for
    all pairs of a batch. A batch is bounded in pairs and in masks. Like the other helpers it travels with the query.
    """
    one, top, number = np.uint64(1), np.uint64(63), numbered

    def common(masks, start, texts, sizes, others) -> np.ndarray:
        unmatched = np.full((len(masks), len(start)), np.iinfo(np.uint64).max, np.uint64)
        for numbers in texts:
            at, carry = start + numbers, None
            for w, mask in enumerate(masks):
                hit = unmatched[w] & mask[at]
                total = unmatched[w] + hit
                over = total < hit
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64) if w + 1 < len(masks) else None
                unmatched[w] = total | (unmatched[w] - hit)
        return np.bitwise_count(~unmatched).sum(axis=0)

    def distance(masks, start, texts, sizes, others) -> np.ndarray:
        # Differences down a column of the usual table are +1 in more, -1 in less; those along its rows go on from word to word.
        more = np.full((len(masks), len(start)), np.iinfo(np.uint64).max, np.uint64)
        less = np.zeros_like(more)
        last, bit = (sizes - 1) // 64, ((sizes - 1) % 64).astype(np.uint64)
        found = sizes.copy()
        for i, numbers in enumerate(texts):
            at, up, down = start + numbers, one, None
            for w, mask in enumerate(masks):
                equal = mask[at]
                either = equal | less[w]
                if down is not None:
                    equal = equal | down
                across = (((equal & more[w]) + more[w]) ^ more[w]) | equal
                rising, falling = less[w] | ~(across | more[w]), more[w] & across
                step = ((rising >> bit) & one).astype(np.int64) - ((falling >> bit) & one).astype(np.int64)
                found += np.where((last == w) & (i < others), step, 0)
                next_up, next_down = rising >> top, falling >> top
                rising, falling = (rising << one) | up, falling << one
                if down is not None:
                    falling |= down
                up, down = next_up, next_down
                more[w], less[w] = falling | ~(either | rising), rising & either
        return np.where(sizes == 0, others, found)

    def compared(codes: list, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        found = np.zeros(len(x), np.int64)
        sizes = np.array([len(c) for c in codes], np.int64)
        if not len(x) or not sizes.max():
            return found
        known, numbers = number(np.concatenate(codes))
        owner = np.repeat(np.arange(len(codes)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = known + 1  # the last number stands behind the end of a text and is in no text
        padded = np.full((sizes.max(), len(codes)), known, np.int32)
        padded[place, owner] = numbers
        words = max(1, -(-int(sizes[x].max()) // 64))
        step = max(1, min(16_384, 4_000_000 // (row * words)))
        for first in range(0, len(x), step):
            here = slice(first, first + step)
            own, which = np.unique(x[here], return_inverse=True)
            masks = np.zeros((words, len(own) * row), np.uint64)
            for i in range(sizes[own].max()):
                longer = np.flatnonzero(sizes[own] > i)
                masks[i // 64, longer * row + padded[i, own[longer]]] |= np.uint64(1 << i % 64)
            texts = (padded[i, y[here]] for i in range(sizes[y[here]].max()))
            found[here] = (distance if edits else common)(masks, which * row, texts, sizes[x[here]], sizes[y[here]])
        return found

    return compared


def pairs_sharing_characters(of_both: float, of_longer: float, edits: bool = False):
    """A function of one cell: the pairs of values from both sides (or of one, if there is only one) that share at
    least of_both * (both lengths) + of_longer * (the longer length) characters, counted with multiplicity.

    These must be in order, or with ``edits`` be what edits leave of the longer value; ``exact`` is then the length of the
    longest common subsequence, or the Levenshtein distance. With ``edits`` it is NULL for values above a bounded length.
    """
    compared, longest, number, in_common = compared_at_once(edits), LONGEST_AT_ONCE, numbered, common_length
    product, part, part_characters = PRODUCT, PART, PART_CHARACTERS

    def fewest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.ceil(of_both * (a + b) + of_longer * np.maximum(a, b) - 1e-6).astype(np.int64)

    def sharing(codes: list, length: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # The pairs that share enough characters; side 0 meets itself, side 1 meets side 2.
        n, single, other = len(codes), side[0] == 0, int(np.searchsorted(side, 2))
        if not single and other in (0, n):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known, at = number(np.concatenate(codes))
        counts = np.bincount(at * n + np.repeat(np.arange(n), length), minlength=n * known).reshape(known, n)
        most = counts.max(axis=1, initial=0)
        if most.sum() <= product:
            # min(a, b) is the number of steps that both a and b reach: a product of zeros and ones, exact as such.
            reached = (counts[np.repeat(np.arange(known), most)]
                       > (np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most))[:, None]).astype(np.float32)
            right = slice(None) if single else slice(other, None)
            shared = reached[:, :other].T @ reached[:, right]
            sizes, which = np.unique(length, return_inverse=True)
            least = fewest(sizes[:, None], sizes[None, :]).astype(np.float32)
            enough = shared >= least[which[:other]][:, which[right]]
            x, y = np.nonzero(np.triu(enough, 1) if single else enough)
            return x, y if single else y + other
        counts = counts.astype(np.uint8 if length.max() < 256 else np.int32)
        left, right = [], []
        for x in range(other):
            ys = slice(x + 1, None) if single else slice(other, None)
            own = np.flatnonzero(counts[:, x])
            shared = np.minimum(counts[own, ys], counts[own, x, None]).sum(axis=0, dtype=counts.dtype)
            y = np.flatnonzero(shared >= fewest(length[ys], length[x])) + ys.start
            left.append(np.full(len(y), x)), right.append(y)
        return np.concatenate(left), np.concatenate(right)

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by("side").combine_chunks()
        texts, times = rows["value"].combine_chunks(), rows["n_rows"].to_numpy()
        side, values = rows["side"].to_numpy(), texts.to_pylist()
        codes = [np.frombuffer(v.encode("utf-32-le", "surrogatepass"), np.uint32) for v in values]
        length = np.array([len(c) for c in codes])
        rank = np.empty(len(values), np.int64)
        rank[sorted(range(len(values)), key=values.__getitem__)] = np.arange(len(values))  # as bytes of UTF-8 are ordered
        pairs = sharing(codes, length, side)
        tried = [c if len(c) <= longest else c[:0] for c in codes]
        step = max(1, min(part, part_characters // max(1, int(length.max()))))
        for first in range(0, len(pairs[0]), step):
            x, y = (ends[first:first + step] for ends in pairs)
            longer = np.maximum(length[x], length[y])
            short = longer <= longest
            exact = np.zeros(len(x), np.int64)
            exact[short] = compared(tried, x[short], y[short])
            if not edits:
                for i in np.flatnonzero(~short):
                    exact[i] = in_common(values[x[i]], values[y[i]])
            unknown = ~short & edits
            keep = np.flatnonzero(unknown | ((longer - exact if edits else exact) >= fewest(length[x], length[y])))
            x, y, exact, unknown, longer = x[keep], y[keep], exact[keep], unknown[keep], longer[keep]
            shorter = np.minimum(length[x], length[y])
            x, y = np.where(rank[x] < rank[y], x, y), np.where(rank[x] < rank[y], y, x)
            yield pa.RecordBatch.from_arrays(
                [texts.take(pa.array(x)), texts.take(pa.array(y)), pa.array(times[x], pa.int64()), pa.array(times[y], pa.int64()),
                 pa.array(exact.astype(np.int32), mask=unknown), pa.array(shorter.astype(np.int32)), pa.array(longer.astype(np.int32))],
                ["value_a", "value_b", "n_a", "n_b", "exact", "shorter", "longer"])

    return cell


def lcs_function(ratio: float):
    """Arrow function for the length of the longest common subsequence of two texts.

    Pairs whose characters alone rule out 2 * length >= ratio * (both lengths) give NULL; that test
    runs on whole batches at once. The helpers are defined in here so that they travel to the
    executors with the query and need no installation there.
    """
    compared, longest, in_common = compared_at_once(), LONGEST_AT_ONCE, common_length

    def histograms(texts) -> np.ndarray:
        # Characters share 256 counters; sharing can only raise an overlap, never hide a pair.
        codes = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) % 256 for t in texts]
        rows = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        cells = np.concatenate(codes).astype(np.int64) if codes else np.zeros(0, np.int64)
        return np.bincount(rows * 256 + cells, minlength=len(codes) * 256).reshape(len(codes), 256)

    def lcs(left: pd.Series, right: pd.Series) -> pd.Series:
        asked = left.notna() & right.notna()
        found = pd.Series(pd.NA, index=left.index, dtype="Int32")
        if asked.any():
            found[asked] = of_texts(left[asked], right[asked]).array
        return found

    def of_texts(left: pd.Series, right: pd.Series) -> pd.Series:
        ids, texts = pd.factorize(pd.concat([left, right], ignore_index=True))
        counts = histograms(texts).astype(np.int32)
        lengths = counts.sum(axis=1)
        a, b = ids[: len(left)], ids[len(left):]
        overlap = np.minimum(counts[a], counts[b]).sum(axis=1)
        possible = 2 * overlap >= ratio * (lengths[a] + lengths[b]) - 1e-9
        short = possible & (np.maximum(lengths[a], lengths[b]) <= longest)
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) if n <= longest else np.zeros(0, np.uint32)
                 for t, n in zip(texts, lengths)]
        found = np.zeros(len(a), np.int64)
        found[short] = compared(codes, a[short], b[short])
        for i in np.flatnonzero(possible & ~short):
            found[i] = in_common(texts[a[i]], texts[b[i]])
        return pd.Series(found, dtype="Int32").where(possible)

    # Declared not deterministic so that the planner does not run it once for a filter on the
    # score and again for the score itself.
    return F.pandas_udf(lcs, T.IntegerType()).asNondeterministic()


def indel_score(
    left: Column, right: Column, ratio: float = 0.0, exact: Column | None = None, total: Column | None = None) -> Column:
    """Whole-number similarity 0..100 from insertions and deletions, halves rounded to even; NULL
    where it cannot reach the ratio. ``exact`` has the length of the longest common subsequence, ``total`` the
    characters of both, if that is known."""
    common = lcs_function(ratio)(left, right) if exact is None else exact
    total = F.char_length(left) + F.char_length(right) if total is None else total
    return F.rint(common * 200.0 / total).cast("int")
