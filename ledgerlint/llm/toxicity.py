"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

A word's features are its subsequences of three characters that span at most ``SPAN`` characters, weighted by
``DECAY`` to the power of the span; the kernel of two words is the product of their normalised features. Inserted
characters and gaps therefore only weaken a match. Punctuation inside a word is skipped, and single letters set apart
by spaces are read as one word.

Training: a bounded sample of labelled documents (``TRAIN_DOCUMENTS`` of each label, in an order of hashes of the id)
goes to the driver. Words that occur mainly in toxic documents become landmarks, beside frequent words of the others.
Words are mapped to Nyström features of the landmarks, and a linear machine with squared hinge loss is trained on
words of toxic documents (with copies that have a character inserted) against words of clean ones, three times more
with the clean words it got most wrong as examples and landmarks. A document's margin is that of its worst word; a logistic curve, fitted on the sampled
documents with the true label counts as weights, turns it into a score.

Scoring: a linear machine on landmark kernels is a weight per subsequence, so the whole model is one table of at most
``64 ** 3`` numbers, and scoring is table lookups over all characters of a batch. Texts are scored whole, in pieces of
bounded size, cut at white space; rows are independent, so nothing is shuffled.

Defined cases: NULL and empty texts score as a text without any word; NULL ids are never trained on and are not held
out; NULL labels are ignored; without labels of both kinds every score is the share of toxic labels (0 without any);
repeated rows are scored alike; an empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_DOCUMENTS = 1500
LANDMARKS = 192
PENALTY = 0.1
SPAN = 6
DECAY = 0.7
PIECE = 1 << 20
LETTERS = 62
OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
BREAK, SKIP, EDGE, OTHER = 255, 254, 63, 0


def held_out(key: Column) -> Column:
    """Whether a document is kept away from training: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_KIND = np.full(1 << 16, SKIP, np.uint8)
for _point in range(1 << 16):
    _char = chr(_point)
    _KIND[_point] = BREAK if _char.isspace() else OTHER if _char.isalnum() else SKIP


@dataclass
class Words:
    """Words of a text as character classes with an edge at both ends: which word each is in, and the words' lengths."""
    letters: np.ndarray
    word: np.ndarray
    length: np.ndarray


def split(text: str, classes: np.ndarray) -> Words:
    """``classes`` maps a code point to its letter; BREAK ends words, SKIP is ignored."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes[np.minimum(points, 0xFFFF)]
    kinds = kinds[kinds != SKIP]
    breaks = kinds == BREAK
    # Words of one letter join the one-letter word before them.
    at = np.flatnonzero(np.concatenate(([True], breaks, [True])))
    lengths = np.diff(at) - 1
    starts = at[:-1][lengths > 0]
    lengths = lengths[lengths > 0]
    if not len(starts):
        return Words(np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64))
    single = lengths == 1
    first = np.concatenate(([True], ~(single[1:] & single[:-1])))
    number = np.cumsum(first) - 1
    inside = np.bincount(number, lengths).astype(np.int64)
    letters = np.full(len(kinds) - breaks.sum() + 2 * len(inside), EDGE, np.uint8)
    letters[np.arange(len(kinds) - breaks.sum()) + 2 * np.repeat(number, lengths) + 1] = kinds[~breaks]
    return Words(letters, np.repeat(np.arange(len(inside)), inside + 2), inside + 2)


_STEP = np.array([sum(DECAY ** (2 * (j + 1)) for _, j in OFFSETS if n > j) for n in range(SPAN + 1)])


def norms(length: np.ndarray) -> np.ndarray:
    """The length of the feature vectors of words of so many letters."""
    upto = np.cumsum(_STEP)  # words of n letters have the windows of all shorter ends
    inside = np.minimum(length, SPAN)
    return np.sqrt(np.maximum(upto[inside] + np.maximum(length - SPAN, 0) * _STEP[SPAN], 1e-9))


def margins(words: Words, table: np.ndarray) -> np.ndarray:
    """Sum of ``table`` over the features of every word, divided by their norm if all were different."""
    total = np.zeros(len(words.length))
    letters = words.letters.astype(np.int32)
    for i, j in OFFSETS:
        if len(letters) <= j:
            break
        code = (letters[:-j] << 12) | (letters[i : len(letters) - j + i] << 6) | letters[j:]
        value = table[code]
        used = np.flatnonzero((value != 0) & (words.word[:-j] == words.word[j:]))
        if len(used):
            total += DECAY ** (j + 1) * np.bincount(words.word[used], value[used], len(total))
    return total / norms(words.length)


def features(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normalised features of one word: codes of its subsequences, and their weights."""
    codes, weights = [], []
    wide = letters.astype(np.int32)
    for i, j in OFFSETS:
        if len(wide) > j:
            code = (wide[:-j] << 12) | (wide[i : len(wide) - j + i] << 6) | wide[j:]
            codes.append(code)
            weights.append(np.full(len(code), DECAY ** (j + 1)))
    if not codes:
        return np.empty(0, np.int64), np.empty(0)
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    summed = np.bincount(at, np.concatenate(weights))
    return found, summed / np.sqrt((summed**2).sum())


def worst(words: Words, table: np.ndarray, most: int = 1) -> list[tuple[float, int]]:
    """The ``most`` largest margins and their words, with the exact norm, which counts repeated features together.

    The norm of ``margins`` takes features as different, so it is at most the exact one and a positive margin there
    is an upper bound: words are looked at from the largest down, and only as far as they can still matter.
    """
    bound = margins(words, table)
    start = np.concatenate(([0], np.cumsum(words.length)))
    order = np.argsort(-bound, kind="stable")
    best: list[tuple[float, int]] = []
    for w in order[: most if bound[order[0]] <= 0 else len(order)]:
        if len(best) >= most and bound[w] <= best[most - 1][0]:
            break
        value = float(bound[w])
        if value > 0:
            codes, weights = features(words.letters[start[w] : start[w + 1]])
            value = float(table[codes] @ weights)
        best.append((value, int(w)))
        best.sort(key=lambda x: (-x[0], x[1]))
    return best[:most]


@dataclass
class Model:
    classes: np.ndarray
    table: np.ndarray
    bias: float
    slope: float
    intercept: float
    constant: float | None = None

    def margin(self, text: str | None) -> float:
        """The margin of the worst word, -1 for a text without words."""
        best = -1.0
        for piece in _pieces(text or ""):
            words = split(piece, self.classes)
            if len(words.length):
                best = max(best, worst(words, self.table)[0][0] + self.bias)
        return best

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.intercept, -500, 500))))


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PIECE:
        cut = re.compile(r"\s(?=\S\S)").search(text, start + PIECE)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _plain_words(text: str) -> set[str]:
    return {w for w in (re.sub(r"[\W_]+", "", x) for x in text.lower().split()) if len(w) >= 3}


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Newton's method on the squared hinge loss of a linear machine; the last column of ``x`` is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(50):
        slack = 1 - y * (x @ w)
        on = slack > 0
        part = x[on] * weight[on, None]
        step = np.linalg.solve(part.T @ x[on] + np.diag(ridge), ridge * w - part.T @ (y[on] * slack[on]))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _telling(words: list[set[str]], labels: list[int], most: int) -> list[str]:
    """Words that tell toxic documents apart, by how many toxic documents each adds to those told already.

    Words that only come with others, as in copies of one document, add nothing and are taken only if a twentieth of
    the toxic documents has them.
    A word counts if its share of toxic documents is ten times its share of the others, both smoothed.
    """
    toxic, clean = Counter(), Counter()
    for own, label in zip(words, labels):
        (toxic if label else clean).update(own)
    n_toxic = sum(labels)
    n_clean = len(labels) - n_toxic
    usable = {w for w, n in toxic.items()
              if n >= 3 and (n - 1) / n_toxic > 10 * (clean[w] + 0.5) / n_clean and all(ord(c) < 1 << 16 for c in w)}
    holders: dict[str, list[int]] = {}
    for i, (own, label) in enumerate(zip(words, labels)):
        if label:
            for w in own & usable:
                holders.setdefault(w, []).append(i)
    open_documents = {i for i, label in enumerate(labels) if label}
    found: list[str] = []
    while holders and len(found) < most:
        gain = {w: sum(i in open_documents for i in own) for w, own in holders.items()}
        best = min(gain, key=lambda w: (-gain[w], -len(holders[w]), w))
        if gain[best] < 3:
            break
        open_documents.difference_update(holders.pop(best))
        found.append(best)
    common = sorted((w for w, own in holders.items() if len(own) >= max(10, n_toxic // 20)),
                    key=lambda w: (-len(holders[w]), w))
    return (found + common)[:most]


def train(texts: list[str], labels: list[int], counts: tuple[int, int]) -> Model:
    """``counts``: how many clean and toxic labels there are beyond the sample, as weights."""
    classes = _KIND.copy()
    empty = Model(classes, np.zeros(1 << 18, np.float32), 0.0, 1.0, 0.0)
    if not min(counts) or len(set(labels)) < 2:
        empty.constant = counts[1] / max(1, sum(counts))
        return empty
    n_toxic = sum(labels)
    n_clean = len(labels) - n_toxic
    words = [_plain_words(t) for t in texts]
    strong = _telling(words, labels, LANDMARKS)
    clean = Counter(w for own, label in zip(words, labels) if not label for w in own if all(ord(c) < 1 << 16 for c in w))
    if not strong:
        empty.constant = counts[1] / sum(counts)
        return empty
    letters = Counter(c for w in strong for c in w)
    for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]):
        classes[ord(c)] = i + 1

    def coded(word: str) -> np.ndarray:
        return split(word, classes).letters

    frequent = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))[: LANDMARKS // 4]]
    landmarks: list[dict[int, float]] = []

    def add_landmarks(words: list[str]) -> None:
        for word in words:
            own = dict(zip(*(x.tolist() for x in features(coded(word)))))
            if own and not any(sum(v * other.get(k, 0) for k, v in own.items()) > 0.95 for other in landmarks):
                landmarks.append(own)

    def nystrom() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes that landmarks have, the landmarks over these codes, and the map that whitens kernel rows."""
        known = np.array(sorted({k for own in landmarks for k in own}))
        basis = np.zeros((len(landmarks), len(known)))
        for i, own in enumerate(landmarks):
            basis[i, np.searchsorted(known, list(own))] = list(own.values())
        values, vectors = np.linalg.eigh(basis @ basis.T)
        kept = values > 1e-6 * values.max()
        return known, basis, vectors[:, kept] / np.sqrt(values[kept])

    def mapped(words: list[str], known: np.ndarray, basis: np.ndarray, whiten: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), len(basis)))
        for i, word in enumerate(words):
            codes, weights = features(coded(word))
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            same = known[at] == codes
            out[i] = basis[:, at[same]] @ weights[same]
        return np.hstack([out @ whiten, np.ones((len(words), 1))])

    add_landmarks([*strong, *frequent])
    random = np.random.default_rng(8)
    own = sorted(letters)
    positive = list(strong)
    for word in strong:
        for _ in range(2):
            at = int(random.integers(1, len(word)))
            positive.append(word[:at] + own[int(random.integers(len(own)))] + word[at:])
    all_clean = sorted(clean, key=lambda w: (-clean[w], w))
    joined = "\n".join(all_clean)
    negative = all_clean[:2000]
    table, bias = empty.table, 0.0
    for _ in range(4):
        known, basis, whiten = nystrom()
        x = mapped([*positive, *negative], known, basis, whiten)
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.where(y > 0, 1.0, len(positive) / len(negative))
        weight[: len(strong)] = 4.0
        weight *= 1000 / weight.sum()
        w = _fit(x, y, weight, PENALTY)
        table, bias = np.zeros(1 << 18, np.float32), float(w[-1])
        table[known] = (whiten @ w[:-1]) @ basis
        hard = [all_clean[i] for _, i in worst(split(joined, classes), table, 1000)]
        negative = list(dict.fromkeys([*negative, *hard]))
        add_landmarks(hard[: LANDMARKS // 3])
    model = Model(classes, table, bias, 1.0, 0.0)
    x = np.array([model.margin(t) for t in texts])
    y = np.array(labels, float)
    weight = np.where(y > 0, counts[1] / n_toxic, counts[0] / n_clean)
    model.slope, model.intercept = _logistic(x, y, weight / weight.sum() * len(y))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """A weighted logistic curve; a weak penalty on the slope keeps it finite when the classes are apart."""
    a = np.stack([x, np.ones(len(x))], 1)
    w = np.zeros(2)
    ridge = np.array([1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        gradient = a.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + np.diag(ridge), gradient)
        step *= min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          documents_of_each: int = TRAIN_DOCUMENTS) -> Model:
    """A model from labelled documents that are not held out."""
    usable = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(
        F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("key")))
    # One label for each document, so a repeated label does not count twice.
    usable = usable.groupBy("key").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    drawn = None
    for value in (0, 1):
        part = usable.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key").limit(documents_of_each)
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(drawn), "key").groupBy("key", "label").agg(F.min("text").alias("text"))
    rows = sorted((r["key"], r["text"] or "", r["label"]) for r in rows.collect())
    rows = list({r[1:]: r for r in reversed(rows)}.values())[::-1]  # copies teach nothing new
    return train([r[1] for r in rows], [r[2] for r in rows], (counts.get(0, 0), counts.get(1, 0)))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every text added under ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            yield pd.Series([own.score(t) for t in batch], dtype="float64")

    return docs.withColumn(name, score(F.coalesce(F.col(text), F.lit(""))))


def report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
           threshold: float = 0.3) -> DataFrame:
    """One row per document: key, ``held_out``, ``score``, ``predicted``."""
    model = learn(docs, labels, key, text)
    narrow = scored(docs.select(F.col(key).alias(key), F.col(text).alias("__text")), model, "__text", "__score")
    return narrow.select(key, held_out(F.col(key)).alias("held_out"), F.col("__score").alias("score"),
                         (F.col("__score") >= threshold).cast("int").alias("predicted"))
