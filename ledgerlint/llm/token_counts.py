"""Token counts of whole texts: batch encoding inside Arrow functions that return lengths only.

A byte-level tokenizer starts a new token at every single space between two other characters, and after a single line
break between two. Texts are split there, so the counts of the pieces add up to the count of the whole. Most pieces are
words that came before: their counts are kept, and only pieces not seen yet are encoded, all those of a batch in one
call. What is kept is bounded in bytes and forgotten when full, which changes no count. Batches are balanced by
bytes whatever the number of rows; texts above ``PIECE_BYTES`` are first cut at such places, or between full stops and letters
of scripts without spaces, so a task never holds the pieces of more than one batch. A stretch without such a place stays whole.

Other tokenizers (.model files, .json files that are not byte-level) get whole texts.

The result has the key, the byte length, the token count and the limit flag; other columns of the input are
not read, so their names cannot clash. NULL texts count as empty, NULL keys and repeated rows are kept, an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20
PIECE_BYTES = 1 << 16
#: Bytes of kept pieces, counting ``ENTRY`` for each beside its characters; longer pieces than ``KEPT`` are not kept.
CACHE_BYTES = 96 << 20
ENTRY = 120
KEPT = 64
#: Before a single space between two characters that are no white space; after such a line break.
WORDS = re.compile(r"(?<=[^\s᠎])(?= [^\s᠎])|(?<=[^\s᠎]\n)(?=[^\s᠎])")
#: The same, and after the full stops of Chinese and Japanese before an ideograph, which byte-level patterns keep apart.
CUT = re.compile(WORDS.pattern + r"|(?<=[。！？，、；：])(?=[一-鿿])")
#: White space that may stand beside a space or line break; a text without these splits at each of both.
UNUSUAL = ("  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if (c.isspace() or c in "\x00᠎") and c not in " \n"))


def pieces(text: str, size: int = PIECE_BYTES) -> Iterator[str]:
    """Cut ``text`` at safe places into pieces of at least ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def words(text: str) -> list[str]:
    """``text`` split at all safe places."""
    if any(x in text for x in UNUSUAL) or text[:1] in " \n" or text[-1:] in " \n":
        return WORDS.split(text)
    return text.replace(" ", "\x00 ").replace("\n", "\n\x00").split("\x00")


class Counter:
    """Counts tokens of texts with the vocabulary of a file."""

    def __init__(self, file: str):
        self.may_cut = False
        self.kept: dict[str, int] = {}
        self.kept_bytes = 0
        if file.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=file)
            self.encoded: Callable[[list[str]], list[int]] = lambda texts: [
                len(x) for x in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(file)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        self.encoded = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.may_cut = cuts_at_words(json.loads(tokenizer.to_str()))

    def counts(self, texts: list[str]) -> list[int]:
        total = [0] * len(texts)
        waiting: list[tuple[int, str]] = []
        held = 0
        for i, text in enumerate(texts):
            for piece in pieces(text) if self.may_cut else (text,):
                waiting.append((i, piece))
                held += len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
                if held >= BATCH_BYTES:
                    self._add(total, waiting)
                    waiting, held = [], 0
        self._add(total, waiting)
        return total

    def _add(self, total: list[int], waiting: list[tuple[int, str]]) -> None:
        if not self.may_cut:
            for (owner, _), n in zip(waiting, self.encoded([text for _, text in waiting])):
                total[owner] += n
            return
        split = [words(text) for _, text in waiting]
        new = list(set().union(*split).difference(self.kept))
        found = dict(zip(new, self.encoded(new)))
        self.kept.update(found)
        for (owner, _), own in zip(waiting, split):
            total[owner] += sum(map(self.kept.__getitem__, own))
        for piece in new:
            if len(piece) > KEPT:
                del self.kept[piece]
            else:
                self.kept_bytes += ENTRY + len(piece.encode("utf-8", "surrogatepass"))
        if self.kept_bytes > CACHE_BYTES:
            self.kept.clear()
            self.kept_bytes = 0


def cuts_at_words(description: dict) -> bool:
    """Whether a tokenizer is byte-level with its usual pattern: no normalizer, and no added token that takes in the white
    space or the word around it."""
    before = description.get("pre_tokenizer") or {}
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"])
                    for t in description.get("added_tokens") or [])
    return (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and description.get("normalizer") is None and plain)


_COUNTERS: dict[str, Counter] = {}


def counter(file: str) -> Counter:
    """The counter of a file; a worker process keeps it, with the counts of its words, for later tasks."""
    if file not in _COUNTERS:
        _COUNTERS[file] = Counter(file)
    return _COUNTERS[file]


def count_tokens(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text",
                 limit: int = 1024) -> DataFrame:
    """One row per document: key, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    ``tokenizer_file`` must exist on every executor; it is a path, never data of this repository. Special
    strings inside texts are handled as the library does by default; nothing is added, padded or cut off.
    """
    source = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = source.select(key, F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_bytes")).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_file)
        for batch in batches:
            column = batch.column(1)
            n_tokens = count.counts(column.to_pylist())
            n_bytes = pa.compute.binary_length(column.cast(pa.binary()) if column.type != pa.large_string()
                                               else column.cast(pa.large_binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tokens, pa.int64()), n_bytes.cast(pa.int64())],
                names=[key, "n_tokens", "n_bytes"])

    counted = source.mapInArrow(encode, schema)
    return counted.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
