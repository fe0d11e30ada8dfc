"""Fill-in-middle rewriting by secondary sort: pieces of texts are sorted into output order, and back again.

Every text is cut into lines; its key decides where prefix and middle end and in which form the parts are put together.
A task turns each text into pieces of bounded size, keyed by document and output position, in the order of the text.
One exchange deals them by document (``repartition`` and ``sortWithinPartitions``, the DataFrame form of
repartitionAndSortWithinPartitions), so the sort assembles the output; a task streams its pieces through incremental digests
and holds one piece at a time, however long the document. Restoration reads the markers of the assembled stream, gives each
piece its place in the text, sorts the same partitions again (no second exchange) and streams once more. Neither sort keeps
more in memory than Spark lets it; both spill.

A document is known by its key, a digest of its text and the number of the task that read it, so nothing depends on row
order, and a lost task makes the same pieces again. Rows with the same key but other texts are documents of their own; equal
rows are assembled once a task and returned as often as they came, so a row that fills a third of the table is spread over as
many partitions as tasks read it.

NULL and empty texts have no lines and stay plain, with an empty output. A NULL key counts as an empty string where the
cuts are drawn. A text that holds one of the markers stays plain, since its output could not be read back. An
empty table gives an empty result. Only key and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMS = ("plain", "psm", "spm")
DOCUMENT = ("digest", "key", "task")
#: Bytes of pieces that a task collects before it hands them on.
BATCH_BYTES = 1 << 22
#: The parts of a text in their own order are 0, 1, 2; a position is the rank of the part and a running number.
PART_BITS = 40


@dataclass(frozen=True)
class Settings:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "7"
    #: Documents in a hundred that are rewritten, and of these those in the form suffix, prefix, middle.
    rate: int = 100
    spm_rate: int = 50
    piece_bytes: int = 1 << 16

    @property
    def markers(self) -> tuple[bytes, bytes, bytes]:
        """In the order of the text: prefix, middle, suffix."""
        return self.prefix.encode(), self.middle.encode(), self.suffix.encode()


#: Per form, the parts (0 prefix, 1 middle, 2 suffix) in output order.
ORDER = {"plain": (0,), "psm": (0, 2, 1), "spm": (2, 0, 1)}


def code_points(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def cut(data: bytes, name: str, settings: Settings) -> tuple[str, int, list[bytes]]:
    """(form, lines, parts) of a text: the parts in the order of the text, one if it stays plain."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if data and not data.endswith(b"\n"):
        ends = np.append(ends, len(data))
    n = len(ends)
    h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(f"{settings.seed}:{name}".encode()).digest()[:16])
    if not data or h3 % 100 >= settings.rate or any(m in data for m in settings.markers):
        return "plain", n, [data]
    first, last = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    return "spm" if h4 % 100 < settings.spm_rate else "psm", n, [data[:first], data[first:last], data[last:]]


def chunks(part: bytes, size: int) -> Iterator[bytes]:
    """A part in pieces of at most ``size`` bytes (at least 8): whole lines, or a long line at code points."""
    start = 0
    while len(part) - start > size:
        end = part.rfind(b"\n", start, start + size) + 1
        if not end:
            end = start + size
            while part[end] & 0xC0 == 0x80:
                end -= 1
        yield part[start:end]
        start = end
    yield part[start:]


class _Batches:
    """Rows collected into record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size + 64
        if self.held >= BATCH_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, t) for column, t in zip(zip(*self.rows), self.schema.types)], schema=self.schema)
        self.rows, self.held = [], 0


def _schema(docs: DataFrame, key: str, rest: str) -> str:
    return f"digest binary, key {docs.schema[key].dataType.simpleString()}, task int, {rest}"


def _opened(batches: Iterator[pa.RecordBatch], schema: str) -> tuple[_Batches, Iterator[pa.RecordBatch]]:
    """An output for rows of this schema, whose key (always the second column) has the type of the input's key."""
    known = {"binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    first = next(batches, None)
    if first is None:
        return _Batches(pa.schema([])), iter(())
    fields = [field.split() for field in schema.split(", ")]
    types = pa.schema([(name, first.schema.field(1).type if i == 1 else known[kind]) for i, (name, kind) in enumerate(fields)])
    return _Batches(types), chain([first], batches)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, bool]]:
    """(row, whether it starts a document, whether it is a copy of the row before) of sorted rows."""
    last = place = None
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns]):
            document = row[:3]
            yield row, document != last, document == last and row[3] == place
            last, place = document, row[3]


def pieces(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all texts with their output position, not yet in order."""
    schema = _schema(docs, key, "place bigint, n bigint, form int, prefix_chars bigint, middle_chars bigint, piece binary")
    source = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(key).alias("key"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        out, batches = _opened(batches, schema)
        for batch in batches:
            for name, own, value in zip(*batch.columns):
                data = value.as_buffer().to_pybytes()
                form, n, parts = cut(data, name.as_py(), settings)
                plain = form == "plain"
                document = hashlib.blake2b(data, digest_size=16).digest(), own.as_py(), task
                facts = (n, FORMS.index(form), *([None] * 2 if plain else map(code_points, parts[:2])))
                for number, part in enumerate(parts):
                    place = ORDER[form].index(number) << PART_BITS
                    marked = part if plain else settings.markers[number] + part
                    for j, piece in enumerate(chunks(marked, settings.piece_bytes)):
                        yield from out.add((*document, place + j, *facts, piece), len(piece))
        yield from out.rest()

    return source.mapInArrow(emit, schema)


def assembled(found: DataFrame) -> DataFrame:
    """The pieces dealt by document and sorted by output position: read in order, they are the outputs."""
    return found.repartition(*DOCUMENT).sortWithinPartitions(*DOCUMENT, "place")


def restored(outputs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Assembled pieces back in the order of their texts; a first row per document has the digest of its output.

    Where a piece belongs follows from form and markers of the output alone.
    """
    key = outputs.schema["key"].dataType.simpleString()
    schema = (f"digest binary, key {key}, task int, place bigint, n bigint, form int, prefix_chars bigint, "
              "middle_chars bigint, copies bigint, output_sha256 string, piece binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, batches = _opened(batches, schema)
        document = facts = digest = None
        copies = part = place = 0
        for row, starts, copy in _documents(batches):
            if starts:
                if document:
                    yield from out.add((*document, -1, *facts, copies, digest.hexdigest(), None))
                document, facts, digest, copies, part, place = row[:3], row[4:8], hashlib.sha256(), 1, 0, 0
            elif copy:
                copies += row[3] == 0
                continue
            piece = row[8]
            digest.update(piece)
            if FORMS[facts[1]] != "plain":  # the text holds no marker then, and no piece cuts one
                opened = next((i for i, m in enumerate(settings.markers) if piece.startswith(m)), None)
                if opened is not None:
                    part, place, piece = opened, 0, piece[len(settings.markers[opened]):]
            yield from out.add((*document, (part << PART_BITS) + place, *facts, None, None, piece), len(piece))
            place += 1
        if document:
            yield from out.add((*document, -1, *facts, copies, digest.hexdigest(), None))
        yield from out.rest()

    return outputs.mapInArrow(read, schema).sortWithinPartitions(*DOCUMENT, "place")


def texts(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its whole output: form, key, output. A task holds one document at a time."""
    schema = f"form string, {key} {docs.schema[key].dataType.simpleString()}, output string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, batches = _opened(batches, schema)
        document, form, parts, copies = None, "", [], 0
        for row, starts, copy in chain(_documents(batches), [(None, True, False)]):
            if starts:
                data = b"".join(parts).decode()
                for _ in range(copies):
                    yield from out.add((form, document[1], data), len(data))
                if row is None:
                    break
                document, form, parts, copies = row[:3], FORMS[row[5]], [], 1
            elif copy:
                copies += row[3] == 0
                continue
            parts.append(row[8])
        yield from out.rest()

    return assembled(pieces(docs, settings, key, text)).mapInArrow(join, schema).select(key, "form", "output")


def report(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: lines, form, lengths of prefix and middle, digests of the output and of the text read back."""
    schema = (f"n bigint, {key} {docs.schema[key].dataType.simpleString()}, form string, prefix_chars bigint, "
              "middle_chars bigint, output_sha256 string, restored_sha256 string")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, batches = _opened(batches, schema)
        head, digest = None, hashlib.sha256()
        for row, starts, _ in chain(_documents(batches), [(None, True, False)]):
            if starts:
                for _ in range(head[8] if head else 0):
                    yield from out.add((head[4], head[1], FORMS[head[5]], *head[6:8], head[9], digest.hexdigest()))
                if row is None:
                    break
                head, digest = row, hashlib.sha256()
            else:
                digest.update(row[10])
        yield from out.rest()

    outputs = assembled(pieces(docs, settings, key, text))
    return restored(outputs, settings).mapInArrow(digests, schema).select(
        key, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
