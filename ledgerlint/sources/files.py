"""File sources: CSV and JSON record files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlint.functions.values import any_of, named, parse_number, parse_whole
from ledgerlint.operators.normalize import as_snapshot, number_placed, place_rows
from ledgerlint.session import stored
from ledgerlint.settings import NULL_TOKENS

#: Names of files are short; beyond so many they are joined without a hint.
FILES_TO_BROADCAST = 10_000


def _csv(spark: SparkSession, paths, encoding: str, multiline: bool, header_row: list[str]):
    return (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("multiLine", multiline)
        .option("escape", '"')
        .schema(T.StructType([T.StructField(c, T.StringType()) for c in header_row]))
        .csv(paths)
    )


def csv_header(spark: SparkSession, path, encoding: str = "UTF-8") -> list[str]:
    """Column names from the header line; no data is scanned for types."""
    return spark.read.option("header", True).option("encoding", encoding).option("escape", '"').csv(path).columns


def csv_scan(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    """The raw scan: every byte of a cell as one Latin-1 character, so no byte is lost whatever a file's encoding.

    Separators and quotes are ASCII, which UTF-8 and Latin-1 share, so rows and cells are the same in both.
    """
    return _csv(spark, path, "ISO-8859-1", multiline, csv_header(spark, path, "ISO-8859-1"))


def _as_utf8(column: Column) -> Column:
    return F.encode(column, "ISO-8859-1").cast("string")


def _title(raw: str) -> str:
    try:
        return raw.encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return raw


def decode(rows: DataFrame, file: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw cells as text: UTF-8 in files whose cells all are, else Latin-1.

    ``rows`` are raw cells beside ``file``, which names the file of a row, and columns to ``keep`` as they are. The files
    that are not UTF-8 are a stored table, joined by name; it is broadcast only after its rows were counted.
    """
    cells = [c for c in rows.columns if c != file and c not in keep]
    carried = [file, *keep]
    utf8 = {c: _as_utf8(named(c)) for c in cells}
    bad = any_of([~F.is_valid_utf8(utf8[c]) for c in cells])
    foreign = stored(rows.where(bad).select(F.col(file).alias("__foreign")).distinct(), "foreign_files")
    n_foreign = foreign.count()
    if not n_foreign:
        return rows.select(*carried, *[utf8[c].alias(_title(c)) for c in cells])
    side = F.broadcast(foreign) if n_foreign <= FILES_TO_BROADCAST else foreign
    joined = rows.join(side, F.col(file) == F.col("__foreign"), "left")
    own = F.col("__foreign").isNull()
    return joined.select(*carried, *[F.when(own, utf8[c]).otherwise(named(c)).alias(_title(c)) for c in cells])


def read_csv_text(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    """All columns as text. Files that are not valid UTF-8 are read as Latin-1."""
    scan = csv_scan(spark, path, multiline)
    rows = scan.select(F.col("_metadata.file_path").alias("__file"), *map(named, scan.columns))
    return decode(rows, "__file").drop("__file")


def read_csv_snapshot(spark: SparkSession, path, multiline: bool = False, **options) -> DataFrame:
    """CSV files as a sheet, numbered over all files in the order of their names, whatever their encodings.

    The files are read once: rows, encodings and numbers all come from the stored rows.
    """
    placed = place_rows(csv_scan(spark, path, multiline))
    rows = decode(placed, "__path", ("__block", "__seen"))
    return as_snapshot(number_placed(rows, placed), **options)


def infer_types(df: DataFrame, tokens=NULL_TOKENS) -> DataFrame:
    """Type text columns by their values: whole numbers, then numbers, then booleans, else text.

    One fused aggregate decides; missing-value words count as NULL and become NULL in typed columns.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    agg = []
    value = {c: F.when(~named(c).isin(*tokens), F.trim(named(c))) for c in names}
    for i, c in enumerate(names):
        agg += [
            F.count(value[c]).alias(f"n_{i}"),
            F.count(parse_whole(value[c])).alias(f"b_{i}"),
            F.count(parse_number(value[c])).alias(f"d_{i}"),
            F.count_if(F.lower(value[c]).isin("true", "false")).alias(f"t_{i}"),
        ]
    seen = df.agg(*agg).first()

    def typed(c):
        if c not in names:
            return named(c)
        i = names.index(c)
        n = seen[f"n_{i}"]
        if n and seen[f"b_{i}"] == n:
            return value[c].try_cast("bigint").alias(c)
        if n and seen[f"d_{i}"] == n:
            return parse_number(value[c]).alias(c)
        if n and seen[f"t_{i}"] == n:
            return (F.lower(value[c]) == "true").alias(c)
        return F.when(~named(c).isin(*tokens), named(c)).alias(c)

    return df.select(*[typed(c) for c in df.columns])


def read_csv(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    return infer_types(read_csv_text(spark, path, multiline))


def read_json(spark: SparkSession, path, array_file: bool = False, variant: bool = False) -> DataFrame:
    """Records from JSON lines, or from files that hold one array each (``array_file``).

    ``variant`` keeps every field's own type per row, for the mixed-type check.
    """
    reader = spark.read.option("multiLine", array_file)
    if not variant:
        return reader.json(path)
    names = reader.json(path).columns
    records = reader.schema(", ".join(f"`{c}` variant" for c in names)).json(path)
    return records


def read_records(spark: SparkSession, path: str, **options) -> DataFrame:
    """A file or folder by its extension: csv or json."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, array_file=options.pop("array_file", kind == "json"), **options)
    raise ValueError(f"Unsupported file format: {kind}")


def dataset_metadata(scan: DataFrame, name: str, file_type: str) -> DataFrame:
    """One row: name, rows, columns, size in KB to two places, type.

    Rows are counted per file first, so the sizes come from one small row per file.
    """
    per_file = scan.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("n"), F.first("_metadata.file_size").alias("bytes")
    )
    return per_file.agg(
        F.lit(name).alias("filename"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.lit(",".join(scan.columns)).alias("columns"),
        F.format_string("%.2f", F.coalesce(F.sum("bytes"), F.lit(0)) / 1024.0).alias("size_kb"),
        F.lit(file_type).alias("file_type"),
    )
