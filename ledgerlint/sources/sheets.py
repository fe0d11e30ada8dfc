"""Sheets exported as nested JSON, and the cell form of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHEET_SCHEMA = (
    "id bigint, name string, totalRowCount bigint, "
    "columns array<struct<id: bigint, title: string, type: string, primary: boolean>>, "
    "rows array<struct<id: bigint, rowNumber: bigint, "
    "cells: array<struct<columnId: bigint, rowId: bigint, value: variant, displayValue: string>>>>"
)


def read_sheet_pages(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    """Sheet exports: one JSON object per page of rows."""
    return spark.read.schema(SHEET_SCHEMA).option("multiLine", multiline).json(path)


def _sheet_rows(pages: DataFrame) -> DataFrame:
    """(titles, row_id, row_number, cells); a row without an id takes that of its first cell."""
    titles = F.map_from_entries(
        F.transform("columns", lambda c: F.struct(c["id"].alias("key"), c["title"].alias("value")))
    )
    return pages.select(titles.alias("titles"), F.explode("rows").alias("r")).select(
        "titles",
        F.coalesce("r.id", F.try_element_at("r.cells", F.lit(1))["rowId"]).alias("row_id"),
        F.col("r.rowNumber").alias("row_number"),
        F.col("r.cells").alias("cells"),
    )


def _cell_title(cell: Column) -> Column:
    """The title that the sheet gives the column, else Unknown_<id>."""
    return F.coalesce(
        F.try_element_at("titles", cell["columnId"]), F.concat(F.lit("Unknown_"), cell["columnId"].cast("string"))
    )


def _cell_text(cell: Column) -> Column:
    """The shown value if there is one, else the stored one; nested values as JSON."""
    kind = F.schema_of_variant(cell["value"])
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.coalesce(
        cell["displayValue"],
        F.when(nested, F.to_json(cell["value"])).otherwise(F.try_variant_get(cell["value"], "$", "string")),
    )


def sheet_cells(pages: DataFrame) -> DataFrame:
    """(row_id, row_number, column_id, title, value): the cells of all pages, without any join."""
    rows = _sheet_rows(pages).withColumn("cell", F.explode("cells"))
    cell = F.col("cell")
    return rows.select(
        "row_id", "row_number", F.col("cell.columnId").alias("column_id"),
        _cell_title(cell).alias("title"), _cell_text(cell).alias("value"),
    )


def sheet_titles(pages: DataFrame) -> list[str]:
    """Titles in sheet order, then unlisted columns; one small row per column is read back."""
    listed = (
        pages.select(F.posexplode("columns").alias("place", "c"))
        .groupBy(F.col("c.title").alias("title"))
        .agg(F.min("place").alias("place"))
    )
    known = [r["title"] for r in listed.orderBy("place", "title").collect()]
    used = sheet_cells(pages).select("title").distinct().orderBy("title").collect()
    return known + [r["title"] for r in used if r["title"] not in known]


def sheet_rows(pages: DataFrame, titles) -> DataFrame:
    """(row_id, row_number, one text column per title).

    All cells of a row sit in the same array, so the row is built in place: no explode, no pivot,
    no shuffle. Of two cells of the same column the last one counts.
    """
    def cell_of(title):
        matching = F.filter("cells", lambda cell: _cell_title(cell) == title)
        return F.try_element_at(F.transform(matching, _cell_text), F.lit(-1)).alias(title)

    return _sheet_rows(pages).select("row_id", "row_number", *[cell_of(t) for t in titles])


def read_sheet(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    pages = read_sheet_pages(spark, path, multiline)
    return sheet_rows(pages, sheet_titles(pages))


def cells_to_rows(cells: DataFrame, titles) -> DataFrame:
    """Wide rows from cells that lie in separate rows; given titles spare the pivot a pass."""
    return (
        cells.groupBy("row_id", "row_number")
        .pivot("title", list(titles))
        .agg(F.first("value", ignorenulls=True))
    )


def rows_to_cells(df: DataFrame, id_columns=("row_id", "row_number"), first_column_id: int = 100) -> DataFrame:
    """(ids, column_id, title, value, display_value): empty text is NULL, shown as empty text."""
    names = [c for c in df.columns if c not in id_columns]
    text = df.select(*id_columns, *[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    cells = text.unpivot(list(id_columns), names, "title", "value")
    places = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(first_column_id + i))])
    value = F.when(F.col("value") != "", F.col("value"))
    return cells.select(
        *id_columns,
        places[F.col("title")].cast("bigint").alias("column_id"),
        "title",
        value.alias("value"),
        F.coalesce(value, F.lit("")).alias("display_value"),
    )
