"""Delimited tables: scan, multi-file scan, sink and delimiter change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from palaver.sources.records import read_records


#: The bytes of a file that one task reads whole.
SPLIT_ABOVE = 128 << 20


def read_delimited(
    spark: SparkSession,
    paths: str | list[str],
    delimiter: str = ",",
    header: bool = False,
    schema: str | None = None,
    multiline: bool = True,
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """All cells as text; empty cells are NULL, blank lines are skipped.

    Give ``schema`` to name the columns; without it the first line says how many there are. A row
    with fewer cells is filled up with NULL, one with more stops the job, as its further cells would
    be lost; ``read_cells`` reads rows of any length.

    Several paths are read as one table and each file's header is dropped. ``multiline`` lets
    a quoted cell hold line breaks. Files of at most ``split_above`` bytes are then one task each; if
    there is a larger one, all are read by ranges at the price of a shuffle (``records.read_records``).
    Turn it off when cells are known to be single lines. A cell with text after its closing quote
    is taken as it stands.
    """
    if multiline and _any_above(spark, paths, split_above):
        names = _columns(spark, paths, delimiter, header, schema, True)
        records = read_records(spark, paths, delimiter)
        if header:
            records = records.where("not is_first")
        found = records.select("record", split_record(F.col("record"), delimiter).alias("cells"))
        cells = [F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]
        return found.select(_refused("record", "cells", len(names), cells[0]).alias(names[0]), *cells[1:])
    rows = _with_records(spark, paths, delimiter, header, schema, multiline)
    names = rows.columns[:-1]
    rows = rows.withColumn("_cells", split_record(F.col(RECORD), delimiter))
    first = _refused(RECORD, "_cells", len(names), F.col(f"`{names[0]}`")).alias(names[0])
    return rows.select(first, *[F.col(f"`{n}`") for n in names[1:]])


def read_cells(
    spark: SparkSession,
    paths: str | list[str],
    delimiter: str = ",",
    multiline: bool = True,
    ordered: bool = False,
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """One array ``cells`` per row, of the row's own length; blank lines are skipped.

    ``ordered`` keeps each file's rows together and in their order, which makes a file of
    multi-line cells one task.
    """
    if multiline and not ordered and _any_above(spark, paths, split_above):
        record = F.col("record")
        return read_records(spark, paths, delimiter).select(split_record(record, delimiter).alias("cells"))
    rows = _with_records(spark, paths, delimiter, False, None, multiline)
    plain = F.array(*[F.col(f"`{n}`") for n in rows.columns[:-1]])
    record = F.col(RECORD)
    return rows.select(F.when(record.isNull(), plain).otherwise(split_record(record, delimiter)).alias("cells"))


def _any_above(spark: SparkSession, paths: str | list[str], size: int) -> bool:
    """Whether a file is larger than ``size``; only the listing is read."""
    return not spark.read.format("binaryFile").load(paths).select("length").where(F.col("length") > size).isEmpty()


def _refused(record: str, cells: str, most: int, value: Column) -> Column:
    """``value``, or an error for a row of more than ``most`` cells."""
    message = F.concat(F.lit(f"more than {most} cells: "), F.col(record))
    return F.when(F.size(cells) > most, F.raise_error(message).cast("string")).otherwise(value)


RECORD = "_record"


def split_record(record: Column, delimiter: str) -> Column:
    """The cells of one record as it stands in the file; empty ones are NULL."""
    sign = "\\" + delimiter
    cell = f'(?s){sign}("(?:[^"]++|"")*+"?[^{sign}]*+|[^{sign}]*+)'
    # With a delimiter before the first cell, too, no match is empty, not even that of an empty cell.
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(cell), F.lit(1))

    def bare(x: Column) -> Column:
        quoted = F.regexp_extract(x, r'(?s)\A"((?:[^"]++|"")*+)', 1)
        after = F.regexp_extract(x, r'(?s)\A"(?:[^"]++|"")*+"(.*)\z', 1)
        inner = F.replace(quoted, F.lit('""'), F.lit('"'))
        return F.nullif(F.when(x.startswith('"') & (after == ""), inner).otherwise(x), F.lit(""))

    return F.transform(found, bare)


def join_cells(cells: Column, delimiter: str) -> Column:
    """The record of an array of cells; the record of a single empty cell is not a blank line."""

    def quoted(x: Column) -> Column:
        needs = x.contains('"') | x.contains(delimiter) | x.rlike(r"[\r\n]|^\s|\s$")
        inside = F.replace(x, F.lit('"'), F.lit('""'))
        return F.when(needs, F.concat(F.lit('"'), inside, F.lit('"'))).otherwise(F.coalesce(x, F.lit("")))

    record = F.array_join(F.transform(cells, quoted), delimiter)
    return F.when(record == "", '""').otherwise(record)


def _reader(spark: SparkSession, delimiter: str, header: bool, multiline: bool) -> DataFrameReader:
    return (
        spark.read.option("sep", delimiter)
        .option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("maxCharsPerColumn", -1)
        .option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def _columns(
    spark: SparkSession, paths: str | list[str], delimiter: str, header: bool, schema: str | None, multiline: bool
) -> list[str]:
    """The names given, or those the first row tells."""
    reader = _reader(spark, delimiter, header, multiline)
    return (reader.csv(paths) if schema is None else reader.schema(schema).csv(paths)).columns


def _with_records(
    spark: SparkSession, paths: str | list[str], delimiter: str, header: bool, schema: str | None, multiline: bool
) -> DataFrame:
    """The table, and as its last column the record of each row that has another number of cells."""
    reader = _reader(spark, delimiter, header, multiline)
    columns = reader.schema(schema).csv(paths).schema if schema is not None else reader.csv(paths).schema
    reader = reader.option("columnNameOfCorruptRecord", RECORD)
    return reader.schema(StructType(columns.fields).add(RECORD, StringType())).csv(paths)


def write_delimited(
    df: DataFrame, path: str, delimiter: str = ",", header: bool = True, mode: str = "error"
) -> None:
    # In a table of one column an empty cell would be a blank line, and skipped when read.
    empty = '""' if len(df.columns) == 1 else ""
    (
        df.write.mode(mode)
        .option("sep", delimiter)
        .option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", empty)
        .option("nullValue", empty)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def transcode(
    spark: SparkSession,
    source: str,
    target: str,
    delimiter_in: str = ",",
    delimiter_out: str = ",",
    header: bool | None = None,
    split_above: int = SPLIT_ABOVE,
) -> None:
    """Rewrite a table with another delimiter; rows may differ in length.

    By default every input file becomes output files in its order and a header row is carried like
    any row, for which a file is read by one task. Say whether there is a ``header`` to have large
    files read by many tasks: each output file then begins with the first input's header, and rows
    come in no order.
    """
    def lines(cells: DataFrame) -> DataFrame:
        return cells.select(join_cells(F.col("cells"), delimiter_out).alias("value"))

    if header is None:
        lines(read_cells(spark, source, delimiter_in, ordered=True)).write.text(target)
    elif not header:
        lines(read_cells(spark, source, delimiter_in, split_above=split_above)).write.text(target)
    else:
        rows = read_delimited(spark, source, delimiter_in, header=True, split_above=split_above)
        write_delimited(rows, target, delimiter_out)


def nth(df: DataFrame, position: int) -> Column:
    """The column at a 1-based position, as coded tables are addressed."""
    if not 1 <= position <= len(df.columns):
        raise IndexError(f"no column {position} among {len(df.columns)}")
    return F.col(f"`{df.columns[position - 1]}`")
