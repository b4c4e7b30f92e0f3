"""Writing tables: Spark tables, database import files, JDBC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import escape_bytes, escape_value, sanitize_text
from .ids import dense_index

# Fixed values of the export formats, with the lines that stand before and after a section.
ROWS_PER_INSERT = 256
JDBC_BATCH = 10_000
NULL_TSV = "\\N"
NULL_SQL = "NULL"
INSERT_HEADER = "/*!40000 ALTER TABLE `{table}` DISABLE KEYS */;\nLOCK TABLES `{table}` WRITE;"
INSERT_FOOTER = "UNLOCK TABLES;\n/*!40000 ALTER TABLE `{table}` ENABLE KEYS */;\n"
COPY_HEADER = 'COPY "{table}" FROM STDIN;'
COPY_FOOTER = "\\.\n"

ROWS_PER_FILE = ROWS_PER_INSERT * 1024


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """Each table as a Parquet folder below ``path``."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


# Join keys of the tables in an article lookup.
BUCKET_KEYS = {"page": "page_latest", "revision": "rev_id", "text": "old_id"}


def save_tables(tables: dict[str, DataFrame], database: str, buckets: int | None = None, mode: str = "error") -> None:
    """Each table as a catalog table; with ``buckets``, laid out by the keys that an article lookup joins on.

    Texts are then shuffled once, here, and never again by a lookup: page and revision meet bucket by bucket, and only
    ids travel to the buckets of the text table. Rows are sent to their bucket first, so that a bucket is one file.
    """
    for name, df in tables.items():
        key = BUCKET_KEYS.get(name)
        if buckets and key:
            writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        else:
            writer = df.write
        writer.format("parquet").mode(mode).saveAsTable(f"{database}.{name}")


def _field(field: T.StructField, quotes: bool) -> Column:
    """One value as export text; null stays null."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BinaryType):
        return escape_bytes(c, quotes)
    if isinstance(field.dataType, T.StringType):
        return escape_value(sanitize_text(c), quotes)
    return c.cast("string")


def tsv_line(schema: T.StructType) -> Column:
    """Tab-separated values with backslash escapes and ``\\N`` for null."""
    return F.concat_ws("\t", *[F.coalesce(_field(f, False), F.lit(NULL_TSV)) for f in schema])


def insert_values(schema: T.StructType) -> Column:
    """``(1,'a',NULL)``: strings and bytes are quoted, numbers are not."""
    values = []
    for f in schema:
        value = _field(f, True)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            value = F.concat(F.lit("'"), value, F.lit("'"))
        values.append(F.coalesce(value, F.lit(NULL_SQL)))
    return F.concat(F.lit("("), F.concat_ws(",", *values), F.lit(")"))


def tsv_lines(df: DataFrame) -> DataFrame:
    return df.select(tsv_line(df.schema).alias("line"))


def write_tsv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Import text files; a pure projection, one file per partition."""
    tsv_lines(df).write.mode(mode).text(path)


def _placed(df: DataFrame, line: Column, order: Sequence[str]) -> DataFrame:
    """Rows as ``line`` with their global position ``idx``; ``is_last`` marks the very last one.

    ``df`` is read three times (sample, keys, lines), so it should be a stored table.
    """
    index = dense_index(df, order, order)
    total = index.count()  # counts the written keys, not the source
    rows = df.select(*order, line.alias("line")).join(index, list(order))
    return rows.select("idx", (F.col("idx") == total - 1).alias("is_last"), "line")


def mysql_insert_lines(
    df: DataFrame, table: str, order: Sequence[str], rows_per_insert: int = ROWS_PER_INSERT
) -> DataFrame:
    """(idx, is_last, statement, line): one line per row; a statement is a run of ``rows_per_insert`` lines.

    The position tells whether a line opens or ends a statement, so rows are never gathered. ``order`` must be a
    unique key.
    """
    step = F.col("idx") % rows_per_insert
    opening = F.when(step == 0, F.lit(f"INSERT INTO `{table}` VALUES ")).otherwise(F.lit(","))
    closing = F.when((step == rows_per_insert - 1) | F.col("is_last"), F.lit(";")).otherwise(F.lit(""))
    return _placed(df, insert_values(df.schema), order).select(
        "idx", "is_last", F.floor(F.col("idx") / rows_per_insert).cast("bigint").alias("statement"),
        F.concat(opening, F.col("line"), closing).alias("line"),
    )


def pg_copy_lines(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """(idx, is_last, line) for COPY; quotes stay as they are."""
    return _placed(df, tsv_line(df.schema), order)


def _write_sections(lines: DataFrame, header: str, footer: str, path: str, rows_per_file: int, mode: str) -> None:
    """Write lines in order, in sections that each stand between header and footer.

    A section is a run of ``rows_per_file`` positions: its size is bounded, and one task writes it. Every output file
    is a complete script, and the sections may be loaded in any order.
    """
    step = F.col("idx") % rows_per_file
    ends = (step == rows_per_file - 1) | F.col("is_last")
    framed = F.array_compact(F.array(
        F.when(step == 0, F.lit(header)), F.col("line"), F.when(ends, F.lit(footer))
    ))
    (
        lines.withColumn("section", F.floor(F.col("idx") / rows_per_file))
        .repartition("section")
        .sortWithinPartitions("idx")
        .select(F.explode(framed).alias("line"))
        .write.mode(mode).text(path)
    )


def write_mysql_insert(
    df: DataFrame, table: str, path: str, order: Sequence[str], rows_per_file: int = ROWS_PER_FILE, mode: str = "error"
) -> None:
    """INSERT scripts with locked table and disabled keys; ``rows_per_file`` must be a multiple of 256."""
    if rows_per_file % ROWS_PER_INSERT:
        raise ValueError(f"rows_per_file must be a multiple of {ROWS_PER_INSERT}")
    header, footer = INSERT_HEADER.format(table=table), INSERT_FOOTER.format(table=table)
    _write_sections(mysql_insert_lines(df, table, order), header, footer, path, rows_per_file, mode)


def write_pg_copy(
    df: DataFrame, table: str, path: str, order: Sequence[str], rows_per_file: int = ROWS_PER_FILE, mode: str = "error"
) -> None:
    """COPY scripts; build the tables with ``raw_timestamps=True`` for this format."""
    header = COPY_HEADER.format(table=table)
    _write_sections(pg_copy_lines(df, order), header, COPY_FOOTER, path, rows_per_file, mode)


def write_jdbc(
    df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None,
    batch_size: int = JDBC_BATCH, mode: str = "append",
) -> None:
    """Batched inserts; every partition opens its own connection, so bound them on the database's behalf."""
    df.write.jdbc(url, table, mode=mode, properties={**(properties or {}), "batchsize": str(batch_size)})
