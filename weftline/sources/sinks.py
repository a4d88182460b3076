"""Tables, reports and traces to write."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(rows: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def numbered(rows: DataFrame, after: int = 0) -> DataFrame:
    """The rows with ``__extract_id``, unique numbers greater than ``after`` that
    ascend within each partition; no row moves for them."""
    return rows.select((F.monotonically_increasing_id() + F.lit(after + 1)).alias("__extract_id"), *[c for c in rows.columns if c != "__extract_id"])


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """What a workbook would hold: a header and the rows."""
    rows.write.mode(mode).option("header", True).csv(path)


def aligned_lines(rows: DataFrame) -> DataFrame:
    """One ``value`` line per row with every column padded to its widest value,
    nulls as NULL, `` | `` between."""
    shown = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias(c) for c in rows.columns])
    widths = shown.agg(*[F.greatest(F.coalesce(F.max(F.length(c)), F.lit(0)), F.lit(len(c))).alias(c) for c in rows.columns]).first()
    return shown.select(F.concat_ws(" | ", *[F.rpad(c, widths[c], " ") for c in rows.columns]).alias("value"))


def write_text(rows: DataFrame, path: str) -> None:
    aligned_lines(rows).write.mode("overwrite").text(path)


def trace(events: DataFrame, path: str) -> None:
    """Events as JSON lines."""
    events.write.mode("append").json(path)


def sse(tokens: Iterable[str]) -> Iterator[str]:
    """Server-sent event lines of an answer's pieces, each as it comes."""
    try:
        for token in tokens:
            yield "data: " + token.replace("\n", "\\n") + "\n\n"
    except RuntimeError as error:
        yield f"data: [ERROR] {error}\n\n"
    yield "data: [DONE]\n\n"
