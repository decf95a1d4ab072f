"""Joining the title and the description of a product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import require_columns, string_columns


def strip(c: Column) -> Column:
    """Trim any Unicode white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def fill_text_nulls(df: DataFrame, columns: list[str] | None = None, value: str = "") -> DataFrame:
    columns = string_columns(df) if columns is None else columns
    return require_columns(df, columns).na.fill(value, subset=columns)


def merge_title_description(title: Column, description: Column, sep: str | None = None) -> Column:
    """``title + ' ' + description``; a missing side keeps its blank."""
    joiner = f" {sep} " if sep else " "
    return F.concat(blank(title), F.lit(joiner), blank(description))


def raw_text(title: Column, description: Column) -> Column:
    return strip(F.concat(strip(blank(title)), F.lit(" "), strip(blank(description))))


def build_text(
    df: DataFrame,
    title: str = "designation",
    description: str = "description",
    empty_token: str = "[EMPTY]",
) -> Column:
    """Stripped text from whichever of the two columns exists; rows are never dropped."""
    present = [c for c in (title, description) if c in df.columns]
    if not present:
        raise ValueError(f"neither {title} nor {description} in {df.columns}")
    parts = [strip(blank(F.col(c).cast("string"))) for c in present]
    text = parts[0] if len(parts) == 1 else strip(F.concat(parts[0], F.lit(" "), parts[1]))
    return F.when(F.length(text) == 0, F.lit(empty_token)).otherwise(text)
