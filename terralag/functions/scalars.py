"""Scalar helpers: text to number, date and list, guarded clipping and masking."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def decimal_comma(c: Column) -> Column:
    """Text with a decimal comma to double; NULL when it is no number."""
    return F.regexp_replace(c, ",", ".").try_cast("double")


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def parse_minutes(c: Column) -> Column:
    """``31-12-2021 15:53`` to a timestamp without zone."""
    return F.try_to_timestamp(c, F.lit("dd-MM-yyyy HH:mm")).cast("timestamp_ntz")


def format_minutes(c: Column) -> Column:
    return F.date_format(c, "dd-MM-yyyy HH:mm")


def parse_day(c: Column) -> Column:
    """``31/12/2021`` to a date."""
    return F.try_to_timestamp(c, F.lit("dd/MM/yyyy")).cast("date")


def clip(c: Column, low: Column, high: Column) -> Column:
    """``c`` held inside ``[low, high]``; NULL stays NULL (plain ``least`` would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def mask_outside(c: Column, low: Column, high: Column) -> Column:
    """NULL where ``c`` lies outside ``[low, high]``."""
    return F.when(c.between(low, high), c)


def parse_names(c: Column) -> Column:
    """A list of names written as ``['a', 'b']`` to an array of strings."""
    return F.from_json(F.translate(c, "'", '"'), "array<string>")


def next_month_start(c: Column) -> Column:
    """The first day of the month after ``c``."""
    return F.add_months(F.trunc(c, "month"), 1)


def month_end(c: Column) -> Column:
    return F.last_day(F.to_date(c))


def label_score(c: Column, threshold: float = 0.7) -> Column:
    return F.when(c >= threshold, "good").otherwise("poor")


def in_band_percent(c: Column, low: float = 65.0, high: float = 75.0) -> Column:
    """Aggregate: percentage of rows with ``c`` in the band; NULL rows count as outside."""
    return F.lit(100.0) * F.avg(F.coalesce(c.between(low, high), F.lit(False)).cast("int"))
