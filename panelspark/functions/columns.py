"""Column expressions for cleaning, parsing, rating and display."""

from __future__ import annotations

import calendar
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def recode(col: Column, mapping: dict[str, str | None], default: Column | str | None = "keep") -> Column:
    """Replace listed labels; others stay (``"keep"``) or become ``default``, null included.

    A label mapped to None becomes null.
    """
    fallback = col if isinstance(default, str) and default == "keep" else default
    if isinstance(fallback, str):
        fallback = F.lit(fallback)
    if fallback is None:
        fallback = F.lit(None).cast("string")
    # one IN test per target label
    sources: dict[str | None, list[str]] = {}
    for label, target in mapping.items():
        sources.setdefault(target, []).append(label)
    out = fallback
    for target, labels in sources.items():
        out = F.when(col.isin(labels), F.lit(target).cast("string")).otherwise(out)
    return out


def regex_class(col: Column, pattern: str, label: str) -> Column:
    """``label`` where the pattern is found, the value itself elsewhere."""
    return F.when(col.rlike(pattern), F.lit(label)).otherwise(col)


def squish(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def norm_text(col: Column, case: str) -> Column:
    """Squash white space, then title or sentence case.

    Title case starts a word after white space and after marks such as ``-``,
    ``/``, ``&`` or ``(``, but not after an apostrophe, dot, colon or underscore.
    """
    text = squish(col)
    if case == "sentence":
        return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483647)))
    if case != "title":
        raise ValueError(f"unknown case {case!r}")
    # initcap only starts words after a blank: put one behind each mark, and take it out again
    opened = F.regexp_replace(text, r"([^\p{L}\p{N}\s'’.:_])", "$1\u0001 ")
    return F.regexp_replace(F.initcap(opened), "\u0001 ", "")


def remove_first(col: Column, literal: str) -> Column:
    """Drop the first occurrence of a literal."""
    at = F.locate(literal, col)
    return F.when(
        at > 0,
        F.concat(
            F.substring(col, F.lit(1), at - 1),
            F.substring(col, at + len(literal), F.length(col)),
        ),
    ).otherwise(col)


def parse_number(col: Column, scale: float = 1.0) -> Column:
    """Text with thousands separators to a double; unreadable text gives null."""
    return F.regexp_replace(F.trim(col), ",", "").try_cast("double") * F.lit(float(scale))


_MONTH_NAMES = "|".join(
    name.lower() for m in range(1, 13) for name in (calendar.month_name[m], calendar.month_abbr[m])
)


def to_month(col: Column) -> Column:
    """'January 2022', 'Jan 2022' or '1 2022', in any letter case, to the first of that month.

    The shape is tested first, so that only readable text reaches the date parser:
    a miss there is an exception, caught, for every row.
    """
    text = F.lower(squish(col))
    short = F.initcap(F.regexp_replace(text, "^([a-z]{3})[a-z]*", "$1"))
    return F.when(text.rlike(rf"^({_MONTH_NAMES}) \d{{4}}$"), F.try_to_date(short, "MMM yyyy")).when(
        text.rlike(r"^(0?[1-9]|1[0-2]) \d{4}$"), F.try_to_date(text, "M yyyy")
    )


def month_from_parts(month: Column, year: Column) -> Column:
    return to_month(F.concat_ws(" ", month, year.cast("string")))


def null_if(col: Column, *sentinels: str) -> Column:
    return F.when(~col.isin(list(sentinels)), col)


def nan_to(col: Column, value: float = 0.0) -> Column:
    """NaN and null (which stands for 0/0 here) to ``value``."""
    return F.coalesce(F.nanvl(col, F.lit(float(value))), F.lit(float(value)))


def zero_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(0).cast("double"))


def rate(cases: Column, pop: Column, per: float = 1e6) -> Column:
    """Cases per ``per`` of population; a zero denominator gives null, not an error."""
    return F.try_divide(cases.cast("double"), pop.cast("double")) * F.lit(float(per))


def row_sum(cols: Sequence[Column], skip_nulls: bool) -> Column:
    """Sum across columns: nulls count as 0, or make the result null."""
    parts = [F.coalesce(c, F.lit(0)) for c in cols] if skip_nulls else list(cols)
    return reduce(lambda a, b: a + b, parts)


def comma(col: Column, decimals: int = 0) -> Column:
    return F.format_number(col.cast("double"), decimals)


def count_with_share(count: Column, total: Column) -> Column:
    """'1,234 (12.50%)'; the share of an empty total reads 0."""
    share = F.coalesce(F.round(F.try_divide(count.cast("double"), total.cast("double")) * 100, 2), F.lit(0.0))
    return F.concat(comma(count), F.lit(" ("), F.format_number(share, 2), F.lit("%)"))


def range_label(label: Column) -> Column:
    """'1234.5-2000' to '1,234.50 – 2,000.00'; anything else stays."""
    low = F.regexp_extract(label, r"^([0-9.]+)-([0-9.]+)$", 1)
    high = F.regexp_extract(label, r"^([0-9.]+)-([0-9.]+)$", 2)
    text = F.concat(
        F.format_number(low.try_cast("double"), 2), F.lit(" – "), F.format_number(high.try_cast("double"), 2)
    )
    return F.when(low != "", text).otherwise(label)
