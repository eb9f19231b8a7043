"""Calendar helpers as Column expressions (stay inside whole-stage codegen)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Analyses with a trailing window take the reference date of their tables.
DEFAULT_WINDOW_MONTHS = 24


def quarter_label(d: Column | str) -> Column:
    """'YYYY-Qn' label of a date."""
    d = F.col(d) if isinstance(d, str) else d
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def month_label(d: Column | str) -> Column:
    """'YYYY-MM' label of a date."""
    d = F.col(d) if isinstance(d, str) else d
    return F.date_format(d, "yyyy-MM")


def week_start(d: Column | str) -> Column:
    """Monday of the week containing the date, as DATE."""
    d = F.col(d) if isinstance(d, str) else d
    return F.date_trunc("week", d).cast("date")


def window_start(as_of: _dt.date, months: int = DEFAULT_WINDOW_MONTHS) -> Column:
    """First day (inclusive) of a trailing window of ``months`` ending at ``as_of``."""
    return F.add_months(F.lit(as_of), -months)
