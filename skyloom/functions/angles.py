"""Angles in the notations that catalogs use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(text: Column) -> Column:
    return F.split(F.trim(text), r"[\s:]+")


def sexagesimal_ra(text: Column) -> Column:
    """``HH MM SS.s`` in degrees; null unless there are three numbers."""
    p = _parts(text)
    n = [p.getItem(i).try_cast("double") for i in range(3)]
    return F.when(F.size(p) == 3, (n[0] + n[1] / 60.0 + n[2] / 3600.0) * 15.0)


def sexagesimal_dec(text: Column) -> Column:
    """``+DD MM SS.s`` in degrees, the sign taken from the text (``-00 30 00`` is negative); null unless there are three numbers."""
    p = _parts(text)
    n = [F.abs(p.getItem(i).try_cast("double")) for i in range(3)]
    size = n[0] + n[1] / 60.0 + n[2] / 3600.0
    return F.when(F.size(p) == 3, F.when(F.startswith(F.trim(text), F.lit("-")), -size).otherwise(size))
