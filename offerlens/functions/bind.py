"""Naming an intermediate value inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which stands once in the expression however often ``body`` uses it.

    Without it a value that is used in several places is copied into each, and
    copies of copies make plans that take seconds to compile.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
