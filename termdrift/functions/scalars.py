"""Scalar functions with the semantics of the analysis where Spark's differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that strip() removes, and texts that count as missing on reading.
BLANKS = " \t\r\n\f\v"
NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def strip(c: Column) -> Column:
    """Without all blanks at both ends; trim() takes spaces alone."""
    return F.btrim(c, F.lit(BLANKS))


def split_list(c: Column, mark: str = "|") -> Column:
    """The parts between marks, literally; empty parts stay."""
    return F.split(c, f"[{mark}]", -1)


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_VALUES), c)


def known(c: Column) -> Column:
    """NaN as null, so that comparisons are false for it and aggregates skip it."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def relative_change(old: Column, new: Column) -> Column:
    """(new - old) / old, a fraction. From nothing to something is infinite; from nothing to nothing is unknown."""
    up = F.when(new > 0, F.lit(float("inf"))).when(new < 0, F.lit(float("-inf")))
    return F.when(old == 0, up).otherwise((new - old) / F.nullif(old, F.lit(0)))


def share(part: Column, whole: Column) -> Column:
    """part in percent of whole; an empty whole counts as 1."""
    return F.lit(100) * part / F.when(whole == 0, 1).otherwise(whole)


def depth_bin(c: Column) -> Column:
    """(0, .33] Shallow, (.33, .67] Medium, (.67, 1] Deep; 0 itself and what lies outside is in no bin."""
    return F.when((c > 0) & (c <= 0.33), "Shallow").when((c > 0.33) & (c <= 0.67), "Medium").when((c > 0.67) & (c <= 1), "Deep")


def bin_order(c: Column) -> Column:
    return F.when(c == "Shallow", 1).when(c == "Medium", 2).when(c == "Deep", 3)
