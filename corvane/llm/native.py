"""Column helpers shared by the operators that stay inside DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the text contracts define it: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds `value` once per row for `body`.

    A lambda that refers to an outer expression evaluates it again for every element, and an array that
    comes from a column costs a copy for every slice. A bound lambda variable has neither cost.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def non_null(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def space_words(text: Column) -> Column:
    """Maximal runs of other characters than SPACE."""
    return F.array_remove(F.split(text, SPACE), "")


def window_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of all runs of `width` words, by start; empty if there are fewer words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width)))).otherwise(F.expr("array()").cast("array<bigint>")))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by `folds`; rows without an id are held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))
