"""Text functions of the name search, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column
from pyspark.sql import functions as F

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """ASCII letters lowered; others stay."""
    return F.translate(text, CAPITALS, SMALL)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits or of any non-ASCII characters, folded."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9\x{80}-\x{10FFFF}]+"), F.lit(0))


def _picks(sizes: list[int], minor: int, at: int = 0) -> Iterator[tuple[int, ...]]:
    """In order, the places below `sizes` of which `minor` are not the first."""
    if at == len(sizes):
        yield ()
        return
    if len(sizes) - at - 1 >= minor:
        yield from ((0, *rest) for rest in _picks(sizes, minor, at + 1))
    if minor:
        yield from ((k, *rest) for k in range(1, sizes[at]) for rest in _picks(sizes, minor - 1, at + 1))


def pinyin_variants(name: str, readings: dict[str, list[str]], most: int = 8) -> list[tuple[list[str], int]]:
    """(syllables, number of minor readings) of a name, main readings first; characters without a reading are left out.

    Variants are made by their number of minor readings, then by the readings' places, and only `most` of them: the
    last `most` characters with several readings give that many with one minor reading, so no others are varied.
    """
    each = [readings[c][:most] for c in name if c in readings]
    if not each:
        return []
    several = [i for i, r in enumerate(each) if len(r) > 1][-most:]
    ranked = islice((p for minor in range(len(several) + 1) for p in _picks([len(each[i]) for i in several], minor)), most)
    return [([r[chosen.get(i, 0)] for i, r in enumerate(each)], sum(map(bool, pick))) for pick in ranked for chosen in [dict(zip(several, pick))]]
