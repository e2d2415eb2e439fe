"""All matches of a pattern with their places, and replacement by a function, as column expressions.

Spark gives the matches of a pattern, but not where they stand; the lengths of what `split` leaves between
them do. Places count code points from 0. Patterns are Java patterns; start them with (?U) where \\d, \\w and
\\b are meant for all scripts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def record(**cols: Column) -> Column:
    """A struct with the given fields; inside lambdas names given by alias get lost."""
    return F.named_struct(*[x for k, v in cols.items() for x in (F.lit(k), v)])


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the matches, left to right, none inside another. Null text gives null."""
    values = matches(text, pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zero = record(at=F.lit(0), out=F.array().cast("array<struct<start:int,end:int,value:string>>"))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: record(g=g, v=v))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["g"]
        end = start + F.length(p["v"])
        return record(at=end, out=F.concat(acc["out"], F.array(record(start=start, end=end, value=p["v"]))))

    return F.aggregate(pairs, zero, step)["out"]


def around(text: Column, hits: Column, before: int = 100, after: int = 200) -> Column:
    """The hits with as much of the text before and after each as any grading looks at."""
    return F.transform(
        hits,
        lambda h: record(
            start=h["start"],
            end=h["end"],
            value=h["value"],
            before=F.substring(text, F.greatest(h["start"] - before, F.lit(0)) + 1, F.least(h["start"], F.lit(before))),
            after=F.substring(text, h["end"] + 1, F.lit(after)),
        ),
    )


def replace_all(text: Column, pattern: str, with_: Callable[[Column], Column]) -> Column:
    """The text with each match replaced by a function of it."""
    gaps = F.split(text, pattern, -1)
    new = F.concat(F.transform(matches(text, pattern), with_), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
