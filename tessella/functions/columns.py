"""Column expressions that plans share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def nearest_rank(value: str, q: float) -> Column:
    """The nearest-rank percentile of a column; null rows don't count, null without rows."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def rounded(x: Column, digits: int = 4) -> Column:
    return F.round(x, digits)


def as_number(text: Column) -> Column:
    """A number from text; blanks, words for nothing and what isn't finite are null, never zero."""
    known = ~F.lower(F.trim(text)).isin("", "none", "null", "nan", "-", "na", "n/a")
    number = text.try_cast("double")
    return F.when(known & ~F.isnan(number) & (F.abs(number) < float("inf")), number)


def words(text: Column) -> Column:
    """Runs of characters that aren't ASCII white space."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def apdex_score(ms: Column, error: Column, t: float) -> list[Column]:
    """Counts of satisfied, tolerating and frustrated calls, and (s + t / 2) / measured. Errors are frustrated."""
    ok = ms.isNotNull() & ~error
    satisfied, tolerating = F.count_if(ok & (ms <= t)), F.count_if(ok & (ms > t) & (ms <= 4 * t))
    measured = F.count_if(ms.isNotNull() | error)
    return [satisfied.alias("satisfied"), tolerating.alias("tolerating"), (measured - satisfied - tolerating).alias("frustrated"), F.round(F.try_divide(satisfied + tolerating / 2, measured), 6).alias("apdex")]


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers, in doubles and in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def reasons(*named: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in named)), lambda x: x.isNotNull())


def semver_key(text: Column) -> Column:
    """A sortable key of a semantic version, null if it isn't one: numbers, then whether it is a release, then the parts of a
    pre-release, where numbers come before words. Build marks don't count."""
    shape = r"^\s*v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?\s*$"
    part = lambda k: F.regexp_extract(text, shape, k)
    pre = part(4)
    ids = F.transform(F.split(pre, r"\."), lambda x: F.struct((~x.rlike(r"^\d+$")).alias("word"), F.coalesce(x.try_cast("long"), F.lit(0)).alias("number"), F.when(x.rlike(r"^\d+$"), "").otherwise(x).alias("name")))
    return F.when(text.rlike(shape), F.struct(part(1).cast("long").alias("major"), part(2).cast("long").alias("minor"), part(3).cast("long").alias("patch"), (pre == "").alias("release"), ids.alias("ids")))


def inside_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies inside a ring of corners: a ray from it crosses an odd number of sides."""
    crossed = [
        ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True) if y1 != y2
    ]
    return sum((c.cast("int") for c in crossed[1:]), crossed[0].cast("int")) % 2 == 1
