"""Column functions that several operators use. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def fold_text(text: Column) -> Column:
    """Lower case, without accents of the Latin letters, single spaces, trimmed."""
    folded = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.replace(folded, F.lit("ß"), F.lit("ss")), r"\s+", " "))


def equality(a: Column, b: Column) -> Column:
    """1 when equal, 0 when not, null when either is unknown."""
    return (a == b).cast("double")


def decay(a: Column, b: Column, span: float) -> Column:
    """Linear from 1 at no difference to 0 at ``span``."""
    return F.lit(1.0) - F.least(F.abs(a - b), F.lit(float(span))) / F.lit(float(span))


def set_jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def half_credit(wanted: Column, text: Column) -> Column:
    """1 when equal, a half when one text holds the other, else 0."""
    return F.when(wanted == text, 1.0).when(F.contains(text, wanted) | F.contains(wanted, text), 0.5).when(wanted.isNotNull() & text.isNotNull(), 0.0)


def regime_overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """1 for the same interval, a half when one holds the other, 0.3 when they meet, else 0."""
    same = (a_low == b_low) & (a_high == b_high)
    holds = ((a_low <= b_low) & (a_high >= b_high)) | ((b_low <= a_low) & (b_high >= a_high))
    meets = (a_low <= b_high) & (b_low <= a_high)
    return F.when(same, 1.0).when(holds, 0.5).when(meets, 0.3).otherwise(0.0)


def marker_decay(a: Column, b: Column, span: float) -> Column:
    """Mean decay over the markers that both maps hold; null when they share none."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    each = F.transform(shared, lambda k: decay(F.element_at(a, k), F.element_at(b, k), span))
    return F.when(F.size(shared) > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(shared))


def flag_compatibility(declared: Column, carried: Column) -> Column:
    """1 when every declared flag is carried too, 0.3 when one is not."""
    return F.when(F.size(F.array_except(declared, carried)) == 0, 1.0).otherwise(0.3)


def weighted_score(traits: Sequence[tuple[Column, float, bool]]) -> Column:
    """Weighted mean of matches. An original trait that is unknown counts a half; an added one (third entry) that is
    unknown leaves numerator and denominator."""
    top = bottom = F.lit(0.0)
    for match, weight, added in traits:
        if added:
            top = top + F.when(match.isNotNull(), match * weight).otherwise(0.0)
            bottom = bottom + F.when(match.isNotNull(), weight).otherwise(0.0)
        else:
            top, bottom = top + F.coalesce(match, F.lit(0.5)) * weight, bottom + F.lit(weight)
    return top / F.nullif(bottom, F.lit(0.0))


def grid_round(value: Column, step: float = 5.0) -> Column:
    """The nearest multiple of ``step``, halves to even; values up to one step stay."""
    return F.when(value > step, F.bround(value / step) * step).otherwise(value)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def age_on(born: Column, day: Column) -> Column:
    """Full years between two dates."""
    return F.floor(F.months_between(day, born, False) / 12).cast("int")


def bucket_of(value: Column, bounds: Sequence[tuple[float, str]], rest: str) -> Column:
    """The name of the first bound that the value is below; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in bounds:
        out = out.when(value < bound, name)
    return out.otherwise(rest)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision; null for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
