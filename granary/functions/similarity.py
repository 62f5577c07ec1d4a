"""String similarities of record linkage, of built-in functions alone."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import canonical, levenshtein_similarity


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity; 1 for equal strings, 0 where one is empty, null where one is null.

    A fold over the characters of `a` keeps the places of `b` that are taken, in the order of `a`. Sorted, they give the
    order of `b`; characters that differ between the two orders are half transpositions.
    """
    x, y = F.split(a, ""), F.split(b, "")
    la, lb = F.length(a), F.length(b)
    reach = F.greatest(F.floor(F.greatest(la, lb) / 2) - 1, F.lit(0))
    places = F.sequence(F.lit(1), lb)

    def take(taken: Column, i: Column) -> Column:
        free = F.filter(places, lambda j: (F.abs(i - j) <= reach) & (F.element_at(y, j) == F.element_at(x, i)) & ~F.array_contains(taken, j))
        return F.concat(taken, F.slice(free, 1, 1))

    taken = F.aggregate(F.sequence(F.lit(1), la), F.array().cast("array<int>"), take)

    def of(taken: Column) -> Column:
        m = F.size(taken)
        moved = F.size(F.filter(F.zip_with(taken, F.array_sort(taken), lambda i, j: F.element_at(y, i) != F.element_at(y, j)), lambda z: z))
        return F.when(m == 0, F.lit(0.0)).otherwise((m / la + m / lb + (m - moved / 2) / m) / 3)

    # An array of one, so that the fold is written, and run, once.
    score = F.element_at(F.transform(F.array(taken), of), 1)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a == b, F.lit(1.0)).when((la == 0) | (lb == 0), F.lit(0.0)).otherwise(score)


def jaro_winkler(a: Column, b: Column, weight: float = 0.1, prefix: int = 4, least: float = 0.7) -> Column:
    """Jaro similarity, from `least` on raised by the length of the common prefix."""
    same = F.lit(0)
    for n in range(1, prefix + 1):
        same = F.when((F.length(a) >= n) & (F.length(b) >= n) & (F.left(a, F.lit(n)) == F.left(b, F.lit(n))), n).otherwise(same)
    raised = F.transform(F.array(jaro(a, b)), lambda s: F.when(s < least, s).otherwise(s + same * weight * (1 - s)))
    return F.element_at(raised, 1)


def name_similarity(a: Column, b: Column) -> Column:
    """The greater of Jaro-Winkler and edit similarity; at least 0.9 where all words of one are among the other's."""
    x, y = canonical(a), canonical(b)
    u, v = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    fewer = F.least(F.size(u), F.size(v))
    subset = (F.size(u) != F.size(v)) & (F.size(F.array_intersect(u, v)) == fewer)
    base = F.when(subset, F.lit(0.9)).otherwise(levenshtein_similarity(x, y))
    return F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(F.greatest(jaro_winkler(x, y), base))
