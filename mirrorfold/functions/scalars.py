"""Column functions of the engine: hashes, text measures, set and vector scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain
MIN_NODES, KGRAM, SLOTS, BANDS, ROWS = 30, 5, 128, 32, 4
FUSED, LSH_ONLY, LSH_NODES, SIZE_RATIO = 0.85, 0.90, 40, 4
RESCUE_OVERLAP, RESCUE_JACCARD, RESCUE_NODES, COSINE = 0.75, 0.65, 30, 0.80
SUPPORT, PROMOTE, SHAPE_SAME, TOKENS_SAME = 0.70, 0.85, 0.99, 0.95
NEAR_SHAPE, NEAR_CONTENT, SIMILAR_CONTENT, SHAPE_ONLY_MAX = 0.90, 0.70, 0.50, 0.05
PRIME = 2_147_483_647


def h60(x: Column) -> Column:
    """A stable 60-bit hash."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")


def h28(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")


def affine(h: Column, slot: Column | int) -> Column:
    """Slot's value of a 28-bit hash, below PRIME."""
    slot = F.lit(slot) if isinstance(slot, int) else slot
    return (h * (slot * 2654435 + 97) + (slot * 40503 + 11)) % PRIME


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^ \n\t\r]+"), F.lit(0))


def kgrams(tokens: Column, k: int = KGRAM) -> Column:
    """Runs of k tokens, space-joined; none below k."""

    def runs(t: Column) -> Column:
        return F.when(F.size(t) >= k, F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.array_join(F.slice(t, i, k), " "))).otherwise(F.array().cast("array<string>"))

    # as a lambda's variable the tokens are worked out once, not for each run
    return F.element_at(F.transform(F.array(tokens), runs), 1)


def shingles(text: Column, width: int = 8) -> Column:
    """Distinct substrings of `width`; the whole text if shorter."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - width + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(width))))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def signature_estimate(a: Column, b: Column) -> Column:
    """The share of equal slots."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def finite(x: Column) -> Column:
    """Non-finite and missing scores are 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def fused(*axes: Column) -> Column:
    """The best axis, within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), *map(finite, axes)))


def cosine(a: Column, b: Column) -> Column:
    """In doubles, within 0 and 1; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norm)))


def line_count(text: Column) -> Column:
    """Newlines and a trailing partial line; an empty text has none."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return (newlines + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """0 to 100; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(F.least(F.lit(100.0), part * 100.0 / whole), 4))


def covers(a: Column, a_end: Column, b: Column, b_end: Column) -> Column:
    return (a <= b) & (b_end <= a_end)


def overlaps(a: Column, a_end: Column, b: Column, b_end: Column) -> Column:
    return (a < b_end) & (b < a_end)


def strictly_encloses(a: Column, a_end: Column, b: Column, b_end: Column) -> Column:
    return covers(a, a_end, b, b_end) & ((a < b) | (b_end < a_end))


def partially_overlaps(a: Column, a_end: Column, b: Column, b_end: Column) -> Column:
    return overlaps(a, a_end, b, b_end) & ~covers(a, a_end, b, b_end) & ~covers(b, b_end, a, a_end)


def folded(text: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(text, r"[ \n\t\r]+", "")


def severity(mass: Column) -> Column:
    return F.when(mass >= 1000, "high").when(mass >= 100, "medium").otherwise("low")


def line_of(text: Column, at: Column) -> Column:
    """The line, from 1, of a character offset."""
    head = F.substr(text, F.lit(1), at.cast("int"))
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1).cast("long")
