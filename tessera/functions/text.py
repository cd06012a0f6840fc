"""Text functions as native column expressions: similarities, tokens and shape of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: common English words that carry no meaning of their own
STOPWORDS = tuple(
    """a about above after again against all am an and any are as at be because been before being below between both but by can could
    did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in
    into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same
    she should so some such than that the their theirs them themselves then there these they this those through to too under until up
    very was we were what when where which while who whom why will with would you your yours yourself yourselves""".split()
)

TOKEN = r"(?U)\b\w{2,}\b"
SPACES = r"(?U)\s+"


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """White-space tokens; none of null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; two empty ones score 0."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)).cast("double")


def _chars(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text, "")), lambda c: (c != " ") & (c != ""))


def _ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams; the length is checked by the caller."""
    last = F.greatest(F.char_length(text) - (n - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda k: F.substring(text, k, F.lit(n))))


def ngram_similarity(a: Column, b: Column, n: int = 3) -> Column:
    """F1. Jaccard similarity of character n-grams, ignoring case; of characters but spaces if either text is shorter than n."""
    a, b = F.lower(a), F.lower(b)
    short = (F.char_length(a) < n) | (F.char_length(b) < n)
    return F.when(short, jaccard(_chars(a), _chars(b))).otherwise(jaccard(_ngrams(a, n), _ngrams(b, n)))


def token_similarity(a: Column, b: Column) -> Column:
    """F2. Jaccard similarity of white-space tokens, ignoring case."""
    return jaccard(words(F.lower(a)), words(F.lower(b)))


def normal(text: Column) -> Column:
    """Lower-cased and stripped: what edit similarities compare."""
    return strip(F.lower(text))


def edit_similarity(a: Column, b: Column) -> Column:
    """F6. One less the Levenshtein distance over the longer length, of lower-cased, stripped texts."""
    return normal_similarity(normal(a), normal(b))


def normal_similarity(a: Column, b: Column) -> Column:
    """F6 of texts that are normal already."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def normal_bound(a: Column, b: Column) -> Column:
    """No edit similarity of normal texts is larger: the shorter length over the longer. Cheap, for pruning before F6."""
    a, b = F.char_length(a), F.char_length(b)
    return F.when(F.greatest(a, b) == 0, F.lit(1.0)).otherwise(F.least(a, b) / F.greatest(a, b))


def tokens(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """F8. Distinct lower-cased tokens of two and more word characters that are no stopwords."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in stopwords])) if stopwords else found


def all_tokens(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """As ``tokens``, with repeats, matched before lower-casing (for term counts)."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda w: F.lower(w))
    return F.filter(found, lambda w: ~w.isin(*stopwords)) if stopwords else found


def common_prefix(a: Column, b: Column) -> Column:
    """F12. The start of ``a`` that ``b`` shares, ignoring case."""
    la, lb = F.lower(a), F.lower(b)
    shorter = F.least(F.char_length(a), F.char_length(b))
    places = F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda k: F.substring(la, k, F.lit(1)) != F.substring(lb, k, F.lit(1)))
    cut = F.when(F.size(places) > 0, F.array_min(places) - 1).otherwise(shorter)
    return F.when(shorter == 0, F.lit("")).otherwise(F.substring(a, F.lit(1), cut))


def blend(a: Column, b: Column) -> Column:
    """F13. Characters by turns, even places of ``a`` and odd ones of ``b``; the longer text's tail as it is."""
    longest = F.greatest(F.char_length(a), F.char_length(b))

    def at(k: Column) -> Column:
        one = lambda t: F.substring(t, k, F.lit(1))
        turn = F.when(k % 2 == 1, one(a)).otherwise(one(b))
        return F.when((k <= F.char_length(a)) & (k <= F.char_length(b)), turn).when(k <= F.char_length(a), one(a)).otherwise(one(b))

    return F.when(longest == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), at), ""))


def fallback_text(a: Column, b: Column) -> Column:
    """F14. The first word of more than two characters that is neither whole text, ignoring case; else ``a``."""
    either = F.concat(words(a), words(b))
    fits = F.filter(either, lambda w: (F.char_length(w) > 2) & (F.lower(w) != F.lower(a)) & (F.lower(w) != F.lower(b)))
    return F.coalesce(F.try_element_at(fits, F.lit(1)), a)


def record_tokens(fields: Sequence[Column]) -> Column:
    """F16. Distinct lower-cased tokens of all fields of a record."""
    return F.array_distinct(F.flatten(F.array(*[words(F.lower(f.cast("string"))) for f in fields])))


def overlap_features(left: Column, right: Column) -> dict[str, Column]:
    """F17. Sizes and overlaps of two token sets: those that know the order, and those that do not."""
    a, b, shared = F.size(left), F.size(right), F.size(F.array_intersect(left, right))
    union = a + b - shared
    ratio = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    return {
        "left_size": a, "right_size": b, "shared": shared, "left_covered": ratio(shared, a), "right_covered": ratio(shared, b), "jaccard": ratio(shared, union),
        "smaller": F.least(a, b), "larger": F.greatest(a, b), "size_gap": F.abs(a - b), "union": union,
    }


FULL_FEATURES = ("left_size", "right_size", "shared", "left_covered", "right_covered", "jaccard")
SYMMETRIC_FEATURES = ("smaller", "larger", "size_gap", "shared", "jaccard")


def shape(fields: Sequence[Column]) -> dict[str, Column]:
    """F18. Empty fields, tokens and characters of a record."""
    texts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    total = lambda parts: sum(parts[1:], parts[0])
    return {
        "n_empty": total([F.when(strip(t) == "", 1).otherwise(0) for t in texts]),
        "n_tokens": total([F.size(words(t)) for t in texts]),
        "n_chars": total([F.char_length(t) for t in texts]),
    }
