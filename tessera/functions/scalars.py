"""Small numeric and label expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names of pair labels, and of datasets in reports
LABEL_NAMES = {0: "non-match", 1: "full match", 2: "forward-only", 3: "reverse-only"}


def ratio(a: Column, b: Column) -> Column:
    """A3. Null where the denominator is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def harmonic(alpha: float | Column, home: Column, target: Column) -> Column:
    """F9. Weighted harmonic mean of two similarities; 0 where either is not positive."""
    alpha = F.lit(alpha) if not isinstance(alpha, Column) else alpha
    return F.when((home > 0) & (target > 0), 1 / (alpha / home + (1 - alpha) / target)).otherwise(F.lit(0.0))


def home_share(home: Column, target: Column) -> Column:
    """F10. The home similarity's share of both; null where they sum to nothing."""
    return F.when(home + target > 0, home / (home + target))


def alpha_tag(alpha: Column) -> Column:
    """F22. Such as ``a065``."""
    return F.format_string("a%03d", F.bround(alpha * 100).cast("int"))


def rounded(value: Column, places: int = 2) -> Column:
    """F23. Half to even, as reports have it."""
    return F.bround(value, places)


def variant_name(dataset: Column, alpha: Column, links: Column | None = None, directed: bool = False) -> Column:
    """K6. ``amb_<dataset>_a<alpha>[_k<links>][_dir]``; one link goes unsaid."""
    parts = [F.lit("amb_"), dataset, F.lit("_"), alpha_tag(alpha)]
    if links is not None:
        parts.append(F.when(links > 1, F.concat(F.lit("_k"), links.cast("string"))).otherwise(F.lit("")))
    return F.concat(*parts, *([F.lit("_dir")] if directed else []))


def label_name(label: Column) -> Column:
    """P12."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in LABEL_NAMES.items() for x in pair]), label.cast("int"))


def display_name(dataset: Column, names: Mapping[str, str]) -> Column:
    """P13. A dataset's name in reports; its own where none is given."""
    if not names:
        return dataset
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), dataset), dataset)


def one_hot(label: Column, classes: int) -> Column:
    """F26. Weights of a certain label."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == label, 1.0).otherwise(0.0))


def degrade(label: Column, weights: Column) -> tuple[Column, Column]:
    """F24. A multi-class result as a binary one: the label at most 1, and the extreme weights, made to sum to one, the larger to that label."""
    low, high = F.array_min(weights), F.array_max(weights)
    total = low + high
    flat = F.least(label, F.lit(1))
    fair = F.when(total > 0, high / total).otherwise(F.lit(0.5))
    return flat, F.when(flat == 1, F.array(1 - fair, fair)).otherwise(F.array(fair, 1 - fair))


def uuid5(namespace: bytes, name: Column) -> Column:
    """F19. Name-based identifier of RFC 4122, version 5."""
    digest = F.sha1(F.concat(F.lit(bytearray(namespace)), name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def between(value: Column, low: float, high: float) -> Column:
    """P4. Inside an inclusive band; null is outside."""
    return F.coalesce(value.between(low, high), F.lit(False))


def hidden(detectability: Column, cap: float) -> Column:
    """P5. Known and at most the cap."""
    return F.coalesce(detectability <= cap, F.lit(False))
