"""Choosing a blend weight: bounds, criteria, sweeps and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import between, hidden, rounded
from .learning import BAYES

# fixed values: criteria and why one may choose nothing
SMALLEST, BALANCE, GAP, HEADROOM = "smallest", "gmm-balance", "surface-gap", "order-headroom"
REASONS = {SMALLEST: "no_feasible_alpha", BALANCE: "no_bayes_optimal_fit", GAP: "no_surface_baseline", HEADROOM: "no_undetectable_alpha"}
NEEDS = {SMALLEST: (), BALANCE: (), GAP: ("surface_baseline",), HEADROOM: ("surface_baseline", "synthetic_detectability")}


@dataclass(frozen=True)
class Settings:
    """Criteria with their bounds; separability has to lie in [min_separability, 2 * max_auc - 1]."""

    criteria: tuple[str, ...] = (SMALLEST,)
    min_separability: float = 0.2
    max_auc: float = 0.9
    target_resolvable: float = 0.5
    max_detect_auc: float = 0.7

    def __post_init__(self) -> None:
        if unknown := set(self.criteria) - set(REASONS):
            raise ValueError(f"unknown criteria: {sorted(unknown)}")
        object.__setattr__(self, "criteria", tuple(dict.fromkeys(self.criteria)))

    def check(self, enabled: Sequence[str]) -> None:
        """Fail before any work if a criterion's profile part is off."""
        for c in self.criteria:
            if missing := set(NEEDS[c]) - set(enabled):
                raise ValueError(f"{c} needs {sorted(missing)}")


def feasible(rows: DataFrame, settings: Settings) -> DataFrame:
    """P4. ``rows`` with ``feasible``."""
    return rows.withColumn("feasible", between(F.col("content_separability"), settings.min_separability, 2 * settings.max_auc - 1))


def _rank(criterion: str, settings: Settings, columns: Sequence[str]) -> tuple[Column, Column]:
    """Which rows a criterion can choose from, and the least of what it takes."""
    has = lambda c: F.col(c).isNotNull() if c in columns else F.lit(False)
    if criterion == SMALLEST:
        return F.lit(True), F.struct(F.lit(0.0).alias("r"), F.col("alpha").alias("a"))
    if criterion == BALANCE:
        return has("margin_pi_resolvable") & (F.col("margin_boundary_type") == BAYES if "margin_boundary_type" in columns else F.lit(False)), F.struct(F.abs(F.col("margin_pi_resolvable") - settings.target_resolvable).alias("r"), F.col("alpha").alias("a"))
    fits = has("surface_auc_gap")
    if criterion == HEADROOM:
        fits = fits & (hidden(F.col("detect_auc_lr"), settings.max_detect_auc) if "detect_auc_lr" in columns else F.lit(False))
    return fits, F.struct((-F.col("surface_auc_gap")).alias("r"), F.col("alpha").alias("a"))


def choose(rows: DataFrame, settings: Settings, by: Sequence[str] = ()) -> DataFrame:
    """W9. (criterion, chosen, n_feasible_alphas, reason) of each criterion over sweep rows."""
    held = feasible(rows, settings)
    out = None
    for number, c in enumerate(settings.criteria):
        fits, rank = _rank(c, settings, rows.columns)
        can = F.col("feasible") & F.coalesce(fits, F.lit(False))
        found = held.groupBy(*by).agg(F.min_by(F.when(can, F.col("alpha")), F.when(can, rank)).alias("chosen"), F.count_if("feasible").alias("n_feasible_alphas"))
        reason = F.when(F.col("chosen").isNotNull(), F.lit(None)).when(F.col("n_feasible_alphas") == 0, REASONS[SMALLEST]).otherwise(REASONS[c])
        one = found.select(*by, F.lit(number).alias("ordinal"), F.lit(c).alias("criterion"), "chosen", "n_feasible_alphas", reason.alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out


def sweep_report(rows: DataFrame, choices: DataFrame, settings: Settings) -> DataFrame:
    """M12. Sweep rows with ``feasible`` and the criteria that chose them."""
    chosen = choices.filter("chosen IS NOT NULL").groupBy(F.col("chosen").alias("alpha")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "criterion"))), lambda x: x["criterion"])).alias("chosen_by"))
    return feasible(rows, settings).join(chosen, "alpha", "left").orderBy("alpha")


def methodology(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M14. Report rows with doubles rounded half to even."""
    kinds = dict(rows.dtypes)
    return rows.select(*[rounded(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def threshold_grid(theta: float, start: float | None = None, count: int | None = None, step: float | None = None) -> list[float]:
    """M13. Thresholds of a sweep, the fitted one among them; whatever is not given is theta - 5, 11 and 1."""
    start, count, step = theta - 5 if start is None else start, 11 if count is None else count, 1.0 if step is None else step
    if count < 1 or step < 0.1:
        raise ValueError("a sweep needs at least one step, and steps of at least 0.1")
    return sorted({*(start + step * k for k in range(count)), theta})


def first_seen(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """A27. The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")
