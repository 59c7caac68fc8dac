"""From met criteria to a five-tier call and a readable rule path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.operators.criteria import DECIDED, earned, strength_column, trail, with_strengths
from locusflow.settings import (
    BENIGN,
    BENIGN_CODES,
    BENIGN_POINTS,
    DEFAULTS,
    LIKELY_BENIGN,
    LIKELY_PATHOGENIC,
    PATHOGENIC,
    PATHOGENIC_POINTS,
    VUS,
    Thresholds,
)

# Counter name: (is benign, strength). Benign evidence has no moderate counter.
COUNTERS = {
    "pvs": (False, "very_strong"),
    "ps": (False, "strong"),
    "pm": (False, "moderate"),
    "pp": (False, "supporting"),
    "ba": (True, "stand_alone"),
    "bs": (True, "strong"),
    "bp": (True, "supporting"),
}


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0)


def evidence_counts(by_code: dict[str, Column]) -> dict[str, Column]:
    """Number of met codes per side and strength."""
    one = lambda strength, wanted: F.when(strength == wanted, 1).otherwise(0)
    return {
        name: _total([one(s, wanted) for code, s in by_code.items() if (code in BENIGN_CODES) == benign])
        for name, (benign, wanted) in COUNTERS.items()
    }


def pathogenic_label(n: dict[str, Column]) -> Column:
    pvs, ps, pm, pp = n["pvs"], n["ps"], n["pm"], n["pp"]
    return (
        F.when(
            (pvs >= 1) & ((ps >= 1) | (pm >= 2) | ((pm == 1) & (pp >= 1)) | (pp >= 2)),
            "PATH-1 (PVS1 + strong/moderate/supporting)",
        )
        .when(ps >= 2, "PATH-2 (>=2 Strong)")
        .when(
            (ps == 1) & ((pm >= 3) | ((pm >= 2) & (pp >= 2)) | ((pm == 1) & (pp >= 4))),
            "PATH-3 (1 Strong + Moderate/Supporting)",
        )
    )


def likely_pathogenic_label(n: dict[str, Column]) -> Column:
    pvs, ps, pm, pp = n["pvs"], n["ps"], n["pm"], n["pp"]
    return (
        F.when((pvs >= 1) & (pm >= 1), "LP-1 (PVS1 + Moderate)")
        .when((pvs >= 1) & (pp >= 1), "LP-1 (PVS1 + Supporting)")
        .when((ps == 1) & pm.between(1, 2), "LP-2 (1 Strong + 1-2 Moderate)")
        .when((ps == 1) & (pp >= 2), "LP-3 (1 Strong + >=2 Supporting)")
        .when(pm >= 3, "LP-4 (>=3 Moderate)")
        .when((pm >= 2) & (pp >= 2), "LP-5 (2 Moderate + >=2 Supporting)")
        .when((pm == 1) & (pp >= 4), "LP-6 (1 Moderate + >=4 Supporting)")
    )


def benign_label(n: dict[str, Column]) -> Column:
    return F.when(n["ba"] >= 1, "BEN-1 (BA1 stand-alone)").when(n["bs"] >= 2, "BEN-2 (>=2 Strong benign)")


def likely_benign_label(n: dict[str, Column]) -> Column:
    return F.when((n["bs"] == 1) & (n["bp"] >= 1), "LB-1 (1 Strong + 1 Supporting benign)").when(
        n["bp"] >= 2, "LB-2 (>=2 Supporting benign)"
    )


def met_codes(by_code: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(s.isNotNull(), F.lit(code)) for code, s in by_code.items()]))


def evidence_points(by_code: dict[str, Column]) -> Column:
    def points(code: str, strength: Column) -> Column:
        table = BENIGN_POINTS if code in BENIGN_CODES else PATHOGENIC_POINTS
        value = F.lit(0)
        for name, score in table.items():
            value = F.when(strength == name, score).otherwise(value)
        return value

    return _total([points(code, s) for code, s in by_code.items()])


def points_tier(points: Column) -> Column:
    return (
        F.when(points >= 10, PATHOGENIC)
        .when(points >= 6, LIKELY_PATHOGENIC)
        .when(points >= 0, VUS)
        .when(points >= -6, LIKELY_BENIGN)
        .otherwise(BENIGN)
    )


def combine(df: DataFrame, by_code: dict[str, Column], t: Thresholds = DEFAULTS) -> DataFrame:
    """Add ``tier``, ``rule_path`` and ``met_codes`` from strength columns by code.

    Counts and labels are laid down in separate projections, so each is computed once
    per row although several rules read it.
    """
    counted = df.select(
        "*",
        *[col.alias(f"_{name}") for name, col in evidence_counts(by_code).items()],
        evidence_points(by_code).alias("_points"),
        met_codes(by_code).alias("met_codes"),
    )
    n = {name: F.col(f"_{name}") for name in COUNTERS}
    labelled = counted.select(
        "*",
        pathogenic_label(n).alias("_path"),
        likely_pathogenic_label(n).alias("_likely_path"),
        benign_label(n).alias("_ben"),
        likely_benign_label(n).alias("_likely_ben"),
        F.when(F.size("met_codes") > 0, F.array_join("met_codes", " + ")).otherwise("no criteria met").alias("_trail"),
    )
    for_path, for_benign = F.coalesce("_path", "_likely_path"), F.coalesce("_ben", "_likely_ben")
    if t.model == "clingen":
        tier = points_tier(F.col("_points"))
        path = F.concat(
            F.col("_trail"), F.format_string(" => %+d points (ClinGen/Tavtigian) => ", F.col("_points")), tier
        )
    else:
        tier = (
            F.when(for_path.isNotNull() & for_benign.isNotNull(), VUS)
            .when(F.col("_path").isNotNull(), PATHOGENIC)
            .when(F.col("_likely_path").isNotNull(), LIKELY_PATHOGENIC)
            .when(F.col("_ben").isNotNull(), BENIGN)
            .when(F.col("_likely_ben").isNotNull(), LIKELY_BENIGN)
            .otherwise(VUS)
        )
        outcome = (
            F.when(
                for_path.isNotNull() & for_benign.isNotNull(),
                "conflicting pathogenic & benign evidence => VUS",
            )
            .when(for_path.isNotNull() | for_benign.isNotNull(), F.concat(tier, F.lit(" ["), F.coalesce(for_path, for_benign), F.lit("]")))
            .otherwise("criteria insufficient for a benign or pathogenic call => VUS")
        )
        path = F.concat(F.col("_trail"), F.lit(" => "), outcome)
    scratch = [f"_{name}" for name in COUNTERS] + ["_points", "_path", "_likely_path", "_ben", "_likely_ben", "_trail"]
    return labelled.select("*", tier.alias("tier"), path.alias("rule_path")).drop(*scratch)


def classify(df: DataFrame, t: Thresholds = DEFAULTS, explain: bool = False, keep_strengths: bool = False) -> DataFrame:
    """Evaluate all criteria and combine them; no shuffle. ``explain`` adds the full trail."""
    graded = with_strengths(df, t)
    called = combine(graded, earned(), t)
    if explain:
        called = called.withColumn("criteria", trail(t))
    return called if keep_strengths else called.drop(*[strength_column(code) for code in DECIDED])


def explained(called: DataFrame, t: Thresholds = DEFAULTS, fields: list[str] | None = None) -> DataFrame:
    """Classified calls with their trail, or the ``fields`` of it that are asked for.

    The trail follows from the columns of a classified call and is many times their size, so
    it is worked out where it is read, for the rows that are read, and never stored with the calls.
    """
    graded = called.select("*", *[build(t).alias(strength_column(code)) for code, build in DECIDED.items()])
    return graded.withColumn("criteria", trail(t, fields)).drop(*[strength_column(code) for code in DECIDED])
