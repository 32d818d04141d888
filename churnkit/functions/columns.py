"""Column expressions (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's encodings.
YES_NO = {"Yes": 1, "No": 0}
GENDER = {"Male": 1, "Female": 0}
SERVICE_LEVELS = {"Yes": 2, "No": 1, "No phone service": 0, "No internet service": 0}
# Tenure bands (lo, hi] in months and their labels.
TENURE_BANDS = [(0, 12, "0-1yr"), (12, 24, "1-2yr"), (24, 48, "2-4yr"), (48, 72, "4-6yr")]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """Text to double; unparsable text and 'NaN' become null."""
    x = F.expr(f"try_cast(`{c}` AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def recode(c, mapping: Mapping[str, int]) -> Column:
    """Literal map lookup; a value outside the map gives null."""
    out = None
    for k, v in mapping.items():
        out = (F.when(col(c) == k, F.lit(v)) if out is None else out.when(col(c) == k, F.lit(v)))
    return out.otherwise(F.lit(None).cast("int"))


def indicator(cond: Column) -> Column:
    """0/1 int; null condition counts as 0 (pandas comparisons with NaN are False)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def one_hot(c: str, levels: Sequence[str], prefix: str | None = None) -> list[Column]:
    """One 0/1 column per level, named ``<col>_<level>``."""
    p = prefix or c
    return [indicator(F.col(c) == lv).alias(f"{p}_{lv}") for lv in levels]


def tenure_band(c: str = "tenure") -> Column:
    """Right-closed bands; 0 and > 72 fall in none (null)."""
    out = None
    for lo, hi, name in TENURE_BANDS:
        cond = (F.col(c) > lo) & (F.col(c) <= hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def sigmoid(c) -> Column:
    """P13."""
    return 1.0 / (1.0 + F.exp(-col(c)))


def threshold(c, t: float = 0.5) -> Column:
    """Score >= t as 0/1."""
    return (col(c) >= F.lit(t)).cast("int")


def pretty_name(c) -> Column:
    """P16: 'random_forest.pkl' -> 'Random Forest'."""
    return F.initcap(F.replace(F.replace(col(c), F.lit(".pkl"), F.lit("")), F.lit("_"), F.lit(" ")))


def hash_key(row_id: str = "row_id", seed: int = 42) -> Column:
    """Portable pseudo-random order key: md5 hex text of '<row_id>-<seed>'."""
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f"-{seed}")))


def r6(c) -> Column:
    """Round doubles to 6 digits for engine-independent comparison."""
    return F.round(col(c), 6)
