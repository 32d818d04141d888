"""Cleaning, encoding and derived features (P1-P11, F2 building blocks).

Every function is a lazy projection: the whole chain compiles to one
``Project`` over the scan, inside one whole-stage-codegen span.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (GENDER, SERVICE_LEVELS, TENURE_BANDS, YES_NO, indicator,
                                 one_hot, recode, tenure_band, to_number)

BINARY_COLS = ["Partner", "Dependents", "PhoneService", "PaperlessBilling", "Churn"]
SERVICE_COLS = ["MultipleLines", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
                "TechSupport", "StreamingTV", "StreamingMovies"]
ADDON_COLS = SERVICE_COLS[1:]
MULTI_COLS = ["InternetService", "Contract", "PaymentMethod"]

# Levels of the multi-class columns. Fixed here so that scoring data always gets
# the same columns; ``fit_levels`` finds them from data instead.
DEFAULT_LEVELS = {
    "InternetService": ["DSL", "Fiber optic", "No"],
    "Contract": ["Month-to-month", "One year", "Two year"],
    "PaymentMethod": ["Bank transfer (automatic)", "Credit card (automatic)",
                      "Electronic check", "Mailed check"],
}

PASS_THROUGH = ["gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
                "MultipleLines", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
                "TechSupport", "StreamingTV", "StreamingMovies", "PaperlessBilling",
                "MonthlyCharges", "TotalCharges"]


def clean(df: DataFrame, charges: str = "TotalCharges", fill: float | None = 0.0,
          drop: Sequence[str] = ("customerID",)) -> DataFrame:
    """P1 text->double, P2 fill, P3 drop columns (the key ``row_id`` is kept)."""
    x = to_number(charges)
    if fill is not None:
        x = F.coalesce(x, F.lit(float(fill)))
    out = df.withColumn(charges, x)
    return out.drop(*[c for c in drop if c in df.columns])


def fit_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct levels per column, found with one distributed aggregate a column.

    Only the level lists, which become the columns of the encoded table, reach the driver.
    """
    return {c: sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect()) for c in cols}


def encode(df: DataFrame, levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """P4 binary, P5 ordinal service, P6 one-hot (dummies appended, source dropped)."""
    levels = dict(DEFAULT_LEVELS if levels is None else levels)
    cols = []
    for c in df.columns:
        if c in MULTI_COLS:
            continue
        if c in BINARY_COLS:
            cols.append(recode(c, YES_NO).alias(c))
        elif c == "gender":
            cols.append(recode(c, GENDER).alias(c))
        elif c in SERVICE_COLS:
            cols.append(recode(c, SERVICE_LEVELS).alias(c))
        else:
            cols.append(F.col(c))
    for c in MULTI_COLS:
        if c in df.columns:
            cols.extend(one_hot(c, levels[c]))
    return df.select(*cols)


def derive(df: DataFrame) -> DataFrame:
    """P7 ratio, P8 difference, P9 tenure band dummies, P10 service count, P11 both services."""
    avg = F.col("TotalCharges") / (F.col("tenure") + 1)
    band = tenure_band("tenure")
    out = (df.withColumn("AvgChargePerMonth", avg)
           .withColumn("ChargeDifference", F.col("MonthlyCharges") - F.col("AvgChargePerMonth")))
    out = out.select("*", *[indicator(band == name).alias(f"TenureGroup_{name}")
                            for _, _, name in TENURE_BANDS])
    present = [c for c in ADDON_COLS if c in df.columns]
    count = sum((indicator(F.col(c) == 2) for c in present), F.lit(0))
    out = out.withColumn("ServiceCount", count)
    if "InternetService_No" in df.columns:
        out = out.withColumn("HasBothServices",
                             indicator((F.col("PhoneService") == 1) & (F.col("InternetService_No") == 0)))
    return out


def feature_columns(levels: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """The 34 model inputs in the reference's order."""
    levels = dict(DEFAULT_LEVELS if levels is None else levels)
    dummies = [f"{c}_{v}" for c in MULTI_COLS for v in levels[c]]
    return (PASS_THROUGH + dummies + ["AvgChargePerMonth", "ChargeDifference"]
            + [f"TenureGroup_{n}" for _, _, n in TENURE_BANDS] + ["ServiceCount", "HasBothServices"])


def indicator_columns(levels: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """Dummy columns, which the reference's scaler leaves as 0/1."""
    levels = dict(DEFAULT_LEVELS if levels is None else levels)
    return ([f"{c}_{v}" for c in MULTI_COLS for v in levels[c]]
            + [f"TenureGroup_{n}" for _, _, n in TENURE_BANDS])


def encoded(df: DataFrame, levels=None) -> DataFrame:
    """clean -> encode -> derive, with ``label`` = recoded Churn."""
    out = derive(encode(clean(df), levels))
    return out.withColumnRenamed("Churn", "label")
