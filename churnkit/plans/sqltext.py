"""DuckDB text of the feature chain, used only as an independent oracle.

Each builder returns CTE text (", name AS (...)") meant to follow
``fixtures.cb_sql``. The Spark side never runs this text.
"""

from __future__ import annotations

from fractions import Fraction

from ..functions.columns import GENDER, SERVICE_LEVELS, TENURE_BANDS, YES_NO
from ..operators.prep import (ADDON_COLS, BINARY_COLS, DEFAULT_LEVELS, MULTI_COLS, PASS_THROUGH,
                              SERVICE_COLS, feature_columns)


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _recode(c, mapping):
    arms = " ".join(f"WHEN {q(c)} = '{k}' THEN {v}" for k, v in mapping.items())
    return f"CASE {arms} END"


def number_sql(c: str) -> str:
    x = f"try_cast({q(c)} AS DOUBLE)"
    return f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END"


def encoded_cte(src: str = "cb", name: str = "der", levels=None) -> str:
    levels = levels or DEFAULT_LEVELS
    sel = ["row_id", "label"]
    for c in PASS_THROUGH:
        if c in BINARY_COLS:
            sel.append(f"{_recode(c, YES_NO)} AS {q(c)}")
        elif c == "gender":
            sel.append(f"{_recode(c, GENDER)} AS {q(c)}")
        elif c in SERVICE_COLS:
            sel.append(f"{_recode(c, SERVICE_LEVELS)} AS {q(c)}")
        elif c == "TotalCharges":
            sel.append(f"coalesce({number_sql(c)}, 0.0) AS {q(c)}")
        else:
            sel.append(q(c))
    for c in MULTI_COLS:
        for v in levels[c]:
            sel.append(f"CASE WHEN {q(c)} = '{v}' THEN 1 ELSE 0 END AS {q(c + '_' + v)}")
    enc = f", enc AS (SELECT {', '.join(sel)} FROM {src})"
    bands = " ".join(f"WHEN tenure > {lo} AND tenure <= {hi} THEN '{n}'" for lo, hi, n in TENURE_BANDS)
    d = ["*", '"TotalCharges" / (tenure + 1) AS "AvgChargePerMonth"',
         '"MonthlyCharges" - "TotalCharges" / (tenure + 1) AS "ChargeDifference"']
    d += [f"CASE WHEN (CASE {bands} END) = '{n}' THEN 1 ELSE 0 END AS {q('TenureGroup_' + n)}"
          for _, _, n in TENURE_BANDS]
    d.append("(" + " + ".join(f"CASE WHEN {q(c)} = 2 THEN 1 ELSE 0 END" for c in ADDON_COLS)
             + ') AS "ServiceCount"')
    d.append('CASE WHEN "PhoneService" = 1 AND "InternetService_No" = 0 THEN 1 ELSE 0 END AS "HasBothServices"')
    return enc + f", {name} AS (SELECT {', '.join(d)} FROM enc)"


def _ceil_frac(expr: str, f: Fraction) -> str:
    return f"(({expr}) * {f.numerator} + {f.denominator - 1}) // {f.denominator}"


def split_cte(src: str = "der", name: str = "sp", seed: int = 42, test_size=Fraction(1, 5),
              val_size=Fraction(1, 10), label: str = "label") -> str:
    """Exact stratified split: largest-remainder seats, rank by md5 order."""
    t = Fraction(str(test_size))
    v = Fraction(str(val_size)) / (1 - t)
    return f"""
, cc AS (SELECT {label} AS lab, count(*) AS n_c FROM {src} GROUP BY {label})
, tt AS (SELECT sum(n_c) AS n, {_ceil_frac('sum(n_c)', t)} AS n_take FROM cc)
, a1 AS (SELECT lab, n_c, (n_c * n_take) // n AS fl, (n_c * n_take) % n AS rem, n_take FROM cc, tt)
, a2 AS (SELECT lab, n_c, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, lab)
                <= n_take - sum(fl) OVER () THEN 1 ELSE 0 END AS t_c FROM a1)
, r1 AS (SELECT lab, t_c, n_c - t_c AS r_c FROM a2)
, tv AS (SELECT sum(r_c) AS n, {_ceil_frac('sum(r_c)', v)} AS n_take FROM r1)
, b1 AS (SELECT lab, t_c, (r_c * n_take) // n AS fl, (r_c * n_take) % n AS rem, n_take FROM r1, tv)
, b2 AS (SELECT lab, t_c, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, lab)
                <= n_take - sum(fl) OVER () THEN 1 ELSE 0 END AS v_c FROM b1)
, rk AS (SELECT s.*, row_number() OVER (PARTITION BY {label}
           ORDER BY md5(CAST(row_id AS VARCHAR) || '-{seed}'), row_id) AS rnk_ FROM {src} s)
, {name} AS (SELECT rk.* EXCLUDE (rnk_), CASE WHEN rnk_ <= t_c THEN 'test'
             WHEN rnk_ <= t_c + v_c THEN 'val' ELSE 'train' END AS split
             FROM rk JOIN b2 ON rk.{label} = b2.lab)
"""


def scaled_cte(cols, src: str = "sp", name: str = "fs", fit_where: str = "split = 'train'") -> str:
    """Population-std standardisation fitted on ``fit_where`` rows; std 0 -> 1."""
    cols = list(cols)
    aggs = ", ".join(f"avg(CAST({q(c)} AS DOUBLE)) AS {q('m_' + c)}, stddev_pop(CAST({q(c)} AS DOUBLE)) AS {q('s_' + c)}"
                     for c in cols)
    repl = ", ".join(
        f"(CAST(s.{q(c)} AS DOUBLE) - coalesce(st.{q('m_' + c)}, 0.0)) / "
        f"(CASE WHEN st.{q('s_' + c)} IS NULL OR st.{q('s_' + c)} = 0 THEN 1.0 ELSE st.{q('s_' + c)} END) AS {q(c)}"
        for c in cols)
    return (f", st AS (SELECT {aggs} FROM {src} WHERE {fit_where})"
            f", {name} AS (SELECT s.* REPLACE ({repl}) FROM {src} s, st)")


def features_cte(scale: bool = True) -> str:
    """cb -> der -> sp -> fs (scaled) : row_id, label, split, 34 features."""
    from .pipeline import scaled_columns
    text = encoded_cte() + split_cte()
    if scale:
        text += scaled_cte(scaled_columns())
    else:
        text += ", fs AS (SELECT * FROM sp)"
    return text


def feature_select(prefix: str = "", round_doubles: bool = True, levels=None) -> str:
    """Select list of the 34 features, doubles rounded to 6 digits."""
    from .pipeline import scaled_columns
    dbl = set(scaled_columns(levels)) if round_doubles else set()
    out = []
    for c in feature_columns(levels):
        if c in dbl:
            out.append(f"round({prefix}{q(c)}, 6) AS {q(c)}")
        else:
            out.append(f"{prefix}{q(c)}")
    return ", ".join(out)


__all__ = ["q", "encoded_cte", "split_cte", "scaled_cte", "features_cte", "feature_select",
           "number_sql", "SERVICE_COLS"]
