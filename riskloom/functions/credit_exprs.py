"""Column expressions for application and credit records (no UDFs)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's:
# credit status -> ordinal code (X and C mean no balance / paid off)
STATUS_CODES = {"X": -1, "C": -1, "0": 0, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5}
# ordinal code -> days past due
STATUS_DAYS = {-1: 0, 0: 29, 1: 59, 2: 89, 3: 119, 4: 149, 5: 150}
# numeric statuses counted as a default
DEFAULT_STATUSES = (2, 3, 4, 5)
# gender / yes-no flags
GENDER_FLAG = {"M": 0, "F": 1}
YES_NO_FLAG = {"Y": 1, "N": 0}
# average days per month and per year used for tenure of employment
DAYS_PER_MONTH = 30.44
DAYS_PER_YEAR = 365
# age bins: [0,5), [5,10) ... [85,90), then 90+
AGE_BIN_WIDTH = 5
AGE_BIN_LAST = 90


def _literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def status_numeric(status) -> Column:
    """``pd.to_numeric(errors='coerce')``: non-numeric statuses become NULL."""
    return col_(status).try_cast("double")


def default_flag(status) -> Column:
    """1 when the numeric status is 2..5, else 0 (NULL compares false)."""
    return F.coalesce(status_numeric(status).isin(*DEFAULT_STATUSES), F.lit(False)).cast("int")


def status_code(status) -> Column:
    """X/C -> -1, '0'..'5' -> 0..5, anything else -> NULL."""
    return F.element_at(_literal_map(STATUS_CODES), col_(status))


def status_days(code) -> Column:
    return F.element_at(_literal_map(STATUS_DAYS), col_(code).cast("int"))


def is_default_code(code) -> Column:
    return F.coalesce(col_(code) >= 2, F.lit(False)).cast("int")


def label_name(label) -> Column:
    return (F.when(col_(label) == 0, "Good Customer")
            .when(col_(label) == 1, "Bad Customer"))


def half_even_int(x: Column) -> Column:
    """numpy/pandas ``round(0)`` (half to even) then ``astype(int)``."""
    return F.rint(x).cast("int")


def age_years(days_birth) -> Column:
    return half_even_int(-col_(days_birth) / F.lit(365.0))


def age_bin_index(age) -> Column:
    """Index of the 5-year bin (0..18), NULL below zero."""
    a = col_(age)
    return (F.when(a < 0, F.lit(None).cast("int"))
            .when(a >= AGE_BIN_LAST, F.lit(AGE_BIN_LAST // AGE_BIN_WIDTH))
            .otherwise(F.floor(a / AGE_BIN_WIDTH).cast("int")))


def age_bin_label(age) -> Column:
    idx = age_bin_index(age)
    lo = idx * AGE_BIN_WIDTH
    return (F.when(idx.isNull(), F.lit(None).cast("string"))
            .when(idx == AGE_BIN_LAST // AGE_BIN_WIDTH, F.lit(f"{AGE_BIN_LAST}+"))
            .otherwise(F.format_string("%d-%d", lo, lo + AGE_BIN_WIDTH - 1)))


def employed_days(days_employed) -> Column:
    """Days >= 0 (not employed) -> -1, else the positive day count."""
    d = col_(days_employed)
    return F.when(d >= 0, F.lit(-1)).otherwise(-d)


def employed_months(days) -> Column:
    m = half_even_int(col_(days) / F.lit(DAYS_PER_MONTH))
    return F.when(m >= 0, m).otherwise(F.lit(-1))


def employed_years(days) -> Column:
    y = half_even_int(col_(days) / F.lit(float(DAYS_PER_YEAR)))
    return F.when(y >= 0, y).otherwise(F.lit(-1))


def employment_flag(days) -> Column:
    """1 when the normalised day count is negative (i.e. *not* employed)."""
    return F.when(col_(days) < 0, 1).otherwise(0)


def map_flag(c, mapping: dict) -> Column:
    """``Series.map(dict)``: unmapped values become NULL."""
    return F.element_at(_literal_map(mapping), col_(c))


def children_bucket(c) -> Column:
    x = col_(c)
    return F.when(x.isin(0, 1, 2, 3), x).otherwise(F.lit(4)).cast("int")


def family_bucket_raw(c) -> Column:
    x = col_(c).cast("int")
    return F.when(x.isin(1, 2, 3, 4, 5), x).otherwise(F.lit(6))


def apply_threshold(proba, t, inclusive: bool = False) -> Column:
    p = col_(proba)
    cond = (p >= t) if inclusive else (p > t)
    return F.coalesce(cond, F.lit(False)).cast("int")
