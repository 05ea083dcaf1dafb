"""Application-record cleaning: dedup, derived features, flags, encoding.

Three variants of the reference pipeline are kept because they produce
different columns: 'f' (first version), 'v2' (dedup preferring a known
occupation, bucket codes shifted to start at 0) and 'n18' (age bins
label-encoded, delinquency features joined later)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import credit_exprs as X
from riskloom.operators import encode as E


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def dedup_prefer_nonnull(df: DataFrame, key: str = "id", seq: str = "src_seq",
                         prefer: str = "occupation_type") -> DataFrame:
    """Per key keep the first row (by ``seq``) with non-null ``prefer``,
    else the first row. A grouped ``min_by`` aggregates partially on the
    map side, so a key with very many rows is reduced before the shuffle."""
    cols = df.columns
    pick = F.min_by(F.struct(*cols), F.struct(F.col(prefer).isNull(), F.col(seq)))
    return df.groupBy(key).agg(pick.alias("_r")).select("_r.*")


def dedup_keep_last(df: DataFrame, key: str = "id", seq: str = "src_seq") -> DataFrame:
    cols = df.columns
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_r")).select("_r.*")


def find_duplicates(df: DataFrame, key: str = "id", duplicated: bool = True) -> DataFrame:
    """Rows whose key occurs more than once (or exactly once)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    keep = counts.filter((F.col("_n") > 1) if duplicated else (F.col("_n") == 1)).select(key)
    return df.join(keep, key, "left_semi")


def _common_numeric(df: DataFrame) -> dict:
    days = X.employed_days("days_employed")
    return {
        "age": X.age_years("days_birth"),
        "days_employed": days,
    }


def clean_application(raw: DataFrame, variant: str = "v2", encoding: str = "label",
                      encoders: dict | None = None, dedup: str = "default",
                      on_unseen: str = "error") -> tuple[DataFrame, dict]:
    """``clean_application_records``: one lazy projection chain.

    ``dedup``: 'default' (v2 prefers a known occupation; f/n18 keep the
    last row), 'none' (duplicates survive, as the reference's discarded
    ``drop_duplicates`` result does). Encoders are fitted on ``raw`` unless
    given."""
    df = lower_columns(raw)
    if dedup == "default":
        df = dedup_prefer_nonnull(df) if variant == "v2" else dedup_keep_last(df)
    elif dedup != "none":
        raise ValueError(f"dedup must be default|none, got {dedup!r}")
    if "src_seq" in df.columns:
        df = df.drop("src_seq")

    days = X.employed_days("days_employed")
    if variant == "f":
        df = df.withColumns({
            "cnt_children_encoded": X.children_bucket("cnt_children"),
            "cnt_fam_members": F.col("cnt_fam_members").cast("int"),
            "age": X.age_years("days_birth"),
            "days_employed": days,
        }).withColumns({
            "months_employed": X.employed_months("days_employed"),
            "years_employed": X.employed_years("days_employed"),
            "employment_status_encoded": X.employment_flag("days_employed"),
            "flag_gender": X.map_flag("code_gender", X.GENDER_FLAG),
            "flag_own_realty": X.map_flag("flag_own_realty", X.YES_NO_FLAG),
            "flag_own_car": X.map_flag("flag_own_car", X.YES_NO_FLAG),
            "amt_income_total_log": F.log1p("amt_income_total"),
            "occupation_type": F.coalesce(F.col("occupation_type"), F.lit("Unemployed")),
        })
        df, encoders = E.encode_application(df, encoding, encoders, on_unseen=on_unseen)
        df = df.drop("amt_income_total", "code_gender", "days_birth", "days_employed")
    elif variant == "v2":
        fam = X.family_bucket_raw("cnt_fam_members")
        bin_code = F.coalesce(X.age_bin_index(X.age_years("days_birth")), F.lit(-1))
        fam_min = df.agg(F.min(fam)).scalar()
        bin_min = df.agg(F.min(bin_code)).scalar()
        df = df.withColumns({
            "cnt_children_encoded": X.children_bucket("cnt_children"),
            "cnt_fam_members": F.col("cnt_fam_members").cast("int"),
            "cnt_fam_members_encoded": (fam - fam_min).cast("int"),
            "age": X.age_years("days_birth"),
            "age_binned_encoded": (bin_code - bin_min).cast("int"),
            "days_employed": days,
        }).withColumns({
            "months_employed": X.employed_months("days_employed"),
            "years_employed": X.employed_years("days_employed"),
            "employment_status_encoded": X.employment_flag("days_employed"),
            "gender_encoded": X.map_flag("code_gender", X.GENDER_FLAG),
            "flag_own_realty_encoded": X.map_flag("flag_own_realty", X.YES_NO_FLAG),
            "flag_own_car_encoded": X.map_flag("flag_own_car", X.YES_NO_FLAG),
            "amt_income_total_log": F.log1p("amt_income_total"),
            "occupation_type": F.coalesce(F.col("occupation_type"), F.lit("Unemployed")),
        }).drop("code_gender", "flag_own_realty", "flag_own_car")
        if encoding is not None:
            df, encoders = E.encode_application(df, encoding, encoders, on_unseen=on_unseen)
    elif variant == "n18":
        df = df.withColumns({
            "age": X.age_years("days_birth"),
            "days_employed": days,
            "cnt_fam_members": F.col("cnt_fam_members").cast("int"),
            "cnt_children": F.col("cnt_children").cast("int"),
        }).withColumns({
            "age_binned": X.age_bin_label("age"),
            "months_employed": X.employed_months("days_employed"),
            "years_employed": X.employed_years("days_employed"),
            "flag_employed": X.employment_flag("days_employed"),
            "amt_income_total_log": F.log1p("amt_income_total"),
            "flag_gender": X.map_flag("code_gender", X.GENDER_FLAG),
            "flag_own_realty": X.map_flag("flag_own_realty", X.YES_NO_FLAG),
            "flag_own_car": X.map_flag("flag_own_car", X.YES_NO_FLAG),
            "occupation_type": F.coalesce(F.col("occupation_type"), F.lit("Unemployed")),
        })
        df, encoders = E.encode_application(
            df, "label", encoders, columns=["age_binned", *E.APPLICATION_CATEGORICALS],
            on_unseen=on_unseen)
        df = df.drop("amt_income_total", "code_gender", "days_birth", "days_employed")
    else:
        raise ValueError(f"variant must be f|v2|n18, got {variant!r}")
    return df, encoders


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop by name; absent names are ignored (``errors='ignore'``)."""
    return df.drop(*cols)


def keep_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols)


def feature_columns(drop: list[str], categorical: list[str], binary: list[str],
                    numerical: list[str]) -> list[str]:
    """``get_feat_cols``: ordered concatenation minus the dropped names."""
    return [c for c in (categorical + binary + numerical) if c not in set(drop)]


def split_xy(df: DataFrame, target: str = "label", key: str = "id",
             drop: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """X (features + key) and y (key + target); Spark has no index, so the
    key is kept on both sides to line them up."""
    base = df.drop(*(drop or []))
    return base.drop(target), base.select(key, target)


def partition_features(cols: list[str]) -> tuple[list[str], list[str]]:
    """Numeric vs categorical by name (contains 'encoded' or 'flag')."""
    cat = [c for c in cols if "encoded" in c or "flag" in c]
    return [c for c in cols if c not in cat], cat
