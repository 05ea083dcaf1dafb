"""End-to-end feature pipelines (``data_pipeline`` in its three variants).

Everything stays lazy. The only driver round-trips are fitted state of
bounded size: encoder vocabularies and quantile knots. Scalars (cutoff
month, label threshold, scaler statistics) are scalar subqueries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import clean as C
from riskloom.operators import credit as K
from riskloom.operators import scale as S
from riskloom.operators import split as P
from riskloom.operators import target as T
from riskloom.session import cut_lineage

# The reference's feature lists.
N18_DROP = ["flag_mobil", "years_employed", "cnt_children"]
N18_CATEGORICAL = ["name_income_type_encoded", "name_education_type_encoded",
                   "name_family_status_encoded", "name_housing_type_encoded",
                   "occupation_type_encoded", "age_binned_encoded"]
N18_BINARY = ["flag_gender", "flag_own_car", "flag_own_realty", "flag_mobil",
              "flag_work_phone", "flag_phone", "flag_email", "flag_employed"]
N18_NUMERICAL = ["amt_income_total_log", "age", "months_employed", "years_employed",
                 "cnt_fam_members", "cnt_children", "max_days_past_due",
                 "longest_non_default_streak", "longest_default_streak",
                 "consecutive_defaults_6m", "recency_last_bad_status"]
CREDIT_FEATURES = ["max_days_past_due", "longest_non_default_streak", "longest_default_streak",
                   "consecutive_defaults_6m", "recency_last_bad_status"]
F_NUMERIC = ["amt_income_total_log", "age", "months_employed", "years_employed",
             "cnt_fam_members", "cnt_children"]
V2_NUMERIC = ["cnt_children", "age", "months_employed", "amt_income_total_log", "risk_score"]
V2_XY_DROP = ["days_birth", "amt_income_total", "days_employed", "years_employed",
              "cnt_fam_members", "flag_mobil"]


@dataclass
class FeatureSet:
    train: DataFrame
    test: DataFrame
    feature_cols: list[str]
    label_col: str = "label"
    encoders: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)


def labelled_customers(credit: DataFrame, decay_mode: str = "month", share: float = 0.8,
                       threshold_scope: str = "train", monthly: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(old, new) customer aggregates with ``multi_dim_target``.

    The label threshold is the training (old) quantile for both sides;
    ``threshold_scope='each'`` gives each side its own quantile."""
    customers = P.assign_split(K.clean_credit(credit, decay_mode=decay_mode, monthly=monthly), share)
    old = customers.filter(F.col("split") == "old").drop("split")
    new = customers.filter(F.col("split") == "new").drop("split")
    old_l, t = T.create_target(old)
    if threshold_scope == "train":
        new_l, _ = T.create_target(new, threshold=t)
    elif threshold_scope == "each":
        new_l, _ = T.create_target(new)
    else:
        raise ValueError(f"threshold_scope must be train|each, got {threshold_scope!r}")
    return old_l, new_l


def labelled_train_frame(application: DataFrame, credit: DataFrame) -> DataFrame:
    """The minimum slice: credit aggregates -> vintage split -> label by
    the training quantile -> join cleaned applications of old accounts."""
    old, _ = labelled_customers(credit, decay_mode="month")
    app, _ = C.clean_application(application, variant="n18")
    label = old.select("id", F.col("multi_dim_target").alias("label"), "default_prop",
                       "weighted_default_prop")
    return app.join(label, "id", "inner")


def train_frame_n18(application: DataFrame, credit: DataFrame,
                    threshold_scope: str = "train") -> FeatureSet:
    app, encoders = C.clean_application(application, variant="n18")
    # one shuffle of the raw credit rows feeds both the label aggregates and
    # the delinquency features: the compact (id, month) series is written once
    monthly = cut_lineage(K.monthly_series(credit))
    old, new = labelled_customers(credit, decay_mode="month", threshold_scope=threshold_scope, monthly=monthly)
    feats = K.feature_engineer(None, monthly=monthly)
    keep = ["id", F.col("multi_dim_target").alias("label")]
    cols = C.feature_columns(N18_DROP, N18_CATEGORICAL, N18_BINARY, N18_NUMERICAL)
    # both sides by one join; a reader of one side has the other pruned from its plan
    sides = old.select(*keep, F.lit("old").alias("split")).unionByName(new.select(*keep, F.lit("new").alias("split")))
    both = app.join(sides.join(feats, "id", "left"), "id").select("id", *cols, "label", "split")
    train, test = (both.filter(F.col("split") == s).drop("split") for s in ("old", "new"))
    return FeatureSet(train, test, cols, encoders=encoders, extra={"both": both})


def train_frame_f(application: DataFrame, credit: DataFrame, encoding: str = "label",
                  exclude_leaky: bool = True) -> FeatureSet:
    """First version: label encoders fitted on train and reused on test,
    standard-scaled numeric columns. ``risk_score`` is derived from the same
    rows as the label, so it is dropped unless ``exclude_leaky=False``."""
    accounts = P.split_accounts(credit).select("id", "split")
    app_old, app_new = P.split_applications(application, accounts)
    tr_app, enc = C.clean_application(app_old, variant="f", encoding=encoding)
    te_app, _ = C.clean_application(app_new, variant="f", encoding=encoding, encoders=enc)
    old, new = labelled_customers(credit, decay_mode="position")
    keep = ["id", "risk_score", F.col("multi_dim_target").alias("label")]
    train = tr_app.join(old.select(*keep), "id")
    test = te_app.join(new.select(*keep), "id")
    if exclude_leaky:
        train, test = train.drop("risk_score"), test.drop("risk_score")
    train, test = S.scale_standard(train, test, F_NUMERIC)
    cols = [c for c in train.columns if c not in ("id", "label")]
    return FeatureSet(train, test, cols, encoders=enc)


def composite_customers(credit: DataFrame, scaling: str = "quantile", q: float = 0.8,
                        threshold_scope: str = "train") -> tuple[DataFrame, DataFrame]:
    """(old, new) customer aggregates labelled by the composite risk score.

    Scalers and threshold are the old accounts'; ``threshold_scope="each"``
    scales and cuts each side by itself, as the reference does."""
    customers = cut_lineage(P.assign_split(K.clean_credit(credit, decay_mode="position")))
    old, new = (customers.filter(F.col("split") == s).drop("split") for s in ("old", "new"))
    old_l, t = T.composite_target(old, scaling, q=q)
    if threshold_scope == "train":
        new_l, _ = T.composite_target(new, scaling, q=q, fit_on=old, threshold=t)
    elif threshold_scope == "each":
        new_l, _ = T.composite_target(new, scaling, q=q)
    else:
        raise ValueError(f"threshold_scope must be train|each, got {threshold_scope!r}")
    return old_l, new_l


def train_frame_v2(application: DataFrame, credit: DataFrame, encoding: str = "label",
                   exclude_leaky: bool = True, scaling: str = "quantile", threshold_scope: str = "train") -> FeatureSet:
    """Second version: applications keep the row with a known occupation, and
    the label is the composite risk score above its 80 % quantile (``scaling``:
    robust, rank_pct or quantile)."""
    accounts = P.split_accounts(credit).select("id", "split")
    app_old, app_new = P.split_applications(application, accounts)
    tr_app, enc = C.clean_application(app_old, variant="v2", encoding=encoding)
    te_app, _ = C.clean_application(app_new, variant="v2", encoding=encoding, encoders=enc)
    old, new = composite_customers(credit, scaling, threshold_scope=threshold_scope)
    keep = ["id", "risk_score", F.col("multi_dim_target").alias("label")]
    train = tr_app.join(old.select(*keep), "id").drop(*V2_XY_DROP)
    test = te_app.join(new.select(*keep), "id").drop(*V2_XY_DROP)
    numeric = [c for c in V2_NUMERIC if not (exclude_leaky and c == "risk_score")]
    if exclude_leaky:
        train, test = train.drop("risk_score"), test.drop("risk_score")
    train, test = S.scale_standard(train, test, numeric)
    cols = [c for c in train.columns if c not in ("id", "label")]
    return FeatureSet(train, test, cols, encoders=enc)


def train_frame(application: DataFrame, credit: DataFrame, variant: str = "n18", **kw) -> FeatureSet:
    builders = {"n18": train_frame_n18, "f": train_frame_f, "v2": train_frame_v2}
    if variant not in builders:
        raise ValueError(f"variant must be one of {sorted(builders)}, got {variant!r}")
    return builders[variant](application, credit, **kw)


def resampled_frames(fs: FeatureSet, methods: tuple = ("ros", "rus", "smote"), seed: int = 42, **knn_kw) -> dict[str, DataFrame]:
    """The training frame of ``fs`` resampled by each method (``sampling.SETS``),
    with its columns id, the features (doubles) and the label. Rows drawn twice
    keep their id; synthetic ones have negative ids. Rows with a null feature
    have no place among the neighbours and are an error."""
    from riskloom.operators import sampling as SM
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.raise_error(F.lit(f"resampled_frames: {c} is null")).cast("double")) for c in fs.feature_cols])
    base = cut_lineage(fs.train.select("id", F.col(fs.label_col).alias("label"), vec.alias("features")))
    sets = SM.make_sampled_sets(base, "label", "id", "features", seed, methods, **knn_kw)
    return {m: df.select("id", *[F.col("features")[i].alias(c) for i, c in enumerate(fs.feature_cols)], F.col("label").alias(fs.label_col))
            for m, df in sets.items()}
