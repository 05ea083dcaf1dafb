"""Registered credit-record queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import credit_exprs as X
from riskloom.operators import clean as C
from riskloom.operators import credit as K
from riskloom.operators import split as P
from riskloom.operators import target as T
from riskloom.plans import pipeline as PL
from riskloom.plans.common import Registry, fx, r6, with_fixtures

R = Registry()

# ---- oracle building blocks (DuckDB) --------------------------------------
CF = ("cf", """SELECT id, months_balance, status,
  CASE WHEN TRY_CAST(status AS DOUBLE) IN (2, 3, 4, 5) THEN 1 ELSE 0 END AS f,
  CASE status WHEN 'X' THEN -1 WHEN 'C' THEN -1 WHEN '0' THEN 0 WHEN '1' THEN 1
    WHEN '2' THEN 2 WHEN '3' THEN 3 WHEN '4' THEN 4 WHEN '5' THEN 5 END AS code
FROM credit_record""")
POS = ("pos", """SELECT *, row_number() OVER (PARTITION BY id ORDER BY months_balance DESC, f DESC) - 1 AS k
FROM cf""")


def cust_cte(mode: str):
    w = "exp(-0.1 * k)" if mode == "position" else "exp(-0.1 * abs(months_balance))"
    places = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(38, 14))) AS DOUBLE)"
    whole = "round((1.0 - pow(exp(-0.1), count(*))) / (1.0 - exp(-0.1)), 14)" if mode == "position" else places(w)
    return ("cust", f"""SELECT id, min(months_balance) AS origination_month, count(*) AS tenure,
  CAST(sum(f) AS DOUBLE) / count(*) AS default_prop,
  {places(f"f * {w}")} / {whole} AS weighted_default_prop,
  CAST(sum(f) AS DOUBLE) * ln(1 + count(*)) AS risk_score
FROM pos GROUP BY id""")


CC = ("cc", """SELECT *, weighted_default_prop / ln(1 + tenure) AS weighted_default_prop_tenure_norm,
  abs(origination_month) AS vintage FROM cust""")
VZ = ("vz", """SELECT *, (weighted_default_prop - avg(weighted_default_prop) OVER (PARTITION BY vintage))
  / (stddev_samp(weighted_default_prop) OVER (PARTITION BY vintage) + 1e-6) AS weighted_default_prop_vintage_norm
FROM cc""")
ACC = ("acc", "SELECT id, min(months_balance) AS origination_month FROM credit_record GROUP BY id")
MC = ("mc", "SELECT origination_month, count(*) AS n_accounts FROM acc GROUP BY origination_month")
CDF = ("cdfc", """SELECT origination_month, n_accounts,
  CAST(sum(n_accounts) OVER (ORDER BY origination_month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_accounts,
  sum(n_accounts) OVER (ORDER BY origination_month ROWS UNBOUNDED PRECEDING) / sum(n_accounts) OVER () AS cdf
FROM mc""")
CUT = ("cut", "SELECT min(origination_month) AS cutoff FROM cdfc WHERE cdf >= 0.8")
SPL = ("spl", """SELECT acc.id, acc.origination_month,
  CASE WHEN acc.origination_month <= cut.cutoff THEN 'old' ELSE 'new' END AS split
FROM acc CROSS JOIN cut""")
CREDIT_CTES = [CF, POS]
SPLIT_CTES = [ACC, MC, CDF, CUT, SPL]
FE = [
    ("fr", "SELECT id, months_balance, code, CASE WHEN code >= 2 THEN 1 ELSE 0 END AS d FROM cf"),
    ("g", """SELECT *, CASE WHEN lag(d) OVER w IS NULL OR lag(d) OVER w <> d THEN 1 ELSE 0 END AS chg
FROM fr WINDOW w AS (PARTITION BY id ORDER BY months_balance)"""),
    ("isl", """SELECT *, sum(chg) OVER (PARTITION BY id ORDER BY months_balance ROWS UNBOUNDED PRECEDING) AS island
FROM g"""),
    ("st", "SELECT id, island, min(d) AS is_default, count(*) AS streak_length FROM isl GROUP BY id, island"),
    ("ls", """SELECT id,
  CAST(coalesce(max(CASE WHEN is_default = 0 THEN streak_length END), 0) AS BIGINT) AS longest_non_default_streak,
  CAST(coalesce(max(CASE WHEN is_default = 1 THEN streak_length END), 0) AS BIGINT) AS longest_default_streak
FROM st GROUP BY id"""),
    ("l6", "SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY months_balance DESC) AS rk FROM fr"),
    ("c6", """SELECT id, CAST(coalesce(min(CASE WHEN d = 0 THEN rk END) - 1, count(*)) AS BIGINT) AS consecutive_defaults_6m
FROM l6 WHERE rk <= 6 GROUP BY id"""),
    ("rec", """SELECT id, CAST(coalesce(abs(max(CASE WHEN d = 1 THEN months_balance END) - max(months_balance)), -1) AS BIGINT)
  AS recency_last_bad_status, max(code) AS mc FROM fr GROUP BY id"""),
    ("fe", """SELECT rec.id,
  CAST(CASE mc WHEN -1 THEN 0 WHEN 0 THEN 29 WHEN 1 THEN 59 WHEN 2 THEN 89 WHEN 3 THEN 119
    WHEN 4 THEN 149 WHEN 5 THEN 150 END AS INTEGER) AS max_days_past_due,
  ls.longest_non_default_streak, ls.longest_default_streak, c6.consecutive_defaults_6m,
  rec.recency_last_bad_status
FROM rec JOIN ls USING (id) JOIN c6 USING (id)"""),
]


def sql(body: str, ctes=(), fixtures=("credit_record",)) -> str:
    return with_fixtures(list(fixtures), body, list(ctes))


def credit(spark, sf):
    return fx(spark, sf, "credit_record")


# ---- 2.1 sources ------------------------------------------------------------
@R.add("src_credit_tables", sql("SELECT id, months_balance, status FROM credit_record"))
def q_src_credit_tables(spark, sf):
    return credit(spark, sf)


# ---- 2.2 status projections ----------------------------------------------------
@R.add("default_flag", sql("SELECT id, months_balance, status, f AS default_flag FROM cf", [CF]))
def q_default_flag(spark, sf):
    return credit(spark, sf).withColumn("default_flag", X.default_flag("status"))


@R.add("status_code", sql("SELECT id, months_balance, status, code AS status_code FROM cf", [CF]))
def q_status_code(spark, sf):
    return credit(spark, sf).withColumn("status_code", X.status_code("status"))


@R.add("status_days", sql("""SELECT id, months_balance, status,
  CASE code WHEN -1 THEN 0 WHEN 0 THEN 29 WHEN 1 THEN 59 WHEN 2 THEN 89 WHEN 3 THEN 119
    WHEN 4 THEN 149 WHEN 5 THEN 150 END AS status_days FROM cf""", [CF]))
def q_status_days(spark, sf):
    return credit(spark, sf).withColumn("status_days", X.status_days(X.status_code("status")))


# ---- 2.4 / 2.5 --------------------------------------------------------------
@R.add("origination_month", sql("""SELECT id, months_balance, status,
  min(months_balance) OVER (PARTITION BY id) AS origination_month FROM credit_record"""))
def q_origination_month(spark, sf):
    return K.origination_month(credit(spark, sf))


@R.add("distinct_accounts", sql("SELECT DISTINCT id, origination_month FROM acc", [ACC]))
def q_distinct_accounts(spark, sf):
    return K.distinct_accounts(credit(spark, sf))


# ---- 2.6 customer aggregates --------------------------------------------------
@R.add("customer_agg", sql("""SELECT id, origination_month, tenure, round(default_prop, 6) AS default_prop,
  round(risk_score, 6) AS risk_score FROM cust""", CREDIT_CTES + [cust_cte("month")]))
def q_customer_agg(spark, sf):
    c = K.customer_aggregates(credit(spark, sf), decay_mode="month")
    return r6(c.select("id", "origination_month", "tenure", "default_prop", "risk_score"))


@R.add("decay_by_position", sql("""SELECT id, round(weighted_default_prop, 6) AS weighted_default_prop
FROM cust""", CREDIT_CTES + [cust_cte("position")]))
def q_decay_by_position(spark, sf):
    c = K.customer_aggregates(credit(spark, sf), decay=0.1, decay_mode="position")
    return r6(c.select("id", "weighted_default_prop"))


@R.add("decay_by_month", sql("""SELECT id, round(weighted_default_prop, 6) AS weighted_default_prop
FROM cust""", CREDIT_CTES + [cust_cte("month")]))
def q_decay_by_month(spark, sf):
    c = K.customer_aggregates(credit(spark, sf), decay=0.1, decay_mode="month")
    return r6(c.select("id", "weighted_default_prop"))


@R.add("tenure_norm", sql("""SELECT id, round(weighted_default_prop_tenure_norm, 6) AS weighted_default_prop_tenure_norm
FROM cc""", CREDIT_CTES + [cust_cte("month"), CC]))
def q_tenure_norm(spark, sf):
    c = K.with_tenure_norm(K.customer_aggregates(credit(spark, sf), decay_mode="month"))
    return r6(c.select("id", "weighted_default_prop_tenure_norm"))


@R.add("vintage", sql("SELECT id, abs(min(months_balance)) AS vintage FROM credit_record GROUP BY id"))
def q_vintage(spark, sf):
    return K.with_vintage(K.distinct_accounts(credit(spark, sf))).select("id", "vintage")


@R.add("vintage_zscore", sql("""SELECT id, vintage, round(weighted_default_prop_vintage_norm, 6)
  AS weighted_default_prop_vintage_norm FROM vz""", CREDIT_CTES + [cust_cte("month"), CC, VZ]))
def q_vintage_zscore(spark, sf):
    c = K.with_vintage_zscore(K.with_vintage(K.customer_aggregates(credit(spark, sf), decay_mode="month")))
    return r6(c.select("id", "vintage", "weighted_default_prop_vintage_norm"))


CLEAN_COLS = ("id, origination_month, tenure, round(default_prop, 6) AS default_prop, "
              "round(weighted_default_prop, 6) AS weighted_default_prop, round(risk_score, 6) AS risk_score, "
              "round(weighted_default_prop_tenure_norm, 6) AS weighted_default_prop_tenure_norm, vintage, "
              "round(weighted_default_prop_vintage_norm, 6) AS weighted_default_prop_vintage_norm")


@R.add("clean_credit", sql(f"SELECT {CLEAN_COLS} FROM vz", CREDIT_CTES + [cust_cte("position"), CC, VZ]))
def q_clean_credit(spark, sf):
    return r6(K.clean_credit(credit(spark, sf), decay_mode="position"))


# ---- split ----------------------------------------------------------------------
@R.add("month_counts", sql("SELECT origination_month, n_accounts FROM mc", [ACC, MC]))
def q_month_counts(spark, sf):
    return P.month_counts(K.distinct_accounts(credit(spark, sf)))


@R.add("origination_cdf", sql("SELECT origination_month, n_accounts, cum_accounts, round(cdf, 6) AS cdf FROM cdfc",
                              [ACC, MC, CDF]))
def q_origination_cdf(spark, sf):
    return r6(P.origination_cdf(K.distinct_accounts(credit(spark, sf))))


@R.add("cdf_cutoff", sql("SELECT cutoff AS cutoff_month FROM cut", [ACC, MC, CDF, CUT]))
def q_cdf_cutoff(spark, sf):
    acc = K.distinct_accounts(credit(spark, sf))
    return P.origination_cdf(acc).filter(F.col("cdf") >= 0.8).agg(F.min("origination_month").alias("cutoff_month"))


@R.add("split_by_cutoff", sql("""SELECT c.id, c.months_balance, c.status, s.origination_month, s.split
FROM credit_record c JOIN spl s USING (id)""", SPLIT_CTES))
def q_split_by_cutoff(spark, sf):
    cr = credit(spark, sf)
    acc = P.split_accounts(cr)
    return cr.join(acc, "id")


@R.add("split_report", sql("""SELECT count(*) AS total_accounts,
  CAST(sum(CASE WHEN split = 'old' THEN 1 ELSE 0 END) AS BIGINT) AS old_accounts,
  CAST(sum(CASE WHEN split = 'new' THEN 1 ELSE 0 END) AS BIGINT) AS new_accounts,
  round(sum(CASE WHEN split = 'old' THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS old_pct,
  round(sum(CASE WHEN split = 'new' THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS new_pct,
  round(CAST(sum(CASE WHEN split = 'old' THEN 1 ELSE 0 END) AS DOUBLE)
    / nullif(sum(CASE WHEN split = 'new' THEN 1 ELSE 0 END), 0), 6) AS old_new_ratio
FROM spl""", SPLIT_CTES))
def q_split_report(spark, sf):
    return r6(P.split_report(P.split_accounts(credit(spark, sf))))


@R.add("split_applications", sql("""SELECT a.*, s.split FROM application_record a JOIN spl s USING (id)""",
                                 SPLIT_CTES, ("credit_record", "application_record")))
def q_split_applications(spark, sf):
    acc = P.split_accounts(credit(spark, sf))
    old, new = P.split_applications(fx(spark, sf, "application_record"), acc)
    return old.withColumn("split", F.lit("old")).unionByName(new.withColumn("split", F.lit("new")))


@R.add("semi_join_ids", sql("""SELECT * FROM credit_record WHERE id IN (SELECT id FROM spl WHERE split = 'new')""",
                            SPLIT_CTES))
def q_semi_join_ids(spark, sf):
    cr = credit(spark, sf)
    return P.split_credit(cr, P.split_accounts(cr), "new")


# ---- target -------------------------------------------------------------------
TGT = [("lab", """SELECT c.*, s.split FROM cust c JOIN spl s USING (id)"""),
       ("thr", "SELECT quantile_cont(default_prop, 0.8) AS t FROM lab WHERE split = 'old'"),
       ("tgt", """SELECT lab.*, CASE WHEN default_prop > t THEN 1 ELSE 0 END AS multi_dim_target,
  CASE WHEN default_prop > t THEN 'Bad Customer' ELSE 'Good Customer' END AS customer_label
FROM lab CROSS JOIN thr""")]


@R.add("target_quantile", sql("""SELECT id, split, round(default_prop, 6) AS default_prop, multi_dim_target,
  customer_label FROM tgt""", CREDIT_CTES + [cust_cte("month")] + SPLIT_CTES + TGT))
def q_target_quantile(spark, sf):
    old, new = PL.labelled_customers(credit(spark, sf))
    cols = ["id", "split", "default_prop", "multi_dim_target", "customer_label"]
    return r6(old.withColumn("split", F.lit("old")).select(*cols)
              .unionByName(new.withColumn("split", F.lit("new")).select(*cols)))


@R.add("label_name", sql("""SELECT id, multi_dim_target,
  CASE multi_dim_target WHEN 0 THEN 'Good Customer' WHEN 1 THEN 'Bad Customer' END AS customer_label FROM tgt""",
                         CREDIT_CTES + [cust_cte("month")] + SPLIT_CTES + TGT))
def q_label_name(spark, sf):
    old, new = PL.labelled_customers(credit(spark, sf))
    both = old.unionByName(new)
    return both.select("id", "multi_dim_target", X.label_name("multi_dim_target").alias("customer_label"))


# ---- delinquency features -------------------------------------------------------
@R.add("max_days_past_due", sql("SELECT id, max_days_past_due FROM fe", [CF] + FE))
def q_max_days_past_due(spark, sf):
    return K.feature_engineer(credit(spark, sf)).select("id", "max_days_past_due")


@R.add("streaks", sql("SELECT id, CAST(island AS BIGINT) AS island, is_default, streak_length FROM st", [CF] + FE[:4]))
def q_streaks(spark, sf):
    isl = K.streak_islands(credit(spark, sf))
    return isl.select("id", F.col("island").cast("long").alias("island"), "is_default",
                      F.col("streak_length").cast("long").alias("streak_length"))


@R.add("longest_streaks", sql("SELECT * FROM ls", [CF] + FE[:5]))
def q_longest_streaks(spark, sf):
    return K.longest_streaks(K.streak_islands(credit(spark, sf)))


@R.add("consecutive_defaults_6", sql("SELECT id, consecutive_defaults_6m FROM fe", [CF] + FE))
def q_consecutive_defaults_6m(spark, sf):
    return K.feature_engineer(credit(spark, sf)).select("id", "consecutive_defaults_6m")


@R.add("recency_last_bad", sql("SELECT id, recency_last_bad_status FROM fe", [CF] + FE))
def q_recency_last_bad(spark, sf):
    return K.feature_engineer(credit(spark, sf)).select("id", "recency_last_bad_status")


@R.add("feature_engineer", sql("SELECT * FROM fe", [CF] + FE))
def q_feature_engineer(spark, sf):
    return K.feature_engineer(credit(spark, sf))


@R.add("join_credit_features", sql("""SELECT c.id, round(c.default_prop, 6) AS default_prop, fe.max_days_past_due,
  fe.longest_non_default_streak, fe.longest_default_streak, fe.consecutive_defaults_6m,
  fe.recency_last_bad_status FROM cust c LEFT JOIN fe USING (id)""", CREDIT_CTES + [cust_cte("month")] + FE))
def q_join_credit_features(spark, sf):
    cr = credit(spark, sf)
    c = K.customer_aggregates(cr, decay_mode="month").select("id", "default_prop")
    return r6(c.join(K.feature_engineer(cr), "id", "left"))


@R.add("fill_defaults", sql("""SELECT s.id, coalesce(fe.longest_non_default_streak, 0) AS longest_non_default_streak,
  coalesce(fe.longest_default_streak, 0) AS longest_default_streak,
  coalesce(fe.consecutive_defaults_6m, 0) AS consecutive_defaults_6m,
  coalesce(fe.recency_last_bad_status, -1) AS recency_last_bad_status
FROM spl s LEFT JOIN fe ON s.id = fe.id AND s.split = 'old'""", SPLIT_CTES + [CF] + FE))
def q_fill_defaults(spark, sf):
    cr = credit(spark, sf)
    acc = P.split_accounts(cr)
    old_feats = K.feature_engineer(P.split_credit(cr, acc, "old"))
    j = acc.select("id").join(old_feats, "id", "left")
    return j.select("id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in
                            ["longest_non_default_streak", "longest_default_streak", "consecutive_defaults_6m"]],
                    F.coalesce(F.col("recency_last_bad_status"), F.lit(-1)).cast("long").alias("recency_last_bad_status"))


@R.add("join_vintage", sql("""SELECT c.id, c.tenure, v.vintage FROM cust c
LEFT JOIN (SELECT id, abs(min(months_balance)) AS vintage FROM credit_record GROUP BY id) v USING (id)""",
                           CREDIT_CTES + [cust_cte("month")]))
def q_join_vintage(spark, sf):
    cr = credit(spark, sf)
    c = K.customer_aggregates(cr, decay_mode="month").select("id", "tenure")
    v = K.with_vintage(K.distinct_accounts(cr)).select("id", "vintage")
    return c.join(v, "id", "left")
