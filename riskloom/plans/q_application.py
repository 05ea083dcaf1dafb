"""Registered application-record queries and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import credit_exprs as X
from riskloom.operators import clean as C
from riskloom.operators import encode as E
from riskloom.operators import scale as S
from riskloom.operators import split as P
from riskloom.operators import target as T
from riskloom.operators import credit as K
from riskloom.plans import pipeline as PL
from riskloom.plans.common import Registry, fx, r6, with_fixtures
from riskloom.plans.q_credit import CF, CREDIT_CTES, FE, SPLIT_CTES, TGT, cust_cte

R = Registry()
APP = ("application_record",)
BOTH = ("credit_record", "application_record")


def sql(body, ctes=(), fixtures=APP):
    return with_fixtures(list(fixtures), body, list(ctes))


def app(spark, sf):
    return fx(spark, sf, "application_record")


# ---- DuckDB building blocks ---------------------------------------------------
AGE = "CAST(round_even(CAST(-days_birth AS DOUBLE) / 365, 0) AS INTEGER)"
DE = "CASE WHEN days_employed >= 0 THEN -1 ELSE -days_employed END"
BIN_IDX = "CASE WHEN age < 0 THEN NULL WHEN age >= 90 THEN 18 ELSE CAST(floor(age / 5) AS INTEGER) END"
BIN_LBL = ("CASE WHEN age < 0 THEN NULL WHEN age >= 90 THEN '90+' ELSE "
           "CAST(CAST(floor(age / 5) AS INTEGER) * 5 AS VARCHAR) || '-' || "
           "CAST(CAST(floor(age / 5) AS INTEGER) * 5 + 4 AS VARCHAR) END")
YN = "CASE {c} WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END"
MF = "CASE code_gender WHEN 'M' THEN 0 WHEN 'F' THEN 1 END"
CATS = ["name_income_type", "name_education_type", "name_family_status", "name_housing_type", "occupation_type"]


def dense_code(col: str, src: str | None = None) -> str:
    s = src or col
    return (f"CASE WHEN {s} IS NULL OR {s} = 'Unknown' THEN -1 ELSE CAST(dense_rank() OVER "
            f"(ORDER BY CASE WHEN {s} IS NULL OR {s} = 'Unknown' THEN NULL ELSE {s} END) - 1 AS INTEGER) END "
            f"AS {col}_encoded")


DEDUP_LAST = ("dd", """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src_seq DESC) AS rn
FROM application_record) WHERE rn = 1""")
DEDUP_NONNULL = ("dv", """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
  (PARTITION BY id ORDER BY occupation_type IS NULL, src_seq) AS rn FROM application_record) WHERE rn = 1""")


def n18_ctes(src: str = "dd"):
    return [
        ("nb", f"SELECT *, {AGE} AS age, {DE} AS de FROM {src}"),
        ("nb2", f"""SELECT *, CAST(round_even(CAST(de AS DOUBLE) / 30.44, 0) AS INTEGER) AS m0,
  CAST(round_even(CAST(de AS DOUBLE) / 365, 0) AS INTEGER) AS y0, {BIN_LBL} AS age_binned,
  coalesce(occupation_type, 'Unemployed') AS occ FROM nb"""),
        ("n18", f"""SELECT id, {YN.format(c='flag_own_car')} AS flag_own_car,
  {YN.format(c='flag_own_realty')} AS flag_own_realty, CAST(cnt_children AS INTEGER) AS cnt_children,
  flag_mobil, flag_work_phone, flag_phone, flag_email, CAST(cnt_fam_members AS INTEGER) AS cnt_fam_members, age,
  CASE WHEN m0 >= 0 THEN m0 ELSE -1 END AS months_employed, CASE WHEN y0 >= 0 THEN y0 ELSE -1 END AS years_employed,
  CASE WHEN de < 0 THEN 1 ELSE 0 END AS flag_employed, ln(1 + amt_income_total) AS amt_income_total_log,
  {MF} AS flag_gender, {dense_code('age_binned')},
  {', '.join(dense_code(c) for c in CATS[:4])}, {dense_code('occupation_type', 'occ')}
FROM nb2"""),
    ]


def v2_ctes(src: str = "dv", codes: bool = True):
    enc = (", " + ", ".join(dense_code(c) for c in CATS[:4]) + ", " + dense_code("occupation_type", "occ")) if codes else ""
    return [
        ("vb", f"SELECT *, {AGE} AS age, {DE} AS de, coalesce(occupation_type, 'Unemployed') AS occ FROM {src}"),
        ("vb2", f"""SELECT *, CASE WHEN CAST(cnt_fam_members AS INTEGER) IN (1, 2, 3, 4, 5)
  THEN CAST(cnt_fam_members AS INTEGER) ELSE 6 END AS fb, coalesce({BIN_IDX}, -1) AS bc,
  CAST(round_even(CAST(de AS DOUBLE) / 30.44, 0) AS INTEGER) AS m0,
  CAST(round_even(CAST(de AS DOUBLE) / 365, 0) AS INTEGER) AS y0 FROM vb"""),
        ("v2", f"""SELECT id, cnt_children, amt_income_total, days_birth, de AS days_employed, flag_mobil,
  flag_work_phone, flag_phone, flag_email, CAST(cnt_fam_members AS INTEGER) AS cnt_fam_members,
  CAST(CASE WHEN cnt_children IN (0, 1, 2, 3) THEN cnt_children ELSE 4 END AS INTEGER) AS cnt_children_encoded,
  CAST(fb - min(fb) OVER () AS INTEGER) AS cnt_fam_members_encoded, age,
  CAST(bc - min(bc) OVER () AS INTEGER) AS age_binned_encoded,
  CASE WHEN m0 >= 0 THEN m0 ELSE -1 END AS months_employed, CASE WHEN y0 >= 0 THEN y0 ELSE -1 END AS years_employed,
  CASE WHEN de < 0 THEN 1 ELSE 0 END AS employment_status_encoded, {MF} AS gender_encoded,
  {YN.format(c='flag_own_realty')} AS flag_own_realty_encoded, {YN.format(c='flag_own_car')} AS flag_own_car_encoded,
  ln(1 + amt_income_total) AS amt_income_total_log{enc}
FROM vb2"""),
    ]


def round_cols(cols: list[str], doubles: set[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in cols)


# ---- 2.1 inspection -------------------------------------------------------------
@R.add("head_sample", sql("SELECT * FROM application_record ORDER BY id, src_seq LIMIT 5"))
def q_head_sample(spark, sf):
    return app(spark, sf).orderBy("id", "src_seq").limit(5)


_PROFILE_COLS = ["id", "code_gender", "flag_own_car", "flag_own_realty", "cnt_children", "amt_income_total",
                 "name_income_type", "name_education_type", "name_family_status", "name_housing_type",
                 "days_birth", "days_employed", "flag_mobil", "flag_work_phone", "flag_phone", "flag_email",
                 "occupation_type", "cnt_fam_members"]


@R.add("frame_profile", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) AS total_rows FROM application_record"
    for c in _PROFILE_COLS)))
def q_frame_profile(spark, sf):
    from riskloom.operators.inspect import frame_profile
    return frame_profile(app(spark, sf).drop("src_seq"))


# ---- 2.2 projections -------------------------------------------------------------
@R.add("lower_columns", sql("SELECT * FROM application_record"))
def q_lower_columns(spark, sf):
    a = app(spark, sf)
    upper = a.toDF(*[c.upper() for c in a.columns])
    return C.lower_columns(upper)


@R.add("children_bucket", sql("""SELECT id, src_seq, cnt_children,
  CAST(CASE WHEN cnt_children IN (0, 1, 2, 3) THEN cnt_children ELSE 4 END AS INTEGER) AS cnt_children_encoded
FROM application_record"""))
def q_children_bucket(spark, sf):
    return app(spark, sf).select("id", "src_seq", "cnt_children",
                                 X.children_bucket("cnt_children").alias("cnt_children_encoded"))


@R.add("family_bucket", sql("""SELECT id, src_seq, CAST(fb - min(fb) OVER () AS INTEGER) AS cnt_fam_members_encoded
FROM (SELECT *, CASE WHEN CAST(cnt_fam_members AS INTEGER) IN (1, 2, 3, 4, 5) THEN CAST(cnt_fam_members AS INTEGER)
  ELSE 6 END AS fb FROM application_record)"""))
def q_family_bucket(spark, sf):
    a = app(spark, sf)
    fb = X.family_bucket_raw("cnt_fam_members")
    return a.select("id", "src_seq", (fb - a.agg(F.min(fb)).scalar()).cast("int").alias("cnt_fam_members_encoded"))


@R.add("int_casts", sql("""SELECT id, src_seq, CAST(cnt_fam_members AS INTEGER) AS cnt_fam_members,
  CAST(cnt_children AS INTEGER) AS cnt_children FROM application_record"""))
def q_int_casts(spark, sf):
    return app(spark, sf).select("id", "src_seq", F.col("cnt_fam_members").cast("int").alias("cnt_fam_members"),
                                 F.col("cnt_children").cast("int").alias("cnt_children"))


@R.add("age_years", sql(f"SELECT id, src_seq, days_birth, {AGE} AS age FROM application_record"))
def q_age_years(spark, sf):
    return app(spark, sf).select("id", "src_seq", "days_birth", X.age_years("days_birth").alias("age"))


@R.add("age_bin", sql(f"SELECT id, src_seq, age, {BIN_LBL} AS age_binned FROM (SELECT *, {AGE} AS age FROM application_record)"))
def q_age_bin(spark, sf):
    a = app(spark, sf).select("id", "src_seq", X.age_years("days_birth").alias("age"))
    return a.withColumn("age_binned", X.age_bin_label("age"))


@R.add("age_bin_code", sql(f"""SELECT id, src_seq, CAST(bc - min(bc) OVER () AS INTEGER) AS age_binned_encoded
FROM (SELECT *, coalesce({BIN_IDX}, -1) AS bc FROM (SELECT *, {AGE} AS age FROM application_record))"""))
def q_age_bin_code(spark, sf):
    a = app(spark, sf)
    bc = F.coalesce(X.age_bin_index(X.age_years("days_birth")), F.lit(-1))
    return a.select("id", "src_seq", (bc - a.agg(F.min(bc)).scalar()).cast("int").alias("age_binned_encoded"))


@R.add("age_bin_label_code", sql(f"""SELECT id, src_seq, age_binned, {dense_code('age_binned')}
FROM (SELECT *, {BIN_LBL} AS age_binned FROM (SELECT *, {AGE} AS age FROM application_record))"""))
def q_age_bin_label_code(spark, sf):
    a = app(spark, sf).select("id", "src_seq", X.age_bin_label(X.age_years("days_birth")).alias("age_binned"))
    enc = E.fit(a, "age_binned", "label")
    return E.apply(a, enc)


@R.add("employment_features", sql(f"""SELECT id, src_seq, de AS days_employed,
  CASE WHEN m0 >= 0 THEN m0 ELSE -1 END AS months_employed, CASE WHEN y0 >= 0 THEN y0 ELSE -1 END AS years_employed
FROM (SELECT *, CAST(round_even(CAST(de AS DOUBLE) / 30.44, 0) AS INTEGER) AS m0,
  CAST(round_even(CAST(de AS DOUBLE) / 365, 0) AS INTEGER) AS y0 FROM (SELECT *, {DE} AS de FROM application_record))"""))
def q_employment_features(spark, sf):
    a = app(spark, sf).select("id", "src_seq", X.employed_days("days_employed").alias("days_employed"))
    return a.withColumns({"months_employed": X.employed_months("days_employed"),
                          "years_employed": X.employed_years("days_employed")})


@R.add("employment_flag", sql(f"""SELECT id, src_seq, CASE WHEN de < 0 THEN 1 ELSE 0 END AS flag_employed
FROM (SELECT *, {DE} AS de FROM application_record)"""))
def q_employment_flag(spark, sf):
    return app(spark, sf).select("id", "src_seq",
                                 X.employment_flag(X.employed_days("days_employed")).alias("flag_employed"))


@R.add("binary_flags", sql(f"""SELECT id, src_seq, {MF} AS flag_gender, {YN.format(c='flag_own_realty')} AS flag_own_realty,
  {YN.format(c='flag_own_car')} AS flag_own_car FROM application_record"""))
def q_binary_flags(spark, sf):
    return app(spark, sf).select("id", "src_seq", X.map_flag("code_gender", X.GENDER_FLAG).alias("flag_gender"),
                                 X.map_flag("flag_own_realty", X.YES_NO_FLAG).alias("flag_own_realty"),
                                 X.map_flag("flag_own_car", X.YES_NO_FLAG).alias("flag_own_car"))


@R.add("income_log", sql("""SELECT id, src_seq, round(ln(1 + amt_income_total), 6) AS amt_income_total_log
FROM application_record"""))
def q_income_log(spark, sf):
    return r6(app(spark, sf).select("id", "src_seq", F.log1p("amt_income_total").alias("amt_income_total_log")))


@R.add("occupation_fill", sql("""SELECT id, src_seq, coalesce(occupation_type, 'Unemployed') AS occupation_type
FROM application_record"""))
def q_occupation_fill(spark, sf):
    return app(spark, sf).select("id", "src_seq", F.coalesce(F.col("occupation_type"), F.lit("Unemployed"))
                                 .alias("occupation_type"))


_V2_COLS = ["id", "cnt_children", "amt_income_total", "days_birth", "days_employed", "flag_mobil", "flag_work_phone",
            "flag_phone", "flag_email", "cnt_fam_members", "cnt_children_encoded", "cnt_fam_members_encoded", "age",
            "age_binned_encoded", "months_employed", "years_employed", "employment_status_encoded", "gender_encoded",
            "flag_own_realty_encoded", "flag_own_car_encoded", "amt_income_total_log",
            *[f"{c}_encoded" for c in CATS]]


@R.add("clean_application", sql(f"SELECT {round_cols(_V2_COLS, {'amt_income_total_log'})} FROM v2",
                                [DEDUP_NONNULL] + v2_ctes()))
def q_clean_application(spark, sf):
    df, _ = C.clean_application(app(spark, sf), variant="v2", encoding="label")
    return r6(df.select(*_V2_COLS))


_N18_COLS = ["id", "flag_own_car", "flag_own_realty", "cnt_children", "flag_mobil", "flag_work_phone", "flag_phone",
             "flag_email", "cnt_fam_members", "age", "months_employed", "years_employed", "flag_employed",
             "amt_income_total_log", "flag_gender", "age_binned_encoded", *[f"{c}_encoded" for c in CATS]]


@R.add("clean_application_n18", sql(f"SELECT {round_cols(_N18_COLS, {'amt_income_total_log'})} FROM n18",
                                    [DEDUP_LAST] + n18_ctes()))
def q_clean_application_n18(spark, sf):
    df, _ = C.clean_application(app(spark, sf), variant="n18")
    return r6(df.select(*_N18_COLS))


_F_COLS = ["id", "flag_own_car", "flag_own_realty", "cnt_children", "flag_mobil", "flag_work_phone", "flag_phone",
           "flag_email", "cnt_fam_members", "cnt_children_encoded", "age", "months_employed", "years_employed",
           "employment_status_encoded", "flag_gender", "amt_income_total_log", *[f"{c}_encoded" for c in CATS]]
F_CTES = [("fb", f"SELECT *, {AGE} AS age, {DE} AS de, coalesce(occupation_type, 'Unemployed') AS occ FROM dd"),
          ("fb2", """SELECT *, CAST(round_even(CAST(de AS DOUBLE) / 30.44, 0) AS INTEGER) AS m0,
  CAST(round_even(CAST(de AS DOUBLE) / 365, 0) AS INTEGER) AS y0 FROM fb"""),
          ("fcl", f"""SELECT id, {YN.format(c='flag_own_car')} AS flag_own_car, {YN.format(c='flag_own_realty')} AS flag_own_realty,
  cnt_children, flag_mobil, flag_work_phone, flag_phone, flag_email, CAST(cnt_fam_members AS INTEGER) AS cnt_fam_members,
  CAST(CASE WHEN cnt_children IN (0, 1, 2, 3) THEN cnt_children ELSE 4 END AS INTEGER) AS cnt_children_encoded, age,
  CASE WHEN m0 >= 0 THEN m0 ELSE -1 END AS months_employed, CASE WHEN y0 >= 0 THEN y0 ELSE -1 END AS years_employed,
  CASE WHEN de < 0 THEN 1 ELSE 0 END AS employment_status_encoded, {MF} AS flag_gender,
  ln(1 + amt_income_total) AS amt_income_total_log, {', '.join(dense_code(c) for c in CATS[:4])},
  {dense_code('occupation_type', 'occ')} FROM fb2""")]


@R.add("clean_application_f", sql(f"SELECT {round_cols(_F_COLS, {'amt_income_total_log'})} FROM fcl",
                                  [DEDUP_LAST] + F_CTES))
def q_clean_application_f(spark, sf):
    df, _ = C.clean_application(app(spark, sf), variant="f")
    return r6(df.select(*_F_COLS))


@R.add("drop_columns", sql("SELECT * EXCLUDE (days_birth, amt_income_total, days_employed) FROM application_record"))
def q_drop_columns(spark, sf):
    return C.drop_columns(app(spark, sf), ["days_birth", "amt_income_total", "days_employed", "age_binned"])


# ---- 2.4 dedup ------------------------------------------------------------------
@R.add("dedup_prefer_nonnull", sql("SELECT * FROM dv", [DEDUP_NONNULL]))
def q_dedup_prefer_nonnull(spark, sf):
    return C.dedup_prefer_nonnull(app(spark, sf))


@R.add("dedup_keep_last", sql("SELECT * FROM dd", [DEDUP_LAST]))
def q_dedup_keep_last(spark, sf):
    return C.dedup_keep_last(app(spark, sf))


@R.add("find_duplicates", sql("""SELECT * FROM application_record WHERE id IN
  (SELECT id FROM application_record GROUP BY id HAVING count(*) > 1)"""))
def q_find_duplicates(spark, sf):
    return C.find_duplicates(app(spark, sf))


# ---- 2.3 encoders -----------------------------------------------------------------
@R.add("enc_label_fit", sql("""SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT occupation_type AS value FROM application_record
      WHERE occupation_type IS NOT NULL AND occupation_type <> 'Unknown')"""))
def q_enc_label_fit(spark, sf):
    return E.fit(app(spark, sf), "occupation_type", "label").mapping(spark)


APP_SPLIT = SPLIT_CTES + [("aps", "SELECT a.*, s.split FROM application_record a JOIN spl s USING (id)")]


@R.add("enc_label_apply", sql("""SELECT id, src_seq,
  CASE WHEN name_housing_type IS NULL THEN -1 ELSE code END AS name_housing_type_encoded
FROM aps LEFT JOIN codes ON name_housing_type = value WHERE split = 'new'""", APP_SPLIT + [("codes", """
  SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT name_housing_type AS value FROM aps WHERE split = 'old' AND name_housing_type IS NOT NULL)""")],
    BOTH))
def q_enc_label_apply(spark, sf):
    acc = P.split_accounts(fx(spark, sf, "credit_record"))
    old, new = P.split_applications(app(spark, sf), acc)
    enc = E.fit(old, "name_housing_type", "label")
    return E.apply(new, enc).select("id", "src_seq", "name_housing_type_encoded")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_ONEHOT_SQL = ", ".join(f"CASE WHEN name_income_type = '{s}' THEN 1.0 ELSE 0.0 END::DOUBLE AS name_income_type_{s}"
                        for s in _SEGMENTS)


@R.add("enc_onehot_fit", sql(f"SELECT id, src_seq, {_ONEHOT_SQL} FROM application_record"))
def q_enc_onehot_fit(spark, sf):
    a = app(spark, sf)
    enc = E.fit(a, "name_income_type", "onehot")
    return a.select("id", "src_seq", *[c.alias(n) for n, c in E.onehot_columns(enc).items()])


@R.add("enc_onehot_apply", sql(f"SELECT id, src_seq, {_ONEHOT_SQL} FROM aps WHERE split = 'new'", APP_SPLIT, BOTH))
def q_enc_onehot_apply(spark, sf):
    acc = P.split_accounts(fx(spark, sf, "credit_record"))
    old, new = P.split_applications(app(spark, sf), acc)
    enc = E.fit(old, "name_income_type", "onehot")
    return new.select("id", "src_seq", *[c.alias(n) for n, c in E.onehot_columns(enc).items()])


@R.add("enc_categorical", sql("""SELECT CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code, value
FROM (SELECT DISTINCT name_family_status AS value FROM application_record)"""))
def q_enc_categorical(spark, sf):
    return E.fit(app(spark, sf), "name_family_status", "categorical").mapping(spark)


@R.add("enc_none", sql("""SELECT id, src_seq, coalesce(CAST(occupation_type AS VARCHAR), 'Unknown') AS occupation_type
FROM application_record"""))
def q_enc_none(spark, sf):
    a = app(spark, sf)
    return E.apply(a, E.fit(a, "occupation_type", "none")).select("id", "src_seq", "occupation_type")


@R.add("enc_mapping", sql(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT coalesce(occupation_type, 'Unemployed') AS value FROM dv)""" if c == "occupation_type" else
    f"""SELECT '{c}' AS column_name, value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT {c} AS value FROM dv WHERE {c} IS NOT NULL)""" for c in CATS), [DEDUP_NONNULL]))
def q_enc_mapping(spark, sf):
    _, encs = C.clean_application(app(spark, sf), variant="v2", encoding="label")
    out = None
    for c in CATS:
        m = encs[c].mapping(spark).select(F.lit(c).alias("column_name"), "value", "code")
        out = m if out is None else out.unionByName(m)
    return out


@R.add("encode_application", sql(f"SELECT id, {', '.join(c + '_encoded' for c in CATS)} FROM v2",
                                 [DEDUP_NONNULL] + v2_ctes()))
def q_encode_application(spark, sf):
    df, _ = C.clean_application(app(spark, sf), variant="v2", encoding=None)
    enc, _ = E.encode_application(df, "label")
    return enc.select("id", *[f"{c}_encoded" for c in CATS])


# ---- joins / merge ----------------------------------------------------------------
N18_TRAIN = SPLIT_CTES + CREDIT_CTES + [cust_cte("month")] + TGT + [DEDUP_LAST] + n18_ctes() + FE[1:]


@R.add("join_label", sql(f"""SELECT {round_cols(_N18_COLS, {'amt_income_total_log'})}, multi_dim_target AS label,
  round(default_prop, 6) AS default_prop, round(weighted_default_prop, 6) AS weighted_default_prop
FROM n18 JOIN tgt USING (id) WHERE split = 'old'""", SPLIT_CTES + CREDIT_CTES + [cust_cte("month")] + TGT + [DEDUP_LAST] + n18_ctes(), BOTH))
def q_join_label(spark, sf):
    return r6(PL.labelled_train_frame(app(spark, sf), fx(spark, sf, "credit_record")))


_N18_FEATS = PL.feature_cols_n18() if hasattr(PL, "feature_cols_n18") else None
_N18_TRAIN_COLS = ["id", *[c for c in (PL.N18_CATEGORICAL + PL.N18_BINARY + PL.N18_NUMERICAL)
                           if c not in PL.N18_DROP], "label"]
N18_FULL = (SPLIT_CTES + CREDIT_CTES + [cust_cte("month")] + TGT + [DEDUP_LAST] + n18_ctes()
            + [f for f in FE])


@R.add("merge_data", sql(f"""SELECT split, {round_cols(_N18_TRAIN_COLS, {'amt_income_total_log'})}
FROM n18 JOIN (SELECT id, split, multi_dim_target AS label FROM tgt) t USING (id) LEFT JOIN fe USING (id)""",
                         N18_FULL, BOTH))
def q_merge_data(spark, sf):
    fs = PL.train_frame(app(spark, sf), fx(spark, sf, "credit_record"), "n18")
    return r6(fs.train.withColumn("split", F.lit("old")).unionByName(fs.test.withColumn("split", F.lit("new"))))


@R.add("train_frame", sql(f"""SELECT {round_cols(_N18_TRAIN_COLS, {'amt_income_total_log'})}
FROM n18 JOIN (SELECT id, multi_dim_target AS label FROM tgt WHERE split = 'old') t USING (id) LEFT JOIN fe USING (id)""",
                          N18_FULL, BOTH))
def q_train_frame(spark, sf):
    return r6(PL.train_frame(app(spark, sf), fx(spark, sf, "credit_record"), "n18").train)


# draws of the samplers: positions of a class in seeded-hash order
_RS = N18_FULL + [
    ("trn", "SELECT n18.id, label, age FROM n18 JOIN (SELECT id, multi_dim_target AS label FROM tgt WHERE split = 'old') t USING (id)"),
    ("cls", "SELECT label, count(*) AS n FROM trn GROUP BY label"),
    ("rkd", """SELECT trn.*, row_number() OVER (PARTITION BY label ORDER BY
  CAST(('0x' || substr(md5('42|' || CAST(id AS VARCHAR)), 1, 15)) AS BIGINT), id) - 1 AS pos FROM trn""")]


@R.add("resampled_frames", sql("""SELECT 'rus' AS method, label, count(*) AS n, CAST(sum(age) AS DOUBLE) AS sum_age
FROM rkd WHERE pos < (SELECT min(n) FROM cls) GROUP BY label
UNION ALL SELECT 'ros', label, (SELECT max(n) FROM cls), NULL FROM cls UNION ALL SELECT 'smote', label, (SELECT max(n) FROM cls), NULL FROM cls""",
                               _RS, BOTH))
def q_resampled_frames(spark, sf):
    fs = PL.train_frame(app(spark, sf), fx(spark, sf, "credit_record"), "n18")
    out = None
    for name, df in PL.resampled_frames(fs).items():
        # ages of drawn rows are compared for the undersampled frame, whose rows SQL can name
        part = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), (F.sum("age") if name == "rus" else F.lit(None).cast("double")).alias("sum_age"))
        part = part.withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("method", "label", "n", "sum_age")


@R.add("feature_columns", sql(f"SELECT {', '.join(_N18_TRAIN_COLS[:-1])} FROM n18 JOIN fe USING (id)"
                              .replace("amt_income_total_log", "round(amt_income_total_log, 6) AS amt_income_total_log"),
                              [DEDUP_LAST] + n18_ctes() + [CF] + FE, BOTH))
def q_feature_columns(spark, sf):
    a, _ = C.clean_application(app(spark, sf), variant="n18")
    j = a.join(K.feature_engineer(fx(spark, sf, "credit_record")), "id")
    cols = C.feature_columns(PL.N18_DROP, PL.N18_CATEGORICAL, PL.N18_BINARY, PL.N18_NUMERICAL)
    return r6(j.select("id", *cols))


@R.add("split_xy", sql(f"""SELECT {round_cols(_N18_TRAIN_COLS[:-1], {'amt_income_total_log'})}, label AS y
FROM n18 JOIN (SELECT id, multi_dim_target AS label FROM tgt WHERE split = 'old') t USING (id) LEFT JOIN fe USING (id)""",
                       N18_FULL, BOTH))
def q_split_xy(spark, sf):
    fs = PL.train_frame(app(spark, sf), fx(spark, sf, "credit_record"), "n18")
    x, y = C.split_xy(fs.train, "label")
    return r6(x.join(y.withColumnRenamed("label", "y"), "id"))


@R.add("rename_label", sql("SELECT id, multi_dim_target AS label FROM tgt WHERE split = 'old'",
                           SPLIT_CTES + CREDIT_CTES + [cust_cte("month")] + TGT, ("credit_record",)))
def q_rename_label(spark, sf):
    old, _ = PL.labelled_customers(fx(spark, sf, "credit_record"))
    return old.select("id", "multi_dim_target").withColumnRenamed("multi_dim_target", "label")


@R.add("keep_columns", sql("""SELECT id, round(risk_score, 6) AS risk_score, multi_dim_target FROM tgt""",
                           SPLIT_CTES + CREDIT_CTES + [cust_cte("month")] + TGT, ("credit_record",)))
def q_keep_columns(spark, sf):
    old, new = PL.labelled_customers(fx(spark, sf, "credit_record"))
    return r6(C.keep_columns(old.unionByName(new), ["id", "risk_score", "multi_dim_target"]))


_CAT = [c for c in _N18_TRAIN_COLS if "encoded" in c or "flag" in c]
_NUM = [c for c in _N18_TRAIN_COLS if c not in _CAT and c not in ("id", "label")]


@R.add("partition_features", sql(f"""SELECT id, {', '.join(f'{c} AS cat_{c}' for c in _CAT)},
  {', '.join(f'round({c}, 6) AS num_{c}' for c in _NUM)}
FROM n18 JOIN (SELECT id FROM tgt WHERE split = 'old') t USING (id) LEFT JOIN fe USING (id)""", N18_FULL, BOTH))
def q_partition_features(spark, sf):
    """Both parts, told apart by their names' beginning."""
    fs = PL.train_frame(app(spark, sf), fx(spark, sf, "credit_record"), "n18")
    num, cat = C.partition_features(fs.feature_cols)
    return r6(fs.train.select("id", *[F.col(c).alias(f"cat_{c}") for c in cat], *[F.col(c).alias(f"num_{c}") for c in num]))


@R.add("cardinalities", sql(" UNION ALL ".join(
    f"""SELECT '{c}_encoded' AS column_name, count(DISTINCT {c}_encoded) AS cardinality,
  CAST(least(50, (count(DISTINCT {c}_encoded) + 1) // 2) AS BIGINT) AS embedding_dim FROM v2""" for c in CATS),
    [DEDUP_NONNULL] + v2_ctes()))
def q_cardinalities(spark, sf):
    from riskloom.operators.inspect import cardinalities
    df, _ = C.clean_application(app(spark, sf), variant="v2")
    return cardinalities(df, [f"{c}_encoded" for c in CATS])


@R.add("class_weight", sql("""SELECT CAST(sum(CASE WHEN multi_dim_target = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
  CAST(sum(CASE WHEN multi_dim_target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
  round(CAST(sum(CASE WHEN multi_dim_target = 0 THEN 1 ELSE 0 END) AS DOUBLE)
    / nullif(sum(CASE WHEN multi_dim_target = 1 THEN 1 ELSE 0 END), 0), 6) AS pos_weight
FROM tgt WHERE split = 'old'""", SPLIT_CTES + CREDIT_CTES + [cust_cte("month")] + TGT, ("credit_record",)))
def q_class_weight(spark, sf):
    from riskloom.operators.inspect import class_weight
    old, _ = PL.labelled_customers(fx(spark, sf, "credit_record"))
    return r6(class_weight(old, "multi_dim_target"))
