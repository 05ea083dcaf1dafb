"""Registered scaling, composite-target, resampling and neighbour queries
(SURVEY 2.6 target_composite, 2.7, 2.8 knn)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import credit as K
from riskloom.operators import neighbors as N
from riskloom.operators import sampling as SM
from riskloom.operators import scale as S
from riskloom.operators import split as P
from riskloom.operators import target as T
from riskloom.plans import pipeline as PL
from riskloom.plans import q_application as QA
from riskloom.plans.common import Registry, fx, r6, with_fixtures
from riskloom.plans.q_credit import CC, CREDIT_CTES, SPLIT_CTES, TGT, VZ, cust_cte

R = Registry()


def r6v(df, col):
    return df.withColumn(col, F.transform(F.col(col), lambda x: F.round(x, 6)))


# ---- customers used by the scalers -------------------------------------------------
def customers(spark, sf):
    cr = fx(spark, sf, "credit_record")
    return P.assign_split(K.clean_credit(cr, decay_mode="position"))


CUST = CREDIT_CTES + [cust_cte("position"), CC, VZ] + SPLIT_CTES + [
    ("cs", "SELECT vz.*, spl.split FROM vz JOIN spl USING (id)")]
MET = ["weighted_default_prop", "default_prop", "weighted_default_prop_tenure_norm",
       "weighted_default_prop_vintage_norm"]


def csql(body, ctes=()):
    return with_fixtures(["credit_record"], body, CUST + list(ctes))


STD_COLS = ["default_prop", "weighted_default_prop", "tenure"]


@R.add("scale_standard", csql(f"""SELECT id, split, {', '.join(
    f"round(({c} - (SELECT avg({c}) FROM cs WHERE split = 'old')) / "
    f"(SELECT CASE WHEN stddev_pop({c}) < 1e-15 OR stddev_pop({c}) IS NULL THEN 1.0 ELSE stddev_pop({c}) END "
    f"FROM cs WHERE split = 'old'), 6) AS {c}" for c in STD_COLS)} FROM cs"""))
def q_scale_standard(spark, sf):
    c = customers(spark, sf).select("id", "split", *STD_COLS)
    tr, te = S.scale_standard(c.filter("split = 'old'"), c.filter("split = 'new'"), STD_COLS)
    return r6(tr.unionByName(te))


@R.add("scale_robust", csql(f"""SELECT id, {', '.join(
    f"round(({c} - (SELECT quantile_cont({c}, 0.5) FROM cs WHERE split = 'old')) / (SELECT CASE WHEN "
    f"abs(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) < 1e-15 THEN 1.0 ELSE "
    f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END FROM cs WHERE split = 'old'), 6) AS {c}_scaled"
    for c in MET)} FROM cs WHERE split = 'old'"""))
def q_scale_robust(spark, sf):
    c = customers(spark, sf).filter("split = 'old'")
    return r6(S.scale_robust(c, MET).select("id", *[f"{m}_scaled" for m in MET]))


def d_rank_pct(c):
    return (f"CASE WHEN {c} IS NULL THEN NULL ELSE (rank() OVER (ORDER BY {c}) + "
            f"(count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count({c}) OVER () END")


@R.add("scale_rank_pct", csql(f"""SELECT id, {', '.join(f"round({d_rank_pct(c)}, 6) AS {c}_scaled" for c in MET)}
FROM cs WHERE split = 'old'"""))
def q_scale_rank_pct(spark, sf):
    c = customers(spark, sf).filter("split = 'old'")
    return r6(S.scale_rank_pct(c, MET).select("id", *[f"{m}_scaled" for m in MET]))


def quantile_ctes(src: str, c: str, tag: str, rows: str | None = None):
    """Uniform quantile transform of column ``c`` of ``rows`` (of ``src`` itself) by the knots of ``src`` (brute force SQL)."""
    return [
        (f"sv_{tag}", f"SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS i FROM {src} "
                      f"WHERE {c} IS NOT NULL"),
        (f"sr_{tag}", f"SELECT id, {c} FROM {rows or src}"),
        (f"nk_{tag}", f"SELECT count(*) AS n, least(1000, count(*)) AS k FROM sv_{tag}"),
        (f"rf_{tag}", f"""SELECT j, CASE WHEN k = 1 THEN 0.0 ELSE CAST(j AS DOUBLE) / (k - 1) END AS r,
  (CASE WHEN k = 1 THEN 0.0 ELSE CAST(j AS DOUBLE) / (k - 1) END) * (n - 1) AS p FROM nk_{tag}, range(k) t(j)"""),
        (f"qv_{tag}", f"""SELECT j, r, a.x + (p - floor(p)) * (b.x - a.x) AS q FROM rf_{tag}
  JOIN sv_{tag} a ON a.i = CAST(floor(p) AS BIGINT) JOIN sv_{tag} b ON b.i = CAST(ceil(p) AS BIGINT)"""),
        (f"kn_{tag}", f"""SELECT q, min(r) AS lo, max(r) AS hi FROM qv_{tag} GROUP BY q"""),
        (f"kx_{tag}", f"""SELECT q, lo, hi, lead(q) OVER (ORDER BY q) AS qn, lead(lo) OVER (ORDER BY q) AS lon,
  min(q) OVER () AS qmin, max(q) OVER () AS qmax FROM kn_{tag}"""),
        (f"qt_{tag}", f"""SELECT s.id, CASE WHEN s.{c} IS NULL THEN NULL
  WHEN s.{c} - 1e-7 < (SELECT min(q) FROM kn_{tag}) THEN 0.0
  WHEN s.{c} + 1e-7 > (SELECT max(q) FROM kn_{tag}) THEN 1.0
  WHEN s.{c} = k.q THEN (k.lo + k.hi) / 2
  ELSE k.hi + (s.{c} - k.q) * (k.lon - k.hi) / (k.qn - k.q) END AS v
FROM sr_{tag} s ASOF LEFT JOIN kx_{tag} k ON s.{c} >= k.q"""),
    ]


OLD = ("old", "SELECT * FROM cs WHERE split = 'old'")
QT = [OLD] + [x for i, m in enumerate(MET) for x in quantile_ctes("old", m, f"m{i}")]


@R.add("scale_quantile", csql(f"""SELECT old.id, {', '.join(f"round(qt_m{i}.v, 6) AS {m}_scaled" for i, m in enumerate(MET))}
FROM old {' '.join(f"JOIN qt_m{i} USING (id)" for i in range(len(MET)))}""", QT))
def q_scale_quantile(spark, sf):
    c = customers(spark, sf).filter("split = 'old'")
    return r6(S.scale_quantile(c, MET).select("id", *[f"{m}_scaled" for m in MET]))


COMP = QT + [("comp", f"""SELECT old.id, {' + '.join(f"0.25 * qt_m{i}.v" for i in range(len(MET)))} AS composite_risk_score
FROM old {' '.join(f"JOIN qt_m{i} USING (id)" for i in range(len(MET)))}""")]


@R.add("target_composite", csql("""SELECT id, round(composite_risk_score, 6) AS composite_risk_score,
  CASE WHEN composite_risk_score > (SELECT quantile_cont(composite_risk_score, 0.8) FROM comp) THEN 1 ELSE 0 END
    AS multi_dim_target FROM comp""", COMP))
def q_target_composite(spark, sf):
    c = customers(spark, sf).filter("split = 'old'")
    lab, _ = T.composite_target(c, scaling="quantile")
    return r6(lab.select("id", "composite_risk_score", "multi_dim_target"))


def half_ctes(cleaned: str, labels: str, cols: list[str], numeric: list[str]) -> tuple[str, list]:
    """Both halves of a training frame: numeric columns standardised by the old accounts."""
    from_old = lambda c: (f"round(({c} - (SELECT avg({c}) FROM hv WHERE split = 'old')) / "  # noqa: E731
                          f"(SELECT stddev_pop({c}) FROM hv WHERE split = 'old'), 6) AS {c}")
    body = f"SELECT id, split, label, {', '.join(from_old(c) if c in numeric else c for c in cols)} FROM hv"
    return body, [("hv", f"SELECT x.*, l.split, l.multi_dim_target AS label FROM {cleaned} x JOIN {labels} l USING (id)")]


def both_halves(fs):
    return r6(fs.train.withColumn("split", F.lit("old")).unionByName(fs.test.withColumn("split", F.lit("new"))))


_F_BODY, _F_HALVES = half_ctes("fcl", "tgt", [c for c in QA._F_COLS if c != "id"], PL.F_NUMERIC)


@R.add("train_frame_f", with_fixtures(["credit_record", "application_record"], _F_BODY, CREDIT_CTES + [cust_cte("position")] + SPLIT_CTES + TGT
                                      + [QA.DEDUP_LAST] + QA.F_CTES + _F_HALVES))
def q_train_frame_f(spark, sf):
    return both_halves(PL.train_frame(QA.app(spark, sf), fx(spark, sf, "credit_record"), "f"))


_V2_FRAME = [c for c in QA._V2_COLS if c != "id" and c not in PL.V2_XY_DROP]
_V2_BODY, _V2_HALVES = half_ctes("v2", "clab", _V2_FRAME, [c for c in PL.V2_NUMERIC if c in _V2_FRAME])
_ALL_QT = [x for i, m in enumerate(MET) for x in quantile_ctes("old", m, f"m{i}", "cs")]
_V2_LABELS = [OLD] + _ALL_QT + [
    ("comp", f"""SELECT cs.id, cs.split, {' + '.join(f"0.25 * qt_m{i}.v" for i in range(len(MET)))} AS score
FROM cs {' '.join(f"JOIN qt_m{i} USING (id)" for i in range(len(MET)))}"""),
    ("clab", """SELECT id, split, CASE WHEN score > (SELECT quantile_cont(score, 0.8) FROM comp WHERE split = 'old') THEN 1 ELSE 0 END
  AS multi_dim_target FROM comp""")]


@R.add("train_frame_v2", with_fixtures(["credit_record", "application_record"], _V2_BODY, CUST + _V2_LABELS + [QA.DEDUP_NONNULL] + QA.v2_ctes() + _V2_HALVES))
def q_train_frame_v2(spark, sf):
    """The composite label of the old accounts' scalers and threshold, on both halves."""
    return both_halves(PL.train_frame(QA.app(spark, sf), fx(spark, sf, "credit_record"), "v2"))


ROBUST = [("crob", f"""SELECT id, {' + '.join(f"0.25 * ({m} - (SELECT quantile_cont({m}, 0.5) FROM cs WHERE split = 'old')) / (SELECT quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25) FROM cs WHERE split = 'old')" for m in MET)} AS score
FROM cs WHERE split = 'old'""")]


@R.add("target_composite_robust", csql("""SELECT id, round(score, 6) AS composite_risk_score,
  CASE WHEN score > (SELECT quantile_cont(score, 0.8) FROM crob) THEN 1 ELSE 0 END AS multi_dim_target FROM crob""", ROBUST))
def q_target_composite_robust(spark, sf):
    lab, _ = T.composite_target(customers(spark, sf).filter("split = 'old'"), scaling="robust")
    return r6(lab.select("id", "composite_risk_score", "multi_dim_target"))


RANKED = [("crk", f"""SELECT id, {' + '.join(f"0.25 * {d_rank_pct(m)}" for m in MET)} AS score FROM cs WHERE split = 'old'""")]


@R.add("target_composite_rank", csql("""SELECT id, round(score, 6) AS composite_risk_score,
  CASE WHEN score > (SELECT quantile_cont(score, 0.8) FROM crk) THEN 1 ELSE 0 END AS multi_dim_target FROM crk""", RANKED))
def q_target_composite_rank(spark, sf):
    lab, _ = T.composite_target(customers(spark, sf).filter("split = 'old'"), scaling="rank_pct")
    return r6(lab.select("id", "composite_risk_score", "multi_dim_target"))


# ---- resampling and neighbours on ``vectors`` -------------------------------------------
def vectors(spark, sf):
    return fx(spark, sf, "vectors")


def H(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 15)) AS BIGINT)"


VR = [("sz", """SELECT arg_min(label, n) AS minority, arg_max(label, n) AS majority, min(n) AS n_min, max(n) AS n_max
FROM (SELECT label, count(*) AS n FROM vectors GROUP BY label)"""),
      ("rk", f"""SELECT vec_id, label, embedding,
  row_number() OVER (PARTITION BY label ORDER BY {H("'42|' || CAST(vec_id AS VARCHAR)")}, vec_id) - 1 AS pos
FROM vectors"""),
      ("dr", "SELECT pos - n_min AS draw FROM rk, sz WHERE label = majority AND pos >= n_min")]


def vsql(body, ctes=()):
    return with_fixtures(["vectors"], body, VR + list(ctes))


ROUNDV = "list_transform(embedding, lambda x: round(x, 6))"


@R.add("sample_under", vsql(f"SELECT vec_id, label, {ROUNDV} AS embedding FROM rk, sz WHERE pos < n_min"))
def q_sample_under(spark, sf):
    return r6v(SM.sample_under(vectors(spark, sf), key="vec_id"), "embedding")


@R.add("sample_over", vsql(f"""SELECT vec_id, label, {ROUNDV} AS embedding, NULL::BIGINT AS draw FROM vectors
UNION ALL SELECT r.vec_id, r.label, list_transform(r.embedding, lambda x: round(x, 6)), d.draw
FROM (SELECT draw, {H("'42|over|' || CAST(draw AS VARCHAR)")} % n_min AS pos FROM dr, sz) d
JOIN rk r ON r.pos = d.pos JOIN sz ON r.label = sz.minority"""))
def q_sample_over(spark, sf):
    return r6v(SM.sample_over(vectors(spark, sf), key="vec_id"), "embedding")


NN_ALL = ("nn5", """SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
  list_distance(a.embedding, b.embedding) AS distance,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding, b.embedding), b.vec_id) AS rank
FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id) WHERE rank <= 5""")


@R.add("knn_join", vsql("SELECT query_id, neighbor_id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM nn5",
                        [NN_ALL]))
def q_knn_join(spark, sf):
    v = vectors(spark, sf)
    return r6(N.knn_join(v, v, k=5, exclude_self=True))


@R.add("knn_join_manhattan", vsql("""SELECT query_id, neighbor_id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance
FROM (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
  list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1] - p[2]))) AS distance,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY
    list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1] - p[2]))), b.vec_id) AS rank
FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id) WHERE rank <= 5"""))
def q_knn_join_manhattan(spark, sf):
    v = vectors(spark, sf)
    return r6(N.knn_join(v, v, k=5, metric="manhattan", exclude_self=True))


@R.add("knn_classify", vsql("""SELECT query_id, round(avg(CAST(v.label AS DOUBLE)), 6) AS proba,
  CASE WHEN avg(CAST(v.label AS DOUBLE)) > 0.5 THEN 1 ELSE 0 END AS y_pred
FROM nn5 JOIN vectors v ON v.vec_id = nn5.neighbor_id GROUP BY query_id""", [NN_ALL]))
def q_knn_classify(spark, sf):
    v = vectors(spark, sf)
    nn = N.knn_join(v, v, k=5, exclude_self=True)
    return r6(N.knn_classify(nn, v))


@R.add("knn_classify_distance", vsql("""SELECT query_id, round(sum(v.label / distance) / sum(1 / distance), 6) AS proba,
  CASE WHEN sum(v.label / distance) / sum(1 / distance) > 0.5 THEN 1 ELSE 0 END AS y_pred
FROM nn5 JOIN vectors v ON v.vec_id = nn5.neighbor_id GROUP BY query_id""", [NN_ALL]))
def q_knn_classify_distance(spark, sf):
    v = vectors(spark, sf)
    nn = N.knn_join(v, v, k=5, exclude_self=True)
    return r6(N.knn_classify(nn, v, weights="distance"))


MNN = [("mi", "SELECT rk.* FROM rk, sz WHERE label = minority"),
       ("mnn", """SELECT * FROM (SELECT a.vec_id AS base_id, b.vec_id AS neighbor_id, row_number() OVER
  (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding, b.embedding), b.vec_id) AS rank
  FROM mi a JOIN mi b ON a.vec_id <> b.vec_id) WHERE rank <= 5"""),
       ("sd", f"""SELECT draw, {H("'42|base|' || CAST(draw AS VARCHAR)")} % n_min AS pos,
  1 + {H("'42|nn|' || CAST(draw AS VARCHAR)")} % least(5, n_min - 1) AS rank,
  {H("'42|gap|' || CAST(draw AS VARCHAR)")} / 1152921504606846976.0 AS gap FROM dr, sz"""),
       ("syn", """SELECT sd.draw, sz.minority AS label, mi.vec_id AS base_id, mnn.neighbor_id, sd.gap,
  list_transform(list_zip(mi.embedding, nb.embedding), lambda p: p[1] + sd.gap * (p[2] - p[1])) AS embedding
FROM sd JOIN mi ON mi.pos = sd.pos JOIN mnn ON mnn.base_id = mi.vec_id AND mnn.rank = sd.rank
JOIN vectors nb ON nb.vec_id = mnn.neighbor_id, sz""")]


@R.add("smote", vsql(f"SELECT draw, label, {ROUNDV} AS embedding, base_id, neighbor_id, round(gap, 6) AS gap FROM syn", MNN))
def q_smote(spark, sf):
    return r6v(r6(SM.smote(vectors(spark, sf), key="vec_id")), "embedding")


@R.add("tomek_links", vsql("""SELECT a.query_id AS id_a, a.neighbor_id AS id_b, va.label AS label_a, vb.label AS label_b
FROM nn5 a JOIN nn5 b ON a.query_id = b.neighbor_id AND a.neighbor_id = b.query_id AND a.rank = 1 AND b.rank = 1
JOIN vectors va ON va.vec_id = a.query_id JOIN vectors vb ON vb.vec_id = a.neighbor_id
WHERE a.query_id < a.neighbor_id AND va.label <> vb.label""", [NN_ALL]))
def q_tomek_links(spark, sf):
    return SM.tomek_links(vectors(spark, sf), key="vec_id")


ST = MNN + [
    ("res", """SELECT vec_id, label, embedding FROM vectors
UNION ALL SELECT -(draw + 1), label, embedding FROM syn"""),
    ("nn1", """SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS n, row_number() OVER
  (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding, b.embedding), b.vec_id) AS rk
  FROM res a JOIN res b ON a.vec_id <> b.vec_id) WHERE rk = 1"""),
    ("links", """SELECT x.q AS a, x.n AS b FROM nn1 x JOIN nn1 y ON x.q = y.n AND x.n = y.q
JOIN res ra ON ra.vec_id = x.q JOIN res rb ON rb.vec_id = x.n WHERE ra.label <> rb.label"""),
]


@R.add("smote_tomek", vsql(f"""SELECT vec_id, label, {ROUNDV} AS embedding FROM res
WHERE vec_id NOT IN (SELECT a FROM links UNION SELECT b FROM links)""", ST))
def q_smote_tomek(spark, sf):
    return r6v(SM.smote_tomek(vectors(spark, sf), key="vec_id"), "embedding")


@R.add("cluster_centroids")
def q_cluster_centroids(spark, sf):
    return r6v(SM.cluster_centroids(vectors(spark, sf), key="vec_id"), "embedding")


@R.add("make_sampled_sets", vsql("""SELECT * FROM (
  SELECT 'original' AS method, label, count(*) AS n FROM vectors GROUP BY label
  UNION ALL SELECT 'ros', label, (SELECT n_max FROM sz) FROM vectors GROUP BY label
  UNION ALL SELECT 'rus', label, (SELECT n_min FROM sz) FROM vectors GROUP BY label
  UNION ALL SELECT 'smote', label, (SELECT n_max FROM sz) FROM vectors GROUP BY label)"""))
def q_make_sampled_sets(spark, sf):
    # the methods of the oracle; compare_samplers runs all of them
    sets = SM.make_sampled_sets(vectors(spark, sf), key="vec_id", methods=("original", "ros", "rus", "smote"))
    out = None
    for name, df in sets.items():
        c = df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("method", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out.select("method", "label", "n")
