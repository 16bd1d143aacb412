"""Queries that match lines and find pressures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.functions import columns as C
from framelens.operators import identify as I
from framelens.operators import lattice
from framelens.operators import matching as O
from framelens.plans.catalog import ORACLE_SQL, query
from framelens.plans.views import phases, table, view, with_views


def _r(*names: str, n: int = 6) -> list:
    return [F.round(x, n).alias(x) for x in names]


_OBS = "obs AS (SELECT frame, frame * 10000 + k1 * 10 + peak AS obs, round(2 * pi() / center, 9) AS d, center_err AS err FROM v_peaks WHERE flag = 0)"


def observed(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_peaks").filter("flag = 0").selectExpr("frame", "frame * 10000 + k1 * 10 + peak AS obs", "round(2 * pi() / center, 9) AS d", "center_err AS err").dropDuplicates(["frame", "obs"])


_OBS1 = "obs AS (SELECT frame, frame * 10000 + k1 * 10 + peak AS obs, min(round(2 * pi() / center, 9)) AS d, min(center_err) AS err FROM v_peaks WHERE flag = 0 GROUP BY 1, 2)"


def observed_once(spark: SparkSession, sf: str) -> DataFrame:
    own = view(spark, sf, "v_peaks").filter("flag = 0").selectExpr("frame", "frame * 10000 + k1 * 10 + peak AS obs", "round(2 * pi() / center, 9) AS d", "center_err AS err")
    return own.groupBy("frame", "obs").agg(F.min("d").alias("d"), F.min("err").alias("err"))


_LINES = "lines AS (SELECT o_orderkey AS frame, i AS line, round(1 + (o_custkey % 13) * 1e-2 + i * 35e-2, 9) AS d FROM orders, range(0, 12) t(i))"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame"), F.col("o_custkey"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("line")).selectExpr("frame", "CAST(line AS BIGINT) AS line", "round(1 + (o_custkey % 13) * 1e-2 + line * 35e-2, 9) AS d")


@query(f"WITH {_OBS1}, {_LINES} SELECT l.frame, l.line, l.d, arg_min(o.d, struct_pack(g := abs(o.d - l.d), o := o.d)) AS near, round(min(abs(o.d - l.d)), 9) AS gap FROM lines l LEFT JOIN obs o ON o.frame = l.frame GROUP BY 1, 2, 3", "v_peaks")
def nearest_match(spark: SparkSession, sf: str) -> DataFrame:
    return O.nearest_match(_lines(spark, sf), observed_once(spark, sf)).select("frame", "line", "d", "near", *_r("gap", n=9))


_GREEDY = """RECURSIVE {obs}, {lines}, cand AS (SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY gap, line, obs) AS n, line, obs, gap FROM ({pairs})),
walk AS (SELECT frame, 0::BIGINT AS n, []::BIGINT[] AS ls, []::BIGINT[] AS os, NULL::BIGINT AS line, NULL::BIGINT AS obs, NULL::DOUBLE AS gap FROM (SELECT DISTINCT frame FROM cand)
 UNION ALL SELECT c.frame, c.n, CASE WHEN list_contains(ls, c.line) OR list_contains(os, c.obs) THEN ls ELSE list_append(ls, c.line) END, CASE WHEN list_contains(ls, c.line) OR list_contains(os, c.obs) THEN os ELSE list_append(os, c.obs) END,
  CASE WHEN list_contains(ls, c.line) OR list_contains(os, c.obs) THEN NULL ELSE c.line END, c.obs, c.gap FROM walk w JOIN cand c ON c.frame = w.frame AND c.n = w.n + 1)
SELECT frame, line, obs, round(gap, 9) AS gap FROM walk WHERE line IS NOT NULL"""


def _greedy(pairs: str, *views: str) -> str:
    from framelens.plans.views import with_views

    body = _GREEDY.format(obs=_OBS1, lines=_LINES, pairs=pairs)
    return with_views("WITH " + body.removeprefix("RECURSIVE "), *views).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_greedy("SELECT o.frame, l.line, o.obs, abs(o.d - l.d) AS gap FROM obs o JOIN lines l ON l.frame = o.frame WHERE abs(o.d - l.d) < 2 * sqrt(pow(greatest(2e-2 * l.d, 1e-9), 2) + err * err)", "v_peaks"))
def match_one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    return O.match_one_to_one(_lines(spark, sf), observed_once(spark, sf), 0.02).select("frame", "line", "obs", *_r("gap", n=9))


@query(_greedy("SELECT o.frame, (l.line % 3) * 100 + l.line AS line, o.obs, abs(o.d - l.d) / o.d AS gap FROM obs o JOIN lines l ON l.frame = o.frame WHERE abs(o.d - l.d) / o.d < 3e-2", "v_peaks"))
def attribute_peaks(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf).selectExpr("frame", "line % 3 AS phase_order", "line", "d")
    return O.attribute_peaks(observed_once(spark, sf), lines, 0.03).selectExpr("frame", "phase_order * 100 + line AS line", "obs", "round(gap, 9) AS gap")


_EOS = """CASE eos WHEN 'Vinet' THEN 3 * k0 * (1 - pow(r, 1/3)) / pow(r, 2/3) * exp(15e-1 * (k0p - 1) * (1 - pow(r, 1/3)))
ELSE 3 * k0 * ((pow(r, -2/3) - 1) / 2) * pow(1 + 2 * ((pow(r, -2/3) - 1) / 2), 25e-1) * (1 + 15e-1 * (k0p - 4) * ((pow(r, -2/3) - 1) / 2)) END"""


@query(f"WITH x AS (SELECT p_partkey AS id, name AS phase, eos, k0, k0p, 1 - (p_size % 40) * 5e-3 AS r FROM part, v_phases) SELECT id, phase, round({_EOS}, 6) AS pressure FROM x")
def eos_pressure(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").selectExpr("p_partkey AS id", "1 - (p_size % 40) * 5e-3 AS r").join(F.broadcast(phases(spark)), F.lit(True))
    return own.select("id", F.col("name").alias("phase"), F.round(C.eos_pressure(F.col("eos"), F.col("r"), F.col("k0"), F.col("k0p")), 6).alias("pressure"))


_P_OF = _EOS.replace("pow(r,", "pow(m,")
_COMPRESS = f"""WITH RECURSIVE {{phases}}, x AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS p, name AS phase, eos, k0, k0p FROM part, v_phases),
grid AS (SELECT x.*, 1 - i * 25e-4 AS r FROM x, range(1, 393) t(i)), hit AS (SELECT phase, p, eos, k0, k0p, max(r) AS lo FROM grid WHERE {_EOS} >= p GROUP BY ALL),
b AS (SELECT phase, p, eos, k0, k0p, lo, lo + 25e-4 AS hi, 0 AS n FROM hit UNION ALL SELECT phase, p, eos, k0, k0p, CASE WHEN v >= p THEN m ELSE lo END, CASE WHEN v >= p THEN hi ELSE m END, n + 1 FROM (SELECT *, {_P_OF} AS v FROM (SELECT *, (lo + hi) / 2 AS m FROM b WHERE n < 48)))
SELECT phase, p AS pressure, round((lo + hi) / 2, 6) AS ratio FROM b WHERE n = 48"""


def _compress_sql() -> str:
    from framelens.plans.views import phases_sql

    return _COMPRESS.replace("{phases}", phases_sql())


def _register_compression():
    @query()
    def compression(spark: SparkSession, sf: str) -> DataFrame:
        own = table(spark, sf, "part").selectExpr("CAST(p_size AS DOUBLE) AS p").distinct().join(F.broadcast(phases(spark)), F.lit(True))
        return own.select(F.col("name").alias("phase"), F.col("p").alias("pressure"), F.round(C.compression(F.col("eos"), F.col("p"), F.col("k0"), F.col("k0p")), 6).alias("ratio"))

    from framelens.plans.catalog import ORACLE_SQL

    ORACLE_SQL["compression"] = _compress_sql()


_register_compression()


@query("""SELECT o_orderkey AS id, round(pow(greatest(1e-6, 1 + 2e-5 * (300 + o_custkey % 500 - 298)), 1/3), 9) AS thermal, round(exp(-1e-3 * (o_totalprice % 60)), 9) AS axial FROM orders""")
def lattice_scale(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr("300e0 + o_custkey % 500")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.round(C.thermal_scale(F.lit(2e-5), t, F.lit(298.0)), 9).alias("thermal"),
        F.round(C.axial_scale(F.expr("o_totalprice % 60"), F.lit(500.0), F.lit(4.0), F.lit(-1e-3)), 9).alias("axial"),
    )


#: Which hkl reflect, by centring, and the lines of cells(phase, a, b, c, alpha, beta, gamma, centring): 1 / d^2 = h G^-1 h,
#: with the inverse of the metric tensor by cofactors, over the whole sphere of hkl.
_RULES = """CASE centring WHEN 'I' THEN (h + k + l) % 2 = 0 WHEN 'C' THEN (h + k) % 2 = 0 WHEN 'F' THEN (h + k) % 2 = 0 AND (k + l) % 2 = 0
WHEN 'R' THEN (k + l - h) % 3 = 0 WHEN 'H' THEN (h + 2 * k) % 3 <> 0 OR l % 2 = 0 ELSE true END"""


def _refl(cells: str) -> str:
    return f"""cells AS ({cells}),
g AS (SELECT *, a * a AS g11, b * b AS g22, c * c AS g33, a * b * cos(radians(gamma)) AS g12, a * c * cos(radians(beta)) AS g13, b * c * cos(radians(alpha)) AS g23 FROM cells),
co AS (SELECT phase, centring, g22 * g33 - g23 * g23 AS c11, g11 * g33 - g13 * g13 AS c22, g11 * g22 - g12 * g12 AS c33, g13 * g23 - g12 * g33 AS c12, g12 * g23 - g13 * g22 AS c13, g12 * g13 - g11 * g23 AS c23,
  g11 * (g22 * g33 - g23 * g23) - g12 * (g12 * g33 - g23 * g13) + g13 * (g12 * g23 - g22 * g13) AS det FROM g),
hkl AS (SELECT phase, h, k, l, sqrt(det / (h * h * c11 + k * k * c22 + l * l * c33 + 2 * (h * k * c12 + h * l * c13 + k * l * c23))) AS d
  FROM co, range(-11, 12) x(h), range(-11, 12) y(k), range(-11, 12) z(l) WHERE NOT (h = 0 AND k = 0 AND l = 0) AND {_RULES}),
ln AS (SELECT phase, round(d, 6) AS d0, count(*) AS m, max(struct_pack(h := h, k := k, l := l)) AS hkl FROM hkl GROUP BY 1, 2 HAVING round(d, 6) >= 1),
wt AS (SELECT phase, d0, hkl, m / max(m) OVER (PARTITION BY phase) AS weight FROM ln), kept AS (SELECT * FROM wt WHERE weight >= 1e-2 QUALIFY row_number() OVER (PARTITION BY phase ORDER BY weight DESC, d0 DESC) <= 40),
refl AS (SELECT phase, CAST(row_number() OVER (PARTITION BY phase ORDER BY d0 DESC) AS INT) AS line, d0, weight, hkl FROM kept)"""


def _ratios(x: str) -> str:
    """``ratio`` (id, r): V / V0 of x(id, p, eos, k0, k0p) by halving below the first crossing."""
    return f"""x AS ({x}), crossed AS (SELECT id, any_value(p) AS p, any_value(eos) AS eos, any_value(k0) AS k0, any_value(k0p) AS k0p, max(r) AS lo FROM (SELECT x.*, 1 - i * 25e-4 AS r FROM x, range(1, 393) t(i)) WHERE {_EOS} >= p GROUP BY id),
bis AS (SELECT id, p, eos, k0, k0p, lo, lo + 25e-4 AS hi, 0 AS n FROM crossed UNION ALL SELECT id, p, eos, k0, k0p, CASE WHEN v >= p THEN m ELSE lo END, CASE WHEN v >= p THEN hi ELSE m END, n + 1 FROM (SELECT *, {_P_OF} AS v FROM (SELECT *, (lo + hi) / 2 AS m FROM bis WHERE n < 48))),
ratio AS (SELECT x.id, CASE WHEN x.p <= 0 THEN 1 ELSE coalesce((b.lo + b.hi) / 2, 2e-2) END AS r FROM x LEFT JOIN (SELECT * FROM bis WHERE n = 48) b ON b.id = x.id)"""


def recursive(sql: str, *views: str):
    """Register as :func:`query` does, for SQL with recursive tables."""

    def register(f):
        query()(f)
        ORACLE_SQL[f.__name__] = with_views(sql, *views).replace("WITH ", "WITH RECURSIVE ", 1)
        return f

    return register


#: Every part as a phase of one of seven crystal systems; its axes follow from its size and price.
_CELL = [
    "p_partkey % 7 AS kind", "p_partkey AS phase", "31e-1 + 1e-2 * (p_partkey % 90) AS a", "(31e-1 + 1e-2 * (p_partkey % 90)) * CASE WHEN p_partkey % 7 IN (2, 5, 6) THEN 11e-1 ELSE 1e0 END AS b",
    "(31e-1 + 1e-2 * (p_partkey % 90)) * CASE p_partkey % 7 WHEN 0 THEN 1e0 WHEN 3 THEN 162e-2 WHEN 4 THEN 24e-1 ELSE 13e-1 END AS c",
    "CASE p_partkey % 7 WHEN 6 THEN 82e0 ELSE 90e0 END AS alpha", "CASE p_partkey % 7 WHEN 5 THEN 105e0 WHEN 6 THEN 97e0 ELSE 90e0 END AS beta",
    "CASE p_partkey % 7 WHEN 3 THEN 120e0 WHEN 4 THEN 120e0 WHEN 6 THEN 104e0 ELSE 90e0 END AS gamma",
    "CASE p_partkey % 7 WHEN 0 THEN 'F' WHEN 1 THEN 'I' WHEN 2 THEN 'C' WHEN 3 THEN 'H' WHEN 4 THEN 'R' ELSE 'P' END AS centring",
]
#: The state of each part's phase: isotropic, with a softer c axis, with a linear compressibility of a, or rigid; a third is heated.
_STATE = [
    "p_size % 30 * 1e0 AS p", "CASE WHEN p_size % 3 = 0 THEN 298e0 + p_partkey % 500 END AS t", "CASE WHEN p_partkey % 4 < 3 THEN 1e2 + p_size * 4e0 END AS k0", "4e0 + p_size % 3 * 5e-1 AS k0p",
    "CASE WHEN p_partkey % 4 = 1 THEN 6e1 + p_size END AS k0_c", "CASE WHEN p_partkey % 4 = 2 THEN (p_size % 5 - 3) * 1e-3 END AS beta_a", "2e-5 * (p_partkey % 3) AS alpha_v",
]
_PARTS = f"SELECT {', '.join(_CELL)} FROM part"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*_CELL, *_STATE).withColumnRenamed("phase", "name")


_REFL = _refl("SELECT name AS phase, a, a AS b, c, 9e1 AS alpha, 9e1 AS beta, gamma, centring FROM v_phases")


def reflections_of(spark: SparkSession, top: int | None = None) -> DataFrame:
    """The ambient lines of the stand-in phases."""
    return lattice.reflections(phases(spark), top=top)


@query(f"WITH {_refl(_PARTS)} SELECT phase AS id, line, d0 AS d, round(weight, 6) AS weight, CAST(hkl.h AS INT) AS h, CAST(hkl.k AS INT) AS k, CAST(hkl.l AS INT) AS l FROM refl")
def reflections(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of every part's crystal."""
    return lattice.reflections(_parts(spark, sf)).select(F.col("phase").alias("id"), "line", F.col("d0").alias("d"), *_r("weight"), "hkl.h", "hkl.k", "hkl.l")


def _inverse_d(a: str, b: str, c: str) -> str:
    """1 / d^2 of hkl in a cell with these axes, by cofactors, as in :func:`_refl`."""
    g = {"11": f"({a})*({a})", "22": f"({b})*({b})", "33": f"({c})*({c})", "12": f"({a})*({b})*cg", "13": f"({a})*({c})*cb", "23": f"({b})*({c})*ca"}
    co = {"11": "{22}*{33}-{23}*{23}", "22": "{11}*{33}-{13}*{13}", "33": "{11}*{22}-{12}*{12}", "12": "{13}*{23}-{12}*{33}", "13": "{12}*{23}-{13}*{22}", "23": "{12}*{13}-{11}*{23}"}
    m = {k: "(" + _filled(v, g) + ")" for k, v in co.items()}
    det = _filled("({11})*C11+({12})*C12+({13})*C13", g).replace("C11", m["11"]).replace("C12", m["12"]).replace("C13", m["13"])
    return f"((h*h*{m['11']}+k*k*{m['22']}+l*l*{m['33']}+2*(h*k*{m['12']}+h*l*{m['13']}+k*l*{m['23']}))/({det}))"


def _filled(pattern: str, values: dict[str, str]) -> str:
    for k, v in values.items():
        pattern = pattern.replace("{" + k + "}", f"({v})")
    return pattern


@recursive(f"""WITH {_refl(_PARTS)}, st AS (SELECT p_partkey AS phase, {', '.join(_STATE)} FROM part),
{_ratios("SELECT phase * 2 AS id, p, 'BM3' AS eos, k0, k0p FROM st WHERE k0 IS NOT NULL UNION ALL SELECT phase * 2 + 1, p, 'BM3', k0_c, 4e0 FROM st WHERE k0_c IS NOT NULL")},
sc AS (SELECT st.*, a, b, c, cos(radians(alpha)) AS ca, cos(radians(beta)) AS cb, cos(radians(gamma)) AS cg, coalesce(pow(i.r, 1/3), 1) AS iso, CASE WHEN p <= 0 THEN 1 WHEN beta_a IS NOT NULL THEN exp(beta_a * p) ELSE coalesce(pow(i.r, 1/3), 1) END AS sa, coalesce(pow(z.r, 1/3), pow(i.r, 1/3), 1) AS s3,
  CASE WHEN t IS NULL THEN 1 ELSE pow(greatest(1e-6, 1 + alpha_v * (t - 298)), 1/3) END AS warm FROM st JOIN cells USING (phase) LEFT JOIN ratio i ON i.id = phase * 2 LEFT JOIN ratio z ON z.id = phase * 2 + 1),
al AS (SELECT phase, line, d0, weight, p, iso, sa, CASE WHEN abs(a - b) < 1e-6 THEN sa ELSE iso END AS sb, s3, warm, beta_a IS NOT NULL OR k0_c IS NOT NULL AS axial, a, b, c, ca, cb, cg, CAST(hkl.h AS DOUBLE) AS h, CAST(hkl.k AS DOUBLE) AS k, CAST(hkl.l AS DOUBLE) AS l FROM refl JOIN sc USING (phase))
SELECT phase AS id, p AS pressure, line, round(d0 * warm * CASE WHEN axial THEN sqrt({_inverse_d('a', 'b', 'c')} / {_inverse_d('a*sa', 'b*sb', 'c*s3')}) ELSE iso END, 6) AS d FROM al""")
def predict_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of every part's crystal at its own pressure and temperature."""
    own = _parts(spark, sf).withColumn("k0p_c", F.lit(4.0)).withColumn("eos", F.lit("BM3"))
    at = own.select(F.col("name").alias("phase"), F.col("p").alias("pressure"), F.col("t").alias("temperature"))
    return lattice.predict_lines(lattice.reflections(own), own, at).select(F.col("phase").alias("id"), "pressure", "line", *_r("d"))


def _eos_lines(n: int) -> str:
    """lines(phase, pressure, line, d, weight) of the stand-in phases at n pressures from 0 to 100."""
    return f"""{_REFL}, st AS (SELECT name AS phase, i AS step, i * 100 / {n - 1}e0 AS p, eos, k0, k0p FROM v_phases, range(0, {n}) t(i) WHERE i * 100 / {n - 1}e0 <= p_max), {_ratios("SELECT phase || ':' || step AS id, p, eos, k0, k0p FROM st")},
lines AS (SELECT phase, p AS pressure, line, d0 * pow(r, 1/3) AS d, weight FROM refl JOIN st USING (phase) JOIN ratio ON id = phase || ':' || step)"""


def grid_lines(spark: SparkSession, n: int) -> DataFrame:
    """The same by the operators."""
    points = spark.range(n).select((F.col("id") * 100 / F.lit(float(n - 1))).alias("pressure"))
    at = phases(spark).select(F.col("name").alias("phase"), "p_max").join(F.broadcast(points), F.col("pressure") <= F.col("p_max")).drop("p_max")
    return lattice.predict_lines(reflections_of(spark), phases(spark), at)


#: Pressures of the two scoring queries, and of the fingerprints.
_FIT, _COARSE = 101, 21
_GRID = _eos_lines(_COARSE)


def _score(n: int) -> str:
    return f"""{_OBS1}, {_eos_lines(n)}, near AS (SELECT frame, phase, pressure, line, weight, o.d AS od, abs(o.d - l.d) AS gap, sqrt(pow(1e-2 * l.d, 2) + err * err) AS sigma FROM obs o JOIN (SELECT *, d - 6 * sqrt(pow(1e-2 * d, 2) + 1e-4) AS lo, d + 6 * sqrt(pow(1e-2 * d, 2) + 1e-4) AS hi FROM lines) l ON o.d BETWEEN l.lo AND l.hi),
best AS (SELECT frame, phase, pressure, line, any_value(weight) AS weight, min(struct_pack(g := gap, o := od, s := sigma)) AS b FROM near GROUP BY 1, 2, 3, 4),
score AS (SELECT frame, phase, pressure, sum(weight * exp(-5e-1 * pow(b.g / b.s, 2))) AS score, count(*) AS n_near FROM best WHERE b.g <= 6 * b.s GROUP BY 1, 2, 3)"""


@recursive(f"WITH {_score(_FIT)}, t AS (SELECT frame, phase, max(struct_pack(s := round(score, 9), p := -pressure, raw := score)) AS t FROM score GROUP BY 1, 2) SELECT frame, phase, round(t.raw, 6) AS score, abs(t.p) AS pressure FROM t", "v_peaks")
def fit_pressure(spark: SparkSession, sf: str) -> DataFrame:
    """The best pressure of each phase on a grid of whole GPa."""
    out = I.best_on_grid(observed_once(spark, sf), phases(spark), reflections_of(spark), 0.01, n_grid=_FIT)
    return out.filter("score > 0").select("frame", "phase", *_r("score"), "pressure")


@recursive(f"WITH {_score(_COARSE)} SELECT frame, phase, pressure, round(score, 6) AS score FROM score WHERE round(score, 6) > 0", "v_peaks")
def score_lines(spark: SparkSession, sf: str) -> DataFrame:
    out = I.score_grid(observed_once(spark, sf), phases(spark), reflections_of(spark), [i * 100 / (_COARSE - 1) for i in range(_COARSE)], 0.01, above=0.0)
    return out.select("frame", "phase", "pressure", *_r("score")).filter("score > 0")


def observed_with_amplitudes(spark: SparkSession, sf: str) -> DataFrame:
    own = view(spark, sf, "v_peaks").filter("flag = 0").selectExpr("frame", "frame * 10000 + k1 * 10 + peak AS obs", "round(2 * pi() / center, 9) AS d", "center_err AS err", "amplitude")
    return own.groupBy("frame", "obs").agg(F.min("d").alias("d"), F.min("err").alias("err"), F.max("amplitude").alias("amplitude"))


@query()
def run_identification(spark: SparkSession, sf: str) -> DataFrame:
    """All frames against all phases: 300 pressures to 100 GPa or within the prior window, lines down to the data's smallest d."""
    own = observed_with_amplitudes(spark, sf)
    windows = O.pressure_windows(view(spark, sf, "v_frames").selectExpr("frame", "pressure AS prior"))
    frames = own.select("frame").distinct().withColumn("excluded", F.expr("frame % 17 = 0"))
    d_min = lattice.data_d_min(own.agg(F.min("d").alias("d")).first()["d"])
    out = I.run_identification(own, frames, phases(spark), lattice.reflections(phases(spark), d_min), windows=windows)
    return out.select("frame", "phase", *_r("pressure", "score"), "n_matched", *_r("recall", "precision", "intensity_corr", "confidence"))


@query("""SELECT frame, pressure AS prior, round(greatest(CASE WHEN frame % 3 = 0 AND frame % 20 > 0 THEN 2e-1 * (frame % 20) ELSE 2e0 END, 3e-1), 9) AS half FROM v_frames WHERE pressure IS NOT NULL""", "v_frames")
def pressure_window(spark: SparkSession, sf: str) -> DataFrame:
    own = view(spark, sf, "v_frames").selectExpr("frame", "pressure AS prior", "CASE WHEN frame % 3 = 0 THEN 1e-1 * (frame % 20) END AS prior_sigma")
    return O.pressure_windows(own).select("frame", "prior", *_r("half", n=9))


@query("""WITH m AS (SELECT p_partkey AS name, CASE WHEN p_size % 5 = 0 THEN 'axial_eos' WHEN p_size % 3 = 0 THEN 'no_eos' ELSE 'eos' END AS model,
CASE p_size % 7 WHEN 0 THEN 'ambient_reference' WHEN 1 THEN 'eos_missing' WHEN 2 THEN 'ignore_prior' END AS own FROM part)
SELECT name, model, coalesce(own, CASE WHEN model = 'no_eos' THEN 'eos_missing' ELSE 'eos_based' END) AS assumption FROM m""")
def phase_models(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").selectExpr(
        "p_partkey AS name", "p_size % 5 = 0 AS axial", "CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS k0",
        "CASE p_size % 7 WHEN 0 THEN 'Ambient_Reference' WHEN 1 THEN 'eos_missing' WHEN 2 THEN ' ignore_prior' WHEN 3 THEN 'other' END AS assumption",
    )
    return O.phase_models(own)


@query("""SELECT frame, arg_max(phase, struct_pack(c := confidence, p := pressure, f := phase)) AS phase, max(struct_pack(c := confidence, p := pressure, f := phase)).p AS prior FROM v_identify WHERE phase = 'Au' AND n_matched >= 3 GROUP BY frame""", "v_identify")
def marker_prior(spark: SparkSession, sf: str) -> DataFrame:
    return O.marker_prior(view(spark, sf, "v_identify"), phases(spark)).select("frame", "phase", "prior")


@query("SELECT i.frame, i.phase, round(pressure, 6) AS pressure, category FROM v_identify i JOIN v_phases ON name = phase WHERE confidence > 3e-1 AND n_matched >= 3", "v_identify")
def present_phases(spark: SparkSession, sf: str) -> DataFrame:
    from framelens.operators.peaks import seen_gate

    known = phases(spark).select(F.col("name").alias("phase"), "category")
    return seen_gate(view(spark, sf, "v_identify")).join(F.broadcast(known), "phase").select("frame", "phase", *_r("pressure"), "category")


@query("""SELECT frame, phase, CASE WHEN phase = 'Au' THEN 'eos' ELSE 'no_eos' END AS model, CASE WHEN phase = 'Au' THEN 'eos_based' WHEN n_matched = 0 THEN 'eos_missing' ELSE 'ambient_reference' END AS assumption FROM v_identify""", "v_identify")
def pressure_model(spark: SparkSession, sf: str) -> DataFrame:
    eos = F.col("phase") == "Au"
    return view(spark, sf, "v_identify").select(
        "frame", "phase", F.when(eos, "eos").otherwise("no_eos").alias("model"), F.when(eos, "eos_based").when(F.col("n_matched") == 0, "eos_missing").otherwise("ambient_reference").alias("assumption")
    )


@query()
def reflection_tracks(spark: SparkSession, sf: str) -> DataFrame:
    identify = view(spark, sf, "v_identify").withColumn("pressure", F.round("pressure", 0))
    return O.reflection_tracks(view(spark, sf, "v_frames"), identify, reflections_of(spark, 6), phases(spark)).select("frame", "phase", "line", "pressure", *_r("q"))


@query(f"""WITH {_REFL}, t AS (SELECT grp * 1000 + id % 50 AS track, round(min(center), 6) AS d0 FROM v_obs GROUP BY 1), n AS (SELECT track, phase, line, d0, r.d0r - d0 AS delta FROM t JOIN (SELECT phase, line, d0 AS d0r FROM refl) r ON r.d0r BETWEEN t.d0 * (1 - 5e-2) AND t.d0 * (1 + 5e-2))
SELECT track, phase, line, round(delta, 6) AS delta, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY abs(delta), phase, line) AS rank FROM n) WHERE rank <= 2""", "v_obs")
def match_tracks(spark: SparkSession, sf: str) -> DataFrame:
    tracks = view(spark, sf, "v_obs").groupBy(F.expr("grp * 1000 + id % 50").alias("track")).agg(F.round(F.min("center"), 6).alias("d0"))
    lines = reflections_of(spark).select("phase", "line", F.col("d0").alias("d"))
    return O.match_tracks(tracks, lines, 0.05, 2).select("track", "phase", "line", *_r("delta"), "rank")


@query("""WITH w(lo, hi) AS (VALUES (2e0, 22e-1), (4e0, 44e-1)), s AS (SELECT id, frame % 8 AS pk, center AS q FROM v_obs), p AS (SELECT DISTINCT frame % 8 AS pk, center, fwhm FROM v_peaks WHERE flag = 0 AND phase <> '')
SELECT id FROM s WHERE NOT EXISTS (SELECT 1 FROM w WHERE q BETWEEN lo AND hi) AND NOT EXISTS (SELECT 1 FROM p WHERE p.pk = s.pk AND q BETWEEN center - fwhm AND center + fwhm)""", "v_obs", "v_peaks")
def spot_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    windows = spark.createDataFrame([(2.0, 2.2), (4.0, 4.4)], "lo double, hi double")
    spots = view(spark, sf, "v_obs").selectExpr("id", "(frame % 8) * 1e0 AS pressure", "center AS q")
    pool = view(spark, sf, "v_peaks").filter("flag = 0 AND phase <> ''").selectExpr("(frame % 8) * 1e0 AS pressure", "center", "fwhm").distinct()
    return O.spot_exclusions(spots, pool, windows).select("id")


@query(r"""WITH h AS (SELECT 'PWDR ' || CASE WHEN frame % 3 = 0 THEN filename WHEN frame % 3 = 1 THEN 'frame_' || frame ELSE 'x' || frame END AS histogram FROM v_frames),
k AS (SELECT frame, regexp_replace(lower(filename), '[^a-z0-9]+', '', 'g') AS akey FROM v_frames), n AS (SELECT histogram, regexp_replace(lower(histogram), '[^a-z0-9]+', '', 'g') AS hkey FROM h),
m AS (SELECT histogram, frame, length(akey) AS n FROM n JOIN k ON contains(hkey, akey) AND length(akey) >= 4 QUALIFY n = max(n) OVER (PARTITION BY histogram)), g AS (SELECT histogram, min(frame) AS f, count(DISTINCT frame) AS a FROM m GROUP BY 1)
SELECT h.histogram, coalesce(f, try_cast(nullif(regexp_extract(lower(h.histogram), 'frame\D*(\d+)', 1), '') AS BIGINT)) AS frame, coalesce(a, 0) AS ambiguous FROM h LEFT JOIN g USING (histogram)""", "v_frames")
def histogram_to_frames(spark: SparkSession, sf: str) -> DataFrame:
    own = view(spark, sf, "v_frames")
    name = F.expr("concat('PWDR ', CASE WHEN frame % 3 = 0 THEN filename WHEN frame % 3 = 1 THEN concat('frame_', frame) ELSE concat('x', frame) END)")
    return O.histogram_to_frames(own.select(name.alias("histogram")), own.select("frame", F.col("filename").alias("alias")))


@query("""WITH g AS (SELECT o_custkey % 200 AS label, list(o_orderkey ORDER BY o_orderkey) AS frames FROM orders GROUP BY 1), p AS (SELECT g.label, frames, phase, fraction FROM g, (VALUES ('Au', 7e-1), ('Re', 25e-2)) v(phase, fraction))
SELECT unnest(frames) AS frame, label, phase, fraction, CAST(len(frames) AS INT) AS group_size, 1::INT AS owners FROM p""")
def refinement_import(spark: SparkSession, sf: str) -> DataFrame:
    values = spark.createDataFrame([("Au", 0.7), ("Re", 0.25)], "phase string, fraction double")
    groups = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 200).alias("label")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("frames"))
    return O.refinement_import(groups.join(F.broadcast(values), F.lit(True)))


@query("""WITH r AS (SELECT frame, sum(CASE WHEN phase = 'Au' THEN eta * 2 ELSE eta END) AS total, count(*) FILTER (NOT (CASE WHEN phase = 'Au' THEN eta * 2 ELSE eta END BETWEEN 0 AND 1)) AS n_outside FROM v_peaks GROUP BY frame)
SELECT frame, round(total, 6) AS total, n_outside FROM r WHERE abs(total - 1) > 2e-2 OR n_outside > 0""", "v_peaks")
def fraction_warnings(spark: SparkSession, sf: str) -> DataFrame:
    own = view(spark, sf, "v_peaks").select("frame", F.expr("CASE WHEN phase = 'Au' THEN eta * 2 ELSE eta END").alias("fraction"))
    return O.fraction_warnings(own).select("frame", *_r("total"), "n_outside")


@query("""WITH q AS (SELECT DISTINCT round(2 * pi() / 356683e-5 * sqrt(h*h + k*k + l*l), 6) AS q FROM range(0, 9) x(h), range(0, 9) y(k), range(0, 9) z(l) WHERE h >= k AND k >= l AND h > 0 AND ((h % 2 = 1 AND k % 2 = 1 AND l % 2 = 1) OR (h % 2 = 0 AND k % 2 = 0 AND l % 2 = 0 AND (h + k + l) % 4 = 0)))
SELECT frame, bin, CAST(bool_or(q IS NOT NULL) AS BOOLEAN) AS masked FROM v_bins LEFT JOIN q ON radial BETWEEN q * (1 - 2e-2) AND q * (1 + 2e-2 + 4e-2) AND q <= 8 GROUP BY 1, 2""", "v_bins")
def diamond_windows(spark: SparkSession, sf: str) -> DataFrame:
    bins = view(spark, sf, "v_bins").select("frame", "bin", "radial")
    windows = O.diamond_lines()(bins)
    inside = O.band_join(bins, windows, [], "radial", F.col("lo"), F.col("hi"), 0.25).select("frame", "bin").distinct().withColumn("hit", F.lit(True))
    return bins.join(inside, ["frame", "bin"], "left").select("frame", "bin", F.coalesce("hit", F.lit(False)).alias("masked"))


@query("""WITH w(d) AS (VALUES (2e0), (125e-2)) SELECT frame, bin, round(CASE WHEN EXISTS (SELECT 1 FROM w WHERE radial BETWEEN 2 * pi() / d * (1 - 28e-3) AND 2 * pi() / d * (1 + 28e-3)) THEN 0 ELSE mean END, 6) AS y FROM v_bins""", "v_bins")
def d_windows(spark: SparkSession, sf: str) -> DataFrame:
    bins = view(spark, sf, "v_bins").select("frame", "bin", "radial", "mean")
    windows = spark.createDataFrame([(2.0,), (1.25,)], "d double").withColumn("q", C.d_to_radial(F.col("d"), "q_A^-1"))
    inside = O.band_join(bins, windows, [], "radial", F.col("q") * (1 - 0.028), F.col("q") * (1 + 0.028), 0.25).select("frame", "bin").distinct().withColumn("hit", F.lit(True))
    return bins.join(inside, ["frame", "bin"], "left").select("frame", "bin", F.round(F.when(F.col("hit"), 0.0).otherwise(F.col("mean")), 6).alias("y"))
