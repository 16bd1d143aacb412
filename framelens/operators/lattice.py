"""Reflections of any crystal lattice, and their lines under pressure and temperature.

A phase is a row: name, a, and optionally b, c (default a), alpha, beta, gamma (default 90), centring (default P), an
equation of state (eos, k0, k0p, p_max), its axial parts (``k0_a, k0p_a, beta_a`` and so on for b and c), and a thermal
expansion (alpha_v, t0). Missing columns count as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions import columns as C

#: The smallest d without data, and its lower limit with data; lines kept at a d of 1 or more, and at most: fixed values.
D_MIN, D_FLOOR, LINES, MOST_LINES = 1.0, 0.25, 40, 400
#: The temperature without a reference of its own: fixed value.
ROOM = 298.0
#: Indices of planes lie between -_HALF and _HALF: digits to the base _BASE.
_BASE, _HALF = 1 << 21, 1 << 20
CELL = ("a", "b", "c", "alpha", "beta", "gamma")


def column_of(df: DataFrame, name: str, kind: str = "double") -> Column:
    """A column, or nulls where there is none."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def with_cell(phases: DataFrame) -> DataFrame:
    """``phases`` with all cell columns and the centring; missing ones are those of the most symmetric cell."""
    a = F.col("a").cast("double")
    own = {k: F.coalesce(column_of(phases, k), a if k in "bc" else F.lit(90.0)) for k in CELL[1:]}
    return phases.withColumns({"a": a, **own, "centring": F.coalesce(column_of(phases, "centring", "string"), F.lit("P"))})


def reciprocal_metric(cell: dict[str, Column]) -> dict[str, Column]:
    """The six numbers of the reciprocal metric tensor (11, 22, 33, 12, 13, 23) of a triclinic cell."""
    a, b, c = (cell[k] for k in "abc")
    ca, cb, cg = (F.cos(F.radians(cell[k])) for k in ("alpha", "beta", "gamma"))
    part = 1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg  # (volume / abc) squared
    return {
        "11": (1 - ca * ca) / (a * a * part), "22": (1 - cb * cb) / (b * b * part), "33": (1 - cg * cg) / (c * c * part),
        "12": (ca * cb - cg) / (a * b * part), "13": (ca * cg - cb) / (a * c * part), "23": (cb * cg - ca) / (b * c * part),
    }


def d_of(h: Column, k: Column, l: Column, metric: dict[str, Column]) -> Column:  # noqa: E741
    """The spacing of the planes hkl; null where the cell has none."""
    s = h * h * metric["11"] + k * k * metric["22"] + l * l * metric["33"] + 2 * (h * k * metric["12"] + h * l * metric["13"] + k * l * metric["23"])
    return F.when(s > 0, 1 / F.sqrt(s))


def allowed(centring: Column) -> Column:
    """Whether a centring lets hkl (columns h, k, l) reflect: P, A, B, C, I, F, R (hexagonal axes), D (diamond), H (hexagonal close packing)."""
    same = F.expr("abs(h) % 2 = abs(k) % 2 AND abs(k) % 2 = abs(l) % 2")
    rules = {
        "A": F.expr("abs(k + l) % 2 = 0"), "B": F.expr("abs(h + l) % 2 = 0"), "C": F.expr("abs(h + k) % 2 = 0"), "I": F.expr("abs(h + k + l) % 2 = 0"),
        "F": same, "R": F.expr("abs(k + l - h) % 3 = 0"), "D": same & F.expr("abs(h + k + l) % 2 = 1 OR abs(h + k + l) % 4 = 0"),
        "H": F.expr("abs(h + 2 * k) % 3 <> 0 OR abs(l) % 2 = 0"),
    }
    return F.coalesce(reduce(lambda out, rule: out.when(centring == rule[0], rule[1]), rules.items(), F.when(centring == "P", True)), F.lit(True))


def line_cap(d_min: float) -> int:
    """How many lines of a phase are kept: as many as the reflecting planes grow, between LINES and MOST_LINES."""
    return int(min(MOST_LINES, max(LINES, round(LINES / d_min**3))))


def data_d_min(smallest: float | None) -> float:
    """The smallest d that lines are needed for, given the smallest d on the data's axis."""
    return D_MIN if smallest is None or not smallest > 0 else max(D_FLOOR, min(D_MIN, smallest))


def reflections(phases: DataFrame, d_min: float = D_MIN, top: int | None = None, least: float = 0.01, given: DataFrame | None = None) -> DataFrame:
    """phase, line, d0, weight, hkl: the ambient lines of each phase with d of ``d_min`` or more, the ``top`` strongest.

    Planes of one spacing (six decimals) are one line; its weight is their number, in parts of the phase's largest. Lines below
    ``least`` are left out. ``given`` (phase, d0, weight, hkl) are the lines of the phases that it names, instead. Lines are
    numbered by falling d. Ties in strength go to the larger d.
    """
    own = with_cell(phases).filter("a > 0 AND b > 0 AND c > 0")
    if given is not None:
        own = own.join(given.select(F.col("phase").alias("name")).distinct(), "name", "left_anti")
    metric = {f"_{k}": v for k, v in reciprocal_metric({k: F.col(k) for k in CELL}).items()}
    # A phase's planes are made and counted in one task, so only the phases move; by number, as each is much work.
    parts = int(phases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.select(F.col("name").alias("phase"), "centring", *"abc", *[v.alias(k) for k, v in metric.items()]).repartition(parts, "phase")
    span = lambda k, low: F.sequence(-F.floor(F.col(k) / d_min) if low else F.lit(0).cast("long"), F.floor(F.col(k) / d_min))
    # One of each two opposite planes: the first of h, k, l that isn't 0 is positive. |h| is at most a / d.
    hkl = own.withColumn("h", F.explode(span("a", False))).withColumn("k", F.explode(span("b", True))).withColumn("l", F.explode(span("c", True)))
    half = hkl.filter("h > 0 OR (h = 0 AND (k > 0 OR (k = 0 AND l > 0)))").filter(allowed(F.col("centring")))
    d = d_of(F.col("h"), F.col("k"), F.col("l"), {k[1:]: F.col(k) for k in metric})
    # h, k and l as the digits of one number, whose order is theirs: its largest is kept without a sort.
    number = ((F.col("h") + _HALF) * _BASE + F.col("k") + _HALF) * _BASE + F.col("l") + _HALF
    planes = half.select("phase", F.round(d, 6).alias("d0"), number.alias("number")).filter(F.col("d0") >= d_min)
    lines = planes.groupBy("phase", "d0").agg((2.0 * F.count(F.lit(1))).alias("weight"), F.max("number").alias("number"))
    digits = [F.expr(x) for x in (f"number DIV {_BASE * _BASE}", f"number DIV {_BASE} % {_BASE}", f"number % {_BASE}")]
    lines = lines.select("phase", "d0", "weight", F.struct(*[(v - _HALF).cast("int").alias(x) for x, v in zip("hkl", digits)]).alias("hkl"))
    if given is not None:
        lines = lines.unionByName(given.select("phase", F.round("d0", 6).alias("d0"), F.col("weight").cast("double").alias("weight"), "hkl").filter(F.col("d0") >= d_min))
    strong = lines.withColumn("weight", F.col("weight") / F.max("weight").over(Window.partitionBy("phase"))).filter(F.col("weight") >= least)
    first = Window.partitionBy("phase").orderBy(F.desc("weight"), F.desc("d0"))
    kept = strong.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= (line_cap(d_min) if top is None else top))
    return kept.select("phase", F.row_number().over(Window.partitionBy("phase").orderBy(F.desc("d0"))).alias("line"), "d0", "weight", "hkl")


def volume_scale(phases: DataFrame, pressure: Column) -> Column:
    """The cube root of V / V0 at a pressure; 1 without a bulk modulus."""
    k0, k0p = column_of(phases, "k0"), column_of(phases, "k0p")
    return F.when(k0.isNull(), 1.0).otherwise(F.pow(C.compression(column_of(phases, "eos", "string"), pressure, k0, k0p), F.lit(1.0 / 3)))


def has_axial(phases: DataFrame) -> Column:
    """Whether a phase has an equation of state or a compressibility of its own for some axis."""
    return reduce(lambda x, y: x | y, [column_of(phases, f"{p}_{k}").isNotNull() for k in "abc" for p in ("k0", "beta")])


def axis_scales(phases: DataFrame, pressure: Column, isotropic: Column) -> dict[str, Column]:
    """The scale of each axis: exp(beta P) with a linear compressibility, else the cube root of its own equation of state, else the isotropic one.

    A second axis without one of its own follows an equal first axis.
    """

    def axis(k: str, other: Column) -> Column:
        beta, k0 = column_of(phases, f"beta_{k}"), column_of(phases, f"k0_{k}")
        own = F.pow(C.compression(F.coalesce(column_of(phases, f"eos_{k}", "string"), F.lit("BM3")), pressure, k0, column_of(phases, f"k0p_{k}")), F.lit(1.0 / 3))
        return F.when(beta.isNotNull(), F.exp(beta * pressure)).when(k0.isNotNull(), own).otherwise(other)

    first = axis("a", isotropic)
    return {"a": first, "b": axis("b", F.when(F.abs(F.col("a") - F.col("b")) < 1e-6, first).otherwise(isotropic)), "c": axis("c", isotropic)}


def predict_lines(reflections: DataFrame, phases: DataFrame, at: DataFrame) -> DataFrame:
    """phase, pressure (and temperature, if ``at`` has it), line, d, weight for each row of ``at`` (phase, pressure).

    A line is scaled by the ratio of its spacing in the compressed cell to that in the ambient one, if the phase has an axial
    equation of state and the line an hkl; else by the cube root of the volume's ratio. The thermal expansion comes on top,
    where phase and row have a temperature. Pressures above a phase's highest one count as that; without a bulk modulus and
    axial parts nothing moves.
    """
    hot = "temperature" in at.columns
    keys = ["phase", "pressure"] + ["temperature"] * hot
    own = with_cell(phases).withColumnRenamed("name", "phase")
    # By number: a state is a small row, but inverting equations of state is work. Merged: a file's size says little of the number
    # of its phases, so neither these nor their states may be gathered for a broadcast.
    parts = int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = at.select(*keys).distinct().join(own.hint("merge"), "phase").repartition(parts, "phase")
    top = column_of(own, "p_max")
    state = state.withColumn("_p", F.greatest(F.lit(0.0), F.least(F.col("pressure").cast("double"), F.coalesce(top, F.lit(float("inf"))))))
    state = state.withColumn("_iso", volume_scale(own, F.col("_p")))
    scales = {k: F.when(F.col("_p") > 0, s).otherwise(1.0) for k, s in axis_scales(own, F.col("_p"), F.col("_iso")).items()}
    warm = F.lit(1.0)
    if hot:
        alpha = column_of(own, "alpha_v")
        warm = F.when(alpha.isNull() | F.col("temperature").isNull(), 1.0).otherwise(C.thermal_scale(alpha, F.col("temperature"), F.coalesce(column_of(own, "t0"), F.lit(ROOM))))
    metrics = lambda cell, name: F.struct(*[v.alias(f"m{k}") for k, v in reciprocal_metric(cell).items()]).alias(name)
    state = state.withColumns({f"_{k}": F.col(k) * s for k, s in scales.items()})
    cell = metrics({k: F.col(k) for k in CELL}, "_cell")
    pressed = metrics({k: F.col(f"_{k}" if k in scales else k) for k in CELL}, "_pressed")
    state = state.select(*keys, "_iso", warm.alias("_warm"), has_axial(own).alias("_axial"), cell, pressed)
    lines = state.join(reflections.hint("merge"), "phase")
    if "hkl" not in reflections.columns:
        return lines.select(*keys, "line", (F.col("d0") * F.col("_iso") * F.col("_warm")).alias("d"), "weight")
    h, k, l = (F.col(f"hkl.{x}").cast("double") for x in "hkl")  # noqa: E741
    pressed, ambient = ({m: F.col(f"{c}.m{m}") for m in ("11", "22", "33", "12", "13", "23")} for c in ("_pressed", "_cell"))
    ratio = d_of(h, k, l, pressed) / d_of(h, k, l, ambient)
    scale = F.when(F.col("_axial"), F.coalesce(ratio, F.col("_iso"))).otherwise(F.col("_iso"))
    return lines.select(*keys, "line", (F.col("d0") * scale * F.col("_warm")).alias("d"), "weight")
