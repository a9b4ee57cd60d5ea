"""Column expressions: text cleaning, angles, bounds, keys, map projection. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TRUE_WORDS = ("1", "true", "t", "yes", "y")
FALSE_WORDS = ("0", "false", "f", "no", "n", "")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- text and numbers

def norm_label(c) -> Column:
    return F.upper(F.trim(_col(c)))


def finite_double(c) -> Column:
    """The number in a text cell; NULL for blanks, words, nan and infinities."""
    text = F.trim(_col(c).cast("string"))
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def safe_double(c, default: float = 0.0) -> Column:
    return F.coalesce(finite_double(c), F.lit(float(default)))


def parse_flag(c) -> Column:
    """Truth of a text cell: known words first, then 'is the number positive'."""
    word = F.lower(F.trim(F.coalesce(_col(c).cast("string"), F.lit(""))))
    return (
        F.when(word.isin(*TRUE_WORDS), True)
        .when(word.isin(*FALSE_WORDS), False)
        .otherwise(F.coalesce(finite_double(word) > 0, F.lit(False)))
    )


def str_default(c, default: str = "UNK") -> Column:
    text = F.trim(_col(c).cast("string"))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def positive_weight(c) -> Column:
    value = finite_double(c)
    return F.when(value > 0, value).otherwise(1.0)


def safe_ratio(num, den, default: float | None = 0.0) -> Column:
    num, den = _col(num), _col(den)
    return F.when(den.isNotNull() & (F.abs(den) > 1e-9) & num.isNotNull(), F.try_divide(num, den)).otherwise(F.lit(default))


# ---------------------------------------------------------------- names

def proposal_origin(source, kind, filename) -> Column:
    """``(proposal_source, proposal_type)`` of a row, filled from the type prefix or the file name."""
    src = F.coalesce(F.trim(_col(source)), F.lit(""))
    typ = F.coalesce(F.trim(_col(kind)), F.lit(""))
    bridge, base = F.lit("virtual_bridge"), F.lit("base_topology")
    from_name = _col(filename).contains("_gap")
    return F.struct(
        F.when(src != "", src)
        .when(typ != "", F.when(typ.startswith("virtual_gap"), bridge).otherwise(base))
        .otherwise(F.when(from_name, bridge).otherwise(base)).alias("proposal_source"),
        F.when((src != "") | (typ != ""), typ)
        .otherwise(F.when(from_name, "virtual_gap_legacy_filename").otherwise("base_junction_legacy"))
        .alias("proposal_type"),
    )


def _name_class(key, esp: Column, rest: Column) -> Column:
    key = _col(key)
    return (
        F.when(key.startswith("ESP_"), esp)
        .when(key.startswith("tile_y"), "tile_grid")
        .when(key.startswith("tile_"), "tile_numeric")
        .otherwise(rest)
    )


def group_of_key(key) -> Column:
    return _name_class(key, F.lit("ESP"), F.lit("other"))


def family_of_key(key) -> Column:
    prefix = F.substring_index(_col(key), "__", 1)
    return F.when(_col(key).startswith("hirise_"), prefix).otherwise(_name_class(key, prefix, F.lit("other")))


def input_mode(name, pattern: str = "", mode: str = "auto") -> Column:
    if mode != "auto":
        return F.lit(mode)
    if "skel" in pattern.lower():
        return F.lit("skeleton")
    return F.when(F.lower(_col(name)).contains("_skel"), "skeleton").otherwise("mask")


def tile_key(parent, x0, y0, size) -> Column:
    return F.format_string("hirise_%s__y%05d_x%05d_s%d", _col(parent), _col(y0), _col(x0), _col(size))


# ---------------------------------------------------------------- bounds

def border_flag(x, y, width, height, margin: int = 8) -> Column:
    x, y, width, height = map(_col, (x, y, width, height))
    return (x < margin) | (y < margin) | (x >= width - margin) | (y >= height - margin)


def clip_to(c, size) -> Column:
    return F.greatest(F.lit(0), F.least(F.bround(_col(c).cast("double")).cast("int"), _col(size) - 1))


def out_of_bounds(x, y, width, height) -> Column:
    x, y, width, height = map(_col, (x, y, width, height))
    return (x < 0) | (x >= width) | (y < 0) | (y >= height)


# ---------------------------------------------------------------- angles (degrees)

def angle_diff(a, b) -> Column:
    d = F.pmod(F.abs(_col(a) - _col(b)), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def vector_angle(ax, ay, bx, by) -> Column:
    """Angle between two vectors; 180 when one of them has no length."""
    ax, ay, bx, by = (_col(c).cast("double") for c in (ax, ay, bx, by))
    norm = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / norm))
    return F.when(norm <= 1e-6, 180.0).otherwise(F.degrees(F.acos(cosine)))


def circular_gaps(angles) -> Column:
    """Gaps between sorted directions, the last one wrapping to the first; empty below two directions."""
    s = F.array_sort(F.transform(_col(angles), lambda a: F.pmod(a, F.lit(360.0))))
    following = F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.get(s, F.lit(0)) + 360.0))
    return F.when(F.size(s) >= 2, F.zip_with(following, s, lambda b, a: b - a)).otherwise(
        F.array().cast("array<double>"))


def collinearity(angles) -> Column:
    """Least deviation from 180 over all pairs of directions; 90 below three directions."""
    a = _col(angles)
    pairs = F.flatten(F.transform(a, lambda p, i: F.transform(
        F.slice(a, i + 2, F.size(a)), lambda q: F.abs(angle_diff(p, q) - 180.0))))
    return F.when(F.size(a) >= 3, F.array_min(pairs)).otherwise(F.lit(90.0))


def merge_directions(branches, merge_deg: float = 20.0) -> Column:
    """Fold ``array<struct<angle, length>>``: longest first, skip one within ``merge_deg`` of a kept one; by angle."""
    b = _col(branches)
    numbered = F.transform(b, lambda s, i: F.struct((-s["length"]).alias("n"), i.alias("i"),
                                                    s["angle"].alias("angle"), s["length"].alias("length")))
    ordered = F.transform(F.array_sort(numbered), lambda s: F.struct(s["angle"].alias("angle"), s["length"].alias("length")))
    kept = F.aggregate(
        ordered, F.slice(ordered, 1, 0),
        lambda acc, s: F.when(F.exists(acc, lambda k: angle_diff(k["angle"], s["angle"]) < merge_deg), acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_sort(kept)


def rmse3(gaps: Sequence[Column], target: Sequence[float]) -> Column:
    return F.sqrt(sum(((g - t) * (g - t) for g, t in zip(gaps, target)), start=F.lit(0.0)) / 3.0)


# The gap triplets of an ideal T and of the two ideal Y forms, and the decay in degrees.
T_GAPS = (90.0, 90.0, 180.0)
Y_GAPS = (120.0, 120.0, 120.0)
Y_OPEN_GAPS = (100.0, 130.0, 130.0)
LIKENESS_DECAY = 25.0


def likeness(lo, mid, hi) -> Column:
    """RMSE of a sorted gap triplet to the T and Y forms, and exp(-rmse / 25) of each."""
    gaps = [_col(c) for c in (lo, mid, hi)]
    t = rmse3(gaps, T_GAPS)
    y = F.least(rmse3(gaps, Y_GAPS), rmse3(gaps, Y_OPEN_GAPS))
    return F.struct(t.alias("t_gap_rmse"), y.alias("y_gap_rmse"),
                    F.exp(-t / LIKENESS_DECAY).alias("t_likeness"), F.exp(-y / LIKENESS_DECAY).alias("y_likeness"))


def geometry_label(n, lo, hi) -> Column:
    n, lo, hi = map(_col, (n, lo, hi))
    return (
        F.when((n != 3) | n.isNull() | lo.isNull() | hi.isNull(), "Unknown")
        .when(hi.between(150.0, 210.0) & (lo >= 35.0), "T")
        .when((hi >= 150.0) & (lo < 35.0), "Y_arrowhead")
        .otherwise("Y_balanced")
    )


def three_arm_label(angles, mode: str = "symmetric", t_min_largest: float = 150.0, t_max_side: float = 124.0,
                    margin: float = 6.0, ordered: bool = False) -> Column:
    """T or Y from the three pairwise angles of a node, with the error of the choice and an ambiguity flag."""
    s = _col(angles) if ordered else F.array_sort(_col(angles))
    a0, a1, a2 = (F.get(s, F.lit(i)) for i in range(3))

    def over(v: Column) -> Column:
        return F.greatest(F.lit(0.0), v)

    guard = (a2 >= t_min_largest) & (a1 <= t_max_side) & (a0 <= t_max_side)
    right = F.abs(a0 - 90.0) + F.abs(a1 - 90.0)
    even = F.abs(a0 - 120.0) + F.abs(a1 - 120.0) + F.abs(a2 - 120.0)
    if mode == "robust":
        err_t = (F.abs(a2 - 180.0) + 0.75 * right + 1.30 * over(t_min_largest - a2)
                 + 1.10 * (over(a0 - t_max_side) + over(a1 - t_max_side)) + 0.20 * F.abs(a0 - a1))
        err_y = even + 0.25 * over(a2 - a0) + 0.20 * F.abs(0.5 * (a0 + a1) - 120.0)
    else:
        err_t, err_y = F.abs(a2 - 180.0) + 0.7 * right, even
    is_t = guard if mode == "legacy" else guard & (err_t <= err_y + margin)
    unsure = F.lit(False) if mode == "legacy" else F.abs(err_t - err_y) <= margin
    return F.struct(F.when(is_t, "T").otherwise("Y").alias("label"), F.when(is_t, err_t).otherwise(err_y).alias("err"),
                    err_t.alias("err_t"), err_y.alias("err_y"), guard.alias("t_guard"), unsure.alias("ambiguous"))


def safe_cv(values: Column) -> Column:
    """Spread of an array over its mean; NULL without values or if the mean is not positive."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda t, v: t + v) / n
    spread = F.sqrt(F.aggregate(values, F.lit(0.0), lambda t, v: t + (v - mean) * (v - mean)) / n)
    return F.when((n > 0) & (mean > 0), spread / mean)


#: What the arms of a three-arm node look like, beside its angle errors.
ARM_FEATURES = ("a0", "a1", "a2", "opp_gap", "area_cv", "span_cv", "area_ratio", "span_ratio", "third_area_frac", "third_span_frac", "opp_balance", "opp_area_ratio", "opp_span_ratio")


def arm_features(arms: Column) -> Column:
    """``struct<ARM_FEATURES>`` of three arms ``(area, span, ux, uy)``; NULL for any other number of arms.

    The two arms that come nearest to a straight line are the opposite ones, the remaining one is the third."""
    def arm(i: int, field: str) -> Column:
        return F.get(arms, F.lit(i))[field].cast("double")

    def pair(i: int, j: int) -> Column:
        angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), arm(i, "ux") * arm(j, "ux") + arm(i, "uy") * arm(j, "uy")))))
        third = 3 - i - j
        return F.struct(angle.alias("angle"), F.lit(-i).alias("i"), F.lit(-j).alias("j"), *[arm(k, f).alias(f"{f}_{n}") for n, k in (("p", i), ("q", j), ("r", third)) for f in ("area", "span")])

    pairs = F.array(pair(0, 1), pair(0, 2), pair(1, 2))
    angles = F.array_sort(F.transform(pairs, lambda p: p["angle"]))
    opp = F.array_max(pairs)
    areas = F.transform(arms, lambda a: a["area"].cast("double"))
    spans = F.transform(arms, lambda a: a["span"].cast("double"))
    both = {f: opp[f"{f}_p"] + opp[f"{f}_q"] for f in ("area", "span")}
    values = {
        **{f"a{i}": F.get(angles, F.lit(i)) for i in range(3)}, "opp_gap": 180.0 - opp["angle"], "area_cv": safe_cv(areas), "span_cv": safe_cv(spans),
        "area_ratio": safe_ratio(F.array_max(areas), F.array_min(areas), None), "span_ratio": safe_ratio(F.array_max(spans), F.array_min(spans), None),
        "third_area_frac": safe_ratio(opp["area_r"], both["area"] + opp["area_r"], None), "third_span_frac": safe_ratio(opp["span_r"], both["span"] + opp["span_r"], None),
        "opp_balance": safe_ratio(F.abs(opp["area_p"] - opp["area_q"]), both["area"], None), "opp_area_ratio": safe_ratio(both["area"], opp["area_r"], None),
        "opp_span_ratio": safe_ratio(both["span"], opp["span_r"], None)}
    return F.when(F.size(arms) == 3, F.struct(*[values[n].alias(n) for n in ARM_FEATURES]))


# ---------------------------------------------------------------- scores

def proposal_score(gap_len, alignment_deg, contacts) -> Column:
    gap_len, alignment_deg, contacts = map(_col, (gap_len, alignment_deg, contacts))
    aligned = F.greatest(F.lit(0.0), F.cos(F.radians(alignment_deg.cast("double"))))
    return F.lit(2.5) / (gap_len + 1.0) + aligned * 2.0 + F.lit(1.5) / (contacts + 1.0) + 1.0


def pair_continuity(angle_i, r2_i, len_i, angle_j, r2_j, len_j) -> Column:
    """How much two branches look like one through-going line, 0 to 1."""
    deviation = F.abs(angle_diff(angle_i, angle_j) - 180.0)
    straight = F.greatest(F.lit(0.0), F.lit(1.0) - deviation / 90.0)
    long_enough = F.least(F.lit(1.0), F.least(_col(len_i), _col(len_j)) / 20.0)
    return straight * F.least(_col(r2_i), _col(r2_j)) * long_enough


def center_weight(x, y, size: int = 192, sigma: float = 40.0) -> Column:
    dx, dy = _col(x) - size // 2, _col(y) - size // 2
    return F.exp(-(dx * dx + dy * dy) / (2.0 * sigma * sigma))


# ---------------------------------------------------------------- map coordinates

DEFAULT_RADIUS = 3376200.0   # fixed value: sphere radius in metres when the text names none


def projected_to_latlon(easting, northing, wkt) -> Column:
    """``(lat, lon)`` in degrees from polar stereographic or equirectangular map coordinates."""
    e, n, w = _col(easting).cast("double"), _col(northing).cast("double"), _col(wkt)

    def number(pattern: str, default: Column) -> Column:
        return F.coalesce(F.regexp_extract(w, pattern, 1).try_cast("double"), default)

    radius = number(r'SPHEROID\["[^"]*",(\d+\.?\d*)', F.lit(DEFAULT_RADIUS))
    parallel = number(r"(?i)latitude_of_origin[^,]*,\s*([-\d.]+)",
                      number(r"(?i)standard_parallel_1[^,]*,\s*([-\d.]+)", F.lit(0.0)))
    meridian = number(r"(?i)central_meridian[^,]*,\s*([-\d.]+)", F.lit(0.0))
    rho = F.sqrt(e * e + n * n)
    polar = F.struct(
        F.when(rho == 0, 90.0).otherwise(90.0 - 2.0 * F.degrees(F.atan(rho / (2.0 * radius)))).alias("lat"),
        F.when(rho == 0, 0.0).otherwise(F.degrees(F.atan2(e, -n))).alias("lon"),
    )
    flat = F.struct(
        F.degrees(n / radius).alias("lat"),
        (meridian + F.degrees(e / (radius * F.cos(F.radians(parallel))))).alias("lon"),
    )
    return (
        F.when(w.contains("Polar_Stereographic"), polar)
        .when(w.contains("Equirectangular") | w.contains("Equidistant_Cylindrical"), flat)
        .otherwise(F.raise_error(F.concat(F.lit("unsupported projection: "), F.substring(w, 1, 200))))
    )


def tile_center(x0, y0, size: int, affine: Sequence[float]) -> Column:
    """Map position of a tile's centre pixel under ``affine`` = (a, b, c, d, e, f)."""
    a, b, c, d, e, f = (float(v) for v in affine)
    col = _col(x0) + size // 2 + 0.5
    row = _col(y0) + size // 2 + 0.5
    return F.struct((col * a + row * b + c).alias("easting"), (col * d + row * e + f).alias("northing"))
