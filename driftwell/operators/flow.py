"""Motion of features from one picture to another, from coarse to fine levels of a pyramid.

Pictures are held by lines (frame, row, line: array), so a feature's window is one join with window + 1 lines, and sums over
it are sums of arrays before the shuffle. Features are followed in rounds; those that have come to rest leave.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Determinants (of sums over 1024) under this count as none.
LEAST_DETERMINANT = 2.0**-23
#: Two steps whose sum is less than this on both axes go to and fro.
TO_AND_FRO = 0.01


@dataclass(frozen=True)
class Options:
    window: int = 21
    #: Levels above the pictures themselves.
    levels: int = 3
    #: Rounds on a level, and the squared length of a step that ends them.
    steps: int = 10
    least_square: float = 0.05
    #: Of the smaller eigenvalue of a window's mean products of gradients, over 1024.
    least_eigenvalue: float = 1e-4
    #: Whether the values of upper levels are rounded to whole numbers, halves up.
    whole: bool = True


def level_sizes(rows: int, cols: int, o: Options) -> list[tuple[int, int]]:
    """(rows, cols) of each level; a level no larger than the window is left out, as are those above it."""
    if min(rows, cols) <= o.window:
        raise ValueError(f"{rows} by {cols} pixels are too few for a window of {o.window}")
    sizes = [(rows, cols)]
    while len(sizes) <= o.levels:
        r, c = ((n + 1) // 2 for n in sizes[-1])
        if min(r, c) <= o.window:
            break
        sizes.append((r, c))
    return sizes


def _mirrored(place: Column, n: int) -> Column:
    """The pixel that a place up to n - 1 beyond either edge shows: a mirror image, without the edge."""
    return (n - 1) - F.abs((n - 1) - F.abs(place))


def picture_lines(raster: DataFrame, rows: int, cols: int) -> DataFrame:
    """(frame, row, line) of rasters (frame, row, col, value). Null values count as 0; a picture that lacks pixels, or has some
    twice, is an error. Pixels are dealt by frame once, for all that is worked out by frame after it."""
    inside = raster.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).repartition("frame")
    cell = F.struct("col", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    lines = inside.groupBy("frame", "row").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    lines = lines.withColumn("__rows", F.count("*").over(Window.partitionBy("frame")))
    whole = (F.size("cells") == cols) & (F.size(F.array_distinct("cells.col")) == cols) & (F.col("__rows") == rows)
    wrong = F.raise_error(F.concat(F.lit("picture with missing or repeated pixels: "), F.col("frame").cast("string")))
    return lines.select("frame", "row", F.when(whole, F.col("cells.value")).otherwise(wrong).alias("line"))


def _around(lines: DataFrame, *steps: int) -> DataFrame:
    """lines with those so many rows before (b1, ...) and after (a1, ...), null beyond the edges."""
    order = Window.partitionBy("frame").orderBy("row")
    return lines.withColumns({f"{s}{n}": f("line", n).over(order) for n in steps for s, f in (("b", F.lag), ("a", F.lead))})


def reduced(lines: DataFrame, rows: int, cols: int, whole: bool = True) -> DataFrame:
    """The next level: every second pixel of a 1-4-6-4-1 smoothing on both axes, mirrored at the edges."""
    near = _around(lines, 1, 2).filter("row % 2 = 0")
    after = F.when(F.col("row") == rows - 2, F.col("line")).otherwise(F.coalesce("a2", "b2"))
    near = near.select("frame", (F.col("row") / 2).cast("int").alias("row"), "line", F.coalesce("b1", "a1").alias("b1"), F.coalesce("a1", "b1").alias("a1"), F.coalesce("b2", "a2").alias("b2"), after.alias("a2"))
    at = lambda c, i: F.get(F.col(c), i)
    down = near.withColumn("line", F.transform("line", lambda x, i: 6 * x + 4 * (at("b1", i) + at("a1", i)) + at("b2", i) + at("a2", i)))
    places = F.sequence(F.lit(0), F.lit((cols + 1) // 2 - 1))
    total = lambda i: sum((w * at("line", _mirrored(2 * i + d, cols)) for d, w in zip(range(-2, 3), (1, 4, 6, 4, 1), strict=True)), F.lit(0.0))
    value = (lambda i: F.floor((total(i) + 128) / 256).cast("double")) if whole else (lambda i: total(i) / 256)
    return down.select("frame", "row", F.transform(places, value).alias("line"))


def with_slopes(lines: DataFrame, cols: int) -> DataFrame:
    """lines with derivatives dx and dy a pixel (arrays, 3-10-3 smoothing), mirrored at the edges."""
    near = _around(lines, 1).select("frame", "row", "line", F.coalesce("b1", "a1").alias("b1"), F.coalesce("a1", "b1").alias("a1"))
    at = lambda c, i: F.get(F.col(c), i)
    near = near.withColumns({"__s": F.transform("line", lambda x, i: 10 * x + 3 * (at("b1", i) + at("a1", i))), "__d": F.transform("line", lambda x, i: at("a1", i) - at("b1", i))})
    before, after = (lambda i: _mirrored(i - 1, cols)), (lambda i: _mirrored(i + 1, cols))
    dx = F.transform("__s", lambda x, i: (at("__s", after(i)) - at("__s", before(i))) / 32)
    dy = F.transform("__d", lambda x, i: (10 * x + 3 * (at("__d", before(i)) + at("__d", after(i)))) / 32)
    return near.select("frame", "row", "line", dx.alias("dx"), dy.alias("dy"))


def pyramid(raster: DataFrame, rows: int, cols: int, o: Options) -> list[DataFrame]:
    """(frame, row, line, dx, dy) of each level, from the pictures up; each is a written table, worked out once a picture."""
    sizes = level_sizes(rows, cols, o)
    lines = picture_lines(raster, rows, cols)
    out = []
    for k, (r, c) in enumerate(sizes):
        out.append(written(with_slopes(lines, c), "pictures"))
        if k + 1 < len(sizes):
            lines = reduced(out[-1].select("frame", "row", "line"), r, c, o.whole)
    return out


# -- windows --------------------------------------------------------------------------------------------------

KEY = ["frame", "to", "key"]


def _corner(df: DataFrame, u: Column, v: Column, window: int) -> DataFrame:
    """df with the whole and broken parts iu, iv, fu, fv of the window's first pixel around u, v."""
    half = (window - 1) / 2
    df = df.withColumns({"iu": F.floor(u - half).cast("int"), "iv": F.floor(v - half).cast("int")})
    return df.withColumns({"fu": u - half - F.col("iu"), "fv": v - half - F.col("iv")})


def _in_reach(rows: int, cols: int, window: int) -> Column:
    return F.col("iu").between(-window, cols - 1) & F.col("iv").between(-window, rows - 1)


def _across(values: str, window: int, place) -> Column:
    """Window values between the pixels of a line, from its pixel iu on; place says which value a column shows."""
    i0, f = F.col("iu"), F.col("fu")
    at = lambda i: F.coalesce(F.get(F.col(values), place(i0 + i)), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda i: (1 - f) * at(i) + f * at(i + 1))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _mixed(a: str, b: str, f: str) -> Column:
    return F.zip_with(a, b, lambda x, y: (1 - F.col(f)) * x + F.col(f) * y)


def window_rows(features: DataFrame, lines: DataFrame, rows: int, cols: int, window: int) -> DataFrame:
    """(KEY, k, value, gx, gy): each feature's window (at u, v of its picture `frame`) by rows k: values and derivatives between
    the pixels. Beyond the edges values are mirrored and derivatives 0. Features out of reach give none."""
    asked = _corner(features, F.col("u"), F.col("v"), window).filter(_in_reach(rows, cols, window))
    asked = asked.select(*KEY, "iu", "iv", "fu", "fv", F.explode(F.sequence(F.lit(0), F.lit(window))).alias("k"))
    asked = asked.withColumn("__at", F.col("iv") + F.col("k"))
    met = asked.withColumn("row", _mirrored(F.col("__at"), rows)).join(lines, ["frame", "row"])
    own = F.when(F.col("__at").between(0, rows - 1), F.lit(1.0)).otherwise(F.lit(0.0))
    slope = lambda c: F.transform(_across(c, window, lambda i: i), lambda x: x * own)
    met = met.select(*KEY, "k", "fv", _across("line", window, lambda i: _mirrored(i, cols)).alias("value"), slope("dx").alias("gx"), slope("dy").alias("gy"))
    order = Window.partitionBy(*KEY).orderBy("k")
    met = met.withColumns({f"__{c}": F.lead(c).over(order) for c in ("value", "gx", "gy")}).filter(F.col("k") < window)
    return met.select(*KEY, "k", *(_mixed(c, f"__{c}", "fv").alias(c) for c in ("value", "gx", "gy")))


def window_sums(template: DataFrame) -> DataFrame:
    """(KEY, a, b, c, p0, q0): sums of products of derivatives, and of these with values, over the windows of window_rows()."""
    pairs = {"a": ("gx", "gx"), "b": ("gx", "gy"), "c": ("gy", "gy"), "p0": ("value", "gx"), "q0": ("value", "gy")}
    return template.groupBy(*KEY).agg(*(F.sum(_dot(F.col(x), F.col(y))).alias(n) for n, (x, y) in pairs.items()))


def _shares(template: DataFrame, window: int) -> DataFrame:
    """(KEY, k, and the derivatives of rows k and k - 1), k from 0 to window: what a line between two rows weighs in both."""
    none = F.array_repeat(F.lit(0.0), window)
    last = template.select(*KEY).distinct().withColumns({"k": F.lit(window), "gx": none, "gy": none})
    both = template.select(*KEY, "k", "gx", "gy").unionByName(last)
    order = Window.partitionBy(*KEY).orderBy("k")
    return both.withColumns({f"{c}_before": F.coalesce(F.lag(c).over(order), none) for c in ("gx", "gy")})


def met_sums(active: DataFrame, shares: DataFrame, lines: DataFrame, rows: int, cols: int, window: int) -> DataFrame:
    """(KEY, p, q): sums over each window at nu, nv of picture `to` of values times the template's derivatives. They are linear in
    the lines, so each line adds its part by itself."""
    asked = _corner(active, F.col("nu"), F.col("nv"), window).select(*KEY, "iu", "iv", "fu", "fv")
    asked = asked.join(shares, KEY).withColumn("row", _mirrored(F.col("iv") + F.col("k"), rows))
    met = asked.join(lines.select(F.col("frame").alias("to"), "row", "line"), ["to", "row"])
    met = met.withColumn("value", _across("line", window, lambda i: _mirrored(i, cols)))
    return met.groupBy(*KEY).agg(*(F.sum(_dot(F.col("value"), _mixed(g, f"{g}_before", "fv"))).alias(n) for n, g in (("p", "gx"), ("q", "gy"))))


# -- rounds ---------------------------------------------------------------------------------------------------

STATE = [*KEY, "nu", "nv", "su", "sv", "a", "b", "c", "p0", "q0", "eigenvalue", "status"]


def _stepped(states: DataFrame, first: bool, o: Options) -> DataFrame:
    """States after a step, from those joined with p and q; a feature that no line was found for is lost."""
    moving = F.col("status") == "moving"
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    p, q = F.col("p") - F.col("p0"), F.col("q") - F.col("q0")
    states = states.withColumns({"__u": (F.col("b") * q - F.col("c") * p) / det, "__v": (F.col("b") * p - F.col("a") * q) / det})
    u, v = F.col("__u"), F.col("__v")
    short = u * u + v * v <= o.least_square
    turning = F.lit(False) if first else (F.abs(u + F.col("su")) < TO_AND_FRO) & (F.abs(v + F.col("sv")) < TO_AND_FRO)
    share = F.when(~short & turning, 0.5).otherwise(1.0)
    status = F.when(~moving, F.col("status")).when(u.isNull(), "lost").when(short | turning, "still").otherwise("moving")
    goes = moving & u.isNotNull()
    new = {"nu": F.when(goes, F.col("nu") + share * u).otherwise(F.col("nu")), "nv": F.when(goes, F.col("nv") + share * v).otherwise(F.col("nv")), "su": u, "sv": v, "status": status}
    return states.withColumns(new).select(*STATE)


def _on_level(places: DataFrame, template: DataFrame, last: bool, window: int, o: Options) -> DataFrame:
    """States at the start of a level: `moving` with enough texture, else `lost` on the last level and `still` on others."""
    area = 1024.0 * window * window
    a, b, c = (F.col(x) for x in "abc")
    small = (a + c - F.sqrt((a - c) * (a - c) + 4 * b * b)) / (2 * area)
    out = places.join(window_sums(template), KEY, "left").withColumn("eigenvalue", small)
    good = (F.col("eigenvalue") >= o.least_eigenvalue) & ((a * c - b * b) / (1024.0 * 1024.0) >= LEAST_DETERMINANT)
    status = F.when(F.coalesce(good, F.lit(False)), "moving").otherwise("lost" if last else "still")
    return out.withColumns({"status": status, "su": F.lit(0.0), "sv": F.lit(0.0)}).select(*STATE)


def tracked(features: DataFrame, levels: list[DataFrame], rows: int, cols: int, o: Options | None = None) -> DataFrame:
    """(frame, to, key, u, v, found, eigenvalue): where features (frame, to, key, u, v) of pictures `frame` are in pictures `to`.

    levels: pyramid(). On each level, from the coarsest, a feature starts where the level above left it and takes gradient
    steps until one is short, two go to and fro (then half the last one is taken back), or the steps run out. It is passed
    on as it is by a level on which its window is out of reach or has too little texture, and is not found if that level is
    the last. eigenvalue: that of the last level, null if the window was out of reach there. Features of unknown pictures
    or without a place aren't found and keep their place; (frame, to, key) must be unique. Values are doubles throughout.
    """
    o = o or Options()
    sizes = level_sizes(rows, cols, o)
    top = len(sizes) - 1
    features = features.select(*KEY, F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    places = features.select(*KEY, (F.col("u") / 2**top).alias("nu"), (F.col("v") / 2**top).alias("nv"))
    for level in range(top, -1, -1):
        (r, c), lines = sizes[level], levels[level]
        at = features.withColumns({x: F.col(x) / 2**level for x in "uv"})
        template = written(window_rows(at, lines, r, c, o.window), "windows")
        shares = written(_shares(template, o.window), "shares")
        states = written(_on_level(places, template, level == 0, o.window, o), "tracks")
        for k in range(o.steps):
            seen = _corner(states, F.col("nu"), F.col("nv"), o.window)
            out = (F.col("status") == "moving") & ~F.coalesce(_in_reach(r, c, o.window), F.lit(False))
            seen = seen.withColumn("status", F.when(out, "still" if level else "lost").otherwise(F.col("status"))).select(*STATE)
            moving = seen.filter("status = 'moving'")
            if moving.isEmpty():
                states = seen
                break
            sums = met_sums(moving, shares, lines, r, c, o.window)
            states = written(_stepped(seen.join(sums, KEY, "left"), k == 0, o), "tracks")
        if level:
            places = states.select(*KEY, (F.col("nu") * 2).alias("nu"), (F.col("nv") * 2).alias("nv"))
    return states.select(*KEY, F.col("nu").alias("u"), F.col("nv").alias("v"), (F.col("status") != "lost").alias("found"), "eigenvalue")
