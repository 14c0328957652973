"""Exports: pose logs, paged and labelled maps, point cloud files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The colour of each label from 1, three channels in the order in which colours are held (see pcd_lines);
#: labels beyond go round again, a label of 0 or less is white.
PALETTE = [
    (128, 128, 128), (180, 120, 120), (6, 230, 230), (80, 50, 50), (4, 200, 3),
    (120, 120, 80), (140, 140, 140), (204, 5, 255), (230, 230, 230), (4, 250, 7),
    (224, 5, 255), (235, 255, 7), (150, 5, 61), (120, 120, 70), (8, 255, 51),
    (255, 6, 82), (143, 255, 140), (204, 255, 4), (255, 51, 7), (204, 70, 3),
    (0, 102, 200), (61, 230, 250), (255, 6, 51), (11, 102, 255), (255, 7, 71),
    (255, 9, 224), (9, 7, 230), (220, 220, 220), (255, 9, 92), (112, 9, 255),
    (8, 255, 214), (7, 255, 224), (255, 184, 6), (10, 255, 71), (255, 41, 10),
    (7, 255, 255), (224, 255, 8), (102, 8, 255), (255, 61, 6), (255, 194, 7),
    (255, 122, 8), (0, 255, 20), (255, 8, 41), (255, 5, 153), (6, 51, 255),
    (235, 12, 255), (160, 150, 20), (0, 163, 255), (140, 140, 140), (250, 10, 15),
    (20, 255, 0), (31, 255, 0), (255, 31, 0), (255, 224, 0), (153, 255, 0),
    (0, 0, 255), (255, 71, 0), (0, 235, 255), (0, 173, 255), (31, 0, 255),
    (11, 200, 200), (255, 82, 0), (0, 255, 245), (0, 61, 255), (0, 255, 112),
    (0, 255, 133), (255, 0, 0), (255, 163, 0), (255, 102, 0), (194, 255, 0),
    (0, 143, 255), (51, 255, 0), (0, 82, 255), (0, 255, 41), (0, 255, 173),
    (10, 0, 255), (173, 255, 0), (0, 255, 153), (255, 92, 0), (255, 0, 255),
    (255, 0, 245), (255, 0, 102), (255, 173, 0), (255, 0, 20), (255, 184, 184),
    (0, 31, 255), (0, 255, 61), (0, 71, 255), (255, 0, 204), (0, 255, 194),
    (0, 255, 82), (0, 10, 255), (0, 112, 255), (51, 0, 255), (0, 194, 255),
    (0, 122, 255), (0, 255, 163), (255, 153, 0), (0, 255, 10), (255, 112, 0),
    (143, 255, 0), (82, 0, 255), (163, 255, 0), (255, 235, 0), (8, 184, 170),
    (133, 0, 255), (0, 255, 92), (184, 0, 255), (255, 0, 31), (0, 184, 255),
    (0, 214, 255), (255, 0, 112), (92, 255, 0), (0, 224, 255), (112, 224, 255),
    (70, 184, 160), (163, 0, 255), (153, 0, 255), (71, 255, 0), (255, 0, 163),
    (255, 204, 0), (255, 0, 143), (0, 255, 235), (133, 255, 0), (255, 0, 235),
    (245, 0, 255), (255, 0, 122), (255, 245, 0), (10, 190, 212), (214, 255, 0),
    (0, 204, 255), (20, 0, 255), (255, 255, 0), (0, 153, 255), (0, 41, 255),
    (0, 255, 204), (41, 0, 255), (41, 255, 0), (173, 0, 255), (0, 245, 255),
    (71, 0, 255), (122, 0, 255), (0, 255, 184), (0, 92, 255), (184, 255, 0),
    (0, 133, 255), (255, 214, 0), (25, 194, 194), (102, 255, 0), (92, 0, 255),
]
WHITE = (255, 255, 255)
PALETTE_SIZE = len(PALETTE)
CHANNELS = ("first", "second", "third")


def fixed_line(columns: list[str]) -> Column:
    """Numbers with six decimals, separated by spaces."""
    return F.format_string(" ".join(["%.6f"] * len(columns)), *columns)


def write_log(df: DataFrame, columns: list[str], path: str, mode: str = "append") -> None:
    """A pose, velocity or bias log as text, one line a row."""
    df.select(fixed_line(columns).alias("value")).write.mode(mode).text(path)


def with_pages(df: DataFrame, by: list[str], order: list[str], page: int = 1000) -> DataFrame:
    """Row numbers cut in pages."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("page", F.floor(place / page).cast("int"))


def with_grown_pages(df: DataFrame, by: list[str], order: list[str], page: int = 1000, most: int = 45, growth: float = 1.5) -> DataFrame:
    """with_pages(), of pages that grow by `growth` until a group has fewer than `most` of them."""
    n = F.count("*").over(Window.partitionBy(*by))
    steps = F.greatest(F.lit(0), F.floor(F.log(n / (page * (most - 1))) / F.log(F.lit(growth)) - 1e-9) + 1)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    size = F.floor(F.lit(float(page)) * F.pow(F.lit(growth), steps))
    return df.withColumn("page", F.floor(place / size).cast("int"))


def dump_sweeps(df: DataFrame, frame: str, path: str) -> None:
    """Every sweep's points in a folder of its own."""
    df.write.mode("overwrite").partitionBy(frame).parquet(path)


def path_poses(poses: DataFrame, by: str, order: str, each: int = 10) -> DataFrame:
    """Every `each`-th pose of a trajectory: what a path shows."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return poses.withColumn("place", place).filter(F.col("place") % each == 0)


def palette(spark: SparkSession) -> DataFrame:
    """(slot, first, second, third) for slots from 0."""
    return spark.createDataFrame([(k, *c) for k, c in enumerate(PALETTE)], "slot int, first int, second int, third int")


def coloured(df: DataFrame, label: str = "label") -> DataFrame:
    """df with its label's colour; the palette has PALETTE_SIZE rows, so it is broadcast."""
    slot = F.when(F.col(label) > 0, F.pmod(F.col(label) - 1, F.lit(PALETTE_SIZE)).cast("int"))
    out = df.withColumn("slot", slot).join(F.broadcast(palette(df.sparkSession)), "slot", "left").drop("slot")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip(CHANNELS, WHITE, strict=True)})


def write_map(df: DataFrame, path: str, min_views: int = 1, labelled: bool = False) -> None:
    """Map points seen `min_views` times, labelled ones alone if asked for, as Parquet."""
    kept = df.filter(F.col("n_rgb") >= min_views)
    (kept.filter("n_semantic > 0") if labelled else kept).write.mode("overwrite").parquet(path)


def pcd_lines_column() -> Column:
    """A line of an ASCII point cloud body: x y z and the colour packed in one number. Colours are held blue first."""
    packed = F.shiftleft(F.col("r").cast("int"), 16) + F.shiftleft(F.col("g").cast("int"), 8) + F.col("b").cast("int")
    return F.concat_ws(" ", fixed_line(["x", "y", "z"]), packed.cast("string"))


def pcd_lines(df: DataFrame) -> DataFrame:
    """pcd_lines_column() of each point."""
    return df.select(pcd_lines_column().alias("value"))


#: The header of an ASCII point cloud file, with the number of points to be put in.
CLOUD_HEADER = [
    "VERSION 0.7", "FIELDS x y z rgb", "SIZE 4 4 4 4", "TYPE F F F U", "COUNT 1 1 1 1",
    "WIDTH %d", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", "POINTS %d", "DATA ascii",
]
CLOUD_WORDS = "VERSION|FIELDS|SIZE|TYPE|COUNT|WIDTH|HEIGHT|VIEWPOINT|POINTS|DATA|#"


def write_clouds(df: DataFrame, path: str, key: list[str], points_a_file: int = 1_000_000) -> None:
    """df (x, y, z, r, g, b) as ASCII point cloud files of about points_a_file points each, every one in a folder of its own.

    Points are dealt by a hash of `key`; a file's header is counted from its points, and one task writes a whole file. An
    empty df gives an empty folder.
    """
    files = max(1, -(-df.count() // points_a_file))
    body = df.withColumn("file", F.pmod(F.xxhash64(*key), F.lit(files)).cast("int"))
    lines = body.select("file", F.lit(len(CLOUD_HEADER)).alias("line"), pcd_lines_column().alias("value"))
    header = F.array(*(F.format_string(h, "n") if "%d" in h else F.lit(h) for h in CLOUD_HEADER))
    heads = body.groupBy("file").agg(F.count("*").alias("n")).select("file", F.posexplode(header).alias("line", "value"))
    whole = heads.unionByName(lines).repartition(files, "file").sortWithinPartitions("file", "line")
    whole.select("file", "value").write.mode("overwrite").partitionBy("file").option("maxRecordsPerFile", 0).text(path)


def read_clouds(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """The points of all ASCII point cloud files under path, of their fields those asked for, as doubles. A file without one
    of these fields, with a row too short, or with other than as many points as its header says fails the job."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.rlike("value", F.lit(f"^({CLOUD_WORDS})")).alias("head"))
    said = lambda word: F.max(F.when(F.col("head") & F.startswith("value", F.lit(word + " ")), F.split("value", " +")))
    heads = raw.groupBy("file").agg(said("FIELDS").alias("names"), said("POINTS")[1].cast("long").alias("n"), F.count_if(~F.col("head") & (F.trim("value") != "")).alias("held"))
    lacks = F.raise_error(F.format_string("%s lacks a field of " + ", ".join(fields), "file")).cast("array<string>")
    miscounted = F.raise_error(F.format_string("%s says %s points and holds %s", "file", "n", "held")).cast("array<string>")
    named = F.when(F.size(F.array_except(F.array(*map(F.lit, fields)), "names")) == 0, F.slice("names", 2, F.size("names"))).otherwise(lacks)
    heads = heads.withColumn("names", F.when(F.col("n") == F.col("held"), named).otherwise(miscounted))
    parts = raw.filter(~F.col("head") & (F.trim("value") != "")).select("file", F.split(F.trim("value"), " +").alias("parts")).join(heads.select("file", "names"), "file")
    return parts.select(*(F.element_at("parts", F.array_position("names", F.lit(f)).cast("int")).cast("double").alias(f) for f in fields))
