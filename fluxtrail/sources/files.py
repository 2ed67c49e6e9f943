"""Readers of image folders, ground truth, scenes, class models, contexts, hierarchies and supervised tables; live frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values, throughout this module: the element and attribute names of the layouts that are read.
# The image types read, and the shifts of ground-truth boxes.
IMAGES = "*.{jpg,jpeg,ppm,gif,bmp}"
SEGMENTATION_SHIFT, TRACKING_SHIFT = (-4, -4), (-4, -2)
OBJECT = "_IDobject INT, _Nameobject STRING, _beginX INT, _beginY INT, _endX INT, _endY INT"
POINT = "_x DOUBLE, _y DOUBLE, _z DOUBLE"
TIMED_NAME = r"-(\d+)\.(\d+)\.(\d+)\.(\d+)-(\d+)\.[A-Za-z]+$"


def frame_columns(path: Column) -> list[Column]:
    """frame_id: the last number of the file name; time_ms: the time of day of names that carry one, else null."""
    file = F.regexp_extract(path, r"([^/]+)$", 1)
    part = lambda k: F.nullif(F.regexp_extract(file, TIMED_NAME, k), F.lit("")).cast("long")
    time = ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)
    return [file.alias("file"), F.nullif(F.regexp_extract(file, r"(\d+)\.[A-Za-z]+$", 1), F.lit("")).cast("long").alias("frame_id"), time.alias("time_ms")]


def frames(spark: SparkSession, folder: str, start: int = 0, nested: bool = False) -> DataFrame:
    """file, frame_id, time_ms, header, bytes of the images of a folder from frame ``start`` on; unreadable files are passed over.

    Files without a number in their name are numbered null and stay.
    """
    read = spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).option("recursiveFileLookup", str(nested).lower()).option("ignoreCorruptFiles", "true")
    return shaped(read.load(folder), start)


def camera(spark: SparkSession, folder: str, start: int = 0, buffer: int = 16, newest_first: bool = False) -> DataFrame:
    """Live frames: a stream of the images that arrive in a folder, ``buffer`` at most a batch, the newest first if so told."""
    read = spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY")
    read = read.option("pathGlobFilter", IMAGES).option("maxFilesPerTrigger", buffer).option("latestFirst", str(newest_first).lower())
    return shaped(read.load(folder), start)


def shaped(found: DataFrame, start: int) -> DataFrame:
    out = found.select(*frame_columns(F.col("path")), header(F.col("content")).alias("header"), F.col("content").alias("bytes"))
    return out.filter(F.col("frame_id").isNull() | (F.col("frame_id") >= start))


def header(content: Column) -> Column:
    """ts, frame, camera of the fixed-width header after the bytes FF E0 and their length, null where there is none."""
    text = F.decode(content, "ISO-8859-1")
    found = F.regexp_extract(text, r"(?s)^.{0,64}?ÿà.{0,16}?(\d{17})(\d{6})([A-Za-z0-9]{3})", 0)
    body = F.substring(found, F.length(found) - 25, F.lit(26))
    stamp = F.try_to_timestamp(F.concat(F.substring(body, 1, 14), F.lit("."), F.substring(body, 15, 3)), F.lit("yyyyMMddHHmmss.SSS"))
    return F.when(found != "", F.struct(stamp.alias("ts"), F.substring(body, 18, 6).cast("int").alias("frame"), F.substring(body, 24, 3).alias("camera")))


def ground_truth(spark: SparkSession, path: str, shift: tuple[int, int] = SEGMENTATION_SHIFT) -> DataFrame:
    """frame_id, object_id, type, xleft, ytop, width, height of the objects of each image; reversed corners are swapped."""
    rows = spark.read.format("xml").option("rowTag", "Image").schema(f"_IDimage INT, Object ARRAY<STRUCT<{OBJECT}>>").load(path)
    o = rows.select(F.col("_IDimage").alias("frame_id"), F.explode("Object").alias("o")).select("frame_id", "o.*")
    kind = F.when(F.upper("_Nameobject").isin("PERSON", "VEHICLE"), F.upper("_Nameobject")).otherwise("UNKNOWN")
    side = lambda a, b, d: (F.least(a, b) + d, F.abs(F.col(a) - F.col(b)) + 1)
    (x, w), (y, h) = side("_beginX", "_endX", shift[0]), side("_beginY", "_endY", shift[1])
    return o.select("frame_id", F.col("_IDobject").alias("object_id"), kind.alias("type"), x.alias("xleft"), y.alias("ytop"), w.alias("width"), h.alias("height"))


def elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of one tag; attributes are columns that begin with an underscore."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def corners(points: str, space: str) -> Column:
    """Points of an outline as structs x, y, z; missing numbers are 0."""
    x, y = ("_x", "_y") if space == "world" else ("_X", "_Y")
    z = (lambda p: F.coalesce(p["_z"], F.lit(0.0))) if space == "world" else lambda p: F.lit(0.0)
    return F.transform(points, lambda p: F.struct(F.coalesce(p[x], F.lit(0.0)).alias("x"), F.coalesce(p[y], F.lit(0.0)).alias("y"), z(p).alias("z")))


def scene(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """matrices, zones, context_objects and walls of a scene file.

    matrices(name, m): twelve numbers of the perspective, nine of the homography. zones(id, name, space, shape, outline,
    cx, cy, rx, ry): polygons of the world, and polygons and ellipses of the image and the homography plane. A missing id
    is -1, a missing name None, a missing height 10.
    """
    named = [F.coalesce("_id", F.lit(-1)).alias("id"), F.coalesce("_name", F.lit("None")).alias("name")]
    matrices = None
    for name, letter, rows in (("perspective", "m", 3), ("homography", "h", 3)):
        cells = [f"_{letter}{i}{j}" for i in range(rows) for j in range(4 if letter == "m" else 3)]
        found = elements(spark, path, f"{name}_matrix", ", ".join(f"{c} DOUBLE" for c in cells))
        found = found.select(F.lit(name).alias("name"), F.array(*cells).alias("m"))
        matrices = found if matrices is None else matrices.union(found)
    flat = "_id INT, _name STRING, _type STRING, OutlineList STRUCT<Point ARRAY<STRUCT<_X DOUBLE, _Y DOUBLE>>>, Center STRUCT<_X DOUBLE, _Y DOUBLE>, Radius STRUCT<_RX DOUBLE, _RY DOUBLE>"
    solid = f"_id INT, _name STRING, _height DOUBLE, OutlineList STRUCT<Point ARRAY<STRUCT<{POINT}>>>"
    none = [F.lit(None).cast("double").alias(c) for c in ("cx", "cy", "rx", "ry")]
    zones = elements(spark, path, "Zone", solid).select(*named, F.lit("world").alias("space"), F.lit("Polygon").alias("shape"), corners("OutlineList.Point", "world").alias("outline"), *none)
    for tag, space in (("Zone2D", "image"), ("ZoneHomography", "homography")):
        round_ = F.col("Center._X").alias("cx"), F.col("Center._Y").alias("cy"), F.col("Radius._RX").alias("rx"), F.col("Radius._RY").alias("ry")
        shape = F.when(F.col("_type") == "Ellipse", "Ellipse").otherwise("Polygon").alias("shape")
        zones = zones.union(elements(spark, path, tag, flat).select(*named, F.lit(space).alias("space"), shape, corners("OutlineList.Point", space).alias("outline"), *round_))
    objects = elements(spark, path, "ContextObject", solid)
    end = f"STRUCT<{POINT}>"
    walls = elements(spark, path, "Wall", f"_id INT, _ident INT, _name STRING, _height DOUBLE, StartPoint {end}, EndPoint {end}")
    point = lambda c: F.struct(*(F.col(f"{c}._{k}").alias(k) for k in "xyz"))
    return {
        "matrices": matrices,
        "zones": zones,
        "context_objects": objects.select(*named, F.coalesce("_height", F.lit(10.0)).alias("height"), corners("OutlineList.Point", "world").alias("outline")),
        "walls": walls.select(F.coalesce("_id", "_ident", F.lit(-1)).alias("id"), F.coalesce("_name", F.lit("None")).alias("name"), F.col("_height").alias("height"), point("StartPoint").alias("start"), point("EndPoint").alias("end")),
    }


def class_models(spark: SparkSession, path: str) -> DataFrame:
    """class, kind, posture, criterion, mean, sigma, lo, hi of the classes and their postures; a velocity without moments
    has half and twice its maximum."""
    value = "STRUCT<_value DOUBLE>"
    moments = f"STRUCT<mean {value}, sigma {value}, min {value}, max {value}>"
    names = ("width", "height", "depth", "velocity")
    own = ", ".join(f"{n} {moments}" for n in names)
    inner = ", ".join(f"{n}: {moments}" for n in names)
    rows = elements(spark, path, "ObjectModel", f"_name STRING, _type STRING, {own}, PostureList STRUCT<Posture ARRAY<STRUCT<_name: STRING, {inner}>>>")
    whole = F.struct(F.lit(None).cast("string").alias("_name"), *names)
    rows = rows.select(F.col("_name").alias("class"), F.col("_type").alias("kind"), F.explode(F.concat(F.array(whole), F.coalesce("PostureList.Posture", F.array().cast(f"array<struct<_name: string, {inner}>>")))).alias("p"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("criterion"), F.col(f"p.{n}").alias("c")) for n in names))).alias("c")
    rows = rows.select("class", "kind", F.col("p._name").alias("posture"), each).filter("c.c is not null")
    of = lambda k: F.col(f"c.c.{k}._value")
    speed = F.col("c.criterion") == "velocity"
    mean, sigma = F.coalesce(of("mean"), F.when(speed, of("max") / 2)).alias("mean"), F.coalesce(of("sigma"), F.when(speed, 2 * of("max"))).alias("sigma")
    return rows.select("class", "kind", "posture", "c.criterion", mean, sigma, of("min").alias("lo"), of("max").alias("hi"))


def contexts(spark: SparkSession, path: str) -> DataFrame:
    """context, init_file, involved, numeric(name, acuity), symbolic; an acuity at or below 0 or missing is 1."""
    name = "STRUCT<_name: STRING>"
    rows = elements(
        spark, path, "Learning_Context",
        f"_name STRING, _init_file STRING, Involved_Object_List STRUCT<Involved_Object: ARRAY<{name}>>, "
        f"Numerical_Attribute_List STRUCT<Numerical_Attribute: ARRAY<STRUCT<_name: STRING, _acuity: DOUBLE>>>, Symbolic_Attribute_List STRUCT<Symbolic_Attribute: ARRAY<{name}>>",
    )
    names = lambda c: F.coalesce(F.transform(c, lambda n: n["_name"]), F.array().cast("array<string>"))
    acuity = F.transform("Numerical_Attribute_List.Numerical_Attribute", lambda n: F.struct(n["_name"].alias("name"), F.when(n["_acuity"] > 0, n["_acuity"]).otherwise(1.0).alias("acuity")))
    return rows.select(
        F.col("_name").alias("context"), F.col("_init_file").alias("init_file"), names("Involved_Object_List.Involved_Object").alias("involved"),
        F.coalesce(acuity, F.array().cast("array<struct<name:string,acuity:double>>")).alias("numeric"), names("Symbolic_Attribute_List.Symbolic_Attribute").alias("symbolic"),
    )


def multimodel(spark: SparkSession, path: str) -> DataFrame:
    """name, model, buffer, dependences of the models of a file, each with the models it needs."""
    rows = elements(spark, path, "Model", "_name STRING, _model STRING, _buffer INT, Dependences STRUCT<Dependence: ARRAY<STRUCT<_name: STRING>>>")
    needs = F.coalesce(F.transform("Dependences.Dependence", lambda d: d["_name"]), F.array().cast("array<string>"))
    return rows.select(F.col("_name").alias("name"), F.col("_model").alias("model"), F.col("_buffer").alias("buffer"), needs.alias("dependences"))


def supervised(spark: SparkSession, path: str) -> DataFrame:
    """image, mean, sd, median, reliability of a white-space table; ``#`` begins a remark; lines without five cells are passed over."""
    cells = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).filter(~F.trim("value").startswith("#")).select(cells.alias("c")).filter(F.size("c") == 5)
    names = ("image", "mean", "sd", "median", "reliability")
    return rows.select(*(F.expr(f"try_cast(c[{i}] AS {'int' if i == 0 else 'double'})").alias(n) for i, n in enumerate(names)))
