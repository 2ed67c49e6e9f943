"""Queries of sources, sinks, plug-ins and configuration: each writes what it reads, and its SQL says what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxtrail.plans import pipeline, session
from fluxtrail.sources import files, relations, sinks

DAG = """<MULTI_MODEL><Model name="Base" model="Blob" buffer="5"><Dependences></Dependences></Model><Model name="Shape" model="Size" buffer="3"><Dependences><Dependence name="Base"/></Dependences></Model>
<Model name="Lost" model="Size" buffer="3"><Dependences><Dependence name="Nowhere"/></Dependences></Model></MULTI_MODEL>"""
#: States made of the boxes of a kind, under one root.
STATES = "SELECT 'kinds' AS context, 'state' AS kind, cast(length(obj_type) AS bigint) AS id, cast(0 AS bigint) AS parent, 1 AS level, count(*) AS n, round(cast(count(*) AS double)/(SELECT count(*) FROM boxes), 6) AS p, concat(cast(min(xleft) AS varchar(9)), ',', cast(min(ytop) AS varchar(9))) AS means, concat(cast(max(width) AS varchar(9)), ',', cast(max(height) AS varchar(9))) AS sigmas FROM boxes GROUP BY length(obj_type)"
#: Frames of pixels as images with the time of day in their names, a frame a second from 10:20 on.
FRAMES = "SELECT frame, 37200040 + frame*1000 AS time_ms, x, y, r, g, b FROM px"
#: The region, the way and the sizes of each object and kind, from which scenes, class models and contexts are written.
REGIONS = "SELECT object_id AS id, min(xleft) AS x0, min(ytop) AS y0, max(xright) AS x1, max(ybottom) AS y1, max(height) AS tall FROM boxes GROUP BY object_id"
KINDS = "SELECT obj_type AS kind, count(*) AS n, round(avg(width), 4) AS mw, round(stddev_pop(width), 4) AS sw, min(width) AS lw, max(width) AS hw, round(avg(height), 4) AS mh, round(stddev_pop(height), 4) AS sh, min(height) AS lh, max(height) AS hh FROM boxes GROUP BY obj_type"
CONFIG = {"Sequence": {"Threshold": "30", "Inner": {"Rate": "0.5", "Name": "a < b"}}, "Rate": "0.9"}


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    session.prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def put(spark: SparkSession, content: dict[str, bytes], path: str | None = None) -> str:
    """A folder, new if none is named, with these small files."""
    path = path or folder(spark)
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for name, data in content.items():
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        stream = target.getFileSystem(conf).create(target)
        stream.write(bytearray(data))
        stream.close()
    return path


def images(spark: SparkSession, sf_dir: str) -> str:
    path = folder(spark)
    sinks.images(relations.run(spark, sf_dir, FRAMES), path)
    return path


def frames_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of the table's frames from the third on, as read from their folder."""
    return files.frames(spark, images(spark, sf_dir), start=3).select("file", "frame_id", "time_ms", F.length("bytes").alias("length"))


def camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "live_" + uuid.uuid4().hex
    rows = files.camera(spark, images(spark, sf_dir), start=3, buffer=50, newest_first=True).select("file", "frame_id")
    rows.writeStream.format("memory").queryName(name).option("checkpointLocation", folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def written(rows: DataFrame, path: str, root: str, tag: str) -> None:
    rows.write.format("xml").option("rootTag", root).option("rowTag", tag).save(path)


# Fixed values in the next three: the element and attribute names of the layouts that the readers take.
def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object's region as a zone, on the ground and on the screen, its diagonal as a wall and its foot as a context object, written and read."""
    path, rows = folder(spark), relations.run(spark, sf_dir, REGIONS)
    point = lambda x, y, up="": F.struct(F.col(x).cast("double").alias("_X" if up else "_x"), F.col(y).cast("double").alias("_Y" if up else "_y"))
    outline = lambda *p: F.struct(F.array(*p).alias("Point")).alias("OutlineList")
    name, corners = F.concat(F.lit("Room "), "id").alias("_name"), (("x0", "y0"), ("x1", "y0"), ("x1", "y1"))
    written(rows.select(F.col("id").alias("_id"), name, outline(*(point(*c) for c in corners))), f"{path}/zones", "ZoneList", "Zone")
    written(rows.select(name, F.lit("Polygon").alias("_type"), outline(*(point(*c, "up") for c in corners[:2]))), f"{path}/screen", "Zone2DList", "Zone2D")
    written(rows.select(F.col("id").alias("_id"), F.col("tall").cast("double").alias("_height"), point("x0", "y0").alias("StartPoint"), point("x1", "y1").alias("EndPoint")), f"{path}/walls", "WallList", "Wall")
    written(rows.select(F.col("id").alias("_id"), name, outline(point("x0", "y1"))), f"{path}/objects", "ContextObjectsList", "ContextObject")
    found = files.scene(spark, f"{path}/*")
    last = lambda c: F.get("outline", F.size("outline") - 1)[c]
    parts = [
        found["zones"].select(F.concat_ws(" ", F.lit("zone"), "space", "shape").alias("kind"), "id", "name", F.size("outline").alias("n"), last("x").alias("a"), last("y").alias("b")),
        found["context_objects"].select(F.lit("object"), "id", "name", F.size("outline"), "height", last("y")),
        found["walls"].select(F.lit("wall"), "id", "name", F.lit(2), "height", F.col("end.x")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def object_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of the table as classes with their widths and, for a posture, heights, written and read."""
    path, value = folder(spark), lambda c: F.struct(F.col(c).cast("double").alias("_value"))
    moments = lambda d: F.struct(*(value(c + d).alias(n) for c, n in (("m", "mean"), ("s", "sigma"), ("l", "min"), ("h", "max"))))
    posture = F.struct(F.array(F.struct(F.lit("UPRIGHT").alias("_name"), moments("h").alias("height"))).alias("Posture"))
    speed = F.struct(value("lw").alias("min"), value("hw").alias("max"))
    rows = relations.run(spark, sf_dir, KINDS).select(F.col("kind").alias("_name"), F.lit("rigid").alias("_type"), moments("w").alias("width"), speed.alias("velocity"), posture.alias("PostureList"))
    written(rows, path, "ObjectModels", "ObjectModel")
    return files.class_models(spark, path)


def learning_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A learning context for each kind of the table, with its deviations as acuities (below nine: none), written and read."""
    path = folder(spark)
    named = lambda *n: F.array(*(F.struct(x.alias("_name")) for x in n))
    numeric = F.array(*(F.struct(F.lit(n).alias("_name"), F.when(F.col(c) >= 9, F.col(c)).otherwise(-1.0).alias("_acuity")) for n, c in (("W", "sw"), ("H", "sh"))))
    rows = relations.run(spark, sf_dir, KINDS).select(
        F.col("kind").alias("_name"), F.concat("kind", F.lit(".xml")).alias("_init_file"), F.struct(named(F.lit("ANY2D"), F.col("kind")).alias("Involved_Object")).alias("Involved_Object_List"),
        F.struct(numeric.alias("Numerical_Attribute")).alias("Numerical_Attribute_List"), F.struct(named(F.lit("CORNER")).alias("Symbolic_Attribute")).alias("Symbolic_Attribute_List"),
    )
    written(rows, path, "LEARNING_CONTEXT_LIST", "Learning_Context")
    found = files.contexts(spark, path)
    each = F.explode("numeric").alias("a")
    return found.select("context", "init_file", F.array_join("involved", ",").alias("involved"), F.array_join("symbolic", ",").alias("symbolic"), each).select("context", "init_file", "involved", "symbolic", F.col("a.name").alias("attribute"), F.col("a.acuity").alias("acuity"))


def hierarchy(spark: SparkSession, sf_dir: str) -> str:
    path = folder(spark)
    sinks.hierarchy_xml(relations.run(spark, sf_dir, STATES), path)
    return path


def object_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    sinks.object_log(relations.run(spark, sf_dir, "SELECT object_id, frame_id AS frame, det_id, xleft, rd FROM boxes"), path)
    return spark.read.option("header", "true").schema("frame bigint, det_id bigint, xleft bigint, rd double, object_id bigint").csv(path)


def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of each kind of the table as a tree of parameters, written and read; a row a kind goes through the driver."""
    tree = {r["kind"]: {"Boxes": r["n"], "Bounds": {"Width": f"{r['lw']} < {r['hw']}", "Height": f"{r['lh']} < {r['hh']}"}} for r in relations.run(spark, sf_dir, KINDS).collect()}
    path = put(spark, {"config.xml": sinks.config_xml(tree).encode()})
    found = sinks.read_config(spark.read.text(path, wholetext=True).first()[0])

    def leaves(node: dict, above: str = "") -> list[tuple[str, str]]:
        return [x for k, v in node.items() for x in (leaves(v, f"{above}{k}/") if isinstance(v, dict) else [(above + k, v)])]

    return spark.createDataFrame(leaves(found), "name string, value string")


@pipeline.stage("keep large")
def keep_large(df: DataFrame, least: int = 300) -> DataFrame:
    return df.filter(F.col("width") * F.col("height") >= least)


@pipeline.stage("mark border")
def mark_border(df: DataFrame, margin: int = 10) -> DataFrame:
    return df.withColumn("border", (F.col("xleft") < margin) | (F.col("ytop") < margin))


@pipeline.stage("area")
def area(df: DataFrame) -> DataFrame:
    return df.withColumn("area", F.col("width") * F.col("height"))


pipeline.attribute("SIZE", lambda: F.col("width") * F.col("height"), lambda: F.col("rd"))
pipeline.attribute("RIGHT", lambda: F.col("xleft") + F.col("width") - 1, lambda: F.col("rd") / 2)
PLAN = "keep large\n# a remark\nno such stage\nmark border  # flags\n\narea"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.run(spark, sf_dir, "SELECT det_id, xleft, ytop, width, height, rd FROM boxes")


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.Sequence.parse(PLAN).run(boxes(spark, sf_dir)).select("det_id", "border", "area")


def module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.Sequence(["area", "keep large"], {"keep large": {"least": 900}}).run(boxes(spark, sf_dir)).select("det_id", "area")


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = pipeline.Sequence(["mark border", "keep large"])
    plan.run(boxes(spark, sf_dir))
    return plan.taps["mark border"].select("det_id", "border")


def stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.Sequence(["mark border", "area"], {"mark border": {"margin": 100}}, stop="border").run(boxes(spark, sf_dir)).select("det_id", "area")


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    least, rate, name = int(pipeline.parameter(CONFIG, "Threshold")), float(pipeline.parameter(CONFIG, "Rate")), pipeline.parameter(CONFIG, "Missing", "none")
    return boxes(spark, sf_dir).filter((F.col("width") > least) & (F.col("rd") >= rate)).select("det_id", F.lit(name).alias("name"))


def live_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan that follows a stream, fed with the boxes of even and then of odd numbers, while its file of parameters changes between."""
    path, rows = folder(spark), boxes(spark, sf_dir)
    plan = pipeline.Sequence(["area", "keep large"])

    def now() -> dict[str, dict]:
        tree = sinks.read_config(spark.read.text(f"{path}/settings", wholetext=True).first()[0])
        return {stage: {name: int(v) for name, v in own.items()} for stage, own in tree.items()}

    for half, least in enumerate((300, 900)):
        put(spark, {"config.xml": sinks.config_xml({"keep large": {"least": least}}).encode()}, f"{path}/settings")
        rows.filter(F.col("det_id") % 2 == half).write.mode("append").parquet(f"{path}/boxes")
        plan.follow(spark.readStream.schema(rows.schema).parquet(f"{path}/boxes"), now, f"{path}/kept", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/kept").select("det_id", "area")


def models() -> list[pipeline.Model]:
    return [
        pipeline.Model("Shape", lambda: {"shape": F.col("base") / F.greatest(F.col("height"), F.lit(1))}, ("Base",)),
        pipeline.Model("Base", lambda: {"base": F.col("width") * 2}, feedback=lambda: {"fed": F.round(F.col("shape") + F.col("rd"), 6)}),
        pipeline.Model("Lost", lambda: {"lost": F.lit(1)}, ("Nowhere",)),
    ]


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of a file that are active, with what each makes of a box."""
    wanted = {r["name"]: tuple(r["dependences"]) for r in files.multimodel(spark, put(spark, {"models.xml": DAG.encode()})).collect()}  # a row per model of the file
    active = [pipeline.Model(m.name, m.forward, wanted[m.name], m.feedback) for m in models() if m.name in wanted]
    out = pipeline.applied(boxes(spark, sf_dir), active)
    return out.select("det_id", "base", F.round("shape", 6).alias("shape"), F.lit("lost" in out.columns).alias("lost"))


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.applied(boxes(spark, sf_dir), models()).select("det_id", "fed")


def time_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The milliseconds that each stage of a plan took over the table in three runs."""
    timings = pipeline.Timings()
    timings.run(pipeline.Sequence(["keep large", "area"]), boxes(spark, sf_dir), times=3)
    return timings.table(spark)


QUERIES = {
    "src_frames_dir": frames_dir,
    "src_camera": camera,
    "src_scene": scene,
    "src_object_models": object_models,
    "src_learning_contexts": learning_contexts,
    "src_hierarchy_xml": lambda s, d: sinks.read_hierarchy(s, hierarchy(s, d)),
    "snk_hierarchy_xml": lambda s, d: s.read.text(hierarchy(s, d)).filter("value like '%<concept %'").selectExpr("cast(regexp_extract(value, ' id=\"([0-9]+)\"', 1) AS bigint) AS id", "cast(regexp_extract(value, ' n=\"([0-9]+)\"', 1) AS bigint) AS n"),
    "snk_gnuplot": lambda s, d: sinks.gnuplot(relations.run(s, d, STATES)),
    "snk_object_log": object_log,
    "snk_view_images": lambda s, d: relations.run(s, d, "SELECT DISTINCT frame_id - 400000 AS frame FROM boxes").select("frame", sinks.view_name().alias("file")),
    "snk_config_xml": config,
    "snk_time_stats": time_stats,
    "mdl_dag": dag,
    "udf_module": module,
    "udf_model": model,
    "udf_attribute": lambda s, d: pipeline.with_attributes(boxes(s, d), ["SIZE", "NONE", "RIGHT"]).selectExpr("det_id", "SIZE AS size", "round(SIZE_r, 6) AS size_r", "RIGHT AS right_", "round(RIGHT_r, 6) AS right_r"),
    "udf_view": view,
    "cfg_params": parameters,
    "cfg_live": live_parameters,
    "cfg_sequence": sequence,
    "cfg_stop": stopped,
}
NAMED = "concat('cam-', lpad(cast(time_ms DIV 3600000 AS varchar(9)), 2, '0'), '.', lpad(cast(time_ms DIV 60000 % 60 AS varchar(9)), 2, '0'), '.', lpad(cast(time_ms DIV 1000 % 60 AS varchar(9)), 2, '0'), '.040-', cast(frame AS varchar(9)), '.ppm')"
SHOWN = f"f AS (SELECT frame, time_ms, max(x) + 1 AS w, max(y) + 1 AS h FROM ({FRAMES}) p WHERE frame >= 3 GROUP BY frame, time_ms)\n--\n"
SQL = {
    "src_frames_dir": f"{SHOWN}SELECT {NAMED} AS file, frame AS frame_id, time_ms, 9 + length(cast(w AS varchar(9))) + length(cast(h AS varchar(9))) + 3*w*h AS length FROM f",
    "src_camera": f"{SHOWN}SELECT {NAMED} AS file, frame AS frame_id FROM f",
    "src_scene": f"g AS ({REGIONS})\n--\nSELECT 'zone world Polygon' AS kind, id, concat('Room ', cast(id AS varchar(20))) AS name, 3 AS n, 1.0D*x1 AS a, 1.0D*y1 AS b FROM g UNION ALL SELECT 'zone image Polygon', -1, concat('Room ', cast(id AS varchar(20))), 2, x1, y0 FROM g UNION ALL SELECT 'object', id, concat('Room ', cast(id AS varchar(20))), 1, 10, y1 FROM g UNION ALL SELECT 'wall', id, 'None', 2, tall, x1 FROM g",
    "src_object_models": f"g AS ({KINDS})\n--\nSELECT kind AS class, 'rigid' AS kind, NULL AS posture, 'width' AS criterion, mw AS mean, sw AS sigma, 1.0D*lw AS lo, 1.0D*hw AS hi FROM g UNION ALL SELECT kind, 'rigid', NULL, 'velocity', hw/2.0D, 2.0D*hw, lw, hw FROM g UNION ALL SELECT kind, 'rigid', 'UPRIGHT', 'height', mh, sh, lh, hh FROM g",
    "src_learning_contexts": f"g AS ({KINDS})\n--\nSELECT kind AS context, concat(kind, '.xml') AS init_file, concat('ANY2D,', kind) AS involved, 'CORNER' AS symbolic, 'W' AS attribute, CASE WHEN sw >= 9 THEN sw ELSE 1.0D END AS acuity FROM g UNION ALL SELECT kind, concat(kind, '.xml'), concat('ANY2D,', kind), 'CORNER', 'H', CASE WHEN sh >= 9 THEN sh ELSE 1.0D END FROM g",
    "src_hierarchy_xml": STATES,
    "snk_hierarchy_xml": f"SELECT id, n FROM ({STATES}) s",
    "snk_gnuplot": f"SELECT printf('set object %d ellipse center %.3f,%.3f size %.3f,%.3f', id, cast(split_part(means, ',', 1) AS double), cast(split_part(means, ',', 2) AS double), 2*cast(split_part(sigmas, ',', 1) AS double), 2*cast(split_part(sigmas, ',', 2) AS double)) AS value FROM ({STATES}) s",
    "snk_object_log": "SELECT object_id, frame_id AS frame, det_id, xleft, cast(rd AS double) AS rd FROM boxes",
    "snk_view_images": "SELECT DISTINCT frame_id - 400000 AS frame, concat(lpad(cast(frame_id - 400000 AS varchar(9)), 6, '0'), '.jpg') AS file FROM boxes",
    "snk_config_xml": f"g AS ({KINDS})\n--\nSELECT concat(kind, '/Boxes') AS name, cast(n AS varchar(20)) AS value FROM g UNION ALL SELECT concat(kind, '/Bounds/Width'), concat(cast(lw AS varchar(20)), ' < ', cast(hw AS varchar(20))) FROM g UNION ALL SELECT concat(kind, '/Bounds/Height'), concat(cast(lh AS varchar(20)), ' < ', cast(hh AS varchar(20))) FROM g",
    "mdl_dag": "SELECT det_id, 2*width AS base, round(2*width/cast(height AS double), 6) AS shape, false AS lost FROM boxes",
    "udf_module": "SELECT det_id, width*height AS area FROM boxes WHERE width*height >= 900",
    "udf_model": "SELECT det_id, round(2*width/cast(height AS double) + rd, 6) AS fed FROM boxes",
    "udf_attribute": "SELECT det_id, width*height AS size, round(rd, 6) AS size_r, xright AS right_, round(rd/2, 6) AS right_r FROM boxes",
    "udf_view": "SELECT det_id, xleft < 10 OR ytop < 10 AS border FROM boxes",
    "cfg_params": "SELECT det_id, 'none' AS name FROM boxes WHERE width > 30 AND rd >= 0.9D",
    "cfg_live": "SELECT det_id, width*height AS area FROM boxes WHERE width*height >= CASE WHEN det_id % 2 = 0 THEN 300 ELSE 900 END",
    "cfg_sequence": "SELECT det_id, xleft < 10 OR ytop < 10 AS border, width*height AS area FROM boxes WHERE width*height >= 300",
    "cfg_stop": "SELECT det_id, width*height AS area FROM boxes WHERE xleft >= 100 AND ytop >= 100",
}
