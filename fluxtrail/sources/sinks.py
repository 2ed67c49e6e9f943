"""Writers of tracks, statistics, object logs and hierarchies; each is one distributed write to a folder."""

from __future__ import annotations

import uuid
import xml.etree.ElementTree as ET

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HIERARCHY = "_context STRING, _kind STRING, _id LONG, _parent LONG, _level INT, _n LONG, _p DOUBLE, _means STRING, _sigmas STRING"


def tracks_xml(tracks: DataFrame, path: str, last_frame: int | None = None) -> None:
    """One element a frame with its targets, of tracks(frame, object_id, cx, cy, width, height); box corners are cut to integers."""
    rows = tracks.withColumn("start", F.min("frame").over(W.partitionBy("object_id")))
    if last_frame is not None:
        rows = rows.filter(F.col("frame") <= last_frame)
    side = lambda c, n, sign: (F.col(c) + sign * F.col(n) / 2).cast("int")
    target = F.struct(
        F.col("object_id").alias("_target_id"), F.col("start").alias("_start_frame_track"),
        side("cx", "width", -1).alias("_xmin"), side("cx", "width", 1).alias("_xmax"), side("cy", "height", -1).alias("_ymin"), side("cy", "height", 1).alias("_ymax"),
        F.col("cx").alias("_x_center"), F.col("cy").alias("_y_center"),
    )
    shaped = rows.groupBy(F.col("frame").alias("_frame_id")).agg(F.array_sort(F.collect_list(target)).alias("tracked_target"))
    shaped.write.format("xml").option("rootTag", "tracks").option("rowTag", "frame").save(path)


def planar_text(statistics: DataFrame, path: str, every: int = 1) -> None:
    """Tab-separated statistics of each ``every``-th frame with a header; numbers have four digits."""
    number = lambda f: F.format_string("%.4f", F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
    statistics.filter(F.col("frame") % every == 0).select(*map(number, statistics.schema)).write.option("sep", "\t").option("header", "true").csv(path)


def object_log(samples: DataFrame, path: str) -> None:
    """One folder of lines per object, in order of its frames; rows of an object go by frame range to several tasks if it is long."""
    rows = samples.repartitionByRange("object_id", "frame").sortWithinPartitions("object_id", "frame")
    rows.write.partitionBy("object_id").option("header", "true").csv(path)


def hierarchy_xml(concepts: DataFrame, path: str) -> None:
    """The learned states and events, one element each."""
    concepts.select(*(F.col(c).alias(f"_{c}") for c in concepts.columns)).write.format("xml").option("rootTag", "hierarchy").option("rowTag", "concept").save(path)


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """What ``hierarchy_xml`` wrote."""
    rows = spark.read.format("xml").option("rowTag", "concept").schema(HIERARCHY).load(path)
    return rows.select(*(F.col(c).alias(c[1:]) for c in rows.columns))


def ellipses(concepts: DataFrame) -> DataFrame:
    """context, id, cx, cy, rx, ry: one ellipse for each state with two or more numbers, to be plotted."""
    number = lambda c, k: F.split(c, ",")[k].cast("double")
    states = concepts.filter((F.col("kind") == "state") & (F.size(F.split("means", ",")) >= 2))
    return states.select("context", "id", number("means", 0).alias("cx"), number("means", 1).alias("cy"), number("sigmas", 0).alias("rx"), number("sigmas", 1).alias("ry"))


def gnuplot(concepts: DataFrame) -> DataFrame:
    """value: the lines of a plot script, an ellipse of one deviation a state."""
    line = "format_string('set object %d ellipse center %.3f,%.3f size %.3f,%.3f', id, cx, cy, 2*rx, 2*ry)"
    return ellipses(concepts).selectExpr(f"{line} AS value")


def images(pixels: DataFrame, path: str) -> None:
    """A binary pixel map for each frame of pixels(frame, time_ms, x, y, r, g, b) in the folder ``path``, a URI of a file system
    that all tasks reach; its name has the time of day and the frame's number.

    Pixels that are missing are black; of repeated ones the last in order of colour counts. A frame, which the sensor bounds,
    is one task's rows; a file is written under another name and then moved, so that a task run again leaves whole files.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        frame, ms = int(part["frame"].iloc[0]), int(part["time_ms"].iloc[0])
        part = part.sort_values(["r", "g", "b"])
        shown = np.zeros((int(part["y"].max()) + 1, int(part["x"].max()) + 1, 3), np.uint8)
        shown[part["y"], part["x"]] = part[["r", "g", "b"]].to_numpy()
        name = f"cam-{ms // 3_600_000:02}.{ms // 60_000 % 60:02}.{ms // 1000 % 60:02}.{ms % 1000:03}-{frame}.ppm"
        system, folder = pafs.FileSystem.from_uri(path)
        system.create_dir(folder)
        partial = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(partial) as out:
            out.write(b"P6\n%d %d\n255\n" % (shown.shape[1], shown.shape[0]) + shown.tobytes())
        system.move(partial, f"{folder}/{name}")
        return pd.DataFrame({"frame": [frame]})

    columns = ["frame", "time_ms", "x", "y", "r", "g", "b"]
    pixels.select(*columns).groupBy("frame").applyInPandas(run, "frame long").write.format("noop").mode("overwrite").save()


def view_name(frame: str = "frame") -> Column:
    """The file name of a rendered view."""
    return F.concat(F.lpad(F.col(frame).cast("string"), 6, "0"), F.lit(".jpg"))


def config_xml(parameters: dict) -> str:
    """A nested parameter tree as XML."""

    def build(parent: ET.Element, tree: dict) -> None:
        for name, value in tree.items():
            if isinstance(value, dict):
                build(ET.SubElement(parent, "group", name=str(name)), value)
            else:
                ET.SubElement(parent, "parameter", name=str(name), value=str(value))

    root = ET.Element("configuration")
    build(root, parameters)
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")


def read_config(text: str) -> dict:
    """What ``config_xml`` wrote; values are text."""

    def parse(node: ET.Element) -> dict:
        return {n.get("name"): parse(n) if n.tag == "group" else n.get("value") for n in node}

    return parse(ET.fromstring(text))
