"""The engine's main relations over the event table: detections, and small frames of pixels."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DETECTIONS = """SELECT event_id AS det_id, user_id AS object_id, event_type AS obj_type, {micros} AS t_us,
 {micros} DIV 3600000000 AS frame_id, cast(regexp_extract(props,'([0-9]+)',1) AS bigint)*6 AS xleft,
 cast(floor(value) AS bigint) % 480 AS ytop, 8 + event_id % 41 AS width, 8 + (event_id*7) % 53 AS height,
 (1 + event_id % 10)/{ten} AS rd FROM {events}"""
BOXES = """SELECT *, xleft + width - 1 AS xright, ytop + height - 1 AS ybottom, xleft + width/2.0 AS cx, ytop + height/2.0 AS cy FROM detections"""
#: Every 256 events fill one frame of 16 x 16 pixels.
PIXELS = """SELECT det_id DIV 256 AS frame, det_id % 16 AS x, (det_id DIV 16) % 16 AS y, xleft % 256 AS r, ytop % 256 AS g, (width*height) % 256 AS b FROM detections"""
PAIRS = """SELECT p.* FROM (SELECT det_id, object_id, t_us, xleft AS ax, ytop AS ay, width AS aw, height AS ah, xright AS ar, ybottom AS ab, cx AS acx, cy AS acy, rd AS ard,
 lag(xleft) OVER w AS bx, lag(ytop) OVER w AS by_, lag(width) OVER w AS bw, lag(height) OVER w AS bh, lag(xright) OVER w AS br, lag(ybottom) OVER w AS bb,
 lag(cx) OVER w AS bcx, lag(cy) OVER w AS bcy, lag(rd) OVER w AS brd, lag(t_us) OVER w AS bt_us FROM boxes WINDOW w AS (PARTITION BY object_id ORDER BY t_us, det_id)) p WHERE bx IS NOT NULL"""
ZONES = """SELECT * FROM (VALUES ('NW',0,0,200,160),('NE',440,0,640,160),('SW',0,320,200,480),('SE',440,320,640,480)) AS z(zone, x0, y0, x1, y1)"""
MODELS = """SELECT * FROM (VALUES ('PERSON',20.0D,12.0D,8.0D,40.0D),('VEHICLE',36.0D,10.0D,20.0D,60.0D)) AS m(class, mean, sigma, lo, hi)"""
CTES = [("detections", DETECTIONS), ("boxes", BOXES), ("px", PIXELS), ("pairs", PAIRS), ("zones", ZONES), ("models", MODELS)]


def text(body: str, events: str, duck: bool) -> str:
    """A statement over the relations; ``body`` may begin with further relations, each after a comma."""
    fill = {"events": events, "micros": "epoch_us(ts)" if duck else "unix_micros(cast(ts AS timestamp))", "ten": "10.0::double" if duck else "10.0D"}
    needed, seen = set(), [body]
    for name, sql in reversed(CTES):
        if any(name in s for s in seen):
            needed.add(name)
            seen.append(sql)
    ctes = [f"{n} AS ({s.format(**fill) if n == 'detections' else s})" for n, s in CTES if n in needed]
    extra, _, last = body.rpartition("\n--\n")
    parts = [*ctes, *([extra] if extra else [])]
    sql = ("WITH " + ("RECURSIVE " if "RECUR" in body else "") + ",\n".join(parts).replace("/*RECUR*/", "") + "\n" if parts else "") + last
    if duck:
        sql = re.sub(r"\b([0-9.]+)D\b", r"\1::double", sql.replace(" DIV ", " // "))
    return sql


def run(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    return spark.sql(text(body, f"parquet.`{sf_dir}/events.parquet`", duck=False))
