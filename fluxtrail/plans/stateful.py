"""Queries whose operators are folds, components, the tracker and the learner."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxtrail.functions import scene
from fluxtrail.operators import classify, components, consensus, contours, folds, grid, learner, lives, merging, objects, recursions, solid, tracker
from fluxtrail.plans import session
from fluxtrail.sources import relations
from fluxtrail.streaming import live

FG = "SELECT frame, x, y FROM px WHERE r > 170"
CLOSE = "a.obj_type = b.obj_type AND a.det_id < b.det_id AND a.xleft - b.xright < 10 AND b.xleft - a.xright < 10 AND a.ytop - b.ybottom < 10 AND b.ytop - a.ybottom < 10"
PLAIN_EDGES = f"SELECT a.det_id AS a, b.det_id AS b FROM boxes a JOIN boxes b ON a.frame_id = b.frame_id AND {CLOSE}"
SAMPLES = "SELECT object_id, det_id, t_us/3600000000.0D AS t, CASE WHEN det_id % 11 = 0 THEN NULL ELSE cast(cx AS double) END AS data, cast(rd AS double) AS rd FROM boxes"


def of(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    session.prepare(spark)
    return relations.run(spark, sf_dir, body)


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, "SELECT obj_type AS stream, frame_id AS frame, det_id AS id, obj_type AS kind, xleft AS l, xright AS r, ytop AS t, ybottom AS b FROM boxes")


def near_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that connect the same boxes as PLAIN_EDGES, at most one a box."""
    rows = of(spark, sf_dir, "SELECT frame_id AS frame, obj_type AS kind, det_id AS node, xleft AS l, xright AS r, ytop AS t, ybottom AS b FROM boxes")
    return components.stars(rows, components.closer(10), ["l", "r", "t", "b"])


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components.groups(near_stars(spark, sf_dir))
    boxes = of(spark, sf_dir, "SELECT det_id AS node, det_id AS id, xleft AS l, xright AS r, ytop AS t, ybottom AS b FROM boxes")
    return boxes.join(found, "node").select("grp", "id", "l", "r", "t", "b")


def nearest_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = of(spark, sf_dir, f"{objects.PLACES}\n--\nSELECT * FROM p")
    return grid.nearest(places, of(spark, sf_dir, "SELECT det_id, frame_id, cx, cy FROM boxes"), (6, 30, 150))


def block_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "p AS (SELECT x DIV 4 AS bx, y DIV 4 AS by_, frame, x, y, r, lag(r) OVER (PARTITION BY x, y ORDER BY frame) AS q FROM px)\n--\nSELECT bx, by_, frame, coalesce(avg(power(r - q, 2)) > 8000, false) AS moving, transform(sequence(0, 15), i -> element_at(map_from_entries(collect_list(struct(cast(y % 4*4 + x % 4 AS int), r))), i)) AS px FROM p GROUP BY bx, by_, frame"
    return folds.block_states(of(spark, sf_dir, body))


def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = of(spark, sf_dir, "SELECT frame_id*8 + length(obj_type) AS frame, det_id AS node FROM boxes")
    return components.connected(near_stars(spark, sf_dir), members)


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "SELECT obj_type AS context, object_id, t_us/3600000000.0D AS t, cast(cx AS double) AS x, cast(cy AS double) AS y, CASE WHEN width > 28 THEN 'wide' ELSE 'slim' END AS shape FROM boxes"
    return learner.learn(of(spark, sf_dir, body), {"x": 60.0, "y": 60.0}, ["shape"])


def learned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The states, the states above each, and the events of the learned hierarchies, which are learned once."""
    found = hierarchy(spark, sf_dir).checkpoint()
    states = found.filter("kind = 'state'").select("context", "id", "parent", "p")
    times, sigma = F.split("means", ","), F.col("sigmas").cast("double")
    events = found.filter("kind = 'event'").select("context", F.col("id").alias("src"), F.col("parent").alias("dst"), "n", *(F.get(times, F.lit(k)).cast("double").alias(c) for k, c in enumerate(("mean", "lo", "hi"))), sigma.alias("sigma"))
    return states, learner.ancestors(states), events


def tree(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The statement of a measure of the tree of object numbers, over ways up made by pointer doubling: recursive statements stop at a million rows."""
    nodes = of(spark, sf_dir, "SELECT object_id AS id, object_id DIV 2 AS parent, count(*) AS n FROM detections GROUP BY object_id").checkpoint()
    rest = scene.bodies()[name][len(scene.TREE) :]
    anc = learner.numbered_ancestors(nodes)
    return spark.sql("WITH nodes AS (SELECT * FROM {nodes}), anc AS (SELECT * FROM {anc})" + rest.replace("\n--\n", "\n"), nodes=nodes, anc=anc)


def kinship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, above, events = learned(spark, sf_dir)
    return learner.kinship(above, events.select("context", F.col("src").alias("x"), F.col("dst").alias("y")))


def likely(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, above, _ = learned(spark, sf_dir)
    return learner.likely_states(states, above)


def event_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, above, events = learned(spark, sf_dir)
    return rounded(learner.lifted(events, above), "p", "mean", "sigma", "lo", "hi")


def solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solid.solids(of(spark, sf_dir, "SELECT det_id, xleft, xright, ytop, ybottom FROM boxes"), solid.WALLS)


def coherent(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = of(spark, sf_dir, "SELECT det_id, object_id, t_us FROM boxes")
    return solid.coherent(solids(spark, sf_dir), of(spark, sf_dir, "SELECT * FROM models"), seen)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


def mergeable(i: int, own: np.ndarray, of: dict[str, np.ndarray]) -> np.ndarray:
    """Which boxes merge with one, as objects.MERGEABLE has it; ``inside`` is whether a box stands in the area of interest."""
    l, r, t, b, w, h, inside = (of[c] for c in ("l", "r", "t", "b", "w", "h", "inside"))
    low, high = np.maximum(l[i], l[own]), np.minimum(r[i], r[own])
    top, foot = np.maximum(t[i], t[own]), np.minimum(b[i], b[own])
    both = np.where((low < high) & (top < foot), (high - low + 1) * (foot - top + 1), 0)
    gap = np.sqrt(np.maximum(0, low - high).astype(float) ** 2 + np.maximum(0, top - foot).astype(float) ** 2)
    floats = (b[i] < t[own]) & inside[i] | (b[own] < t[i]) & inside[own]
    reach = 10.0 * np.where(high - low + 1 < 0.5 * np.minimum(w[i], w[own]), 1.0, np.where(floats, 1.5, 3.5))
    return ((both > 0.4 * (w[i] * h[i])) | (both > 0.4 * (w[own] * h[own])) | (gap < reach)) & (inside[i] | inside[own])


def involved_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which groups of mergeable boxes each object reaches, and with how many boxes: a group stands for all its boxes.

    Boxes are connected by an edge each, and have their group before they meet the objects; so what is shuffled is counts of
    groups, and no pair.
    """
    columns = ["l", "r", "t", "b", "w", "h", "inside"]
    rows = of(spark, sf_dir, f"SELECT frame_id AS frame, 0 AS kind, det_id AS node, xleft AS l, xright AS r, ytop AS t, ybottom AS b, width AS w, height AS h, NOT ({objects.OUTSIDE.format('boxes')}) AS inside FROM boxes")
    found = components.groups(components.stars(rows, mergeable, columns))
    named = of(spark, sf_dir, "SELECT * FROM boxes").join(found.withColumnRenamed("node", "det_id"), "det_id", "left").withColumn("grp", F.coalesce("grp", "det_id"))
    near = grid.joined("m", "{named}", ("l - wx", "r + wx", "t - wy", "b + wy"), reach=1)
    body = objects.INVOLVED.replace("{join}", near).replace("b.det_id AS blob", "b.grp").replace("SELECT object_id, det_id, blob FROM g", "SELECT object_id, det_id, grp, count(*) AS boxes FROM g")
    return spark.sql(relations.text(body + " GROUP BY object_id, det_id, grp", f"parquet.`{sf_dir}/events.parquet`", duck=False), named=named)


def network_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean error of the network on rows that it has not learned from, plain and by reliability."""
    off = F.abs(F.col("y") - F.col("guess"))
    return classify.regressed(histograms(spark, sf_dir)).agg(F.round(F.avg(off), 3).alias("mae"), F.round(F.sum(F.col("weight") * off) / F.sum("weight"), 3).alias("weighted_mae"), F.count(off).alias("n"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: f"struct(cast({x} AS double) AS x, cast({y} AS double) AS y)"
    square = lambda a, b, c, d: f"array({corner(a, b)}, {corner(c, b)}, {corner(c, d)}, {corner(a, d)})"
    return of(spark, sf_dir, f"SELECT det_id AS id, {square('ax', 'ay', 'ar', 'ab')} AS p, {square('bx', 'by_', 'br', 'bb')} AS q FROM pairs")


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = ", ".join(f"cast(sum(CASE WHEN width DIV 8 = {k} THEN 1 ELSE 0 END) AS double)" for k in range(1, 7))
    return of(spark, sf_dir, f"SELECT object_id AS id, array({bins}) AS features, avg(height) AS y, avg(rd) AS weight FROM boxes GROUP BY object_id")


EVIDENCE = "SELECT object_id, t_us, det_id, cast(rd - 0.4D AS double) AS cover, width > 10 AND xleft <= 600 AS fits FROM boxes"
SAMPLED = "SELECT cast(object_id AS varchar(20)) AS key, t_us, det_id, cast(cx AS double) AS x, cast(rd AS double) AS w FROM boxes"
SIGHTS = """f AS (SELECT *, row_number() OVER (PARTITION BY obj_type, frame_id ORDER BY width*height DESC, det_id) AS rn FROM boxes)
--
SELECT obj_type AS stream, frame_id AS frame, CASE WHEN rd >= 0.3 THEN cast(cx AS double) END AS x, CASE WHEN rd >= 0.3 THEN cast(cy AS double) END AS y,
 1.0D*xleft AS x1, cast(cy AS double) AS y1, 1.0D*xright AS x2, cast(cy AS double) AS y2, cast(height*rd AS double) AS half1, cast(height*(1 - rd) AS double) AS half2, CASE WHEN det_id % 7 > 0 THEN 1.0D*width END AS length
FROM f WHERE rn = 1"""
#: An object's foot on the ground, by a plane map of the screen.
GROUND = ("(0.02D*cx + 0.001D*ybottom + 1)/(0.0001D*cx + 0.0002D*ybottom + 1)", "(0.002D*cx + 0.03D*ybottom + 2)/(0.0001D*cx + 0.0002D*ybottom + 1)")


#: Shapes in space with the angle of an object's last movement on the ground.
SHAPES = "SELECT object_id, t_us, det_id, 1.0D*width AS w, 0.8D*height AS l, (width + height)/2.0D AS h, CASE WHEN coalesce(cx - lag(cx) OVER v, 0) = 0 AND coalesce(cy - lag(cy) OVER v, 0) = 0 THEN 0.0D ELSE atan2(cast(cy - lag(cy) OVER v AS double), cast(cx - lag(cx) OVER v AS double)) END AS alpha, cast(rd AS double) AS rw, cast(1 - rd/2 AS double) AS rl, 0.5D AS rh FROM boxes WINDOW v AS (PARTITION BY object_id ORDER BY t_us, det_id)"


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as their bases on the ground, of the kind of their class in space."""
    boxes = of(spark, sf_dir, "SELECT obj_type AS stream, frame_id AS frame, det_id, xleft, xright, ybottom FROM boxes")
    rows = solid.footprints(boxes, solids(spark, sf_dir), of(spark, sf_dir, "SELECT * FROM models"))
    return rows.select("stream", "frame", F.col("det_id").alias("id"), F.col("class").alias("kind"), F.col("gl").alias("l"), F.col("gr").alias("r"), F.col("gt").alias("t"), F.col("gb").alias("b"))


def solid_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recursion over the shapes that the search of angles and heights finds for persons; a box without one has none."""
    best = solid.searched(solids(spark, sf_dir), of(spark, sf_dir, "SELECT * FROM models WHERE class = 'PERSON'"), ("rw", "rl", "rh"))
    rows = of(spark, sf_dir, "SELECT det_id, object_id, t_us FROM boxes").join(best.hint("merge"), "det_id", "left")
    angle = F.lit(solid.ANGLES[0]) + (solid.ANGLES[1] - solid.ANGLES[0]) * F.col("k")
    return recursions.mobile_shape(rows.withColumn("alpha", angle))


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, x, y, fg of the pixels in the zone: whether a pixel is farther than 50 from the running background before it."""
    px = of(spark, sf_dir, "SELECT 3*x + c AS x, y, frame, CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS v FROM px CROSS JOIN (VALUES (0), (1), (2)) AS k(c) WHERE x BETWEEN 2 AND 13 AND NOT (x BETWEEN 6 AND 9 AND y BETWEEN 6 AND 9)")
    before = F.lag("bg").over(W.partitionBy("x", "y").orderBy("frame"))
    off = px.join(folds.background(px), ["x", "y", "frame"]).withColumn("off", F.pow(F.col("v") - before, F.lit(2)))
    return off.groupBy("frame", F.expr("x div 3").alias("x"), "y").agg(F.sum("off").alias("off")).filter("off is not null").select("frame", "x", "y", (F.col("off") > 2500).cast("int").alias("fg"))


QUERIES = {
    "join_nearest_object": nearest_objects,
    "px_bg_update": lambda s, d: folds.background(of(s, d, "SELECT x, y, frame, r AS v FROM px")),
    "px_block_classify": lambda s, d: block_states(s, d).select("bx", "by_", "frame", "code"),
    "px_block_update": lambda s, d: block_states(s, d).select("bx", "by_", "frame", "bg"),
    "trk_reliability_full": lambda s, d: folds.attributes(of(s, d, SAMPLES)),
    "attr_ema_probability": lambda s, d: folds.cooled_probability(of(s, d, "SELECT object_id, det_id, t_us/3600000000.0D AS t, cast(rd AS double) AS rd FROM boxes"), 0.1),
    "cc_two_step": lambda s, d: components.pixel_components(of(s, d, FG)).select("frame", "label", "n", "l", "r", "t", "b"),
    "cc_rle": lambda s, d: components.run_components(of(s, d, FG)),
    "merge_groups": lambda s, d: components.groups(near_stars(s, d)),
    "merge_connectivity": connectivity,
    "join_involved_groups": involved_groups,
    "sup_ann_error": network_error,
    "merge_partitions": lambda s, d: merging.merge_partitions(grouped(s, d), each_way=True),
    "trk_new_objects": lambda s, d: merging.new_objects(grouped(s, d), each_way=True),
    "premerge_search": lambda s, d: merging.merge_search(grouped(s, d), each_way=True),
    "premerge_correspond": lambda s, d: components.matched(of(s, d, "SELECT frame_id AS frame, det_id AS id, xleft AS l, xright AS r, ytop AS t, ybottom AS b, width*height AS area FROM boxes")),
    "premerge_merge": lambda s, d: merging.merged_by_correspondence(of(s, d, "SELECT frame_id AS frame, det_id AS id, xleft AS l, xright AS r, ytop AS t, ybottom AS b FROM boxes"), [(20.0, 12.0, 8.0, 40.0), (36.0, 10.0, 20.0, 60.0)]),
    "px_bg_diff": moved,
    "trk_mobile2d_dim": lambda s, d: recursions.mobile_size(of(s, d, "SELECT * FROM boxes")),
    "trk_mobile2d_pos": lambda s, d: recursions.mobile_place(of(s, d, "SELECT object_id, t_us, det_id, cast(rd AS double) AS rd, cx, cy FROM boxes")),
    "trk_mobile3d": lambda s, d: recursions.mobile_place(of(s, d, f"SELECT object_id, t_us, det_id, cast(rd AS double) AS rd, {GROUND[0]} AS gx, {GROUND[1]} AS gy FROM boxes"), ("gx", "gy"), expect=True),
    "trk_mobile3d_dim": lambda s, d: recursions.mobile_shape(of(s, d, SHAPES)),
    "trk_mobile3d_solid": solid_tracks,
    "premerge_reduce": lambda s, d: components.reduced(of(s, d, "SELECT frame_id AS frame, det_id AS id, xleft AS l, xright AS r, ytop AS t, ybottom AS b, CASE obj_type WHEN 'click' THEN 'PERSON' WHEN 'view' THEN 'VEHICLE' ELSE 'UNKNOWN' END AS kind, cast(rd AS double) AS p FROM boxes")),
    "trk_multi_hypothesis": lambda s, d: tracker.track(blobs(s, d)),
    "trk_live": lambda s, d: live.replayed(s, blobs(s, d)),
    "trk_2d": lambda s, d: tracker.track(blobs(s, d), tracker.CONFIGURATIONS["planar"]),
    "trk_3d": lambda s, d: tracker.track(bases(s, d), tracker.CONFIGURATIONS["ground"]),
    "trk_spatial": lambda s, d: tracker.track(blobs(s, d), tracker.CONFIGURATIONS["spatial"]),
    "geo_polygon_clip": lambda s, d: classify.clipped(polygons(s, d)).select("id", F.round("area", 4).alias("area")),
    "trk_hull": lambda s, d: classify.hulls(of(s, d, "SELECT frame AS id, array_sort(collect_list(struct(cast(x AS double) AS x, cast(y AS double) AS y))) AS points FROM px WHERE r > 170 GROUP BY frame")),
    "trk_contour": lambda s, d: rounded(contours.segments(of(s, d, FG)), "to_x", "to_y", "length"),
    "px_vibe_update": lambda s, d: consensus.foreground(of(s, d, "SELECT frame DIV 16 AS clip, frame, x, y, (r + g + b) DIV 3 AS v FROM px")),
    "sup_pca": lambda s, d: classify.principal(histograms(s, d)).select("id", F.round(F.abs(F.get("pcs", F.lit(0))), 4).alias("pc1")),
    "sup_kmeans": lambda s, d: classify.clusters(classify.principal(histograms(s, d))).select("id", "cluster"),
    "sup_ann": lambda s, d: classify.regressed(histograms(s, d)).select("id", F.round("guess", 3).alias("guess")),
    "trk_blob_autoc": lambda s, d: lives.blob_lives(of(s, d, EVIDENCE)),
    "trk_focus_object": lambda s, d: lives.focus(of(s, d, SIGHTS)),
    "agg_weighted_gauss": lambda s, d: lives.weighted_gaussians(of(s, d, SAMPLED), 5.0),
    "cls_3d_box": lambda s, d: rounded(solids(s, d).select("det_id", "k", "h", "x", "y", "w", "l", "hidden", "blocked"), "x", "y", "w", "l"),
    "cls_search_alpha_h": lambda s, d: rounded(solid.searched(solids(s, d), of(s, d, "SELECT * FROM models")), "w", "l", "p", "r"),
    "cls_tracking_coherent": lambda s, d: rounded(coherent(s, d), "w", "l", "off"),
    "lrn_step": lambda s, d: hierarchy(s, d).filter("kind = 'state'"),
    "lrn_events": lambda s, d: hierarchy(s, d).filter("kind = 'event'"),
    "lrn_event_levels": event_levels,
    "lrn_growth": lambda s, d: hierarchy(s, d).filter("kind = 'growth'").selectExpr("context", "n AS day", "id AS states", "parent AS events"),
    "lrn_depth": lambda s, d: learned(s, d)[1].groupBy("context", "id").agg(F.max("d").alias("depth")),
    "lrn_distance_to_leaf": lambda s, d: learner.leaf_steps(learned(s, d)[1]),
    "lrn_kinship": kinship,
    "lrn_likely_states": likely,
    **{q: lambda s, d, q=q: tree(s, d, q) for q in ("tree_depth", "tree_distance_to_leaf", "tree_kinship", "tree_likely_states")},
}

LABELLED = f"fg AS ({FG}), /*RECUR*/reach(frame, x, y, v, w) AS (SELECT frame, x, y, x, y FROM fg UNION SELECT r.frame, r.x, r.y, f.x, f.y FROM reach r JOIN fg f ON f.frame = r.frame AND abs(f.x - r.v) <= 1 AND abs(f.y - r.w) <= 1), named AS (SELECT frame, x, y, min(w*65536 + v) AS label FROM reach GROUP BY frame, x, y)\n--\nSELECT frame, label, count(*) AS n, min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS b FROM named GROUP BY frame, label"
NAMED = f"half AS ({PLAIN_EDGES}), e AS (SELECT a, b FROM half UNION SELECT b, a FROM half), /*RECUR*/reach(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other), g AS (SELECT node, min(other) AS grp FROM reach GROUP BY node)\n--\n"
_INVOLVED = objects.PAIRED["join_involved"][1].split("\n--\n")
GROUPED = f"{_INVOLVED[0]}, involved AS ({_INVOLVED[1]}), half AS ({objects.PAIRED['merge_candidates'][1]}), e AS (SELECT a_id AS a, b_id AS b FROM half UNION SELECT b_id, a_id FROM half), /*RECUR*/reach(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other), c AS (SELECT node, min(other) AS grp FROM reach GROUP BY node)\n--\n"
#: DuckDB statements; the other operators are held against brute force and planted cases in the tests.
SQL = {
    "cc_two_step": LABELLED,
    "join_nearest_object": objects.NEAREST_SQL,
    "merge_groups": NAMED + "SELECT node, grp FROM g",
    "join_involved_groups": GROUPED + "SELECT object_id, det_id, coalesce(grp, blob) AS grp, count(*) AS boxes FROM involved LEFT JOIN c ON c.node = blob GROUP BY object_id, det_id, coalesce(grp, blob)",
    "merge_connectivity": NAMED + "SELECT frame_id*8 + length(obj_type) AS frame, min(coalesce(grp, det_id)) = max(coalesce(grp, det_id)) AS connected FROM boxes LEFT JOIN g ON g.node = det_id GROUP BY frame_id*8 + length(obj_type)",
    "geo_polygon_clip": "SELECT det_id AS id, round(greatest(0, least(ar, br) - greatest(ax, bx))*greatest(0, least(ab, bb) - greatest(ay, by_))*1.0D, 4) AS area FROM pairs",
    "px_bg_diff": "o AS (SELECT x, y, frame, r, g, b, row_number() OVER (PARTITION BY x, y ORDER BY frame) AS i FROM px WHERE x BETWEEN 2 AND 13 AND NOT (x BETWEEN 6 AND 9 AND y BETWEEN 6 AND 9)), /*RECUR*/f(x, y, frame, i, r, g, b, off) AS (SELECT x, y, frame, i, r, g, b, cast(NULL AS bigint) FROM o WHERE i = 1 UNION ALL SELECT o.x, o.y, o.frame, o.i, " + ", ".join(f"cast(floor(0.9D*f.{c} + 0.1D*o.{c} + 1e-9) AS bigint)" for c in "rgb") + ", cast((o.r - f.r)*(o.r - f.r) + (o.g - f.g)*(o.g - f.g) + (o.b - f.b)*(o.b - f.b) AS bigint) FROM f JOIN o ON o.x = f.x AND o.y = f.y AND o.i = f.i + 1)\n--\nSELECT frame, x, y, CASE WHEN off > 2500 THEN 1 ELSE 0 END AS fg FROM f WHERE off IS NOT NULL",
    "trk_mobile2d_dim": recursions.size_sql(),
    "trk_mobile2d_pos": recursions.place_sql(),
    "trk_mobile3d_dim": recursions.shape_sql(SHAPES),
    "trk_mobile3d": recursions.place_sql(*GROUND, expect=True),
    "px_bg_update": "o AS (SELECT x, y, frame, r, row_number() OVER (PARTITION BY x, y ORDER BY frame) AS i FROM px), /*RECUR*/f(x, y, frame, i, bg) AS (SELECT x, y, frame, i, r FROM o WHERE i = 1 UNION ALL SELECT o.x, o.y, o.frame, o.i, cast(floor(0.9D*f.bg + 0.1D*o.r + 1e-9) AS bigint) FROM f JOIN o ON o.x = f.x AND o.y = f.y AND o.i = f.i + 1)\n--\nSELECT x, y, frame, bg FROM f",
    "attr_ema_probability": "SELECT a.object_id, a.det_id, round(sum(b.rd*exp(-0.1D*(a.t_us - b.t_us)/3600000000.0D))/sum(exp(-0.1D*(a.t_us - b.t_us)/3600000000.0D)), 6) AS p FROM boxes a JOIN boxes b ON a.object_id = b.object_id AND (b.t_us < a.t_us OR b.t_us = a.t_us AND b.det_id <= a.det_id) GROUP BY a.object_id, a.det_id",
    "trk_blob_autoc": f"e AS ({EVIDENCE}), o AS (SELECT object_id, det_id, CASE WHEN NOT fits THEN 3 WHEN cover > 0.1D THEN 0 ELSE 1 END AS worse, row_number() OVER (PARTITION BY object_id ORDER BY t_us, det_id) AS i FROM e), /*RECUR*/f(object_id, det_id, i, life, bad) AS (SELECT object_id, det_id, i, 1, 0 FROM o WHERE i = 1 UNION ALL SELECT o.object_id, o.det_id, o.i, CASE WHEN f.bad > 3 THEN f.life + 1 ELSE f.life END, CASE WHEN f.bad > 3 OR o.worse = 0 THEN 0 ELSE f.bad + o.worse END FROM f JOIN o ON o.object_id = f.object_id AND o.i = f.i + 1)\n--\nSELECT object_id, det_id, life, bad, bad > 3 AS deleted FROM f",
    "agg_weighted_gauss": f"e AS ({SAMPLED}), o AS (SELECT key, x, w, row_number() OVER (PARTITION BY key ORDER BY t_us, det_id) AS i FROM e), /*RECUR*/f(key, i, m, s, t) AS (SELECT key, i, x, 5.0D, w FROM o WHERE i = 1 UNION ALL SELECT o.key, o.i, (f.m*f.t + o.x*o.w)/(f.t + o.w), greatest(5.0D, sqrt(f.t*f.s*f.s/(f.t + o.w) + f.t*o.w*(o.x - f.m)*(o.x - f.m)/((f.t + o.w)*(f.t + o.w)))), f.t + o.w FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1)\n--\nSELECT key, i AS n, round(m, 5) AS mean, round(s, 5) AS sigma FROM f QUALIFY i = max(i) OVER (PARTITION BY key)",
}
