"""Sources, sinks and streams on small files."""

import datetime as dt
import uuid

from fluxtrail.sources import files, sinks
from fluxtrail.streaming import tracks


def test_frames_and_header(spark, tmp_path):
    (tmp_path / "cam-10.20.30.400-7.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x10" + b"20260107102030400" + b"000007" + b"C01" + bytes(8))
    (tmp_path / "img_3.ppm").write_bytes(b"P6")
    (tmp_path / "skip_9.txt").write_bytes(b"x")
    rows = {r.frame_id: r for r in files.frames(spark, str(tmp_path), start=2).collect()}
    assert set(rows) == {3, 7}
    assert rows[7].time_ms == ((10 * 60 + 20) * 60 + 30) * 1000 + 400 and rows[3].time_ms is None
    assert rows[7].header.frame == 7 and rows[7].header.camera == "C01" and rows[7].header.ts == dt.datetime(2026, 1, 7, 10, 20, 30, 400000)
    assert rows[3].header is None
    name = "cam" + uuid.uuid4().hex
    query = files.camera(spark, str(tmp_path)).select("frame_id").writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.frame_id for r in spark.table(name).collect()} == {3, 7}


def test_ground_truth(spark, tmp_path):
    path = tmp_path / "truth.xml"
    path.write_text('<VideoAnalysis><Image IDimage="4"><Object IDobject="1" Nameobject="person" beginX="50" beginY="20" endX="41" endY="29"/></Image><Image IDimage="5"/></VideoAnalysis>')
    assert [tuple(r) for r in files.ground_truth(spark, str(path)).collect()] == [(4, 1, "PERSON", 37, 16, 10, 10)]
    assert files.ground_truth(spark, str(path), files.TRACKING_SHIFT).first().ytop == 18


def test_supervised(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# image mean\n 1  2.5\t3 4 0.5\n\n2 1 2\n3 x 1 1 1\n")
    assert [tuple(r) for r in files.supervised(spark, str(tmp_path / "t.txt")).orderBy("image").collect()] == [(1, 2.5, 3.0, 4.0, 0.5), (3, None, 1.0, 1.0, 1.0)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, 10.0, 10.0, 4.0, 4.0), (2, 7, 11.0, 10.0, 5.0, 4.0)], "frame long, object_id long, cx double, cy double, width double, height double")
    sinks.tracks_xml(rows, str(tmp_path / "xml"))
    back = spark.read.format("xml").option("rowTag", "frame").load(str(tmp_path / "xml"))
    assert sorted((r._frame_id, r.tracked_target._start_frame_track, r.tracked_target._xmin) for r in back.collect()) == [(1, 1, 8), (2, 1, 8)]
    sinks.planar_text(rows, str(tmp_path / "tsv"), every=2)
    assert [r.cx for r in spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "tsv")).collect()] == ["11.0000"]
    sinks.object_log(rows, str(tmp_path / "log"))
    assert (tmp_path / "log" / "object_id=7").is_dir()
    shape = "context string, kind string, id long, parent long, level int, n long, p double, means string, sigmas string"
    tree = spark.createDataFrame([("c", "state", 1, 0, 0, 5, 1.0, "1.5,2.5", "3.0,4.0")], shape)
    sinks.hierarchy_xml(tree, str(tmp_path / "tree"))
    assert sinks.read_hierarchy(spark, str(tmp_path / "tree")).collect() == tree.collect()
    assert tuple(sinks.ellipses(tree).first()) == ("c", 1, 1.5, 2.5, 3.0, 4.0)
    config = {"a": "1", "b": {"c": "x < y"}}
    assert sinks.read_config(sinks.config_xml(config)) == config


def test_stream_keeps_state(spark, tmp_path):
    shape = "object_id long, frame long, ts timestamp, data double, rd double"
    start = dt.datetime(2026, 1, 1)
    feed = [[(1, f, start + dt.timedelta(seconds=f), 5.0 * f, 1.0) for f in range(4)], [(1, f, start + dt.timedelta(seconds=f), 5.0 * f, 1.0) for f in range(4, 9)], [(2, 0, start + dt.timedelta(hours=2), 1.0, 1.0)], [(2, 1, start + dt.timedelta(hours=3), 1.0, 1.0)]]
    for k, rows in enumerate(feed):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{k}"))
    source = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for make, name in ((tracks.reliability, "rel" + uuid.uuid4().hex), (tracks.lives, "liv" + uuid.uuid4().hex)):
        make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        rows = spark.table(name).collect()
        if name.startswith("rel"):
            seen = {r.frame: r.value for r in rows if r.object_id == 1 and r.status == "SEEN"}
            assert len(seen) == 9 and abs(seen[8] - 40) < 3
            assert any(r.object_id == 1 and r.status == "EXPIRED" for r in rows)
        else:
            assert any(r.object_id == 1 and r.samples == 9 for r in rows)


def test_images_come_back(spark, tmp_path):
    rows = [(7, 37_203_040, x, y, 10 * x, 10 * y, 200) for x in range(4) for y in range(3)] + [(7, 37_203_040, 0, 0, 9, 9, 9)] * 2 + [(8, 37_204_040, 1, 1, 5, 6, 7)]
    path = f"file://{tmp_path}/images"
    for _ in range(2):  # a task run again leaves the same files
        sinks.images(spark.createDataFrame(rows, "frame long, time_ms long, x long, y long, r long, g long, b long"), path)
    found = {r.frame_id: r for r in files.frames(spark, path).collect()}
    assert {k: (r.file, r.time_ms) for k, r in found.items()} == {7: ("cam-10.20.03.040-7.ppm", 37_203_040), 8: ("cam-10.20.04.040-8.ppm", 37_204_040)}
    assert bytes(found[8].bytes) == b"P6\n2 2\n255\n" + bytes([0] * 9 + [5, 6, 7])
    whole = bytes(found[7].bytes)
    assert whole[:11] == b"P6\n4 3\n255\n" and whole[11:14] == bytes([9, 9, 9]) and whole[-3:] == bytes([30, 20, 200]) and len(whole) == 11 + 36


SCENE = """<scene><perspective_matrix m00="1.5" m01="0" m02="0" m03="2" m10="0" m11="1" m12="0" m13="0" m20="0" m21="0" m22="0" m23="1"/>
<homography_matrix h00="1" h01="0" h02="0" h10="0" h11="1" h12="0" h20="0" h21="0" h22="1"/>
<Zone2DList><Zone2D name="Screen"><OutlineList><Point X="3" Y="4"/><Point X="7"/></OutlineList></Zone2D></Zone2DList>
<ZoneHomographyList><ZoneHomography id="3" type="Ellipse"><Center X="1" Y="2"/><Radius RX="50" RY="40"/></ZoneHomography></ZoneHomographyList>
<WallList><Wall ident="4" name="North" height="90"><StartPoint x="7" y="5"/><EndPoint x="9" y="6" z="0"/></Wall></WallList>
<ContextObjectsList><ContextObject><OutlineList><Point x="1" y="1" z="2"/></OutlineList></ContextObject></ContextObjectsList></scene>"""
MODELS = """<ObjectModels><ObjectModel name="A" type="postural"><velocity><min value="0"/><max value="8"/></velocity></ObjectModel>
<ObjectModel name="B" type="rigid"><depth><mean value="7"/><sigma value="2"/><min value="1"/><max value="11"/></depth></ObjectModel></ObjectModels>"""
CONTEXTS = """<L><Learning_Context name="P"><Numerical_Attribute_List><Numerical_Attribute name="X" acuity="2.5"/><Numerical_Attribute name="Y" acuity="-1"/><Numerical_Attribute name="Z"/></Numerical_Attribute_List></Learning_Context>
<Learning_Context name="Q" init_file="q.xml"/></L>"""


def test_what_files_leave_out(spark, tmp_path):
    for name, text in (("scene", SCENE), ("models", MODELS), ("contexts", CONTEXTS)):
        (tmp_path / f"{name}.xml").write_text(text)
    scene = files.scene(spark, f"file://{tmp_path}/scene.xml")
    assert {r.name: list(r.m) for r in scene["matrices"].collect()} == {"perspective": [1.5, 0, 0, 2, 0, 1, 0, 0, 0, 0, 0, 1], "homography": [1, 0, 0, 0, 1, 0, 0, 0, 1]}
    zones = {r.space: r for r in scene["zones"].collect()}
    assert (zones["image"].id, zones["image"].shape, [tuple(p) for p in zones["image"].outline]) == (-1, "Polygon", [(3, 4, 0), (7, 0, 0)])
    assert (zones["homography"].shape, zones["homography"].name, zones["homography"].rx) == ("Ellipse", "None", 50)
    wall, thing = scene["walls"].first(), scene["context_objects"].first()
    assert (wall.id, wall.height, wall.end.y, thing.id, thing.name, thing.height) == (4, 90, 6, -1, "None", 10)
    models = {(r["class"], r.criterion): (r.mean, r.sigma, r.hi) for r in files.class_models(spark, f"file://{tmp_path}/models.xml").collect()}
    assert models == {("A", "velocity"): (4, 16, 8), ("B", "depth"): (7, 2, 11)}
    contexts = {r.context: r for r in files.contexts(spark, f"file://{tmp_path}/contexts.xml").collect()}
    assert [tuple(a) for a in contexts["P"].numeric] == [("X", 2.5), ("Y", 1.0), ("Z", 1.0)] and contexts["Q"].init_file == "q.xml" and not contexts["Q"].numeric
