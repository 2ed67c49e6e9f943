"""All queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fluxtrail.functions import camera, geometry, scene
from fluxtrail.operators import classify, objects, pixels, recursions
from fluxtrail.plans import stateful, surface
from fluxtrail.sources import relations

FLAGSHIP = "win_planar_stats"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, body: str, duck: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: relations.run(spark, sf_dir, body)
    SQL[name] = relations.text(duck or body, "events", duck=True)


for bodies in (geometry.bodies(), scene.bodies(), camera.bodies(), pixels.BODIES, objects.BODIES, classify.BODIES):
    for query, statement in bodies.items():
        add(query, statement)
add("px_gray_code", *pixels.GRAY)
add("px_vibe", *pixels.VIBE_PAIR)
for query, statements in objects.PAIRED.items():
    add(query, *statements)
for query, fold, statement in (("win_cooling", recursions.cooling, recursions.COOLING_SQL), ("trk_reliability_attr", recursions.reliability, recursions.RELIABILITY_SQL)):
    QUERIES[query] = lambda spark, sf_dir, fold=fold: fold(relations.run(spark, sf_dir, "SELECT * FROM boxes"))
    SQL[query] = relations.text(statement, "events", duck=True)
for query, operator in stateful.QUERIES.items():
    QUERIES[query] = operator
for query, statement in stateful.SQL.items():
    SQL[query] = relations.text(statement, "events", duck=True)
for query, operator in surface.QUERIES.items():
    QUERIES[query] = operator
for query, statement in surface.SQL.items():
    SQL[query] = relations.text(statement, "events", duck=True)
