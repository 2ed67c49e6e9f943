"""The plug-in surface: stages by name, models with dependences, attributes as columns, nested parameters, taps and stops."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Stage(Protocol):
    """A module: takes the relation so far and its parameters, and returns the next."""

    def __call__(self, df: DataFrame, **parameters: Any) -> DataFrame: ...


STAGES: dict[str, Stage] = {}
ATTRIBUTES: dict[str, tuple[Callable[[], Column], Callable[[], Column]]] = {}


def stage(name: str) -> Callable[[Stage], Stage]:
    """Registers a module under a name."""

    def keep(function: Stage) -> Stage:
        STAGES[name] = function
        return function

    return keep


def attribute(name: str, value: Callable[[], Column], reliability: Callable[[], Column]) -> None:
    """Registers an attribute: makers of the columns of its value and its reliability."""
    ATTRIBUTES[name] = (value, reliability)


def with_attributes(df: DataFrame, names: list[str]) -> DataFrame:
    """df with <name> and <name>_r for each registered attribute; unknown names are passed over."""
    known = [n for n in names if n in ATTRIBUTES]
    return df.withColumns({c: maker() for n in known for c, maker in ((n, ATTRIBUTES[n][0]), (f"{n}_r", ATTRIBUTES[n][1]))})


def parameter(tree: dict, name: str, default: Any = None) -> Any:
    """The first value of a name in a nested tree, the outer before the inner, in the order written."""
    missing = object()

    def find(node: dict) -> Any:
        if name in node and not isinstance(node[name], dict):
            return node[name]
        for inner in node.values():
            found = find(inner) if isinstance(inner, dict) else missing
            if found is not missing:
                return found
        return missing

    found = find(tree)
    return default if found is missing else found


@dataclass
class Sequence:
    """An ordered list of stage names, as a plan.

    Unknown names are passed over. ``stop`` names a boolean column: rows where it is true leave the plan after the stage that
    set it. ``taps`` holds the relation after each stage by its name, for views.
    """

    names: list[str]
    parameters: dict[str, dict] = field(default_factory=dict)
    stop: str | None = None
    taps: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str, **options: Any) -> Sequence:
        """One name a line; empty lines and remarks after ``#`` are passed over."""
        lines = (line.split("#")[0].strip() for line in text.splitlines())
        return cls([line for line in lines if line], **options)

    def run(self, df: DataFrame) -> DataFrame:
        for name in self.names:
            if name not in STAGES:
                continue
            df = df.transform(lambda d, name=name: STAGES[name](d, **self.parameters.get(name, {})))
            if self.stop and self.stop in df.columns:
                df = df.filter(f"NOT coalesce(`{self.stop}`, false)")
            self.taps[name] = df
        return df

    def follow(self, stream: DataFrame, parameters: Callable[[], dict[str, dict]], path: str, checkpoint: str) -> None:
        """Runs the plan over what has arrived on a stream, with the parameters as they are when each micro-batch begins.

        A micro-batch's rows are written to a folder of its own under ``path``, over those of an attempt that broke off.
        """

        def one(rows: DataFrame, number: int) -> None:
            plan = Sequence(self.names, parameters(), self.stop)
            plan.run(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

        stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@dataclass
class Timings:
    """Mean, deviation, least, greatest and total milliseconds of each stage of a plan, each run to its end on its own."""

    rows: list[tuple[str, float]] = field(default_factory=list)

    def run(self, plan: Sequence, df: DataFrame, times: int = 1) -> DataFrame:
        """The plan's result after ``times`` timed runs. A stage's time is what it takes beyond the stage before."""
        for _ in range(times):
            before, result = 0.0, plan.run(df)
            for name, tap in plan.taps.items():
                began = time.perf_counter()
                tap.write.format("noop").mode("overwrite").save()
                took = (time.perf_counter() - began) * 1000
                self.rows.append((name, max(0.0, took - before)))
                before = took
        return result

    def table(self, spark: SparkSession) -> DataFrame:
        """module, runs, mean, sigma, lo, hi, total."""
        ms = F.col("ms")
        rows = spark.createDataFrame(self.rows, "module string, ms double").groupBy("module")
        return rows.agg(F.count(ms).alias("runs"), F.avg(ms).alias("mean"), F.stddev_pop(ms).alias("sigma"), F.min(ms).alias("lo"), F.max(ms).alias("hi"), F.sum(ms).alias("total"))


@dataclass(frozen=True)
class Model:
    """A single model of an object: columns made from those of its dependences, and columns fed back afterwards."""

    name: str
    forward: Callable[[], dict[str, Column]]
    dependences: tuple[str, ...] = ()
    feedback: Callable[[], dict[str, Column]] | None = None


def applied(df: DataFrame, models: list[Model]) -> DataFrame:
    """Each model's columns after those it depends on, then feedback in the reverse order.

    Models whose dependences are not all active stay out; a cycle raises an error of the sorter.
    """
    active = {m.name: m for m in models}
    while bad := [n for n, m in active.items() if any(d not in active for d in m.dependences)]:
        for name in bad:
            del active[name]
    order = list(TopologicalSorter({n: m.dependences for n, m in active.items()}).static_order())
    for name in order:
        df = df.withColumns(active[name].forward())
    for name in reversed(order):
        if active[name].feedback:
            df = df.withColumns(active[name].feedback())
    return df
