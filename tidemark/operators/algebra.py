"""Algebra on result series (step, value), and the graph of metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def divide(num: DataFrame, den: DataFrame) -> DataFrame:
    """num / den per step. Where den is 0 no row is written."""
    both = num.join(den.withColumnRenamed("value", "den"), "step")
    return both.select("step", F.try_divide("value", "den").alias("value")).where("value is not null")


def add(*series: DataFrame) -> DataFrame:
    """Sum of series, keyed or not, per step."""
    rows = reduce(DataFrame.unionByName, [s.select("step", "value") for s in series])
    return rows.groupBy("step").agg(F.sum("value").alias("value"))


def complement(series: DataFrame, spine: DataFrame) -> DataFrame:
    """1 - value; 1 where there is none yet, the last one carried on where a step has none."""
    last = F.last("value", ignorenulls=True).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return spine.join(series, "step", "left").select("step", (F.lit(1.0) - F.coalesce(last, F.lit(0.0))).alias("value"))


def labelled_share(labels: DataFrame, descriptions: DataFrame, entities: DataFrame) -> DataFrame:
    """(labels + descriptions) / (2 entities); 1.0 where there is no entity."""
    both = labels.withColumnRenamed("value", "l").join(descriptions.withColumnRenamed("value", "d"), "step").join(entities, "step")
    share = F.coalesce(F.try_divide(F.col("l") + F.col("d"), 2 * F.col("value")), F.lit(1.0))
    return both.select("step", share.alias("value"))


class MetricGraph:
    """Metrics by name, each a function of the results it depends on."""

    def __init__(self) -> None:
        self.nodes: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}

    def add(self, name: str, run: Callable[..., DataFrame], *needs: str) -> MetricGraph:
        self.nodes[name] = needs, run
        return self

    def levels(self) -> list[list[str]]:
        """Names in order of dependence; those of one level don't depend on each other. A cycle is an error."""
        sorter = TopologicalSorter({n: needs for n, (needs, _) in self.nodes.items()})
        try:
            sorter.prepare()
        except CycleError as e:
            raise ValueError(f"metrics depend on each other: {e.args[1]}") from e
        out = []
        while sorter.is_active():
            ready = sorted(sorter.get_ready())
            out.append(ready)
            sorter.done(*ready)
        return out

    def run(self, *wanted: str) -> dict[str, DataFrame]:
        """The wanted results; shared inputs are planned once."""
        done: dict[str, DataFrame] = {}
        needed, todo = set(), list(wanted or self.nodes)
        while todo:
            n = todo.pop()
            if n not in needed:
                needed.add(n)
                todo += self.nodes[n][0]
        for level in self.levels():
            for n in level:
                if n in needed:
                    needs, run = self.nodes[n]
                    done[n] = run(*(done[d] for d in needs))
        return {n: done[n] for n in (wanted or done)}

    def as_rows(self) -> Mapping[str, tuple[str, ...]]:
        return {n: needs for n, (needs, _) in self.nodes.items()}
