"""The preference graph: edges (src, dst, weight), src replaced by dst."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import settled


def edges_at(prefs: DataFrame, step: int) -> DataFrame:
    """Edges so far."""
    return prefs.where(F.col("step") <= step).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def graph_series(prefs: DataFrame, spine: DataFrame) -> DataFrame:
    """Per step: vertices, edges, new edges, density, average degree and the largest edge count so far."""
    first_edge = prefs.groupBy("src", "dst").agg(F.min("step").alias("step"))
    vertex = prefs.select(F.col("src").alias("v"), "step").unionByName(prefs.select(F.col("dst").alias("v"), "step")).groupBy("v").agg(F.min("step").alias("step"))
    e, v = (x.groupBy("step").agg(F.count("*").alias(n)) for x, n in ((first_edge, "e"), (vertex, "v")))
    filled = spine.join(e, "step", "left").join(v, "step", "left").na.fill(0)
    so_far = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    n, m = F.sum("v").over(so_far), F.sum("e").over(so_far)
    rows = filled.select("step", n.alias("vertices"), m.alias("edges"), F.col("e").alias("new_edges"))
    return rows.select(
        "step",
        "vertices",
        "edges",
        "new_edges",
        F.coalesce(F.try_divide(F.col("edges"), F.col("vertices") * (F.col("vertices") - 1)), F.lit(0.0)).alias("density"),
        F.coalesce(F.try_divide("edges", "vertices"), F.lit(0.0)).alias("average_degree"),
        F.max("edges").over(so_far).alias("max_edges"),
    )


def without_low_mass(edges: DataFrame, mass: DataFrame, least: float, live: int) -> DataFrame:
    """Edges between vertices of ``least`` mass, once there are ``live`` vertices or more."""
    v = edges.select(F.col("src").alias("domain")).unionByName(edges.select(F.col("dst").alias("domain"))).distinct()
    if v.count() < live:
        return edges
    heavy = mass.where(F.col("mass") >= least).select("domain")
    return edges.join(heavy.withColumnRenamed("domain", "src"), "src", "left_semi").join(heavy.withColumnRenamed("domain", "dst"), "dst", "left_semi").select("src", "dst", "weight")


def contracted(edges: DataFrame, mass: DataFrame, least: float, live: int, into: str = "(contracted)") -> DataFrame:
    """Edges with all vertices of less than ``least`` mass made one, once there are ``live`` vertices or more; edges that become alike are summed."""
    v = edges.select(F.col("src").alias("domain")).unionByName(edges.select(F.col("dst").alias("domain"))).where(F.col("domain") != into).distinct()
    if v.count() < live:
        return edges
    light = v.join(mass.where(F.col("mass") >= least).select("domain"), "domain", "left_anti").withColumn("to", F.lit(into))
    rows = edges
    for end in ("src", "dst"):
        rows = rows.join(light.withColumnRenamed("domain", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def accepted_edges(edges: DataFrame, ratio: float = 0.05, clear: float = 0.8, strict: bool = True) -> DataFrame:
    """Relevant and clear edges: heavier than the weight at place ceil(ratio * n) - 1 in order, and at least ``clear`` times the reverse.

    strict=False is the older rule: place int(ratio * n), weights from the cutoff on, and strictly more than ``clear`` times.
    """
    by = edges.groupBy("weight").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("weight"))
    place = F.ceil(F.lit(ratio) * F.sum("n").over(Window.partitionBy())) - 1 if strict else F.floor(F.lit(ratio) * F.sum("n").over(Window.partitionBy()))
    cutoff = by.select("weight", upto.alias("u"), place.alias("p")).where("u > p").agg(F.min("weight").alias("cut"))
    reverse = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("back"))
    rows = edges.join(reverse, ["src", "dst"], "left").na.fill(0, ["back"])
    heavy = F.col("weight") > cutoff.scalar() if strict else F.col("weight") >= cutoff.scalar()
    plain = F.col("weight") >= clear * F.col("back") if strict else F.col("weight") > clear * F.col("back")
    return rows.where(heavy & plain).select("src", "dst", "weight")


def weight_flow(edges: DataFrame, mass: DataFrame, majority: float = 0.7, change: float = 0.01) -> DataFrame:
    """(domain, class) by the weights that leave and enter a vertex."""
    ends = edges.select(F.col("src").alias("domain"), F.col("weight").alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("domain"), F.lit(0).cast("long").alias("o"), F.col("weight").alias("i")))
    by = ends.groupBy("domain").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).join(mass, "domain")
    total = F.col("o") + F.col("i")
    kind = F.when(F.col("o") >= majority * total, "dominated").when(F.col("i") >= majority * total, "dominating").otherwise("contested")
    return by.where((F.col("mass") > 0) & (total > 0) & (total >= change * F.col("mass"))).select("domain", kind.alias("class"))


def simple_degree(edges: DataFrame) -> DataFrame:
    """(domain, class): dominating without edges out, dominated without edges in, else contested."""
    ends = edges.select(F.col("src").alias("domain"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("domain"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    by = ends.groupBy("domain").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return by.select("domain", F.when(F.col("o") == 0, "dominating").when(F.col("i") == 0, "dominated").otherwise("contested").alias("class"))


def degree_with_path(edges: DataFrame, hops: int = 3) -> DataFrame:
    """As simple_degree, but contested only where every out-neighbour reaches back within ``hops``; else dominated."""
    e = settled(edges.select("src", "dst").distinct())  # each hop reads them
    plain = simple_degree(e)
    contested = plain.where(F.col("class") == "contested").select(F.col("domain").alias("src"))
    # from each out-neighbour of a vertex that this can change; a neighbour that is back walks no further
    reach = e.join(contested, "src", "left_semi").select(F.col("src").alias("origin"), F.col("dst").alias("start"), F.col("dst").alias("at"))
    pair = ["origin", "start"]
    back = reach.where("at = origin").select(*pair)
    for _ in range(hops):
        open_ = reach.join(reach.where("at = origin").select(*pair).distinct(), pair, "left_anti")
        reach = settled(open_.join(e, open_["at"] == e["src"]).select(*pair, F.col("dst").alias("at")).distinct())
        back = back.unionByName(reach.where("at = origin").select(*pair))
    lost = e.select(F.col("src").alias("origin"), F.col("dst").alias("start")).join(back.distinct(), ["origin", "start"], "left_anti").select(F.col("origin").alias("domain")).distinct().withColumn("lost", F.lit(True))
    return plain.join(lost, "domain", "left").select("domain", F.when((F.col("class") == "contested") & F.col("lost"), "dominated").otherwise(F.col("class")).alias("class"))


def class_mass(classes: DataFrame, edges: DataFrame, mass: DataFrame) -> DataFrame:
    """(class, fraction) of all mass; 'unclassified' is in the graph without a class, 'not_in_graph' the rest."""
    v = edges.select(F.col("src").alias("domain")).unionByName(edges.select(F.col("dst").alias("domain"))).distinct().withColumn("inside", F.lit(True))
    rows = mass.join(v, "domain", "left").join(classes, "domain", "left")
    kind = F.coalesce("class", F.when(F.col("inside"), "unclassified").otherwise("not_in_graph"))
    total = mass.agg(F.sum("mass").alias("t"))
    return rows.groupBy(kind.alias("class")).agg(F.sum("mass").alias("m")).select("class", F.try_divide(F.col("m"), total.scalar()).alias("fraction"))


def replacements(edits: DataFrame, limit_us: int, key: str = "statement") -> DataFrame:
    """(src, dst, weight): a deletion and a creation of one statement within limit_us, paired in order; each edit is used once.

    Depends on the order of a statement's edits, so each statement is read in order by one task.
    """
    kind = edits.schema[key].dataType.simpleString()

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "revision_id"])
        open_: list[tuple[int, int, str]] = []
        out = []
        for us, sign, domain in zip(pdf["us"], pdf["sign"], pdf["domain"], strict=True):
            open_ = [o for o in open_ if us - o[0] <= limit_us]
            k = next((k for k, o in enumerate(open_) if o[1] == -sign), None)
            if k is None:
                open_.append((us, sign, domain))
                continue
            other = open_.pop(k)[2]
            src, dst = (domain, other) if sign < 0 else (other, domain)
            if src != dst:
                out.append((src, dst))
        return pd.DataFrame(out, columns=["src", "dst"])

    rows = edits.select(F.col(key).cast(kind).alias(key), "us", "revision_id", "sign", "domain")
    return rows.groupBy(key).applyInPandas(pair, "src string, dst string").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def neighbours(edges: DataFrame, domain: str, k: int, outgoing: bool = True) -> DataFrame:
    """Top k edges from (or to) domain, with the reverse weight and the net."""
    here, there = ("src", "dst") if outgoing else ("dst", "src")
    mine = edges.where(F.col(here) == domain)
    back = edges.where(F.col(there) == domain).select(F.col(here).alias(there), F.col(there).alias(here), F.col("weight").alias("reverse"))
    rows = mine.join(back, ["src", "dst"], "left").na.fill(0, ["reverse"]).withColumn("net", F.col("weight") - F.col("reverse"))
    return rows.orderBy(F.desc("weight"), there).limit(k).select("src", "dst", "weight", "reverse", "net")
