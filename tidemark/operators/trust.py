"""Trust in sources: sessions of edits, what they replace, and how sources fare against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import wilson
from tidemark.operators.steps import accumulated, spread


def edit_stream(references: DataFrame) -> DataFrame:
    """Creations and deletions of whole references: sign +1 or -1."""
    return references.where("change_target = ''").withColumn("sign", F.when(F.col("action") == "CREATE", 1).when(F.col("action") == "DELETE", -1)).where("sign is not null")


def sessionize(edits: DataFrame, gap_us: int, key: str = "statement", order: Sequence[str] = ("us", "revision_id")) -> DataFrame:
    """Adds session: a new one after a pause longer than gap_us; a pause of exactly that continues."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.col("us") - F.lag("us").over(w) > gap_us, 1).otherwise(0)
    return edits.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def session_net(sessions: DataFrame, key: str = "statement") -> DataFrame:
    """Net of each reference in each session, with its domain."""
    return sessions.groupBy(key, "session", "reference", "domain").agg(F.sum("sign").cast("long").alias("net"))


def session_close(sessions: DataFrame, gap_us: int, origin_us: int, step_us: int, key: str = "statement") -> DataFrame:
    """(key, session, edits, last_us, step): a session closes in the first step that ends later than its last edit plus the gap."""
    closed = sessions.groupBy(key, "session").agg(F.count("*").alias("edits"), F.countDistinct("reference").alias("references"), F.max("us").alias("last_us"))
    return closed.withColumn("step", F.floor((F.col("last_us") + F.lit(gap_us - origin_us)) / F.lit(step_us)).cast("long"))


def preferences(net: DataFrame, closes: DataFrame, key: str = "statement") -> DataFrame:
    """(step, src, dst, weight): sessions closed in step in which a source of domain src was replaced by one of dst."""
    side = net.select(key, "session", "domain", (F.col("net") > 0).alias("current")).distinct()
    old = side.where(~F.col("current")).select(key, "session", F.col("domain").alias("src"))
    new = side.where("current").select(key, "session", F.col("domain").alias("dst"))
    pairs = old.join(new, [key, "session"]).where("src <> dst")
    return pairs.join(closes.select(key, "session", "step"), [key, "session"]).groupBy("step", "src", "dst").agg(F.count("*").alias("weight"))


def session_stats(closes: DataFrame, spine: DataFrame) -> DataFrame:
    """Per step: closed sessions, edits in them and their references; and the same so far."""
    by = closes.groupBy("step").agg(F.count("*").alias("closed"), F.sum("edits").alias("edits"), F.sum("references").alias("refs"))
    filled = spine.join(by, "step", "left").na.fill(0)
    so_far = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(
        "step",
        F.col("closed").cast("long").alias("closed"),
        F.sum("closed").over(so_far).cast("long").alias("closed_total"),
        F.try_divide("edits", "closed").alias("avg_size"),
        F.try_divide(F.sum("edits").over(so_far), F.sum("closed").over(so_far)).alias("avg_size_total"),
        F.try_divide("refs", "closed").alias("avg_references"),
    )


def flows(prefs: DataFrame, spine: DataFrame) -> DataFrame:
    """(step, domain, out_weight, in_weight): how often a domain was replaced and preferred so far, from its first pair on."""
    ends = prefs.select("step", F.col("src").alias("domain"), F.col("weight").alias("o"), F.lit(0).cast("long").alias("i")).unionByName(
        prefs.select("step", F.col("dst").alias("domain"), F.lit(0).cast("long").alias("o"), F.col("weight").alias("i"))
    )
    by = ends.groupBy("step", "domain").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    sums = accumulated(by, ["domain"], ["o", "i"])
    return spread(sums, spine).select("step", "domain", F.col("o").alias("out_weight"), F.col("i").alias("in_weight"))


def discard_steps(steps: int, step_days: float, every_days: float) -> list[int]:
    """Steps at which rare domains are discarded: their end lies more than every_days after the start of the last such step."""
    out, last = [], 0.0
    for t in range(steps):
        if (t + 1) * step_days - last > every_days:
            out.append(t)
            last = t * step_days
    return out


def domain_counts(signed: DataFrame, spine: DataFrame, marks: Sequence[int], least: int = 1) -> DataFrame:
    """(step, domain, count, creates): net and created references so far; at each mark domains with a count of ``least`` or less start again from nothing.

    signed has step, domain, d and c. One array of steps per domain, folded in order.
    """
    n = spine.count()
    by = signed.groupBy("domain", "step").agg(F.sum("d").alias("d"), F.sum("c").alias("c"))
    by = by.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("step", F.struct("d", "c")))).alias("m"))
    at_mark = F.array(*(F.lit(int(m)) for m in marks)) if marks else F.array().cast("array<int>")
    zero = F.lit(0).cast("long")

    def fold(acc: Column, t: Column) -> Column:
        last, move = F.try_element_at(acc, F.lit(-1)), F.try_element_at(F.col("m"), t.cast("long"))
        s, c = (F.coalesce(last[x], zero) + F.coalesce(move[x], zero) for x in ("d", "c"))
        gone = F.array_contains(at_mark, t) & (s <= least)
        return F.concat(acc, F.array(F.struct(F.when(gone, zero).otherwise(s).alias("d"), F.when(gone, zero).otherwise(c).alias("c"))))

    start = F.array().cast("array<struct<d:bigint,c:bigint>>")
    folded = by.select("domain", F.posexplode(F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, fold)).alias("step", "v"))
    return folded.select(F.col("step").cast("long").alias("step"), "domain", F.col("v.d").alias("count"), F.col("v.c").alias("creates")).where("count <> 0 or creates <> 0")


def domain_fractions(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """Per step and domain: count and fraction of all references, tail included; totals has step and value."""
    return kept.join(totals, "step").select("step", "domain", "count", F.try_divide("count", "value").alias("fraction"))


def tail(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """Per step: total, what the discarded domains hold, and its fraction."""
    held = kept.groupBy("step").agg(F.sum("count").alias("held"))
    rest = F.col("value") - F.coalesce("held", F.lit(0))
    return totals.join(held, "step", "left").select("step", F.col("value").alias("total"), rest.alias("tail"), F.try_divide(rest, "value").alias("tail_fraction"))


def supermajority(flow: DataFrame, mass: DataFrame, majority: float = 0.6, threshold: float = 0.05, cap: float | None = None) -> DataFrame:
    """(step, domain, mass, class) of the domains with evidence enough: dominated, dominating or contested, in this order."""
    total = F.col("out_weight") + F.col("in_weight")
    need = threshold * F.col("mass") if cap is None else F.least(threshold * F.col("mass"), F.lit(cap))
    kind = F.when(F.col("out_weight") >= majority * total, "dominated").when(F.col("in_weight") >= majority * total, "dominating").otherwise("contested")
    rows = flow.join(mass, ["step", "domain"]).where((total > 0) & (F.col("mass") > 0) & (total >= need))
    return rows.select("step", "domain", "mass", kind.alias("class"))


def class_fractions(classes: DataFrame, mass: DataFrame) -> DataFrame:
    """(step, class, fraction) of all mass, with 'unclassified' for the rest."""
    total = mass.groupBy("step").agg(F.sum("mass").alias("total"))
    share = F.when(F.col("total") > 0, F.col("m") / F.col("total")).otherwise(0.0)
    by = classes.groupBy("step", "class").agg(F.sum("mass").alias("m")).join(total, "step").select("step", "class", share.alias("fraction"))
    rest = total.select("step").join(by.groupBy("step").agg(F.sum("fraction").alias("f")), "step", "left")
    return by.unionByName(rest.select("step", F.lit("unclassified").alias("class"), F.greatest(F.lit(0.0), 1 - F.coalesce("f", F.lit(0.0))).alias("fraction")))


#: What a class is written as. Unclassified is off the axis from dominated to dominating.
CLASS_VALUES = {"dominated": -1, "contested": 0, "dominating": 1, "unclassified": 2}


def top_classes(classes: DataFrame, mass: DataFrame, k: int = 1000) -> DataFrame:
    """Top k domains by mass per step, ties by name, with their class as a number (CLASS_VALUES)."""
    rank = F.row_number().over(Window.partitionBy("step").orderBy(F.desc("mass"), "domain"))
    top = mass.withColumn("rank", rank).where(F.col("rank") <= k)
    code = F.lit(CLASS_VALUES["unclassified"])
    for name in ("dominated", "contested", "dominating"):
        code = F.when(F.col("class") == name, CLASS_VALUES[name]).otherwise(code)
    return top.join(classes.drop("mass"), ["step", "domain"], "left").select("step", "domain", "mass", "rank", code.alias("class_value"))


def flow_wilson(flow: DataFrame, mass: DataFrame, creates: DataFrame, majority: float = 0.7, lam: float = 1.0, z: float = 1.645, clamp: float = 0.02) -> DataFrame:
    """Classes by Wilson bounds of the replaced share, with the sample thinned by a design effect and the bar raised by exposure.

    Every domain that was replaced or preferred counts; without mass or creations these are 0. The null share of a domain is its share of mass against
    its share of creations, each with 1 / (domains of the step) added. A mass below 0 counts as 0 there.
    """
    of_step = Window.partitionBy("step")
    rows = flow.join(mass, ["step", "domain"], "left").join(creates, ["step", "domain"], "left").na.fill(0, ["mass", "creates"]).where(F.col("out_weight") + F.col("in_weight") > 0)
    held = F.greatest(F.col("mass"), F.lit(0.0))

    def share(x: Column) -> Column:
        total = F.sum(x).over(of_step)
        return F.when(total > 0, x / total).otherwise(0.0) + F.lit(1.0) / F.count("*").over(of_step)

    rows = rows.withColumns(
        {
            "total": F.col("out_weight") + F.col("in_weight"),
            "deff": 1 + lam * F.log1p(held / 1000),
            "mass_share": share(held),
            "create_share": share(F.col("creates").cast("double")),
        }
    )
    rows = rows.withColumn("p0", F.greatest(F.lit(clamp), F.least(F.lit(1 - clamp), F.col("mass_share") / (F.col("mass_share") + F.col("create_share")))))
    rows = rows.withColumn("bar", F.greatest(F.col("p0") * majority / (F.col("p0") * majority + (1 - F.col("p0")) * (1 - majority)), F.lit(majority)))
    low, high = wilson(F.col("out_weight") / F.col("deff"), F.col("total") / F.col("deff"), z)
    rows = rows.withColumns({"low": low, "high": high})
    kind = F.when(F.col("high") <= 1 - majority, "dominating").when(F.col("low") >= F.col("bar"), "dominated").otherwise("contested")
    return rows.select("step", "domain", "mass", "deff", "p0", "bar", "low", "high", kind.alias("class"))


def wilson_diagnostics(classes: DataFrame, majority: float = 0.7) -> DataFrame:
    """Per step: median design effect, mass-weighted means of it and of the interval's width, and raised bars."""
    m = F.sum("mass")
    return classes.groupBy("step").agg(
        F.percentile("deff", F.lit(0.5)).alias("median_deff"),
        F.try_divide(F.sum(F.col("mass") * F.col("deff")), m).alias("mean_deff"),
        F.try_divide(F.sum(F.col("mass") * (F.col("high") - F.col("low"))), m).alias("mean_width"),
        F.count_if(F.col("bar") > majority).alias("raised"),
    )
