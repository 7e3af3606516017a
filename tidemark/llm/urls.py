"""URL filter: host/path rules first, then a character language-model ratio.

Two smoothed Markov models of variable order over a folded alphabet, one of accepted
and one of rejected URLs, score what no rule decides. A context of up to ``ORDER`` symbols acts where its class has met it ``ENOUGH``
times; each order is smoothed by the one below it (Witten-Bell), down to single symbols. All labelled URLs are counted.
The verdict compares the length-normalised log-likelihood difference with a
threshold. That is calibrated out of sample: labelled URLs are dealt to two halves by hash, and each half is scored by
models of the other. Only DataFrame functions are used.

Weights of the grams that occur meet the URLs' grams in a join. Grams that make up over 1 / HOT of all positions, at most HOT by
that, are broadcast; the others are shuffled, and none of them is frequent. Weights are whole numbers, so sums don't depend on their order.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits
no rule and gets the method's verdict of its text (null: of the empty text). An empty text
scores 0. Without labelled URLs of both kinds the models agree and everything scores 0;
a score equal to the threshold is allowed. Repeated rows are judged alike; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The folded alphabet. 0 stands for any other character, 1 for the start of a URL.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-?&=_:%#"
SYMBOLS = len(ALPHABET) + 2
ORDER = 4
ENOUGH = 4
HOT = 1 << 16
UNIT = 1e9  # weights are whole numbers of 1 / UNIT
BINS = 4096
SPAN = 8.0  # scores are per character, so within +- log(probability ratio); beyond it they share a bin


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(
        F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds host, path, rule and rule_verdict; the longest rule that fits wins."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def codes(url: Column) -> Column:
    """The URL as symbols, after ORDER start symbols."""
    letters = F.split(F.lower(F.coalesce(url, F.lit(""))), "")
    known = F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c) + 1).otherwise(0))
    return F.concat(F.array_repeat(F.lit(1), ORDER), known)


def grams(c: Column) -> Column:
    """A number for each (ORDER symbols of context, symbol); its last k + 1 digits to the base SYMBOLS are that of order k."""

    def gram(i: Column) -> Column:
        return sum((F.get(c, i + k).cast("long") * SYMBOLS ** (ORDER - k) for k in range(ORDER + 1)), F.lit(0).cast("long"))

    return F.transform(F.slice(c, F.lit(ORDER + 1), F.greatest(F.size(c) - ORDER, F.lit(0))), lambda _, i: gram(i))


def counted(labelled: DataFrame) -> DataFrame:
    """(model, g, a, b): how often a gram comes in accepted and in rejected URLs of a half (models 0 and 1) or of both (model 2).

    labelled has grams, verdict and half. Counts are added up before they are shuffled.
    """
    each = labelled.select("half", "verdict", F.explode("grams").alias("g")).groupBy("half", "g")
    halves = each.agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    return halves.select(F.explode(F.array("half", F.lit(2))).alias("model"), "g", "a", "b").groupBy("model", "g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def weighed(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, w0, w1, w2): each wanted gram's log P(accepted) - log P(rejected) by each model, in units of 1 / UNIT."""
    n = SYMBOLS
    now = wanted.select("g", F.explode(F.array(*(F.lit(m) for m in range(3)))).alias("model")).withColumns({"pa": F.lit(1.0 / n), "pb": F.lit(1.0 / n), "both": F.lit(False)})
    for k in range(ORDER + 1):
        own = counts.groupBy("model", F.pmod("g", F.lit(n ** (k + 1))).alias("own")).agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
        context = own.groupBy("model", F.expr(f"own div {n}").alias("context")).agg(
            F.sum("ca").alias("na"), F.sum("cb").alias("nb"), F.count_if(F.col("ca") > 0).alias("da"), F.count_if(F.col("cb") > 0).alias("db")
        )
        now = now.withColumn("own", F.pmod("g", F.lit(n ** (k + 1)))).withColumn("context", F.expr(f"own div {n}"))
        now = now.join(own, ["model", "own"], "left").join(context, ["model", "context"], "left")

        def step(v: str, least: int) -> Column:
            below, c, m, d = F.col(f"p{v}"), F.coalesce(f"c{v}", F.lit(0)), F.coalesce(f"n{v}", F.lit(0)), F.coalesce(f"d{v}", F.lit(0))
            return F.when(m >= least, (c + d * below) / (m + d)).otherwise(below)

        both = (F.coalesce("na", F.lit(0)) > 0) & (F.coalesce("nb", F.lit(0)) > 0) if k == 0 else F.col("both")
        least = ENOUGH if k else 1
        now = now.select("g", "model", step("a", least).alias("pa"), step("b", least).alias("pb"), both.alias("both"))
    w = F.when(F.col("both"), F.round((F.log("pa") - F.log("pb")) * UNIT)).otherwise(0.0).cast("long")
    return now.groupBy("g").agg(*(F.max(F.when(F.col("model") == m, w)).alias(f"w{m}") for m in range(3)))


def with_scores(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds score and held (by the other half's models): log-likelihood differences per character. rows has row, half and grams."""
    from tidemark.llm.storage import saved

    places = rows.select("row", F.explode("grams").alias("g"))
    often = places.groupBy("g").agg(F.count("*").alias("n"))
    total = often.agg(F.sum("n").alias("n"))
    frequent = saved(often.where(F.col("n") * HOT > total.scalar()).join(weights, "g").select("g", F.struct("w0", "w1", "w2").alias("hot")).coalesce(1), "hot-grams")
    known = places.join(F.broadcast(frequent), "g", "left")  # at most HOT rows
    found = known.where("hot is not null").select("row", "hot.*").unionByName(known.where("hot is null").select("row", "g").join(weights, "g").select("row", "w0", "w1", "w2"))
    sums = found.groupBy("row").agg(F.count("*").alias("n"), *(F.sum(f"w{m}").alias(f"s{m}") for m in range(3)))
    held = F.when(F.col("half") == 0, F.col("s1")).otherwise(F.col("s0"))
    joined = rows.drop("grams").join(sums, "row", "left")
    return joined.withColumn("score", F.coalesce(F.col("s2") / F.col("n") / UNIT, F.lit(0.0))).withColumn("held", F.coalesce(held / F.col("n") / UNIT, F.lit(0.0))).drop("n", "s0", "s1", "s2")


def calibrate(scored: DataFrame) -> DataFrame:
    """One row: the threshold at which accepted and rejected labelled URLs are wrong equally often in sum.

    Balanced error over a histogram of BINS bins, so the work after counting is of fixed size.
    """
    width = 2 * SPAN / BINS
    binned = scored.select(
        "verdict", F.least(F.greatest(F.floor((F.col("score") + SPAN) / width), F.lit(0)), F.lit(BINS - 1)).alias("bin")
    ).groupBy("bin").agg(
        F.count_if(F.col("verdict") == "allow").cast("double").alias("a"), F.count_if(F.col("verdict") == "block").cast("double").alias("r")
    )
    spine = scored.sparkSession.range(BINS + 1).withColumnRenamed("id", "bin").join(binned, "bin", "left").na.fill(0.0)
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wrong = spine.select(
        "bin",
        (
            F.coalesce(F.sum("a").over(before), F.lit(0.0)) / F.greatest(F.sum("a").over(everything), F.lit(1.0))
            + (F.sum("r").over(everything) - F.coalesce(F.sum("r").over(before), F.lit(0.0))) / F.greatest(F.sum("r").over(everything), F.lit(1.0))
        ).alias("wrong"),
    )
    best = wrong.agg(F.min("wrong").alias("least"))
    # the middle of the bins that are equally good
    return wrong.where(F.col("wrong") == best.scalar()).agg((F.avg("bin") * width - SPAN).alias("threshold"))


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule, score and verdict of each row of pages."""
    from tidemark.llm.storage import saved

    # codes is a column of its own: within grams' lambda its expression would run once per character
    marked = with_rule(pages.select("page_id", "url", F.monotonically_increasing_id().alias("row")), rules).withColumn("codes", codes(F.col("url")))
    half = F.pmod(F.xxhash64("url"), F.lit(2)).cast("int")
    ruled = saved(marked.withColumn("half", half).withColumn("grams", grams(F.col("codes"))).drop("codes", "url"), "ruled-pages")
    labelled = ruled.where(F.col("rule").isNotNull()).select(F.col("rule_verdict").alias("verdict"), "half", "grams")
    counts = saved(counted(labelled), "url-counts")
    weights = saved(weighed(counts, ruled.select(F.explode("grams").alias("g")).distinct()), "url-model")
    scored = saved(with_scores(ruled, weights), "url-scores")
    held = scored.where(F.col("rule").isNotNull()).select(F.col("rule_verdict").alias("verdict"), F.col("held").alias("score"))
    threshold = saved(calibrate(held).coalesce(1), "url-threshold")
    chosen = F.when(F.col("score") >= threshold.scalar(), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", "score", F.coalesce("rule_verdict", chosen).alias("verdict"))
