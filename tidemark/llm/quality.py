"""Quality rules combined by weak supervision.

Each rule votes good, bad or abstains. Votes are counted by pattern: with R rules there are
at most 3 ** R patterns whatever the input's size, and only these counts reach the
driver. Expectation-maximisation on them estimates how each rule votes on good and on bad documents and the share of good
documents; the posterior probability of a document is then one expression of its votes. Nothing but the
majority of the votes says at the start which documents are good, so a rule that goes against the others loses its weight.
Only DataFrame functions are used.

Defined results: a null text is an empty one; a text without words fails the base rule;
repeated rows are judged alike; an empty table gives an empty result; the given columns travel in one
struct, so whatever their names are they stay as they were.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import packed, saved

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
WEIGHT = 1.0  # of the prior on every probability, in documents
#: Common short words of English, German, French and Spanish.
COMMON = (
    "a al and at au das de del den der des die du el en et for in is la las le les los mit of on por que se the to un una und une"
    " von was with y zu"
).split()


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def window_hashes(w: Column) -> Column:
    """A 64-bit hash of each WINDOW-word window of the array w, which must be a column."""
    return F.when(
        F.size(w) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))


def placed_repeats(h: Column) -> Column:
    """(hash, place) in order; none for the many texts whose hashes are all distinct."""
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(
        F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    )


def repeated_places(placed: Column) -> Column:
    """Places, in order, of windows with an equal neighbour in the column placed."""

    def same(k: Column, x: Column) -> Column:
        return F.coalesce(F.get(placed, k)["h"] == x["h"], F.lit(False))

    marked = F.transform(placed, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"]))
    return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))


def covered_words(places: Column) -> Column:
    """Words in the windows that begin at places."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )


def measured(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """doc (a struct of the columns to carry) and the counts that rules are made of."""
    text = F.col("body")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return (
        docs.select(packed(docs.select(*(F.col(f"`{c}`") for c in carry))), F.coalesce("text", F.lit("")).alias("body"))
        .withColumn("w", words(text))
        .withColumn("lines", lines)
        .withColumn("windows", window_hashes(F.col("w")))
        .withColumn("placed", placed_repeats(F.col("windows")))
        .select(
            "doc",
            F.size("w").cast("long").alias("n_words"),
            (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            covered_words(repeated_places(F.col("placed"))).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
            F.size(F.filter("w", lambda x: x.isin(*COMMON))).cast("long").alias("n_common"),
            F.size(F.filter("w", lambda x: F.substring(x, -1, 1).isin(".", "!", "?"))).cast("long").alias("n_ends"),
            F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", "")).cast("long").alias("n_marks"),
            F.regexp_count(text, F.lit("[0-9]")).cast("long").alias("n_digits"),
        )
    )


class Rule(NamedTuple):
    """Votes good where value <= good, bad where value > bad, else abstains; null abstains."""

    name: str
    value: Column
    good: float
    bad: float


def share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def default_rules() -> list[Rule]:
    """Rules that overlap and err: none of them is enough to reject a document by itself."""
    length = share("word_chars", "n_words")
    return [
        Rule("symbols", share("n_symbols", "n_words"), 0.1, 0.25),
        Rule("marks", share("n_marks", "word_chars"), 0.06, 0.1),
        Rule("digits", share("n_digits", "word_chars"), 0.03, 0.1),
        Rule("common", -share("n_common", "n_words"), -0.1, -0.05),
        Rule("repeats", share("n_repeat_words", "n_words"), 0.02, 0.1),
        Rule("dup_lines", share("n_dup_lines", "n_lines"), 0.1, 0.3),
        Rule("distinct", -share("n_distinct", "n_words"), -0.6, -0.5),
        Rule("ends", -share("n_ends", "n_words"), -0.05, -0.03),
        Rule("short", -F.col("n_words"), -30.0, -15.0),
        Rule("long_words", length, 6.0, 7.0),
    ]


class Model(NamedTuple):
    """Natural logarithms. votes[r][v]: what vote v of rule r adds to the log odds of good."""

    prior: float
    votes: list[dict[int, float]]


def vote(rule: Rule) -> Column:
    return F.coalesce(F.when(rule.value <= rule.good, 1).when(rule.value > rule.bad, -1), F.lit(0)).cast("byte")


def expectation_maximisation(patterns: Sequence[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 2000) -> Model:
    """How each rule votes on good and on bad documents, from counts of vote patterns.

    A document's first probability is the share of good among its votes, with one vote for either side added. Each rule's
    votes on a class are a distribution over good, bad and abstain, as a bad document seldom breaks every rule. The prior is the
    same for all of them: WEIGHT documents for each vote and class.
    """
    chances = [(1 + v.count(1)) / (2 + v.count(1) + v.count(-1)) for v, _ in patterns]
    prior, tables = 0.0, [{v: 0.0 for v in (1, 0, -1)} for _ in range(n_rules)]
    for _ in range(rounds):
        n_good, n_bad = WEIGHT, WEIGHT
        good = [{v: WEIGHT for v in (1, 0, -1)} for _ in range(n_rules)]
        bad = [{v: WEIGHT for v in (1, 0, -1)} for _ in range(n_rules)]
        for (votes, count), p in zip(patterns, chances, strict=True):
            n_good += p * count
            n_bad += (1 - p) * count
            for r, v in enumerate(votes):
                good[r][v] += p * count
                bad[r][v] += (1 - p) * count
        prior = math.log(n_good / n_bad)
        tables = [{v: math.log(g[v] / sum(g.values())) - math.log(b[v] / sum(b.values())) for v in g} for g, b in zip(good, bad, strict=True)]
        odds = [prior + sum(t[v] for t, v in zip(tables, votes, strict=True)) for votes, _ in patterns]
        before, chances = chances, [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in odds]
        if max((abs(p - q) for p, q in zip(before, chances, strict=True)), default=0.0) < 1e-12:
            break
    return Model(prior, tables)


def fit(votes: DataFrame, n_rules: int) -> Model:
    """The model of a table with column votes."""
    rows = votes.groupBy("votes").count().collect()  # at most 3 ** n_rules rows
    return expectation_maximisation(sorted((tuple(r["votes"]), r["count"]) for r in rows), n_rules)


def posterior(votes: Column, model: Model) -> Column:
    """Probability that a document is good."""
    odds = F.lit(model.prior)
    for r, weights in enumerate(model.votes):
        v = F.get(votes, F.lit(r))
        odds = odds + F.when(v > 0, weights[1]).when(v < 0, weights[-1]).otherwise(weights[0])
    return 1 / (1 + F.exp(-odds))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, least: float = 0.5, rules: Sequence[Rule] | None = None, carry: Sequence[str] | None = None) -> DataFrame:
    """Per row of docs: doc (a struct of its columns, or of those to carry), the counts, votes, quality (posterior), base_failed and kept.

    The counts are taken once and written to the shared folder; votes are counted and
    judged from there.
    """
    rules = default_rules() if rules is None else rules
    counts = saved(measured(docs, docs.columns if carry is None else carry), "quality")
    votes = counts.withColumn("votes", F.array(*(vote(r) for r in rules)))
    model = fit(votes, len(rules))
    out = votes.withColumn("quality", posterior(F.col("votes"), model)).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
