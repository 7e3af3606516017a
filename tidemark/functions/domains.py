"""References and their domains."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INVALID = "__INVALID_URL__"
#: Prefixes of references that count, and the buckets of identifiers.
PREFIXES = ("Q", "http", "www", "ISBN", "PMID", "DOI")
BUCKETS = ("ISBN", "PMID", "DOI")


def normalize_reference(raw: Column) -> Column:
    return F.replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r'^"+|"+$', ""), F.lit(" "), F.lit("%20"))


def counts(reference: Column) -> Column:
    return reference.rlike("^(" + "|".join(PREFIXES) + ")")


def host_of(reference: Column) -> Column:
    """Lower-case host without user and port; '' where there is none."""
    url = F.when(reference.startswith("www"), F.concat(F.lit("//"), reference)).otherwise(reference)
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1)
    return F.lower(F.rtrim(host, F.lit(".")))


@lru_cache(maxsize=1)
def _list_text(path: str | None) -> str:
    if path:
        with open(path, encoding="utf8") as f:
            return f.read()
    spark = SparkSession.getActiveSession()
    jvm = spark._jvm  # the list that ships with Spark's HTTP client
    stream = jvm.java.lang.Thread.currentThread().getContextClassLoader().getResourceAsStream("mozilla/public-suffix-list.txt")
    if stream is None:
        return "com\nnet\norg\n"
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def suffix_rules(path: str | None = None) -> frozenset[str]:
    """Rules of the list's ICANN section (without it, of the whole list)."""
    lines = _list_text(path).splitlines()
    begin, end = "===BEGIN PRIVATE DOMAINS===", "===END PRIVATE DOMAINS==="
    private, out = False, set()
    for line in lines:
        private = begin in line or private and end not in line
        rule = line.split()[0] if line.split() else ""
        if rule and not rule.startswith("//") and not private:
            out.add(rule)
    return frozenset(out)


def registrable(host: str, rules: frozenset[str]) -> str:
    labels = host.split(".")
    if not host or len(labels) < 2 or "" in labels or all(x.isdigit() for x in labels):
        return INVALID
    for k in range(len(labels)):
        rest = ".".join(labels[k:])
        wild = ".".join(["*", *labels[k + 1 :]])
        if "!" + rest in rules:
            return rest
        if rest in rules or wild in rules and len(labels) - k > 1:
            return ".".join(labels[k - 1 :]) if k else INVALID
    return INVALID


def with_domain(rows: DataFrame, column: str = "reference", suffix_list: str | None = None) -> DataFrame:
    """Adds domain. The suffix rule is looked up once per distinct host; the list is of fixed size."""
    rules = rows.sparkSession.sparkContext.broadcast(suffix_rules(suffix_list))

    @F.pandas_udf("string")
    def lookup(hosts: pd.Series) -> pd.Series:
        return hosts.map(lambda h: registrable(h, rules.value))

    ref = normalize_reference(F.col(column))
    web = ref.startswith("http") | ref.startswith("www")
    named = rows.withColumn("_host", F.when(web, host_of(ref)))
    hosts = named.select("_host").where("_host is not null").distinct().withColumn("_domain", lookup("_host"))
    bucket = F.coalesce(*(F.when(ref.startswith(b), b) for b in BUCKETS), ref)
    return named.join(hosts, "_host", "left").withColumn("domain", F.when(web, F.col("_domain")).otherwise(bucket)).drop("_host", "_domain")
