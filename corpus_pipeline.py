"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and rereads as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, minhash, mixing, quality, simhash, substring
from tidemark.llm.components import components
from tidemark.llm.queries import word_vocabulary
from tidemark.llm.storage import Tables, packed, saved

ORACLE_SQL = None  # the stages go beyond SQL; tests/llm hold them against brute force


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the weakly supervised rules keep."""
    return quality.judge(docs).where("kept").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of the smallest id, of equal ids that of the smaller hash of its text.

    Near are fingerprints within operator 1's radius, and texts whose five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    # rows get their number once, with the text beside it
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.xxhash64("text").alias("mark"), packed(docs, "text")), "rows")
    marks = simhash.near_duplicates(rows.select(F.struct("doc_id", "row").alias("doc_id"), "text"))
    same = marks.select(F.col("doc_id.row").alias("a"), F.col("component_id.row").alias("b"))
    groups = components(same.unionByName(minhash.near_links(rows)))
    named = rows.select("doc_id", "mark", "row").join(groups.hint("merge"), F.col("row") == F.col("node"), "left")
    # as many rows as documents, whatever an estimate says
    kept = named.groupBy(F.coalesce("component", "row").alias("c")).agg(F.min(F.struct("doc_id", "mark", "row")).alias("k")).select("k.row").hint("merge")
    return rows.join(kept, "row", "left_semi").select(*(F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document has."""
    return substring.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to the target weights: a row per slot of the mix and document in it, shard by shard."""
    return mixing.documents(mixing.mixed(docs), docs.columns)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of their decoding."""
    return bpe.round_trip(docs.select("doc_id", "text"), word_vocabulary())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_working = Tables()


def lean(stage: Stage) -> Stage:
    """The stage for callers that write each result before they call the next stage: tables that earlier calls of
    these stages worked on go, but for those that docs reads. Only such tables go."""

    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _working.release(spark, keep=docs)
        with _working:
            return stage(spark, docs, sf_dir)

    return call


STEPS: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("bpe_round_trip", bpe_round_trip),
]
STAGES: list[tuple[str, Stage]] = [(name, lean(stage)) for name, stage in STEPS]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A run has tables of its own, and drops what no later stage reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    results = Tables()
    for name, stage in STEPS[:-1]:
        working = Tables()
        with working:
            out = stage(spark, docs, sf_dir)
        with results:
            docs = saved(out, name)
        working.release(spark)
        results.release(spark, keep=docs)
    return STEPS[-1][1](spark, docs, sf_dir)
