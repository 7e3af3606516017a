"""Shards by extendible hashing.

A directory maps prefixes of a row's 64-bit hash to buckets. From a single bucket on, only buckets above the byte limit split on
the next bit, until each fits. All of this
works on bytes per hash prefix, counted before they are shuffled, so no bucket's rows ever meet in one task
to be split; depths at which every bucket is far above the limit are passed over, as none of them can be the end. Rows are then dealt by bucket and written, one folder per bucket.

The hash covers id and text. Rows that are alike in both share it; where such rows alone pass the limit,
bits of their place in the input follow after the hash's own. Rows are written with these bits once, so that no later scan gives them others.

Defined results: a null text has 0 bytes; a row above the limit gets a shard of its own and ``fits`` is false; null ids and repeated
rows are rows like others; an empty table gives no shard; the rows' own columns travel in one struct (``doc``), so their names don't matter, and their bytes don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tidemark.llm.storage import new_path, packed, saved

LIMIT = 32 << 20
STEP = 8
BITS = 128
MOST_TASKS = 20_000
ABOVE = 4
SMALL = 1 << 18  # buckets that may be broadcast


def _hashed(docs: DataFrame) -> DataFrame:
    """bits, bytes and doc (a struct of the row) of each row."""
    same, own = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.xxhash64(F.monotonically_increasing_id())
    bits = F.concat(F.lpad(F.bin(same), 64, "0"), F.lpad(F.bin(own), 64, "0"))
    return docs.select(bits.alias("bits"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), packed(docs))


def directory(sized: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(prefix, bytes, rows, fits) of the buckets; sized has bits and bytes.

    Several bits are settled at a time: bytes per longer prefix are added up to each of the shorter
    prefixes, and a bucket ends at the first prefix that fits. What doesn't fit at the longest goes on.
    """
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    about = max(0, (-(-total // limit) - 1).bit_length())
    found, open_, depth, deeper = None, sized, max(0, about - ABOVE), min(about + STEP, BITS)
    while True:
        cells = saved(open_.groupBy(F.substring("bits", F.lit(1), F.lit(deeper)).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")), "cells")
        if found is None and depth and cells.groupBy(F.substring("cell", F.lit(1), F.lit(depth)).alias("p")).agg(F.sum("bytes").alias("n")).where(F.col("n") <= limit).take(1):
            depth = 0  # a bucket fits where none was thought to: look from the root on
        levels = (
            cells.select("bytes", "rows", "cell", F.explode(F.sequence(F.lit(depth), F.lit(deeper))).alias("d"))
            .groupBy("d", F.substring("cell", F.lit(1), F.col("d")).alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        )
        parent = F.substring("prefix", F.lit(1), F.col("d") - 1)
        above = levels.select(F.col("d").alias("pd"), F.col("prefix").alias("pp"), F.col("bytes").alias("pn"), F.col("rows").alias("pr"))
        known = levels.withColumn("pp", F.when(F.col("d") > depth, parent)).withColumn("pd", F.col("d") - 1)
        full = known.join(above, ["pd", "pp"], "left")
        split = F.col("d").eqNullSafe(F.lit(depth)) | ((F.col("pn") > limit) & (F.col("pr") > 1))
        fits = (F.col("bytes") <= limit) | (F.col("rows") == 1)
        last = F.col("d") == deeper
        state = saved(full.where(split).select("prefix", "bytes", "rows", fits.alias("ends"), last.alias("last"), (F.col("bytes") <= limit).alias("fits")), "levels")
        done = state.where(F.col("ends") | F.lit(deeper == BITS) & F.col("last")).select("prefix", "bytes", "rows", "fits")
        found = done if found is None else found.unionByName(done)
        rest = state.where(~F.col("ends") & F.col("last")).select(F.col("prefix").alias("open"))
        if deeper == BITS or not rest.take(1):
            return found
        open_ = sized.join(rest, F.substring("bits", F.lit(1), F.lit(deeper)) == F.col("open"), "left_semi")
        depth, deeper = deeper, min(deeper + STEP, BITS)


def assign(docs: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, int]:
    """doc, shard (the bucket's hash prefix), shard_bytes and fits per row of docs; and how many tasks should write them."""
    hashed = saved(_hashed(docs), "hashed")
    buckets = saved(directory(hashed.select("bits", "bytes"), limit), "directory")
    by_depth = buckets.groupBy(F.length("prefix").alias("d")).count().collect()  # at most BITS rows
    depths, count = sorted(r["d"] for r in by_depth), sum(r["count"] for r in by_depth)
    out = hashed
    for d in depths:  # a row is in one bucket only; two or three depths are in use as a rule
        at = buckets.where(F.length("prefix") == d).select(F.col("prefix").alias(f"p{d}"), F.struct("prefix", "bytes", "fits").alias(f"b{d}"))
        at = F.broadcast(at) if count <= SMALL else at.hint("merge")
        out = out.join(at, F.substring("bits", F.lit(1), F.lit(d)) == F.col(f"p{d}"), "left").drop(f"p{d}")
    found = F.coalesce(*(F.col(f"b{d}") for d in depths)) if depths else F.lit(None).cast("struct<prefix:string,bytes:bigint,fits:boolean>")
    named = out.withColumn("found", found).select("doc", F.col("found.prefix").alias("shard"), F.col("found.bytes").alias("shard_bytes"), F.col("found.fits").alias("fits"))
    return named, max(1, min(count, MOST_TASKS))


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes docs to path, a folder ``shard=...`` per bucket, with each row in the column doc."""
    named, parts = assign(docs, limit)
    named = named.withColumn("shard", F.concat(F.lit("b"), "shard"))  # a folder's name can't be empty
    named.repartition(parts, "shard").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def sharded(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, shard, doc_bytes, shard_bytes and fits of each row, as read back from the written shards."""
    spark = docs.sparkSession
    path = new_path(spark, "shards")
    write(docs, path, limit)
    schema = StructType([StructField("doc", docs.schema), StructField("shard_bytes", LongType()), StructField("fits", BooleanType()), StructField("shard", StringType())])
    back = spark.read.option("basePath", path).schema(schema).parquet(path)
    return back.select("doc.doc_id", F.substring("shard", 2, BITS).alias("shard"), F.coalesce(F.octet_length("doc.text"), F.lit(0)).cast("long").alias("doc_bytes"), "shard_bytes", "fits")
