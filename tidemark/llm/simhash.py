"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are compared in tiles with numpy: exclusive-or of a block of rows with a
tile, bit counts, hits within the radius. Two fingerprints that differ in at most r bits also
differ by at most r in their population counts, so tiles are made of like counts and a pair of
tiles whose counts lie further apart is skipped.

Comparing each tile with each other one would grow with the square of the corpus. The pairs
of tiles are therefore further limited to what can hold a pair at all: with the 64 bits in r + extra
bands, two fingerprints within r agree in at least ``extra`` of them, so tiles are only
compared within groups that share the same ``extra`` bands. This loses no pair. ``extra`` grows with
the number of fingerprints so that groups stay small; groups above ``TILE`` rows become several tiles.

Each comparison returns a spanning forest of what it linked, not all pairs, so a group of n near
copies gives fewer than n links. Exact copies share one fingerprint.

Defined results: a null text is an empty one; texts without words have fingerprint zero and are linked like any
other; repeated rows share a component; a null id never is a component's name unless all its ids are null;
an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.storage import saved
from tidemark.llm.wordids import slices

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
TILE = 1024
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = 4) -> int:
    """Bits set in over half the hashes of the text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = WORDS.findall((text or "").encode().translate(UPPER))
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    ends = starts[width:] - 1
    starts = starts[: len(ends)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(ends), BLOCK):
        h = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) per row of docs; fp is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fp = np.array([fingerprint(t, width) for t in part["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def forest(fp: np.ndarray, other: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect whatever lies within radius in fp (or between fp and other): a spanning forest.

    Rows are in order of their bit counts, so each block meets only the rows whose counts are near.
    """
    both = fp if other is None else np.concatenate([fp, other])
    ones = np.bitwise_count(both)
    order = np.argsort(ones, kind="stable")
    both, ones = both[order], ones[order]
    parent = list(range(len(both)))
    side = order < len(fp)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    step = 128
    for k in range(0, len(both), step):
        rows = both[k : k + step]
        end = int(np.searchsorted(ones, int(ones[min(k + step, len(both)) - 1]) + radius, "right"))
        near = np.bitwise_count(rows[:, None] ^ both[None, k:end]) <= radius
        if other is not None:  # links within one tile are another comparison's
            near &= side[k : k + len(rows), None] != side[None, k:end]
        near &= np.arange(end - k)[None, :] > np.arange(len(rows))[:, None]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            a = root(k + i)
            for j in (np.flatnonzero(near[i]) + k).tolist():
                b = root(j)
                if a != b:
                    parent[b] = a
                    links.append((int(both[k + i]), int(both[j])))
    return links


def _bands(n: int, radius: int) -> list[tuple[int, ...]]:
    """Groups of bit places; any two fingerprints within radius agree on all places of one group."""
    extra = 1
    while extra < radius and n * 64 > TILE << int(64 * extra / (radius + extra)):
        extra += 1
    cuts = np.linspace(0, 64, radius + extra + 1).astype(int).tolist()
    bands = [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [tuple(p for band in some for p in band) for some in combinations(bands, extra)]


def _mask(places: tuple[int, ...]) -> Column:
    value = sum(1 << p for p in places)
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value)


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all that lie within radius."""
    groups = _bands(distinct.count(), radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(_mask(g)) for g in groups))).alias("g", "v"))
    # how many rows of each bit count a group has: at most 65 numbers a group
    cells = keyed.groupBy("g", "v", F.bit_count("fp").alias("p")).agg(F.count("*").alias("n"))
    sizes = cells.groupBy("g", "v").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("n"))
    rows = keyed.join(sizes.where("all > 1"), ["g", "v"]).withColumn("p", F.bit_count("fp"))
    # a small group is one tile; a larger one has tiles by bit count, and by hash where one count has too many
    whole = F.col("all") <= TILE

    def parts(n: Column) -> Column:
        return F.ceil(n / TILE).cast("int")

    tile_p = F.when(whole, F.lit(-1)).otherwise(F.col("p"))
    tile_s = F.when(whole, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), parts(F.try_element_at("n", F.col("p")))).cast("int"))
    tiles = (
        rows.select("g", "v", "fp", "n", tile_p.alias("p"), tile_s.alias("s"))
        .groupBy("g", "v", "p", "s")
        .agg(F.collect_list("fp").alias("fps"), F.first("n").alias("n"))
    )
    # a tile meets itself, and the later tiles of counts up to radius above its own; both sides of a meeting name it alike
    apart = F.array(*(F.lit(d) for d in range(-radius, radius + 1)))
    others = F.flatten(
        F.transform(
            apart,
            lambda d: F.transform(
                F.array_repeat(F.lit(0), parts(F.coalesce(F.try_element_at("n", F.col("p") + d), F.lit(0)))),
                lambda _, s: F.struct((F.col("p") + d).alias("p"), s.alias("s")),
            ),
        )
    )
    own = F.struct(F.col("p").alias("p"), F.col("s").alias("s"))
    partners = F.when(F.col("p") < 0, F.array(own)).otherwise(others)
    meetings = (
        tiles.select("g", "v", own.alias("own"), "fps", F.explode(partners).alias("other"))
        .select("g", "v", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "fps")
        .groupBy("g", "v", "x", "y")
        .agg(
            F.max(F.when(F.col("own") == F.col("x"), F.col("fps"))).alias("left"),
            F.max(F.when((F.col("own") == F.col("y")) & (F.col("x") != F.col("y")), F.col("fps"))).alias("right"),
        )
        .select("left", "right")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for left, right in zip(batch["left"], batch["right"], strict=True):
                a = left.values.to_numpy().view(np.uint64) if left.is_valid else np.zeros(0, np.uint64)
                b = right.values.to_numpy().view(np.uint64) if right.is_valid else None
                found += forest(a, b, radius)
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    return meetings.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) per row of docs."""
    marks = saved(fingerprints(docs, width), "fingerprints")
    distinct = saved(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    groups = components(links(distinct.select("fp"), radius))
    named = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    names = named.join(least, "component").select("fp", "component_id")
    return marks.join(names, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
