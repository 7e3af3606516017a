"""Near copies of whole texts: MinHash bands, then the exact Jaccard similarity of five-word shingles.

Texts of equal words are one class. With BANDS bands of ROWS values a pair at similarity 0.8 meets with probability 0.998.
What meets is compared exactly, so no pair below the wanted similarity is linked. Texts of fewer than five words have no
shingles and are left to their fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import substring
from tidemark.llm.storage import saved
from tidemark.llm.wordids import slices

BANDS, ROWS = 9, 3
BLOCK = 1 << 15
FACTORS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)


def band_keys(h: np.ndarray) -> np.ndarray:
    """The keys of a text's shingle hashes, one a band."""
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), BLOCK):
        low = np.minimum(low, (h[k : k + BLOCK, None] * FACTORS).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = substring._mix(key * np.uint64(0x94D049BB133111EB) + low[r::ROWS])
    return key


def found(rows: DataFrame) -> DataFrame:
    """(row, h, keys) per text of rows (row, text) with a shingle; h is a hash of its words in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for part in slices(batches, "text"):
            rows, hs, keys = [], [], []
            for row, text in zip(part["row"].to_pylist(), part["text"].to_pylist(), strict=True):
                h = substring.shingle_hashes(substring.words_in(text or "", lower=True))
                if len(h):
                    rows.append(row)
                    hs.append(xxh64_intdigest(h.tobytes()))
                    keys.append(band_keys(h).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()),
                    pa.array(np.array(hs, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))),
                ],
                ["row", "h", "keys"],
            )

    return rows.select("row", "text").mapInArrow(run, "row long, h long, keys array<long>")


def near_links(rows: DataFrame, like: float = 0.8) -> DataFrame:
    """(a, b): rows of rows (row, text; row a number of its own) that connect all whose shingles are alike enough."""
    marks = saved(found(rows), "texts")
    first = saved(marks.groupBy("h").agg(F.min("row").alias("first")), "equal-texts")
    one = marks.join(first.select(F.col("first").alias("row")), "row", "left_semi")  # of equal texts one is compared

    def payload(asked: DataFrame) -> DataFrame:
        wanted = first.join(asked, "h", "left_semi").select("h", F.col("first").alias("row"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"))
        return substring.numbers_of(rows, wanted, lambda text: np.unique(substring.shingle_hashes(substring.words_in(text, lower=True))), None)

    def compare(left: pa.StructArray, right: pa.StructArray | None) -> list[tuple[int, int]]:
        def sets(x: pa.StructArray) -> list[np.ndarray]:
            numbers = x.field("numbers")
            ends = numbers.offsets.to_numpy()
            flat = numbers.values.to_numpy()
            return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

        near = substring.similar(sets(left), None if right is None else sets(right), like)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out, shift = [], 0 if right is None else len(left)
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            a, b = root(i), root(j + shift)
            if a != b:
                parent[b] = a
                out.append((i, j))
        return out

    keyed = one.select("h", F.explode("keys").alias("key"))
    pairs = substring.links(keyed, payload, lambda left, right: substring.by_group(left, right, compare))
    near = pairs.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return near.unionByName(marks.join(first, "h").where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b")))
