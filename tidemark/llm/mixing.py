"""Mixing sources to target weights by blocks of words.

The words of each source's documents, end to end in a fixed order, are cut into blocks of
``block`` words. The mix is a number of output shards with ``slots`` block slots each. How many slots
of a shard go to which source is a multinomial draw given the totals that the targets ask for, so
that each source's sum is its target to within a block. The draws go down a binary tree of shard
ranges, each node seeded by its own number: any shard finds its own without the others. A source's
n-th slot takes block ``p(n mod blocks)``, where p is a pseudorandom permutation of its block numbers,
another one for each pass; where in its shard the slot is, is a permutation as well. Blocks and slots then meet in a join on
(source, block number), and ``mixed`` gives the words of each slot, shard by shard.

Only the table of sources (one row each) and of shards (a few numbers each) is as wide as one task;
offsets within a source come from sums by hash bucket of its distinct documents, and equal documents follow each other, so a source
or a document of any frequency is dealt over many tasks.

Defined results: a null text has size 0; a document of size 0 is never taken; a null source is a source of its
own, last in order; a null id is an id like any other; repeated rows are documents of their own; an empty table gives
an empty result; other columns travel in one struct, so whatever their names are they stay as they were.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.storage import packed, saved
from tidemark.llm.wordids import slices

BLOCK = 128
SLOTS = 1 << 13
SAME = 4096
TASK = 1 << 24  # words of the mix that a task of draws stands for
ROUNDS = 6
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK = (1 << 64) - 1


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[float], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of total by weight, none above most times its size; what is above goes to the others by weight."""
    out, open_, left = [0.0] * len(sizes), [k for k, n in enumerate(sizes) if n > 0], total
    while open_:
        scale = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if weights[k] * scale > most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = weights[k] * scale
            break
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
            open_.remove(k)
    return out


def _mixed(*x: int) -> int:
    h = 0x9E3779B97F4A7C15
    for v in x:
        h = (h ^ (v & MASK)) * 0xBF58476D1CE4E5B9 & MASK
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & MASK
        h ^= h >> 31
    return h


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) at index: a Feistel network, walked until it stays inside."""
    index, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.uint64(1) * ((np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 0.5)).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.ones(len(index), bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        with np.errstate(over="ignore"):
            for r in range(ROUNDS):
                f = (right + k + np.uint64(r * 0x9E3779B97F4A7C15 & MASK)) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        out[todo] = left << h | right
        todo = out >= n
    return out.astype(np.int64)


def shard_counts(totals: Sequence[int], shards: int, slots: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots that shards before it give to each source, slots that it gives), for one shard."""
    lo, hi, have, before, node = 0, shards, tuple(totals), np.zeros(len(totals), np.int64), 1
    whole = sum(have)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        drawn = _node(have, min(whole, mid * slots) - min(whole, lo * slots), seed, node)
        if shard < mid:
            hi, have, node = mid, drawn, 2 * node
        else:
            before = before + np.array(drawn, np.int64)
            lo, have, node = mid, tuple(a - b for a, b in zip(have, drawn, strict=True)), 2 * node + 1
    return before, np.array(have, np.int64)


@lru_cache(maxsize=256)
def _node(have: tuple[int, ...], n: int, seed: int, node: int) -> tuple[int, ...]:
    """n of the slots in have, without return, source by source; neighbouring shards share most nodes."""
    rng, out, left = np.random.default_rng(_mixed(seed, node)), [0] * len(have), sum(have)
    for k, m in enumerate(have):
        left -= m
        if n <= 0:
            break
        out[k] = _draw(m, left, n, rng)
        n -= out[k]
    return tuple(out)


def _draw(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n draws without return are good: hypergeometric, exact to a double's precision at any size.

    numpy's own stops at 10 ** 9. Beyond it the probabilities around the mode follow from each other, and one uniform number is looked up in
    their sums; what lies more than 12 standard deviations away has less weight than a double's rounding.
    """
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    all_ = good + bad
    mode = min(max((n + 1) * (good + 1) // (all_ + 2), low), high)
    reach = 16 + int(12 * (n * (good / all_) * (bad / all_) * ((all_ - n) / (all_ - 1))) ** 0.5)
    up = np.arange(mode, min(mode + reach, high), dtype=np.float64)
    down = np.arange(mode, max(mode - reach, low), -1, dtype=np.float64)
    rise = np.cumprod((good - up) / (up + 1) * ((n - up) / (bad - n + up + 1)))
    fall = np.cumprod(down / (good - down + 1) * ((bad - n + down) / (n - down + 1)))
    sums = np.cumsum(np.concatenate([fall[::-1], [1.0], rise]))
    return mode - len(fall) + int(min(np.searchsorted(sums, rng.random() * sums[-1], "right"), len(sums) - 1))


def sources_of(sized: DataFrame, weights: Sequence[float], share: float, block: int) -> DataFrame:
    """One row per source: number, size, target, blocks and slots."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for t in tables for r in t.to_pylist()]
        rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["source_size"] for r in rows]
        goal = targets(sizes, [weights[k % len(weights)] for k in range(len(rows))], share * sum(sizes))
        for k, (r, t) in enumerate(zip(rows, goal, strict=True)):
            r["blocks"] = -(-r["source_size"] // block)
            full = r["source_size"] / r["blocks"] if r["blocks"] else 1
            r |= {"number": k, "target": t, "slots": min(round(t / full), 2 * r["blocks"])}
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("source", pa.string()), ("source_size", pa.int64()), ("number", pa.int32()), ("target", pa.float64()), ("blocks", pa.int64()), ("slots", pa.int64())]))

    return saved(sizes.coalesce(1).mapInArrow(run, "source string, source_size long, number int, target double, blocks long, slots long"), "sources")


def _positions(sized: DataFrame, sources: DataFrame, bucket: int) -> DataFrame:
    """sized with number, blocks and start: the place of a document's first word in its source.

    Documents that are equal in all that is known of them stand side by side, in any order.
    """
    own = ["source", "doc_id", "hash", "size"]
    groups = sized.groupBy(*own).agg(F.count("*").alias("many"))
    groups = saved(groups.withColumn("tie", F.xxhash64(*own)), "groups")
    buckets = max(64, -(-groups.count() // bucket))
    keyed = groups.withColumn("bucket", F.pmod("tie", F.lit(buckets)))
    within = Window.partitionBy("source", "bucket").orderBy("tie", "doc_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("many")
    sums = keyed.groupBy("source", "bucket").agg(F.sum(words).alias("n")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = keyed.withColumn("local", F.coalesce(F.sum(words).over(within), F.lit(0)))
    named = sources.select(F.col("source").alias("t"), "number", "blocks", "source_size", "target")
    placed = local.join(sums, F.expr("source <=> s and bucket = b")).join(named, F.expr("source <=> t"))
    placed = placed.select(*(F.col(c).alias(f"g_{c}") for c in own), "many", "number", "blocks", "source_size", "target", (F.col("offset") + F.col("local")).alias("start"))
    rows = sized.join(placed, F.expr(" and ".join(f"{c} <=> g_{c}" for c in own))).drop(*(f"g_{c}" for c in own))
    single = rows.where("many = 1").drop("many")
    # which of its equals a row is: numbered within parts of about SAME, which begin where those before them end
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("many") / SAME)).alias("part")
    equals = rows.where("many > 1").select("*", part)
    sizes = equals.groupBy("number", "start", "doc_id", "hash", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("number", "start", "doc_id", "hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("number").alias("x"), F.col("start").alias("y"), F.col("part").alias("z"), F.col("doc_id").alias("i"), F.col("hash").alias("j"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("number", "start", "doc_id", "hash", "part").orderBy("row")) - 1
    numbered = equals.withColumn("place", place).join(offsets, F.expr("number = x and start = y and part = z and doc_id <=> i and hash <=> j"))
    several = numbered.withColumn("start", F.col("start") + (F.col("first") + F.col("place")) * F.col("size"))
    return single.unionByName(several.select(*single.columns))


def draws(sources: DataFrame, seed: int, slots: int, block: int) -> DataFrame:
    """One row per slot of the mix: shard, slot (its place in the shard), source number, block and pass."""
    spark = sources.sparkSession
    rows = sources.orderBy("number").select("slots", "blocks").collect()  # one row a source
    totals, blocks = [r["slots"] for r in rows], [r["blocks"] for r in rows]
    shards = max(1, -(-sum(totals) // slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch["id"].to_pylist():
                before, counts = shard_counts(totals, shards, slots, shard, seed)
                whole, done = int(counts.sum()), 0
                for k in np.flatnonzero(counts).tolist():
                    n = np.arange(before[k], before[k] + counts[k])
                    turn = n // blocks[k]
                    keys = np.array([_mixed(seed, 7, k, int(t)) for t in (0, 1, 2)], np.uint64)[turn]
                    index = permuted(n % blocks[k], np.full(len(n), blocks[k]), keys)
                    place = permuted(np.arange(done, done + len(n)), np.full(len(n), whole), np.full(len(n), _mixed(seed, 11, shard), np.uint64))
                    done += len(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), shard, np.int64)), pa.array(place), pa.array(np.full(len(n), k, np.int32)), pa.array(index), pa.array(turn.astype(np.int32))],
                        ["shard", "slot", "number", "block", "turn"],
                    )

    tasks = max(1, min(shards, shards * slots * block // TASK))
    return spark.range(0, shards, 1, tasks).mapInArrow(run, "shard long, slot long, number int, block long, turn int")


def plan(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    block: int = BLOCK,
    slots: int = SLOTS,
    seed: int = 20240229,
    bucket: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents has a row per row of docs: row, doc, size, source_size and target; doc is a struct of docs' columns but text, which stands beside it. pieces has, per draw of a
    block and document in it: row, shard, slot, turn, and the words [first, last) of the document that it takes, which
    begin at word ``at`` of the slot.
    """
    rows = _rows(docs, with_text=False)
    return _plan(rows, weights, share, block, slots, seed, bucket)


def _rows(docs: DataFrame, with_text: bool) -> DataFrame:
    """row, doc_id, source, size, hash and, with_text, text and doc: numbered once and written, so that no later scan numbers them anew."""
    columns = [
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"),
    ]
    return saved(docs.select(*columns, *(["text", packed(docs, "text")] if with_text else [])), "sized")


def _plan(rows: DataFrame, weights: Sequence[float], share: float, block: int, slots: int, seed: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    sized = rows.select("row", "doc_id", "source", "size", "hash")
    sources = sources_of(sized, weights, share, block)
    placed = saved(_positions(sized, sources, bucket), "placed")
    cuts = (
        placed.where("size > 0")
        .select("row", "number", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
        .select(
            "row",
            "number",
            "block",
            F.greatest(F.col("start") - F.col("block") * block, F.lit(0)).alias("at"),
            F.greatest(F.col("block") * block - F.col("start"), F.lit(0)).alias("first"),
            F.least((F.col("block") + 1) * block - F.col("start"), F.col("size")).alias("last"),
        )
    )
    # the draws are as many as the blocks, which Spark's estimate doesn't see: it would broadcast them
    drawn = draws(sources, seed, slots, block).hint("merge").join(cuts, ["number", "block"])
    return placed, drawn.select("row", "shard", "slot", "turn", "at", "first", "last")


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words of the document that the mix takes) per row of docs."""
    placed, pieces = plan(docs, **options)
    sums = pieces.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    return placed.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    block: int = BLOCK,
    slots: int = SLOTS,
    seed: int = 20240229,
    bucket: int = 20_000,
) -> DataFrame:
    """The mix: shard, slot, at, text and doc, a row per slot and document in it. text has the words that the slot takes of the document, which begin
    at word ``at`` of the slot, and what stands between them; doc the document's other columns.

    Each shard's rows are together, in order of their slots. n_chars, if there, is counted anew.
    """
    from tidemark.llm.substring import rebuilt

    rows = _rows(docs, with_text=True)
    _, pieces = _plan(rows, weights, share, block, slots, seed, bucket)
    asked = pieces.groupBy("row").agg(F.collect_list(F.struct("shard", "slot", "at", "first", "last")).alias("pieces"))
    joined = rows.select("row", "text", "doc").join(asked.hint("merge"), "row")
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts = pa.compute.list_value_length(batch["pieces"]).to_numpy()
            flat, ends = batch["pieces"].flatten(), np.cumsum(counts)
            spans = np.stack([flat.field(c).to_numpy() for c in ("first", "last")], 1)
            texts: list[str] = []
            for text, a, b in zip(batch["text"].to_pylist(), ends - counts, ends, strict=True):
                at = [m.span() for m in WORD.finditer(text)]
                texts += (text[at[x][0] : at[y - 1][1]] for x, y in spans[a:b].tolist())
            which = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            for k in range(0, len(texts), 4096):  # a row's other columns may be wide
                doc = rebuilt(batch["doc"].take(which[k : k + 4096]), names, texts[k : k + 4096])
                columns = [*(flat.field(c).slice(k, 4096) for c in ("shard", "slot", "at")), pa.array(texts[k : k + 4096], pa.string()), pa.StructArray.from_arrays(doc.columns, names)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "slot", "at", "text", "doc"])

    kind = StructType([StructField("shard", LongType()), StructField("slot", LongType()), StructField("at", LongType()), StructField("text", StringType()), rows.schema["doc"]])
    return joined.mapInArrow(run, kind).repartition("shard").sortWithinPartitions("shard", "slot", "at")


def documents(mix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix as documents with the columns named, a row per slot and document in it, in the mix's order."""
    return mix.select(*(F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in columns))
