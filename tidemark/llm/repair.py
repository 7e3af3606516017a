"""Token-id files with Re-Pair grammar compression.

Documents are dealt by ranges of their id to partitions, encoded, and cut into shards of about
``shard_tokens`` ids. In each shard frequent pairs of neighbouring ids are replaced by
nonterminals, round after round, until no pair comes ``least`` times. After the first round only pairs with a new symbol, and
those that were frequent and lost a place to another pair, can be frequent, so later rounds look at these alone. A shard's image holds the
rules with their expansion lengths, the compressed ids, and how many symbols and ids each document has;
so one document, or one id of it, can be decoded without the ids before it.

A shard's image is one binary cell of a Parquet table in the shared folder: only Spark's own writers reach
every store, and their commits survive lost executors.

Image: little-endian unsigned 32-bit numbers: magic, base (the first nonterminal), rules r, documents d, symbols s, and the
bits that a number of each kind takes: symbols, lengths, symbol counts, id counts. Then, packed to that many bits, each kind from a
whole byte on: r left symbols, r right symbols, r expansion lengths, d symbol counts, d id counts, s symbols.

Defined results: a null text is an empty one with only the end id; a null id sorts first; repeated rows are
written as often as they come, and rows of one id in the input's order; an empty table writes no shard; extra columns
don't matter. Pairs across documents are never replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import new_path, tasks_for
from tidemark.llm.wordids import ID, encoder, slices

MAGIC = 0x52505432
END = 1
SHARD_TOKENS = 1 << 19
TASK = 64 << 20
BUCKET_BITS = 18
LEAST = 16


def _ranked(seq: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, rank of the pair at each, pairs by rank, their counts) of the pairs at ``at`` that come there at least ``least`` times.

    Pairs are first counted by hash bucket; a pair can't be frequent where its bucket isn't. A
    frequent bucket nearly always holds one pair; what else lies in it is sorted. Counts are exact.
    """
    a, b = seq[at], seq[at + 1]
    bucket = ((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKET_BITS)).astype(np.intp)
    some = np.flatnonzero((np.bincount(bucket, minlength=1 << BUCKET_BITS) >= least)[bucket])
    key = a[some].astype(np.uint64) << np.uint64(32) | b[some]
    slot = bucket[some]
    one = np.zeros(1 << BUCKET_BITS, np.uint64)
    one[slot] = key
    same = one[slot] == key
    counts = np.bincount(slot[same], minlength=1 << BUCKET_BITS)
    slots = np.flatnonzero(counts >= least)
    pairs, n = one[slots], counts[slots]
    rest, where, times = np.unique(key[~same], return_inverse=True, return_counts=True)
    more = times >= least
    number = np.full(1 << BUCKET_BITS, -1, np.int32)
    number[slots] = np.arange(len(slots))
    index = number[slot]
    other = np.full(len(rest), -1, np.int32)
    other[more] = len(slots) + np.arange(int(more.sum()))
    index[~same] = other[where]
    pairs, n = np.concatenate([pairs, rest[more]]), np.concatenate([n, times[more]])
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    keep = index >= 0
    return at[some[keep]], rank[index[keep]], pairs[order], n[order]


def _chosen(places: np.ndarray, rank: np.ndarray, seq_len: int) -> np.ndarray:
    """Which of the places are replaced: where two overlap, the better ranked; every second of a run of one pair."""
    none = np.int32(np.iinfo(np.int32).max)
    at = np.full(seq_len + 1, none, np.int32)
    at[places + 1] = rank
    left, right = at[places], at[places + 2] if seq_len > 1 else none
    take = (rank < left) & (rank <= right)
    tie = rank == left
    if tie.any():
        run = np.flatnonzero(tie)
        starts = np.concatenate([[True], np.diff(places[run]) > 1])
        begin = run[starts][np.cumsum(starts) - 1]  # first of the run that ties with its left
        second = (places[run] - places[begin]) % 2 == 1
        taken = np.zeros(seq_len + 2, bool)
        taken[places[take] + 1] = True
        free = ~taken[places[run]] & ~taken[places[run] + 2]
        take[run[second & free & (rank[run] <= right[run])]] = True
    return take


def compress(seq: np.ndarray, starts: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first symbol of each document, rules as rows of left, right) of a shard's ids."""
    seq, starts = seq.astype(np.uint32), starts.astype(np.int64)
    rules: list[np.ndarray] = []
    n_rules, at = 0, np.arange(max(len(seq) - 1, 0))
    while True:
        inside = np.ones(len(seq) + 1, bool)  # pairs within a document
        inside[starts[starts > 0] - 1] = False
        inside[max(len(seq) - 1, 0) :] = False
        places, rank, pairs, n = _ranked(seq, at[inside[at]], least)
        if not len(pairs):
            break
        take = _chosen(places, rank, len(seq))
        counts = np.bincount(rank[take], minlength=len(pairs))
        worth = counts >= max(least // 4, 1)  # a rule that hardly has a place isn't; the most frequent pair always is
        take &= worth[rank]
        used = np.flatnonzero(worth)
        symbol = np.zeros(len(pairs), np.uint32)
        symbol[used] = base + n_rules + np.arange(len(used))
        rules.append(np.stack([(pairs[used] >> np.uint64(32)).astype(np.uint32), pairs[used].astype(np.uint32)], 1))
        n_rules += len(used)
        open_ = ~take & (n - counts * worth >= least)[rank]
        chosen, over = places[take], places[open_]
        seq[chosen] = symbol[rank[take]]
        gone = np.zeros(len(seq) + 1, bool)
        gone[chosen + 1] = True
        over = over[~gone[over] & ~gone[over + 1]]  # both symbols are still there, or have become new ones
        seq = seq[~gone[: len(seq)]]
        starts = starts - np.searchsorted(chosen, starts - 1)
        new = chosen - np.arange(len(chosen))
        marked = np.zeros(len(seq) + 1, bool)
        marked[new] = marked[np.maximum(new - 1, 0)] = True
        marked[over - np.searchsorted(chosen, over - 1, "right")] = True
        at = np.flatnonzero(marked[:-1])
    return seq, starts, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for. A rule only uses symbols before its own."""
    out = np.zeros(len(rules), np.int64)
    plain = rules < base
    done = np.zeros(len(rules), bool)
    while not done.all():
        inner = np.where(plain, 0, rules.astype(np.int64) - base)
        ready = ~done & (plain | done[inner]).all(axis=1)
        out[ready] = np.where(plain, 1, out[inner])[ready].sum(axis=1)
        done |= ready
    return out


def bits_for(values: np.ndarray) -> int:
    return int(values.max()).bit_length() if len(values) else 0


def pack(values: np.ndarray, bits: int) -> bytes:
    """The lower bits of each value, one after the other, up to a whole byte."""
    if bits in (8, 16, 32):
        return values.astype(f"<u{bits // 8}").tobytes()
    if bits == 0:
        return b""
    each = np.unpackbits(np.ascontiguousarray(values.astype(ID)).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(each[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, offset: int, bits: int, first: int, last: int) -> np.ndarray:
    """Values first to last of those packed from offset on; nothing else is read."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", last - first, offset + first * bits // 8).astype(np.uint32)
    if bits == 0 or first >= last:
        return np.zeros(max(last - first, 0), np.uint32)
    begin = first * bits // 8
    some = np.frombuffer(data, np.uint8, (last * bits + 7) // 8 - begin, offset + begin)
    skip = first * bits - 8 * begin
    each = np.zeros((last - first, 32), np.uint8)
    each[:, :bits] = np.unpackbits(some, bitorder="little")[skip : skip + (last - first) * bits].reshape(-1, bits)
    return np.packbits(each, axis=1, bitorder="little").view(ID).reshape(-1)


def image(seq: np.ndarray, starts: np.ndarray, counts: np.ndarray, rules: np.ndarray, base: int) -> bytes:
    lengths, symbols = expansion_lengths(rules, base), np.diff(starts)
    w = max(bits_for(seq), bits_for(rules.reshape(-1)))
    bits = [w, bits_for(lengths), bits_for(symbols), bits_for(counts)]
    head = np.array([MAGIC, base, len(rules), len(counts), len(seq), *bits], ID)
    parts = zip((rules[:, 0], rules[:, 1], lengths, symbols, counts, seq), (w, w, *bits[1:], w), strict=True)
    return head.tobytes() + b"".join(pack(p, n) for p, n in parts)


class Shard:
    """A shard's image, decoded document by document."""

    def __init__(self, data: bytes):
        if len(data) < 36 or np.frombuffer(data, ID, 1)[0] != MAGIC:
            raise ValueError("not a shard image")
        self.base, r, d, s, w, *rest = np.frombuffer(data, ID, 9)[1:].tolist()
        self._data, self._bits, self._size, at, parts = data, w, s, 36, []
        for n, bits in zip((r, r, r, d, d), (w, w, *rest), strict=True):
            parts.append(unpack(data, at, bits, 0, n))
            at += (n * bits + 7) // 8
        if len(data) != at + (s * w + 7) // 8:
            raise ValueError("not a shard image")
        self.left, self.right, self.lengths, counts, self.counts = parts
        self._at, self.starts = at, np.concatenate([[0], np.cumsum(counts.astype(np.int64))]).tolist()
        self._ids: tuple[np.ndarray, np.ndarray] | None = None

    def symbols(self, first: int, last: int) -> np.ndarray:
        return unpack(self._data, self._at, self._bits, first, last)

    def __len__(self) -> int:
        return len(self.counts)

    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rules end to end, and where each rule's begin; a rule only uses symbols before its own."""
        if self._ids is None:
            parts: list[np.ndarray] = []
            for pair in zip(self.left.tolist(), self.right.tolist(), strict=True):
                parts.append(np.concatenate([parts[x - self.base] if x >= self.base else np.array([x], np.uint32) for x in pair]))
            self._ids = np.concatenate([*parts, np.zeros(1, np.uint32)]), np.cumsum(self.lengths.astype(np.int64)) - self.lengths
        return self._ids

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        flat, begins = self._flat()
        deep = np.flatnonzero(symbols >= self.base)
        rules = (symbols[deep] - self.base).astype(np.int64)
        lengths = np.ones(len(symbols), np.int64)
        lengths[deep] = self.lengths[rules]
        out = np.repeat(symbols, lengths)
        n = lengths[deep]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        starts = (np.cumsum(lengths) - lengths)[deep]
        out[np.repeat(starts, n) + place] = flat[np.repeat(begins[rules], n) + place]
        return out

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn; the shard is expanded at once."""
        ids, ends = self.expand(self.symbols(0, self._size)), np.cumsum(self.counts.astype(np.int64)).tolist()
        for a, b in zip([0, *ends], ends, strict=False):
            yield ids[a:b]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols(self.starts[k], self.starts[k + 1]))

    def token(self, k: int, i: int) -> int:
        """The i-th id of document k, by way of expansion lengths alone."""
        for x in self.symbols(self.starts[k], self.starts[k + 1]).tolist():
            n = int(self.lengths[x - self.base]) if x >= self.base else 1
            if i >= n:
                i -= n
                continue
            while x >= self.base:
                a, b = int(self.left[x - self.base]), int(self.right[x - self.base])
                n = int(self.lengths[a - self.base]) if a >= self.base else 1
                x, i = (a, i) if i < n else (b, i - n)
            return x
        raise IndexError(i)


def write(docs: DataFrame, vocabulary: str, path: str, partitions: int | None = None, shard_tokens: int = SHARD_TOKENS, end: int = END) -> None:
    """Writes the shards of docs (doc_id, text), in ascending order of doc_id, to the table at path."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = ["doc_id", "tie"]  # very many rows of one id are dealt over several tasks
    dealt = rows.repartitionByRange(partitions or tasks_for(docs, TASK), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary, 1_000_000)  # the only worker of its task
        base = max(enc.tokenizer.get_vocab_size(), end + 1)
        last = np.array([end], ID).tobytes()
        kind = None
        part, shard, ids, held, names = TaskContext.get().partitionId(), 0, [], 0, []

        def full() -> pa.RecordBatch:
            nonlocal shard, ids, held, names
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            seq = np.frombuffer(b"".join(ids), ID)
            starts = np.concatenate([[0], np.cumsum(counts)])
            symbols, first, rules = compress(seq, starts, base)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([shard], pa.int32()),
                    pa.array([int(counts.sum())], pa.int64()),
                    pa.array([names], pa.list_(kind)),
                    pa.array([image(symbols, first, counts, rules, base)], pa.binary()),
                ],
                ["part", "shard", "n_tokens", "doc_ids", "image"],
            )
            shard, ids, held, names = shard + 1, [], 0, []
            return out

        for some in slices(batches, "text"):
            kind = some["doc_id"].type
            for doc_id, x in zip(some["doc_id"].to_pylist(), enc.encode(some["text"].to_pylist()), strict=True):
                ids.append(x + last)
                names.append(doc_id)
                held += len(x) // 4 + 1
                if held >= shard_tokens:
                    yield full()
        if ids:
            yield full()

    kind = docs.schema["doc_id"].dataType.simpleString()
    shards = dealt.mapInArrow(run, f"part int, shard int, n_tokens long, doc_ids array<{kind}>, image binary")
    shards.write.option("compression", "zstd").parquet(path)


def read(table: DataFrame) -> DataFrame:
    """Per document of the shards in table: doc_id, start, n_tokens and ids_crc32, all from the images.

    start counts the ids of all documents before it: those of earlier shards (one row each) and those before it in its own.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    local = table.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("local"))
    offsets = local.join(parts, "part").select("part", "shard", (F.col("before") + F.col("local")).alias("offset"))
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch["image"][k].as_py())
                crc = [crc32(ids) for ids in shard.documents()]
                counts = shard.counts.astype(np.int64)
                n = len(shard)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch["part"][k].as_py(), np.int32)),
                        pa.array(np.full(n, batch["shard"][k].as_py(), np.int32)),
                        batch["doc_ids"][k].values,
                        pa.array(np.cumsum(counts) - counts),
                        pa.array(counts),
                        pa.array(crc, pa.int64()),
                    ],
                    ["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    found = table.select("part", "shard", "doc_ids", "image").mapInArrow(run, f"part int, shard int, doc_id {kind}, inner long, n_tokens long, ids_crc32 long")
    return found.join(offsets, ["part", "shard"]).select("doc_id", (F.col("offset") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Writes docs to new files and reads them back."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write(docs, vocabulary, path, **options)
    return read(spark.read.parquet(path))
