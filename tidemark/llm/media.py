"""Media columns stored as content-defined chunks.

A text's payload becomes an 8-bit greyscale image (binary PGM, ``WIDTH`` samples a row). The image's bytes are cut where a
rolling gear hash of the last 32 bytes has its top bits zero, so equal stretches give equal chunks wherever they
begin. Spark joins on chunk digests find which chunks are in several places and give each one owner. The store has a row per distinct
image: its ordered chunk list (every chunk's size, and the digests of those that are in several places), and the bytes of the chunks that it owns, compressed together. Chunks that another
image owns are fetched by their digests; the image is put together in the order of its list, checked against its own digest, and read.

An image is known by the digest of its text, so nothing depends on how rows are numbered or dealt. Texts are shuffled once, compressed, into
the store, where equal ones become one; out of it only the pieces of images with chunks of others are. A chunk that very many lists share is handed
out in parts of ``LISTS``, so that none gathers in one task.

Defined results: a null text is an empty one; equal texts share an image and its values; null ids and repeated rows
are rows like others; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import Tables, saved
from tidemark.llm.wordids import slices

FRAME, WIDTH = 576, 24
LEAST, MOST, BITS = 128, 1 << 13, 8
DIGEST = 16
LISTS = 256
GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, np.uint32)


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % FRAME if data else FRAME)


def image(data: bytes) -> bytes:
    """The payload as a binary PGM."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(data) // WIDTH) + data


def cuts(data: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks of data."""
    out, done, n = [], 0, len(data)
    if n > least:
        h = GEAR[np.frombuffer(data, np.uint8)]
        for k in (1, 2, 4, 8, 16):  # the hash of 32 bytes from those of 1, 2, 4 ... bytes
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        for place in (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist():
            while place - done > most:
                done += most
                out.append(done)
            if place - done >= least:
                done = place
                out.append(done)
    while n - done > most:
        done += most
        out.append(done)
    return [*out, n] if not out or out[-1] < n else out


def name_of(text: str | None) -> bytes:
    """What an image is known by."""
    return hashlib.sha256((text or "").encode()).digest()[:DIGEST]


def _pieces(whole: bytes) -> list[bytes]:
    ends = cuts(whole)
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _digest(piece: bytes) -> bytes:
    return hashlib.sha256(piece).digest()[:DIGEST]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"))


def chunk_lists(docs: DataFrame) -> DataFrame:
    """(name, digests): the ordered chunk list of each distinct image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for part in slices(batches, "text"):
            names, lists = [], []
            for text in part["text"].to_pylist():
                name = name_of(text)
                if name not in met:
                    met.add(name)
                    names.append(name)
                    lists.append([_digest(p) for p in _pieces(image(payload(text)))])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["name", "digests"])

    return _texts(docs).mapInArrow(run, "name binary, digests array<binary>").dropDuplicates(["name"])


def shared_chunks(lists: DataFrame) -> DataFrame:
    """(name, shared): per image the (seq, mine, digest) of its chunks that are in more than one place; of a chunk's places one is the owner's."""
    chunks, key = lists.select("name", F.posexplode("digests").alias("seq", "digest")), F.xxhash64("name", "seq")
    several = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(key).alias("owner")).where("n > 1").select("digest", "owner")
    found = chunks.join(saved(several, "several"), "digest").select("name", F.struct("seq", (key == F.col("owner")).alias("mine"), "digest").alias("s"))
    return found.groupBy("name").agg(F.collect_list("s").alias("shared"))


SHARED = "array<struct<seq:int,mine:boolean,digest:binary>>"
STORED = f"name binary, media binary, sizes array<int>, shared {SHARED}, own_bytes long, own binary"


def store(docs: DataFrame) -> DataFrame:
    """(name, media, sizes, shared, own_bytes, own) per distinct image: the image's digest, the sizes of its chunks in order, those that are in
    several places (and whether this is the owner's), and how many bytes it owns and these bytes in order, compressed."""
    working = Tables()
    with working:
        found = shared_chunks(saved(chunk_lists(docs), "chunk-lists"))
    shared = saved(found, "shared")
    working.release(docs.sparkSession)

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer, met = zstandard.ZstdCompressor(level=6), set()
        for part in slices(batches, "text"):
            names, bodies = [], []
            for text in part["text"].to_pylist():
                name = name_of(text)
                if name not in met:
                    met.add(name)
                    names.append(name)
                    bodies.append(packer.compress(text.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(bodies, pa.binary())], ["name", "body"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer, unpacker = zstandard.ZstdCompressor(level=12), zstandard.ZstdDecompressor()
        for part in slices(batches, "body", 1_000_000):
            rows = []
            for name, body, some in zip(part["name"].to_pylist(), part["body"].to_pylist(), part["shared"].to_pylist(), strict=True):
                whole = image(payload(unpacker.decompress(body).decode()))
                pieces, foreign = _pieces(whole), {s["seq"] for s in some or () if not s["mine"]}
                own = [p for k, p in enumerate(pieces) if k not in foreign]
                rows.append((name, hashlib.sha256(whole).digest(), list(map(len, pieces)), some or [], sum(map(len, own)), packer.compress(b"".join(own))))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.binary(), pa.binary(), pa.list_(pa.int32()), part.schema.field("shared").type, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "media", "sizes", "shared", "own_bytes", "own"])

    bodies = _texts(docs).mapInArrow(compressed, "name binary, body binary").dropDuplicates(["name"])
    return saved(bodies.join(shared.hint("merge"), "name", "left").mapInArrow(built, STORED), "chunk-store", "none")


def _owned(row: dict, unpacker) -> list[tuple[int, bytes]]:
    """(seq, chunk) of the chunks that a row of the store owns."""
    foreign, data, at, out = {s["seq"] for s in row["shared"] if not s["mine"]}, unpacker.decompress(row["own"]), 0, []
    for k, n in enumerate(row["sizes"]):
        if k not in foreign:
            out.append((k, data[at : at + n]))
            at += n
    return out


VALUES = "name binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _values(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], [c.split()[0] for c in VALUES.split(", ")])


class _Reader:
    """Takes an image's chunks in order and makes its values."""

    def __init__(self, name: bytes, media: bytes):
        self.name, self.want = name, media
        self.media, self.samples, self.counts = hashlib.sha256(), hashlib.sha256(), np.zeros(16, np.int64)
        self.size = self.kept = 0
        self.head: bytes | None = b""
        self.tail = b""

    def add(self, piece: bytes) -> None:
        self.media.update(piece)
        self.size += len(piece)
        if self.head is not None:  # the samples begin after the third line end
            self.head += piece
            if self.head.count(b"\n") < 3:
                return
            piece, self.head = self.head.split(b"\n", 3)[3], None
        self.samples.update(piece)
        self.kept += len(piece)
        self.tail = (self.tail + piece)[-FRAME:]
        self.counts += np.bincount(np.frombuffer(piece, np.uint8) >> 4, minlength=16)

    def values(self) -> tuple:
        if self.media.digest() != self.want:
            raise ValueError(f"image {self.name.hex()} differs from what was stored")
        n_bytes = self.kept - (len(self.tail) - len(self.tail.rstrip(b"\xff")))  # a byte that UTF-8 never has
        feature = ",".join(map(str, self.counts.tolist()))
        return self.name, n_bytes, self.kept, self.samples.hexdigest(), crc32(self.tail[-32:]), self.size, self.media.hexdigest(), feature


class _Whole(_Reader):
    """Puts an image together from its own bytes and chunks of others, which come in order."""

    def __init__(self, name: bytes, media: bytes, sizes: list[int], foreign: list[int], own: bytes):
        super().__init__(name, media)
        self.sizes, self.waits, self.own, self.at, self.k = sizes, sorted(foreign, reverse=True), own, 0, 0

    def _up_to(self, k: int) -> None:
        n = sum(self.sizes[self.k : k])
        if n:
            self.add(self.own[self.at : self.at + n])
        self.at, self.k = self.at + n, k

    def take(self, seq: int, chunk: bytes) -> None:
        if not self.waits or seq != self.waits.pop():
            raise ValueError(f"a chunk before {seq} of image {self.name.hex()} is missing")
        self._up_to(seq)
        self.add(chunk)
        self.k = seq + 1

    def values(self) -> tuple:
        self._up_to(len(self.sizes))
        return super().values()


def read(chunk_store: DataFrame) -> DataFrame:
    """Per distinct image: name, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature.

    feature counts the samples by their upper four bits. An image that doesn't have its digest is an error.
    """
    foreign = F.exists("shared", lambda s: ~s["mine"])
    whole, partial = chunk_store.where(~foreign), chunk_store.where(foreign)

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for part in slices(batches, "own", 1_000_000):
            out = []
            for name, media, own in zip(*(part[c].to_pylist() for c in ("name", "media", "own")), strict=True):
                reader = _Reader(name, media)
                reader.add(unpacker.decompress(own))
                out.append(reader.values())
            yield _values(out)

    def lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer, unpacker = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()
        for part in slices(batches, "own", 1_000_000):
            for row in part.to_pylist():
                mine = {s["seq"]: s["digest"] for s in row["shared"] if s["mine"]}
                some = [(mine[k], packer.compress(p)) for k, p in _owned(row, unpacker) if k in mine]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], pa.binary()) for i in (0, 1)], ["digest", "data"])

    wanted = partial.select("name", F.explode("shared").alias("s")).where("not s.mine").select("name", "s.seq", "s.digest")
    often = wanted.groupBy("digest").agg(F.ceil(F.count("*") / LISTS).cast("int").alias("parts")).where("parts > 1")
    asked = wanted.join(often, "digest", "left").withColumn("part", F.pmod(F.xxhash64("name", "seq"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    given = chunk_store.where(F.exists("shared", lambda s: s["mine"])).mapInArrow(lent, "digest binary, data binary").join(often, "digest", "left")
    given = given.select("digest", "data", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    fetched = asked.join(given, ["digest", "part"]).select("name", "seq", "data")
    # an image's own bytes come first, then what it takes from others, in order
    seqs = F.transform(F.filter("shared", lambda s: ~s["mine"]), lambda s: s["seq"]).alias("foreign")
    own = partial.select("name", F.lit(-1).alias("seq"), F.col("own").alias("data"), "media", "sizes", seqs)
    pieces = own.unionByName(fetched, allowMissingColumns=True)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker, whole = zstandard.ZstdDecompressor(), None
        for part in slices(batches, "data", 1_000_000):
            out = []
            for name, seq, data, media, sizes, foreign in zip(*(part[c].to_pylist() for c in ("name", "seq", "data", "media", "sizes", "foreign")), strict=True):
                if seq < 0:
                    if whole is not None:
                        raise ValueError(f"chunks of image {whole.name.hex()} are missing")
                    whole = _Whole(name, media, sizes, foreign, unpacker.decompress(data))
                elif whole is None:
                    raise ValueError(f"image {name.hex()} is missing")
                else:
                    whole.take(seq, unpacker.decompress(data))
                if not whole.waits:
                    out.append(whole.values())
                    whole = None
            yield _values(out)
        if whole is not None:
            raise ValueError(f"chunks of image {whole.name.hex()} are missing")

    in_order = pieces.repartition("name").sortWithinPartitions("name", "seq")
    return whole.mapInArrow(in_place, VALUES).unionByName(in_order.mapInArrow(together, VALUES))


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores the images of docs' texts and returns, per row of docs, doc_id and what ``read`` makes of its image."""
    values = read(store(docs.select("doc_id", "text")))
    rows = docs.select("doc_id", F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, DIGEST).alias("name"))
    return rows.join(values, "name").drop("name")
