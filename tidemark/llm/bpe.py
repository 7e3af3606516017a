"""BPE encoding and decoding by tree concatenation.

Texts up to ``leaf`` code points are encoded whole. Longer ones are cut in halves
down to leaves, which are dealt over the cluster and encoded in parallel. Going
up the tree, a window around each join is encoded again and grows until it agrees
with both sides: until it has a piece in common with each, at the same place and
with the same ids, from which the tokenizer's state on both sides is the same.
A window that never agrees ends as the whole of both sides, so results are
always those of the undivided text. FAN leaves that follow each other are joined in one task; a text of more has its
nodes joined in another. Texts are only cut for vocabularies whose tokenizer drops white space and splits at it; for others each text is encoded whole.

Defined results: a null text is an empty one; an empty text has no ids and decodes
to an empty text; repeated rows are each encoded; columns other than id and text
don't matter.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.wordids import ID, WORD, by_words, encoder, slices

LEAF = 1 << 15
FAN = 64
UNSPLIT = 256  # longer words are kept as single tokens with their places
WINDOW = 64
EDGE = 512
SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


class Pieces(NamedTuple):
    """Encoded text as pieces, each a word or a token of a long word: start, end, ids."""

    starts: list[int]
    ends: list[int]
    ids: list[bytes]


def _edges(text: str) -> tuple[int, int]:
    """Where the first and the last few words of text end and begin; between them pieces aren't needed.
    0, 0 where white space doesn't allow this."""
    if len(text) < 4 * EDGE:
        return 0, 0
    first = next((m.end() for m in SPACE.finditer(text, EDGE, len(text) // 2)), 0)
    last = next((k for k in range(len(text) - EDGE, len(text) // 2, -1) if text[k] in " \t\n\r\x0b\x0c"), 0)
    return (first, last) if first and last else (0, 0)


def encode_pieces(text: str, at: int, path: str) -> Pieces:
    """Pieces of text, which begins at place ``at`` of the document. All that lies between the
    first and the last words is one piece."""
    first, last = _edges(text)
    if first:
        head, tail = encode_pieces(text[:first], at, path), encode_pieces(text[last:], at + last, path)
        middle = encoder(path).encode([text[first:last]])
        return Pieces(head.starts + [at + first] + tail.starts, head.ends + [at + last] + tail.ends, head.ids + middle + tail.ids)
    enc, out = encoder(path), Pieces([], [], [])
    spans = [m.span() for m in WORD.finditer(text)]
    short = iter(enc.encode_words([text[a:b] for a, b in spans if b - a <= UNSPLIT]))
    for a, b in spans:
        if b - a <= UNSPLIT:
            tokens = [((0, b - a), next(short))]
        else:
            found = enc.tokenizer.encode(text[a:b], add_special_tokens=False)
            tokens = [(o, np.array([i], ID).tobytes()) for o, i in zip(found.offsets, found.ids, strict=True)]
        for (x, y), ids in tokens:
            out.starts.append(at + a + x)
            out.ends.append(at + a + y)
            out.ids.append(ids)
    return out


def kind(c: str) -> str:
    """The run of the tokenizer's pattern that c can belong to; '' where that depends on more than c."""
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "" if c in "'<>|" or c.isspace() else "O"


def one_run(text: str) -> bool:
    return bool(text) and kind(text[0]) != "" and len({kind(c) for c in text}) == 1


def _agree(text: str, side: Pieces, window: Pieces, lo: int, hi: int, at: int, left: bool) -> tuple[int, int] | None:
    """Places in side and window of a common piece from which both must go on alike.

    A word that white space bounds on both sides always is one. A token of a long
    word is one where all from the window's (or the right side's) begin to the
    token's end is a single run, as then only neighbours decide on a merge.
    """
    order = range(len(window.ids)) if left else range(len(window.ids) - 1, -1, -1)
    for k in order:
        a, b = window.starts[k], window.ends[k]
        if not (lo <= a and b <= at if left else at <= a and b <= hi):
            continue
        i = bisect_left(side.starts, a)
        if i == len(side.starts) or (side.starts[i], side.ends[i], side.ids[i]) != (a, b, window.ids[k]):
            continue
        if i + 1 < len(side.starts) and side.starts[i + 1] == a or i and side.starts[i - 1] == a:
            continue  # tokens of one character share its place
        free = (a == 0 or text[a - 1].isspace() and a - 1 >= (lo if left else at)) and b < (at if left else hi) and text[b].isspace()
        if free or 0 < k < len(window.ids) - 1 and one_run(text[lo if left else at : b] if left else text[at:b]) and (left or kind(text[b - 1]) == kind(text[at - 1])):
            return i, k
    return None


def join(text: str, left: Pieces, right: Pieces, lo: int, at: int, hi: int, path: str, window: int = WINDOW) -> Pieces:
    """The pieces of text[lo:hi] from those of text[lo:at] and text[at:hi]."""
    while True:
        a, b = max(lo, at - window), min(hi, at + window)
        mid = encode_pieces(text[a:b], a, path)
        whole_left, whole_right = a == lo, b == hi
        x = (0, 0) if whole_left else _agree(text, left, mid, a, b, at, True)
        y = (len(right.ids), len(mid.ids)) if whole_right else _agree(text, right, mid, a, b, at, False)
        if x and y:
            return Pieces(*(p[: x[0]] + m[x[1] : y[1]] + q[y[0] :] for p, m, q in zip(left, mid, right, strict=True)))
        window *= 2


def concatenate(text: str, leaves: list[Pieces], bounds: list[int], path: str) -> Pieces:
    """Joins neighbouring leaves in pairs until one is left. bounds: where leaves begin, and the end."""
    while len(leaves) > 1:
        pairs = [
            join(text, leaves[i], leaves[i + 1], bounds[i], bounds[i + 1], bounds[i + 2], path)
            for i in range(0, len(leaves) - 1, 2)
        ]
        leaves = pairs + leaves[len(pairs) * 2 :]
        bounds = sorted({*bounds[::2], bounds[-1]})
    return leaves[0]


def encode_long(text: str, path: str, leaf: int = LEAF) -> bytes:
    """Ids of one long text in this process, as the distributed plan makes them."""
    bounds = [*range(0, len(text), leaf), len(text)] if text else [0, 0]
    leaves = [encode_pieces(text[a:b], a, path) for a, b in zip(bounds, bounds[1:], strict=False)]
    return b"".join(concatenate(text, leaves, bounds, path).ids)


def _pack(p: Pieces) -> tuple[bytes, bytes, bytes, bytes]:
    return (
        np.array(p.starts, "<i8").tobytes(),
        np.array(p.ends, "<i8").tobytes(),
        np.array([len(x) // 4 for x in p.ids], "<u4").tobytes(),
        b"".join(p.ids),
    )


def _unpack(starts: bytes, ends: bytes, lengths: bytes, ids: bytes) -> Pieces:
    cuts = [0, *(np.frombuffer(lengths, "<u4").cumsum() * 4).tolist()]
    return Pieces(
        np.frombuffer(starts, "<i8").tolist(),
        np.frombuffer(ends, "<i8").tolist(),
        [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)],
    )


def as_ids(ids: list[bytes]) -> list[pa.Array]:
    return [pa.array(ids, pa.binary())]


def encode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    leaf: int = LEAF,
    finish: Callable[[list[bytes]], list[pa.Array]] = as_ids,
    columns: str = "ids binary",
) -> DataFrame:
    """id_col and what finish makes of the ids, per row of docs; ids are little-endian unsigned 32-bit.

    finish runs in the task that encodes, so that ids need not go through another one.
    """
    names = ["id", *(c.split()[0] for c in columns.split(","))]
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids = encoder(path).encode(part["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([part["id"], *finish(ids)], names)

    if not by_words(path):
        return rows.mapInArrow(short, f"id {id_type}, {columns}").withColumnRenamed("id", id_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for k in range(batch.num_rows):
                text, one = batch["text"][k].as_py(), batch.slice(k, 1)
                n = -(-len(text) // leaf)
                for a in range(0, n, FAN):
                    some = range(a, min(a + FAN, n))
                    same = [pa.concat_arrays([one[c]] * len(some)) for c in ("id", "row")]
                    yield pa.RecordBatch.from_arrays(
                        [*same, pa.array(some, pa.int32()), pa.array([n] * len(some), pa.int32()), pa.array([text[i * leaf : (i + 1) * leaf] for i in some])], ["id", "row", "k", "n", "text"]
                    )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts, places = part["text"].to_pylist(), part["k"].to_pylist()
            packed = [_pack(encode_pieces(t, k * leaf, path)) for t, k in zip(texts, places, strict=True)]
            columns = [pa.array(list(c), pa.binary()) for c in zip(*packed, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "starts", "ends", "lengths", "ids"])

    def joined(rows: pa.Table) -> pa.Table:
        """The node of the nodes in rows, which follow each other; its k is that of the first."""
        rows = rows.sort_by("k")
        col = {c: rows[c].to_pylist() for c in ("k", "text", "starts", "ends", "lengths", "ids")}
        text, begin = "".join(col["text"]), col["k"][0] * leaf
        parts = [_unpack(*x) for x in zip(col["starts"], col["ends"], col["lengths"], col["ids"], strict=True)]
        parts = [Pieces([x - begin for x in p.starts], [x - begin for x in p.ends], p.ids) for p in parts]
        whole = concatenate(text, parts, [*(k * leaf - begin for k in col["k"]), len(text)], path)
        whole = Pieces([x + begin for x in whole.starts], [x + begin for x in whole.ends], whole.ids)
        return pa.table([*(rows[c].slice(0, 1) for c in ("id", "row", "k", "n")), [text], *([x] for x in _pack(whole))], rows.schema.names)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([batch["id"], *finish(batch["ids"].to_pylist())], names)

    out, cell = f"id {id_type}, {columns}", f"id {id_type}, row long, k int, n int, text string"
    node = f"{cell}, starts binary, ends binary, lengths binary, ids binary"
    size = F.length("text")

    def nodes(some: DataFrame) -> DataFrame:
        cells = some.withColumn("row", F.monotonically_increasing_id()).select("id", "row", "text").mapInArrow(cut, cell)
        return cells.repartition("row", "k").mapInArrow(leaves, node).groupBy("row", F.expr(f"k div {FAN}")).applyInArrow(joined, node)

    roots = nodes(rows.where((size > leaf) & (size <= FAN * leaf))).unionByName(nodes(rows.where(size > FAN * leaf)).groupBy("row").applyInArrow(joined, node))
    return rows.where(size <= leaf).mapInArrow(short, out).unionByName(roots.mapInArrow(finished, out)).withColumnRenamed("id", id_col)


_tables: dict[str, list[str]] = {}


def decode(ids: bytes, path: str) -> str:
    """The library's decode(ids, skip_special_tokens=False); for a vocabulary without a decoder that is
    its tokens, separated by spaces."""
    if not by_words(path):
        return encoder(path).tokenizer.decode(np.frombuffer(ids, ID).tolist(), skip_special_tokens=False)
    if path not in _tables:
        t = encoder(path).tokenizer
        _tables[path] = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
    return " ".join(map(_tables[path].__getitem__, np.frombuffer(ids, ID).tolist()))


def round_trip(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, per row of docs."""

    def digests(ids: list[bytes]) -> list[pa.Array]:
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(decode(x, path).encode()).hexdigest() for x in ids], pa.string()),
        ]

    return encode(docs, path, leaf=leaf, finish=digests, columns="n_tokens long, ids_sha256 string, decoded_sha256 string")
