"""Substring dedup by paragraph MinHash banding.

Repeated passages begin and end anywhere, so a paragraph here is a run of ``WORDS`` words from an anchor that its
own words choose: the smallest hash of a word pair among ``REACH`` neighbours. Any passage of ``AROUND`` words or more thus has
a whole paragraph in every document it stands in, wherever that begins.

Paragraphs of equal words are one class, by 64-bit hash. A band is the anchor and the smallest hash of the
paragraph's five-word shingles under one of ``BANDS`` functions: near copies begin at the same anchor, so it costs no recall
and keeps unlike paragraphs apart. One other word in the middle leaves 16 of 26 shingles, of which the bands then miss 2 in 100 pairs.
Classes that share a band are compared by the exact edit distance of their words, at most ``EDITS`` of ``WORDS`` (a similarity of 0.8), group by
group, in tiles of bounded size; each comparison returns a spanning forest of its links. Components of the classes are the
clusters. Of each cluster the paragraph of the smallest document stays, the others are removed.

Documents are put in order of id and text once and written, and a paragraph's place is one number in that order. So results don't
depend on how the input is dealt, and paragraphs overlap just where their places are less than WORDS apart. Two classes are
compared unless all their paragraphs overlap.

Defined results: a null text is an empty one; texts of fewer than WORDS words have no paragraph; a repeated row's paragraphs are
copies of the first row's; a null id sorts first; an empty table gives an empty result; other columns travel in one struct,
so whatever their names are they stay as they were.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.storage import packed, saved, tasks_for
from tidemark.llm.wordids import _Known, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHINGLE, START = 5, 2
SMALL = 16
WORDS = 25  # a multiple of SHINGLE
REACH = 25  # not above WORDS, or gaps stay between the paragraphs of one passage
STRIDE = 12  # in a run of equal words, where any place would do
AROUND = WORDS + REACH - 1
EDITS = WORDS // 5
BRIDGE = 4
BANDS = 4
TILE = 256
WEIGHT = 1 << 20  # numbers in a tile
COLUMNS = 1 << 13
TASK = 64 << 20
BATCH = 256  # tiles of up to TILE classes go to Python at once
PLACE = np.uint64((1 << 24) - 1)
_rng = np.random.default_rng(7)
FACTORS = _rng.integers(1, 1 << 63, BANDS, np.uint64) | np.uint64(1)
WORD_FACTORS = _rng.integers(1, 1 << 63, SHINGLE, np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def words_in(text: str, lower: bool = False) -> list[str]:
    """The words of a text; with lower, A to Z in lower case as in the fingerprints."""
    return WORD.findall(text.translate(LOWER) if lower else text)


def _hash(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word)


_hashes = _Known(_hash, 200_000)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def run_hashes(h: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A hash of each run of width words, from the words' hashes."""
    n = len(h) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out += h[k : k + n] * WORD_FACTORS[k]
    return _mix(out)


def shingle_hashes(words: list[str]) -> np.ndarray:
    return run_hashes(word_hashes(words))


def anchors(h: np.ndarray, n_words: int) -> np.ndarray:
    """Places whose hash is the smallest of some REACH neighbouring ones, where a paragraph fits."""
    n = len(h)
    if n_words < WORDS:
        return np.zeros(0, np.int64)
    span = min(REACH, n)
    out = []
    for lo in range(0, n - span + 1, 1 << 22):  # places are kept in 24 bits
        part = h[lo : lo + (1 << 22) + span - 1]
        low = part & ~PLACE | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width < span:
            step = min(width, span - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        out.append(np.unique(low & PLACE).astype(np.int64) + lo)
    places = np.unique(np.concatenate(out))
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    since = places - new[np.searchsorted(new, places, "right") - 1]
    return places[(places <= n_words - WORDS) & (since % STRIDE == 0)]


def paragraphs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, band keys) of each paragraph of a text's words."""
    each = word_hashes(words)
    two, five = run_hashes(each, START), run_hashes(each)
    at = anchors(two, len(words))
    whole, keys = [np.zeros(0, np.uint64)], [np.zeros((0, BANDS), np.uint64)]
    for k in range(0, len(at), 1 << 14):
        places = at[k : k + (1 << 14)]
        ordered = np.zeros(len(places), np.uint64)
        for c in range(0, WORDS, SHINGLE):
            ordered = _mix(ordered * np.uint64(0xBF58476D1CE4E5B9) + five[places + c])
        some, begin = five[places[:, None] + np.arange(WORDS - SHINGLE + 1)], two[places]
        band = np.empty((len(places), BANDS), np.uint64)
        for b, f in enumerate(FACTORS):
            scaled = some * f
            low = (scaled ^ (scaled >> np.uint64(32))).min(axis=1)
            band[:, b] = _mix(_mix(begin + np.uint64(b + 1)) * np.uint64(0x94D049BB133111EB) + low)
        whole.append(ordered)
        keys.append(band)
    return at, np.concatenate(whole), np.concatenate(keys)


def ordered(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(row, doc_id, text[, doc]) of docs in order of id and text; row + a word's number is a place that no other word has."""
    columns = ["doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("tie")]
    if carry:
        columns += [F.col("text").isNull().alias("none"), packed(docs, "text")]
    keys = ["doc_id", "mark", "tie"]  # ties are between equal rows alone; they spread very many of them
    dealt = docs.select(*columns).repartitionByRange(tasks_for(docs, TASK), *keys).sortWithinPartitions(*keys).drop("mark", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        free = TaskContext.get().partitionId() << 42  # bytes of one task; a text has fewer words than bytes
        for batch in batches:
            sizes = pa.compute.binary_length(batch["text"]).to_numpy().astype(np.int64) + WORDS
            ends = free + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ends - sizes), *batch.columns], ["row", *batch.schema.names])
            free = int(ends[-1]) if len(ends) else free

    from pyspark.sql.types import LongType, StructField, StructType

    return saved(dealt.mapInArrow(run, StructType([StructField("row", LongType()), *dealt.schema.fields])), "rows")


def found(rows: DataFrame) -> DataFrame:
    """(row, pos, doc_id, h, keys) of all paragraphs of rows; pos is the place of its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            lengths, ats, hs, ks = [], [], [], []
            for text in part["text"].to_pylist():
                at, h, keys = paragraphs(WORD.findall(text))
                lengths.append(len(at))
                ats.append(at)
                hs.append(h)
                ks.append(keys)
            which = np.repeat(np.arange(part.num_rows), lengths)
            row, h = part["row"].to_numpy()[which], np.concatenate(hs)
            # of equal paragraphs of this part the first has keys: a passage that is everywhere costs little beyond
            new = np.zeros(len(h), bool)
            new[np.unique(h, return_index=True)[1]] = True
            keys = pa.array(np.concatenate(ks)[new].reshape(-1).view(np.int64))
            ends = np.concatenate([[0], np.cumsum(new * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(row + np.concatenate(ats)), part["doc_id"].take(pa.array(which)), pa.array(h.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), keys)],
                ["row", "pos", "doc_id", "h", "keys"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "text").mapInArrow(run, f"row long, pos long, doc_id {kind}, h long, keys array<long>")


def numbers_of(rows: DataFrame, wanted: DataFrame, make: Callable[[str], np.ndarray], size: int | None) -> DataFrame:
    """(h, first, last, numbers) of the wanted (h, row, first, last): what make gives for the row's text, the size numbers from place first."""
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("h", "first", "last")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts = pa.compute.list_value_length(part["asked"]).to_numpy()
            flat = part["asked"].flatten()
            first = flat.field("first").to_numpy()
            at = first - np.repeat(part["row"].to_numpy(), counts)
            ends, numbers, sizes = np.cumsum(counts), [np.zeros(0, np.int64)], []
            for text, a, b in zip(part["text"].to_pylist(), ends - counts, ends, strict=True):
                every = make(text).view(np.int64)
                some = np.tile(every, b - a) if size is None else every[at[a:b, None] + np.arange(size)].reshape(-1)
                numbers.append(some)
                sizes.append(np.full(b - a, len(every) if size is None else size))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(numbers)))
            yield pa.RecordBatch.from_arrays([flat.field("h"), flat.field("first"), flat.field("last"), lists], ["h", "first", "last", "numbers"])

    return rows.select("row", "text").join(asked, "row").mapInArrow(run, "h long, first long, last long, numbers array<long>")


def _common(sets: np.ndarray, which: np.ndarray, n: int, other: np.ndarray | None, other_which: np.ndarray | None, m: int) -> np.ndarray:
    """How many numbers set i of n and set j of m (or of the same n) share; numbers are distinct within a set, ``which`` names their set."""
    every, codes = np.unique(sets if other is None else np.concatenate([sets, other]), return_inverse=True)
    left, right = codes[: len(sets)], codes[len(sets) :]

    def incidence(codes: np.ndarray, which: np.ndarray, n: int, lo: int) -> np.ndarray:
        out = np.zeros((n, min(COLUMNS, len(every) - lo)), np.float32)
        take = (codes >= lo) & (codes < lo + COLUMNS)
        out[which[take], codes[take] - lo] = 1
        return out

    common = np.zeros((n, m), np.float32)
    for lo in range(0, len(every), COLUMNS):
        a = incidence(left, which, n, lo)
        common += a @ (a if other is None else incidence(right, other_which, m, lo)).T
    return common


def similar(sets: list[np.ndarray], other: list[np.ndarray] | None, like: float) -> np.ndarray:
    """Whether sets[i] and other[j] (or sets[j], j > i) have a Jaccard similarity of at least like."""

    def flat(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in x])
        return np.concatenate(x), np.repeat(np.arange(len(x)), sizes), sizes.astype(np.float32)

    a, which, sizes = flat(sets)
    b, other_which, other_sizes = (None, None, sizes) if other is None else flat(other)
    common = _common(a, which, len(sets), b, other_which, len(other_sizes))
    near = common >= np.float32(like) * (sizes[:, None] + other_sizes[None, :] - common) - 1e-4
    return np.triu(near, 1) if other is None else near


def edit_distances(x: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The edit distance of the words x and those in each row of ys, or of each row of x and of ys."""
    steps = np.arange(ys.shape[1] + 1)
    now = np.tile(steps, (len(ys), 1))
    for i in range(x.shape[-1]):
        best = np.concatenate([np.full((len(ys), 1), i + 1), np.minimum(now[:, :-1] + (ys != x[..., i : i + 1]), now[:, 1:] + 1)], 1)
        now = np.minimum.accumulate(best - steps, axis=1) + steps
    return now[:, -1]


def _numbered(words: np.ndarray) -> np.ndarray:
    """Words of each row made distinct: a word's second coming in a row is another number than its first."""
    order = np.argsort(words, axis=1, kind="stable")
    by = np.take_along_axis(words, order, 1)
    same = np.concatenate([np.zeros((len(words), 1), bool), by[:, 1:] == by[:, :-1]], 1)
    since = np.arange(words.shape[1]) - np.maximum.accumulate(np.where(same, 0, np.arange(words.shape[1])), axis=1)
    times = np.empty_like(since)
    np.put_along_axis(times, order, since, 1)
    return words + times * np.int64(0x5851F42D4C957F2D)


def near_paragraphs(words: np.ndarray, ends: np.ndarray, others: np.ndarray | None, other_ends: np.ndarray | None, edits: int = EDITS) -> list[tuple[int, int]]:
    """A spanning forest of the links (i, j) between rows of words and of others (or of words itself).

    ends holds the first and the last place of each class. A link is an edit distance of at most edits, of classes that have paragraphs apart from each
    other. Rows that are linked already aren't compared again, so many near copies of one paragraph cost little more than one pass.
    """
    n, width = words.shape
    m = n if others is None else len(others)
    bag, who = _numbered(words).reshape(-1), np.repeat(np.arange(n), width)
    if others is None:
        common = _common(bag, who, n, None, None, n)
    else:
        common = _common(bag, who, n, _numbered(others).reshape(-1), np.repeat(np.arange(m), width), m)
    right, right_ends, shift = (words, ends, 0) if others is None else (others, other_ends, n)
    far = np.maximum(right_ends[None, :, 1] - ends[:, None, 0], ends[:, None, 1] - right_ends[None, :, 0]) >= WORDS
    maybe = far & (common >= width - edits)
    if others is None:
        maybe = np.triu(maybe, 1)
    label = np.arange(n + m if shift else n)
    out = []
    for i in np.flatnonzero(maybe.any(axis=1)).tolist():
        js = np.flatnonzero(maybe[i])
        js = js[label[js + shift] != label[i]]
        if not len(js):
            continue
        near = (right[js] != words[i]).sum(axis=1) <= edits
        near[~near] = edit_distances(words[i], right[js[~near]]) <= edits
        for j in js[near].tolist():
            if label[j + shift] != label[i]:
                label[label == label[j + shift]] = label[i]
                out.append((i, j))
    return out


def near_pairs(words: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """Which of the pairs (i, j) of rows of words are links, as in near_paragraphs."""
    near = np.maximum(ends[j, 1] - ends[i, 0], ends[i, 1] - ends[j, 0]) >= WORDS
    for k in range(0, len(i), 1 << 15):
        some = k + np.flatnonzero(near[k : k + (1 << 15)])
        x, y = words[i[some]], words[j[some]]
        fits = (x != y).sum(axis=1) <= edits
        rest = np.flatnonzero(~fits)
        both = np.sort(np.concatenate([_numbered(x[rest]), _numbered(y[rest])], 1), axis=1)
        rest = rest[(both[:, 1:] == both[:, :-1]).sum(axis=1) >= words.shape[1] - edits]
        fits[rest] = edit_distances(x[rest], y[rest]) <= edits
        near[some] = fits
    return near


Compare = Callable[[pa.ListArray, pa.ListArray], tuple[np.ndarray, np.ndarray]]


def links(keyed: DataFrame, payload: Callable[[DataFrame], DataFrame], compare: Compare) -> DataFrame:
    """(a, b): links between classes that connect all which share a key and which compare links.

    keyed has (key, h), one row or more for each; payload gives (h, first, last, numbers) of the classes h it is asked for.
    """
    # which keys have more than one class is counted before it is shuffled, so no key is too frequent
    mixed = saved(keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key"), "mixed")
    members = saved(keyed.join(mixed, "key").select("key", "h").distinct(), "members")
    sets = saved(payload(members.select("h").distinct()), "numbers").withColumn("n", F.size("numbers"))
    # groups of any size become tiles of about TILE classes, and each two tiles of a group meet once
    many = F.greatest(F.count("*") / TILE, F.sum("n") / WEIGHT)
    sizes = members.join(sets.select("h", "n"), "h").groupBy("key").agg(F.greatest(F.ceil(many), F.lit(1)).cast("int").alias("tiles"))
    sizes = saved(sizes, "sizes")

    def tiled(which: str) -> DataFrame:
        return (
            members.join(sizes.where(which), "key")
            .join(sets, "h")
            .withColumn("t", F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int"))
            .groupBy("key", "tiles", "t")
            .agg(F.collect_list(F.struct("h", "first", "last", "numbers")).alias("rows"))
        )

    meetings = (
        tiled("tiles > 1")
        .select("key", "t", "rows", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u"))
        .select("key", F.least("t", "u").alias("x"), F.greatest("t", "u").alias("y"), "t", "rows")
        .groupBy("key", "x", "y")
        .agg(F.max(F.when(F.col("t") == F.col("x"), F.col("rows"))).alias("left"), F.max(F.when((F.col("t") == F.col("y")) & (F.col("x") != F.col("y")), F.col("rows"))).alias("right"))
        .where("left is not null and (x = y or right is not null)")
        .select("left", "right")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = compare(batch["left"], batch["right"])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    alone = tiled("tiles = 1").select(F.col("rows").alias("left"), F.lit(None).cast(meetings.schema["right"].dataType).alias("right"))
    return saved(alone.unionByName(meetings).mapInArrow(run, "a long, b long"), "links", batch=BATCH)


def by_group(left: pa.ListArray, right: pa.ListArray, forest: Callable[[pa.StructArray, pa.StructArray | None], list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """The links that forest finds in each tile, or between each two."""
    found = [np.zeros((0, 2), np.int64)]
    for x, y in zip(left, right, strict=True):
        a = x.values
        b = y.values if y.is_valid else a
        pairs = np.array(forest(a, b if y.is_valid else None), np.int64).reshape(-1, 2)
        if len(pairs):
            found.append(np.stack([a.field("h").to_numpy()[pairs[:, 0]], b.field("h").to_numpy()[pairs[:, 1]]], 1))
    ends = np.concatenate(found)
    return ends[:, 0].copy(), ends[:, 1].copy()


def _parts(rows: pa.StructArray | None) -> tuple:
    if rows is None:
        return None, None
    return rows.field("numbers").flatten().to_numpy().reshape(-1, WORDS), np.stack([rows.field(c).to_numpy() for c in ("first", "last")], 1)


def _compare(left: pa.ListArray, right: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Links of paragraphs; the many small groups are compared together, pair by pair."""
    sizes = pa.compute.list_value_length(left).to_numpy()
    small = (sizes <= SMALL) & ~right.is_valid().to_numpy(zero_copy_only=False)
    large = pa.array(~small)
    a, b = by_group(left.filter(large), right.filter(large), lambda x, y: near_paragraphs(*_parts(x), *_parts(y)))
    rows = left.filter(pa.array(small))
    flat = rows.flatten()
    words, ends = _parts(flat)
    sizes = sizes[small]
    begins, i, j = np.cumsum(sizes) - sizes, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(sizes).tolist():
        x, y = np.triu_indices(n, 1)
        at = begins[sizes == n][:, None]
        i.append((at + x).reshape(-1))
        j.append((at + y).reshape(-1))
    i, j = np.concatenate(i), np.concatenate(j)
    near, h = near_pairs(words, ends, i, j), flat.field("h").to_numpy()
    return np.concatenate([a, h[i[near]]]), np.concatenate([b, h[j[near]]])


def paragraph_links(rows: DataFrame, marks: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between the classes of marks; classes has h, row, first and last."""

    def payload(asked: DataFrame) -> DataFrame:
        wanted = classes.join(asked, "h", "left_semi").select("h", "row", "first", "last")
        return numbers_of(rows, wanted, lambda text: word_hashes(WORD.findall(text)), WORDS)

    return links(marks.where(F.size("keys") > 0).select("h", F.explode("keys").alias("key")), payload, _compare)


def classes_of(marks: DataFrame) -> DataFrame:
    """(h, n, first, last, row, doc): each class's number of paragraphs, its first and last place, and whose the first is."""
    return marks.groupBy("h").agg(
        F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.min_by("row", "pos").alias("row"), F.min_by("doc_id", "pos").alias("doc")
    )


def clusters(rows: DataFrame) -> DataFrame:
    """Paragraphs of rows that are in a cluster with others: row, pos, doc_id, component_id, removed, and row and pos of the
    cluster's first paragraph (keeper) and of the class's."""
    marks = saved(found(rows), "paragraphs")
    classes = saved(classes_of(marks), "classes")
    groups = components(paragraph_links(rows, marks, classes))
    known = classes.join(groups, classes["h"] == groups["node"], "left").where("n > 1 or component is not null")
    known = saved(known.select("h", "first", "row", "doc", F.coalesce("component", "h").alias("component")), "clustered")
    keeper = known.groupBy("component").agg(F.min("first").alias("kpos"), F.min_by("row", "first").alias("krow"), F.min_by("doc", "first").alias("component_id"))
    named = known.join(keeper, "component").select("h", "kpos", "krow", "component_id", "first", F.col("row").alias("frow"))
    return (
        marks.drop("keys")
        .join(named, "h")
        .select("row", "pos", "doc_id", "component_id", (F.abs(F.col("pos") - F.col("kpos")) >= WORDS).alias("removed"), "krow", "kpos", "frow", F.col("first").alias("fpos"))
    )


def repeats(docs: DataFrame) -> DataFrame:
    """Paragraphs that are in a cluster with others: doc_id, at (the number of its first word), component_id and removed.

    component_id is the smallest doc_id with a paragraph of the cluster; the first paragraph of it stays, and
    so does what overlaps it.
    """
    return clusters(ordered(docs)).select("doc_id", (F.col("pos") - F.col("row")).alias("at"), "component_id", "removed")


def runs(paragraphs: DataFrame) -> DataFrame:
    """(row, start, end, krow, kstart): what removed paragraphs cover of a row, joined where they touch and the earlier text (krow) runs along."""
    earlier = F.array_distinct(F.array(F.struct(F.col("krow").alias("row"), F.col("kpos").alias("pos")), F.struct(F.col("frow").alias("row"), F.col("fpos").alias("pos"))))
    at = (F.col("pos") - F.col("row")).alias("at")
    pairs = (
        paragraphs.where("removed")
        .select("row", "pos", at, F.explode(earlier).alias("k"))
        .where("pos <> k.pos")
        .groupBy("row")
        .agg(F.collect_list(F.struct(F.col("k.row").alias("krow"), (F.col("at") - (F.col("k.pos") - F.col("k.row"))).alias("shift"), "at")).alias("pairs"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = batch["pairs"].flatten()
            row = np.repeat(batch["row"].to_numpy(), pa.compute.list_value_length(batch["pairs"]).to_numpy())
            krow, shift, at = (pairs.field(c).to_numpy().astype(np.int64) for c in ("krow", "shift", "at"))
            order = np.lexsort((at, shift, krow, row))
            row, krow, shift, at = row[order], krow[order], shift[order], at[order]
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (krow[1:] != krow[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] > at[:-1] + WORDS)
            first, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True))
            columns = [row[first], at[first], at[last] + WORDS, krow[first], at[first] - shift[first]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "start", "end", "krow", "kstart"])

    return pairs.mapInArrow(run, "row long, start long, end long, krow long, kstart long")


def _around(rows: DataFrame, covered: DataFrame) -> DataFrame:
    """(krow, kstart, kend, before, after): up to AROUND words on either side of what runs cover of the earlier texts."""
    asked = covered.select("krow", "kstart", "kend").distinct().groupBy("krow").agg(F.collect_list(F.struct("kstart", "kend")).alias("asked"))
    texts = rows.select(F.col("row").alias("krow"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for row, text, asked in zip(part["krow"].to_pylist(), part["text"].to_pylist(), part["asked"], strict=True):
                words = WORD.findall(text)
                ends = np.stack([asked.values.field(c).to_numpy() for c in ("kstart", "kend")], 1)
                for k in range(0, len(ends), 1 << 13):
                    some = ends[k : k + (1 << 13)].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(some), row, np.int64)),
                            pa.array([a for a, _ in some], pa.int64()),
                            pa.array([b for _, b in some], pa.int64()),
                            pa.array([" ".join(words[max(a - AROUND, 0) : a]) for a, _ in some], pa.string()),
                            pa.array([" ".join(words[b : b + AROUND]) for _, b in some], pa.string()),
                        ],
                        ["krow", "kstart", "kend", "before", "after"],
                    )

    return texts.join(asked, "krow").mapInArrow(run, "krow long, kstart long, kend long, before string, after string")


def alike(a: list[str], b: list[str]) -> int:
    """How far a and b run along each other: over equal words, and over one other word where BRIDGE equal ones follow."""
    n, k = min(len(a), len(b)), 0
    while k < n:
        if a[k] == b[k]:
            k += 1
        elif k + BRIDGE < n and a[k + 1 : k + 1 + BRIDGE] == b[k + 1 : k + 1 + BRIDGE]:
            k += 1 + BRIDGE
        else:
            break
    return k


def grown(words: list[str], run: dict) -> tuple[int, int]:
    """A run's first word and the one after its last, with the words beside it that the earlier text has there as well.

    Within one row it stays clear of the earlier run, and as far from it as it grows.
    """
    start, end = run["start"], run["end"]
    before, after = WORD.findall(run["before"]), WORD.findall(run["after"])
    most = max(start - run["kend"], 0) if run["own"] else len(words)
    left = min(alike(before[::-1], words[max(start - AROUND, 0) : start][::-1]), most)
    right = min(alike(after, words[end : end + AROUND]), most - left)
    return start - left, end + right


def cut_out(text: str, cuts: list[dict]) -> str:
    """text without what the cuts cover once they have grown."""
    places = [m.span() for m in WORD.finditer(text)]
    words = [text[a:b] for a, b in places]
    parts, done = [], 0
    for start, end in sorted({grown(words, c) for c in cuts}):
        parts.append(text[done : max(places[start][0], done)])
        done = max(done, places[end - 1][1])
    return "".join([*parts, text[done:]])


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without what removed paragraphs cover and the equal words beside it, and without documents of which no word is left by that.

    n_chars, if there, is counted anew where words were removed.
    """
    rows = ordered(docs, carry=True)
    covered = saved(runs(clusters(rows)).withColumn("kend", F.col("kstart") + F.col("end") - F.col("start")), "runs")
    known = covered.join(saved(_around(rows, covered), "around"), ["krow", "kstart", "kend"])
    run_ = F.struct("start", "end", (F.col("row") == F.col("krow")).alias("own"), "kend", "before", "after")
    spans = known.groupBy("row").agg(F.collect_list(run_).alias("cut"))
    joined = rows.select("row", "text", "none", "doc").join(saved(spans, "cuts").hint("merge"), "row", "left")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, keep = [], []
            for text, none, cut in zip(batch["text"].to_pylist(), batch["none"].to_pylist(), batch["cut"], strict=True):
                if cut.is_valid:
                    text = cut_out(text, cut.as_py())
                    keep.append(bool(WORD.search(text)))
                else:
                    keep.append(True)
                texts.append(None if none else text)
            yield rebuilt(batch["doc"], names, texts, batch["cut"].is_valid()).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)


def rebuilt(doc: pa.StructArray, names: list[str], texts: list[str | None], changed: pa.Array | None = None) -> pa.RecordBatch:
    """The documents of the struct doc with other texts; n_chars, if there, is counted anew where the text has changed."""
    rest = dict(zip((f.name for f in doc.type), doc.flatten(), strict=True))
    if "n_chars" in rest:
        counts = pa.array([None if t is None else len(t) for t in texts], rest["n_chars"].type)
        rest["n_chars"] = counts if changed is None else pa.compute.if_else(changed, counts, rest["n_chars"])
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else rest[c] for c in names], names)
