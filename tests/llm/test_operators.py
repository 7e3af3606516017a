"""Each operator against a brute-force version, over small and awkward documents."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, media, mixing, quality, repair, sharding, simhash, substring, urls, wordids
from tidemark.llm import queries as Q
from tidemark.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = """
row name h fp ids shard _words prefix n at keys key pos first last numbers asked removed component node doc text_ none mark tie cut krow kpos before after words w body
lines windows placed votes quality kept n_words base_failed n_symbols _row a b c k size hash bucket start local offset number blocks block turn spans taken target
source_size slots draw shard_bytes fits _bits _bytes _found _open _p5 _b5 _p0 _b0 media seq digest data lists owner part image doc_ids n_tokens inner starts ends lengths id
host path rule score grams codes weights verdict labels fingerprint component_id number_ stamp pieces
""".split()


def crowded(docs):
    """docs with extra columns whose names operators use inside."""
    return docs.withColumns({c: F.lit("x") for c in EXTRA})


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    n = min(4, len(words))
    hs = [xxh64_intdigest(" ".join(words[k : k + n]), 42) for k in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def unions(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    return root


@pytest.mark.parametrize("tile", [4, 1024])
def test_simhash(docs, rows, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    fps = [slow_fingerprint(t) for _, t in rows]
    root = unions([(a, b) for a in set(fps) for b in set(fps) if (a ^ b).bit_count() <= 4], set(fps))
    least = defaultdict(list)
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root(f)].append(i)
    want = Counter((i, f"{f:016x}", min(least[root(f)], default=None)) for (i, _), f in zip(rows, fps, strict=True))
    got = simhash.near_duplicates(crowded(docs)).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, got)) == want


def test_forest_of_a_large_cluster_is_small():
    rng = np.random.default_rng(1)
    fp = np.unique(np.uint64(1 << 40) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)))
    assert len(simhash.forest(fp, None, 4)) == len(fp) - 1


def test_components_of_a_long_chain(spark):
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_media(docs, rows):
    want = Counter()
    for i, t in rows:
        data = (t or "").encode()
        whole = data + b"\xff" * (-len(data) % 576 if data else 576)
        want[i, len(data), len(whole), hashlib.sha256(whole).hexdigest(), crc32(whole[-32:])] += 1
    got = media.media_columns(crowded(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()
    assert Counter(map(tuple, got)) == want


def test_cuts_move_with_the_content():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 400_000, np.uint8).tobytes()
    a, b = media.cuts(data), media.cuts(b"some bytes before" + data)
    assert a[-1] == len(data) and len({x + 17 for x in a} & set(b)) > len(a) / 2
    assert all(x <= media.MOST for x in np.diff([0, *a]))


def test_shared_stretches_are_stored_once(spark):
    """Copies of half a text give chunks that are stored once, and the images still read back."""
    rng = random.Random(2)
    half = " ".join(made(rng, 900))
    texts = [(k, " ".join(made(rng, 700)) + " " + half + (" " + half if k == 3 else "")) for k in range(6)] + [(7, half), (8, half), (9, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    kept = media.store(df).collect()
    whole = sum(len(media.image(media.payload(t))) for t in {t for _, t in texts})
    own = sum(r["own_bytes"] for r in kept)
    assert len(kept) == 8 and own < whole - 6 * 0.8 * len(half) and sum(not s["mine"] for r in kept for s in r["shared"]) > 60
    got = {r["doc_id"]: r["payload_sha256"] for r in media.media_columns(df).collect()}
    assert got == {i: hashlib.sha256(media.payload(t)).hexdigest() for i, t in texts}


def test_chunks_in_very_many_lists(spark, monkeypatch):
    monkeypatch.setattr(media, "LISTS", 3)
    rng = random.Random(2)
    half = " ".join(made(rng, 400))
    df = spark.createDataFrame([(k, half + f" {k} " + " ".join(made(rng, 60))) for k in range(40)], "doc_id long, text string")
    assert media.media_columns(df).where("payload_bytes >= n_bytes").count() == 40


def test_chunk_digests_save_bytes_of_the_documents(spark):
    """Beyond equal texts, which are one image: bytes of chunks that another image owns, 1.1 % here."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = media.store(docs).select("own_bytes", F.expr("aggregate(sizes, 0L, (a, x) -> a + x)").alias("n")).agg(F.sum("own_bytes"), F.sum("n")).first()
    assert kept[0] < 0.99 * kept[1], (kept[0], kept[1])


def test_damaged_store_is_an_error(docs):
    from pyspark.errors import PythonException

    kept = media.store(docs)
    with pytest.raises(PythonException, match="differs"):
        media.read(kept.withColumn("media", F.expr("unhex(repeat('00', 32))"))).collect()
    with pytest.raises(PythonException, match="missing"):
        media.read(kept.where("exists(shared, s -> not s.mine)")).collect()


def test_chat_equals_sql(spark):
    assert_same(Q.op3_chat_format(spark, SF), Q.OP3_SQL, SF)


def test_chat_collapse(spark):
    turns = [
        (1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "bot", "x"),
        (4, 5, "user", "a"), (4, 9, "bot", "x"), (4, 9, "bot", "x"), (None, 0, "user", None), (6, 0, "user", ""), (7, None, None, "z"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1))
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.rendered(df).collect()}
    assert set(got) == {2, 3, None, 6, 7}  # 1 is a prefix of 2, 4 equals 3; null and empty texts differ
    assert got[3] == (2, "<|user|>\na\n<|end|>\n<|bot|>\nx\n<|end|>\n")
    assert chat.rendered(df.limit(0)).count() == 0


def test_chat_blocks(spark, monkeypatch):
    df = spark.range(50).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    part = df.where("turn < 20").withColumn("conv_id", F.lit(2))
    monkeypatch.setattr(chat, "BLOCK", 7)
    assert [(r["conv_id"], r["n_turns"]) for r in chat.rendered(df.unionByName(part)).collect()] == [(1, 50)]


def library_ids(vocabulary, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    return t, np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_repair_files(docs, rows, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    ids = [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")) for i, x in rows]
    got = repair.token_files(crowded(docs), vocabulary, partitions=3, shard_tokens=5000).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), crc32(x.tobytes())) for i, x in ids)
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    words = [rng.integers(0, 3000, int(rng.integers(2, 9))) for _ in range(400)]
    docs = [np.concatenate([words[int(min(rng.exponential(60), 399))] for _ in range(200)] + ([np.arange(2000)] if k % 3 == 0 else [])) for k in range(60)]
    seq, starts = np.concatenate(docs).astype("<u4"), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    symbols, first, rules = repair.compress(seq, starts, 3000)
    ends = set(first.tolist())
    left = Counter((int(a), int(b)) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if k + 1 not in ends)
    assert max(left.values()) < repair.LEAST and repair.expansion_lengths(rules, 3000).max() >= 2000
    image = repair.image(symbols, first, np.diff(starts), rules, 3000)
    assert len(image) < 0.3 * 2 * len(seq)
    assert (np.concatenate(list(repair.Shard(image).documents())) == seq).all()


def test_repair_counts_every_bucket():
    """A frequent pair is replaced whichever its hash bucket is; this one's is 0."""
    pairs = [(a, b) for a in range(3000) for b in (7, 11) if ((a * 0x9E3779B1 ^ b * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - repair.BUCKET_BITS) == 0]
    a, b = pairs[0] if pairs else (0, 0)
    seq = np.array([x for k in range(100) for x in (a, b, 5000 + k)], "<u4")
    symbols, _, rules = repair.compress(seq, np.array([0, len(seq)]), 10_000)
    assert len(symbols) == 200 and rules.tolist() == [[a, b]]


def test_token_files_are_smaller_than_plain_ids(spark, vocabulary, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    repair.write(docs, vocabulary, f"file://{tmp_path}/t", partitions=1)
    kept = spark.read.parquet(f"file://{tmp_path}/t").agg(F.sum(F.octet_length("image")), F.sum("n_tokens")).first()
    assert kept[0] < 0.8 * 2 * kept[1], kept  # of plain 16-bit ids


@pytest.mark.parametrize("bits", [0, 1, 7, 8, 13, 16, 17, 31, 32])
def test_packed_numbers(bits):
    rng = np.random.default_rng(bits)
    values = rng.integers(0, 1 << bits, 101).astype("<u4")
    data = b"xy" + repair.pack(values, bits)
    assert len(data) == 2 + (101 * bits + 7) // 8
    for a, b in ((0, 101), (3, 3), (5, 64), (100, 101)):
        assert repair.unpack(data, 2, bits, a, b).tolist() == values[a:b].tolist()


def test_repair_round_trips():
    rng = np.random.default_rng(0)
    for t in range(100):
        n = int(rng.integers(1, 2000))
        seq = np.full(n, 5, "<u4") if t % 7 == 0 else rng.integers(0, [2, 3, 50][t % 3], n).astype("<u4")
        starts = np.concatenate([[0], np.sort(rng.integers(0, n + 1, 5)), [n]])
        symbols, first, rules = repair.compress(seq, starts, 100, least=4)
        shard = repair.Shard(repair.image(symbols, first, np.diff(starts), rules, 100))
        assert all((a == b).all() for a, b in zip(shard.documents(), np.split(seq, starts[1:-1]), strict=True))
        for k in range(len(shard)):
            want = seq[starts[k] : starts[k + 1]]
            assert (shard.document(k) == want).all()
            if len(want):
                assert shard.token(k, len(want) // 2) == want[len(want) // 2]


@pytest.mark.parametrize("limit", [2000, 20_000, 10**9])
def test_sharding(docs, rows, limit):
    got = sharding.sharded(crowded(docs), limit).collect()
    assert Counter((r["doc_id"], r["doc_bytes"]) for r in got) == Counter((i, len((t or "").encode())) for i, t in rows)
    size, count = Counter(), Counter()
    for r in got:
        size[r["shard"]] += r["doc_bytes"]
        count[r["shard"]] += 1
    assert all(size[s] <= limit or count[s] == 1 for s in size)
    assert {r["shard"]: r["shard_bytes"] for r in got} == dict(size)
    prefixes = sorted(size)
    assert all(not b.startswith(a) for a, b in zip(prefixes, prefixes[1:], strict=False))


def slow_directory(rows, limit, prefix=""):
    """{prefix: bytes}: the buckets that splitting from the root on gives; rows are (bits, bytes)."""
    if sum(n for _, n in rows) <= limit or len(rows) == 1 or len(prefix) == sharding.BITS:
        return {prefix: sum(n for _, n in rows)}
    halves = [[r for r in rows if r[0].startswith(prefix + b)] for b in "01"]
    return {k: v for b, half in zip("01", halves, strict=True) if half for k, v in slow_directory(half, limit, prefix + b).items()}


@pytest.mark.parametrize("limit", [700, 5000, 60_000, 10**9])
def test_directory_is_that_of_splits_from_the_root(docs, limit):
    hashed = sharding.saved(sharding._hashed(crowded(docs)), "hashed").select("bits", "bytes")
    got = {r["prefix"]: r["bytes"] for r in sharding.directory(hashed, limit).collect()}
    assert got == slow_directory([tuple(r) for r in hashed.collect()], limit)


def test_directory_with_one_heavy_side(spark):
    """Nearly all bytes are in a few rows, so most of the buckets at the depth that the total asks for fit earlier."""
    heavy = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 36, F.lit("x")).otherwise(F.repeat(F.lit("y"), 5000)).alias("text"))
    hashed = sharding.saved(sharding._hashed(heavy), "hashed").select("bits", "bytes")
    got = {r["prefix"]: r["bytes"] for r in sharding.directory(hashed, 100).collect()}
    assert got == slow_directory([tuple(r) for r in hashed.collect()], 100)


def test_sharding_splits_equal_rows(spark, docs):
    same = spark.range(64).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x" * 100).alias("text"))
    got = sharding.sharded(same, 1000).groupBy("shard").agg(F.sum("doc_bytes").alias("n")).collect()
    assert sum(r["n"] for r in got) == 6400 and all(r["n"] <= 1000 for r in got)


def made(rng, n):
    return [f"w{rng.randint(0, 10**9)}" for _ in range(n)]


def test_substring_finds_what_repeats(spark):
    rng = random.Random(4)
    passage, texts = made(rng, 51), []
    for k in range(40):
        words = made(rng, rng.randint(60, 300))
        at = rng.randint(0, len(words))
        texts.append((k, " ".join(words[:at] + (passage if k % 4 == 0 else []) + words[at:])))
    edited = list(passage) + made(rng, 40)
    edited[9] = "changed"
    texts += [(98, " ".join(edited)), (99, None), (100, ""), (None, "a b c")]
    df = crowded(spark.createDataFrame(texts, "doc_id long, text string"))
    hit = substring.repeats(df).collect()
    assert {r["doc_id"] for r in hit} == {k for k in range(0, 40, 4)} | {98}
    # a paragraph may reach a few words beyond the passage, where document 0 may end
    assert all(any(r["component_id"] == 0 and r["removed"] for r in hit if r["doc_id"] == k) for k in [*range(4, 40, 4), 98])
    rows = substring.deduplicated(df).collect()
    assert all(r[c] == "x" for r in rows for c in EXTRA)
    left = {r["doc_id"]: r["text"] for r in rows}
    assert left[0] == texts[0][1] and left[1] == texts[1][1] and left[99] is None and len(left) == len(texts)
    assert not {*passage} & {*left[98].split()} and len(left[98].split()) >= 36
    shared = Counter(tuple(w[k : k + 50]) for t in left.values() for w in [(t or "").split()] for k in range(len(w) - 49))
    assert max(shared.values()) == 1


@pytest.mark.parametrize("length", [50, 60, 300])
def test_substring_removes_whole_passages(spark, length):
    rng = random.Random(length)
    texts, parts = [], {}
    for k in range(0, 40, 2):
        passage, before, after = made(rng, length), made(rng, rng.randint(0, 80)), made(rng, rng.randint(1, 80))
        texts += [(k, " ".join(made(rng, 30) + passage + made(rng, 30))), (k + 1, " ".join(before + passage + after))]
        parts[k + 1] = before, passage, after
    left = {r["doc_id"]: r["text"].split() for r in substring.deduplicated(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for k, text in texts:
        if k % 2 == 0:
            assert left[k] == text.split()
        else:
            before, passage, after = parts[k]
            assert not {*passage} & {*left[k]}
            # a near paragraph may take up to EDITS words beside the passage
            assert any(left[k] == before[: len(before) - a] + after[b:] for a in range(6) for b in range(6))


def edited_passages(rng, kind):
    """Texts, and per copy to be found: (doc_id, its passage's words). Kinds differ in where edits are and where copies stand."""
    texts, want = [], []
    for k in range(0, 160, 2):
        length, places = {"middle": (51, [25]), "anywhere": (51, [rng.randrange(51)]), "two": (100, [33, 66]), "one document": (51, [25])}[kind]
        passage = made(rng, length)
        other = [w if j not in places else "changed" for j, w in enumerate(passage)]
        if kind == "one document":
            texts.append((k, " ".join(made(rng, 40) + passage + made(rng, rng.randint(0, 60)) + other + made(rng, 20))))
            want.append((k, other))
        else:
            texts += [(k, " ".join(made(rng, rng.randint(0, 60)) + passage + made(rng, 40))), (k + 1, " ".join(made(rng, rng.randint(0, 60)) + other + made(rng, 40)))]
            want.append((k + 1, other))
    return texts, want


@pytest.mark.parametrize("kind", ["middle", "anywhere", "two", "one document"])
def test_substring_recall_of_edited_passages(spark, kind):
    rng = random.Random(kind)
    texts, want = edited_passages(rng, kind)
    texts += [(1000 + k, " ".join(made(rng, 200))) for k in range(50)]
    hit = Counter(r["doc_id"] for r in substring.repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect() if r["removed"])
    assert sum(i in hit for i, _ in want) >= 0.95 * len(want)
    assert set(hit) <= {i for i, _ in want}


def slow_distance(x, y):
    now = list(range(len(y) + 1))
    for i, a in enumerate(x):
        before, now = now, [i + 1]
        for j, b in enumerate(y):
            now.append(min(before[j] + (a != b), before[j + 1] + 1, now[j] + 1))
    return now[-1]


def test_substring_links_against_all_pairs(spark):
    """Exact where they link, and nearly all pairs of paragraphs that begin alike, are near and stand apart."""
    rng, texts = random.Random(8), []
    for k in range(60):
        passage = made(rng, 50)
        for c in range(3):
            other = list(passage)
            for _ in range(rng.randint(0, 3)):
                j, how = rng.randrange(len(other)), rng.randrange(3)
                other[j : j + 1] = [[], ["changed"], [other[j], "more"]][how]
            texts.append((10 * k + c, " ".join(made(rng, 9) + other + made(rng, 9) + (other if c == 2 else []))))
    rows = substring.ordered(spark.createDataFrame(texts, "doc_id long, text string"))
    marks = substring.saved(substring.found(rows), "paragraphs")
    texts_by_row = {r["row"]: r["text"].split() for r in rows.collect()}
    words, places = {}, defaultdict(list)
    for r in marks.collect():
        at = r["pos"] - r["row"]
        words[r["h"]] = texts_by_row[r["row"]][at : at + substring.WORDS]
        places[r["h"]].append(r["pos"])
    got = [(r["a"], r["b"]) for r in substring.paragraph_links(rows, marks, substring.classes_of(marks)).collect()]

    def apart(a, b):
        return any(abs(x - y) >= substring.WORDS for x in places[a] for y in places[b])

    assert got and all(slow_distance(words[a], words[b]) <= substring.EDITS and apart(a, b) for a, b in got)
    want = [(a, b) for a in words for b in words if a < b and words[a][:2] == words[b][:2] and slow_distance(words[a], words[b]) <= substring.EDITS and apart(a, b)]
    root = unions(got, words)
    found = sum(root(a) == root(b) for a, b in want)
    assert len(want) > 100 and found >= 0.95 * len(want), (found, len(want))


def test_substring_does_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts, _ = edited_passages(random.Random(3), "one document")
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(k + 10**6, t) for k, t in texts + texts[:9]], "doc_id long, text string"))
    want = Counter(map(tuple, substring.deduplicated(docs).collect()))
    for n in (1, 7):
        assert Counter(map(tuple, substring.deduplicated(docs.repartition(n, F.rand(n))).collect())) == want


def test_edit_distances():
    rng = np.random.default_rng(5)
    x, ys = rng.integers(0, 3, 12), rng.integers(0, 3, (200, 12))
    assert substring.edit_distances(x, ys).tolist() == [slow_distance(x.tolist(), y.tolist()) for y in ys]
    assert substring._numbered(np.array([[5, 7, 5, 5]])).tolist()[0].__len__() == len(set(substring._numbered(np.array([[5, 7, 5, 5]]))[0].tolist()))


def test_substring_forest_of_many_near_copies():
    rng = np.random.default_rng(6)
    words = np.tile(rng.integers(0, 10**9, substring.WORDS), (300, 1))
    words[np.arange(300), rng.integers(0, substring.WORDS, 300)] = np.arange(300)
    ends = np.stack([np.arange(300) * 100] * 2, 1)
    assert len(substring.near_paragraphs(words, ends, None, None)) == 299
    assert len(substring.near_paragraphs(words[:100], ends[:100], words[100:], ends[100:])) >= 200
    assert substring.near_paragraphs(words, np.stack([np.arange(300) % 9] * 2, 1), None, None) == []  # they all overlap


def test_substring_similarity_is_exact():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, 20)) for _ in range(60)]
    want = [[j > i and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.5 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert (substring.similar(sets, None, 0.5) == np.array(want)).all()


def test_substring_of_nothing(empty):
    assert substring.repeats(empty).count() == 0 and substring.deduplicated(empty).count() == 0


@pytest.mark.parametrize("leaf", [40, 1 << 15])
def test_bpe(docs, rows, vocabulary, leaf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    want = Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    some = docs if leaf > 1000 else docs.where("text is null or length(text) < 3000")
    if leaf <= 1000:
        keep = [(i, x) for i, x in rows if x is None or len(x) < 3000]
        want = Counter()
        for i, text in keep:
            ids = t.encode(text or "", add_special_tokens=False).ids
            want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(crowded(some), vocabulary, leaf).collect())) == want


@pytest.mark.parametrize("fan", [2, 3])
def test_bpe_of_many_leaves(spark, vocabulary, fan, monkeypatch):
    monkeypatch.setattr(bpe, "FAN", fan)
    rng = random.Random(fan)
    texts = [(k, "".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(150 * k))) for k in range(7)]
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe.round_trip(spark.createDataFrame(texts, "doc_id long, text string"), vocabulary, 50).collect()}
    assert got == {k: hashlib.sha256(library_ids(vocabulary, t)[1].tobytes()).hexdigest() for k, t in texts}


def test_bpe_of_another_vocabulary(spark):
    """Where words can't be looked up, texts go to the library whole."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not wordids.by_words(path)
    texts = [(1, "two  spaces\n\nand lines " * 30), (2, None), (3, "é ß 12")]
    got = {r["doc_id"]: (r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(spark.createDataFrame(texts, "doc_id long, text string"), path, 40).collect()}
    for k, t in texts:
        tokenizer, ids = library_ids(path, t)
        assert got[k] == (hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest())


PARTS = ["a", "the", "ing", "e\u0301", "é", "ß", "'s", "'", "''", "<|endoftext|>", "<|start", "1", "23", " ", "\n", "\u3000", "\x1c", "日本", "\u1112\u1161", "≠", "=\u0338", "%%%", "Σ", "İ", "<", "|", "\x85", "\xa0"]


def test_bpe_joins_agree_with_the_library(vocabulary):
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(vocabulary), random.Random(6)
    for k in range(80):
        parts = PARTS if k % 2 else rng.sample(PARTS, 3)
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
        want = np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert wordids.encoder(vocabulary).encode([text])[0] == want
        for leaf in (7, 90):
            assert bpe.encode_long(text, vocabulary, leaf) == want, text


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([0, 10], [5, 2], 15) == [0.0, 15.0] and mixing.targets([], [], 0) == []


def test_permutation():
    for n in (1, 2, 3, 10, 1000):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(got.tolist()) == list(range(n))


def test_shards_add_up():
    totals, slots = [1000, 37, 5], 100
    shards = -(-sum(totals) // slots)
    parts = [mixing.shard_counts(totals, shards, slots, k, 1) for k in range(shards)]
    assert np.sum([c for _, c in parts], axis=0).tolist() == totals
    assert [int(c.sum()) for _, c in parts] == [100] * 10 + [42]
    assert all((parts[k][0] + parts[k][1] == parts[k + 1][0]).all() for k in range(shards - 1))


def slow_mix(got_sources, documents, block, slots, seed):
    """{(shard, slot): the block's words} by loops, from each source's documents in the order of their places."""
    totals = [r["slots"] for r in got_sources]
    shards = max(1, -(-sum(totals) // slots))
    out = {}
    for shard in range(shards):
        before, counts = mixing.shard_counts(totals, shards, slots, shard, seed)
        assert counts.sum() == min(slots, sum(totals) - shard * slots)
        done = 0
        for k, (r, n) in enumerate(zip(got_sources, counts.tolist(), strict=True)):
            for j in range(before[k], before[k] + n):
                turn, i = divmod(j, r["blocks"])
                at = int(mixing.permuted(np.array([i]), np.array([r["blocks"]]), np.array([mixing._mixed(seed, 7, k, turn)], np.uint64))[0])
                slot = int(mixing.permuted(np.array([done]), np.array([counts.sum()]), np.array([mixing._mixed(seed, 11, shard)], np.uint64))[0])
                out[shard, slot] = documents[k][at * block : (at + 1) * block]
                done += 1
        assert sorted(s for h, s in out if h == shard) == list(range(int(counts.sum())))
    return out


def test_mix(docs, rows):
    got = mixing.taken(crowded(docs)).collect()
    size = Counter((i, len(WORD.findall(t or ""))) for i, t in rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == size
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        x = by[r["source_size"], r["target"]]
        x[0] += r["taken"]
    assert all(abs(x[0] - t) <= max(2 * mixing.BLOCK, 0.02 * t) for (_, t), x in by.items())
    assert Counter(map(tuple, mixing.taken(docs.repartition(3, "text")).collect())) == Counter(map(tuple, got))  # reruns agree


def test_mix_against_loops(docs, rows):
    """Each slot of each shard holds the block that the loops find for it."""
    block, slots, seed = 32, 500, 20240229
    sized = mixing._rows(docs, with_text=True)
    sources = mixing.sources_of(sized, (5, 2, 1), 1.5, block)
    placed = mixing._positions(sized.select("row", "doc_id", "source", "size", "hash"), sources, 50)
    words = defaultdict(list)
    for r in placed.join(sized.select("row", "text"), "row").orderBy("number", "start").select("number", "start", "text").collect():
        assert len(words[r["number"]]) == r["start"]
        words[r["number"]] += WORD.findall(r["text"] or "")
    want = slow_mix(sorted(sources.collect(), key=lambda r: r["number"]), words, block, slots, seed)
    mix = mixing.mixed(crowded(docs), block=block, slots=slots, seed=seed, bucket=50).collect()
    got = defaultdict(list)
    for r in sorted(mix, key=lambda r: (r["shard"], r["slot"], r["at"])):
        assert len(got[r["shard"], r["slot"]]) == r["at"] and all(r["doc"][c] == "x" for c in EXTRA)
        got[r["shard"], r["slot"]] += WORD.findall(r["text"])
    assert got == want and len({s for s, _ in want}) > 3
    texts = mixing.documents(mixing.mixed(crowded(docs)), crowded(docs).columns)
    assert texts.columns == crowded(docs).columns
    assert sum(len(WORD.findall(r["text"])) for r in texts.collect()) == sum(r["taken"] for r in mixing.taken(docs).collect())


def test_many_equal_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SAME", 7)
    same = spark.range(200).select(F.lit(1).alias("doc_id"), F.lit("a").alias("source"), F.lit("x y z").alias("text"))
    sized = mixing._rows(same, with_text=False)
    starts = [r["start"] for r in mixing._positions(sized, mixing.sources_of(sized, (5,), 1.5, 32), 50).collect()]
    assert sorted(starts) == list(range(0, 600, 3))


def test_large_draws_have_the_hypergeometric_mean_and_spread():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**11, 10**11, 10**10
    got = np.array([mixing._draw(good, bad, n, rng) for _ in range(300)], np.float64)
    mean, spread = n * 0.75, (n * 0.75 * 0.25 * (1 - n / (good + bad))) ** 0.5
    assert abs(got.mean() - mean) < 5 * spread / 300**0.5 and 0.8 < got.std() / spread < 1.2
    assert mixing._draw(10**10, 0, 5, rng) == 5 and mixing._draw(0, 10**10, 5, rng) == 0
    small = [mixing._draw(2 * 10**9, 10**9, 3, rng) for _ in range(4000)]
    assert abs(np.mean(small) - 2) < 0.06 and set(small) == {0, 1, 2, 3}


def test_mix_of_nothing(empty):
    assert mixing.taken(empty).count() == 0 and mixing.mixed(empty).count() == 0


RULES = Q.url_rules()


def slow_judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def test_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = [(900, None), (901, ""), (902, "no scheme.com/en/"), (903, "http://EXAMPLE.com/en/7?x"), (904, "http://notcom/en/"), (905, "http://com/en/#a"), (906, "http://a.example.net/de/81"), (907, "x://a\nb/c"), (903, "http://EXAMPLE.com/en/7?x"), (None, "http://x.org/es/")]
    got = urls.judge(pages.unionByName(spark.createDataFrame(odd, pages.schema)).withColumns({"host": F.lit(1), "grams": F.lit(2)}), RULES).collect()
    given = Counter((r["page_id"], r["url"]) for r in pages.collect()) + Counter(odd)
    want = Counter()
    for (i, u), n in given.items():
        host, path, rule = slow_judge(u)
        want[i, host, path, rule.name if rule else None] += n
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == want
    verdicts = {r.name: r.verdict for r in RULES}
    assert all(r["verdict"] == verdicts[r["rule"]] for r in got if r["rule"])
    assert {r["verdict"] for r in got if not r["rule"]} <= {"allow", "block"}
    unruled = [r for r in got if not r["rule"]]
    cut = [r["score"] for r in unruled if r["verdict"] == "allow"], [r["score"] for r in unruled if r["verdict"] == "block"]
    assert min(cut[0], default=9) > max(cut[1], default=-9)


def slow_scores(rows):
    """Scores by models as loops over strings: rows are (url, label or None)."""
    import math

    def symbols(url):
        return [1] * urls.ORDER + [urls.ALPHABET.find(c) + 2 if c in urls.ALPHABET else 0 for c in (url or "").lower()]

    def model(some):
        seen = defaultdict(Counter)
        for url in some:
            x = symbols(url)
            for i in range(urls.ORDER, len(x)):
                for k in range(urls.ORDER + 1):
                    seen[tuple(x[i - k : i])][x[i]] += 1
        return seen

    def p(seen, context, symbol):
        out = 1 / urls.SYMBOLS
        for k in range(urls.ORDER + 1):
            c = seen.get(tuple(context[len(context) - k :]), Counter())
            if c.total() >= (urls.ENOUGH if k else 1):
                out = (c[symbol] + len(c) * out) / (c.total() + len(c))
        return out

    good, bad = (model([u for u, v in rows if v == want]) for want in ("allow", "block"))
    out = []
    for url, _ in rows:
        x = symbols(url)
        each = [math.log(p(good, x[i - urls.ORDER : i], x[i])) - math.log(p(bad, x[i - urls.ORDER : i], x[i])) for i in range(urls.ORDER, len(x))]
        out.append(sum(each) / len(each) if each else 0.0)
    return out


@pytest.mark.parametrize("hot", [4, 1 << 16])
def test_url_scores_against_loops(spark, hot, monkeypatch):
    monkeypatch.setattr(urls, "HOT", hot)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").limit(60).unionByName(spark.createDataFrame([(900, None), (901, "")], "page_id long, url string"))
    given = {r["page_id"]: r["url"] for r in pages.collect()}
    got = urls.judge(pages, RULES).collect()
    verdicts = {r.name: r.verdict for r in RULES}
    want = dict(zip(given, slow_scores([(u, verdicts.get(slow_judge(u)[2].name) if slow_judge(u)[2] else None) for u in given.values()]), strict=True))
    assert len(got) == len(given) and all(r["score"] == pytest.approx(want[r["page_id"]], abs=1e-6) for r in got)


def test_url_model_tells_held_out_urls_apart(spark):
    rng = random.Random(8)
    make = lambda good: "http://" + "".join(rng.choice("abcde" if good else "vwxyz") for _ in range(12)) + ("/good/" if good else "/bad/")
    rules = [urls.Rule("allow", "com", "/good/1"), urls.Rule("block", "com", "/bad/1")]
    rows = [(k, make(k % 2).replace("http://", "http://a").replace("/", ".com/", 3).replace(".com/.com/", "//", 1) + ("1" if k < 200 else "2")) for k in range(400)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert sum(r["verdict"] == ("allow" if r["page_id"] % 2 else "block") for r in got if not r["rule"]) >= 0.9 * sum(1 for r in got if not r["rule"])


def test_urls_without_labels_and_rows(spark):
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge(df, RULES).collect()] == ["allow"]
    assert urls.judge(df.limit(0), RULES).count() == 0


def slow_counts(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, rows):
    got = quality.judge(crowded(docs)).collect()
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = Counter((i, *slow_counts(t)) for i, t in rows)
    assert Counter((r["doc"]["doc_id"], *(r[c] for c in columns)) for r in got) == want
    assert all(r["doc"][c] == "x" for r in got for c in EXTRA)
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def slow_posteriors(votes):
    """Expectation-maximisation over single documents, with numpy."""
    v = np.array(votes)
    one = np.stack([v == k for k in (1, 0, -1)], 2).astype(float)
    p = (1 + (v == 1).sum(1)) / (2 + (v != 0).sum(1))
    for _ in range(2000):
        good = 1 + np.einsum("i,irv->rv", p, one)
        bad = 1 + np.einsum("i,irv->rv", 1 - p, one)
        prior = np.log((1 + p.sum()) / (1 + (1 - p).sum()))
        odds = prior + np.einsum("irv,rv->i", one, np.log(good / good.sum(1, keepdims=True)) - np.log(bad / bad.sum(1, keepdims=True)))
        before, p = p, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(p - before).max() < 1e-12:
            break
    return p


def test_quality_against_single_documents_and_labels(spark):
    """The posterior is that of expectation-maximisation over single documents, it isn't 'no rule votes bad', and it meets the labels better."""
    sf = "/root/testdata/sf0.1"
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), carry=["doc_id"]).select("doc.doc_id", "votes", "quality", "kept", "base_failed").toPandas()
    assert np.abs(slow_posteriors(judged["votes"].tolist()) - judged["quality"].to_numpy()).max() < 1e-9
    judged["all_pass"] = [not (np.array(v) < 0).any() for v in judged["votes"]]
    judged = judged[~judged["base_failed"]]
    assert 0.005 < (judged["kept"] != judged["all_pass"]).mean() < 0.05  # 1.1 % of them
    both = judged.merge(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label")).toPandas(), on="doc_id")
    agree = {c: (both[c] == (both["label"] == 1)).mean() for c in ("kept", "all_pass")}
    assert agree["kept"] > 0.99 and agree["kept"] > agree["all_pass"] + 0.005
    good = both[both["label"] == 1]
    assert good["kept"].mean() > 0.99 and both[both["label"] == 0]["kept"].mean() < 0.02


def test_quality_outvotes_a_rule_that_goes_against_the_others():
    rng = np.random.default_rng(2)
    good = rng.random(4000) < 0.8
    votes = [[int(x if rng.random() < (0.3 if r == 0 else 0.9) else -x) for r in range(6)] for x in np.where(good, 1, -1)]
    model = quality.expectation_maximisation(sorted(Counter(map(tuple, votes)).items()), 6)
    assert model.votes[0][1] < 0 < model.votes[0][-1] and all(w[1] > 0 > w[-1] for w in model.votes[1:])
    odds = np.array([model.prior + sum(w[x] for w, x in zip(model.votes, v, strict=True)) for v in votes])
    assert ((odds > 0) == good).mean() > 0.97


def test_quality_of_nothing(empty):
    assert quality.judge(empty).count() == 0


def slow_near_dedup(rows):
    """Ids that stay: of each group by fingerprints within 4 bits or shingles alike to 0.8, the row of smallest id and hash."""
    fps = [slow_fingerprint(t) for _, t in rows]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for _, t in rows for w in [substring.words_in(t or "", True)]]
    n = range(len(rows))
    near = [(i, j) for i in n for j in n if i < j and ((fps[i] ^ fps[j]).bit_count() <= 4 or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    root, least = unions(near, n), {}
    for i in n:
        key = (rows[i][0] is not None, rows[i][0] or 0)
        least[root(i)] = min(least.get(root(i), key), key)
    return Counter(i if known else None for known, i in least.values())


def test_pipeline_stages_over_odd_and_crowded_rows(spark, docs, rows):
    """Each stage against its operator or a loop, with values of clashing columns kept."""
    import corpus_pipeline

    stage, full = dict(corpus_pipeline.STAGES), crowded(docs)

    def run(name, given):
        out = stage[name](spark, given, SF)
        if name != "bpe_round_trip":
            assert out.columns == given.columns
            assert out.where(" or ".join(f"`{c}` is null or `{c}` <> 'x'" for c in EXTRA)).count() == 0
        return substring.saved(out, name)

    kept = run("quality_rules", full)
    judged = Counter(r["doc"]["doc_id"] for r in quality.judge(full).where("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == judged and sum(judged.values()) < len(rows)
    everything = [(r["doc_id"], r["text"]) for r in full.collect()]
    assert Counter(r["doc_id"] for r in run("near_dedup", full).collect()) == slow_near_dedup(everything)
    once = run("near_dedup", kept)
    assert Counter(r["doc_id"] for r in once.collect()) == slow_near_dedup([(r["doc_id"], r["text"]) for r in kept.collect()])
    cut = run("substring_dedup", once)
    removed = {r["doc_id"] for r in substring.repeats(once).where("removed").collect()}
    before, after = ([r for r in x.collect() if (r["doc_id"] in removed)] for x in (once, cut))
    assert Counter(map(tuple, once.collect())) - Counter(map(tuple, before)) == Counter(map(tuple, cut.collect())) - Counter(map(tuple, after))
    assert sum(len(r["text"]) for r in after) < sum(len(r["text"]) for r in before) and all(r["n_chars"] == len(r["text"]) for r in after)
    mix = run("source_mix", cut)
    assert sum(len(WORD.findall(r["text"])) for r in mix.collect()) == sum(r["taken"] for r in mixing.taken(cut).collect())
    coded = Counter((r["doc_id"], r["n_tokens"]) for r in run("bpe_round_trip", mix).collect())
    tokenizer, _ = library_ids(Q.word_vocabulary(), "")
    assert coded == Counter((r["doc_id"], len(tokenizer.encode(r["text"], add_special_tokens=False).ids)) for r in mix.collect())
    for name in stage:
        assert stage[name](spark, full.limit(0), SF).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_stages_leave_results_of_others_alone(spark, docs):
    import corpus_pipeline

    live = simhash.near_duplicates(docs)
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality_rules"](spark, docs, SF)  # read by the next stage without having been written
    assert stage["near_dedup"](spark, kept, SF).count() > 0
    corpus_pipeline.run(spark, SF).count()
    assert live.count() == docs.count()


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from types import SimpleNamespace

    from tidemark.llm.storage import shared_dir

    class Conf:
        def get(self, name, default):
            return default

    with pytest.raises(ValueError, match="share"):
        shared_dir(SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_near_dedup_finds_near_copies_at_the_wanted_similarity(spark):
    import corpus_pipeline

    rng, texts = random.Random(12), []
    for k in range(0, 120, 2):  # copies with 1 to 12 other words, far apart, of 300
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(300)]
        other = list(words)
        for j in range(k // 10 + 1):
            other[10 + 24 * j] = "other"
        texts += [(k, " ".join(words)), (k + 1, " ".join(other))]
    shingles = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for _, t in texts for w in [t.split()]]
    near = [k + 1 for k in range(0, 120, 2) if len(shingles[k] & shingles[k + 1]) >= 0.8 * len(shingles[k] | shingles[k + 1])]
    assert 20 < len(near) < 60
    texts += [(200, None), (200, None), (201, "x y"), (None, texts[0][1])]
    left = Counter(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(texts, "doc_id long, text string"), "").collect())
    assert sum(k in left for k in near) <= 1 and all(k in left for k in range(2, 120, 2))
    assert sum(k in left for k in range(1, 120, 2) if k not in near) >= 0.9 * (60 - len(near))
    assert left[200] == 1 and left[201] == 1 and left[None] == 1 and left[0] == 0
