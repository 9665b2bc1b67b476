"""Operators on texts against brute force over awkward rows, and over a given table."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from awkward import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewall.llm import bpe, components, digest, mixing, queries, simhash, suffix, tokencount, tokenfile, words

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module", params=["awkward", "given"])
def docs(request, spark):
    return documents(spark) if request.param == "awkward" else queries.table(spark, SF, "documents")


def rows_of(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]


def ordered(docs):
    return sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))


# mixing


def fill(words, weights, budget, most):
    """Targets by clamping one source at a time."""
    target, open_, rest = {}, set(words), budget
    while open_:
        level = rest / sum(weights[s] for s in open_)
        over = [s for s in open_ if most * words[s] < level * weights[s]]
        if not over:
            target |= {s: level * weights[s] for s in open_}
            break
        for s in over:
            target[s] = most * words[s]
            rest -= target[s]
            open_.remove(s)
    return target


def test_mix(docs):
    out = mixing.mix(docs).collect()
    rows = rows_of(docs)
    sizes = [len((t or "").encode().split()) for _, t, _ in rows]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"]) for r in out) == sorted(
        (i is not None, i or 0, n) for (i, _, _), n in zip(rows, sizes)
    )
    per = {}
    for (_, _, s), n in zip(rows, sizes):
        per[s] = per.get(s, 0) + n
    names = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    target = fill(per, {s: float(1 + k % 3) for k, s in enumerate(names)}, sum(sizes), 3)
    taken = {}
    for r in out:
        assert r["source_size"] == per[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["repeats"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in names:
        largest = max(n for (_, _, x), n in zip(rows, sizes) if x == s)
        same = 3  # rows of one id are taken alike
        assert abs(taken[s] - target[s]) <= same * largest
    again = mixing.mix(docs).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mixture(docs).count() == sum(r["repeats"] for r in out)
    assert mixing.mixture(docs).columns == docs.columns


def test_water_fill_redistributes(spark):
    plan = spark.createDataFrame([("a", 10.0, 5.0), ("b", 100.0, 1.0), ("c", 1000.0, 1.0)], "_source string, _words double, _weight double")
    out = {r["_source"]: r["_target"] for r in mixing.water_fill(plan, 1110.0, 3.0).collect()}
    assert out == pytest.approx({"a": 30.0, "b": 300.0, "c": 780.0})


# token files


def test_token_files(spark, docs, tmp_path):
    manifest = tokenfile.write_tokens(docs, WORDS, folder=f"file://{tmp_path}", frame_bytes=4096, shard_bytes=1 << 14)
    got = tokenfile.read_tokens(manifest).collect()
    library = Tokenizer.from_file(WORDS)
    at, expected, by_id = 0, [], {}
    for i, t, _ in ordered(docs):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        expected.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        by_id.setdefault(i, []).append(ids)
        at += len(ids) // 4
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    shard = manifest.orderBy(F.desc("documents")).first()["path"]
    reader = tokenfile.ShardReader(shard)
    wanted = [int(i) for i, n in zip(reader.entries["id"], reader.entries["null"]) if not n][::3]
    for i, ids in reader.get(wanted).items():
        assert ids in by_id[i]
    reader.close()


def test_broken_frame_is_noticed(tmp_path):
    writer = tokenfile.ShardWriter(64)
    for i in range(40):
        writer.add(i, bytes(range(40)))
    path = tmp_path / "a.tok"
    data = bytearray(writer.finish())
    data[20] ^= 1
    path.write_bytes(data)
    reader = tokenfile.ShardReader(str(path))
    with pytest.raises(Exception):
        list(reader.documents())
    assert len(reader.get([39])) == 1  # other frames are not touched


def test_words_like_the_library():
    mine, library = words.WordPieces(WORDS, memory=50), Tokenizer.from_file(WORDS)
    import random

    import pyarrow as pa

    rng = random.Random(1)
    signs = ["a", "B", "'", "s", " ", "\n", ".", "1", "é", "É", "́", "Σ", "İ", "<|", "|>", "endoftext", " ", "ª", "²", "\x1c", "漢", "\U0001f600"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["H̱ x<|endoftext|>y <|ENDOFTEXT|>"]
    for text, ids in zip(texts, mine.encode_all(pa.array(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


# byte BPE


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_round_trip(docs, library):
    got = sorted(map(str, bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()))
    expected = []
    for i, t, _ in rows_of(docs):
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        sha = hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
        expected.append(f"Row(doc_id={i}, n_tokens={len(ids) // 4}, ids_sha256='{sha[0]}', decoded_sha256='{sha[1]}')")
    assert got == sorted(expected)


def test_transducer_like_plain_merging(library):
    import random

    rng, ranks = random.Random(2), bpe.load_ranks(RANKS)
    merges, fst, tokens = bpe.Merges(ranks), bpe.Transducer(ranks, states=500), list(ranks)
    for _ in range(1500):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 5)))
        assert fst.run(piece) == [ranks[p] for p in merges.merge(piece)]
    for _ in range(300):
        piece = bytes(rng.choice(b"ab ") for _ in range(rng.randint(1, 80)))
        assert fst.run(piece) == [ranks[p] for p in merges.merge(piece)]


def test_utf8_stream_at_any_cut():
    text = "aä€\U0001f600ࠀ퟿\U0010ffff"
    for raw in (text.encode(), b"\xe2\x82", b"\xff\xe0\x80x\xed\xa0\x80\xf5a\xf0\x9f", b"\xc3\xc3\xa4\x80"):
        for a in range(len(raw) + 1):
            for b in range(a, len(raw) + 1):
                stream = bpe.Utf8Stream()
                out = stream.feed(raw[:a]) + stream.feed(raw[a:b]) + stream.feed(raw[b:]) + stream.close()
                assert out == raw.decode("utf-8", "replace"), (raw, a, b)


# token counts


def test_ids_beyond_the_width_are_an_error_however_long_the_text():
    assert tokencount.narrow(np.array([0, 65535], "<u4")).tobytes() == b"\0\0\xff\xff"
    assert tokencount.narrow(np.array([], "<u4")).tobytes() == b""
    with pytest.raises(ValueError, match="70000"):
        tokencount.narrow(np.array([5, 70000], "<u4"))


def test_transducer_adds_one_state_for_a_new_piece():
    ranks = bpe.load_ranks(RANKS)
    machine, merges = bpe.Transducer(ranks), bpe.Merges(ranks)
    rng = np.random.default_rng(5)
    for k in range(300):
        piece = bytes(rng.choice(list(b"aeinrst" if k % 2 else range(256)), rng.integers(1, 40)).tolist())
        before = len(machine._states)
        for _ in range(3):
            assert machine.run(piece) == [ranks[part] for part in merges.merge(piece)]
        assert len(machine._states) <= before + 3  # one a run, not one a byte


def test_space_beside_white_space():
    encoder = bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN, 1 << 20)
    assert [bool(encoder._odd(t)) for t in ("", " ", "a b", "a\nb", "a  b", "a \nb", "a\x85 b", "a \u3000b", "\u2003 b", "a\x1c b")] == [False] * 4 + [True] * 5 + [False]


def test_worker_drops_what_a_task_kept():
    from tidewall.llm import common

    def run(batches):
        common.kept("once", ("table",), lambda: [1])
        yield from batches

    list(common.task("once")(run)(iter([1])))
    assert list(common._KEPT) == [("table",)]
    list(common.task("once", keep=False)(run)(iter([1])))
    assert not common._KEPT


def test_token_counts(docs, library, tmp_path):
    names = tokencount.write_flat(docs, RANKS, public_tokenizers.PATTERN, 50256, folder=f"file://{tmp_path}", file_bytes=1 << 12)
    for block in (64, 1 << 20):
        out = tokencount.count_tokens(names.select("path").distinct(), 50256, block_bytes=block)
        got = [(r["doc_id"], r["n_tokens"]) for r in out.where("complete").join(names, ["path", "ordinal"], "full").collect()]
        expected = [(i, len(library.encode_ordinary(t or "")) + 1) for i, t, _ in rows_of(docs)]
        assert sorted(map(str, got)) == sorted(map(str, expected))


def test_token_counts_without_an_end(spark, tmp_path):
    np.array([5, 9, 9, 5, 5, 5, 5, 5, 9, 5, 5], "<u2").tofile(tmp_path / "a")
    np.array([], "<u2").tofile(tmp_path / "b")
    np.array([5] * 9, "<u2").tofile(tmp_path / "c")
    files = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in "abc"], "path string")
    for block in (2, 4, 6, 100):
        out = tokencount.count_tokens(files, 9, block_bytes=block).orderBy("path", "ordinal").collect()
        assert [(r["path"][-1], *r[1:]) for r in out] == [
            ("a", 0, 0, 2, True), ("a", 1, 2, 1, True), ("a", 2, 3, 6, True), ("a", 3, 9, 2, False), ("c", 0, 0, 9, False)
        ]


# SimHash


def plain_fingerprint(text):
    parts = ("".join(c.lower() if c.isascii() else c for c in text or "")).encode().split()
    shingles = [b" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] or ([b" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    names = sorted(set(fps))
    of = {f: f for f in names}
    changed = True
    while changed:
        changed = False
        for a in names:
            for b in names:
                if of[b] < of[a] and (a ^ b).bit_count() <= 3:
                    of[a], changed = of[b], True
    return of


def test_simhash(docs):
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    rows = rows_of(docs)
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    of, first = plain_components(fps), {}
    for (i, _, _), f in zip(rows, fps):
        if i is not None:
            first[of[f]] = min(first.get(of[f], i), i)
    expected = [(i, f"{f:016x}", first.get(of[f])) for (i, _, _), f in zip(rows, fps)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    kept = [r["doc_id"] for r in simhash.one_of_each(docs).select("doc_id").collect()]
    assert len(kept) == len(set(of.values())) and set(first.values()) == {i for i in kept if i is not None}


def test_links_in_crowded_segments(spark, monkeypatch):
    """Many fingerprints under one segment, in blocks of eight, and links over both segments."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(3)
    centre = [int(c) for c in rng.integers(0, 1 << 63, 3, dtype=np.uint64)]
    fps = {c ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for c in centre for _ in range(120)}
    fps |= {centre[0] ^ (1 << int(b)) ^ (0x5A << 40) for b in rng.choice(32, 20, replace=False)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    back = {int(np.int64(s).view(np.uint64)): s for s in signed}
    mine = {}
    for f, s in back.items():
        mine.setdefault(found.get(s, s), set()).add(f)
    plain = {}
    for f, root in plain_components(list(fps)).items():
        plain.setdefault(root, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, plain.values()))


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}


# digest


def test_digest(docs):
    got = digest.fingerprints(docs).collect()
    rows = ordered(docs)
    expected = []
    for k, (i, t, _) in enumerate(rows):
        text, following = t or "", rows[k - 1][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        marks = [digest.digest(x.encode()) for x in (text, edited, following)]
        expected.append((
            i, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0].hex(), marks[1].hex(),
            digest.likeness(marks[0], marks[1]), digest.likeness(marks[0], marks[2]),
        ))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_digest_counts_triplets():
    raw = bytes(range(256)) * 9000  # over a block's end
    counts = np.zeros(256, int)
    for a in range(len(raw) - 2):
        if a % 997 == 0 or a > len(raw) - 9:
            counts[((raw[a] | raw[a + 1] << 8 | raw[a + 2] << 16) * 2654435761 % 2**32) >> 24] += 1
    assert digest.bucket_counts(raw).sum() == len(raw) - 2
    part = raw[:3000]
    plain = np.bincount([((part[a] | part[a + 1] << 8 | part[a + 2] << 16) * 2654435761 % 2**32) >> 24 for a in range(2998)], minlength=256)
    assert (digest.bucket_counts(part) == plain).all()
    a, b = digest.digest(b"some words in a row"), digest.digest(b"")
    assert digest.difference(a, a) == 0 and 0 <= digest.difference(a, b) <= digest.bound() and 0 <= digest.likeness(a, b) <= 1


def test_digest_tells_edits_from_others(docs):
    out = digest.fingerprints(docs).where("n_chars > 300").collect()
    if len(out) > 100:
        assert np.mean([r["near_edited"] > r["near_next"] for r in out]) > 0.9


# suffix arrays


def plain_masks(rows, length=50):
    """Each row's id, bytes, and a mark for every byte that goes."""
    first = {}
    for i, t, _ in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            o = np.inf if i is None else i
            first[s] = min(first.get(s, np.inf), o)
    out = []
    for i, t, _ in rows:
        raw = (t or "").encode()
        mask = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < (np.inf if i is None else i):
                mask[p : p + length] = b"\1" * length
        out.append((i, raw, mask))
    return out


def plain_removal(rows, length=50):
    out = []
    for i, raw, mask in plain_masks(rows, length):
        spans = sum(1 for k in range(len(mask)) if mask[k] and not (k and mask[k - 1]))
        kept = bytes(b for b, m in zip(raw, mask) if not m)
        out.append((i, len(raw), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_suffix_dedup(docs, batches):
    got = suffix.digests(suffix.remove_repeats(docs, batches=batches, shard_bytes=1 << 15)).collect()
    assert sorted(map(str, map(tuple, got))) == plain_removal(rows_of(docs))


def test_suffix_levels_and_blocks(spark, monkeypatch):
    """Levels merge geometrically; chunks and blocks that cut runs change nothing."""
    docs = documents(spark)
    index = suffix.SuffixIndex(spark, 3, chunk_bytes=700)
    bounds = [None, -1, 5, 20, 40, 60, 80, None]
    sizes = []
    for low, high in zip(bounds[:-1], bounds[1:]):
        inside = (F.lit(True) if low is None else F.col("doc_id") > low) & (F.lit(True) if high is None else F.col("doc_id") <= high)
        if high is None:
            inside |= F.col("doc_id").isNull()
        index.add(docs.where(inside))
        sizes.append(index.levels)
    assert sizes[-1] == [4, 2, 1] and sizes[3] == [2, 1, 1]
    got = suffix.digests(index.removed()).collect()
    assert sorted(map(str, map(tuple, got))) == plain_removal(rows_of(docs))
    buffer = "".join(t or "" for _, t, _ in rows_of(docs)).encode()[:9000]
    ends = np.array([3000, 3010, 9000])
    whole = suffix.sample_suffixes(buffer, ends)
    monkeypatch.setattr(suffix, "_BLOCK", 777)
    cut = suffix.sample_suffixes(buffer, ends)
    covered = [sorted(x for a, n in zip(r[2].tolist(), r[3].tolist()) for x in range(a, a + n)) for r in (whole, cut)]
    assert covered[0] == covered[1] == [*range(0, 2951), *range(3010, 8951)]


def common_passage(n):
    """A passage in all of `n` texts, which go on in ways of their own; some ways are shared by a few."""
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz     ", np.uint8)
    own = [rng.choice(letters, 90).tobytes().decode() for _ in range(2 * n)]
    passage = rng.choice(letters, 150).tobytes().decode()
    return [(k, own[k] + passage + (own[n + k // 3][:20] + own[k][::-1] if k % 2 else own[n + k][:60])) for k in range(n)] + [(None, passage), (2, passage * 2)]


@pytest.mark.parametrize("batches", [1, 4])
def test_runs_of_one_anchor_are_dealt_out(spark, monkeypatch, batches):
    """Each text has a run of its own where the common passage ends: their windows go to many tasks, with the same results."""
    rows = common_passage(400)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = plain_removal([(i, t, None) for i, t in rows])
    monkeypatch.setattr(suffix, "CROWDED", 150)
    got = suffix.digests(suffix.remove_repeats(table, batches=batches)).collect()
    assert sorted(map(str, map(tuple, got))) == expected
    index = suffix.SuffixIndex(spark, 16)
    index.add(table)
    windows = {}
    for shard, kind, data in index._windows(index._found[0]).collect():
        if kind != suffix._SETTLED:
            kinds = ("<u8", "<i8", "<u4", "<u4", np.uint8) if kind == suffix._RUNS else ("<u8", "<i8", "<u4")
            parts = suffix._unpack(data[8:], *kinds)
            windows[shard] = windows.get(shard, 0) + (int(parts[3].sum(dtype=np.int64)) if kind == suffix._RUNS else len(parts[0]))
    assert sum(windows.values()) > 2000 and max(windows.values()) < sum(windows.values()) / 8


def test_long_passages(spark):
    """Runs of more than 255 windows, whole and in parts."""
    rng = np.random.default_rng(12)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    passage = "a" * 40 + rng.choice(letters, 2500).tobytes().decode()
    texts = [passage, "x" + passage, passage[300:2000] + "y", passage[100:900] + passage[700:1500], passage[-700:]]
    rows = [(k, t, None) for k, t in enumerate(texts)]
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    for length in (270, 400, 600):
        got = suffix.digests(suffix.remove_repeats(table, batches=2, length=length)).collect()
        assert sorted(map(str, map(tuple, got))) == plain_removal(rows, length)


def test_clean_keeps_rows_and_columns(spark):
    docs = documents(spark)
    out = suffix.clean(docs)
    assert out.dtypes == docs.dtypes and out.count() == docs.count()
    assert out.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert out.groupBy("lang", "source", "n_chars").count().exceptAll(docs.groupBy("lang", "source", "n_chars").count()).count() == 0


def test_clean_keeps_other_columns_as_they_are(spark):
    docs = documents(spark).where("doc_id IS NOT NULL").select(
        "doc_id", "text", (F.col("doc_id") % 2).alias("_null"), F.lit("x").alias("__NULL"),
        F.timestamp_micros(F.lit(1_700_000_000_123_456) + F.col("doc_id")).alias("seen"),
        F.timestamp_micros(F.lit(-4_000_000_000_123_457)).alias("old"),
        F.array(F.expr("timestamp_ntz'2024-02-29 01:02:03.000007'")).alias("local"),
    )
    out = suffix.clean(docs)
    assert out.dtypes == docs.dtypes
    assert out.where("text IS NULL").count() == docs.where("text IS NULL").count() > 0
    others = [c for c in docs.columns if c != "text"]
    assert sorted(map(str, out.select(others).collect())) == sorted(map(str, docs.select(others).collect()))


def test_empty_tables(spark):
    none = documents(spark, empty=True)
    assert mixing.mix(none).count() == 0
    assert tokenfile.read_tokens(tokenfile.write_tokens(none, WORDS)).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0
    names = tokencount.write_flat(none, RANKS, public_tokenizers.PATTERN, 50256)
    assert tokencount.count_tokens(names.select("path"), 50256).count() == 0
    assert digest.fingerprints(none).count() == 0
    assert suffix.remove_repeats(none).count() == 0
