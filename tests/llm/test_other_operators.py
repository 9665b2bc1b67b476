"""WARC, nearest neighbours, toxicity and the pipeline."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from awkward import CLASHING, documents
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from test_text_operators import RANKS, plain_components, plain_fingerprint, plain_masks
from tidewall.llm import ann, bpe, mixing, queries, suffix, toxicity, warc

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


# WARC


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    long = ["".join(chr(rng.randint(32, 0x24F)) for _ in range(900)) for _ in range(3)]
    rows = [(i, f"http://a.test/{i}", long[i % 3], 1) for i in range(0, 40, 2)]
    rows += [(None, None, long[0], 2), (41, "http://x/\r\nEvil: 1 ä", "short", 3), (43, "u", "short", 4), (45, "u", None, 5), (47, "u", "", 6)]
    rows += [(38, "u", long[1], 7), (38, "u", long[1], 7), (50, "u", "x" * 300_000, 8), (None, "u", "only nameless " * 99, 9)]
    rows += [(60, "u", "WARC/1.1\r\n\r\n" * 200, 1), (61, "u", "y" * 1000, 2), (62, "u", "y" * 1000, 2), (63, "u", "z" * 999, 2), (64, "u", "z" * 999, 2)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


def plain_records(rows):
    best = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000:
            best[raw] = max(best.get(raw, -(2**70)), -(2**70) if i is None else i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        original = best.get(raw)
        revisit = original is not None and original > -(2**70) and original != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", original if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("split", [100, 4096, 1 << 23])
def test_warc_round_trip(pages, split):
    archives = warc.write_archives(warc.with_originals(pages), archive_bytes=20_000)
    out = warc.read_archives(archives, split_bytes=split).drop("payload", "url").collect()
    assert sorted(map(str, map(tuple, out))) == plain_records([(r[0], r[1], r[2]) for r in pages.collect()])
    for path in [r["path"] for r in archives.collect()][:2]:
        with gzip.open(path.removeprefix("file:").replace("//", "/") if path.startswith("file:") else path) as f:
            assert f.read().startswith(b"WARC/1.1\r\n")


def test_false_magic_is_no_member():
    inner = warc.record(1, "u", b"inside", hashlib.sha1(b"inside").hexdigest(), None, False)
    junk = b"WARC no " + warc.MAGIC + b"\0\0\0\0\0\0\0" + zlib.compress(b"x")
    out, at = b"", []
    for k in range(6):
        at.append(len(out))
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: what looks like a magic stays visible
        body = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha1:\r\nContent-Length: {len(junk)}\r\n\r\n".encode()
        out += packer.compress(body + junk + b"\r\n\r\n") + packer.flush()
    out += inner
    at.append(len(out) - len(inner))
    for step in (7, 50, 1000, len(out)):
        found = [p for a in range(0, len(out), step) for p, _ in warc.members(lambda o, n: out[o : o + n], len(out), a, min(a + step, len(out)))]
        assert found == at


# nearest neighbours


def plain_nearest(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    length = max({len(v) for _, v in good}, key=lambda n: (sum(len(v) == n for _, v in good), n))
    good = [(i, v) for i, v in good if len(v) == length]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            scored = sorted(((-(v @ w) / np.sqrt((v @ v) * (w @ w)), j) for j, w in good if j != i))
            out[i] = [(round(-s, 9), j) for s, j in scored[:k]]
    return out


def test_nearest_on_awkward_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist(), "e") for i in range(1, 260)]
    hot = rng.normal(size=8).tolist()
    rows += [(i, hot, "e") for i in range(300, 520)]
    rows += [(1000, None, "e"), (1050, [0.0] * 8, "e"), (1100, [1.0, None] + [0.0] * 6, "e"), (1150, [float("nan")] * 8, "e"), (1200, [float("inf")] * 8, "e")]
    rows += [(1250, [1.0, 2.0], "e"), (None, hot, "e"), (1300, [], "e"), (1350, [x * 2 for x in hot], "e")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((round(r["score"], 9), r["vec_id"]))
    expected = plain_nearest([(r[0], r[1]) for r in rows])
    assert set(got) == set(expected)
    assert np.mean([len({j for _, j in got[q]} & {j for _, j in expected[q]}) / 5 for q in expected]) >= 0.9
    assert got[300][:4] == expected[300][:4]


def test_many_vectors_of_equal_cosine(spark):
    """Multiples of a vector by powers of two: more than are needed, and the smallest ids are the answer."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=6)
    rows = [(int(i), (base * 2.0**k).tolist()) for k, i in enumerate(rng.permutation(60))]
    rows += [(100 + k, rng.normal(size=6).tolist()) for k in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = [tuple(r)[:3] for r in ann.nearest(table, every=1).where("query_id < 60").orderBy("query_id", "rank").collect()]
    assert got == [(q, n + 1, i) for q in range(60) for n, i in enumerate([i for i in range(6) if i != q][:5])]


def test_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r)[:3] for r in ann.nearest(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert ann.nearest(table.where("vec_id < 0")).count() == 0
    assert ann.nearest(table.where("vec_id = 0")).count() == 0


def test_recall(spark):
    table = queries.table(spark, SF2, "embeddings")
    expected = plain_nearest([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {j for _, j in e}) / 5 for q, e in expected.items()]) >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(c, 0.1, (100, 4)) for c in range(6)])
    near = np.argsort(((points[:, None] - points[None]) ** 2).sum(2), axis=1)[:, 1:11]
    part = ann.balanced_parts(near, points, 6)
    assert np.bincount(part, minlength=6).max() <= 110
    assert np.mean(part[near] == part[:, None]) > 0.95


# toxicity


def test_toxicity_held_out(spark):
    docs, labels = queries.table(spark, SF2, "documents"), queries.table(spark, SF2, "labels")
    scored = queries.QUERIES["op9_toxicity"](spark, SF2)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert wins > 0.8
    assert scored.count() == docs.count()
    assert scored.where("score < 0 OR score > 1 OR (predicted = 1) != (score >= 0.5)").count() == 0
    held = {i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r["doc_id"] for r in scored.where("held_out").collect()} == held


def test_toxicity_on_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(0, 100)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    scored = toxicity.fit(docs, labels).score(docs)
    assert scored.count() == docs.count() and scored.where("score IS NULL").count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 1")).score(docs).where("score = 1").count() == docs.count()
    assert toxicity.fit(docs, labels.limit(0)).score(docs).where("score = 0").count() == docs.count()
    assert toxicity.fit(docs.limit(0), labels).score(docs.limit(0)).count() == 0


# pipeline


def test_stages_on_awkward_rows(spark, tmp_path):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 100)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for kind in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, kind, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= 3 * kind.count()
            # Columns named as the stages name their own come out as they went in.
            clashing = stage(spark, kind.withColumns({c: F.lit(777) for c in CLASHING}), str(tmp_path))
            assert clashing.columns == docs.columns + CLASHING, name
            assert sorted(map(str, clashing.select(docs.columns).collect())) == sorted(map(str, out.collect())), name
            assert clashing.where(" OR ".join(f"`{c}` IS DISTINCT FROM 777" for c in CLASHING)).count() == 0, name
        assert corpus_pipeline.encode(spark, kind, str(tmp_path)).count() == kind.count()


def test_pipeline(spark):
    """Each stage by a plain version on the rows of the stage before; toxicity by its own scores."""
    docs = queries.table(spark, SF2, "documents")
    labels = queries.table(spark, SF2, "labels")
    before, current = None, docs.cache()
    for name, stage in corpus_pipeline.STAGES:
        before, current = current, stage(spark, current, SF2).cache()
        rows = sorted(map(tuple, before.select("doc_id", "text", "source").collect()))
        got = current.collect()
        if name != "byte_bpe":
            assert current.columns == docs.columns
        if name == "toxicity":
            scores = toxicity.fit(docs, labels).score(docs).select("row.doc_id", "score").collect()
            assert sorted(r["doc_id"] for r in got) == sorted(i for i, score in scores if score < 0.5)
            assert 0.8 * len(rows) < len(got) < len(rows)
        if name == "simhash_near_dedup":
            fps = {i: plain_fingerprint(t) for i, t, _ in rows}
            of, first = plain_components(fps.values()), {}
            for i in sorted(fps):
                first.setdefault(of[fps[i]], i)
            assert sorted(r["doc_id"] for r in got) == sorted(first.values())
        if name == "suffix_array_dedup":
            kept = {i: bytes(b for b, m in zip(raw, mask) if not m).decode("utf-8", "ignore") for i, raw, mask in plain_masks(rows)}
            assert {r["doc_id"]: r["text"] for r in got} == kept
            assert all(r["n_chars"] == len(r["text"]) for r in got)
        if name == "mixing":
            times = {r["doc_id"]: r["repeats"] for r in mixing.mix(before).collect()}
            texts = {i: t for i, t, _ in rows}
            assert Counter(r["doc_id"] for r in got) == Counter({i: n for i, n in times.items() if n})
            assert all(r["text"] == texts[r["doc_id"]] for r in got)
        if name == "byte_bpe":
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
            expected = []
            for i, t, _ in rows:
                ids = np.array(library.encode_ordinary(t), "<u4").tobytes()
                expected.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), ids))
            assert sorted(map(tuple, got)) == sorted(expected)


def test_registered():
    names = set(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


def test_warc_like_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF2}/pages.parquet'")
    cursor = con.execute(entry.oracle_sql()["op6_warc"])
    names = [c[0] for c in cursor.description]
    got = entry.queries()["op6_warc"](spark, SF2).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cursor.fetchall()))
