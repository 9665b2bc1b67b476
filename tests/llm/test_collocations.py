"""Collocations against plain counting, tries against a dictionary."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from awkward import documents
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewall.llm import collocations, queries

SF = "/root/testdata/sf0.01"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=10, top=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = tuple(w for w in re.split("[ \t]", piece) if w)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rated = []
        for p, a in found.items():
            score, cut = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * found[q] >= 50 * a for q in found if p[0] in q):
                rated.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def tuples(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


@pytest.fixture
def small(monkeypatch):
    """Several dictionary files and shards also for a small table."""
    monkeypatch.setattr(collocations, "DICTIONARY", 9)
    monkeypatch.setattr(collocations, "SHARD", 7)


def rich(spark):
    rng = np.random.default_rng(5)
    words = ["the", "of", "New", "york", "CITY", "ä", "Ä", "x.y", "a b", "\x00", "日本", "end\x1c"] + [f"w{k}" for k in range(30)]
    odds = 1 / np.arange(1, len(words) + 1)
    rows = []
    for k in range(300):
        some = rng.choice(words, int(rng.integers(0, 60)), p=odds / odds.sum()).tolist()
        some[3:3] = ["New", "York", "City"] * int(rng.integers(0, 2))
        joins = rng.choice([" ", "  ", "\t", ". ", ",", "\x0b", "\r\n"], len(some) + 1, p=[0.8, 0.05, 0.05, 0.04, 0.02, 0.02, 0.02])
        rows.append((k, "".join(w + j for w, j in zip(some, joins)), [None, "und", "en", "de", "en"][k % 5], 1))
    rows += [(None, "a a a a a a a a a a a a a", "fr", 1)] * 3 + [(1, None, "fr", 1), (1, "", None, 1), (7, "New York. " * 40, "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, f long").withColumns({c: F.lit(7) for c in ("word", "n", "w0", "ids")})


@pytest.mark.parametrize("least", [10, 2])
def test_collocations(spark, small, least):
    docs = rich(spark)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert tuples(collocations.collocations(docs, least=least)) == plain(rows, least)
    assert tuples(collocations.collocations(docs, least=least, top=5)) == plain(rows, least, 5)


def test_awkward_and_empty(spark):
    docs = documents(spark)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert tuples(collocations.collocations(docs, least=4)) == plain(rows, 4)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("doc_id < 3")).count() == 0 or plain([r for r in rows])  # too few for candidates


def test_like_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({entry.oracle_sql()['op13_collocations']})")
    assert tuples(queries.QUERIES["op13_collocations"](spark, SF)) == sorted(cursor.fetchall())


@pytest.mark.parametrize("depth", [2, 3])
def test_double_array(depth):
    rng = np.random.default_rng(depth)
    words = np.sort(rng.choice(1 << 30, 900, replace=False))
    odds = 1 / np.arange(1, 901)
    rows = np.unique(words[rng.choice(900, (6000, depth), p=odds / odds.sum())], axis=0)
    rows = np.unique(np.concatenate([rows, np.column_stack([np.full(900, words[3])] * (depth - 1) + [words])]), axis=0)
    symbols, base, check, accept = collocations.double_array(rows)
    at = {int(s): k for k, s in enumerate(symbols)}

    def find(phrase):
        state = 0
        for w in phrase:
            if w not in at:
                return -1
            for digit in (at[w] >> 10, at[w] & 1023):
                slot = int(base[state]) + digit
                if not 0 < slot < len(check) or check[slot] != state:
                    return -1
                state = slot
        return accept[state]

    assert all(find(row) == k for k, row in enumerate(rows.tolist()))
    present = set(map(tuple, rows.tolist()))
    others = [t for t in map(tuple, words[rng.integers(0, 900, (4000, depth))].tolist()) if t not in present]
    assert len(others) > 1000 and all(find(t) == -1 for t in others)
    assert len(base) < 4 * depth * len(rows)


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of billions: the product of 10**6 and a square takes more than 64 bits."""
    docs = spark.createDataFrame([("a b c. " * 20, "x")], "text string, lang string")
    count = collocations.count_words

    def more(*args, **options):
        return count(*args, **options).withColumn("f", F.col("f") * 3_000_000_000)

    monkeypatch.setattr(collocations, "count_words", more)
    out = collocations.phrases(docs).where("size(words) = 2 AND words[0] = 'a'").first()
    assert (out["a"], out["l"], out["r"], out["score"]) == (20, 60_000_000_000, 60_000_000_000, 10**6 * 400 // (36 * 10**20))
