"""The factorisation machine against sums over all pairs, its features against plain counts, held-out labels."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from awkward import CLASHING, documents
from pyspark.sql import functions as F

from tidewall.llm import quality, queries

SF = "/root/testdata/sf0.01"
TEXTS = [b"The cat. The dog!\nThe cat. The dog!\n", b"", b" \n ", b"AND&&& THE### end", "übel 日本 1234 übel".encode(), b"a b c a b c a b c", b"x"]


def vector(raw, extra, model):
    """A text's features one by one: words by hash, statistics by counting characters."""
    words = raw.lower().split()
    weights = {}
    for word, n in Counter(zlib.crc32(w) % quality.BUCKETS for w in words).items():
        weights[word] = math.log(1 + n)
    length = math.sqrt(sum(x * x for x in weights.values()))
    weights = {k: x / length for k, x in weights.items()}
    dense = [0.0] * len(quality.STATISTICS)
    if words:
        lines = [line for line in raw.split(b"\n") if line.strip()]
        triples = list(zip(words, words[1:], words[2:]))
        signs = {"lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digits": b"0123456789", "spaces": b" \t\n\x0b\x0c\r", "ends": b".!?", "punctuation": b",;:'\"()-", "beyond_ascii": bytes(range(128, 256))}
        share = {name: sum(raw.count(bytes([c])) for c in chars) / len(raw) for name, chars in signs.items()}
        share["symbols"] = 1 - sum(share.values())
        values = share | {
            "words": math.log(1 + len(words)), "word_length": sum(map(len, words)) / len(words), "distinct_words": len(set(words)) / len(words),
            "top_word": max(Counter(words).values()) / len(words), "repeated_triples": 1 - len(set(triples)) / len(triples) if triples else 0,
            "lines": math.log(1 + len(lines)), "line_length": math.log(1 + len(raw) / len(lines)), "repeated_lines": 1 - len(set(lines)) / len(lines),
            "words_a_sentence": math.log(1 + len(words) / (1 + share["ends"] * len(raw))),
        }
        dense = [values[name] for name in quality.STATISTICS]
    dense.append(math.copysign(math.log(1 + abs(extra)), extra) if extra is not None else math.nan)
    for k, x in enumerate(dense):
        weights[quality.BUCKETS + k] = 0.0 if math.isnan(x) else max(-4.0, min(4.0, (x - model.mean[k]) / model.spread[k])) * 0.4
    return weights


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(2)
    size = quality.BUCKETS + len(quality.STATISTICS) + 1
    model = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)), rng.normal(size=18), rng.uniform(0.5, 2, 18))
    extra = [3.0, None, -5.0, 0.0, 1e9, 7.0, 1.0]
    numbers = np.array([[math.nan if e is None else math.copysign(math.log1p(abs(e)), e)] for e in extra])
    got = model.raw(quality.Features(iter(TEXTS), numbers))
    for raw, e, score in zip(TEXTS, extra, got):
        x = sorted(vector(raw, e, model).items())
        pairs = sum(model.vectors[i] @ model.vectors[j] * a * b for k, (i, a) in enumerate(x) for j, b in x[k + 1 :])
        assert score == pytest.approx(0.3 + sum(model.linear[i] * a for i, a in x) + pairs)


def test_learning_finds_interactions():
    """Good where exactly one of two words is there: no linear score can say so."""
    rng = np.random.default_rng(4)
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        texts.append(b" ".join([b"left"] * a + [b"right"] * b + [b"word"]))
        labels.append(int(a != b))
    model = quality.learn(texts, np.zeros((3000, 0)), np.array(labels), epochs=15)
    p = model.probability(quality.Features(iter([b"word", b"left word", b"right word", b"left right word"]), np.zeros((4, 0))))
    assert p[0] < 0.3 and p[3] < 0.3 and p[1] > 0.7 and p[2] > 0.7


def test_held_out_labels(spark):
    scored = queries.QUERIES["op11_quality"](spark, SF)
    rows = scored.collect()
    truth = {r["doc_id"]: r["quality"] for r in queries.table(spark, SF, "labels").collect()}
    docs = queries.table(spark, SF, "documents")
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(truth[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.85
    assert {r["doc_id"]: r["score"] for r in queries.QUERIES["op11_quality"](spark, SF).collect()} == {r["doc_id"]: r["score"] for r in rows}


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(100)] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, text int")
    model = quality.fit(docs, labels)
    scored = model.score(docs)
    assert scored.count() == docs.count() and scored.where("score IS NULL OR isnan(score)").count() == 0
    assert scored.where("row.text IS NULL OR row.text = ''").select("score").distinct().count() <= 2  # by metadata
    extra = model.score(docs.withColumns({c: F.lit(7) for c in CLASHING}))
    assert sorted(r["score"] for r in extra.collect()) == sorted(r["score"] for r in scored.collect())
    assert model.score(docs.drop("n_chars")).where("score IS NULL").count() == 0
    assert quality.fit(docs, labels.where("quality = 1")).score(docs).where("score = 1").count() == docs.count()
    assert quality.fit(docs, labels.limit(0)).score(docs).where("score = 0").count() == docs.count()
    assert quality.fit(docs.limit(0), labels).score(docs.limit(0)).count() == 0
    assert quality.fit(docs, labels, metadata=()).score(docs).where("score IS NULL").count() == 0
