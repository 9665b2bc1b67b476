"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, _hash long, count long"

#: Names that operators use inside.
CLASHING = (
    "_source _words _rest _cut _third _id _whole _weight _target _vector _sum _s _in _cell _raw _first _spent _kept _features _row "
    "_calibrated _at _null _beside _score _times _time _f0 row nth order group fingerprint component component_id first times score "
    "kept carry spans chunk shard kind data a.b"
).split()


def documents(spark, empty=False):
    rng = random.Random(5)
    words = ["the", "Thing", "ciónes", "übel", "and,", "of.", "don't", "日本", "x1", "\U0001f600", "stupid", "eŕ", "it's"]
    texts = [" ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    passage = "A passage of more than fifty bytes that several of the documents share, word by word. "
    texts += [passage + texts[0], texts[1] + passage, texts[2] + passage + texts[3], passage * 3, texts[4], texts[4], texts[5] + " end"]
    texts += [None, "", " \t\n ", "a", "ab", "   x", "line\n\n  two   three\x1c", "word " * 30_000 + passage]
    texts += ["\U0001f600" * 40, "ä" * 60, "x" * 49, "x" * 50, "x" * 51]
    rows = [(i * 7 % 101, t, "en", ["b", "a", None, "ä", "B"][i % 5], None, 3, "x", None, 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[6], None, "a", 5, None, None, 1, None), (None, "nameless text", None, None, 5, None, None, 1, None)]
    rows += [(-5, texts[7], "fr", "a", 9, 1, "y", 2, 2)]
    return spark.createDataFrame([] if empty else rows, SCHEMA)
