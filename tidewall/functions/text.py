"""Text features that feed the scores: character sums, symbol counts, squashed text, trigger words, hashes, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewall import fixed

# White space as scores and blank checks understand it: wider than Java's \s.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
SYMBOL = r"[^\p{L}\p{N}\s\x1c-\x1f\x85\p{Z}]"

STATS_TYPE = "struct<sum_raw:bigint,sum_low:bigint,symbols:bigint,chars:bigint,solid:bigint>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(text: Column | str) -> Column:
    """True for NULL, empty and white-space-only text."""
    return ~F.coalesce(F.rlike(_col(text), F.lit(r"[^\s\x1c-\x1f\x85\p{Z}]")), F.lit(False))


def without_space(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), SPACE, "")


def squash(text: Column | str) -> Column:
    """Lower-cased text with all white space removed."""
    return F.regexp_replace(F.lower(_col(text)), SPACE, "")


def char_sum(text: Column | str) -> Column:
    """Sum of the code points of all non-space characters.

    Costs a few hundred nanoseconds per character: right for short texts such as file captions.  For corpora use
    :func:`text_stats`.
    """
    return F.aggregate(
        F.split(without_space(text), ""), F.lit(0).cast("long"), lambda acc, ch: acc + F.ascii(ch)
    )


def complexity(text: Column | str) -> Column:
    """Number of characters that are neither alphanumeric nor white space."""
    t = _col(text)
    return (F.length(t) - F.length(F.regexp_replace(t, SYMBOL, ""))).cast("long")


def short_text_stats(text: Column | str) -> Column:
    """The struct of :func:`text_stats` from built-in expressions only; for short texts."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.struct(
        char_sum(t).alias("sum_raw"),
        char_sum(F.lower(t)).alias("sum_low"),
        complexity(t).alias("symbols"),
        F.length(t).cast("long").alias("chars"),
        F.length(squash(t)).cast("long").alias("solid"),
    )


def _profile_udf(
    folded: tuple[str, ...], lowered: tuple[str, ...], raw: tuple[str, ...], whole_words: tuple[str, ...]
):
    """Arrow function: character statistics and literal presence in one pass over a batch of texts.

    Built inside a function so that it ships by value: executors need numpy and pyarrow, not this package.  Literals
    are found by an Aho-Corasick automaton where that library is installed, else one by one; the result is the same.
    """
    bits = SEEN_BITS
    words = -(-(len(folded) + len(lowered) + len(raw) + len(whole_words)) // bits) or 1
    result_type = STATS_TYPE[:-1] + ",digits:bigint,seen:array<bigint>>"
    made: dict = {}  # tables live as long as the task

    def prepare():
        import re

        import numpy as np

        known = 0x3000  # code points below are looked up in a table, the rest one by one
        chars = [chr(i) for i in range(known)]

        def facts(c):
            space, low = c.isspace(), c.lower()
            return [
                0 if space else ord(c),
                0 if space else sum(map(ord, low)),
                not space and not c.isalnum(),
                0 if space else len(low),
                c.isdecimal(),
            ]

        made["facts"], made["table"] = facts, np.array([facts(c) for c in chars], np.int64)
        masks = [1 << n for n in range(len(folded) + len(lowered) + len(raw))]
        made["raw"] = list(zip(raw, masks[len(folded) + len(lowered):]))
        plain = list(zip(folded, masks)) + list(zip(lowered, masks[len(folded):]))
        made["loop"], made["find"] = plain, None
        made["words"] = [
            (w, re.compile(rf"\b{re.escape(w)}\b").search, 1 << (len(masks) + n)) for n, w in enumerate(whole_words)
        ]
        try:
            import ahocorasick
        except ImportError:
            return
        if plain:
            automaton, joint = ahocorasick.Automaton(), {}
            for literal, mask in plain:
                joint[literal] = joint.get(literal, 0) | mask
            for literal, mask in joint.items():
                automaton.add_word(literal, mask)
            automaton.make_automaton()
            made["find"] = automaton.iter

    @F.arrow_udf(result_type)
    def profile(texts):
        import numpy as np
        import pyarrow as pa

        if not made:
            prepare()
        table, facts, find, loop = made["table"], made["facts"], made["find"], made["loop"]
        low_bits = (1 << len(folded)) - 1

        def statistics(text):
            if text.isascii():
                points = np.frombuffer(text.encode("ascii"), np.uint8)
            else:
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                far = points >= len(table)
                if far.any():
                    seen, times = np.unique(points[far], return_counts=True)
                    rest = sum(np.array(facts(chr(int(p))), np.int64) * n for p, n in zip(seen, times))
                    counts = np.bincount(points[~far], minlength=1)
                    return counts @ table[: len(counts)] + rest
            counts = np.bincount(points, minlength=1)
            return counts @ table[: len(counts)]

        def present(text):
            found = 0
            if find is not None:
                for _, mask in find(text):
                    found |= mask
            else:
                for literal, mask in loop:
                    if literal in text:
                        found |= mask
            return found

        rows, seen = [], []
        for text in texts.to_pylist():
            text = text or ""
            low = text.lower()
            row = statistics(text)
            if "\u03a3" in text:  # lower case of this letter depends on its place in the word
                row[1] = sum(ord(c) for c in low if not c.isspace())
            rows.append((row[0], row[1], row[2], len(text), row[3], row[4]))
            found = 0
            if loop:
                found = present(low)
                if not low.isascii():
                    fold = low.replace("\u017f", "s").replace("\u0131", "i").replace("i\u0307", "i")
                    if fold != low:
                        found = (found & ~low_bits) | (present(fold) & low_bits)
            for word, search, mask in made["words"]:
                if word in low and search(low):
                    found |= mask
            for literal, mask in made["raw"]:
                if literal in text:
                    found |= mask
            seen.append([(found >> (bits * w)) & ((1 << bits) - 1) for w in range(words)])
        columns = np.array(rows, np.int64).reshape(len(rows), 6)
        return pa.StructArray.from_arrays(
            [pa.array(columns[:, n]) for n in range(6)] + [pa.array(seen, pa.list_(pa.int64()))],
            ["sum_raw", "sum_low", "symbols", "chars", "solid", "digits", "seen"],
        )

    return profile


SEEN_BITS = 62


def text_profile(
    text: Column | str,
    folded: tuple[str, ...] = (),
    lowered: tuple[str, ...] = (),
    raw: tuple[str, ...] = (),
    whole_words: tuple[str, ...] = (),
) -> Column:
    """Character statistics of a text, and which of the given literals occur in it.

    Statistics: raw and lower-cased code point sums, symbols, length, squashed length, decimal digits.  Literals are
    looked up in the case-folded, the lower-cased and the original text; `seen` holds one bit per literal, in that
    order; ``whole_words`` follow, and count only where they stand as a word of their own in the lower-cased text.

    One Arrow batch function.  Measured on the documents table, per character and core: about 350 ns for each
    :func:`char_sum` and 10 ns for each built-in substring test, against about 50 ns here for everything.
    """
    return _profile_udf(tuple(folded), tuple(lowered), tuple(raw), tuple(whole_words))(_col(text))


def text_stats(text: Column | str) -> Column:
    """Character statistics only."""
    return text_profile(text)


def matched_tokens(text: Column | str) -> Column:
    """First six distinct trigger words in text order, then the ``1=1`` and ``--`` markers."""
    t = _col(text)
    # Only words of the vocabulary are extracted, so the array stays as small as the number of hits.
    words = sorted({w for w in fixed.TRIGGER_WORDS if w != "1=1"}, key=lambda w: (-len(w), w))
    found = F.regexp_extract_all(F.lower(t), F.lit(r"(?Ud)\b(" + "|".join(words) + r")\b"), F.lit(1))
    marks = F.array_compact(
        F.array(
            F.when(F.contains(F.replace(t, F.lit(" "), F.lit("")), F.lit("1=1")), F.lit("1=1")),
            F.when(F.contains(t, F.lit("--")), F.lit("--")),
        )
    )
    return F.slice(F.array_distinct(F.concat(found, marks)), 1, 6)


def prompt_hash(text: Column | str) -> Column:
    return F.sha2(_col(text).cast("binary"), 256)


def short_hash(text: Column | str) -> Column:
    return F.left(prompt_hash(text), F.lit(16))


def preview(text: Column | str) -> Column:
    t = _col(text)
    return F.when(F.length(t) > 95, F.concat(F.left(t, F.lit(95)), F.lit("..."))).otherwise(t)
