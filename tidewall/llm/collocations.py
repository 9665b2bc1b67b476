"""Phrase collocations: phrases of two and three words that stand together more often than their parts would.

Words are counted first.  Those with fewer than `least` occurrences can be in no candidate, so only the others get numbers
(one per language and word), and the texts are written once more as arrays of numbers in which anything else is a break.

Level by level, candidates are phrases that can still reach `least` (Apriori): pairs whose occurrences, summed over the
blocks that saw them, reach it, and triples whose two pairs do and that reach it themselves.  The candidates of a level are
dealt by a hash of their first two words into shards of bounded size, and each shard becomes a double-array trie: a state
moves from `base[state] + symbol`, and only if `check` there names it.  A task loads one shard after the other (each a file
of bounded size in the shared folder); numpy moves the states of all positions of a block at once, a level at a time, and
bincounts the accepting states.  Each position looks into the one shard of its first two words, so the work is one walk over
the positions however many shards there are.  Counts of blocks are summed.  The phrases' counts are these sums.

Scores are exact: products are decimals of 38 digits, divided as integers.  Ranks are taken per language after each task has
kept its own best, so a language with most of the phrases costs no more than others.

Defined results: null and empty texts have no words; a null language is `und`, together with documents that say so; other
upper-case letters than A-Z stay; phrases never cross pieces, documents or languages; repeated rows count as often as they
are there; ids are not read; an empty table gives no rows; ties in rank go by count, then phrase in UTF-8 byte order.
"""

from __future__ import annotations

import io
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm.common import get, partitions, put, shared_folder, stored, task, utf8

LEAST = 10
TOP = 2000
#: Words of a dictionary file, candidates of a trie: both are files that a task holds one at a time.
DICTIONARY = 400_000
SHARD = 200_000
#: Numbers of a row of encoded text (a row ends at a break), positions that are walked at once, and counts a task gathers.
ROW_WORDS = 4096
BLOCK_WORDS = 1 << 20
HELD = 300_000
_BREAK = -1
_IDS = 20  # bits of a number within its dictionary file
_DIGIT = 10  # bits of a digit in a trie
_SPAN = 1 << _DIGIT

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b",;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9)


def tokens(raw: bytes) -> list[bytes]:
    """Lower-case words in order, and `.` between pieces: no word holds one."""
    return raw.translate(_LOWER).replace(b".", b" . ").split()


def _language(name: str | None) -> str:
    return "und" if name is None else name


def count_words(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (`lang`, `word`, `f`): all occurrences, counted in each task before they meet."""

    @task("collocations")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush():
            for name, words in counts.items():
                words.pop(b".", None)
                keys = pa.array(words.keys(), pa.binary()).cast(pa.string())
                names = pa.array([name] * len(words), pa.string())
                yield pa.RecordBatch.from_arrays([names, keys, pa.array(words.values(), pa.int64())], ["lang", "word", "f"])
            counts.clear()

        for batch in batches:
            for raw, name in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                counts.setdefault(_language(name), Counter()).update(tokens(raw))
                if sum(map(len, counts.values())) > HELD:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = rows.mapInArrow(run, "lang string, word string, f long")
    return counted.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _file_of(lang: Column, word: Column, files: int) -> Column:
    return (F.crc32(F.concat(lang, F.lit("\0"), word)) % files).cast("int")


def _dictionary_file(folder: str, k: int) -> str:
    return f"{folder}/words-{k:05d}.arrow"


def number_words(words: DataFrame, folder: str) -> tuple[DataFrame, int, frozenset[int]]:
    """Numbers for the words (`lang`, `word`, `f`), as rows (`id`, `lang`, `word`, `f`) and as dictionary files; how many
    files words are dealt over, and which of them have any."""
    files = max(1, math.ceil(words.count() / DICTIONARY))
    if files >= 1 << 31 - _IDS:
        raise ValueError("more frequent words than numbers of 31 bits")

    @task("collocations")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        numbers = table["file"].to_numpy()
        for k in np.unique(numbers).tolist():
            part = table.filter(pa.array(numbers == k)).combine_chunks()
            if len(part) > 1 << _IDS:
                raise ValueError("too many words in a dictionary file")
            out = io.BytesIO()
            with pa.ipc.new_file(out, part.schema) as writer:
                writer.write_table(part)
            put(_dictionary_file(folder, k), out.getvalue())
            ids = pa.array(np.arange(len(part), dtype=np.int64) + (k << _IDS))
            for batch in pa.Table.from_arrays([ids, part["lang"], part["word"], part["f"]], ["id", "lang", "word", "f"]).to_batches(10_000):
                yield batch

    dealt = words.select(_file_of(F.col("lang"), F.col("word"), files).alias("file"), "lang", "word", "f")
    dealt = dealt.repartition(files, "file").sortWithinPartitions("file", "lang", "word")
    numbered = stored(dealt.mapInArrow(run, "id long, lang string, word string, f long"), "collocations-words")
    there = numbered.select(F.shiftright("id", _IDS).alias("file")).distinct().collect()
    return numbered, files, frozenset(row["file"] for row in there)


def encode(docs: DataFrame, folder: str, files: int, there: frozenset[int], *, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (`ids`): 32-bit numbers of successive words, -1 for a break (end of a piece or text, a word without a number)."""

    @task("collocations")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, bytes], int] = {}
        local: list[int] = []

        def flush():
            numbers = _look_up(list(known), folder, files, there)
            ids = np.append(numbers, np.int32(_BREAK))[np.fromiter(local, np.int64, len(local))]
            known.clear()
            local.clear()
            # Runs of breaks say no more than one, and a row ends at a break.
            ids = ids[(ids != _BREAK) | np.append(True, ids[:-1] != _BREAK)]
            breaks = np.flatnonzero(ids == _BREAK)
            cuts, at = [], 0
            while at < len(ids):
                k = int(np.searchsorted(breaks, at + ROW_WORDS))
                stop = int(breaks[k]) + 1 if k < len(breaks) else len(ids)
                cuts.append(ids[at:stop].tobytes())
                at = stop
            return pa.RecordBatch.from_arrays([pa.array(cuts, pa.binary())], ["ids"])

        for batch in batches:
            for raw, name in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                name = _language(name)
                words = tokens(raw)
                if not words:
                    continue
                of = {w: -1 if w == b"." else known.setdefault((name, w), len(known)) for w in set(words)}
                local.extend(map(of.__getitem__, words))
                local.append(-1)
                if len(local) > BLOCK_WORDS or len(known) > HELD:
                    yield flush()
        if local:
            yield flush()

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(run, "ids binary")


def _look_up(words: list[tuple[str, bytes]], folder: str, files: int, there: frozenset[int]) -> np.ndarray:
    keys = [lang.encode() + b"\0" + word for lang, word in words]
    out = np.full(len(keys), _BREAK, np.int32)
    where = np.fromiter((zlib.crc32(k) % files for k in keys), np.int64, len(keys)) if files > 1 else np.zeros(len(keys), np.int64)
    for k in sorted(there.intersection(np.unique(where).tolist())):
        mine = np.flatnonzero(where == k)
        table = pa.ipc.open_file(pa.BufferReader(get(_dictionary_file(folder, k)))).read_all()
        names = pc.binary_join_element_wise(table["lang"].cast(pa.binary()), table["word"].cast(pa.binary()), b"\0")
        found = pc.index_in(pa.array([keys[i] for i in mine.tolist()], pa.binary()), value_set=names.combine_chunks())
        places = found.fill_null(-1).to_numpy()
        out[mine] = np.where(places < 0, _BREAK, places + (k << _IDS))
    return out


# tries


def double_array(phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`phrases` [n, depth], distinct and sorted: symbols (sorted numbers of words), base, check and accept of their trie.

    A word is two digits of its place among the symbols, so no state has children further apart than `_SPAN` and rows of
    children pack well.  State 0 is the root, states are slots, and `accept` holds a phrase's row at the slot where it ends
    (else -1).  Slots of a state's children are base + digit; states with many children come first, those with one fill holes.
    """
    symbols = np.unique(phrases)
    if len(symbols) > _SPAN * _SPAN:
        raise ValueError("more words than two digits can tell apart")
    code = np.searchsorted(symbols, phrases)
    digits = np.stack([code >> _DIGIT, code & (_SPAN - 1)], axis=2).reshape(len(phrases), -1)
    size = 1 + _SPAN
    base, check, accept = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    firsts = np.unique(digits[:, 0])
    base[0] = 1
    check[1 + firsts] = 0
    used = check >= 0
    used[0] = True
    state = 1 + digits[:, 0]  # of each phrase's beginning

    end = size  # behind the last slot in use

    def grow(upto: int):
        nonlocal base, check, accept, used, end
        end = max(end, upto)
        if upto > len(base):
            more = max(upto, len(base) * 5 // 4) - len(base)
            base, check, accept = (np.append(x, np.full(more, fill, np.int32)) for x, fill in ((base, 0), (check, -1), (accept, -1)))
            used = np.append(used, np.zeros(more, bool))

    for level in range(1, digits.shape[1]):
        starts = np.flatnonzero(np.append(True, (state[1:] != state[:-1]) | (digits[1:, level] != digits[:-1, level])))
        parents, children = state[starts], digits[starts, level]
        heads = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        counts = np.diff(np.append(heads, len(parents)))
        slot = np.empty(len(parents), np.int64)
        low, kind = 0, None
        for h in np.argsort(-counts, kind="stable").tolist():
            n = int(counts[h])
            if n == 1:
                break
            if n.bit_length() != kind:
                low, kind = 0, n.bit_length()  # smaller rows fit where larger ones did not
            kids = children[heads[h] : heads[h] + n]
            place, low = _room(used[:end], kids - kids[0], low)
            grow(place + int(kids[-1] - kids[0]) + 1)
            mine = place + kids - kids[0]
            slot[heads[h] : heads[h] + n] = mine
            used[mine] = True
        single = heads[counts == 1]
        free = np.flatnonzero(~used[:end])[: len(single)]
        if len(free) < len(single):
            more = np.arange(end, end + len(single) - len(free))
            free = np.append(free, more)
            grow(end + len(more))
        slot[single] = free
        used[free] = True
        base[parents[heads]] = slot[heads] - children[heads]
        check[slot] = parents
        state = np.repeat(slot, np.diff(np.append(starts, len(state))))
    accept[state] = np.arange(len(phrases))
    return symbols, base[:end], check[:end], accept[:end]


def _room(used: np.ndarray, offsets: np.ndarray, low: int) -> tuple[int, int]:
    """A free slot from which all offsets are free too, and where to look for the next row of such a size.

    Looks at a few stretches from `low` on; rows that find no room there go to the end.
    """
    for _ in range(8):
        if low >= len(used):
            break
        free = low + np.flatnonzero(~used[low : low + _SPAN])[: max(8, 32_768 // len(offsets))]
        if len(free):
            slots = free[:, None] + offsets[None, :]
            taken = used[np.minimum(slots, len(used) - 1)] & (slots < len(used))
            fits = np.flatnonzero(~taken.any(axis=1))
            if len(fits):
                return int(free[fits[0]]), low
        low += _SPAN
    return len(used), low


def _shard_of(a: np.ndarray, b: np.ndarray, shards: int) -> np.ndarray:
    mixed = (a.astype(np.uint64) << np.uint64(31) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


class Tries:
    """The tries of one level's candidates: files in the shared folder."""

    def __init__(self, folder: str, depth: int, shards: int):
        self.folder, self.depth, self.shards = folder, depth, shards
        self.there: frozenset[int] = frozenset()  # shards with candidates

    def path(self, k: int) -> str:
        return f"{self.folder}/trie{self.depth}-{k:05d}.npz"

    @classmethod
    def build(cls, candidates: DataFrame, depth: int, folder: str) -> "Tries":
        """`candidates`: rows of `depth` numbers, `w0`, `w1`, ...; each shard is made by the task that its rows come to."""
        self = cls(folder, depth, max(1, math.ceil(candidates.count() / SHARD)))

        @task("collocations")
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [np.stack([c.to_numpy() for c in batch.columns], axis=1) for batch in batches if batch.num_rows]
            if parts:
                rows = np.concatenate(parts)
                by = _shard_of(rows[:, 0], rows[:, 1], self.shards)
                for k in np.unique(by).tolist():
                    phrases = rows[by == k]
                    phrases = phrases[np.lexsort(phrases.T[::-1])]
                    out = io.BytesIO()
                    symbols, base, check, accept = double_array(phrases)
                    np.savez(out, phrases=phrases, symbols=symbols, base=base, check=check, accept=accept)
                    put(self.path(k), out.getvalue())
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(by))], ["shard"])

        dealt = candidates.select(*(f"w{k}" for k in range(depth)))
        dealt = dealt.withColumn("shard", _shard_column(self.shards)).repartition(self.shards, "shard").drop("shard")
        self.there = frozenset(row["shard"] for row in dealt.mapInArrow(run, "shard long").collect())
        return self

    def walk(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each shard: its phrases, their counts in `ids` (bincount of accepting states), positions where one begins."""
        padded = np.append(ids.astype(np.int64), [_BREAK] * (self.depth - 1))
        # Position by position, a state must have `depth` words before the next break.
        alive = padded[: len(ids)] >= 0
        for level in range(1, self.depth):
            alive &= padded[level : level + len(ids)] >= 0
        positions = np.flatnonzero(alive)
        if not len(positions):
            return
        distinct, local = np.unique(padded, return_inverse=True)
        shard = _shard_of(padded[positions], padded[positions + 1], self.shards)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for k in range(self.shards):
            at = positions[order[bounds[k] : bounds[k + 1]]]
            if not len(at) or k not in self.there:
                continue
            trie = np.load(io.BytesIO(get(self.path(k))))
            symbols, base, check, accept = (trie[n] for n in ("symbols", "base", "check", "accept"))
            place = np.searchsorted(symbols, distinct)
            place[place == len(symbols)] = 0
            symbol = np.where(symbols[place] == distinct, place, -1)
            state = np.zeros(len(at), np.int64)
            for level in range(self.depth):  # all positions at once, those without a transition drop out
                word = symbol[local[at + level]]
                for shift in (_DIGIT, 0):
                    slot = base[state] + (word >> shift & (_SPAN - 1))
                    inside = (word >= 0) & (slot > 0) & (slot < len(check))
                    inside &= check[np.where(inside, slot, 0)] == state
                    at, state, word = at[inside], slot[inside].astype(np.int64), word[inside]
            found = accept[state]
            yield trie["phrases"], np.bincount(found, minlength=len(trie["phrases"])), at


def _shard_column(shards: int) -> Column:
    """`_shard_of` of the columns `w0`, `w1`, in the JVM: products of 64 bits wrap there as they do in numpy."""
    key = F.shiftleft(F.col("w0"), 31).bitwiseOR(F.col("w1"))

    @F.arrow_udf("int")
    def run(column: pa.Array) -> pa.Array:
        mixed = column.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return pa.array(((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int32))

    return run(key)


# candidates and counts


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Numbers of several rows, with a break at each end."""
    held, size = [], 0
    for batch in batches:
        for value in batch.column(0):
            ids = np.frombuffer(value.as_buffer(), np.int32)
            held += [ids, [_BREAK]]
            size += len(ids)
            if size > BLOCK_WORDS:
                yield np.concatenate(held).astype(np.int64)
                held, size = [], 0
    if held:
        yield np.concatenate(held).astype(np.int64)


def _emit(columns: list[np.ndarray], counts: np.ndarray, tag: int | None = None) -> Iterator[pa.RecordBatch]:
    names = [*(f"w{k}" for k in range(len(columns))), "n"]
    for start in range(0, len(counts), 100_000):
        part = [pa.array(c[start : start + 100_000]) for c in (*columns, counts)]
        if tag is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), tag, np.int32)), *part], ["level", *names])
        else:
            yield pa.RecordBatch.from_arrays(part, names)


def pairs(encoded: DataFrame, least: int) -> DataFrame:
    """Rows (`w0`, `w1`): pairs of frequent words that stand together often enough to be candidates."""

    @task("collocations")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _blocks(batches):
            both = (ids[:-1] >= 0) & (ids[1:] >= 0)
            keys, counts = np.unique(ids[:-1][both] << 31 | ids[1:][both], return_counts=True)
            for start in range(0, len(keys), 100_000):
                part = [pa.array(x[start : start + 100_000]) for x in (keys, counts)]
                yield pa.RecordBatch.from_arrays(part, ["key", "n"])

    seen = encoded.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return seen.select(F.shiftright("key", 31).alias("w0"), F.col("key").bitwiseAND((1 << 31) - 1).alias("w1"))


def count_pairs(encoded: DataFrame, tries: Tries) -> DataFrame:
    """Rows (`level`, `w0`, `w1`, `w2`, `n`) by block: counts of pairs (2), and of triples whose pairs are both candidates (3)."""

    @task("collocations")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _blocks(batches):
            begins = np.zeros(len(ids) + 1, bool)
            for phrases, counts, at in tries.walk(ids):
                begins[at] = True
                some = np.flatnonzero(counts)
                nothing = np.full(len(some), _BREAK, np.int64)
                yield from _emit([phrases[some, 0], phrases[some, 1], nothing], counts[some], 2)
            at = np.flatnonzero(begins[:-1] & begins[1:])
            if len(at):
                heads, local = np.unique(ids[at] << 31 | ids[at + 1], return_inverse=True)
                keys, counts = np.unique(local.astype(np.int64) << 31 | ids[at + 2], return_counts=True)
                head = heads[keys >> 31]
                yield from _emit([head >> 31, head & ((1 << 31) - 1), keys & ((1 << 31) - 1)], counts, 3)

    return encoded.mapInArrow(run, "level int, w0 long, w1 long, w2 long, n long")


def count_triples(encoded: DataFrame, tries: Tries) -> DataFrame:
    @task("collocations")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _blocks(batches):
            for phrases, counts, _ in tries.walk(ids):
                some = np.flatnonzero(counts)
                yield from _emit([phrases[some, k] for k in range(3)], counts[some])

    return encoded.mapInArrow(run, "w0 long, w1 long, w2 long, n long")


def phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """Rows (`lang`, `words`, `a`, `l`, `r`, `n`, `score`, `kept`): every phrase with at least `least` occurrences.

    `words` are two or three; `l`, `r`, `score` are those of the lowest-scoring cut (of equal ones the first); `n` counts all
    words of the language; `kept` is false where a longer phrase has half of the occurrences or more.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "collocations")
    counted = stored(count_words(docs, text=text, lang=lang), "collocations-counts")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words, files, there = number_words(counted.where(F.col("f") >= least), folder)
    encoded = stored(encode(docs, folder, files, there, text=text, lang=lang), "collocations-ids")
    second = Tries.build(stored(pairs(encoded, least), "collocations-pairs"), 2, folder)
    sums = count_pairs(encoded, second).groupBy("level", "w0", "w1", "w2").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    sums = stored(sums, "collocations-sums")
    two = sums.where("level = 2").select("w0", "w1", F.col("n").alias("a"))
    third = Tries.build(sums.where("level = 3").select("w0", "w1", "w2"), 3, folder)
    three = count_triples(encoded, third).groupBy("w0", "w1", "w2").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    three = stored(three, "collocations-triples")

    def word(k: int) -> DataFrame:
        return words.select(F.col("id").alias(f"w{k}"), F.col("lang").alias(f"lang{k}"), F.col("word").alias(f"s{k}"), F.col("f").alias(f"f{k}"))

    def score(left: str, right: str) -> Column:
        wide = [F.col(c).cast("decimal(19,0)") for c in ("a", left, right)]
        product = wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)")
        return F.call_function("div", product, wide[1] * wide[2]).cast("long")

    # Inside a longer phrase: the most occurrences of one around each pair.
    inside = three.select(F.explode(F.array(F.struct("w0", "w1"), F.struct(F.col("w1").alias("w0"), F.col("w2").alias("w1")))).alias("p"), "a")
    inside = inside.groupBy("p").agg(F.max("a").alias("longer")).select("p.*", "longer")
    of_two = two.join(inside, ["w0", "w1"], "left").join(word(0), "w0").join(word(1), "w1").select(
        F.col("lang0").alias("lang"), F.array("s0", "s1").alias("words"), "a", F.col("f0").alias("l"), F.col("f1").alias("r"),
        (F.coalesce("longer", F.lit(0)) * 100 < F.col("a") * 50).alias("kept"),
    ).withColumn("score", score("l", "r"))
    heads = two.select("w0", "w1", F.col("a").alias("head"))
    tails = two.select(F.col("w0").alias("w1"), F.col("w1").alias("w2"), F.col("a").alias("tail"))
    of_three = three.join(heads, ["w0", "w1"]).join(tails, ["w1", "w2"]).join(word(0), "w0").join(word(1), "w1").join(word(2), "w2")
    of_three = of_three.withColumn("cut1", score("f0", "tail")).withColumn("cut2", score("head", "f2"))
    early = F.col("cut1") <= F.col("cut2")
    of_three = of_three.select(
        F.col("lang0").alias("lang"), F.array("s0", "s1", "s2").alias("words"), "a", F.when(early, F.col("f0")).otherwise(F.col("head")).alias("l"),
        F.when(early, F.col("tail")).otherwise(F.col("f2")).alias("r"), F.lit(True).alias("kept"), F.least("cut1", "cut2").alias("score"),
    )
    return of_two.unionByName(of_three).join(totals, "lang").select("lang", "words", "a", "l", "r", "n", "score", "kept")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """Rows (`lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`): each language's `top` kept phrases by score, count, phrase."""
    kept = phrases(docs, text=text, lang=lang, least=least).where("kept").withColumn("phrase", F.array_join("words", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
