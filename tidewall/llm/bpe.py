"""Byte-level BPE as a lazily determinised transducer, and streaming decode.

Encoding.  In a BPE encoding every prefix of a piece has exactly one last token that can end there: the token whose left
neighbour is the last token of what stands before it, such that no merge crosses the seam between the two.  The
transducer's state is the last token it has emitted together with the bytes that are still open.  Reading a byte finds
the token that ends there; then whatever all continuations share is emitted: a continuation must leave from a position
whose open bytes are a prefix of some token, so the lookahead is at most the longest token.  States and transitions are
made when a text first needs them and kept in a bounded table, so frequent beginnings of words run over ready
transitions.  Whether a merge crosses a seam is read off the merges of the two tokens, undone from the last one.

Decoding.  Ids become bytes; a state machine holds back the bytes of an unfinished UTF-8 sequence between two chunks.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.llm.common import get, kept, task, utf8

#: Bytes that an encoder may keep in a worker, about: states and seams of the transducer, and texts seen before.
MEMORY = 640 << 20
#: Of the bound, one state for so many bytes (it takes some 900 with its transitions and seams; most of the bound is for
#: texts seen before), and what an entry of a memory takes beside its text and ids.
PER_STATE = 2560
PER_ENTRY = 120
SPACE = r"\t-\r \x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, from lines of base64 token and rank."""
    pairs = (line.split() for line in get(path).splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Merges:
    """For each token the two tokens that its last merge joins, and whether two tokens can stand side by side."""

    def __init__(self, ranks: dict[bytes, int], seams: int = 2 * MEMORY // PER_STATE):
        self.ranks = ranks
        self._limit = seams
        self.bytes = {rank: token for token, rank in ranks.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._seams: dict[int, bool] = {}

    def merge(self, piece: bytes, until: int = 1) -> list[bytes]:
        """Plain merging by rank, leftmost first, down to `until` parts."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """What the last merge of a token joins; None for a single byte; a token that merging never makes is no token."""
        if token not in self._halves:
            value = self.bytes[token]
            parts = self.merge(value, 2) if len(value) > 1 else []
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        value = self.bytes[token]
        return len(value) == 1 or (self.halves(token) is not None and self.merge(value) == [value])

    def apart(self, left: int, right: int) -> bool:
        """True if the two tokens' bytes, merged together, give just these two tokens.

        Goes back in time: undoes the later of the two last merges and asks whether the parts that met at the seam then
        would have merged before it.  Of equal ranks the left one comes first.
        """
        seam = left << 32 | right
        known = self._seams.get(seam)
        if known is not None:
            return known
        if len(self._seams) > self._limit:
            self._seams.clear()
        names, ranks, a, b, limit = self.bytes, self.ranks, left, right, None
        while True:
            rank = ranks.get(names[a] + names[b])
            if rank is not None and (limit is None or rank < limit):
                answer = False
                break
            of_a, of_b = self.halves(a), self.halves(b)
            if of_a is None and of_b is None:
                answer = True
                break
            if of_b is None or of_a is not None and a > b:
                limit, a = a, of_a[1]  # a merge left of the seam comes before an equal one at it
            else:
                limit, b = b + 1, of_b[0]
        self._seams[seam] = answer
        return answer


class Transducer:
    """States are made on demand; `run` gives the tokens of one piece.

    A state is (token emitted before it, open bytes, last token at each open position, positions from which a token can
    still reach over the end).  Transitions go from state and byte to state; those that emit are listed beside them.
    """

    def __init__(self, ranks: dict[bytes, int], states: int = MEMORY // PER_STATE):
        self._merges = Merges(ranks, 2 * states)
        self._limit = states
        # For all bytes that begin a token: the token that they are, or -1; and whether a longer one begins so.
        longer = {t[:n] for t in ranks for n in range(1, len(t))}
        self._beginnings = {t: (-1, True) for t in longer} | {t: (r, t in longer) for t, r in ranks.items()}
        self._checked: set[int] = set()
        self._reset()

    def _reset(self) -> None:
        self._states: list[tuple] = [(None, b"", (), ())]
        self._numbers: dict[tuple, int] = {(None, b""): 0}
        self._next: dict[int, int] = {}
        self._emit: dict[int, tuple[int, ...]] = {}

    def _usable(self, token: int) -> bool:
        if token not in self._checked:
            if not self._merges.reachable(token):
                value = self._merges.bytes[token]
                self._beginnings[value] = (-1, self._beginnings[value][1])
                return False
            self._checked.add(token)
        return True

    def _step(self, number: int, byte: int) -> int:
        before, opened, last, live = self._states[number]
        value = opened + bytes((byte,))
        end = len(value)
        found, reach = None, []
        for start in (*live, end - 1):
            entry = self._beginnings.get(value[start:])
            if entry is None:
                continue
            token, longer = entry
            if longer:
                reach.append(start)
            if found is None and token >= 0 and self._usable(token):
                left = last[start - 1] if start else before
                if left is None or self._merges.apart(left, token):
                    found = token
        if found is None:
            raise ValueError("no token ends here: the vocabulary lacks a byte")
        last = (*last, found)
        if not reach or reach[0]:  # else a token may still begin where the open bytes do
            emitted, cut = self._shared(last, reach)
            if cut:
                self._emit[number << 8 | byte] = emitted
                before, value, last = emitted[-1], value[cut:], last[cut:]
                reach = [start - cut for start in reach]
        following = self._numbers.get((before, value))
        if following is None:
            following = self._numbers[before, value] = len(self._states)
            self._states.append((before, value, last, tuple(reach)))
        self._next[number << 8 | byte] = following
        return following

    def _chain(self, last: tuple[int, ...], end: int) -> list[int]:
        names, out = self._merges.bytes, []
        while end:
            out.append(last[end - 1])
            end -= len(names[out[-1]])
        return out[::-1]

    def _shared(self, last: tuple[int, ...], reach: list[int]) -> tuple[tuple[int, ...], int]:
        """The tokens that every continuation begins with, and how many bytes they are."""
        names = self._merges.bytes
        chain = self._chain(last, len(last))
        ends, at = {}, 0
        for k, token in enumerate(chain):
            at += len(names[token])
            ends[at] = k + 1
        shared = len(chain)
        for start in reach:
            # The tokens that lead to `start` agree with the chain up to where the two last meet.
            while start and start not in ends:
                start -= len(names[last[start - 1]])
            shared = min(shared, ends.get(start, 0))
            if not shared:
                return (), 0
        return tuple(chain[:shared]), sum(len(names[t]) for t in chain[:shared])

    def run(self, piece: bytes) -> list[int]:
        """A piece that leaves the ready transitions adds one state; what it has left is read without making any."""
        if len(self._states) > self._limit:
            self._reset()
        state, out, following, emits = 0, [], self._next.get, self._emit
        for k, byte in enumerate(piece):
            at = state << 8 | byte
            state = following(at)
            if state is None:
                state = self._step(at >> 8, byte)
                if at in emits:
                    out.extend(emits[at])
                out.extend(self._rest(state, piece[k + 1 :]))
                return out
            if at in emits:
                out.extend(emits[at])
        out.extend(self._rest(state, b""))
        return out

    def _rest(self, number: int, rest: bytes) -> list[int]:
        """The tokens of a state's open bytes and of those that follow up to the end."""
        before, opened, last, live = self._states[number]
        if not rest:
            return self._chain(last, len(opened)) if opened else []
        value, last, beginnings, apart, usable = opened + rest, list(last), self._beginnings, self._merges.apart, self._checked
        for end in range(len(opened) + 1, len(value) + 1):
            found, reach = None, []
            for start in (*live, end - 1):
                entry = beginnings.get(value[start:end])
                if entry is None:
                    continue
                token, longer = entry
                if longer:
                    reach.append(start)
                if found is None and token >= 0 and (token in usable or self._usable(token)):
                    left = last[start - 1] if start else before
                    if left is None or apart(left, token):
                        found = token
            if found is None:
                raise ValueError("no token ends here: the vocabulary lacks a byte")
            last.append(found)
            live = reach
        return self._chain(last, len(value))


class Encoder:
    """Texts to ids: pieces by a pattern, each through the transducer; stretches seen before come from a bounded memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = MEMORY):
        self._ranks = ranks
        self._transducer = Transducer(ranks, memory // PER_STATE)
        # White space as Unicode defines it; the library of the pattern would count four control characters more.
        spaced = pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self._find = regex.compile(spaced).findall
        spaces = regex.findall(f"[{SPACE}]", "".join(map(chr, range(0x10000))))
        self._spaces = [(sign, f" {sign}", f"{sign} ") for sign in spaces if sign != " "]
        self._stretches = _Memory(lambda stretch: self._encode(" " + stretch), memory // 8)
        self._pieces = _Memory(self._piece, memory // 8)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    @classmethod
    def shared(cls, path: str, pattern: str, memory: int = MEMORY) -> "Encoder":
        """One per process: states and memory outlive a task, until a task of another operator starts."""
        return kept("bpe", ("bpe", path, pattern, memory), lambda: cls(load_ranks(path), pattern, memory))

    def _odd(self, text: str) -> bool:
        """True if a space stands beside other white space.  Most kinds of it are in no text, which is found out fastest."""
        return "  " in text or any(sign in text and (after in text or ahead in text) for sign, after, ahead in self._spaces)

    def _encode(self, stretch: str) -> bytes:
        return b"".join(map(self._pieces.get_or_make, self._find(stretch)))

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        rank = self._ranks.get(raw)
        tokens = self._transducer.run(raw) if rank is None else [rank]
        return struct.pack(f"<{len(tokens)}I", *tokens)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A single space between other signs always begins a piece (letters, digits and signs take one space in front),
        so the text falls into stretches that can be looked up; texts with other white space beside a space are cut whole.
        """
        if not text:
            return b""
        if self._odd(text):
            return self._encode(text)
        stretches = text.split(" ")
        first = stretches[0]
        last = stretches.pop() if text[-1] == " " else None
        out = map(self._stretches.get_or_make, itertools.islice(stretches, 1, None))
        return b"".join([self._encode(first) if first else b"", *out, b"" if last is None else self._encode(" ")])


class _Memory(dict):
    """What a function made of its argument, in two generations of bounded size in bytes, so that frequent arguments stay."""

    def __init__(self, make, bound: int):
        super().__init__()
        self._make, self._bound, self._old, self._size = make, bound, {}, 0
        self.get_or_make = self.__getitem__

    def __missing__(self, key: str) -> bytes:
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if self._size >= self._bound:
            self._old = dict(self)
            self.clear()
            self._size = 0
        self._size += len(key) + len(value) + PER_ENTRY
        self[key] = value
        return value


class Utf8Stream:
    """Incremental UTF-8: give it bytes as they come, it returns the text that is complete so far.

    The state is the unfinished sequence at the end (at most three bytes).  Only the end of a chunk is looked at byte by
    byte; what stands before is decoded at once.  Bytes that are no UTF-8 come out as U+FFFD.
    """

    def __init__(self):
        self._open = b""

    @staticmethod
    def _needs(byte: int) -> int:
        """Length of the sequence that a byte begins; 0 for a continuation byte, 1 where nothing follows."""
        if byte < 0x80 or byte > 0xF4 or byte in (0xC0, 0xC1):
            return 1
        return 0 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4

    def feed(self, chunk: bytes) -> str:
        data = self._open + chunk
        self._open = b""
        for back in range(1, min(3, len(data)) + 1):
            needs = self._needs(data[-back])
            if needs:
                if needs > back and self._possible(data[len(data) - back :]):
                    data, self._open = data[: len(data) - back], data[len(data) - back :]
                break
        return data.decode("utf-8", "replace")

    @staticmethod
    def _possible(opened: bytes) -> bool:
        """False where the second byte already rules the sequence out (overlong, surrogate, beyond U+10FFFF)."""
        if len(opened) < 2:
            return True
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(opened[0], (0x80, 0xBF))
        return low <= opened[1] <= high

    def close(self) -> str:
        rest, self._open = self._open, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], bytes_of: list[bytes], chunk: int = 4096) -> Iterator[str]:
    """Texts of successive chunks of ids; a character cut by two chunks comes with the second."""
    stream, ids, token = Utf8Stream(), iter(ids), bytes_of.__getitem__
    while part := b"".join(map(token, itertools.islice(ids, chunk))):
        yield stream.feed(part)
    yield stream.close()


def encode(docs: DataFrame, ranks: str, pattern: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (`doc_id`, `ids`): the ids of each whole text as little-endian unsigned 32-bit integers.  No shuffle.

    Defined results: a null or empty text has no ids; ids may be null or repeated, each row is encoded by itself.
    """
    @task("bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(ranks, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [encoder.encode(t.decode()) for t in utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def round_trip(
    docs: DataFrame, ranks: str, pattern: str, *, id: str = "doc_id", text: str = "text", keep_ids: bool = False,
    memory: int = MEMORY, keep: bool = True,
) -> DataFrame:
    """Rows (`doc_id`, `n_tokens`, `ids_sha256`, `decoded_sha256`): encodes and decodes each whole text in one pass.

    With `keep_ids` also `ids`, little-endian unsigned 32-bit integers.  `memory` bounds the bytes that a worker keeps of
    texts and states; less of it costs time only.  Without `keep` a worker drops them after each task.
    """
    more = ", ids binary" if keep_ids else ""

    @task("bpe", keep)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(ranks, pattern, memory)
        for batch in batches:
            counts, of_ids, of_text, kept = [], [], [], []
            for raw in utf8(batch.column(1)):
                ids = encoder.encode(raw.decode())
                digest = hashlib.sha256()
                for piece in decode_stream(memoryview(ids).cast("I") if ids else (), encoder.bytes_of):
                    digest.update(piece.encode())
                counts.append(len(ids) // 4)
                if keep_ids:
                    kept.append(ids)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(digest.hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
