"""Conversation structure repair: the cheapest edits that give roles in turn, and of those the least audit.

A repaired conversation reads `(s?(ua)+)?` in the initials of its roles.  Edits, in the order of rows: Keep (0), Rerole to
user or assistant (3), Delete (4; the only one for blank rows and duplicates), and Insert of an empty user or assistant row
(3, anywhere); a truncated row that stays costs 3 more.  The audit is the string of the edits' initials.

Method.  The place in the grammar is one of four (start, after s, after u, after a), so a node is a row and a place.  A cost
DP runs backward over all rows of a block of conversations at once.  Arcs that lie on a cheapest way stay; each node takes
its arc of the least initial (the initial fixes the successor, as the grammar leaves one role at each place).  Then nodes
are ranked by audits of length 1, 2, 4, ...: the rank of twice the length is that of the pair (own rank, rank of the node
that the pointer reaches), and pointers are doubled.  Reading doubled pointers from the start gives the least path; starts
of equal rank share their audit.

Scale.  Rows are dealt by ranges of (conversation, turn, role, beginning of the text), so no conversation is gathered: equal
rows are counted first, and whether a row repeats an earlier one comes from minima, combined before the shuffle, that travel
as markers to the row's place in the order.  A conversation inside one task and of moderate size is done there.  Of every
other each task makes pieces of bounded size; a piece's costs are a four by four matrix (smallest sums instead of products),
the matrices are chained backward in a stream, pieces find for each place where their least path comes out, places are
chained forward, and then each piece is repaired where it lies.

Defined results: a null role or text is one space, a null id or turn is one space where the damage's checksum is taken; a
null id is a conversation; null turns come first; rows of one turn are in order of role, then text (by code point), equal
rows side by side; a role without an initial of the grammar (the empty one too) can be reroled or deleted only; a
conversation without rows has an empty audit and no text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.llm.common import partitions, stored, task

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
#: A piece of a long conversation, and what a task holds of finished conversations before it repairs them.
PIECE_ROWS = 1024
PIECE_BYTES = 1 << 20
BLOCK_ROWS = 8192
BLOCK_BYTES = 4 << 20

_START, _S, _U, _A = range(4)
_NEXT = np.array([_U, _U, _A, _U])
_ENDS = np.array([0, 6, 3, 0])  # from each place to an accepted end, by insertions
_NEVER = 1 << 40
_FINE, _TRUNCATED, _GOES = range(3)
_CLASS = {"s": 0, "u": 1, "a": 2}
_PAD = 12
_LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
_D, _I, _K, _R = 1, 2, 3, 4
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_SPACE = " \t\n\x0b\x0c\r"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By symbol (3 * class of the role + fault) and place: cost of Keep, where Keep leads, cost of Rerole."""
    keep = np.full((13, 4), _NEVER)
    to = np.zeros((13, 4), np.int64)
    again = np.full((13, 4), _NEVER)
    follows = {(_START, 0): _S, (_START, 1): _U, (_S, 1): _U, (_A, 1): _U, (_U, 2): _A}
    for role in range(4):
        for fault in (_FINE, _TRUNCATED):
            again[3 * role + fault] = REROLE + UNFINISHED * fault
            for place in range(4):
                if (place, role) in follows:
                    keep[3 * role + fault, place] = KEEP + UNFINISHED * fault
                    to[3 * role + fault, place] = follows[place, role]
    return keep, to, again


_KEEP_COST, _KEEP_TO, _AGAIN = _tables()


def costs_to_go(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """`symbols` [rows, lanes], `_PAD` behind a lane's end; `ends` [lanes, 4] what remains there.  Costs [rows + 1, lanes, 4]."""
    out = np.empty((len(symbols) + 1, *ends.shape), np.int64)
    out[-1] = ends
    for k in range(len(symbols) - 1, -1, -1):
        after, symbol = out[k + 1], symbols[k]
        base = np.minimum(after + DELETE, _KEEP_COST[symbol] + np.take_along_axis(after, _KEEP_TO[symbol], 1))
        np.minimum(base, _AGAIN[symbol] + after[:, _NEXT], out=base)
        # One or two insertions first; a third would come back to the same place.
        best = np.minimum(base, np.minimum(base[:, _NEXT] + INSERT, base[:, _NEXT[_NEXT]] + 2 * INSERT))
        out[k] = np.where((symbol == _PAD)[:, None], after, best)
    return out


def lanes_of(rows: list[bytes]) -> np.ndarray:
    """Symbols of several sequences as columns of one array."""
    out = np.full((max(map(len, rows), default=0), len(rows)), _PAD, np.int64)
    for lane, row in enumerate(rows):
        out[: len(row), lane] = np.frombuffer(row, np.uint8)
    return out


class Paths:
    """Least cheapest paths of several lanes, from every place at their start."""

    def __init__(self, rows: list[bytes], ends: np.ndarray, final: np.ndarray):
        symbols = lanes_of(rows)
        self.lanes, self._length = len(rows), len(symbols)
        costs = costs_to_go(symbols, ends)
        self.start_costs = costs[0]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        k, lane, place = np.ix_(np.arange(self._length + 1), np.arange(self.lanes), np.arange(4))
        own = self._node(k, lane, place)
        padded = np.vstack([symbols, np.full((1, self.lanes), _PAD)])
        after = np.concatenate([costs[1:], costs[-1:]])
        keep_to = _KEEP_TO[padded]
        inside, end = k < sizes[:, None], k == sizes[:, None]
        label, following = np.zeros(own.shape, np.int64), own.copy()
        # From the greatest initial to the least: the last to fit stays.
        for letter, fits, successor in (
            (_R, inside & (costs == _AGAIN[padded] + after[:, :, _NEXT]), self._node(k + 1, lane, _NEXT[place])),
            (_K, inside & (costs == _KEEP_COST[padded] + np.take_along_axis(after, keep_to, 2)), self._node(k + 1, lane, keep_to)),
            (_I, (inside | (end & final[:, None])) & (costs == INSERT + costs[:, :, _NEXT]), self._node(k, lane, _NEXT[place])),
            (_D, inside & (costs == DELETE + after), self._node(k + 1, lane, place)),
        ):
            np.copyto(label, letter, where=fits)
            np.copyto(following, np.broadcast_to(successor, own.shape), where=fits)
        self._label, pointer = label.ravel(), following.ravel()
        self.rank = self._label
        self._pointers = [pointer]
        while self._label[pointer].any():
            pairs = self.rank * (int(self.rank.max()) + 1) + self.rank[pointer]
            self.rank = np.unique(pairs, return_inverse=True)[1]
            pointer = pointer[pointer]
            self._pointers.append(pointer)

    def _node(self, k, lane, place):
        return (k * self.lanes + lane) * 4 + place

    def exits(self) -> np.ndarray:
        """For each lane and place at its start, the place in which the least path leaves it."""
        starts = self._node(0, np.arange(self.lanes)[:, None], np.arange(4)[None, :])
        return self._pointers[-1][starts] % 4

    def read(self, lane: np.ndarray, place: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Audits of the lanes from the places given; and rows and places of their nodes, edit by edit."""
        nodes = self._node(0, lane, place)[:, None]
        for pointer in reversed(self._pointers):
            nodes = np.stack([nodes, pointer[nodes]], axis=2).reshape(len(nodes), -1)
        audits: dict[int, bytes] = {}
        starts = nodes[:, 0]
        for rank, row in zip(*np.unique(self.rank[starts], return_index=True)):
            audits[rank] = _LETTERS[self._label[nodes[row]]].tobytes().rstrip(b"\0")
        out = [audits[r] for r in self.rank[starts].tolist()]
        return out, nodes // 4 // self.lanes, nodes % 4


def repaired_lines(audit: bytes, rows: np.ndarray, places: np.ndarray, texts: list[tuple[str, str] | None]) -> list[str]:
    lines = []
    for step, (edit, row) in enumerate(zip(audit, rows.tolist())):
        if edit == 68:  # D
            continue
        if edit == 75:  # K
            role, text = texts[row]
        else:
            role, text = "user" if _NEXT[places[step]] == _U else "assistant", "" if edit == 73 else texts[row][1]
        lines.append(f"{role}:{text}")
    return lines


class _Held:
    """The rows of one conversation, or of a piece of it, as they come."""

    __slots__ = ("symbols", "texts", "size", "blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "low", "high")

    def __init__(self):
        self.symbols, self.texts, self.size = bytearray(), [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, role: str, text: str, times: int, again: bool) -> None:
        kind = _CLASS.get(role[:1], 3)
        if self.last is None:
            self.first = kind
        else:
            self.illegal += (self.last, kind) not in _LEGAL
        self.last = kind
        self.illegal += times - 1
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        stripped = text.rstrip(_SPACE)
        gone = times
        if not stripped:
            self.blank += times
        else:
            if not again:
                gone -= 1
                unfinished = stripped[-1] not in ".!?"
                self.truncated += unfinished
                self.symbols.append(3 * kind + unfinished)
                self.texts.append((role, text))
                self.size += len(role) + len(text)
            self.duplicate += gone
        if gone:
            self.symbols += bytes((3 * kind + _GOES,)) * gone
            self.texts += [None] * gone

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_PARTS = f"part int, piece long, whole boolean, {_TOTALS}, audit string, repaired string, symbols binary, texts array<struct<role:string,text:string>>, "
_EDGES = "first int, last int, low long, high long, turns long"
_NAMES = [c.strip().split()[0] for c in (_PARTS.split("texts ")[0] + "texts x, " + _EDGES).split(", ") if c.strip()]
_TEXTS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_TYPES = {"part": pa.int32(), "whole": pa.bool_(), "audit": pa.string(), "repaired": pa.string(), "symbols": pa.binary(), "texts": _TEXTS, "first": pa.int32(), "last": pa.int32()}


def _by_length(items: list, length: Callable) -> Iterator[list]:
    """Groups of alike length, so that little is padded."""
    groups: dict[int, list] = {}
    for item in items:
        groups.setdefault(length(item).bit_length(), []).append(item)
    yield from groups.values()


def _finished(held: list[tuple[object, _Held]]) -> list[dict]:
    """Results of whole conversations."""
    out = []
    for group in _by_length(held, lambda item: len(item[1].symbols)):
        n = len(group)
        paths = Paths([bytes(h.symbols) for _, h in group], np.tile(_ENDS, (n, 1)), np.ones(n, bool))
        audits, rows, places = paths.read(np.arange(n), np.zeros(n, np.int64))
        for k, (conv, h) in enumerate(group):
            lines = repaired_lines(audits[k], rows[k], places[k], h.texts)
            out.append({
                "conv_id": conv, "whole": True, "gaps": h.gaps, "blank": h.blank, "duplicate": h.duplicate, "truncated": h.truncated,
                "illegal": h.illegal, "cost": int(paths.start_costs[k, _START]), "audit": audits[k].decode(), "repaired": "\n".join(lines),
            })
    return out


def _survey(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows in order; whole conversations come out repaired, others (the first and last of a task, long ones) as pieces."""
    part, piece = TaskContext.get().partitionId(), 0
    conv, opened, held, known, group = object(), True, _Held(), set(), None
    done, rows, size, started = [], 0, 0, False

    def flush_piece():
        nonlocal piece, held
        h, held = held, _Held()
        piece += 1
        texts = [None if t is None else {"role": t[0], "text": t[1]} for t in h.texts]
        return _records([{
            "conv_id": conv, "part": part, "piece": piece, "whole": False, "blank": h.blank, "duplicate": h.duplicate,
            "truncated": h.truncated, "illegal": h.illegal, "symbols": bytes(h.symbols), "texts": texts,
            "first": h.first, "last": h.last, "low": h.low, "high": h.high, "turns": h.turns,
        }], kind)

    for batch in batches:
        for row_conv, turn, role, prefix, mark, digest, text, times in zip(*(c.to_pylist() for c in batch.columns)):
            if not started or row_conv != conv:
                if started:
                    if opened:
                        yield flush_piece()
                    else:
                        done.append((conv, held))
                        rows, size = rows + len(held.symbols) + 1, size + held.size
                    if rows > BLOCK_ROWS or size > BLOCK_BYTES:
                        yield _records(_finished(done), kind)
                        done, rows, size = [], 0, 0
                conv, opened, held, started, group = row_conv, not started, _Held(), True, None
            if mark == 0:
                continue  # names a conversation
            if group != (turn, role, prefix):
                group, known = (turn, role, prefix), set()
            if mark == 1:
                known.add(digest)
                continue
            first = hashlib.sha256(text.encode()).digest() in known
            while times:
                some = min(times, PIECE_ROWS)
                held.add(turn, role, text, some, not first)
                first = False
                times -= some
                if len(held.symbols) >= PIECE_ROWS or held.size >= PIECE_BYTES:
                    opened = True
                    yield flush_piece()
    if started:
        yield flush_piece()
    yield _records(_finished(done), kind)


def _records(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array([r["conv_id"] for r in rows], kind)]
    columns += [pa.array([r.get(name) for r in rows], _TYPES.get(name, pa.int64())) for name in _NAMES]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", *_NAMES])


def damaged(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (`conv_id`, `turn`, `role`, `text`, `times`) after the damage; `times` is 0 for a row that is dropped."""

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn))) % 20
    words = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(filled(text), "[.!?]", "")).otherwise(filled(text))
    return rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(filled(role)).alias("role"), words.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def _in_order(rows: DataFrame) -> DataFrame:
    """Counted rows, markers of first ones and a marker of each conversation, in order over all tasks."""
    live = F.col("times") > 0
    named = rows.select(
        "conv_id", *(F.when(live, F.col(c)).alias(c) for c in ("turn", "role", "text")), "times"
    )  # of dropped rows only the conversation is left
    counted = stored(named.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times")), "conversations-rows")
    prefix = F.substring("text", 1, 16)
    digest = F.unhex(F.sha2("text", 256))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = (
        counted.where(live).select("conv_id", "role", prefix.alias("prefix"), digest.alias("digest"), turn.alias("at"))
        .groupBy("conv_id", "role", "prefix", "digest").agg(F.min("at").alias("at"))
    )
    nothing = F.lit(None)
    everything = counted.select(
        "conv_id", "turn", "role", prefix.alias("prefix"), F.when(live, 2).otherwise(0).alias("mark"),
        nothing.cast("binary").alias("digest"), "text", "times",
    ).unionByName(firsts.select(
        "conv_id", F.col("at.turn").alias("turn"), "role", "prefix", F.lit(1).alias("mark"), "digest",
        nothing.cast("string").alias("text"), F.lit(0).cast("long").alias("times"),
    ))
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "prefix")]
    return everything.repartitionByRange(partitions(rows), *keys).sortWithinPartitions(*keys, "mark", F.col("text").asc_nulls_first())


def repair(rows: DataFrame) -> DataFrame:
    """Repairs rows (`conv_id`, `turn`, `role`, `text`, `times`): each counts `times`, 0 only names its conversation.

    Rows (`conv_id`, `part`, `piece`, `whole`, `gaps`, `blank`, `duplicate`, `truncated`, `illegal`, `cost`, `audit`,
    `repaired`).  Most conversations are whole in one row.  A long one, or one that lies over two tasks, has several, in order
    of `part` and `piece`; its totals stand in the last of them (null before), and its text is the texts, without the empty
    ones, joined by newlines.
    """
    arrow = pa.int64() if dict(rows.dtypes)["conv_id"] in ("bigint", "int", "smallint", "tinyint") else pa.string()
    rows = rows.withColumn("conv_id", F.col("conv_id").cast("long" if arrow == pa.int64() else "string"))
    id_type = "long" if arrow == pa.int64() else "string"

    @task("conversations")
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _survey(batches, arrow)

    found = stored(_in_order(rows).mapInArrow(survey, f"conv_id {id_type}, {_PARTS}{_EDGES}"), "conversations-found")
    results = ["conv_id", "part", "piece", "whole", *(c.split()[0] for c in _TOTALS.split(", ")), "audit", "repaired"]
    pieces = found.where(~F.col("whole"))
    spread = partitions(rows)

    def chained(df: DataFrame, *order: Column) -> DataFrame:
        return df.repartition(spread, "conv_id").sortWithinPartitions("conv_id", *order)

    # Backward: what remains after each piece.
    matrices = pieces.select("conv_id", "part", "piece", "symbols").mapInArrow(
        _matrices, f"conv_id {id_type}, part int, piece long, matrix array<long>"
    )
    remaining = chained(matrices, F.desc("part"), F.desc("piece")).mapInArrow(
        _backward, "part int, piece long, final boolean, ends array<long>, cost long"
    )
    remaining = stored(remaining, "conversations-remaining")
    # Forward: the place in which each piece begins, and the totals.
    edges = pieces.drop("whole", "gaps", "cost", "audit", "repaired", "texts").join(remaining, ["part", "piece"])
    exits = edges.repartition(spread, "part", "piece").mapInArrow(
        _exits, edges.drop("symbols", "ends").withColumn("exits", F.lit(None).cast("array<long>")).schema
    )
    entries = chained(exits, F.col("part"), F.col("piece")).mapInArrow(
        _forward, f"part int, piece long, final boolean, entry int, {_TOTALS}"
    )
    entries = stored(entries, "conversations-entries")
    # Each piece where it lies.
    long_ones = pieces.select("conv_id", "part", "piece", "symbols", "texts").join(
        entries.join(remaining.drop("final", "cost"), ["part", "piece"]), ["part", "piece"]
    )
    columns = ["conv_id", "part", "piece", "final", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "symbols", "texts", "entry", "ends"]
    long_ones = long_ones.select(*columns).mapInArrow(_repair_pieces, found.select(*results).schema)
    return found.where("whole").select(*results).union(long_ones)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit = np.where(np.eye(4, dtype=bool), 0, _NEVER)
    for batch in batches:
        symbols = batch.column(3).to_pylist()
        out: list = [None] * len(symbols)
        for group in _by_length(list(enumerate(symbols)), lambda item: len(item[1])):
            lanes = [s for _, s in group for _ in range(4)]
            costs = costs_to_go(lanes_of(lanes), np.tile(unit, (len(group), 1)))[0]
            for (k, _), matrix in zip(group, costs.reshape(len(group), 4, 4)):
                out[k] = np.minimum(matrix.T, _NEVER).ravel().tolist()  # from a place, to a place
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], ["conv_id", "part", "piece", "matrix"])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, ends = object(), _ENDS
    for batch in batches:
        rows = []
        for this, part, piece, matrix in zip(*(c.to_pylist() for c in batch.columns)):
            final = this != conv
            if final:
                conv, ends = this, _ENDS
            before = (np.array(matrix).reshape(4, 4) + ends).min(axis=1)
            rows.append((part, piece, final, ends.tolist(), int(before[_START])))
            ends = before
        types = [pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int64()]
        names = ["part", "piece", "final", "ends", "cost"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = list(enumerate(zip(*(batch[c].to_pylist() for c in ("symbols", "ends", "final")))))
        out: list = [None] * len(items)
        for group in _by_length(items, lambda item: len(item[1][0])):
            for start in range(0, len(group), 64):
                some = group[start : start + 64]
                paths = Paths([s for _, (s, _, _) in some], np.array([e for _, (_, e, _) in some]), np.array([f for _, (_, _, f) in some]))
                for (k, _), exits in zip(some, paths.exits().tolist()):
                    out[k] = exits
        rest = batch.drop_columns(["symbols", "ends"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.list_(pa.int64()))], [*rest.schema.names, "exits"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "piece", "final", "entry", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.int32(), *[pa.int64()] * 6]
    conv, place, total = object(), _START, {}
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["conv_id"] != conv:
                conv, place = row["conv_id"], _START
                total = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "low": None, "high": None, "last": None, "cost": row["cost"]}
            for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
                total[name] += row[name]
            if row["first"] is not None:
                total["illegal"] += total["last"] is not None and (total["last"], row["first"]) not in _LEGAL
                total["last"] = row["last"]
            if row["low"] is not None:
                total["turns"] -= row["low"] == total["high"]
                total["low"] = row["low"] if total["low"] is None else total["low"]
                total["high"] = row["high"]
            gaps = 0 if total["low"] is None else total["high"] - total["low"] + 1 - total["turns"]
            totals = (gaps, *(total[c] for c in names[5:])) if row["final"] else (None,) * 6
            out.append((row["part"], row["piece"], row["final"], place, *totals))
            place = row["exits"][place]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)


def _repair_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            paths = Paths([row["symbols"]], np.array([row["ends"]]), np.array([row["final"]]))
            audits, rows, places = paths.read(np.zeros(1, np.int64), np.array([row["entry"]]))
            texts = [None if t is None else (t["role"], t["text"]) for t in row["texts"]]
            lines = repaired_lines(audits[0], rows[0], places[0], texts)
            done = [pa.array([False]), pa.array([audits[0].decode()]), pa.array(["\n".join(lines)])]
            one = batch.slice(k, 1)
            yield pa.RecordBatch.from_arrays(
                [*one.columns[:3], done[0], *one.columns[4:10], done[1], done[2]],
                ["conv_id", "part", "piece", "whole", *one.schema.names[4:10], "audit", "repaired"],
            )


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation: its totals, its audit, and the SHA-256 of its repaired text.

    A hash of a whole text is made in order by nature: the pieces of a long conversation pass one task as a stream, none is kept.
    """
    totals = [c.split()[0] for c in _TOTALS.split(", ")]
    whole = repaired.where("whole").select("conv_id", *totals, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))

    @task("conversations")
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audits, empty = hashlib.sha256(), [], True
        for batch in batches:
            last, ends = None, []
            for k, (audit, text, cost) in enumerate(zip(*(batch[c].to_pylist() for c in ("audit", "repaired", "cost")))):
                audits.append(audit)
                if text:
                    digest.update((text if empty else "\n" + text).encode())
                    empty = False
                if cost is not None:
                    ends.append((k, "".join(audits), digest.hexdigest()))
                    digest, audits, empty = hashlib.sha256(), [], True
            last = batch.take(pa.array([k for k, _, _ in ends], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(last[c] for c in ("conv_id", *totals)), pa.array([a for _, a, _ in ends], pa.string()), pa.array([d for _, _, d in ends], pa.string())],
                ["conv_id", *totals, "audit", "repaired_sha256"],
            )

    pieces = repaired.where(~F.col("whole")).repartition(partitions(repaired), "conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return whole.union(pieces.mapInArrow(joined, whole.schema))
