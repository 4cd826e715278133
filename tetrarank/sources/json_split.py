"""One JSON list or object of any size, read by many tasks.

Spark's text reader cuts the file: with `}` as line end it splits it by byte ranges in whatever store it lies, and a row ends where an object
may end. Such an end never falls between a backslash and what it escapes, so every range can be scanned by itself but for
two things it cannot know: whether it starts inside a string, and how deep. A first pass sums up each range for both cases
(quotes, and the change of depth), a row per range goes to the driver, and from these every start is known. A second pass cuts
the ranges at the commas between members. A member that runs over a border leaves its fragments in the ranges it touches;
these, one or two per range, are put together afterwards. No range but its own text is ever in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUOTE, BACKSLASH, COMMA = 34, 92, 44
#: +1 for what opens a level, -1 for what closes one.
_STEP = np.zeros(256, np.int8)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1
PARTS = "file string, start bigint, part int, text string"


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text up to each `}` (left out), with its file and the start of its byte range, in order within a range."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def outside(raw: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Which bytes lie outside of strings, and whether the end lies inside one. Quotes count as inside."""
    quote = raw == QUOTE
    marks = np.flatnonzero(raw == BACKSLASH)
    if len(marks):
        first = np.append(True, np.diff(marks) > 1)
        run = marks - np.maximum.accumulate(np.where(first, marks, 0)) + 1  # backslashes up to here
        after = marks[run % 2 == 1] + 1
        last = np.append(np.diff(marks) > 1, True)[run % 2 == 1]
        after = after[last & (after < len(raw))]
        quote[after] = False
    parity = (np.cumsum(quote) + inside) % 2 == 1
    return ~(parity | quote), bool(parity[-1]) if len(raw) else inside


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    """(file, start of range, bytes) of consecutive rows, each row with its `}` again."""
    for batch in batches:
        file, start = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        value = batch.column(0).to_pylist()
        at = 0
        while at < len(value):
            to = at + 1
            while to < len(value) and start[to] == start[at] and file[to] == file[at]:
                to += 1
            yield file[at], start[at], np.frombuffer(b"}".join(value[at:to]) + b"}", np.uint8)
            at = to


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per range: quotes odd or even, change of depth and least depth if it starts outside and inside of a string, its first bytes."""
    found = {}
    for file, start, raw in _buffers(batches):
        one = found.setdefault((file, start), [[False, 0, 0], [True, 0, 0], bytes(raw[:64])])
        for case in one[:2]:
            free, case[0] = outside(raw, case[0])
            change = np.cumsum(_STEP[raw[free]], dtype=np.int64)
            if len(change):
                case[2] = min(case[2], case[1] + int(change.min()))
                case[1] += int(change[-1])
    for (file, start), (out, inn, head) in found.items():
        yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "odd": [out[0]], "out": [out[1:]], "inn": [inn[1:]], "head": [head]})


class Cutter:
    """Cuts the bytes of a range at the commas of one level; buffer after buffer.

    Level 1 are the members of the document. Level 2 are those of the list that is the value of the member `name`.
    """

    def __init__(self, inside: bool, depth: int, level: int, name: str | None, active: bool):
        self.inside, self.depth, self.level, self.active = inside, depth, level, active
        self.name = None if name is None else b'"' + name.encode() + b'"'
        self.opened = self.closed = False
        self.rest, self.parts = b"", 0
        self.seen = active  # whether the range holds text of the level

    def feed(self, raw: np.ndarray) -> list[bytes]:
        """Members that end in this buffer; what follows the last comma stays in `rest`."""
        free, self.inside = outside(raw, self.inside)
        step = np.where(free, _STEP[raw], 0)
        after = self.depth + np.cumsum(step, dtype=np.int64)
        self.depth = int(after[-1])
        text, out, at = raw.tobytes(), [], 0
        if not self.active:
            if self.closed:
                return []
            opens = np.flatnonzero((step == 1) & (after == self.level))
            first = next((int(o) for o in opens if self.name is None or self._named(text, int(o))), None)
            if first is None:
                return []
            self.active = self.opened = self.seen = True
            at = first + 1
        ends = at + np.flatnonzero((step[at:] == -1) & (after[at:] == self.level - 1))
        stop = int(ends[0]) if len(ends) else len(raw)
        for comma in at + np.flatnonzero(free[at:stop] & (raw[at:stop] == COMMA) & (after[at:stop] == self.level)):
            out.append(self.rest + text[at:comma])
            self.rest, at = b"", int(comma) + 1
        self.rest += text[at:stop]
        if len(ends):
            self.active, self.closed = False, True
        return out

    def _named(self, text: bytes, at: int) -> bool:
        before = text[max(0, at - len(self.name) - 4096):at].rstrip()
        return text[at:at + 1] == b"[" and before.endswith(b":") and before[:-1].rstrip().endswith(self.name)


def _cutters(starts: dict, level: int, name: str | None) -> Callable:
    def made(file: str, start: int) -> Cutter:
        inside, depth, active = starts[file, start]
        return Cutter(inside, depth, level, name, active)

    return made


def _members(starts: dict, level: int, name: str | None, edges: bool) -> Callable:
    """Whole members (part 1), or the first (part 0) and last (part 2) fragment of each range.

    The first fragment continues a member of the range before; a range without a comma is one fragment (part 0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, cutters = _cutters(starts, level, name), {}

        def batch(file: str, start: int, part: int, texts: list[bytes]) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_pydict({"file": [file] * n, "start": [start] * n, "part": pa.array([part] * n, pa.int32()),
                                               "text": pa.array(texts, pa.binary()).cast(pa.string())})

        for file, start, raw in _buffers(batches):
            cutter = cutters.setdefault((file, start), made(file, start))
            found = cutter.feed(raw)
            whole = found if cutter.parts or starts[file, start][2] is False else found[1:]
            if edges and len(whole) < len(found):
                yield batch(file, start, 0, found[:1])
            cutter.parts += len(found)
            if not edges and whole:
                yield batch(file, start, 1, whole)
        for (file, start), cutter in cutters.items():
            if edges and cutter.seen:
                continued = not cutter.parts and starts[file, start][2]
                yield batch(file, start, 0 if continued else 2, [cutter.rest])

    return run


def _openings(starts: dict, names: list[str]) -> Callable:
    """Per range and name: whether the list of that name opens there, and whether it closes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for file, start, raw in _buffers(batches):
            inside, depth, _ = starts[file, start]
            own = found.setdefault((file, start), {n: Cutter(inside, depth, 2, n, False) for n in names})
            for cutter in own.values():
                cutter.feed(raw)
                cutter.rest = b""
        for (file, start), own in found.items():
            for n, cutter in own.items():
                if cutter.opened:
                    yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "name": [n], "closed": [cutter.closed]})

    return run


def _starts(spark: SparkSession, path: str) -> tuple[DataFrame, dict, dict, str]:
    """Pieces; (inside of a string, depth, depth above 0) at the start of each range; least depth in each; kind of document."""
    rows = pieces(spark, path)
    summary = rows.mapInArrow(_summaries, "file string, start bigint, odd boolean, out array<bigint>, inn array<bigint>, head binary")
    starts, least, kinds, state = {}, {}, set(), {}
    for r in sorted(summary.collect(), key=lambda r: (r.file, r.start)):  # a row per byte range
        inside, depth = state.get(r.file, (False, 0))
        if r.file not in state:
            kinds.add(bytes(r.head).lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode())
        change, low = r.inn if inside else r.out
        starts[r.file, r.start], least[r.file, r.start] = (inside, depth, depth > 0), depth + low
        state[r.file] = inside ^ r.odd, depth + change
    if not kinds <= {"[", "{"} or len(kinds) != 1:
        raise ValueError(f"{path}: expected a JSON list or object")
    return rows, starts, least, kinds.pop()


def _parts(rows: DataFrame, starts: dict, level: int, name: str | None) -> DataFrame:
    whole = rows.mapInArrow(_members(starts, level, name, False), PARTS).select("text")
    edges = rows.mapInArrow(_members(starts, level, name, True), PARTS)
    order = W.partitionBy("file").orderBy("start", "part")
    member = edges.withColumn("member", F.sum((F.col("part") == 2).cast("int")).over(order)).groupBy("file", "member").agg(
        F.array_sort(F.collect_list(F.struct("start", "part", "text"))).alias("parts"))
    joined = member.select(F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    return whole.unionByName(joined).where(F.trim(F.translate("text", "\t\r\n", "   ")) != "")


def members(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(text) of each member of the documents at a path, and "[" or "{"; members of an object are `"key": value`."""
    rows, starts, _, kind = _starts(spark, path)
    return _parts(rows, starts, 1, None), kind


def list_inside(spark: SparkSession, path: str, names: list[str]) -> DataFrame | None:
    """(text) of each element of the list under the first of the names that an object has, or None."""
    rows, starts, least, kind = _starts(spark, path)
    if kind == "[":
        return None
    opened = rows.mapInArrow(_openings(starts, names), "file string, start bigint, name string, closed boolean").collect()  # a row per range and name
    name = next((n for n in names if any(o.name == n for o in opened)), None)
    if name is None:
        return None
    state, inside = {}, {}
    of = {(o.file, o.start): o.closed for o in opened if o.name == name}
    for file, start in sorted(starts):
        active = state.get(file, False)
        inside[file, start] = (*starts[file, start][:2], active)
        if (file, start) in of:
            state[file] = not of[file, start]
        elif active and least[file, start] < 2:
            state[file] = False
    return _parts(rows, inside, 2, name)


def documents(spark: SparkSession, path: str, inside: list[str] | None = None) -> DataFrame:
    """(value) small documents: each member of the documents at a path as a list or object of its own.

    With `inside` an object that has a list under one of these names gives the elements of that list, of the first name.
    """
    parts, kind = (list_inside(spark, path, inside), "[") if inside else (None, "")
    if parts is None:
        parts, kind = members(spark, path)
    a, b = ("[", "]") if kind == "[" else ("{", "}")
    return parts.select(F.concat(F.lit(a), "text", F.lit(b)).alias("value"))


def is_lines(spark: SparkSession, path: str) -> bool:
    """Whether another object follows the first one, as in JSON lines, seen from the first pieces."""
    raw = np.frombuffer(b"".join(bytes(r.value) + b"}" for r in pieces(spark, path).limit(1000).collect()), np.uint8)
    if not len(raw):
        return False
    free, _ = outside(raw, False)
    depth = np.cumsum(np.where(free, _STEP[raw], 0), dtype=np.int64)
    opened = np.flatnonzero(depth > 0)
    closed = np.flatnonzero(depth[opened[0]:] == 0) + opened[0] if len(opened) else opened
    return len(closed) > 0 and raw[closed[0] + 1:].tobytes().lstrip().startswith(b"{")
