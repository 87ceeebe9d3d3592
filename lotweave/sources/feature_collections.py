"""FeatureCollections read by byte ranges: a Python data source, ``feature_collection``.

A collection is one JSON object, so a task that starts in its middle does not know whether it stands
inside a string or how deep. Every range is therefore scanned twice, first without and then with that
knowledge:

1. A survey scans each range in a task of its own under both assumptions, outside and inside a
   string, and reports for each how the range ends, how many brackets of earlier ranges it closes and
   which of its own stay open: a few numbers a range. Folding them in order gives every range its
   true start state.
2. The read cuts out the objects that begin in a range inside the ``features`` array. An object that
   reaches over the range's end is read on from there.

Small ranges are dealt to a bounded number of tasks, several in a row to one. Tasks open files with ``pyarrow.fs`` and read them in pieces, so no file is held whole. ``pos`` grows
in file order but has gaps. Text that is no FeatureCollection gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, unless the option ``rangebytes`` says otherwise.
RANGE_BYTES = 32 << 20
READ_BYTES = 1 << 20
#: Fewest tasks that many small ranges are dealt to; larger layers get one for every ``RANGE_BYTES``.
TASKS = 128
_MARK = re.compile(rb'["\\{}\[\]]')


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and inner path of an address; plain paths are local."""
    for scheme in ("s3a://", "s3n://"):
        path = path.replace(scheme, "s3://", 1) if path.startswith(scheme) else path
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def files(path: str) -> list[tuple[str, int]]:
    """(inner path, bytes) of the file, or of the plain files in the folder, in order of their names."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(inner, info.size)]
    if info.type == pafs.FileType.NotFound:
        return []
    found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


def chunks(path: str, name: str, start: int, end: int, piece: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of a file from ``start`` to ``end``, in bounded pieces."""
    piece = min(READ_BYTES, piece or READ_BYTES)
    system, _ = opened(path)
    with system.open_input_file(name) as source:
        source.seek(start)
        while start < end:
            data = source.read(min(piece, end - start))
            if not data:
                return
            yield start, data
            start += len(data)


class Scanner:
    """Depth and strings over the bytes of a JSON text that come in pieces.

    ``step`` yields (offset, mark) for each bracket outside strings. A backslash hides the byte after
    it, also over the border of two pieces.
    """

    def __init__(self, in_string: bool = False, hidden: int = -1):
        self.in_string, self.hidden = in_string, hidden

    def step(self, at: int, data: bytes) -> Iterator[tuple[int, int]]:
        for m in _MARK.finditer(data):
            place, mark = at + m.start(), data[m.start()]
            if place == self.hidden:
                continue
            if mark == 0x5C:
                if self.in_string:
                    self.hidden = place + 1
            elif mark == 0x22:
                self.in_string = not self.in_string
            elif not self.in_string:
                yield place, mark


@dataclass
class Range:
    """Bytes ``start`` to ``end`` of a file, and the state in which they begin."""

    path: str
    name: str
    size: int
    start: int
    end: int
    number: int
    in_string: bool = False
    depth: int = 0
    inside: bool = False  # the ``features`` array is open


@dataclass
class Task(InputPartition):
    """Ranges that follow each other, read by one task."""

    parts: list[Range]


def tasks_of(parts: list[Range]) -> list[Task]:
    """All ranges, dealt in order to as many tasks as their bytes ask for, but not to one task for every small range."""
    wanted = max(TASKS, sum(r.end - r.start for r in parts) // RANGE_BYTES)
    each = max(1, -(-len(parts) // wanted))
    return [Task(parts[at:at + each]) for at in range(0, len(parts), each)] or [Task([])]


def ranges(path: str, width: int) -> list[Range]:
    out: list[Range] = []
    for name, size in files(path):
        out += [Range(path, name, size, at, min(at + width, size), len(out) + k) for k, at in enumerate(range(0, size, width))]
    return out


def _first_byte_hidden(r: Range) -> bool:
    """Whether an odd number of backslashes ends before the range."""
    run, end = 0, r.start
    while end > 0:
        at = max(0, end - 64)
        data = b"".join(d for _, d in chunks(r.path, r.name, at, end))
        kept = len(data) - len(data.rstrip(b"\\"))
        run += kept
        if kept < len(data):
            break
        end = at
    return run % 2 == 1


CONTEXT = 256  # bytes before a bracket in which its member's name is looked up
_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
#: What the survey notes of an open bracket: the array of the member ``features``, or any other.
FEATURES, OTHER = 2, 1


def _is_features(text: bytes, mark: int) -> bool:
    found = _NAME.search(text[-CONTEXT:]) if mark == 0x5B else None
    return found is not None and found.group(1) == b"features"


def _marks(r: Range, in_string: bool, end: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(offset, mark, offset of the piece, bytes before the piece, piece) of the brackets outside strings."""
    scanner = Scanner(in_string, r.start if in_string and _first_byte_hidden(r) else -1)
    before = b"".join(d for _, d in chunks(r.path, r.name, max(0, r.start - CONTEXT), r.start))
    for at, data in chunks(r.path, r.name, r.start, end, r.end - r.start):
        for place, mark in scanner.step(at, data):
            yield place, mark, at, before, data
        yield -1, int(scanner.in_string), at, before, data  # the piece is done
        before = (before + data)[-CONTEXT:]


def survey(r: Range) -> Iterator[tuple[bool, bool, int, list[int]]]:
    """For both assumptions: starts in a string, ends in one, brackets of earlier ranges closed, own ones left open."""
    for guess in (False, True):
        closed, left, ends = 0, [], guess
        for place, mark, at, before, data in _marks(r, guess, r.end):
            if place < 0:
                ends = bool(mark)
            elif mark in b"{[":
                left.append(FEATURES if _is_features((before + data[:place - at]) if place - at < CONTEXT else data[place - at - CONTEXT:place - at], mark) else OTHER)
            elif left:
                left.pop()
            else:
                closed += 1
        yield guess, ends, closed, left


def starts(found: dict[tuple[int, bool], tuple[bool, int, list[int]]], parts: list[Range]) -> list[tuple[bool, int, bool]]:
    """(in a string, depth, inside ``features``) at the beginning of each range."""
    out, in_string, stack = [], False, []
    for r in parts:
        if r.start == 0:
            in_string, stack = False, []
        out.append((in_string, len(stack), len(stack) >= 2 and stack[1] == FEATURES))
        in_string, closed, left = found[(r.number, in_string)]
        stack = stack[:max(0, len(stack) - closed)] + left
    return out


def cut_features(r: Range) -> Iterator[tuple[int, str]]:
    """(offset, text) of the objects that begin in the range at depth 2, inside the ``features`` array."""
    depth, inside, start, text = r.depth, r.inside, None, []
    for place, mark, at, before, data in _marks(r, r.in_string, r.size):
        if place < 0:
            if start is not None:
                text.append(data[max(0, start - at):])
            elif at + len(data) >= r.end:
                return
        elif mark in b"{[":
            if depth == 1:
                inside = _is_features(before + data[:place - at], mark)
            elif depth == 2 and mark == 0x7B and inside:
                if place >= r.end:
                    return
                start, text = place, []
            depth += 1
        else:
            depth -= 1
            if depth == 2 and start is not None:
                yield start, (b"".join(text) + data[max(0, start - at):place + 1 - at]).decode("utf-8", "replace")
                start = None


class FeatureCollectionSource(DataSource):
    """``spark.read.format("feature_collection").option("path", ...).load()``: pos, value."""

    @classmethod
    def name(cls) -> str:
        return "feature_collection"

    def schema(self) -> str:
        return "pos bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class SurveySource(DataSource):
    """What ``survey`` finds in each range."""

    @classmethod
    def name(cls) -> str:
        return "feature_collection_survey"

    def schema(self) -> str:
        return "number int, guess boolean, ends boolean, closed int, left array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _SurveyReader(self.options)


class _Ranges(DataSourceReader):
    def __init__(self, options):
        self.path, self.width = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.states = [tuple(map(int, s.split(","))) for s in options.get("states", "").split(";") if s]

    def partitions(self) -> list[Task]:
        out = ranges(self.path, self.width)
        for r, (in_string, depth, inside) in zip(out, self.states, strict=bool(self.states)):
            r.in_string, r.depth, r.inside = bool(in_string), depth, bool(inside)
        self.states = []  # each range has its own now; the reader goes to every task
        return tasks_of(out)


class _SurveyReader(_Ranges):
    def read(self, task: Task):
        for r in task.parts:
            for guess, ends, closed, left in survey(r):
                yield r.number, guess, ends, closed, left


class _Reader(_Ranges):
    def read(self, task: Task):
        for r in task.parts:
            for at, text in cut_features(r):
                yield (r.number << 40) + at - r.start, text


def collection_rows(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(pos, value): the text of each feature of the collections at ``path``, a file or a folder."""
    spark.dataSource.register(FeatureCollectionSource)
    spark.dataSource.register(SurveySource)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)  # an address without scheme lies where Spark's default is
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = system.makeQualified(hadoop).toString()
    whole = whole.removeprefix("file:") if whole.startswith("file:") else whole
    options = {"path": whole, "rangebytes": str(range_bytes)}
    parts = ranges(whole, range_bytes)
    found = {(r["number"], r["guess"]): (r["ends"], r["closed"], list(r["left"]))  # two short rows a range
             for r in spark.read.format("feature_collection_survey").options(**options).load().collect()}
    states = ";".join(",".join(str(int(v)) for v in s) for s in starts(found, parts))
    return spark.read.format("feature_collection").options(**options, states=states).load()
