"""Lines of growing files as a stream: a data source with a position for each file.

Transcripts grow in place, which Spark's file source doesn't follow. This one keeps,
for every file, how many bytes and complete lines it has given, and gives what came
since; a line counts as complete with its newline. Where a file has become shorter,
or the bytes before its position have changed, it was rewritten: lines are what is
kept then, so it goes on after as many lines as it has given, or at the last there
are. Positions are plain files under `state`, numbered, and the stream's offset is
their number, so that offsets stay small and a restart finds the positions again.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that are looked through for new lines before a trigger ends, bytes read at once, and bytes before a position that must not change.
BYTES_PER_TRIGGER, BLOCK, GUARD = 256 << 20, 4 << 20, 256
_SCHEMA = pa.schema([("path", pa.string()), ("line", pa.int64()), ("value", pa.string())])


@dataclass(frozen=True)
class Position:
    """What a file has given: `bytes` and `lines` up to a newline, checked by `guard`. Since its last rewrite (`rewrites`) it gives from_bytes on."""

    bytes: int = 0
    lines: int = 0
    guard: int = 0
    size: int = 0
    modified: float = 0.0
    rewrites: int = 0
    from_bytes: int = 0
    from_lines: int = 0


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    line: int


def _guard(f, at: int) -> int:
    f.seek(max(0, at - GUARD))
    return zlib.crc32(f.read(min(at, GUARD)))


def _scan(f, start: int, end: int, most_lines: int | None = None) -> tuple[int, int]:
    """(position after the last newline, newlines) of the bytes start..end, of the first most_lines only if given."""
    at, lines, last = start, 0, start
    f.seek(start)
    while at < end and (most_lines is None or lines < most_lines):
        block = f.read(min(BLOCK, end - at))
        if not block:
            break
        n = block.count(b"\n")
        if most_lines is not None and lines + n >= most_lines:
            k = -1
            for _ in range(most_lines - lines):
                k = block.index(b"\n", k + 1)
            return at + k + 1, most_lines
        if n:
            last, lines = at + block.rindex(b"\n") + 1, lines + n
        at += len(block)
    return last, lines


def advanced(f, old: Position, size: int, modified: float, budget: int) -> Position:
    """A file's position now, of which up to about `budget` new bytes are looked through."""
    if size < old.bytes or (old.bytes and _guard(f, old.bytes) != old.guard):
        at, lines = _scan(f, 0, size, old.lines)
        old = replace(old, bytes=at, lines=lines, rewrites=old.rewrites + 1, from_bytes=at, from_lines=lines)
    end, last, lines = old.bytes, old.bytes, 0
    while end < size and end - old.bytes < budget:
        # A line longer than the budget is looked through whole.
        end = min(size, end + budget)
        last, lines = _scan(f, old.bytes, end)
        if last > old.bytes:
            break
        budget *= 2
    at = max(last, old.bytes)
    whole = end >= size
    return replace(old, bytes=at, lines=old.lines + lines, guard=_guard(f, at), size=size if whole else -1, modified=modified)


def ranges(before: dict[str, Position], now: dict[str, Position]) -> list[Range]:
    """What is read to come from one set of positions to another: a range of a file each."""
    out = []
    for path, p in sorted(now.items()):
        old = before.get(path, Position())
        start, line = (old.bytes, old.lines) if old.rewrites == p.rewrites else (p.from_bytes, p.from_lines)
        if p.bytes > start:
            out.append(Range(path, start, p.bytes, line))
    return out


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.state, self.glob = options["path"], options["state"].rstrip("/"), options.get("suffix", ".jsonl")
        self.budget = int(options.get("bytespertrigger", BYTES_PER_TRIGGER))
        self.now: tuple[int, dict[str, Position]] | None = None

    def _states(self) -> tuple[pafs.FileSystem, str, list[int]]:
        fs, base = pafs.FileSystem.from_uri(self.state)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return fs, base, sorted(int(i.base_name[:-5]) for i in found if i.base_name.endswith(".json"))

    def _load(self, n: int) -> dict[str, Position]:
        if n == 0:
            return {}
        fs, base, _ = self._states()
        with fs.open_input_stream(f"{base}/{n:020d}.json") as f:
            return {k: Position(**v) for k, v in json.loads(f.read()).items()}

    def _save(self, n: int, positions: dict[str, Position]) -> None:
        fs, base, _ = self._states()
        fs.create_dir(base)
        waiting = f"{base}/{n:020d}.waiting"
        with fs.open_output_stream(waiting) as f:
            f.write(json.dumps({k: asdict(v) for k, v in positions.items()}).encode())
        fs.move(waiting, f"{base}/{n:020d}.json")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"state": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.now is None:
            states = self._states()[2]
            self.now = (states[-1], self._load(states[-1])) if states else (0, {})
        n, positions = self.now
        fs, base = pafs.FileSystem.from_uri(self.root)
        left, new = self.budget, dict(positions)
        for info in sorted(fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)), key=lambda i: i.path):
            if info.type != pafs.FileType.File or not info.base_name.endswith(self.glob) or left <= 0:
                continue
            modified = info.mtime.timestamp() if info.mtime else 0.0
            old = new.get(info.path, Position())
            if (old.size, old.modified) != (info.size, modified):
                with fs.open_input_file(info.path) as f:
                    new[info.path] = advanced(f, old, info.size, modified, left)
                left -= max(0, new[info.path].bytes - old.bytes)
        if ranges(positions, new) or any(p.rewrites != positions.get(k, p).rewrites for k, p in new.items()):
            n += 1
            self._save(n, new)
        self.now = n, new
        return {"state": n}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(self._load(start["state"]), self._load(end["state"]))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.root)
        with fs.open_input_file(partition.path) as f:
            f.seek(partition.start)
            at, line, rest = partition.start, partition.line, b""
            while at < partition.end:
                block = f.read(min(BLOCK, partition.end - at))
                if not block:
                    break
                at += len(block)
                *whole, rest = (rest + block).split(b"\n")
                if whole:
                    numbers = pa.array(range(line + 1, line + 1 + len(whole)), pa.int64())
                    line += len(whole)
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(whole)), numbers, pa.array([x.decode("utf-8", "replace") for x in whole])], schema=_SCHEMA)

    def commit(self, end: dict) -> None:
        """Positions before the ones that a restart may ask for are dropped."""
        fs, base, states = self._states()
        for n in states:
            if n < end["state"] - 1:
                fs.delete_file(f"{base}/{n:020d}.json")


class LineTail(DataSource):
    """Options: path (a folder, read recursively), state (a folder of its own), suffix, bytesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "path string, line long, value string"

    def streamReader(self, schema) -> _Reader:  # noqa: N802
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_tail(spark: SparkSession, path: str, state: str, suffix: str = ".jsonl", bytes_per_trigger: int = BYTES_PER_TRIGGER) -> DataFrame:
    """path, line (from 1), value: each line of each file once, as it comes. Paths are those of the file system, without a scheme."""
    spark.dataSource.register(LineTail)
    return spark.readStream.format("line_tail").options(path=path, state=state, suffix=suffix, bytesPerTrigger=str(bytes_per_trigger)).load()


