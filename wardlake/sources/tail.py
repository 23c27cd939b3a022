"""Tailing of growing logs: a streaming source whose offset is (file, byte) and not a list of lines.

A file is known by its path. It goes on where it was if the bytes before that place are still the same; a renamed (rotated) file
is recognised by its first line and those bytes, if no file at the old path goes on. Every other file is read from its
beginning, so files that begin alike are all read. Only whole lines are read; a line still being written waits for the
next batch. The last line of a file needs no line break once the file was renamed or has not changed for ``settle`` seconds. New bytes
are cut into ranges that executors read through the file's own store. Spark keeps the offsets in the checkpoint.

A batch takes at most about ``batchbytes``, oldest files first (with ``catchup``, or such a part of what was read before it, if that is more); what is planned already is read from the checkpoint's log. Only files that changed
since are opened to plan, and of new ones as many as fit. A file that is read to its end and ``maxage`` older than the newest one leaves the offset; files
that old which turn up later are taken as read.

Compressed files (.gz) are read too, each by one task, from where the plain file was that they were made of. What cannot be
decompressed gives one line that says so, which no log kind accepts.
"""

from __future__ import annotations

import hashlib
import json
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FIRST_BYTES = 4096
RANGE_BYTES = 64 << 20
READ_BYTES = 4 << 20
PACKED_BYTES = 64 << 10  # at most a thousand times as much text
SETTLE = 600
MAX_AGE = 30 * 86_400


def _store(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "://" not in path else path)
    return fs.LocalFileSystem(), path


@dataclass
class Range(InputPartition):
    file: str
    first: int  # where the batch begins in this file
    start: int
    stop: int
    end: int  # where the batch ends in this file
    skip: int = 0  # of a compressed file's text, what was read when it was plain


def line_end(handle, size: int) -> int:
    """Just behind the last line break of the first ``size`` bytes; 0 without one."""
    stop = size
    while stop > 0:
        start = max(0, stop - FIRST_BYTES)
        handle.seek(start)
        at = handle.read(stop - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        stop = start
    return 0


def _hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def bytes_before(handle, stop: int) -> str:
    """Hash of the last bytes before ``stop``."""
    start = max(0, stop - FIRST_BYTES)
    handle.seek(start)
    return _hash(handle.read(stop - start))


def inflate(handle, size: int) -> Iterator[tuple[bytes, bool]]:
    """Text of the first ``size`` bytes of a gzip file, in pieces, and whether it is complete with this piece."""
    handle.seek(0)
    unzip, left = zlib.decompressobj(31), size
    while left > 0 and (data := handle.read(min(PACKED_BYTES, left))):
        left -= len(data)
        while data:
            if unzip.eof:
                data = data.lstrip(b"\0")
                if not data:
                    break
                unzip = zlib.decompressobj(31)
            text = unzip.decompress(data)
            data = unzip.unused_data
            yield text, unzip.eof and not data


def text_end(handle, size: int) -> tuple[int, bool]:
    """How much text the first ``size`` bytes of a gzip file give: whole lines, or all of a complete file."""
    total, lines, complete = 0, 0, False
    try:
        for text, complete in inflate(handle, size):
            at = text.rfind(b"\n")
            lines = total + at + 1 if at >= 0 else lines
            total += len(text)
    except zlib.error:
        pass
    return (total if complete else lines), complete


def text_before(handle, size: int, stop: int) -> str | None:
    """As ``bytes_before``, in the text of a gzip file; None if it has less text."""
    last, total = b"", 0
    try:
        for text, _ in inflate(handle, size):
            last = last[-FIRST_BYTES:] + text
            total += len(text)
            if total >= stop:
                last = last[: len(last) - (total - stop)]
                return _hash(last[-min(FIRST_BYTES, stop) :])
    except zlib.error:
        pass
    return None


def _first_line(handle, info) -> str:
    head = b""
    if _packed(info.path):
        try:
            for text, _ in inflate(handle, info.size):
                head += text
                if b"\n" in head or len(head) >= FIRST_BYTES:
                    break
        except zlib.error:
            pass
    else:
        handle.seek(0)
        head = handle.read(min(info.size, FIRST_BYTES))
    return _hash(head[:FIRST_BYTES].split(b"\n", 1)[0])


def _packed(file: str) -> bool:
    return file.endswith(".gz")


class TailReader(DataSourceStreamReader):
    """An offset has for each file the hash of its first line, the hash of the bytes before its end, its end, and what it looked like
    (time and size, null while more of it is there to be read); and the time up to which files are taken as read.
    """

    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", 0)) or None
        self.catch_up = int(options.get("catchup", 0)) or None
        self.settle, self.max_age = float(options.get("settle", SETTLE)), float(options.get("maxage", MAX_AGE))
        self.checkpoint = options.get("checkpoint")
        self.planned: dict = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _start(self) -> dict:
        """The end of what is planned: of the last offset in the checkpoint's log, or of what this reader was asked for."""
        from pyarrow import fs

        if self.checkpoint is None:
            return self.planned
        store, folder = _store(f"{self.checkpoint}/offsets")
        logged = [x for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.base_name.isdigit()]
        if not logged:
            return self.initialOffset()
        with store.open_input_file(max(logged, key=lambda x: int(x.base_name)).path) as handle:
            return json.loads(handle.read().decode().split("\n")[2])

    def _limit(self, old: dict) -> int | None:
        """Bytes of the next batch: a long backlog takes batches in the order of its logarithm, none larger than a part of what is stored."""
        if not self.batch_bytes or not self.catch_up:
            return self.batch_bytes
        return max(self.batch_bytes, sum(x[2] for x in old.values()) // self.catch_up)

    def latestOffset(self) -> dict:
        from pyarrow import fs

        start = self._start()
        old, aged = _files(start), start.get("aged", 0.0)
        limit = self._limit(old)
        store, folder = _store(self.path)
        listed = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        wanted = {x.path: x for x in listed if x.type == fs.FileType.File and x.base_name[0] not in "._" and fnmatch(x.base_name, self.pattern)}
        times = {f: x.mtime.timestamp() if x.mtime else None for f, x in wanted.items()}
        settled = {f for f, t in times.items() if t is not None and time.time() - t >= self.settle}
        open_files, kept = [], {}
        for file, info in wanted.items():
            seen = old.get(file)
            if seen and seen[3:] == [times[file], info.size] and (seen[2] == info.size or file not in settled):
                kept[file] = seen
            elif seen or times[file] is None or times[file] > aged:
                open_files.append(file)
        open_files.sort(key=lambda f: (f not in old, _packed(f), times[f] or 0.0, f))  # known ones first, then plain before packed, the oldest first

        heads, ends, total = {}, {}, 0
        going_on = {f for f in old if f in kept}
        for file in open_files:
            if limit and file not in old and total >= limit and len(going_on) == len(old):
                break  # no file has moved and the batch is full: the rest can wait unopened
            size = wanted[file].size
            with store.open_input_file(file) as handle:
                end = size if _packed(file) or file in settled else line_end(handle, size)
                if not size or not end and file not in old:
                    continue
                first, plain = _first_line(handle, wanted[file]), file.removesuffix(".gz")
                beside = heads.get(plain) or kept.get(plain)
                if _packed(file) and plain in wanted and beside and beside[0] == first and self._in_making(handle, size, wanted[plain].size):
                    continue
                heads[file], ends[file] = [first, "", size], end
            if file in old and self._goes_on(store, file, heads[file], file, old[file]):
                going_on.add(file)
            elif file not in old:
                total += size
        places = self.places({"files": {f: x for f, x in old.items() if f not in kept}}, {"files": heads})

        files, left = dict(kept), limit or float("inf")
        for file, (first, _, size) in heads.items():
            place, skip = places[file]
            if left <= 0 and not place and not skip:
                continue
            with store.open_input_file(file) as handle:
                moved = place > 0 and file not in old
                stop = size if moved else ends[file]
                if left <= 0:
                    stop = 0 if _packed(file) else place
                elif not _packed(file) and stop - place > left:
                    stop = line_end(handle, place + int(left))
                    stop = stop if stop > place else min(_next_line(handle, place), size)
                stop = max(stop, 0 if _packed(file) else place)
                whole = stop == size if _packed(file) else stop >= (size if moved else ends[file])
                files[file] = [first, bytes_before(handle, stop), stop, *([times[file], size] if whole else [None, None])]
            left = left - (stop if _packed(file) else stop - place) if files[file][3] is not None else 0
        # without the checkpoint's log a restart would take aged files for new ones
        return {"files": files} if self.checkpoint is None else self._with_age(files, wanted, times, aged)

    def _with_age(self, files: dict, wanted: dict, times: dict, aged: float) -> dict:
        """The offset without files that are read and old; nothing that is still to be read counts as old."""
        known = [t for t in times.values() if t is not None]
        unread = [t for f, t in times.items() if t is not None and t > aged and wanted[f].size and (f not in files or files[f][2] < wanted[f].size)]
        limit = min([max(known, default=0.0) - self.max_age, *[t - 1e-3 for t in unread]])
        aged = max(aged, limit)
        return {"files": {f: x for f, x in files.items() if x[3] is None or x[3] > aged or x[2] < x[4]}, "aged": aged}

    @staticmethod
    def _in_making(handle, size: int, plain: int) -> bool:
        """A gzip file beside the plain file that it is being made of: not complete, or just as long."""
        handle.seek(max(0, size - 4))
        length = int.from_bytes(handle.read(4), "little")
        return length == plain % (1 << 32) or not text_end(handle, size)[1]

    def places(self, start: dict, end: dict) -> dict[str, tuple[int, int]]:
        """Where each file of ``end`` goes on: bytes, and of a newly compressed file its text. Each old file goes on once."""
        old = _files(start)
        store, _ = _store(self.path)
        out: dict[str, tuple[int, int]] = {}
        for file, now in end["files"].items():
            if file in old and (now == old[file] or self._goes_on(store, file, now, file, old[file])):
                out[file] = (old.pop(file)[2], 0)
        for file, now in end["files"].items():
            if file in out:
                continue
            out[file] = (0, 0)
            for was in sorted(old, key=lambda f: (-old[f][2], f)):
                if was != file and self._goes_on(store, file, now, was, old[was]):
                    stop = old.pop(was)[2]
                    out[file] = (0, stop) if _packed(file) and not _packed(was) else (stop, 0)
                    break
        return out

    @staticmethod
    def _goes_on(store, file: str, now: list, was: str, before: list) -> bool:
        first, check, stop = before[:3]
        if _packed(was) and not _packed(file) or now[0] != first and not (_packed(was) and file == was):
            return False
        if _packed(file) == _packed(was) and now[2] < stop:
            return False
        with store.open_input_file(file) as handle:
            if _packed(file) and not _packed(was):
                return text_before(handle, now[2], stop) == check if check else text_end(handle, now[2])[0] >= stop
            return not check or bytes_before(handle, stop) == check

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        places = self.places(start, end)
        for file, (_, _, stop, *_) in end["files"].items():
            first, skip = places[file]
            if _packed(file):
                out += [Range(file, first, first, stop, stop, skip)] if first < stop else []
            else:
                out += [Range(file, first, at, min(at + self.range_bytes, stop), stop) for at in range(first, stop, self.range_bytes)]
        self.planned = end
        return out

    def read(self, partition: Range) -> Iterator:
        import pyarrow as pa

        store, _ = _store(self.path)
        names = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("value", pa.string())])
        with store.open_input_file(partition.file) as handle:
            for offsets, values in (_packed_lines if _packed(partition.file) else _plain_lines)(handle, partition):
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(values)), pa.array(offsets, pa.int64()), pa.array(values)], schema=names)


def _text(line: bytes) -> str:
    return line.removesuffix(b"\r").decode("utf-8", "replace")


def _files(offset: dict) -> dict[str, list]:
    """The files of an offset; earlier forms had {first line: [path, end]} or no times."""
    named = [(k, v) if len(v) > 2 else (v[0], [k, "", v[1]]) for k, v in offset["files"].items()]
    return {file: x if len(x) == 5 else [*x, None, None] for file, x in named}


def _plain_lines(handle, partition: Range) -> Iterator[tuple[list[int], list[str]]]:
    at = partition.start
    if at > partition.first:  # the line that reaches into this range belongs to the one before
        at = _next_line(handle, at - 1)
    handle.seek(at)
    rest, read = b"", at
    while at < partition.stop:
        block = handle.read(min(READ_BYTES, partition.end - read))
        if not block:
            if rest:  # the last line of a file at rest
                yield [at], [_text(rest)]
            break
        read += len(block)
        lines = (rest + block).split(b"\n")
        rest, offsets, values = lines.pop(), [], []
        for line in lines:
            if at >= partition.stop:
                break
            offsets.append(at)
            values.append(_text(line))
            at += len(line) + 1
        if values:
            yield offsets, values


def _packed_lines(handle, partition: Range) -> Iterator[tuple[list[int], list[str]]]:
    """Lines of a compressed file; offsets count its text. The last line of a complete file needs no line break."""
    at = max(partition.skip, text_end(handle, partition.first)[0])
    rest, total, complete = b"", 0, False
    try:
        for text, complete in inflate(handle, partition.stop):
            new = text[max(0, at + len(rest) - total) :]
            total += len(text)
            lines = (rest + new).split(b"\n")
            rest, offsets, values = lines.pop(), [], []
            for line in lines:
                offsets.append(at)
                values.append(_text(line))
                at += len(line) + 1
            if values:
                yield offsets, values
        if complete and rest:
            yield [at], [_text(rest)]
    except zlib.error as error:
        yield [at], [f"unreadable gzip file: {error}"]


def _next_line(handle, at: int) -> int:
    handle.seek(at)
    while block := handle.read(FIRST_BYTES):
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return at


class WholeReader(DataSourceReader):
    """All lines that there are now, the last ones too."""

    def __init__(self, options: dict):
        self.tail = TailReader(options | {"settle": "-inf"})

    def partitions(self) -> list[Range]:
        return self.tail.partitions(self.tail.initialOffset(), self.tail.latestOffset())

    def read(self, partition: Range) -> Iterator:
        return self.tail.read(partition)


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})

    def reader(self, schema) -> WholeReader:
        return WholeReader({k.lower(): v for k, v in self.options.items()})


def tail_lines(spark: SparkSession, folder: str, pattern: str = "*", checkpoint: str | None = None, batch_bytes: int | None = None, **options) -> DataFrame:
    """Stream of (file, offset, value): the lines of the folder's files, plain or gzip, each once, as they grow.

    ``batch_bytes`` needs ``checkpoint``, the query's own checkpoint, to know after a restart what was planned. Other options: ``settle``,
    ``maxage`` (seconds), ``rangebytes``, ``catchup`` (the part of what was read that a batch may take if it is more than ``batch_bytes``: 16 for a sixteenth).
    """
    if batch_bytes and not checkpoint:
        raise ValueError("batch_bytes needs the query's checkpoint")
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format("log_tail").option("path", folder).option("pattern", pattern)
    given = {"checkpoint": checkpoint, "batchbytes": batch_bytes, **options}
    return reader.options(**{k: str(v) for k, v in given.items() if v is not None}).load()


def read_lines(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, offset, value): all lines of the folder's files, plain or gzip, as a table."""
    spark.dataSource.register(LogTail)
    return spark.read.format("log_tail").option("path", folder).option("pattern", pattern).load()
