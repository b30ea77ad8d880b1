"""Text files made of blocks (subtitles, captions) as a Spark data source, ``timed_blocks``.

Reading gives rows of whole blocks, blocks being set apart by blank lines: ``media_id`` is the file's path below the root without
its extension, ``part`` and ``at`` order the rows of one media, and ``text`` holds about ``CHUNK`` bytes at most unless one
block is longer.  Files are cut at ``maxPartitionBytes``; a block belongs to the cut in which it begins, so neither a task nor a cell
holds a whole file.

Writing takes ``media_id``, ``ord`` and ``value`` (a block, or several) and leaves one file per media and task, in a folder per task
attempt.  The folders that count are named by numbered entries under ``_commits``; whatever failed or killed attempts leave is
never read.  A stream follows these numbers, so it reads every committed file once.  Writers to one folder follow one another.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

FORMAT = "timed_blocks"
SCHEMA = "media_id string, part long, at long, text string"
CHUNK = 64 << 10
PARTITION_BYTES = 128 << 20
#: Files so small that opening them is the cost count as this much when partitions are filled: at most 1,024 files a task.
OPEN_BYTES = 128 << 10
#: Characters of a file that a writer collects before it writes them.
WRITE_CHARS = 1 << 20
#: Folders that a writer remembers to have made.
KNOWN_FOLDERS = 1000
COMMITS = "_commits"
#: Stands for an empty step of an id; quoting leaves no percent sign by itself.
NO_NAME = "%"
ATTEMPT = re.compile(r"^t-(\d+)-[0-9a-f]{32}$")


@dataclass
class Pieces(InputPartition):
    """(media_id, part, file, first byte, end byte) of each piece of one task."""

    pieces: list[tuple[str, int, str, int, int]]


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(re.sub(r"^file:/*", "/", path)) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, root.rstrip("/")


def listed(fs: pafs.FileSystem, root: str, recursive: bool = True) -> list[pafs.FileInfo]:
    return fs.get_file_info(pafs.FileSelector(root, recursive=recursive, allow_not_found=True))


def commits(fs: pafs.FileSystem, root: str) -> list[tuple[int, dict]]:
    """(number, entry) of the folder's commits, in order."""
    found = sorted((i.base_name, i.path) for i in listed(fs, f"{root}/{COMMITS}", False) if i.base_name.endswith(".json"))
    out = []
    for name, path in found:
        with fs.open_input_stream(path) as f:
            out.append((int(name.split(".")[0]), json.loads(f.read())))
    return out


def current(entries: list[tuple[int, dict]]) -> dict[str, int]:
    """Attempt folders that count, with the number of their commit; an entry that replaces hides all before it."""
    out: dict[str, int] = {}
    for number, entry in entries:
        if entry["replaces"]:
            out = {}
        out.update((folder, number) for folder in entry["folders"])
    return out


def planned(fs: pafs.FileSystem, root: str, folders: dict[str, int] | None, foreign: bool, ending: str, limit: int) -> list[Pieces]:
    """Partitions of about ``limit`` bytes over committed folders and, if asked for, files that other programs put there."""
    one = fs.get_file_info(root)
    if one.type == pafs.FileType.File:
        return bins([(one.base_name.rsplit(".", 1)[0], 0, root, one.size)], limit)
    files = []
    for info in listed(fs, root):
        if info.type != pafs.FileType.File or not info.path.endswith(ending):
            continue
        names = info.path[len(root) + 1 :].split("/")
        attempt = ATTEMPT.match(names[0])
        if attempt:
            if names[0] not in folders:
                continue
            names = ["" if n == NO_NAME else unquote(n) for n in names[1:-1]] + [unquote(names[-1].removesuffix(ending)).removeprefix(NO_NAME) + ending]
            part = (folders[attempt.group(0)] << 32) + int(attempt.group(1))
        elif foreign and not any(n.startswith(("_", ".")) for n in names):
            part = 0
        else:
            continue
        files.append(("/".join(names).removesuffix(ending), part, info.path, info.size))
    return bins(sorted(files), limit)


def bins(files: list[tuple[str, int, str, int]], limit: int) -> list[Pieces]:
    out, held, size = [], [], 0
    for media, part, path, length in files:
        for a in range(0, max(length, 1), limit):
            b = min(a + limit, length)
            cost = max(b - a, min(OPEN_BYTES, limit))
            if held and size + cost > limit:
                out.append(Pieces(held))
                held, size = [], 0
            held.append((media, part, path, a, b))
            size += cost
    return [*out, Pieces(held)] if held else out


def line_start(f: pa.NativeFile, at: int) -> int:
    """Start of the line that holds the byte before ``at``."""
    width = 4096
    while at > 0:
        low = max(0, at - width)
        f.seek(low)
        cut = f.read(at - 1 - low).rfind(b"\n")
        if cut >= 0:
            return low + cut + 1
        if low == 0:
            break
        width *= 4
    return 0


def lines_from(f: pa.NativeFile, at: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, line with its end) from a line's start on."""
    f.seek(at)
    rest = b""
    while more := f.read(1 << 20):
        rest += more
        *whole, rest = rest.split(b"\n")
        for line in whole:
            yield at, line + b"\n"
            at += len(line) + 1
    if rest:
        yield at, rest


def chunks(f: pa.NativeFile, first: int, end: int, size: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(first byte, text) of whole blocks that begin in [first, end)."""
    held, start, length, blank = [], 0, 0, True
    for at, line in lines_from(f, line_start(f, first)):
        empty = not line.strip(b" \t\r\n")
        if not empty and blank:
            if at >= end:
                break
            if held and length >= size:
                yield start, b"".join(held)
                held, length = [], 0
            if not held and at >= first:
                start = at
        if at >= first and (held or (not empty and blank)):
            held.append(line)
            length += len(line)
        blank = empty
    if held:
        yield start, b"".join(held)


BLANK_LINES = re.compile(rb"(?:[ \t\r]*\n)*")


def small_file(f: pa.NativeFile, size: int) -> Iterator[tuple[int, bytes]]:
    """What ``chunks`` gives for a whole file of at most ``CHUNK`` bytes: all from its first line with a block, without a look at each line."""
    raw = f.read(size)
    start = BLANK_LINES.match(raw).end()
    if raw[start:].strip(b" \t\r\n"):
        yield start, raw[start:]


def rows_of(fs: pafs.FileSystem, pieces: list[tuple[str, int, str, int, int]], limit: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("media_id", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("text", pa.string())])
    rows, size = [], 0
    for media, part, path, first, end in pieces:
        with fs.open_input_file(path) as f:
            # A piece shorter than the cuts that begins a file is all of it.
            for at, raw in small_file(f, end) if first == 0 and end < limit and end <= CHUNK else chunks(f, first, end):
                rows.append((media, part, at, raw.decode("utf-8", "replace")))
                size += len(raw)
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), schema, strict=True)], schema=schema)
                    rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), schema, strict=True)], schema=schema)


class BlockReader(DataSourceReader):
    def __init__(self, path: str, ending: str, limit: int):
        self.path, self.ending, self.limit = path, ending, limit

    def partitions(self) -> list[Pieces]:
        fs, root = opened(self.path)
        return planned(fs, root, current(commits(fs, root)), True, self.ending, self.limit) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return rows_of(opened(self.path)[0], partition.pieces, self.limit)


class BlockStream(DataSourceStreamReader):
    """Reads what each commit added; entries that replace earlier ones add their files as well."""

    def __init__(self, path: str, ending: str, limit: int):
        self.path, self.ending, self.limit = path, ending, limit

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        fs, root = opened(self.path)
        return {"commit": max((n for n, _ in commits(fs, root)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        fs, root = opened(self.path)
        folders = {f: n for n, entry in commits(fs, root) if start["commit"] < n <= end["commit"] for f in entry["folders"]}
        return planned(fs, root, folders, False, self.ending, self.limit) if folders else []

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return rows_of(opened(self.path)[0], partition.pieces, self.limit)


class BlockWriter(DataSourceArrowWriter):
    """Rows must come sorted by media and order within a partition; ``write_blocks`` sees to that."""

    def __init__(self, path: str, ending: str, header: str, replaces: bool):
        self.path, self.ending, self.header, self.replaces = path, ending, header, replaces

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, root = opened(self.path)
        folder = f"t-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        last, out, files, held, size, made = None, None, 0, [], 0, set()
        try:
            for batch in iterator:
                for media, value in zip(batch.column("media_id").to_pylist(), batch.column("value").to_pylist(), strict=True):
                    if media is None:
                        raise ValueError("a block without media_id has no file")
                    if media != last:
                        if out is not None:
                            out.write("".join(held).encode())
                            out.close()
                        # Every name is quoted, so no id leaves the folder or takes the form of another one's.
                        names = [quote(n, safe=" ").replace(".", "%2E") or NO_NAME for n in media.split("/")]
                        target = f"{root}/{folder}/{'/'.join(names)}{self.ending}"
                        parent = target.rsplit("/", 1)[0]
                        if parent not in made:
                            fs.create_dir(parent, recursive=True)
                            if len(made) >= KNOWN_FOLDERS:
                                made.clear()
                            made.add(parent)
                        out, last, files = fs.open_output_stream(target), media, files + 1
                        held, size = [self.header], 0
                    held += ((value or "").rstrip("\n"), "\n\n")
                    size += len(value or "")
                    if size >= WRITE_CHARS:
                        out.write("".join(held).encode())
                        held, size = [], 0
            if out is not None:
                out.write("".join(held).encode())
        finally:
            if out is not None:
                out.close()
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        number = max((n for n, _ in commits(fs, root)), default=0) + 1
        fs.create_dir(f"{root}/{COMMITS}", recursive=True)
        entry = {"replaces": self.replaces, "folders": sorted(m.folder for m in messages if m is not None and m.files)}
        waiting = f"{root}/{COMMITS}/{number:012d}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(waiting) as f:
            f.write(json.dumps(entry).encode())
        fs.move(waiting, f"{root}/{COMMITS}/{number:012d}.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for m in messages:
            if m is not None and m.files:
                fs.delete_dir(f"{root}/{m.folder}")


class Blocks(DataSource):
    """Options: path, ending (``.srt``), header, maxPartitionBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _ending(self) -> str:
        return self.options.get("ending", ".srt")

    def _limit(self) -> int:
        return int(self.options.get("maxPartitionBytes", PARTITION_BYTES))

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options["path"], self._ending(), self._limit())

    def streamReader(self, schema) -> BlockStream:
        return BlockStream(self.options["path"], self._ending(), self._limit())

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options["path"], self._ending(), self.options.get("header", ""), overwrite)


def read_blocks(spark: SparkSession, path: str, ending: str = ".srt", stream: bool = False, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(Blocks)
    reader = spark.readStream if stream else spark.read
    return reader.format(FORMAT).option("ending", ending).option("maxPartitionBytes", partition_bytes).load(path)


def write_blocks(blocks: DataFrame, path: str, ending: str = ".srt", header: str = "", mode: str = "append", bounded: bool = False) -> None:
    """``blocks``: media_id, ord and value.  Ranges of (media_id, ord) are written by one task each, so a media of any size spreads.

    ``bounded`` says that every media is small: each is then written by one task, and no sample is drawn for ranges.
    """
    blocks.sparkSession.dataSource.register(Blocks)
    rows = blocks.select(F.col("media_id").cast("string").alias("media_id"), F.col("ord").cast("long").alias("ord"), "value")
    placed = (rows.repartition("media_id") if bounded else rows.repartitionByRange("media_id", "ord")).sortWithinPartitions("media_id", "ord")
    placed.write.format(FORMAT).option("ending", ending).option("header", header).mode(mode).save(path)


def relative_id(path: str, ending: str = "") -> Column:
    """Path of a row's file below ``path`` (up to its first wildcard) without ``ending``; the bare name if ``path`` is the file itself."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "", path)
    plain = re.sub(r"/[^/]*[*?\[{].*$", "", plain).rstrip("/")
    here = F.col("_metadata.file_path")
    # A plus stands for itself in a file's address.
    whole = F.url_decode(F.replace(here, F.lit("+"), F.lit("%2B")))
    at = F.locate(f"{plain}/", whole)
    named = F.when(at > 0, F.substr(whole, at + len(plain) + 1)).otherwise(F.substring_index(whole, "/", -1))
    return F.regexp_replace(named, re.escape(ending) + "$", "") if ending else named
