"""ZIP archives as a table: a row a line of a member, or a row a member.

A partition is a run of members of one archive, of about ``RANGE_BYTES`` compressed bytes. Only the central directory is read to plan them, and not even
that of an archive that is no larger, or where members are only listed; a task opens the archive at the members' places and unpacks them as a stream, so neither an archive nor a member is ever held whole. Files are opened by
Arrow's file systems (local paths, ``file:``, ``hdfs:``, ``s3:`` and so on). Directories in an archive are left out; an encrypted or broken member fails the task.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .trajectories import HEADER_LINES, trajectory_rows

RANGE_BYTES, LINES = 32 << 20, 1 << 16
#: Members of an archive that is written: its directory is held while it is written and whenever it is read.
MEMBERS = 8192
#: An archive without members and without a comment.
EMPTY_BYTES = 22
LINE_SCHEMA = "archive string, member string, line_no long, value string"
MEMBER_SCHEMA = "archive string, member string, size long, compressed long"


def _opened(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return system, path


class _Bytes(io.RawIOBase):
    """An Arrow file as Python's zipfile wants it: a place before the file's begin is an OSError."""

    def __init__(self, raw: pa.NativeFile):
        self.raw = raw

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        to = offset + (0, self.raw.tell(), self.raw.size())[whence]
        if to < 0:
            raise OSError("place before the file's begin")
        return self.raw.seek(to)

    def tell(self) -> int:
        return self.raw.tell()

    def readinto(self, into: memoryview) -> int:
        return self.raw.readinto(into)


@contextmanager
def _archive(uri: str) -> Iterator[zipfile.ZipFile]:
    system, path = _opened(uri)
    with system.open_input_file(path) as raw, zipfile.ZipFile(io.BufferedReader(_Bytes(raw))) as archive:
        yield archive


def archives_under(uri: str) -> list[tuple[str, int]]:
    """The archive itself, or all files under a folder that end in .zip, by name, and their bytes."""
    from pyarrow import fs

    system, path = _opened(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    prefix = uri.rstrip("/").removesuffix(path.rstrip("/"))
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.lower().endswith(".zip"))


@dataclass
class Members(InputPartition):
    archive: str
    first: int
    last: int | None


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.listing = options["path"], options.get("listing", "false").lower() == "true"
        self.suffix, self.range_bytes = options.get("suffix", ""), int(options.get("range_bytes", RANGE_BYTES))

    def _members(self, archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
        return [m for m in archive.infolist() if not m.is_dir() and m.filename.endswith(self.suffix)]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for uri, size in archives_under(self.path):
            if self.listing or size <= self.range_bytes:
                if size > EMPTY_BYTES:
                    out.append(Members(uri, 0, None))
                continue
            with _archive(uri) as archive:
                sizes = [m.compress_size for m in self._members(archive)]
            first = held = 0
            for i, size in enumerate(sizes):
                if held and held + size > self.range_bytes:
                    out.append(Members(uri, first, i))
                    first, held = i, 0
                held += size
            if sizes:
                out.append(Members(uri, first, len(sizes)))
        return out

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        with _archive(partition.archive) as archive:
            own = self._members(archive)[partition.first : partition.last]
            if self.listing:
                names = [m.filename for m in own]
                numbers = [pa.array([getattr(m, x) for m in own], pa.int64()) for x in ("file_size", "compress_size")]
                yield pa.RecordBatch.from_arrays([pa.array([partition.archive] * len(own), pa.string()), pa.array(names, pa.string()), *numbers], names=["archive", "member", "size", "compressed"])
                return
            # Lines of many small members go out together.
            held: list[tuple[str, int, list[str]]] = []
            n = 0
            for m in own:
                with archive.open(m) as stream:
                    at, lines = 0, []
                    for line in io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline=None):
                        lines.append(line.removesuffix("\n"))
                        if n + len(lines) == LINES:
                            yield self._batch(partition.archive, [*held, (m.filename, at, lines)])
                            at, lines, held, n = at + len(lines), [], [], 0
                if lines:
                    held.append((m.filename, at, lines))
                    n += len(lines)
            if held:
                yield self._batch(partition.archive, held)

    @staticmethod
    def _batch(archive: str, held: list[tuple[str, int, list[str]]]) -> pa.RecordBatch:
        """Lines of members, each with the number of its first."""
        members = [name for name, _, lines in held for _ in lines]
        numbers = [k for _, at, lines in held for k in range(at, at + len(lines))]
        values = [v for _, _, lines in held for v in lines]
        columns = [pa.array([archive] * len(values), pa.string()), pa.array(members, pa.string()), pa.array(numbers, pa.int64()), pa.array(values, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["archive", "member", "line_no", "value"])


class ZipMembers(DataSource):
    """Options: path, listing (a row a member), suffix of members, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBER_SCHEMA if self.options.get("listing", "false").lower() == "true" else LINE_SCHEMA

    def reader(self, schema) -> ZipReader:  # noqa: ANN001
        return ZipReader(dict(self.options))


def _source(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").options(**options).load(path)


def member_lines(spark: SparkSession, path: str, suffix: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """archive, member, line_no (from 0), value of every line of the members that end in suffix."""
    return _source(spark, path, suffix=suffix, range_bytes=str(range_bytes))


def _step(member: Column, i: int) -> Column:
    return F.try_element_at(F.split(member, "/"), F.lit(i))


def member_inventory(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, member, size, compressed, and the user and trajectory that the member's path names (the folder two levels up, and the file)."""
    listed = _source(spark, path, listing="true", suffix=suffix)
    return listed.withColumns({"user_id": _step(F.col("member"), -3), "trajectory_id": _step(F.col("member"), -1)})


def read_zip_points(spark: SparkSession, path: str, suffix: str = ".plt", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The points of trajectory files within archives, as read_points() has them of unpacked files."""
    lines = member_lines(spark, path, suffix, range_bytes).where(F.col("line_no") >= HEADER_LINES)
    return trajectory_rows(lines.select("value", F.col("member").alias("file")))


def summarize_trajectories(points: DataFrame) -> DataFrame:
    """A row a trajectory: points, those with valid coordinates, those without a time, different times, first and last time, and the bounds."""
    from ..functions.geo import valid_point

    ok = valid_point(F.col("lat"), F.col("lon"))
    within = lambda f, c: f(F.when(ok, F.col(c)))
    return points.groupBy("user_id", "trajectory_id").agg(
        F.count("*").alias("points"), F.count_if(ok).alias("valid_points"), F.count_if(F.col("ts").isNull()).alias("untimed"), F.count_distinct("ts").alias("different_times"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), within(F.min, "lat").alias("south"), within(F.max, "lat").alias("north"), within(F.min, "lon").alias("west"), within(F.max, "lon").alias("east"),
    )


def write_zip(files: DataFrame, uri: str, members: int = MEMBERS) -> DataFrame:
    """Writes files (member, place, value: the lines of each member by place) as archives of at most ``members`` members under uri, and gives archive and members of each.

    Members are dealt out by name. An archive is written under another name and then renamed, so a task can be run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, root = _opened(uri)
        name, n, stream, current, archive, raw = "", 0, None, None, None, None

        def closed() -> pa.RecordBatch:
            stream.close()
            archive.close()
            raw.close()
            system.move(f"{root}/{name}.part", f"{root}/{name}.zip")
            return pa.RecordBatch.from_arrays([pa.array([f"{uri}/{name}.zip"]), pa.array([n], pa.int64())], names=["archive", "members"])

        for b in batches:
            for member, value in zip(b.column("member").to_pylist(), b.column("value").to_pylist(), strict=True):
                if archive is not None and member != current and n == members:
                    yield closed()
                    archive = None
                if archive is None:
                    system.create_dir(root, recursive=True)
                    name, n, stream, current = uuid.uuid4().hex, 0, None, None
                    raw = system.open_output_stream(f"{root}/{name}.part")
                    archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                if member != current:
                    if stream is not None:
                        stream.close()
                    stream, current, n = archive.open(member, "w"), member, n + 1
                stream.write((value + "\n").encode())
        if archive is not None:
            yield closed()

    return files.select("member", "place", "value").repartition("member").sortWithinPartitions("member", "place").mapInArrow(run, "archive string, members long")
