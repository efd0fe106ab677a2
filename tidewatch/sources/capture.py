"""Captured packets as a Spark data source.

A capture is a folder of text files, one JSON record a line, as a capture
process writes them::

    {"id": 7, "time": 1704067200.25, "proto": "TCP", "len": 60, "src": "10.0.0.1", "dst": "10.0.0.2", "sport": 4242, "dport": 80}

``time`` (epoch seconds), ``proto`` and ``len`` are required; ``src`` and
``dst`` are there for IP packets, ports for TCP and UDP. Every line is checked
and none is lost: a line that isn't such a record becomes a row with the line
in ``rejected`` and the reason in ``reason``, all packet columns NULL. Blank
lines are no records.

``spark.read.format("capture")`` and ``spark.readStream.format("capture")``
read the same way. Files are listed on the driver by name only and read by the
tasks, in ranges of ``splitBytes``; a line belongs to the range in which it
begins. A stream's offset is the name of the last file taken: files have names
that grow, as rotating captures have, and are complete when they get their
name. ``maxFilesPerTrigger`` bounds a micro-batch. Names that begin with ``_``
or ``.`` are not read. Paths may be of any store that pyarrow can open.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = ("event_id bigint, ts timestamp, proto string, length double, src string, dst string, sport int, dport int, "
          "rejected string, reason string")
_ARROW = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("proto", pa.string()), ("length", pa.float64()),
                    ("src", pa.string()), ("dst", pa.string()), ("sport", pa.int32()), ("dport", pa.int32()),
                    ("rejected", pa.string()), ("reason", pa.string())])
PROTOCOLS = ("TCP", "UDP", "ARP", "DNS", "OTHER")
SPLIT_BYTES = 64 << 20
#: Rows of one Arrow batch, and bytes read at a time.
BATCH_ROWS, CHUNK = 8192, 1 << 20


class BadRecord(ValueError):
    pass


def _number(record: dict, key: str, least: float, most: float, whole: bool = False):
    v = record.get(key)
    if v is None:
        return None
    if isinstance(v, bool) or not isinstance(v, int if whole else (int, float)) or not least <= v <= most:
        raise BadRecord(f"bad {key}")
    return v


def _text(record: dict, key: str) -> str | None:
    v = record.get(key)
    if v is not None and not isinstance(v, str):
        raise BadRecord(f"bad {key}")
    return v


def parse(line: str) -> tuple:
    """The packet columns of a line; raises :class:`BadRecord`."""
    try:
        r = json.loads(line)
    except ValueError:
        raise BadRecord("not JSON") from None
    if not isinstance(r, dict):
        raise BadRecord("not a record")
    for key in ("time", "proto", "len"):
        if r.get(key) is None:
            raise BadRecord(f"no {key}")
    if r["proto"] not in PROTOCOLS:
        raise BadRecord("bad proto")
    time = _number(r, "time", 0, 253402300799)
    micros = math.floor(time) * 1_000_000 + round((time - math.floor(time)) * 1e6)
    return (_number(r, "id", -(1 << 63), (1 << 63) - 1, True), micros, r["proto"], float(_number(r, "len", 0, 1e18)),
            _text(r, "src"), _text(r, "dst"), _number(r, "sport", 0, 65535, True), _number(r, "dport", 0, 65535, True))


def batches(lines: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for raw in lines:
        line = raw.decode("utf-8", "replace").strip()
        if not line:
            continue
        try:
            rows.append((*parse(line), None, None))
        except BadRecord as e:
            rows.append((*[None] * 8, line, str(e)))
        if len(rows) == BATCH_ROWS:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def lines_of(file, start: int, end: int) -> Iterator[bytes]:
    """Lines that begin in ``[start, end)``: the one under way at ``start`` is
    the range's before, the one under way at ``end`` is read to its end."""
    at = max(0, start - 1)
    file.seek(at)
    rest, skip = b"", start > 0
    while True:
        chunk = file.read(CHUNK)
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            began, at = at, at + len(line) + 1
            if skip:
                skip = False
            elif began < end:
                yield line
            if at >= end:
                return
        if not chunk:
            if rest and not skip and at < end:
                yield rest
            return


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int


class _Files:
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        if "path" not in self.options:
            raise ValueError("capture: no path")
        self.path, self.split = self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES))

    def store(self):
        return pafs.FileSystem.from_uri(self.path) if ":/" in self.path else (pafs.LocalFileSystem(), self.path)

    def listed(self) -> list[tuple[str, str, int]]:
        """(name, path, bytes) of the capture's files by name."""
        fs, path = self.store()
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return sorted((f.base_name, f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "_.")

    def ranges(self, after: str = "", upto: str | None = None) -> list[FileRange]:
        return [FileRange(path, at, min(size, at + self.split)) for name, path, size in self.listed()
                if name > after and (upto is None or name <= upto) for at in range(0, size, self.split)]

    def read(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        fs, _ = self.store()
        with fs.open_input_file(part.path) as f:
            yield from batches(lines_of(f, part.start, part.end))


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def partitions(self):
        return self.files.ranges() or [FileRange("", 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from self.files.read(partition)


class CaptureStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = _Files(options)
        self.most = int(self.files.options.get("maxfilespertrigger", 0))
        self.given = ""

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        names = [n for n, _, _ in self.files.listed() if n > self.given]
        if names:
            self.given = names[min(self.most, len(names)) - 1] if self.most else names[-1]
        return {"file": self.given}

    def partitions(self, start: dict, end: dict):
        # a restarted stream learns here how far the one before it came
        self.given = max(self.given, end["file"])
        return self.files.ranges(start["file"], end["file"]) or [FileRange("", 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from self.files.read(partition)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return CaptureReader(dict(self.options))

    def streamReader(self, schema):
        return CaptureStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)


def read_capture(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("capture").options(**options).load(path)


def capture_stream(spark: SparkSession, path: str, watermark: str | None = "1 hour", **options) -> DataFrame:
    register(spark)
    x = spark.readStream.format("capture").options(**options).load(path)
    return x.withWatermark("ts", watermark) if watermark else x


def write_capture(packets: DataFrame, path: str) -> None:
    """Packets (``event_id, ts, proto, length`` and, where there, ``src, dst,
    sport, dport``) as capture files."""
    packets.select(record_line(packets).alias("value")).write.text(path)


def record_line(packets: DataFrame) -> Column:
    """A packet as a line of a capture."""
    at = lambda c, t: F.col(c).cast(t) if c in packets.columns else F.lit(None).cast(t)
    record = F.struct(F.col("event_id").alias("id"), (F.unix_micros("ts").cast("decimal(20,0)") / 1_000_000).cast("decimal(20,6)").alias("time"), "proto",
                      F.col("length").cast("double").alias("len"), at("src", "string").alias("src"), at("dst", "string").alias("dst"),
                      at("sport", "int").alias("sport"), at("dport", "int").alias("dport"))
    return F.to_json(record)
