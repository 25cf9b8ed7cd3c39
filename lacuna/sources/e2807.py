"""Scan files as a Spark source and sink.

``spark.read.format("e2807")`` reads local paths; ``mode`` chooses what: files,
scans, points (default), packets, pages or audit (per scan, the records that
its packets hold and what is wrong with it; never fails). ``fields`` names the point fields to
decode (the API hands no projection to a Python source, so it must be said),
``scan`` one scan of each file, ``records_per_task`` how a scan is split,
``strict`` whether a field that a scan lacks is an error, and ``on_error``
whether a bad file fails the query (FAILFAST) or is left out (PERMISSIVE).

Files in stores that only Spark's readers can open go through ``read_binary``.
"""

from __future__ import annotations

import glob
import json
import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import codec

POINT_FIELDS = ("cartesianX", "cartesianY", "cartesianZ", "sphericalRange", "sphericalAzimuth", "sphericalElevation", "cartesianInvalidState", "sphericalInvalidState", "colorRed", "colorGreen", "colorBlue", "intensity", "rowIndex", "columnIndex")
PROTO = "array<struct<name: string, type: string, minimum: bigint, maximum: bigint, scale: double, offset: double, bits: int>>"
SCHEMAS = {
    "files": "path string, physical_size bigint, logical_size bigint, scan_count int",
    "scans": "path string, scan_index int, guid string, name string, has_pose boolean, q array<double>, t array<double>, record_count bigint, "
    f"proto {PROTO}, has_index_bounds boolean, row_min bigint, row_max bigint, col_min bigint, col_max bigint, has_point_grouping boolean, has_cartesian_bounds boolean, "
    "x_min double, x_max double, y_min double, y_max double, z_min double, z_max double, cv_file_offset bigint",
    "packets": "path string, scan_index int, packet_no bigint, type int, flags int, length bigint, stream_lengths array<bigint>",
    "pages": "path string, page_no bigint, stored bigint, computed bigint",
    "audit": "path string, scan_index int, records bigint, decoded bigint, error string",
}
CHUNK = 65_536
#: Records that a writing task holds back at most, for all of its files.
HELD = 4 * CHUNK


def open_file(path: str) -> codec.Paged:
    if not os.path.exists(path):
        raise codec.FormatError(f"cannot open {path}")
    with open(path, "rb") as f:
        size = os.fstat(f.fileno()).st_size
        if size < codec.PAGE:
            raise codec.FormatError(f"{path} is shorter than a page")
        return codec.Paged(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def scan_row(path: str, i: int, s: codec.Scan) -> tuple:
    proto = [{"name": f.name, "type": f.type, "minimum": f.minimum, "maximum": f.maximum, "scale": f.scale, "offset": f.offset, "bits": f.bits} for f in s.fields]
    return (path, i, s.guid, s.name, s.has_pose, s.q, s.t, s.records, proto, s.index_bounds is not None, *(s.index_bounds or [None] * 4), s.grouping, s.bounds is not None, *(s.bounds or [None] * 6), s.offset)


def point_batches(path: str, index: int, file: codec.Paged, scan: codec.Scan, fields: list[str], low: int, high: int, strict: bool) -> Iterator[pa.RecordBatch]:
    """Arrow batches of some records; a field that the scan lacks is null, or an error if strict."""
    there = {f.name for f in scan.fields}
    missing = [f for f in fields if f not in there]
    if missing and strict:
        raise codec.FormatError(f"no field {missing[0]}")
    parts = codec.located(file, scan, [f for f in fields if f in there]) if low < high else []
    for a in range(low, high, CHUNK):
        b = min(high, a + CHUNK)
        got = codec.decode(file, scan, [f for f in fields if f in there], a, b, parts)
        n = b - a
        columns = [pa.array([path] * n), pa.array(np.full(n, index, np.int32)), pa.array(np.arange(a, b))]
        columns += [pa.array(got[f]) if f in got else pa.nulls(n, pa.float64()) for f in fields]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "scan_index", "record_idx", *fields])


def points_schema(fields: list[str]) -> str:
    return "path string, scan_index int, record_idx bigint" + "".join(f", {f} double" for f in fields)


def audit_rows(path: str) -> Iterator[tuple]:
    """(path, scan, records declared, records there, error) of each scan; one row without a scan for a file that cannot be read."""
    try:
        file = open_file(path)
        scans = codec.catalogue(file)
    except codec.FormatError as e:
        yield path, None, None, None, str(e)
        return
    for i, s in enumerate(scans):
        decoded, error = 0, None
        try:
            found = codec.packets(file, s)
            wanted = [k for k, f in enumerate(s.fields) if f.type != "String"]
            decoded = codec.there(s, found, wanted)
            codec.segments(s, found, wanted)
        except codec.FormatError as e:
            error = str(e)
        yield path, i, s.records, decoded, error


class Part(InputPartition):
    def __init__(self, path: str, scan: int | None = None, low: int = 0, high: int = 0):
        self.path, self.scan, self.low, self.high = path, scan, low, high


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.mode = options.get("mode", "points")
        self.fields = [f.strip() for f in options["fields"].split(",") if f.strip()] if options.get("fields") else list(POINT_FIELDS)
        self.scan = int(options["scan"]) if options.get("scan") else None
        self.step = int(options.get("records_per_task", 2_000_000))
        self.strict = options.get("strict", "false").lower() == "true"
        self.lenient = options.get("on_error", "FAILFAST").upper() == "PERMISSIVE"
        given = json.loads(options["paths"]) if options.get("paths") else [options["path"]]
        self.paths = []
        for path in given:
            path = path.removeprefix("file://")
            found = sorted(glob.glob(os.path.join(path, "*.e57")) if os.path.isdir(path) else glob.glob(path))
            if not found and not self.lenient:
                raise codec.FormatError(f"cannot open {path}")
            self.paths += found

    def partitions(self) -> list[Part]:
        if self.mode != "points":
            return [Part(p) for p in self.paths] or [Part("")]
        parts = []
        for path in self.paths:
            try:
                scans = codec.catalogue(open_file(path))
            except codec.FormatError:
                if self.lenient:
                    continue
                raise
            if self.scan is not None and self.scan >= len(scans) and not self.lenient:
                raise codec.FormatError("scan index out of range")
            for i, s in enumerate(scans):
                if self.scan in (None, i):
                    parts += [Part(path, i, a, min(s.records, a + self.step)) for a in range(0, s.records, self.step)]
        return parts or [Part("")]

    def read(self, part: Part):
        if not part.path:
            return
        if self.mode == "audit":
            yield from audit_rows(part.path)
            return
        try:
            file = open_file(part.path)
            if self.mode == "pages":
                for n, (a, b) in enumerate(zip(*(x.tolist() for x in codec.pages(file.raw)))):
                    yield part.path, n, a, b
                return
            scans = codec.catalogue(file)
            if self.mode == "files":
                yield part.path, len(file.raw), file.logical_size, len(scans)
            elif self.mode == "scans":
                for i, s in enumerate(scans):
                    yield scan_row(part.path, i, s)
            elif self.mode == "packets":
                for i, s in enumerate(scans):
                    for n, p in enumerate(codec.packets(file, s)):
                        yield part.path, i, n, p.type, p.flags, p.size, [size for _, size in p.streams]
            else:
                yield from point_batches(part.path, part.scan, file, scans[part.scan], self.fields, part.low, part.high, self.strict)
        except codec.FormatError:
            if not self.lenient:
                raise


class Growing:
    """A file under a hidden name, and its records that are not yet written."""

    def __init__(self, path: str, file: codec.ScanFile):
        self.path, self.file = path, file
        self.tables: list[pa.Table] = []
        self.waiting = 0

    def take(self, table: pa.Table) -> None:
        self.tables.append(table)
        self.waiting += table.num_rows

    def flush(self, unit: int) -> int:
        """Writes a multiple of so many records; how many."""
        n = self.waiting // unit * unit
        if n:
            table, self.waiting = pa.concat_tables(self.tables), self.waiting - n
            self.file.add([table.column(f.name)[:n].to_numpy() for f in self.file.scan.fields], n)
            # Copied, since a slice would keep all of the table.
            self.tables = [table.take(pa.array(np.arange(n, table.num_rows)))]
        return n


class Writer(DataSourceArrowWriter):
    """One file of one scan for each task, or for each value of the column ``key`` in a task.

    ``prototype`` (JSON list of fields) says how columns are packed; ``scans``
    (JSON, by key) what a scan's catalogue entry holds, its own fields included.
    Records go to their file as they come, so that a task's memory does not grow
    with its scans; files get their names when the task has all of its rows.
    """

    def __init__(self, options: dict, columns: list[str]):
        self.path = options["path"].removeprefix("file://")
        self.key = options.get("key")
        self.headers = json.loads(options.get("scans", "{}"))
        given = json.loads(options.get("prototype", "[]"))
        self.fields = [codec.Field(**f) for f in given] or [codec.Field(c) for c in columns if c != self.key]
        self.per_packet = int(options.get("records_per_packet", 512))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files: dict = {}
        # Of packets that end at a whole byte of every field.
        unit, held = max(1, CHUNK // (8 * self.per_packet)) * 8 * self.per_packet, 0
        try:
            for table in (pa.Table.from_batches([b]) for b in batches if b.num_rows):
                for key, part in self.by_key(table):
                    if key not in files:
                        files[key] = self.begin(key)
                    files[key].take(part)
                    held += part.num_rows - files[key].flush(unit)
                if held > HELD:
                    held -= sum(f.flush(8) for f in files.values())
            for f in files.values():
                f.flush(1)
                f.file.close()
            for f in files.values():
                os.replace(f.file.path, f.path)
        finally:
            for f in files.values():
                if os.path.exists(f.file.path):
                    os.remove(f.file.path)
        return WriterCommitMessage()

    def by_key(self, table: pa.Table) -> Iterator[tuple]:
        if not self.key:
            yield None, table
            return
        column = table.column(self.key)
        found = column.unique().to_pylist()
        for key in found:
            own = pa.compute.is_null(column) if key is None else pa.compute.equal(column, key)
            yield key, table if len(found) == 1 else table.filter(own)

    def begin(self, key) -> Growing:
        os.makedirs(self.path, exist_ok=True)
        own = dict(self.headers.get(str(key), {}))
        fields = [codec.Field(**f) for f in own.pop("fields")] if "fields" in own else self.fields
        unique = uuid.uuid4().hex
        scan = codec.Scan(fields, 0, 0, **({"guid": "{" + unique + "}", "name": unique} | own))
        file = codec.ScanFile(os.path.join(self.path, f".{unique}.tmp"), scan, self.per_packet)
        return Growing(os.path.join(self.path, f"part-{'' if key is None else f'{key:08d}-'}{unique}.e57"), file)


class E2807(DataSource):
    @classmethod
    def name(cls) -> str:
        return "e2807"

    def schema(self) -> str:
        mode = self.options.get("mode", "points")
        if mode == "points":
            return points_schema([f.strip() for f in self.options["fields"].split(",") if f.strip()] if self.options.get("fields") else list(POINT_FIELDS))
        if mode not in SCHEMAS:
            raise ValueError(f"unknown mode {mode}")
        return SCHEMAS[mode]

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(E2807)


def read_binary(files: DataFrame, fields: list[str], strict: bool = False) -> DataFrame:
    """Points of the files that ``spark.read.format("binaryFile")`` read, from any store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                file = codec.Paged(content.as_buffer())
                for i, s in enumerate(codec.catalogue(file)):
                    yield from point_batches(path, i, file, s, fields, 0, s.records, strict)

    return files.select("path", "content").mapInArrow(run, points_schema(fields))


def proto_json(fields: list[codec.Field]) -> str:
    return json.dumps([asdict(f) for f in fields])
