"""File sinks with a commit: GeoParquet parts with their footer, and one GeoJSON document.

Tasks write below a staging folder inside the target and report what they wrote. The commit moves the reported
files to their place (or joins them to one document) and removes the staging folder, so the parts of killed or
repeated tasks never show; an abort leaves the target as it was.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

CHUNK = 1 << 20  # bytes of a document moved at a time
STAGING = "_staging-"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    task: str
    rows: int


def polygon_bounds(wkb: bytes) -> tuple[float, float, float, float]:
    """Bounds of the outer ring of a little-endian polygon."""
    n = struct.unpack_from("<I", wkb, 9)[0]
    points = np.frombuffer(wkb, "<f8", 2 * n, 13).reshape(-1, 2)
    return (*points.min(0).tolist(), *points.max(0).tolist())


def footer(srid: int, bounds: list[float] | None) -> bytes:
    """Column description of GeoParquet 1.1."""
    column = {
        "encoding": "WKB", "geometry_types": ["Polygon"],
        "crs": {"type": "GeographicCRS" if srid == 4326 else "ProjectedCRS", "name": f"EPSG:{srid}", "id": {"authority": "EPSG", "code": srid}},
    }
    if bounds:
        column["bbox"] = bounds
    return json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}}).encode()


class StagedWriter(DataSourceArrowWriter):
    """Parts below a staging folder; subclasses write a part and finish the job."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.options, self.overwrite = options["path"].rstrip("/"), dict(options), overwrite
        self.job = uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{opened(self.path)[1]}/{STAGING}{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = opened(self.path)[0]
        files.create_dir(self.staging, recursive=True)
        task = uuid.uuid4().hex
        return Written(task, self.part(files, f"{self.staging}/{task}", iterator))

    def commit(self, messages: list[Written | None]) -> None:
        files = opened(self.path)[0]
        files.create_dir(self.staging, recursive=True)
        self.finish(files, opened(self.path)[1], [m for m in messages if m is not None and m.rows])
        files.delete_dir(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        files = opened(self.path)[0]
        if files.get_file_info(self.staging).type == fs.FileType.Directory:
            files.delete_dir(self.staging)


class GeoParquetWriter(StagedWriter):
    def part(self, files: fs.FileSystem, path: str, batches: Iterator[pa.RecordBatch]) -> int:
        writer, rows, bounds = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or pq.ParquetWriter(path, batch.schema, filesystem=files)
            writer.write_batch(batch)
            rows += batch.num_rows
            own = np.array([polygon_bounds(g.as_py()) for g in batch.column("geometry") if g.is_valid])
            if len(own):
                both = np.vstack([own, *([bounds] if bounds is not None else [])])
                bounds = np.concatenate((both[:, :2].min(0), both[:, 2:].max(0)))
        if writer:
            writer.add_key_value_metadata({"geo": footer(int(self.options.get("srid", 4326)), None if bounds is None else bounds.tolist()).decode()})
            writer.close()
        return rows

    def finish(self, files: fs.FileSystem, target: str, parts: list[Written]) -> None:
        old = [f.path for f in files.get_file_info(fs.FileSelector(target)) if f.base_name.startswith("part-")] if self.overwrite else []
        for i, part in enumerate(parts):
            files.move(f"{self.staging}/{part.task}", f"{target}/part-{i:05d}-{self.job}.parquet")
        for path in old:
            files.delete_file(path)


class GeoJsonWriter(StagedWriter):
    """Column ``value`` holds features as JSON text; all become one FeatureCollection in ``path``/fields.geojson."""

    def part(self, files: fs.FileSystem, path: str, batches: Iterator[pa.RecordBatch]) -> int:
        rows = 0
        with files.open_output_stream(path) as out:
            for batch in batches:
                texts = batch.column("value").to_pylist()
                if texts:
                    out.write(((",\n" if rows else "") + ",\n".join(texts)).encode())
                    rows += len(texts)
        return rows

    def finish(self, files: fs.FileSystem, target: str, parts: list[Written]) -> None:
        # one file has one writer: the parts pass through it in small pieces
        with files.open_output_stream(f"{self.staging}/document") as out:
            out.write(b'{"type":"FeatureCollection","features":[\n')
            for i, part in enumerate(parts):
                out.write(b",\n" if i else b"")
                with files.open_input_stream(f"{self.staging}/{part.task}") as own:
                    while piece := own.read(CHUNK):
                        out.write(piece)
            out.write(b"\n]}\n")
        files.move(f"{self.staging}/document", f"{target}/fields.geojson")


class GeoParquet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "furrow_geoparquet"

    def writer(self, schema, overwrite: bool) -> GeoParquetWriter:
        return GeoParquetWriter(self.options, overwrite)


class GeoJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "furrow_geojson"

    def writer(self, schema, overwrite: bool) -> GeoJsonWriter:
        return GeoJsonWriter(self.options, overwrite)


def exists(path: str) -> bool:
    files, target = opened(path)
    return files.get_file_info(target).type != fs.FileType.NotFound


def save(rows: DataFrame, source: type[DataSource], path: str, overwrite: bool = False, **options: str) -> bool:
    """Write through a source; existing output is replaced when asked, else kept. True if something was written."""
    if exists(path) and not overwrite:
        return False
    import furrow.sinks.geo as own

    register_pickle_by_value(own)
    rows.sparkSession.dataSource.register(source)
    rows.write.format(source.name()).options(**options).mode("overwrite" if overwrite else "append").save(path)
    return True
