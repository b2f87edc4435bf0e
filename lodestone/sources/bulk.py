"""A sink that commits all tasks' files or none: a Python data source whose tasks stage and whose driver verifies and publishes.

    spark.dataSource.register(BulkSink)
    df.write.format("lodestone_bulk").option("path", uri).mode("append").save()

Each task writes one Parquet file into a staging folder of its own job and sends its name, rows and digest; names hold a random part, so a
task that ran twice leaves a file that nobody commits. The driver reads each named file back, compares, moves it beside the published ones
and then writes the list of them. A failed task, or a file that isn't what was sent, leaves nothing published.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def _storage(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _digest(table: pa.Table) -> str:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return xxhash.xxh3_128_hexdigest(sink.getvalue())


@dataclass
class Staged(WriterCommitMessage):
    name: str
    rows: int
    digest: str


class BulkSink(DataSource):
    """Options: path; most_rows (rows a file may hold, more is an error of its task)."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_bulk"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("published files are never overwritten")
        return BulkWriter(self.options["path"], int(self.options.get("most_rows", 10_000_000)))


class BulkWriter(DataSourceArrowWriter):
    def __init__(self, path: str, most_rows: int):
        self.path, self.most_rows, self.job = path.rstrip("/"), most_rows, uuid.uuid4().hex

    def _staging(self) -> tuple[pafs.FileSystem, str]:
        fs, at = _storage(self.path)
        return fs, f"{at}/_staging-{self.job}"

    def write(self, iterator) -> Staged:
        fs, at = self._staging()
        fs.create_dir(at, recursive=True)
        name, rows, parts, out = f"part-{uuid.uuid4().hex}.parquet", 0, [], None
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            rows += len(batch)
            if rows > self.most_rows:
                raise ValueError(f"more than {self.most_rows} rows in one file")
            if out is None:
                out = pq.ParquetWriter(f"{at}/{name}", table.schema, filesystem=fs)
            out.write_table(table)
            parts.append(_digest(pq.ParquetFile(pa.BufferReader(_one_file(table))).read()))
        if out is not None:
            out.close()
        return Staged(name if rows else "", rows, json.dumps(parts))

    def commit(self, messages: list[Staged]) -> None:
        fs, at = self._staging()
        kept = [m for m in messages if m is not None and m.name]
        for m in kept:
            groups = pq.ParquetFile(f"{at}/{m.name}", filesystem=fs)
            read = [_digest(groups.read_row_group(i)) for i in range(groups.num_row_groups)]
            if groups.metadata.num_rows != m.rows or json.dumps(read) != m.digest:
                self.abort(messages)
                raise ValueError(f"{m.name} isn't what its task wrote")
        base = _storage(self.path)[1]
        for m in kept:
            fs.move(f"{at}/{m.name}", f"{base}/{m.name}")
        with fs.open_output_stream(f"{base}/_published-{self.job}.json") as out:
            out.write(json.dumps([{"name": m.name, "rows": m.rows} for m in kept]).encode())
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, at = self._staging()
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)


def _one_file(table: pa.Table) -> pa.Buffer:
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink)
    return sink.getvalue()


def published(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of every published list; files without a list, moved by a driver that was lost on the way, don't count."""
    fs, at = _storage(path)
    infos = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    names = []
    for info in infos:
        if info.base_name.startswith("_published-"):
            with fs.open_input_stream(info.path) as f:
                names += [f"{path.rstrip('/')}/{x['name']}" for x in json.loads(f.read())]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
