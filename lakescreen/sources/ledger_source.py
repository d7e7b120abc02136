"""The ledger as a data source of Spark: ``format("ledger")`` reads, appends and commits entries of a folder.

Each task writes one file beside the ledger and tells its name, its number of entries and the range of their keys. The commit names the files of all
tasks in one manifest, which is renamed into place; until then nothing is seen. An abort removes what tasks have written. A reader has a
partition for each committed file and leaves out files whose range cannot hold the key that is asked for.

Only folders are supported as a backend; paths may be of any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators import audit

SCHEMA = "ledger STRING, sequence BIGINT, screening_id STRING, result_hash STRING, prev_entry_hash STRING, entry_hash STRING"
KEY = "screening_id"
_ROWS = 1 << 16  # entries that a writer holds before it sends them to its file
_ARROW = pa.schema([("ledger", pa.string()), ("sequence", pa.int64()), (KEY, pa.string()), ("result_hash", pa.string()), ("prev_entry_hash", pa.string()), ("entry_hash", pa.string())])


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:") and "://" not in path:  # as Hadoop writes it
        path = path.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def _committed(path: str) -> list[dict]:
    """Files of all manifests: name, entries, least and greatest key."""
    fs, root = _open(path)
    out = []
    for info in sorted(fs.get_file_info(pa.fs.FileSelector(f"{root}/commits", allow_not_found=True)), key=lambda i: i.path):
        if info.path.endswith(".json"):
            with fs.open_input_stream(info.path) as f:
                out += json.loads(f.read())
    return out


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    entries: int = 0
    low: str | None = None
    high: str | None = None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _open(self.path)
        told, out, held = _Written(None), None, []

        def send() -> None:
            out.write_table(pa.Table.from_batches(held).select(_ARROW.names).cast(_ARROW))
            held.clear()

        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    fs.create_dir(f"{root}/entries")
                    told.file = f"{uuid.uuid4().hex}.parquet"
                    out = pa.parquet.ParquetWriter(f"{root}/entries/{told.file}", _ARROW, filesystem=fs)
                held.append(batch)
                told.entries += batch.num_rows
                ends = pa.compute.min_max(batch.column(batch.schema.get_field_index(KEY)).cast(pa.string())).as_py()
                if ends["min"] is not None:
                    told.low = ends["min"] if told.low is None else min(told.low, ends["min"])
                    told.high = ends["max"] if told.high is None else max(told.high, ends["max"])
                if sum(b.num_rows for b in held) >= _ROWS:
                    send()
            if held:
                send()
        finally:
            if out is not None:
                out.close()
        return told

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/commits")
        told = [{"file": m.file, "entries": m.entries, "low": m.low, "high": m.high} for m in messages if m and m.file]
        name = f"{root}/commits/{time.time_ns():020d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps(told).encode())
        fs.move(f"{name}.part", f"{name}.json")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{root}/entries/{m.file}")


@dataclass
class _File(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.key = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (KEY,):
                self.key = f.value
            yield f  # files are left out by their range; rows are still told apart by Spark

    def partitions(self) -> list[_File]:
        files = _committed(self.path)
        if self.key is not None:
            files = [f for f in files if f["low"] is not None and f["low"] <= self.key <= f["high"]]
        return [_File(f["file"]) for f in files] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.name:
            fs, root = _open(self.path)
            yield from pa.parquet.ParquetFile(fs.open_input_file(f"{root}/entries/{partition.name}")).iter_batches()


class LedgerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a ledger is appended to, never overwritten")
        found = audit.FORBIDDEN & {n.lower() for n in schema.names}
        if found:
            raise ValueError(f"not for the ledger: {', '.join(sorted(found))}")
        return _Writer(self.options["path"])


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a ledger's folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LedgerSource)
    return spark.read.format("ledger").load(path)


def append(records: DataFrame, path: str, ledger: str, order: list[str], columns: list[str]) -> None:
    """Chain records after what their ledgers hold and append them. Records that a ledger holds, by screening_id and result_hash, are not
    chained again; those without an id fail and are not written (see ``statuses``)."""
    held = entries(records.sparkSession, path)
    same = [KEY, "result_hash"]
    new = records.dropDuplicates(same).join(held.select(*same), same, "left_anti")
    tails = held.groupBy("ledger").agg(F.max("sequence").alias("start_sequence"), F.max_by("entry_hash", "sequence").alias("start_hash"))
    chained = audit.record_chain(new, ledger, order, columns, keep=("result_hash",), start=tails)
    logged = chained.where("ledger_status = 'logged'").select(F.col("ledger").cast("string").alias("ledger"), "sequence", KEY, "result_hash", "prev_entry_hash", "entry_hash")
    logged.write.format("ledger").mode("append").save(path)


def statuses(records: DataFrame, path: str) -> DataFrame:
    """records with ledger_status: logged if a ledger holds the record, failed if it has no id, else absent."""
    same = [KEY, "result_hash"]
    held = entries(records.sparkSession, path).select(*same).distinct().withColumn("_held", F.lit(True))
    status = F.when(F.coalesce(F.col(KEY), F.lit("")) == "", "failed").when(F.col("_held"), "logged").otherwise("absent")
    return records.join(held, same, "left").withColumn("ledger_status", status).drop("_held")
