"""Landing places: where a job keeps files of its own, and documents written one to a file."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that a cluster shares; on one machine a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/landed/{name}-{uuid.uuid4().hex}"


def land_documents(documents: DataFrame, text: Column, name: str) -> str:
    """Write each row's text as a file of its own; returns the folder."""
    path = work_path(documents.sparkSession, name)
    documents.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def open_place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it, for tasks."""
    return fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


def land_files(documents: DataFrame, text: Column, name: str) -> list[str]:
    """Write each row's text and a line feed as a file of its own, for very many rows; returns the folders.

    Tasks write by themselves, as Spark's writer opens, renames and lists files one
    by one. Each attempt has a folder, and only those of successful ones are named.
    """
    path = work_path(documents.sparkSession, name)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, n = f"{path}/{uuid.uuid4().hex}", 0
        system, place = open_place(folder)
        system.create_dir(place, recursive=True)
        for batch in batches:
            for value in batch.column(0):
                with system.open_output_stream(f"{place}/{n}") as file:
                    file.write((value.as_py() + "\n").encode())
                n += 1
        yield pa.record_batch({"folder": [folder]})

    return [r.folder for r in documents.select(text.alias("value")).mapInArrow(write, "folder string").collect()]
