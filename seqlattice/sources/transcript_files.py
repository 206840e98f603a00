"""A data source that writes one text file for each object.

``df.write.format("transcript_files").mode("append").save(folder)`` takes ``base, text`` and writes ``<base>_transcript.txt`` without a line end behind the
text.  Tasks write into folders of their own; the files get their names when all tasks have succeeded, so a task that fails or
runs twice leaves no file behind.  The driver holds one mark for each task, and each task's list of names stays in a
folder ``<folder>.names``, so that reading the files back lists no folder of all objects.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..functions.text import safe_base

NAME = "transcript_files"
SUFFIX = "_transcript.txt"
#: A task's list of names, and what the folder of the lists of all tasks that succeeded has behind the name of the files' folder.
NAMES, LISTS = "names", ".names"
#: Files that get their names at a time, and by how many threads.
PORTION, THREADS = 1000, 16
#: Files that a task reads, and characters of them that it hands on at a time.
FILES_A_TASK, CHARACTERS = 20000, 8_000_000


@dataclass
class Written(WriterCommitMessage):
    mark: str


class Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> Written:
        mark = uuid.uuid4().hex
        own = f"{self.folder}/.{mark}"
        os.makedirs(own)
        try:
            with open(f"{own}/{NAMES}", "w", encoding="utf-8") as names:
                for row in iterator:
                    with open(f"{own}/{row.base}{SUFFIX}", "w", encoding="utf-8", newline="") as f:
                        f.write(row.text or "")
                    names.write(f"{row.base}\n")
        except BaseException:
            shutil.rmtree(own)
            raise
        return Written(mark)

    def _end(self, messages: list[Written | None], each: Callable[[str, str], None]) -> None:
        """``each(path, name)`` of all files of the tasks, many at a time, and then their folders go."""

        with ThreadPoolExecutor(THREADS) as pool:
            for done in filter(None, messages):
                own = f"{self.folder}/.{done.mark}"
                with open(f"{own}/{NAMES}", encoding="utf-8") as names:
                    while some := [name.rstrip("\n") + SUFFIX for name in islice(names, PORTION)]:
                        for _ in pool.map(each, [f"{own}/{name}" for name in some], [f"{self.folder}/{name}" for name in some]):
                            pass

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.folder + LISTS, exist_ok=True)
        self._end(messages, os.replace)
        for done in filter(None, messages):
            os.replace(f"{self.folder}/.{done.mark}/{NAMES}", f"{self.folder}{LISTS}/{done.mark}")
            os.rmdir(f"{self.folder}/.{done.mark}")

    def abort(self, messages: list[Written | None]) -> None:
        self._end(messages, lambda path, _: os.unlink(path))
        for done in filter(None, messages):
            os.unlink(f"{self.folder}/.{done.mark}/{NAMES}")
            os.rmdir(f"{self.folder}/.{done.mark}")


def mounted(folder: str) -> str:
    scheme, colon, rest = folder.partition(":")
    if colon and scheme != "file":
        raise ValueError(f"{folder} is not on a mounted file system")
    return ("/" + rest.lstrip("/") if colon else folder).rstrip("/")


class TranscriptFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "base string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(mounted(self.options["path"]))


def write_transcripts(transcripts: DataFrame, folder: str) -> None:
    """One file for each object of ``base, text``, under the object's name made safe for a path; white space at the end goes.

    Objects whose safe names are equal fail the query; null texts are written as empty ones.  ``folder`` is one that all tasks and the driver share.
    """
    spark = transcripts.sparkSession
    spark.dataSource.register(TranscriptFiles)
    named = transcripts.select(safe_base(F.col("base").cast("string")).alias("base"), F.regexp_replace(F.coalesce("text", F.lit("")), "\\s+$", "").alias("text"))
    once = named.groupBy("base").agg(F.collect_list("text").alias("texts"))
    text = F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("two objects are named "), "base")))
    once.select("base", text.alias("text")).write.format(NAME).mode("append").save(folder)


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, texts, held = [], [], 0
        for name in batch.column("base").to_pylist():
            with open(f"{folder}/{name}{SUFFIX}", encoding="utf-8", newline="") as f:
                texts.append(f.read())
            names.append(name)
            held += len(texts[-1])
            if held > CHARACTERS:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["base", "text"])
                names, texts, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["base", "text"])


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """``base, text`` of the files that :func:`write_transcripts` wrote, by the lists of their names, which are read when this is called."""
    path = mounted(folder)
    lists = spark.read.text(f"file://{os.path.abspath(path)}{LISTS}").withColumnRenamed("value", "base").distinct()
    tasks = max(spark.sparkContext.defaultParallelism, lists.count() // FILES_A_TASK)
    return lists.repartition(tasks, "base").mapInArrow(lambda it: _read(it, path), "base string, text string")
