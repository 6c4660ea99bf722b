"""One file for each row, as a data source: ``df.write.format("page_files").mode("append").save(folder)``.

Rows have a path, relative to the folder, and a text; a file without text is one line end. Each task writes into a folder of its own beside the files; when all
have succeeded the files are moved to their places, and when the job fails they are deleted, so that it leaves either all
of its files or none and can be run again. Paths come from :func:`settled_paths`, which avoids files that exist.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.links import output_path

PENDING = "_pending"


@dataclass
class Written(WriterCommitMessage):
    """A task's files: where they are, and their paths."""

    folder: str
    paths: list[str]


def _opened(folder: str):
    found, path = FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (LocalFileSystem(), folder)
    return found, path.rstrip("/")


class PageFilesWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = _opened(self.folder)
        own, paths = f"{root}/{PENDING}/{self.job}/{uuid.uuid4().hex}", []
        for row in iterator:
            path = row["path"]
            if not path or path.startswith("/") or ".." in path.split("/"):
                raise ValueError(f"not a path inside the folder: {path!r}")
            files.create_dir(f"{own}/{path}".rpartition("/")[0], recursive=True)
            with files.open_output_stream(f"{own}/{path}") as out:
                out.write((row["text"] or "\n").encode())  # readers of folders pass over files of no bytes
            paths.append(path)
        # a task that outlives its job cleans up after itself
        if files.get_file_info(self._stopped(root)).type == FileType.File:
            files.delete_dir(own)
            raise RuntimeError("the job was aborted")
        return Written(own, paths)

    def _stopped(self, root: str) -> str:
        return f"{root}/{PENDING}/{self.job}.aborted"

    def _sweep(self, files, root: str) -> None:
        if files.get_file_info(f"{root}/{PENDING}/{self.job}").type != FileType.NotFound:
            files.delete_dir(f"{root}/{PENDING}/{self.job}")

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.folder)
        moved = [(m.folder, path) for m in messages if m is not None for path in m.paths]
        targets = [f"{root}/{path}" for _, path in moved]
        clash = len(targets) != len(set(targets))
        if not clash and not self.overwrite:
            clash = any(f.type != FileType.NotFound for i in range(0, len(targets), 1000) for f in files.get_file_info(targets[i : i + 1000]))
        if clash:  # Spark aborts the job then
            raise ValueError("paths repeat, or files exist; see settled_paths")
        for (own, path), target in zip(moved, targets, strict=True):
            files.create_dir(target.rpartition("/")[0], recursive=True)
            files.move(f"{own}/{path}", target)
        self._sweep(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        """Delete what is pending of this job; the mark is for tasks that still run."""
        files, root = _opened(self.folder)
        files.create_dir(f"{root}/{PENDING}", recursive=True)
        files.open_output_stream(self._stopped(root)).close()
        self._sweep(files, root)


class PageFiles(DataSource):
    """The data source ``page_files``; it writes only."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PageFilesWriter(self.options["path"], overwrite)


def settled_paths(pages: DataFrame, taken: DataFrame | None = None, source_col: str = "url") -> DataFrame:
    """Adds ``path``: the file name that a page's text goes by, or the next one that is free.

    Pages of one name get it in the order of their source, as name, name_1, name_2 and so on, leaving out those in
    ``taken`` (column path).
    """
    base, ending = F.regexp_replace("_name", r"\.[^.]*$", ""), F.regexp_extract("_name", r"\.[^.]*$", 0)
    named = pages.withColumn("_name", output_path(source_col)).withColumn("_k", F.row_number().over(Window.partitionBy("_name").orderBy(source_col)) - 1)
    if taken is None:
        number = F.col("_k")
    else:
        whole = taken.select(F.col("path").alias("_name"), F.lit(0).alias("_n"))
        more = taken.select(F.regexp_replace("path", r"_[1-9][0-9]{0,8}(\.[^.]*)?$", "$1").alias("_name"), F.regexp_extract("path", r"_([1-9][0-9]{0,8})(?:\.[^.]*)?$", 1).alias("_n"))
        used = whole.unionByName(more.where("_n != ''").withColumn("_n", F.col("_n").cast("int"))).groupBy("_name").agg(F.collect_set("_n").alias("_used"))
        named = named.join(used, "_name", "left")
        free = F.filter(F.sequence(F.lit(0), F.col("_k") + F.size("_used")), lambda n: ~F.array_contains("_used", n))
        number = F.when(F.col("_used").isNull(), F.col("_k")).otherwise(F.get(free, F.col("_k")))
    named = named.withColumn("_at", number)
    path = F.when(F.col("_at") == 0, F.col("_name")).otherwise(F.concat(base, F.lit("_"), F.col("_at"), ending))
    return named.withColumn("path", path).drop("_name", "_k", "_at", "_used")


def existing_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the files in a folder, relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return found.select(F.regexp_extract("path", rf"^.*?{'/'.join(folder.rstrip('/').rpartition('://')[2].split('/'))}/(.*)$", 1).alias("path")).where(~F.col("path").startswith(PENDING))


def write_files(pages: DataFrame, folder: str, path_col: str = "path", text_col: str = "markdown", mode: str = "append") -> None:
    spark = pages.sparkSession
    spark.dataSource.register(PageFiles)
    pages.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")).write.format("page_files").mode(mode).save(folder)
