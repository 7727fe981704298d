"""Tables in the folder that the driver and all executors share.

Long plans are cut by writing a Parquet table there, so a lost executor costs
a task and not the lineage behind it.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_open_scopes: list[list[str]] = []
_tables: dict[str, str] = {}  # names in the catalog of tables in buckets, by path
_of_session: dict[str, SparkSession] = {}  # tables to delete when this process ends


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where it is unset and all runs on one machine."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(known)
        known = context.getCheckpointDir()
    return known.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def passing_path(spark: SparkSession, name: str) -> str:
    """A new path for what nobody needs once this process ends, when it is deleted, or at the end of a surrounding ``scratch``."""
    path = new_path(spark, name)
    for written in _open_scopes:
        written.append(path)
    _of_session[path] = spark
    return path


@atexit.register
def delete_passing() -> None:
    """Delete all passing tables; a session that has already lost its JVM leaves them."""
    for path, spark in list(_of_session.items()):
        with suppress(Exception):
            delete(spark, path)


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _located(spark, path)
    return system.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    system, where = _located(spark, path)
    system.delete(where, True)
    _of_session.pop(path, None)
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")


def folders(spark: SparkSession, path: str, depth: int) -> list[str]:
    """Paths of the folders ``depth`` levels below ``path``."""
    system, where = _located(spark, path)
    found = [where] if system.exists(where) else []
    for _ in range(depth):
        found = [status.getPath() for folder in found for status in system.listStatus(folder) if status.isDirectory()]
    return [folder.toString() for folder in found]


class Manifest:
    """Numbered entries in a shared folder, each a small JSON file that is created once and never changed.

    Creating the file claims its number, so of two writers one takes the next. A
    file that its writer did not finish is no entry. The driver reads them all:
    one for each batch or run.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self) -> list[tuple[int, dict]]:
        system, where = _located(self.spark, self.path)
        if not system.exists(where):
            return []
        found = []
        for status in system.listStatus(where):
            number = status.getPath().getName().partition(".")[0]
            stream = system.open(status.getPath())
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if number.isdigit() and text.endswith("\n"):
                found.append((int(number), json.loads(text)))
        return sorted(found, key=lambda x: x[0])

    def entries(self) -> list[dict]:
        return [entry for _, entry in self._read()]

    def commit(self, entry: dict) -> int:
        """Add an entry and return its number; numbers grow, with gaps where a writer failed."""
        system, where = _located(self.spark, self.path)
        names = [status.getPath().getName() for status in system.listStatus(where)] if system.exists(where) else []
        number = max((int(name.partition(".")[0]) for name in names if name[0].isdigit()), default=-1) + 1
        while True:
            try:
                stream = system.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{number:012d}.json"), False)
                break
            except Exception as taken:
                if "FileAlreadyExists" not in str(taken):
                    raise
                number += 1
        try:
            stream.write(bytearray((json.dumps(entry) + "\n").encode()))
        finally:
            stream.close()
        return number


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete all shared tables written inside, when their last reader is done: write what is to stay elsewhere first."""
    written: list[str] = []
    _open_scopes.append(written)
    try:
        yield
    finally:
        _open_scopes.remove(written)
        for path in written:
            delete(spark, path)


class SharedTables:
    """Intermediate tables of one run; ``drop`` deletes those that nothing reads any more, ``scratch`` or the end of the process the rest."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = passing_path(self.spark, name)
        df.write.partitionBy(*partition_by).parquet(path)
        self.paths[name] = self.paths.get(name, ()) + (path,)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_buckets(self, df: DataFrame, name: str, column: str, dealt: bool = False) -> DataFrame:
        """``df`` in buckets sorted by ``column``, as many as a shuffle has partitions, so that joins on it don't shuffle this side; ``dealt``: it lies by ``column`` already."""
        path, buckets = passing_path(self.spark, name), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = path.rsplit("/", 1)[-1].replace("-", "_")
        rows = df if dealt else df.repartition(buckets, column)
        rows.write.format("parquet").bucketBy(buckets, column).sortBy(column).option("path", path).saveAsTable(table)
        self.paths[name] = self.paths.get(name, ()) + (path,)
        _tables[path] = table
        return self.spark.table(table)

    def drop(self, *names: str, all_but_last: bool = False) -> None:
        for name in names:
            paths = self.paths.get(name, ())
            gone, left = (paths[:-1], paths[-1:]) if all_but_last else (paths, ())
            for path in gone:
                delete(self.spark, path)
            self.paths[name] = left
