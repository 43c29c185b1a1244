"""The catalogue as a table in folders by ``library_dir``: scans read, and changes rewrite, only the folders concerned."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from needledrop.operators import sync

BY = "library_dir"
#: Up to so many folders are named in a plan; changes to more of them go through a join.
NAMED = 1000


class Snapshot:
    """A catalogue of Parquet files, a folder a library. One writer at a time; a change replaces whole folders, each at once."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType) -> None:
        # partition columns come last in what is read
        self.spark, self.folder, self.schema = spark, folder, StructType([*[f for f in schema if f.name != BY], schema[BY]])

    def create(self, rows: DataFrame) -> Snapshot:
        self._put(rows, "static")
        return self

    def _put(self, rows: DataFrame, mode: str) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(BY).parquet(self.folder)

    def read(self, *library_dirs: str) -> DataFrame:
        """All rows, or those of some libraries: only their folders are listed and read."""
        rows = self.spark.read.schema(self.schema).parquet(self.folder)
        return rows.filter(F.col(BY).isin(*library_dirs)) if library_dirs else rows

    def _concerned(self, rows: DataFrame) -> tuple[list[str] | None, DataFrame]:
        """The libraries of some rows, or None if they are too many to name, and their part of the table."""
        dirs = rows.select(BY).distinct()
        named = [r[BY] for r in dirs.limit(NAMED + 1).collect()]
        if len(named) > NAMED:
            return None, self.read().join(dirs, BY, "left_semi")
        return named, self.read(*named) if named else self.read().limit(0)

    def _drop_emptied(self, before: list[str], left: set[str]) -> None:
        """A folder without rows is not written, so its old files go here."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = {d for d in before if d not in left}
        for status in files.listStatus(path) if gone else ():
            name = status.getPath().getName()
            if name.startswith(f"{BY}=") and unquote(name.removeprefix(f"{BY}=")) in gone:
                files.delete(status.getPath(), True)

    def upsert(self, incoming: DataFrame, *key: str, seq: str | None = None) -> None:
        """Rows replace those of their key within their library; libraries that no row names are not touched."""
        _, part = self._concerned(incoming)
        self._put(sync.upsert(part, incoming, *key, seq=seq), "dynamic")

    def prune(self, keep: DataFrame, library_dir: str, full_sweep: bool) -> None:
        """Drop a library's rows that a full sweep did not see."""
        if full_sweep:
            self._put(sync.prune(self.read(library_dir), keep, library_dir, full_sweep), "dynamic")
            self._left_after([library_dir], keep)

    def _left_after(self, dirs: list[str], keep: DataFrame) -> None:
        left = {r[BY] for r in self.read(*dirs).join(keep.select("path"), "path", "left_semi").select(BY).distinct().collect()}
        self._drop_emptied(dirs, left)

    def delete(self, gone: DataFrame) -> None:
        """Drop rows by ``path`` and library; a folder that loses all its rows goes."""
        named, part = self._concerned(gone)
        rest = sync.delete_paths(part, gone)
        left = {r[BY] for r in rest.select(BY).distinct().collect()}
        self._put(rest, "dynamic")
        self._drop_emptied(named if named is not None else [r[BY] for r in gone.select(BY).distinct().toLocalIterator()], left)
