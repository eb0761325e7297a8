"""Files as tables and as named views."""

from __future__ import annotations

import re
from pathlib import PureWindowsPath

from pyspark.sql import DataFrame, SparkSession

from .csv import read_csv_typed

#: The name of a file whose own name says nothing.
FALLBACK_NAME = "data"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def view_name(file_name: str) -> str:
    """What a file is called as a view: its name without folder, ending and control characters."""
    stem = PureWindowsPath(_CONTROL.sub("", file_name)).stem.strip(" .")
    return stem or FALLBACK_NAME


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder, or a CSV file with detected types, by its extension."""
    return read_csv_typed(spark, path) if re.search(r"\.(csv|tsv)$", path, re.I) else spark.read.parquet(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> list[str]:
    """Paths of the tables of a folder, those of its partitions too: names only, no contents.

    A table is a file, or a folder of files such as Spark writes; what is in such a folder is no table of its own.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    wanted, found, open_folders = hadoop.GlobFilter(pattern), [], [hadoop.Path(folder)]
    while open_folders:
        place = open_folders.pop()
        for entry in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place):
            path, name = entry.getPath(), entry.getPath().getName()
            if name.startswith(".") or name.startswith("_") and "=" not in name:
                continue
            if wanted.accept(path):
                found.append(path.toString())
            elif entry.isDirectory() and "=" in name:
                open_folders.append(path)
    return sorted(found)


def create_views(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """One view per file, named after it; returns view name to path. Two files of one name are an error, before any view is made."""
    views: dict[str, str] = {}
    for path in paths:
        name = view_name(path)
        clash = next((other for other in views if other.lower() == name.lower()), None)
        if clash is not None:
            raise ValueError(f"{path} and {views[clash]} would both be the view {name}")
        views[name] = path
    for name, path in views.items():
        read_file(spark, path).createOrReplaceTempView(name if name.isidentifier() else "`" + name.replace("`", "``") + "`")
    return views
