"""Tab-separated export of a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.table import shown_text
from .csv import read_csv


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """Write the table as shown, one part file per task."""
    shown_text(df).write.csv(path, sep="\t", header=header, quote='"', escape='"', emptyValue="", nullValue="")


def read_tsv(spark, path: str, header: bool = True) -> DataFrame:
    """The table as text. With a header, files are read in splits, cells with line breaks included."""
    if header:
        return read_csv(spark, path, "\t", line_breaks=True)
    return spark.read.csv(path, sep="\t", header=header, quote='"', escape='"', multiLine=True).na.fill("")
