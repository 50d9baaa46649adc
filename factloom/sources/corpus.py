"""Text corpora: SQL files and source code, one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Directories never read.
SQL_SKIPPED = ("node_modules", ".git", "target")
SOURCE_SKIPPED = ("node_modules", "dist", "build", ".git")
# File name extensions of each source language reader.
EXTENSIONS = {"typescript": (".ts", ".tsx"), "jvm": (".java", ".kt", ".kts")}


def in_directory(path: Column, names: tuple[str, ...]) -> Column:
    """Some directory on the path has one of the names."""
    found = F.lit(False)
    for name in names:
        found = found | F.contains(path, F.lit(f"/{name}/"))
    return found


def _read(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))


def read_sql(spark: SparkSession, path: str, glob: str = "*.sql") -> DataFrame:
    """(file_path, sql) of every SQL file below a path; files are listed and read by the executors' tasks."""
    files = _read(spark, path, glob).filter(~in_directory(F.col("file_path"), SQL_SKIPPED))
    return files.withColumnRenamed("content", "sql")


def read_source(spark: SparkSession, path: str, extensions: tuple[str, ...], excludes: tuple[str, ...] = ()) -> DataFrame:
    """(file_path, content) of source files by extension.

    ``excludes`` are path parts to leave out (declaration files always are).
    """
    ending = F.lit(False)
    for extension in extensions:
        ending = ending | F.endswith(F.lower("file_path"), F.lit(extension))
    p = F.col("file_path")
    kept = _read(spark, path, None).filter(ending & ~F.endswith(p, F.lit(".d.ts")) & ~in_directory(p, SOURCE_SKIPPED))
    for part in excludes:
        kept = kept.filter(~F.contains(p, F.lit(part)))
    return kept
