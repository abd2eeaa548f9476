"""What belongs to a project: its session files, and the packages that its manifests declare.

Defined results: a folder without fitting files gives no rows; a manifest that isn't JSON declares nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A package file's fields, and files whose lines declare Python packages.
FIELDS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
PYTHON_FILES = ("requirements.txt", "pyproject.toml", "Pipfile")
#: A line that declares a Python package.
PYTHON_LINE = r"""^[ \t]*['"]?([A-Za-z][A-Za-z0-9_.-]+)['"]?\s*(?:[=<>~!]=?|@|\s*=\s*)"""


def folder_name(path: Column) -> Column:
    """The name of a project's folder of sessions: letters, digits and hyphens of its path, and a hyphen for anything else."""
    return F.regexp_replace(path, "[^A-Za-z0-9-]", "-")


def session_files(spark: SparkSession, root: str, project: str) -> DataFrame:
    """path, modified and bytes of the JSON-line files in the root's folders that begin with the project's name, the oldest first; contents aren't read."""
    name = "".join(c if c.isascii() and (c.isalnum() or c == "-") else "-" for c in project)
    listed = spark.read.format("binaryFile").load(f"{root}/{name}*/*.jsonl")
    return listed.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy("modified", "path")


def of_project(found: DataFrame, project: str) -> DataFrame:
    """Records (of transcripts.records) of the files whose first stated working folder is the project's, or that state none.

    The first stated folder counts wherever it stands.
    """
    first = F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("ord")))
    others = found.groupBy("file").agg(first.alias("_cwd")).filter(F.col("_cwd") != project).select("file")
    return found.join(others, "file", "left_anti")


def _manifests(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """name and value of the folder's own files of these names; manifests are small, so each is one row."""
    listed = spark.read.option("pathGlobFilter", "{" + ",".join(names) + "}").text(folder, wholetext=True)
    return listed.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), "value")


def declared(spark: SparkSession, folder: str) -> DataFrame:
    """kind (package, lock or python) and name of each package that the folder's manifests declare."""
    keys = lambda path: F.coalesce(F.json_object_keys(F.get_json_object("value", path)), F.array().cast("array<string>"))
    package = _manifests(spark, folder, ("package.json",)).select(F.lit("package").alias("kind"), F.explode(F.concat(*(keys(f"$.{f}") for f in FIELDS))).alias("name"))
    installed = F.filter(F.transform(keys("$.packages"), lambda k: F.regexp_extract(k, r"(?s)^.*node_modules/(.*)$", 1)), lambda k: k != "")
    lock = _manifests(spark, folder, ("package-lock.json",)).select(F.lit("lock").alias("kind"), F.explode(F.concat(installed, keys("$.dependencies"))).alias("name"))
    lines = F.regexp_extract_all("value", F.lit("(?m)" + PYTHON_LINE), F.lit(1))
    python = _manifests(spark, folder, PYTHON_FILES).select(F.lit("python").alias("kind"), F.explode(F.transform(lines, F.lower)).alias("name"))
    return package.unionByName(lock).unionByName(python).distinct()
