"""Source trees: clone, scan, and read as text."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import universal_newlines
from .tree import source_tree

#: Suffixes of the chat-record plan, and folders that hold no sources.
CHAT_SUFFIXES = (".py", ".js", ".jsx", ".ts", ".tsx", ".md")
SPAN_SUFFIXES = (".py", ".md", ".MD", ".Md", ".mD")
EXCLUDED = (".git", "node_modules", "dist", "build", "venv", ".venv", "__pycache__")


def run(command: list[str], cwd: str | None = None) -> str:
    """What a command wrote to its output; what it said otherwise is the error's text."""
    try:
        return subprocess.run(command, cwd=cwd, capture_output=True, text=True, check=True).stdout
    except subprocess.CalledProcessError as e:
        raise RuntimeError(f"{' '.join(command[:2])} failed: {e.stdout}{e.stderr}") from e


def shallow_clone(url: str, folder: str) -> tuple[str, str]:
    """(folder, commit) of a clone without history. On a cluster the folder has to be one that all executors see."""
    run(["git", "clone", "--depth=1", url, folder])
    return folder, run(["git", "rev-parse", "HEAD"], folder).strip()


def _text(content: Column) -> Column:
    """UTF-8 without what isn't; line ends as \\n."""
    return universal_newlines(F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit("")))


def _scanned(spark: SparkSession, root: str, glob: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path below root, suffix, text); only files of these suffixes are read.

    Roots in another store than a mounted one are read by Spark's file source, which leaves out names that begin with a dot or an underscore.
    """
    if "://" not in root.removeprefix("file://"):
        return source_tree(spark, paths.local(root), suffixes).select("path", "text", "suffix")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    path = paths.relative(F.col("path"), paths.local(root))
    return found.select(path.alias("path"), _text(F.col("content")).alias("text")).withColumn("suffix", paths.suffix(F.col("path")))


def chat_files(spark: SparkSession, root: str, prune_excluded: bool = False) -> DataFrame:
    """Files of the chat-record plan, suffixes as they are written; excluded folders only go when asked for."""
    files = _scanned(spark, root, "*.{py,js,jsx,ts,tsx,md}", CHAT_SUFFIXES).filter(F.col("suffix").isin(*CHAT_SUFFIXES))
    if prune_excluded:
        files = files.filter(~F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda p: p.isin(*EXCLUDED)))
    return files


def span_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of the span plans: .py, and .md in either case."""
    return _scanned(spark, root, "*.{py,[mM][dD]}", SPAN_SUFFIXES).filter((F.col("suffix") == ".py") | (F.lower("suffix") == ".md"))
