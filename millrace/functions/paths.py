"""Parts of paths and repository addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last dot and what follows; empty for names that only start with a dot or end in one."""
    return F.regexp_extract(name(path), r"^.+?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    last = name(path)
    return F.substring(last, F.lit(1), F.length(last) - F.length(suffix(path)))


def relative(path: Column, root: str) -> Column:
    """A path below root, whatever scheme it comes with."""
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z]+:(//[^/]*)?", ""), "^" + _quoted(root.rstrip("/")) + "/", "")


def _quoted(said: str) -> str:
    return "\\Q" + said.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def repository_name(url: Column) -> Column:
    """The last part of a repository's address, without .git."""
    return F.replace(F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1), F.lit(".git"), F.lit(""))


def run_folder(url: Column, at: Column) -> Column:
    """A repository's name and the time, for one run's files."""
    return F.concat(repository_name(url), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def local(root: str) -> str:
    """A folder's path as Spark writes it below a scheme."""
    return re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", root).rstrip("/")
