"""Column functions over paths of archive members and source files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def classify(path: Column) -> Column:
    """IO-01: what kind of source a path is; null if it is none."""
    return (
        F.when(path == "setup.py", "setup_py")
        .when(path == "pyproject.toml", "pyproject_toml")
        .when(F.endswith(path, F.lit(".py")), "python")
    )


def components(path: Column) -> Column:
    return F.filter(F.split(path, r"[/\\]"), lambda p: (p != "") & (p != "."))


def normalise_entry(path: Column) -> Column:
    """IO-07: the path with slashes, without empty and ``.`` parts."""
    return F.array_join(components(path), "/")


def entry_error(path: Column, kind: Column) -> Column:
    """IO-06: why an archive member must not be unpacked; null if it may. ``kind``: file, directory, symlink, hardlink, other."""
    parts = components(path)
    return (
        F.when(path.rlike(r"^(?:[/\\]|[A-Za-z]:)"), "absolute_path")
        .when(F.array_contains(parts, ".."), "path_traversal")
        .when((F.size(parts) == 0) & (kind != "directory"), "path_traversal")
        .when(kind.isin("symlink", "hardlink"), "link_entry")
        .when(~kind.isin("file", "directory"), "unsupported_entry")
    )


def top_level_of(path: Column) -> Column:
    """Rule of IO-18 that a path answers to, with the name it gives: struct of rule and name, null for none."""
    at_root = F.regexp_extract(path, r"^([^/]+)/__init__\.py$", 1)
    contained = F.regexp_extract(path, r"^[^/]+/([^/]+)/__init__\.py$", 1)
    single = F.regexp_extract(path, r"^([^/]+)\.py$", 1)
    return (
        F.when(at_root != "", F.struct(F.lit(1).alias("rule"), at_root.alias("name")))
        .when(contained != "", F.struct(F.lit(2).alias("rule"), contained.alias("name")))
        .when((single != "") & (path != "setup.py"), F.struct(F.lit(3).alias("rule"), single.alias("name")))
    )


def top_level_modules(path: Column):
    """IO-18 as an aggregate over the paths of one distribution: sorted names."""
    found = F.collect_set(top_level_of(path))
    of = lambda rule: F.transform(F.filter(found, lambda x: x["rule"] == rule), lambda x: x["name"])
    packages = F.when(F.size(of(1)) > 0, of(1)).otherwise(of(2))
    return F.array_sort(F.array_union(packages, of(3)))
