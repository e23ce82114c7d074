"""Column functions over names: project names, file names of distributions, dotted names, requirements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"^[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?$"


def package_name(raw: Column) -> Column:
    """IO-05: the normalised project name; null unless the raw text is a valid name."""
    return F.when(raw.rlike(_NAME) & ~F.contains(raw, F.lit("\n")), F.lower(F.regexp_replace(raw, "[-_.]+", "-")))


def sdist_name(filename: Column) -> Column:
    """IO-04: the name part of ``{name}-{version}.tar.gz``, split at the last dash; null for other files."""
    return F.nullif(F.regexp_extract(filename, r"^(.+)-([^-]+)\.tar\.gz$", 1), F.lit(""))


def sdist_version(filename: Column) -> Column:
    return F.nullif(F.regexp_extract(filename, r"^(.+)-([^-]+)\.tar\.gz$", 2), F.lit(""))


def requirement_name(requirement: Column) -> Column:
    """B-01: the project that a requirement names; null if it does not begin with a valid name."""
    return package_name(F.regexp_extract(F.trim(requirement), r"^([A-Za-z0-9._-]*)", 1))


def requirement_optional(requirement: Column) -> Column:
    """B-01: whether an extra or a marker conditions it."""
    return F.contains(requirement, F.lit(";"))


def is_under(name: Column, prefix: Column) -> Column:
    """M-01: whether ``prefix`` is ``name`` or its first dotted components."""
    return (name == prefix) | F.startswith(name, F.concat(prefix, F.lit(".")))


def dotted_prefixes(name: Column) -> Column:
    """All leading parts of a dotted name, longest first: what M-01 matches, ready for a hash join."""
    parts = F.split(name, r"\.")
    return F.reverse(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ".")))


def package_of(module: Column, is_init: Column) -> Column:
    """N-04: the package that relative imports of a module start from."""
    return F.when(is_init, module).otherwise(F.regexp_replace(module, r"(^|\.)[^.]*$", ""))


def resolve_relative(package: Column, dots: Column, rest: Column) -> Column:
    """N-04: ``from ..x import`` as a dotted name; null when it climbs out of the top package."""
    parts = F.filter(F.split(package, r"\."), lambda p: p != "")
    left = F.size(parts) - (dots - 1)
    joined = F.array_join(F.concat(F.slice(parts, F.lit(1), F.greatest(left, F.lit(0))), F.filter(F.array(rest), lambda p: p != "")), ".")
    return F.when(left >= 0, joined)


def module_dotted(path: Column, top_level: Column) -> Column:
    """N-03: the module name of a path; a container directory in front is left out if the next part is top-level."""
    stem = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", "")
    parts = F.filter(F.split(stem, "/"), lambda p: p != "")
    contained = (F.size(parts) >= 2) & ~F.array_contains(top_level, F.get(parts, F.lit(0))) & F.array_contains(top_level, F.get(parts, F.lit(1)))
    return F.array_join(F.when(contained, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts), ".")


def package_ref(ref: Column) -> Column:
    """IO-21: struct of name and version of ``name==version``, nothing else; null for any other text."""
    name, version = F.regexp_extract(ref, "^([^=]+)==([^=]+)$", 1), F.regexp_extract(ref, "^([^=]+)==([^=]+)$", 2)
    return F.when((version != "") & package_name(name).isNotNull(), F.struct(package_name(name).alias("name"), version.alias("version")))
