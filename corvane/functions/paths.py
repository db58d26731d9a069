"""Expressions over relative file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def suffix(path: Column) -> Column:
    """The last extension in lower case, with its dot; empty for names like ".jpg" and "x."."""
    return F.lower(F.regexp_extract(path, r"([^/])(\.[^./]+)$", 2))


def has_suffix(path: Column, extensions) -> Column:
    return suffix(path).isin(*sorted(extensions))


def class_code(rel_path: Column, class_map) -> Column:
    """The first character of the first path part that is a known code followed by a dot; the file name counts too."""
    known = lambda part: (F.substring(part, 2, 1) == ".") & F.substring(part, 1, 1).isin(*sorted(class_map))
    return F.substring(F.get(F.filter(F.split(rel_path, "/"), known), F.lit(0)), 1, 1)


def class_name(code: Column, class_map) -> Column:
    out = F.lit(None).cast("string")
    for key, name in class_map.items():
        out = F.when(code == key, F.lit(name)).otherwise(out)
    return out


def relative(path: Column, root: str) -> Column:
    """A scan's path below its root; the scheme and slashes that Hadoop puts first go."""
    bare = F.regexp_replace(path, r"^[a-z]+:/+", "/")
    return F.substr(bare, F.lit(len(root.rstrip("/")) + 2))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def numbered_path(split: Column, name: Column, ordinal: Column, ext: Column) -> Column:
    """split/class/class_00001.ext; the number grows past five digits."""
    return F.concat_ws("/", split, name, F.concat(F.format_string("%s_%05d", name, ordinal), ext))
