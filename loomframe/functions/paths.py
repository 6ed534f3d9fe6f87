"""Path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def name(path) -> Column:
    return F.element_at(F.split(_c(path), "/", -1), -1)


def stem(path) -> Column:
    """Last path part up to its first dot."""
    return F.substring_index(name(path), ".", 1)


def folder_class(path) -> Column:
    return F.substring_index(_c(path), "/", 1)


def under_root(root: str, path) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), _c(path))


def swap_suffix(path, old: str, new: str) -> Column:
    """Sibling path: ``old`` at the end becomes ``new``."""
    literal = "".join("\\" + ch if not ch.isalnum() else ch for ch in old)
    return F.regexp_replace(_c(path), literal + "$", new.replace("\\", "\\\\").replace("$", "\\$"))


def padded_image_name(image_id, width: int = 16, suffix: str = ".jpg") -> Column:
    """Left-zero-padded id; longer ids are kept whole."""
    image_id = _c(image_id).cast("string")
    return F.concat(
        F.lpad(image_id, F.greatest(F.lit(width), F.length(image_id)), F.lit("0")), F.lit(suffix)
    )


def content_number(path) -> Column:
    """Numeric file stem, an error when it is not a number."""
    value = stem(path)
    return F.when(value.rlike(r"^\d+$"), value.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("file stem is not a number: "), _c(path))).cast("long")
    )


def style_content_path(style, content) -> Column:
    return F.format_string("id_%d/%04d.png", _c(style).cast("long"), _c(content).cast("long"))
