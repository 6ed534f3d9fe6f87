"""Text functions over two scripts A and B given as character-class bodies."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.arrays import bind

# The CJK range and ASCII letters, and all Unicode white space.
CJK = "一-龥"
LATIN = "A-Za-z"
BLANKS = r"\t-\r\x1c-\x20\x85\p{Z}"

# Fixed value: word classes of the tokeniser (specials, contractions, letters,
# single digits, runs of anything else).
WORD = (
    r"(?i)<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d"
    rf"|\p{{L}}+|\p{{N}}|[^{BLANKS}\p{{L}}\p{{N}}]+"
)


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def has_script(text, script: str = CJK) -> Column:
    return _c(text).rlike(f"[{script}]")


def strip(text) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.regexp_replace(_c(text), f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def _grab(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, "(?s)" + pattern, 1)


def split_tags(keywords, a: str = CJK, b: str = LATIN) -> tuple[Column, Column]:
    """Comma tags as two ordered lists, one per script.

    A tag with both scripts is cut where the later script starts; a tag with
    neither vanishes; nothing is trimmed.
    """
    tags = F.split(F.coalesce(_c(keywords), F.lit("")), ",", -1)

    def part(own: str, other: str):
        def cut(tag: Column) -> Column:
            own_first = tag.rlike(f"(?s)^[^{own}{other}]*[{own}]")
            head = _grab(tag, f"^([^{other}]*)")
            tail = _grab(tag, f"^[^{own}]*(.*)$")
            return F.when(
                has_script(tag, other), F.when(own_first, head).otherwise(tail)
            ).otherwise(tag)

        return F.transform(F.filter(tags, lambda t: has_script(t, own)), cut)

    return part(a, b), part(b, a)


def split_remark(text, a: str = CJK, b: str = LATIN, legacy: bool = False) -> tuple[Column, Column]:
    """Span of script A (first to last character) and what script B holds after it.

    With ``legacy`` a text without A that starts with B loses its first letter.
    All patterns are anchored or succeed at their first candidate, so matching
    stays linear in the text length.
    """
    text = F.coalesce(_c(text), F.lit(""))
    a_span = _grab(text, f"([{a}](?:.*[{a}])?)")
    after_a = _grab(text, f"^(?:.*[{a}])?([^{a}]*)$")
    b_started_early = text.rlike(f"(?s)^[^{b}]*[{b}].*[{a}]")
    b_span = F.when(b_started_early, _grab(after_a, f"^(.*[{b}])")).otherwise(
        _grab(after_a, f"([{b}](?:.*[{b}])?)")
    )
    if legacy:
        loses = text.rlike(f"^[{b}]") & ~has_script(text, a)
        b_span = F.when(loses, _grab(text, f"^.(.*[{b}])")).otherwise(b_span)
    return strip(a_span), strip(b_span)


def join_tags(tags, separator: str = " ") -> Column:
    return F.array_join(_c(tags), separator)


def validity(text) -> Column:
    """0 for exactly empty (or missing) text, else 1."""
    return F.when(F.coalesce(_c(text), F.lit("")) == "", 0).otherwise(1)


def _entity(names: Mapping[str, str], name: Column) -> Column:
    """Characters of an entity by its name, else null; names and characters are one constant each."""
    known, chars = (F.split(F.lit("\1".join(x)), "\1") for x in (names.keys(), names.values()))
    return F.get(chars, (F.array_position(known, name) - 1).cast("int"))


def _character(point: Column) -> Column:
    """The character that HTML reads for a number."""
    low = F.array(*[F.lit(html.unescape(f"&#{n};")) for n in range(0xA0)])  # controls are read as Windows characters or dropped
    return (
        F.when((point > 0x10FFFF) | point.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(point < 0xA0, F.get(low, point.cast("int")))
        .when(point.between(0xFDD0, 0xFDEF) | (point % 0x10000 >= 0xFFFE), F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    )


def unescape(text) -> Column:
    """Entities replaced as HTML reads them, by name or number, with or without a semicolon.

    The text is cut at ampersands.  What a piece begins with is a number, else a whole name, else
    the longest beginning that is known without a semicolon.
    """
    closed = {n: c for n, c in html5.items() if n.endswith(";")}
    opened = {n: html5[n] for n in sorted(html5.keys() - closed.keys(), key=lambda n: (-len(n), n))}

    def begin(p: Column, i: Column) -> Column:
        number = F.regexp_extract(p, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
        name = F.regexp_extract(F.substring(p, 1, 33), r"^[^\t\n\f <&#;]{1,32};", 0)
        digits = F.regexp_extract(number, "^#[xX]?0*([0-9a-fA-F]*)", 1)
        return F.struct(
            i.alias("i"), p.alias("piece"), F.when(p.startswith("#"), number).otherwise(name).alias("taken"),
            F.when(p.startswith("#"), F.substring(digits, 1, 8)).alias("digits"),  # eight are beyond the last character
        )

    def known(x: Column) -> Column:
        point = F.when(x.digits == "", F.lit("0")).when(x.taken.rlike("^#[xX]"), F.conv(x.digits, 16, 10)).otherwise(x.digits)
        return F.struct(
            x.i.alias("i"), x.piece.alias("piece"), x.taken.alias("taken"),
            F.when(x.taken.startswith("#"), point.cast("long")).alias("point"),
            F.when(x.taken.endswith(";") & ~x.taken.startswith("#"), _entity(closed, x.taken)).alias("chars"),
        )

    def or_begun(x: Column) -> Column:
        begun = F.regexp_extract(F.substring(x.piece, 1, 32), f"^(?:{'|'.join(opened)})", 0)
        found = x.point.isNotNull() | x.chars.isNotNull()
        return F.struct(
            x.i.alias("i"), x.piece.alias("piece"), F.when(found, x.taken).otherwise(begun).alias("taken"),
            x.point.alias("point"), x.chars.alias("chars"),
        )

    def replaced(x: Column) -> Column:
        chars = F.coalesce(x.chars, _character(x.point), F.when(x.taken != "", _entity(opened, x.taken)), F.lit("&"))
        rest = F.substring(x.piece, F.length(x.taken) + 1, F.length(x.piece))
        return F.when(x.i == 0, x.piece).otherwise(F.concat(chars, rest))

    def run(t: Column) -> Column:
        pieces = F.transform(F.split(t, "&", -1), begin)
        for step in (known, or_begun, replaced):
            pieces = F.transform(pieces, step)
        return F.when(F.contains(t, F.lit("&")), F.array_join(pieces, "")).otherwise(t)

    return bind(_c(text), run)


def clean(text) -> Column:
    """Unescape entities twice, collapse white space, trim, lower-case."""
    plain = unescape(unescape(text))
    return F.lower(F.trim(F.regexp_replace(plain, f"[{BLANKS}]+", " ")))


def words(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(WORD), F.lit(0))


def frame_tokens(ids, start: int, end: int, length: int, truncate: bool = False) -> Column:
    """Start and end tokens around ``ids``, zero-padded to ``length``.

    Too long: an error, or with ``truncate`` a cut whose last token is ``end``.
    """
    framed = F.concat(F.array(F.lit(start)), _c(ids), F.array(F.lit(end)))
    size = F.size(framed)
    padded = F.concat(framed, F.array_repeat(F.lit(0), F.greatest(F.lit(length) - size, F.lit(0))))
    if truncate:
        too_long = F.concat(F.slice(framed, 1, length - 1), F.array(F.lit(end)))
    else:
        too_long = F.raise_error(
            F.concat(F.lit("sequence longer than "), F.lit(str(length)))
        ).cast(T.ArrayType(T.IntegerType()))
    return F.when(size > length, too_long).otherwise(padded)


def pad_with_mask(ids, length: int, pad: int = 0) -> tuple[Column, Column]:
    """Cut or pad ``ids`` to ``length`` and the matching attention mask."""
    ids = _c(ids)
    kept = F.least(F.size(ids), F.lit(length))
    padded = F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad), F.lit(length) - kept))
    mask = F.concat(
        F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(length) - kept)
    )
    return padded, mask


def wrap(text, width: int) -> Column:
    """A line break after every ``width`` characters, none at the end."""
    return F.regexp_replace(_c(text), f"(?s)(.{{{width}}})(?=.)", "$1\n")


def shorten(text, length: int) -> Column:
    return F.substring(_c(text), 1, length)


def slug(text) -> Column:
    return F.replace(_c(text), F.lit(" "), F.lit("-"))


def range_list(spec) -> Column:
    """``'5-8, 2'`` as sorted integers; range ends are exclusive, duplicates stay."""

    def item(piece: Column) -> Column:
        bounds = F.split(strip(piece), "-")
        low = bounds[0].cast("int")
        high = F.try_element_at(bounds, F.lit(2)).cast("int")
        return F.when(high.isNull(), F.array(low)).otherwise(
            F.when(high > low, F.sequence(low, F.greatest(high - 1, low))).otherwise(
                F.array().cast("array<int>")
            )
        )

    pieces = F.split(_c(spec), ",", -1)
    bad = F.exists(pieces, lambda p: ~strip(p).rlike(r"^\d+(-\d+)?$"))
    parsed = F.sort_array(F.flatten(F.transform(pieces, item)))
    return F.when(
        bad, F.raise_error(F.concat(F.lit("bad range list: "), _c(spec))).cast("array<int>")
    ).otherwise(parsed)


def scripts_present(text, scripts: Sequence[str]) -> list[Column]:
    return [has_script(text, s).cast("long") for s in scripts]
