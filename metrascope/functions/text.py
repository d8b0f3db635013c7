"""Text expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source that does not render, and accents that hide letters.
COMMENT_ENVIRONMENT = r"(?s)\\begin\{comment\}.*?(?:\\end\{comment\}|\z)"
SWITCHED_OFF = r"(?s)\\iffalse\b.*?(?:\\fi\b|\z)"
AFTER_END = r"(?s)(\\end\{document\}).*"
LINK_ARGUMENT = r"\\(?:url|href)\{[^}]*\}"
PERCENT_COMMENT = r"(?<!\\)%[^\n]*"
ACCENT = r"\\(?:[`'^\"~=.]|[uvHtcdb](?=[\s{]))\s*\{?([a-zA-Z])\}?"
# How typeset text differs from its source.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\u00ad": ""}
DASHES, SINGLE_QUOTES, DOUBLE_QUOTES = "[\u2010-\u2015]", "[\u2018\u2019`]", "[\u201c\u201d]|''|``"
# Characters of a snippet on each side of a hit, in sources and in metadata.
SOURCE_RADIUS, METADATA_RADIUS = 700, 400


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sums_before(xs: Column, block: int = 64) -> Column:
    """For each integer of an array, the sum of those before it.

    Sums of blocks, then sums within a block: arrays of any usual length take
    time in proportion to their length.
    """
    add = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))

    def of(xs: Column) -> Column:
        totals = F.transform(upto(F.ceil(F.size(xs) / block).cast("int")), lambda b: add(F.slice(xs, b * block + 1, F.lit(block))))
        bases = let(totals, lambda ts: F.transform(ts, lambda _, i: add(F.slice(ts, F.lit(1), i))))
        here = lambda bs: F.transform(xs, lambda _, i: F.get(bs, F.floor(i / block).cast("int")) + add(F.slice(xs, i - i % block + 1, i % block)))
        return let(bases, here)

    return let(xs, of)


def match_positions(text: Column, pattern: str | Column) -> Column:
    """array<struct<offset, matched>> of all non-empty matches, offsets counted in characters from 0.

    The pieces between matches and the matches themselves add up to the text.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("skip"), m.alias("matched")))

    def placed(steps: Column) -> Column:
        starts = sums_before(F.transform(steps, lambda s: s["skip"] + F.length(s["matched"])))
        return F.zip_with(steps, starts, lambda s, at: F.struct((at + s["skip"]).alias("offset"), s["matched"].alias("matched")))

    return let(steps, placed)


def window(text: Column, offset: Column, radius: int, length: Column | int = 0) -> Column:
    """The text from ``radius`` characters before an offset to as many after offset + length."""
    low = F.greatest(F.lit(0), offset - radius)
    return F.substring(text, low + 1, offset + length + radius - low)


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def is_grounded(quote: Column, text: Column) -> Column:
    """Whether a non-empty quote occurs in the text, white space aside."""
    return (F.coalesce(F.length(quote), F.lit(0)) > 0) & F.contains(squeeze(text), squeeze(quote))


def strip_comments(c: Column) -> Column:
    """Source without what does not render; percent signs inside link arguments stay."""
    c = F.regexp_replace(F.regexp_replace(c, COMMENT_ENVIRONMENT, ""), SWITCHED_OFF, "")
    c = F.regexp_replace(c, AFTER_END, "$1")
    links = F.transform(F.regexp_extract_all(c, F.lit(LINK_ARGUMENT), F.lit(0)), lambda x: F.replace(x, F.lit("%"), F.lit("\x00")))
    pieces = F.split(c, LINK_ARGUMENT, -1)
    guarded = F.array_join(F.zip_with(pieces, links, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    return F.replace(F.regexp_replace(guarded, PERCENT_COMMENT, ""), F.lit("\x00"), F.lit("%"))


def plain_accents(c: Column) -> Column:
    """Accent macros give way to their letters, ties to spaces."""
    return F.replace(F.regexp_replace(c, ACCENT, "$1"), F.lit("~"), F.lit(" "))


def typeset(c: Column) -> Column:
    """The common form of quotes and rendered text before they are compared."""
    for mark, letters in LIGATURES.items():
        c = F.replace(c, F.lit(mark), F.lit(letters))
    c = F.replace(c, F.lit("-\n"), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, DASHES, "-"), SINGLE_QUOTES, "'")
    return F.lower(squeeze(F.regexp_replace(c, DOUBLE_QUOTES, '"')))


def first_class(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule (name, pattern) that matches."""
    out = F
    for name, pattern in rules:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise(default)


def middle_cut(c: Column, most: int, marker: str = "\n[...]\n") -> Column:
    """Texts over ``most`` characters keep two thirds of that from the start and one third from the end."""
    head = most * 2 // 3
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(head)), F.lit(marker), F.right(c, F.lit(most - head)))).otherwise(c)


def sniff_format(head: Column) -> Column:
    """A format by the first bytes of a file."""
    magic = lambda n: F.hex(F.substring(head, 1, n))
    blank = F.octet_length(head) == 0
    return F.when(blank, "empty").when(magic(4) == "25504446", "pdf").when(magic(2) == "1F8B", "gzip").when(F.hex(F.substring(head, 258, 5)) == "7573746172", "tar").otherwise("other")


def decode_text(c: Column) -> Column:
    """UTF-8 where the bytes are valid, Latin-1 otherwise."""
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.decode(c, "ISO-8859-1"))


def protocol_hash(*fields: Column) -> Column:
    """SHA-256 of fields joined by ``|``; null is written as None."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("None")) for f in fields]), 256)
