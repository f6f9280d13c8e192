"""Text and Markdown clean-up as column functions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[ \t\n\r\f\x0B]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row; inside a lambda function an outer expression is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def words(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def merge_hyphens(text: Column, strict: bool = True) -> Column:
    """Words parted by a hyphen at a line end, joined; strict: letters only, and the second part in lower case."""
    pattern = r"([a-zA-Z]+)-\s*\n\s*([a-z]+)" if strict else r"([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)"
    return F.regexp_replace(text, pattern, "$1$2")


def clean_artifacts(text: Column) -> Column:
    """Without stray signs at line starts, runs of blanks and blank lines in a row."""
    out = F.regexp_replace(text, r"(?md)^[|_\-=+]+\s*", "")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(out, r"\n\s*\n{2,}", "\n\n"))


def normalize_markdown(text: Column) -> Column:
    """Dashes, bullets, blank lines and empty role tags in one form."""
    out = F.translate(text, "−–—―", "----")
    out = F.regexp_replace(out, r"(?md)(^|\n\n)[ ]{2,4}([-*+])\s", "$1$2 ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"(?md)^(\s*)\* ", "$1- ")
    out = F.regexp_replace(out, r"([^\n])\n(#{1,6} )", "$1\n\n$2")
    out = F.regexp_replace(out, r"<!-- role:\w+ -->\s*<!-- /role -->", "")
    return strip(out)


def mask_numbers(text: Column) -> Column:
    """Whole numbers as [NUM]."""
    return F.regexp_replace(strip(text), r"\b\d+\b", "[NUM]")


def fold_case(text: Column) -> Column:
    """Lower case with single blanks."""
    return F.regexp_replace(F.lower(strip(text)), r"\s+", " ")


def safe_file_name(name: Column) -> Column:
    """A name that any file system takes, of at most 200 characters."""
    out = F.regexp_replace(name, r'[<>:"/\\|?*]', "_")
    out = F.regexp_replace(F.replace(out, F.lit("$"), F.lit("USD")), r"[() ,]", "_")
    out = F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_|_$", "")
    return F.substring(out, 1, 200)


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def markdown_to_text(text: Column, code: bool = False) -> Column:
    """Markdown without heading marks, bold, italic and links; with `code`, without inline code marks."""
    out = F.regexp_replace(text, r"#{1,6}\s", "")
    out = F.regexp_replace(out, r"\*\*(.+?)\*\*", "$1")
    out = F.regexp_replace(out, r"\*(.+?)\*", "$1")
    if code:
        out = F.regexp_replace(out, r"`(.+?)`", "$1")
    return F.regexp_replace(out, r"\[(.+?)\]\(.+?\)", "$1")


def clean_inner(text: Column) -> Column:
    """At most two blank lines in a row, line ends as \\n, no blanks at line ends."""
    out = F.regexp_replace(text, r"\n{4,}", "\n\n\n")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    return F.regexp_replace(out, r"(?md)[ \t\r\f\x0B]+$", "")


def one_end(text: Column) -> Column:
    """One line end at the end."""
    return F.concat(F.regexp_replace(text, r"\n+\z", ""), F.lit("\n"))


def clean_ends(text: Column) -> Column:
    """clean_inner() with one line end at the end."""
    return one_end(clean_inner(text))


def has_front_matter(text: Column) -> Column:
    return F.startswith(strip(text), F.lit("---"))


def front_matter(text: Column) -> Column:
    """What lies between the first three characters and the next ---; null where none follows."""
    end = F.locate("---", text, 4)
    return F.when(end > 0, F.substr(text, F.lit(4), end - 4))


def numbers_of(text: Column, marker: str) -> Column:
    """The numbers of markers such as <!-- page:3 --> in order, as integers."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"<!-- {marker}:(\d+) -->"), F.lit(1)), lambda x: x.cast("long"))


def in_sequence(numbers: Column) -> Column:
    """Are they 1, 2, ... in order? True for none."""
    return F.when(F.size(numbers) == 0, True).otherwise(numbers == F.sequence(F.lit(1).cast("long"), F.greatest(F.size(numbers), F.lit(1)).cast("long")))


def _level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s+.", 1))


def least_level(lines: Column) -> Column:
    """The highest heading's level among an array of lines; null where there is no heading."""
    return F.array_min(F.filter(F.transform(lines, _level), lambda n: n > 0))


def shift_headings(text: Column, least: Column | None = None) -> Column:
    """Heading levels moved up so that the highest is 1. least: the highest's level, if text is a piece of a longer one."""
    moved = lambda x, least: F.when(_level(x) > 0, F.regexp_replace(F.substr(x, least), r"^(#{1,6})\s+(.+)$", "$1 $2")).otherwise(x)

    def whole(parts: Column) -> Column:
        return F.when(F.coalesce(parts["least"], F.lit(1)) > 1, F.array_join(F.transform(parts["lines"], lambda x: moved(x, parts["least"])), "\n")).otherwise(parts["text"])

    top = lambda lines: least_level(lines) if least is None else least
    return let(F.struct(text.alias("text"), F.split(text, "\n").alias("lines")), lambda t: let(F.struct(t["text"].alias("text"), t["lines"].alias("lines"), top(t["lines"]).alias("least")), whole))
