"""Column functions on text. All patterns use explicit classes: ``\\s`` and ``\\w`` differ between engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's ``str.split`` sees it (U+3000 included, U+200B not).
WS = r"\x09-\x0d\x1c-\x20\x85\p{Z}"


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text; never null."""
    return ~F.coalesce(text.rlike(f"[^{WS}]"), F.lit(False))


def collapse_ws(text: Column) -> Column:
    """Runs of white space become one space, ends are trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def fold_caption(text: Column) -> Column:
    """Letters and numbers only, case folded (``lower`` plus the two folds it lacks in common scripts)."""
    return F.regexp_replace(F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ")), r"[^\p{L}\p{N}]+", "")


def escape_markup(text: Column) -> Column:
    """Ampersand and angle brackets as entities; quotes stay."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def clean_lines(lines: Column) -> Column:
    """The text of a cue's lines without tags, style blocks, entities and direction marks, joined by spaces; a line equal
    to the one before is skipped."""
    from cuelake.functions.udfs import unescaped

    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\{\\[^}]+\}", ""))
    shown = F.filter(F.transform(unescaped(bare), lambda x: collapse_ws(F.translate(x, "\u200e\u200f", ""))), lambda x: x != "")
    return F.array_join(without_repeats(shown), " ")


def clean_cue(text: Column) -> Column:
    """``clean_lines`` of a text with any line ends."""
    return clean_lines(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"))


def without_repeats(values: Column) -> Column:
    """An array without elements that equal the one right before them."""
    return F.filter(F.zip_with(values, F.concat(F.array(F.lit(None).cast("string")), values), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() & ~p["x"].eqNullSafe(p["y"])).getField("x")


def bounded(text: Column, most: int = 180) -> Column:
    """One line of at most ``most`` characters, cut ones ending in three dots."""
    flat = collapse_ws(text)
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 3)), F.lit("..."))).otherwise(flat)


def one_line_error(text: Column, kind: str = "Error") -> Column:
    """An error's message on one line, or its kind."""
    return F.coalesce(F.nullif(collapse_ws(text), F.lit("")), F.lit(kind))


def normal_url(url: Column, is_file: Column | None = None) -> Column:
    """Trimmed where it is a URL of a known scheme and not the name of a file that exists (``is_file``), else as it is."""
    named = F.coalesce(is_file, F.lit(False)) if is_file is not None else F.lit(False)
    return F.when(url.rlike(r"^\s*(?i:https?|file):") & ~named, F.trim(url)).otherwise(url)


def required_input(value: Column) -> Column:
    """The value; a blank one fails the query, as a list of inputs with a hole in it is a mistake of the caller."""
    return F.when(is_blank(value), F.raise_error(F.lit("inputs must not be blank")).cast("string")).otherwise(value)


#: Steps of a search by halves over any string's length.
_HALVINGS = 31


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two captions, without leaving the JVM: equality of prefixes, searched by halves."""
    bounds = F.struct(F.lit(0).alias("lo"), F.least(F.length(a), F.length(b)).alias("hi"))

    def halve(x: Column, _: Column) -> Column:
        middle = F.ceil((x["lo"] + x["hi"]) / 2).cast("int")
        same = F.left(a, middle) == F.left(b, middle)
        return F.when(x["lo"] >= x["hi"], x).otherwise(F.struct(F.when(same, middle).otherwise(x["lo"]).alias("lo"), F.when(same, x["hi"]).otherwise(middle - 1).alias("hi")))

    return F.left(a, F.aggregate(F.sequence(F.lit(1), F.lit(_HALVINGS)), bounds, halve, lambda x: x["lo"]))


def agreed_start(a: Column, b: Column) -> Column:
    """What two doubtful readings share at the start, if they differ in short ends only, else empty."""
    p = common_prefix(a, b)
    core = F.rtrim(p)
    left, right = F.trim(F.substr(a, F.length(p) + 1)), F.trim(F.substr(b, F.length(p) + 1))
    shorter = F.least(F.length(fold_caption(a)), F.length(fold_caption(b)))
    ok = (core != "") & (left != "") & (right != "") & (left != right) & (F.length(left) <= 2) & (F.length(right) <= 2) & (shorter >= 4)
    return F.when(ok & (F.length(fold_caption(core)) >= 0.8 * shorter), core).otherwise("")
