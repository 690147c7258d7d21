"""Column expressions on text: lengths, titles, fences, escaping, cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CONTROL, DEFAULT_TITLE, HEADING_ROLES, MAX_TITLE, PREVIEW, SPACE, UNSAFE


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def utf16_length(c: Column) -> Column:
    return F.octet_length(F.encode(c, "UTF-16BE")) / 2


def utf16_order(c: Column) -> Column:
    """A key that sorts as UTF-16 code units do, which plain string order does not above U+FFFF."""
    return F.encode(c, "UTF-16BE")


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def has_control(c: Column) -> Column:
    return c.rlike(CONTROL)


def has_unsafe(c: Column) -> Column:
    """Control characters other than tab, line feed and carriage return."""
    return c.rlike(UNSAFE)


def truncate_title(c: Column) -> Column:
    return F.left(c, F.lit(MAX_TITLE))


def title_of(transcript: Column) -> Column:
    """The first line that says something other than a role, without leading hashes, cut to the title limit."""
    lines = F.transform(F.split(transcript, r"\r?\n"), lambda x: trim_space(F.regexp_replace(x, f"^#+{SPACE}*", "")))
    told = F.filter(lines, lambda x: (F.length(x) > 0) & ~F.lower(x).isin(*HEADING_ROLES))
    return truncate_title(F.coalesce(F.try_element_at(told, F.lit(1)), F.lit(DEFAULT_TITLE)))


def is_valid_title(c: Column) -> Column:
    return c.isNotNull() & F.char_length(c).between(1, MAX_TITLE) & ~has_control(c)


def is_relative_path(c: Column) -> Column:
    """Whether a text is a relative path of plain segments."""
    parts = F.split(c, r"[\\/]")
    return utf16_length(c).between(1, 512) & ~has_control(c) & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def is_text(c: Column, most: int) -> Column:
    """Whether a text has 1 to ``most`` UTF-16 units and no control characters; null has not."""
    return F.coalesce(utf16_length(c).between(1, most) & ~has_control(c), F.lit(False))


def close_fence(content: Column) -> Column:
    """Content with a closer for a Markdown fence that is open at its end.

    A fold over lines: the state is the open fence's run of markers, empty
    outside a fence.
    """
    fence = r"^ {0,3}(`{3,}|~{3,})(.*)$"

    def step(state: Column, line: Column) -> Column:
        run, rest = F.regexp_extract(line, fence, 1), F.regexp_extract(line, fence, 2)
        opens = (state == "") & (run != "") & ~(run.startswith("`") & rest.contains("`"))
        closes = (state != "") & (F.left(run, F.lit(1)) == F.left(state, F.lit(1))) & (F.length(run) >= F.length(state)) & rest.rlike(r"^[ \t]*$")
        return F.when(opens, run).when(closes, F.lit("")).otherwise(state)

    left_open = F.aggregate(F.split(content, r"\r?\n"), F.lit(""), step)
    return F.when(left_open == "", content).otherwise(F.concat(content, F.when(content.endswith("\n"), "").otherwise("\n"), left_open))


def role_heading(role: Column) -> Column:
    return F.concat(F.lit("## "), F.upper(F.left(role, F.lit(1))), F.substring(role, 2, 1_000_000))


def escape_html(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def safe_text(c: Column) -> Column:
    return escape_html(F.regexp_replace(c, UNSAFE, "�"))


def safe_attribute(c: Column) -> Column:
    return escape_html(F.regexp_replace(c, CONTROL, "�"))


def safe_line(c: Column) -> Column:
    return trim_space(F.regexp_replace(F.regexp_replace(c, CONTROL, "�"), f"{SPACE}+", " "))


def preview(c: Column, limit: int = PREVIEW) -> Column:
    note = "\n\n[Shortened here. The archive holds the whole message.]"
    return F.concat(F.left(c, F.lit(limit)), F.when(F.char_length(c) > limit, F.lit(note)).otherwise(""))


def one_line(c: Column) -> Column:
    return F.regexp_replace(c, r"\r?\n", " ")


def excerpt(content: Column, start: Column, stop: Column) -> Column:
    """Characters [start, stop) of content on one line, with an ellipsis where it is cut."""
    start, stop = F.greatest(start, F.lit(0)), F.least(stop, F.char_length(content))
    body = one_line(F.substr(content, start + 1, stop - start))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(stop < F.char_length(content), "…").otherwise(""))


def head_bytes(content: Column, limit: Column) -> Column:
    """The longest prefix of whole code points within ``limit`` UTF-8 bytes.

    The byte prefix is taken and at most three bytes of a broken character are
    given back.
    """
    raw = F.encode(content, "UTF-8")
    limit = F.greatest(limit, F.lit(0)).cast("int")
    cuts = F.array(*[F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(limit - i, F.lit(0)))) for i in range(4)])
    return F.when(F.octet_length(content) <= limit, content).otherwise(F.coalesce(F.try_element_at(F.filter(cuts, lambda x: x.isNotNull()), F.lit(1)), F.lit("")))


def tail_bytes(content: Column, limit: Column) -> Column:
    """The longest suffix of whole code points within ``limit`` UTF-8 bytes."""
    raw = F.encode(content, "UTF-8")
    limit = F.greatest(limit, F.lit(0)).cast("int")
    size = F.octet_length(content)
    cuts = F.array(*[F.try_validate_utf8(F.substring(raw, size - limit + 1 + i, F.greatest(limit - i, F.lit(0)))) for i in range(4)])
    return F.when(size <= limit, content).otherwise(F.coalesce(F.try_element_at(F.filter(cuts, lambda x: x.isNotNull()), F.lit(1)), F.lit("")))
