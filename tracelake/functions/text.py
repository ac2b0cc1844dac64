"""Scanned text made safe: redaction, table cells, labels, screening."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,255}\.[A-Za-z]{2,24}"
#: A run that begins and ends with a digit and holds nine at least; the second pattern finds what may be such a run.
LONG_NUMBER = r"[0-9][0-9\s.\-]{7,255}[0-9]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
INERT = "ˋ"
MAX_FILE_BYTES = 1_500_000
SNIFF = 8192


def redact(text: Column) -> Column:
    """E-mail addresses and runs with nine digits or more become markers."""
    t = F.regexp_replace(text, EMAIL, "<redacted-email>")
    # The pieces between runs stay; a run is replaced if enough of it is digits.
    runs = F.regexp_extract_all(t, F.lit(f"({LONG_NUMBER})"), 1)
    between = F.split(t, LONG_NUMBER, -1)
    shown = F.transform(runs, lambda r: F.when(F.length(F.regexp_replace(r, "[^0-9]", "")) >= 9, "<redacted-number>").otherwise(r))
    both = F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.get(shown, i), F.lit(""))))
    return F.array_join(both, "")


def table_cell(value: Column) -> Column:
    """Text that stays inside its cell of a Markdown table."""
    t = F.regexp_replace(value, r"[\r\n\t\x0b\f]", " ")
    t = F.regexp_replace(t, CONTROL, "")
    # A run of three backticks or more loses its meaning, shorter ones stay.
    t = F.regexp_replace(t, "`(?=``)|(?<=`)`(?=`)|(?<=``)`", INERT)
    return F.replace(t, F.lit("|"), F.lit("\\|"))


def _shortened(text: Column, most: int) -> Column:
    if not most:
        return text
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most - 1), r"\s+$", ""), F.lit("…"))).otherwise(text)


def markdown(value: Column, most: int = 200) -> Column:
    return _shortened(F.replace(table_cell(value), F.lit("`"), F.lit(INERT)), most)


def mermaid_label(value: Column, most: int = 40) -> Column:
    t = F.regexp_replace(F.regexp_replace(value, r"[\r\n\t\x0b\f]", " "), CONTROL, "")
    return _shortened(F.regexp_replace(t, r"[\"\[\]{}()|`]", ""), most)


def trace_slug(repo: Column, path: Column) -> Column:
    """A file name's stem for the trace of a repository's path."""
    own = F.replace(F.regexp_replace(path, "^/+|/+$", ""), F.lit("/"), F.lit("-"))
    own = F.regexp_replace(F.when(own == "", "root").otherwise(own), "[^A-Za-z0-9._-]+", "-")
    return F.concat(F.replace(repo, F.lit("/"), F.lit("-")), F.lit("-"), own)


def skip_reason(text: Column, indicators: list[str] | None = None, longest: int = 50_000, share: float = 0.10) -> Column:
    """Why a file is not scanned, or null: binary content, oversized lines, or an indicator of the operator's."""
    head = F.substring(text, 1, SNIFF)
    odd = F.length(head) - F.length(F.replace(head, F.lit("�"), F.lit("")))
    out = F.when(F.contains(head, F.lit("\x00")), "binary content (null byte)").when((F.length(head) > 0) & (odd / F.length(head) > share), "binary or non-UTF-8 content")
    if longest:
        out = out.when(F.exists(F.split(text, r"\r\n|\r|\n", -1), lambda x: F.length(x) > longest), f"oversized line (> {longest} bytes)")
    for word in indicators or []:
        out = out.when(F.contains(F.lower(text), F.lit(word.lower())), f"matched configured indicator: {word.lower()[:40]}")
    return out


def node_slug(family: Column, kind: Column, line: Column, symbol: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", family, kind, line.cast("string"), F.coalesce(symbol, F.lit(""))), 256), 1, 12)


def node_id(repo: Column, file: Column, line: Column, family: Column, kind: Column, symbol: Column) -> Column:
    return F.concat_ws(":", repo, file, line.cast("string"), family, kind, node_slug(family, kind, line, symbol))


def line_of_offset(text: Column, offset: Column) -> Column:
    """The line (from 1) of a place (from 0) in a text."""
    before = F.substr(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
