"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, numbers and private-use characters; all else separates.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


@lru_cache(1)
def _folds() -> tuple[str, str]:
    """Composed characters and the base letters that are left of them without combining marks."""
    pairs = []
    for point in range(0xC0, 0x10000):
        char = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if base != char and len(base) == 1 and unicodedata.category(char)[0] == "L":
            pairs.append((char, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without combining marks; letters that are no composition (ß, ł, ø, æ) stay."""
    return F.regexp_replace(F.translate(F.lower(text), *_folds()), r"\p{Mn}+", "")


def fold_plain(text: str) -> str:
    """fold for a string on the driver."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Split at white space after . ! or ?, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def bounded_id(value: Column, limit: int = 128, head: int = 110) -> Column:
    """Values over the limit, or that look as if they had been cut, become a cut with a digest."""
    cut = F.concat(F.lit("…"), F.substring(value, 1, head), F.lit("-"), F.substring(F.sha2(value, 256), 1, 16))
    return F.when((F.length(value) <= limit) & ~F.startswith(value, F.lit("…")), value).otherwise(cut)


def utc(ts: Column) -> Column:
    """A timestamp of text that begins with a year; null where it can't be read. Text without an offset is in UTC, whatever the session's zone."""
    bare = ~ts.rlike(r"(?:[Zz]|[+-]\d{2}(?::?\d{2})?)$") | ts.rlike(r"^\d{4}-\d{1,2}(?:-\d{1,2})?$")
    whole = F.when(ts.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat(ts, F.lit("T00:00:00Z"))).when(bare & ts.rlike(r"\d:\d"), F.concat(ts, F.lit("Z"))).otherwise(ts)
    return F.when(ts.rlike(r"^\d{4}-"), F.try_to_timestamp(whole))


def utc_format(at: Column, form: str) -> Column:
    """A timestamp's wall clock in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), form)


def recall_line(text: Column, width: int = 160) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, width)


def label(text: Column, width: int = 120) -> Column:
    """One line of at most width characters, cut at a space where there is one."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    head = F.substring(flat, 1, width - 1)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.concat(F.when(F.instr(head, " ") > 0, F.rtrim(F.substring(head, F.lit(1), at))).otherwise(head), F.lit("…"))
    return F.when(flat == "", "(no visible text)").when(F.length(flat) <= width, flat).otherwise(cut)


#: Path-shaped text: separators with bounded names between them, ending in a name with a suffix or a directory.
PATH = r"(?:[A-Za-z]:)?(?:[~.]{0,2}/)?(?:[A-Za-z0-9_.@+-]{1,255}+/){1,32}[A-Za-z0-9_.@+-]{1,255}"


def paths(text: Column) -> Column:
    """Distinct path-shaped substrings in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PATH), F.lit(0)))


def split_of(key: Column) -> Column:
    """dev or test by the last hex digit of the key's sha256."""
    return F.when(F.conv(F.right(F.sha2(key, 256), F.lit(1)), 16, 10).cast("int") % 2 == 0, "dev").otherwise("test")


#: Controls, bidirectional marks and other characters that can't be seen.
UNSAFE = "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f\\x{ad}\\x{180e}\\x{2060}\\x{feff}\\x{61c}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}\\x{2028}\\x{2029}\\x{2061}-\\x{2064}\\x{fff9}-\\x{fffb}\\x{e0000}-\\x{e007f}]"


def safe_text(text: Column) -> Column:
    """Text in which unsafe characters are spelled out (\\x below U+0100, else \\u): each character that occurs is looked at once."""
    spell = lambda c: F.when(F.ascii(c) < 256, F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(c))), 2, "0"))).otherwise(F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0")))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(UNSAFE), F.lit(0)))
    return F.when(text.rlike(UNSAFE), F.aggregate(found, text, lambda t, c: F.replace(t, c, spell(c)))).otherwise(text)


def looks_failed(native: Column, text: Column) -> Column:
    """Whether a tool's result is a failure: what it says of itself, else exit codes, counts and phrases."""
    said = F.get_json_object(native, "$.is_error")
    guess = text.rlike(r"(?i)\bexit(?:ed with)? (?:code|status) [1-9]|\b[1-9]\d* (?:failed|errors?)\b|\btraceback \(most recent call last\)|\bcommand not found\b|\bfatal: ")
    return F.coalesce(said == "true", guess, F.lit(False))


def qa_verdict(answer: Column) -> Column:
    """A judge's yes or no: of a JSON object its correct field, else whether the text says yes."""
    field = F.lower(F.get_json_object(F.regexp_extract(answer, r"(\{[^{}]*\})", 1), "$.correct"))
    return F.coalesce(field.isin("true", "yes"), F.contains(F.lower(answer), F.lit("yes")), F.lit(False))
