"""Event texts, JSON as Python writes it, and the clean-up of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of an event's keys in tagged text and in generated events.
TAGGED = ("when", "what", "who", "why", "where", "how", "event_id")
GENERATED = ("what", "where", "when", "who", "how", "why", "event_id")
CONTEXT = ("what", "who", "when", "where", "why", "how")


def event_time(when: str) -> Column:
    """A node's time as the texts carry it."""
    return F.date_format(when, "yyyy-MM-dd-HH:mm:ss")


def event_id(seq: str, keywords: str, when: str) -> Column:
    """seq_keyword_keyword_date: keywords split at commas, trimmed, blanks to underscores, in lower case."""
    words = F.lower(F.array_join(F.transform(F.split(keywords, ","), lambda k: F.replace(F.trim(k), F.lit(" "), F.lit("_"))), "_"))
    return F.concat_ws("_", F.col(seq).cast("string"), words, F.date_format(when, "yyyy-MM-dd"))


def tagged_event(event: Column | None = None) -> Column:
    """One event as tagged lines; fields come from a struct, or from the row's own columns."""
    field = (lambda k: F.col(k)) if event is None else (lambda k: event.getField(k))
    names = {"when": "When", "what": "What", "who": "Who", "why": "Why", "where": "Where", "how": "How", "event_id": "ID"}
    lines = [F.concat(F.lit(f"{names[k]}: "), F.coalesce(field(k).cast("string"), F.lit("None")), F.lit("\n")) for k in TAGGED]
    return F.concat(F.lit("<event>\n"), *lines, F.lit("</event>\n"))


def json_string(value: Column) -> Column:
    """A string as Python's json.dumps writes it: control characters and those beyond ASCII as \\uXXXX, in pairs beyond U+FFFF; null is null."""
    text = value.cast("string")
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    high = lambda n: n - 0x10000
    coded = lambda n: F.when(n < 0x10000, unit(n)).otherwise(F.concat(unit(F.shiftright(high(n), 10) + 0xD800), unit(high(n).bitwiseAND(0x3FF) + 0xDC00)))
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    letters = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"[^\x20-\x7e]"), coded(F.ascii(c))).otherwise(c))
    text = F.when(text.rlike(r"[^\x20-\x7e]"), F.array_join(letters, "")).otherwise(text)
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))


def json_object(keys: tuple[str, ...], indent: int | None = None) -> Column:
    """The row's columns `keys` as json.dumps(..., indent=indent) writes them: nulls kept, keys in order."""
    gap, end, between = (F.lit("\n" + " " * indent), F.lit("\n"), F.lit(",\n" + " " * indent)) if indent else (F.lit(""), F.lit(""), F.lit(", "))
    parts: list[Column] = []
    for k, key in enumerate(keys):
        parts += [between] * (k > 0) + [F.lit(f'"{key}": '), json_string(F.col(key))]
    return F.concat(F.lit("{"), gap, *parts, end, F.lit("}"))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def cleaned_answer(text: str | Column) -> Column:
    """A model's answer without code fences, rulers and the word json, wherever they stand, and without outer white space."""
    out = F.col(text) if isinstance(text, str) else text
    for mark in ("```", "json", "---"):
        out = F.replace(out, F.lit(mark), F.lit(""))
    return strip(out)


def prettified(name: str) -> Column:
    """model_name_7b -> Model Name 7B."""
    words = F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))
    return F.regexp_replace(F.array_join(words, " "), "b$", "B")
