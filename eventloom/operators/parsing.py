"""Model answers as columns: JSON of a strict shape, tagged events, plain labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.text import GENERATED, cleaned_answer, strip


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _object(text: Column) -> Column:
    """The JSON object of a text as a variant; null for anything else."""
    whole = F.try_parse_json(text)
    return F.when(_kind(whole).startswith("OBJECT"), whole)


def link_answer(answer: str | Column) -> Column:
    """struct<success, link, explanation>: the cleaned answer must be an object whose `link`, if there, is a boolean and whose `explanation`, if there, is a string."""
    whole = _object(cleaned_answer(answer))
    link, text = (F.try_variant_get(whole, f"$.{k}", "variant") for k in ("link", "explanation"))
    good = whole.isNotNull() & (link.isNull() | (_kind(link) == "BOOLEAN")) & (text.isNull() | (_kind(text) == "STRING"))
    good = F.coalesce(good, F.lit(False))
    return F.struct(good.alias("success"), F.when(good, F.coalesce(F.try_variant_get(whole, "$.link", "boolean"), F.lit(False))).otherwise(False).alias("link"), F.when(good, F.coalesce(F.try_variant_get(whole, "$.explanation", "string"), F.lit(""))).otherwise("").alias("explanation"))


def repaired(answer: Column) -> Column:
    """An answer that breaks off after true or false gets its closing brace."""
    return F.when(answer.rlike(r"(true|false)$"), F.concat(answer, F.lit("}"))).otherwise(answer)


EXTRACTED = ("keywords", "what", "who", "why", "how")


def extraction(answer: str | Column, published: Column) -> Column:
    """struct<success, keywords, what, who, why, how, where (JSON text), when>: an object with text fields, missing ones empty; `when` is the publication date. An empty object, or a field of another type, is no success."""
    whole = _object(cleaned_answer(answer))
    fields = {k: F.try_variant_get(whole, f"$.{k}", "variant") for k in EXTRACTED}
    where = F.try_variant_get(whole, "$.where", "variant")
    good = whole.isNotNull() & (_kind(whole) != "OBJECT<>")
    for value in fields.values():
        good = good & (value.isNull() | (_kind(value) == "STRING"))
    good = F.coalesce(good, F.lit(False))
    texts = [F.when(good, F.coalesce(F.try_variant_get(whole, f"$.{k}", "string"), F.lit(""))).alias(k) for k in EXTRACTED]
    return F.struct(good.alias("success"), *texts, F.when(good, F.coalesce(F.to_json(where), F.lit("{}"))).alias("where"), F.when(good, F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss")).alias("when"))


def tagged_events(text: str | Column) -> Column:
    """array<map<string, string>>: each <event> block's lines as key and value around the first colon; keys in lower case, id as event_id; a line without a colon has an empty value, the last of equal keys wins."""
    text = F.col(text) if isinstance(text, str) else text

    def fields(block: Column) -> Column:
        lines = F.filter(F.split(strip(block), "\n"), lambda line: strip(line) != "")
        key = lambda line: F.lower(strip(F.substring_index(line, ":", 1)))
        pair = F.transform(lines, lambda line: F.struct(F.when(key(line) == "id", "event_id").otherwise(key(line)).alias("k"), F.when(F.contains(line, F.lit(":")), strip(F.regexp_replace(line, "^[^:]*:", ""))).otherwise("").alias("v")))
        last = F.filter(pair, lambda p, i: ~F.exists(F.slice(pair, i + 2, F.greatest(F.size(pair) - i - 1, F.lit(0))), lambda q: q.k == p.k))
        return F.map_from_entries(last)

    return F.transform(F.regexp_extract_all(text, F.lit("(?s)<event>(.*?)</event>"), 1), fields)


def json_event(text: str | Column) -> Column:
    """map<string, string>: the first JSON object in a model's answer, code fences left out; values that are no strings as JSON; null where there is none."""
    text = F.regexp_extract(cleaned_answer(text), r"(?s)\{.*\}", 0)
    fields = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    return F.transform_values(fields, lambda k, v: F.when(~F.is_variant_null(v), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))))


def is_event(fields: Column) -> Column:
    """All seven keys are there; their values may be null or empty."""
    out = F.lit(True)
    for key in GENERATED:
        out = out & F.map_contains_key(fields, key)
    return out


def missing_keys(fields: Column) -> Column:
    """The keys that an event lacks, sorted."""
    return F.array_sort(F.array_except(F.array(*[F.lit(k) for k in GENERATED]), F.map_keys(fields)))


def standard_event(fields: Column) -> Column:
    """A valid event's fields in their fixed order; null for others."""
    return F.when(is_event(fields), F.struct(*[F.try_element_at(fields, F.lit(k)).alias(k) for k in GENERATED]))


def naive_label(text: str, default: bool | None = False) -> Column:
    """true or false by the words in a text, true first."""
    low = F.lower(F.col(text))
    return F.when(F.contains(low, F.lit("true")), True).when(F.contains(low, F.lit("false")), False).otherwise(F.lit(default).cast("boolean"))


def after_last(text: str, marker: str) -> Column:
    """What follows the last marker; all of the text without one."""
    return F.substring_index(F.col(text), marker, -1)
