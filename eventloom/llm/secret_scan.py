"""Secret scans: fixed patterns, and an assignment-aware lexer for what they miss.

The lexer reads source and configuration syntax into pairs of a name and the terms assigned to it: `name = "x"`, `name: str = "x"`, `name := 'x'`,
`"name": "x"`, `name => "x"`, `conf["name"] = "x"`, `<name>x</name>`, and `NAME=x` or `name: x` on a line of their own. Terms are string
literals, bare values and names, joined by `+`; a name stands for the literals that the text last gave it (constants are
propagated in the order of the text), and so does `${NAME}`. What a pair says is scored by how sensitive its name is and how secret its value looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order in which they are listed, and the patterns of those that every scan reports.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

# Possessive quantifiers (`*+`) keep every pattern linear in the text: what a name or a string took is never given back.
_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*+(?:(?:\.|->|::|-)[A-Za-z_$][A-Za-z0-9_$]*+)*+"
_STRING = r"""[bBrRuUfF]{0,2}(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`)"""
_BARE = r"""[^\s"'`,;(){}\[\]<>+]++"""
_TERM = f"(?:{_STRING}|{_BARE})"
_PAIR = re.compile(rf"""(?<![A-Za-z0-9_$.>:-])(?:(?P<quote>["'])(?P<key>{_NAME})(?P=quote)\]?|(?P<name>{_NAME}))[\x20\t]*+(?::[\x20\t]*+[A-Za-z_][\w.|]*+(?:\[[\w.,|\x20]*+\])?[\x20\t]*+=(?![=~])|:=|=>|=(?![=~>])|:(?![:/=]))[\x20\t]*+(?P<value>{_TERM}(?:[\x20\t]*+\+[\x20\t]*+{_TERM})*+)""")
_TAG = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)>(?P<value>[^<>\s]++)</(?P=name)>")
_TERMS, _IS_NAME, _REFERENCE = re.compile(_TERM), re.compile(_NAME), re.compile(r"\$\{?([A-Za-z_][A-Za-z0-9_.]*+)\}?")
_QUOTED = re.compile(r"""[bBrRuUfF]{0,2}(["'`])""")
_LINE_START = re.compile(r"^[\x20\t]*+(?:-[\x20\t]++)?(?:export[\x20\t]++|set[\x20\t]++)?", re.MULTILINE)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: How sensitive a word of a name makes it; words that do so only beside `key`; last words that name something about a secret instead; values that stand for one.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pass": 0.7, "secret": 1.0, "secrets": 1.0, "token": 1.0, "credential": 1.0, "credentials": 1.0, "apikey": 1.0, "auth": 0.7, "authorization": 0.8, "bearer": 0.9, "pin": 0.6}
KEY_WORDS = frozenset({"access", "account", "api", "app", "auth", "client", "consumer", "encryption", "license", "master", "private", "secret", "service", "shared", "signing", "ssh", "storage"})
ABOUT = frozenset({"count", "expiry", "expires", "field", "file", "hint", "id", "label", "length", "limit", "max", "message", "min", "name", "path", "pattern", "policy", "regex", "size", "ttl", "type", "uri", "url"})
STANDS_FOR = re.compile(r"(?i)example|change_?me|placeholder|dummy|redacted|your[_-]|^x{3,}|\*{3,}|\.{3,}|<.*>|\{\{|\$\{|%\(|^(?:null|none|true|false|undefined|string|process\.env.*|os\.environ.*)$")


@dataclass(frozen=True)
class Pair:
    """A name, what it was given, the places of the literals that this is made of, and whether one of them was quoted."""

    name: str
    value: str
    places: tuple[tuple[int, int], ...]
    quoted: bool


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind, by start, then kind; matches that are too short consume their text."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [(m.start(), k, m.end()) for k, pattern in ((1, ACCESS), (2, HEX)) for m in pattern.finditer(text) if m.end() - m.start() >= LEAST[KINDS[k]]]
    return sorted(out)


def assignments(text: str) -> list[Pair]:
    """All pairs of a text in its order, names in their values replaced by the literals that they stand for at that place."""
    known: dict[str, Pair] = {}
    out = []
    heads = {m.end() for m in _LINE_START.finditer(text)}  # where a line's first name may stand
    found = sorted([*_PAIR.finditer(text), *_TAG.finditer(text)], key=lambda m: m.start()) if "</" in text else _PAIR.finditer(text)
    for m in found:
        groups = m.groupdict()
        name = groups.get("key") or groups["name"]
        tag = "key" not in groups
        whole = tag or groups["key"] is not None or m.start() in heads
        value, places, quoted, fixed = [], [], False, True
        for term in _TERMS.finditer(text, m.start("value"), m.end("value")):
            said, mark = term[0], _QUOTED.match(term[0])
            low, high = term.start() + (mark.end() if mark else 0), term.end() - (1 if mark else 0)
            inner = text[low:high]
            reference = _REFERENCE.fullmatch(inner)
            same = known.get(reference[1] if reference else inner.rsplit(".", 1)[-1]) if reference or not mark and _IS_NAME.fullmatch(said) else None
            if same is not None:
                value.append(same.value)
                places.extend(same.places)
                quoted |= same.quoted
            elif mark or whole and not inner.endswith((":", "=")):
                value.append(inner)
                places.append((low, high))
                quoted |= mark is not None
            else:
                fixed = False
        if fixed and value:
            pair = Pair(name, "".join(value), tuple(dict.fromkeys(places)), quoted)
            known[re.split(r"\.|->|::", name)[-1]] = pair
            out.append(pair)
        else:
            known.pop(re.split(r"\.|->|::", name)[-1], None)  # what it stood for is over
    return out


def sensitivity(name: str) -> float:
    """0 to 1: how likely the name's words make what it holds a secret."""
    words = [w.lower() for w in _PARTS.findall(name)]
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    joined = {a + b for a, b in zip(words, words[1:], strict=False)}
    if "apikey" in joined or any(b in ("key", "keys") and a in KEY_WORDS for a, b in zip(words, words[1:], strict=False)):
        best = 1.0
    elif words and words[-1] in ("key", "keys"):
        best = max(best, 0.4)
    return best * (0.3 if words and words[-1] in ABOUT else 1.0)


def secrecy(value: str, quoted: bool) -> float:
    """0 to 1: how much the value looks like a secret: its length times the entropy of its letters, more kinds of letters telling more."""
    n = len(value)
    if n < 6 or STANDS_FOR.search(value) or any(c.isspace() for c in value):
        return 0.0
    bits = sum(-k * math.log2(k / n) for k in Counter(value).values())
    kinds = (any(c.islower() for c in value)) + any(c.isupper() for c in value) + any(c.isdigit() for c in value) + any(not c.isalnum() for c in value)
    if kinds < 2 or not quoted and (n < 8 or not any(c.isdigit() for c in value)):
        return 0.0  # a word, as prose has after a colon
    return min(1.0, bits / 20) * (0.7 if kinds == 2 and not any(c.isdigit() for c in value) else 1.0)


def scan_text(text: str, least: float = 0.6) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    """(base spans, literals that the pairs give away: (start, kind, end, score), outside of the base spans)."""
    base = base_spans(text)
    scored: dict[tuple[int, int], float] = {}
    for pair in assignments(text) if "=" in text or ":" in text or "</" in text else ():
        if (score := sensitivity(pair.name)) >= least and (score := score * secrecy(pair.value, pair.quoted)) >= least:
            for place in pair.places:
                scored[place] = max(scored.get(place, 0.0), score)
    literals, at, reach = [], 0, -1
    for (low, high), score in sorted(scored.items()):
        while at < len(base) and base[at][0] <= low:
            reach = max(reach, base[at][2])
            at += 1
        if high > reach and high > low:
            literals.append((low, 3, high, score))
    return base, literals


def _said(spans: list) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, *_ in spans)


def scan_secrets(docs: DataFrame, least: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_assign, n_access, n_hex, base_sha256, spans, n_literal, score.

    The first three count the fixed patterns (of kind assign, access and hex), base_sha256 is the SHA-256 of their spans `kind:start:end`, by start, then
    kind, comma-joined; places count code points, ends are exclusive. spans lists them together with the literals that assignments to sensitive names give away
    (kind literal: a score of `least` or more, and not within a span of a fixed pattern); n_literal counts those, score is the best of their scores (0: none).
    A null text counts as empty. Texts are scanned whole, one at a time, in time linear in their length but for sorting what was found. Repeated rows and null
    ids stay; other columns are not read; an empty table gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, literals = scan_text(text.as_py() or "", least)
                n = Counter(kind for _, kind, _ in base)
                rows.append((n[0], n[1], n[2], hashlib.sha256(_said(base).encode()).hexdigest(), _said(sorted([*base, *literals])), len(literals), max((x[3] for x in literals), default=0.0)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(scan, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long, score double").withColumnRenamed("id", id_col)
