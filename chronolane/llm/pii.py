"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, plus-signs, digits, URL schemes and
identifier or street cues. Local parsers expand each anchor to its boundaries and validate what they
read; nothing else of the text is looked at again. Offsets are code points, ends exclusive.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of their patterns; a
match that fails its check is dropped and not tried again. Added kinds: `url` (scheme and what
follows up to white space or a closing mark), `account` (identifier after a cue, with at least four
digits) and `address` (house number next to a street cue). Null and empty texts have no span; repeated rows are read each, long
texts whole; an empty table gives an empty one, and other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

KINDS = ("email", "ip", "card", "phone", "url", "account", "address")
BASE = KINDS[:4]
# What starts a URL, an identifier, and an address line.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "token", "api_key", "apikey", "secret", "konto", "compte", "cuenta")
STREET_CUES = ("street", "avenue", "boulevard", "straße", "strasse", "rue ", "calle ")

DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
DIAL = DIGITS | frozenset(" ().-")
IDENT = LETTERS | DIGITS | frozenset("-_")
#: Marks between a street cue and a number, and the longest word that may be a street's name.
MARKS, NAME = frozenset(" ,."), 40
BREAKS = frozenset(" \t\n\v\f\r\"'<>|")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), *((d, "d") for d in sorted(DIGITS))]:
        found.add_word(word, (kind, 1))
    for words, kind in ((SCHEMES, "url"), (ACCOUNT_CUES, "account"), (STREET_CUES, "address")):
        for word in words:
            for form in {word, word.capitalize(), word.upper()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def run_end(text: str, at: int, allowed: frozenset, most: int | None = None) -> int:
    n = len(text) if most is None else min(len(text), at + most)
    while at < n and text[at] in allowed:
        at += 1
    return at


def run_start(text: str, at: int, allowed: frozenset, floor: int) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def parse_email(text: str, sign: int, floor: int) -> tuple[int, int] | None:
    start = run_start(text, sign, LOCAL, floor)
    end = run_end(text, sign + 1, LABEL)
    if start == sign or end == sign + 1:
        return None
    last = end
    while last < len(text) and text[last] == ".":
        more = run_end(text, last + 1, LABEL)
        if more == last + 1:
            break
        last = more
    return (start, last) if last > end else None


def parse_ip(text: str, start: int) -> tuple[int, bool] | None:
    """End of four dotted numbers, and whether each is at most 255."""
    at = run_end(text, start, DIGITS)
    parts = [text[start:at]]
    while len(parts) < 4:
        if at >= len(text) or text[at] != ".":
            return None
        end = run_end(text, at + 1, DIGITS)
        if end == at + 1:
            return None
        parts.append(text[at + 1 : end])
        at = end
    return at, all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in parts))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def parse_card(text: str, start: int) -> tuple[int, bool] | None:
    at, digits, n = start + 1, [text[start]], len(text)
    while at < n:
        step = 1 if text[at] in " -" else 0
        if at + step < n and text[at + step] in DIGITS:
            digits.append(text[at + step])
            at += step + 1
        else:
            break
    if len(digits) < 2:
        return None
    return at, 13 <= len(digits) <= 19 and luhn("".join(digits))


def parse_phone(text: str, plus: int) -> tuple[int, bool] | None:
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = run_end(text, plus + 2, DIAL)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end < plus + 4 or text[end - 1] not in DIGITS:
        return None
    return end, 9 <= sum(c in DIGITS for c in text[plus:end]) <= 15


def parse_account(text: str, at: int) -> tuple[int, int] | None:
    """The identifier after a cue that ends at `at`, past at most six marks or blanks."""
    start = at
    while start < min(len(text), at + 6) and text[start] in " :=#\"'":
        start += 1
    if start == at:
        return None
    end = run_end(text, start, IDENT)
    ident = text[start:end]
    return (start, end) if 6 <= len(ident) and sum(c in DIGITS for c in ident) >= 4 else None


def parse_address(text: str, start: int, end: int) -> tuple[int, int] | None:
    """From a house number shortly before the cue, or to one shortly after it; words of over NAME characters are not passed."""
    before = start
    for _ in range(2):  # at most the street's name and the number
        while before > 0 and text[before - 1] == " ":
            before -= 1
        word = run_start(text, before, IDENT, max(0, before - NAME - 1))
        token = text[word:before]
        if token and len(token) <= 5 and all(c in DIGITS for c in token):
            return word, end
        if len(token) > NAME:
            break
        before = word
    after = end
    for _ in range(2):
        after = run_end(text, after, MARKS)
        stop = run_end(text, after, IDENT, NAME + 1)
        token = text[after:stop]
        if token and len(token) <= 5 and all(c in DIGITS for c in token):
            return start, stop
        if len(token) > NAME:
            break
        after = stop
    return None


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by kind and then start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)  # where each kind may begin again
    ip_run = 0
    for last, (kind, size) in automaton().iter(text):
        at = last - size + 1
        if kind == "@":
            if (got := parse_email(text, at, free["email"])) is not None:
                spans["email"].append(got)
                free["email"] = got[1]
        elif kind == "+":
            if at >= free["phone"] and (got := parse_phone(text, at)) is not None:
                free["phone"] = got[0]
                if got[1]:
                    spans["phone"].append((at, got[0]))
        elif kind == "d":
            if at >= ip_run:
                if (got := parse_ip(text, at)) is not None:
                    ip_run = got[0]
                    if got[1]:
                        spans["ip"].append((at, got[0]))
                else:
                    ip_run = run_end(text, at, DIGITS)
            if at >= free["card"] and (got := parse_card(text, at)) is not None:
                free["card"] = got[0]
                if got[1]:
                    spans["card"].append((at, got[0]))
        elif kind == "url":
            if at >= free["url"]:
                end = last + 1
                while end < len(text) and text[end] not in BREAKS:
                    end += 1
                if end > last + 1:
                    spans["url"].append((at, end))
                    free["url"] = end
        elif kind == "account":
            if at >= free["account"] and (got := parse_account(text, last + 1)) is not None:
                spans["account"].append(got)
                free["account"] = got[1]
        elif at >= free["address"] and (got := parse_address(text, at, last + 1)) is not None and got[0] >= free["address"]:
            spans["address"].append(got)
            free["address"] = got[1]
    return [(k, a, b) for k in KINDS for a, b in spans[k]]


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, longest one names the whole."""
    if not spans:
        return text
    joined: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if joined and a < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], b)
        else:
            joined.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in joined:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, the count of each base kind, base_sha256 and all spans, a row for each row of docs(doc_id, text)."""
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [find(x or "") for x in batch.column("text").to_pylist()]
            base = [[s for s in f if s[0] in BASE] for f in found]
            counts = [pa.array([sum(s[0] == k for s in f) for f in base], pa.int64()) for k in BASE]
            digest = pa.array([hashlib.sha256(spelled(f).encode()).hexdigest() for f in base])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array([spelled(f) for f in found], pa.string())], names)

    schema = docs.select("doc_id").schema
    for name in names[1:]:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its column `text` masked; other columns stay. Null stays null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            clean = [x if x is None else masked(x, find(x)) for x in batch.column(text).to_pylist()]
            columns = [pa.array(clean, batch.column(c).type) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
