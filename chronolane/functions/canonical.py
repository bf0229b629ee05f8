"""Canonical text and JSON. Only what built-in functions cannot say is a pandas function."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .times import col


def sha256_id(text: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(text), 256))


def ascii_alias(text: Column | str) -> Column:
    """The alias key of ASCII names without leaving the JVM."""
    return F.regexp_replace(F.lower(col(text)), r"\W", "")


@F.pandas_udf(T.StringType())
def normal_text(s: pd.Series) -> pd.Series:
    """NFKC and stripped; empty becomes null."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x).strip() or None, na_action="ignore")


@F.pandas_udf(T.StringType())
def composed(s: pd.Series) -> pd.Series:
    """NFC."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def entry_path(path: Column | str) -> Column:
    """What keeps an archive entry's path (in NFC, see composed) from being a relative POSIX path, or OK."""
    p = col(path)
    return F.coalesce(
        F.when(p.isNull() | (p == ""), "ENTRY_PATH_INVALID"), F.when(p.rlike(r"\x00|\\|^/|^[A-Za-z]:"), "ENTRY_PATH_INVALID"),
        F.when(p.rlike("/\\z|//"), "DIRECTORY_ENTRY_FORBIDDEN"), F.when(p.rlike(r"(^|/)\.{1,2}(/|\z)"), "ENTRY_PATH_INVALID"), F.lit("OK"),
    )


@F.pandas_udf(T.StringType())
def alias_key(s: pd.Series) -> pd.Series:
    """NFKC, case-folded, without anything but word characters."""
    return s.map(lambda x: re.sub(r"\W+", "", unicodedata.normalize("NFKC", x).casefold()), na_action="ignore")


def parsed(text: str):
    """The value of JSON text; None for text that is none."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no blanks; null for text that is no JSON, holds NaN or Infinity, or is nested deeper than the JSON reader goes."""

    def one(x):
        def refuse(_):
            raise ValueError

        try:
            return json.dumps(json.loads(x, parse_constant=refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return s.map(one, na_action="ignore")


def without_keys(keys: tuple[str, ...]):
    """A function that drops top-level keys from JSON text, for hashes that leave out volatile fields; null for what is no JSON object."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            body = parsed(x)
            return json.dumps({k: v for k, v in body.items() if k not in keys}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if isinstance(body, dict) else None

        return s.map(one, na_action="ignore")

    return run


def path_of(value, keys: tuple[str, ...]) -> str | None:
    """The path of the first of keys in a JSON value, read from left to right, parents first."""
    steps: list[str] = ["$"]  # of the way to what is looked at now
    stack = [_children(value)]
    while stack:
        step, child, key = next(stack[-1], (None, None, None))
        if step is None:
            stack.pop()
            steps.pop()
            continue
        if key in keys:
            return "".join([*steps, step])
        if isinstance(child, (dict, list)):
            steps.append(step)
            stack.append(_children(child))
    return None


def _children(value) -> Iterator[tuple[str, object, str | None]]:
    """(step, child, key) of a value's children; the key of a list's is null."""
    if isinstance(value, dict):
        return ((f".{k}", v, k) for k, v in value.items())
    return ((f"[{i}]", v, None) for i, v in enumerate(value if isinstance(value, list) else ()))


_PIECE = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]', re.S)


def deep_path(text: str, keys: tuple[str, ...]) -> str | None:
    """As path_of, of text that is nested deeper than the JSON reader goes: by brackets, strings, commas and colons, one after the other.

    What stands between them is not looked at, so text that is no JSON may have a path too.
    """
    stack: list[list] = []  # for each open bracket: is it an object, and the step it stands at
    word = None
    for m in _PIECE.finditer(text):
        piece = m.group()
        if piece in "{[":
            stack.append([piece == "{", "" if piece == "{" else 0])
        elif piece in "}]":
            if not stack or stack.pop()[0] != (piece == "}"):
                return None
        elif piece == ",":
            if stack and not stack[-1][0]:
                stack[-1][1] += 1
        elif piece == ":":
            if not stack or not stack[-1][0] or word is None:
                return None
            try:
                stack[-1][1] = json.loads(word)
            except ValueError:
                return None
            if stack[-1][1] in keys:
                return "".join(["$", *(f".{at}" if named else f"[{at}]" for named, at in stack)])
        word = piece if piece[0] == '"' else None
    return None


def forbidden_path(keys: tuple[str, ...]):
    """A function that gives the path of the first forbidden key anywhere in JSON text, or null, as for text that is no JSON. No depth is too great."""

    def one(text):
        try:
            return path_of(json.loads(text), keys)
        except RecursionError:
            return deep_path(text, keys)
        except ValueError:
            return None

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return run


#: Fixed value: the URL namespace of name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(name: Column | str) -> Column:
    """A version-5 UUID of a name, in the URL namespace: SHA-1 of both, cut to 16 bytes, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(col(name), "utf-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def decimal_text(text: Column | str) -> Column:
    """A number read from print: comma as point, one point at most, above 0 and at most 9999; else null."""
    x = F.replace(F.trim(col(text)), F.lit(","), F.lit("."))
    v = F.when(x.rlike(r"^[0-9]+(\.[0-9]+)?$"), x.cast("double"))
    return F.when((v > 0) & (v <= 9999), v)
