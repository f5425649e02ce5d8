"""The first JSON object of a chatty text by a pushdown scan: linear, with string state, and past false starts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: A JSON token or, last, one character that begins none.
_TOKEN = re.compile(r'[ \t\n\r]+|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null)|([{}\[\],:])|.', re.S)
#: What may come: v a value, k a key, c a colon, e a comma or the end; K and V as k and v, where the end may come at once.
_AFTER_VALUE = "e"


def _scan(text: str, start: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Objects that end within the value that begins at ``start``, and where those began that did not end."""
    stack: list[tuple[str, int]] = []  # the opening bracket and its place
    done: list[tuple[int, int]] = []
    want = "v"
    for token in _TOKEN.finditer(text, start):
        string, scalar, mark = token.group(1, 2, 3)
        if string is not None:
            if want in "kK":
                want = "c"
            elif want in "vV":
                want = _AFTER_VALUE
            else:
                break
        elif scalar is not None:
            if want not in "vV":
                break
            want = _AFTER_VALUE
        elif mark is not None:
            if mark in "{[":
                if want not in "vV":
                    break
                stack.append((mark, token.start()))
                want = "K" if mark == "{" else "V"
            elif mark in "}]":
                if not stack or stack[-1][0] != ("{" if mark == "}" else "[") or want not in ("eK" if mark == "}" else "eV"):
                    break
                opened = stack.pop()
                if mark == "}":
                    done.append((opened[1], token.end()))
                if not stack:
                    break
                want = _AFTER_VALUE
            elif mark == ":":
                if want != "c":
                    break
                want = "v"
            else:
                if want != "e" or not stack:
                    break
                want = "k" if stack[-1][0] == "{" else "v"
        elif token.group().isspace():
            continue
        else:
            break
    return done, [at for kind, at in stack if kind == "{"]


def first_object(text: str | None) -> str | None:
    """The object that parses and begins first; null if there is none.

    A scan from a brace that fails leaves the objects that ended within it, of which the first counts. Braces that it took for the beginning
    of an object would fail at the same place, so they are not tried again; those within its strings are, as the text before may have been
    no JSON.
    """
    if not text:
        return None
    failed: set[int] = set()
    at = text.find("{")
    while at >= 0:
        if at not in failed:
            done, unfinished = _scan(text, at)
            for a, b in sorted(done):
                try:
                    json.loads(text[a:b])
                    return text[a:b]
                except (ValueError, RecursionError):
                    continue
            failed.update(unfinished)
        at = text.find("{", at + 1)
    return None


@pandas_udf(StringType())
def _first_objects(texts: pd.Series) -> pd.Series:
    return texts.map(first_object, na_action="ignore")


def json_object(text: Column) -> Column:
    """``first_object`` of a column, in Arrow batches."""
    return _first_objects(text)
