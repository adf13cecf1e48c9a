"""Broken JSON objects as models write them, read in one pass with a stack of open brackets."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_WORD = re.compile(r"[^,:{}\[\]\n\"']+")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?\Z")
_COMMENT = re.compile(r"//[^\n]*|#[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_BEFORE_COMMENT = re.compile(r".*?(?=\s(?://|#|/\*)|\Z)", re.S)
_KEY_NEXT = re.compile(r"\s*[\"'][^\"'\n]*[\"']\s*:")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_CLOSING = {'"': '"', "'": "'", "“": "”", "‘": "’"}
_PLAIN = {"true": True, "false": False, "null": None, "none": None, "nan": None, "undefined": None}


def _string(text: str, at: int, key: bool) -> tuple[str, int]:
    """The string whose opening quote is at ``at``, and where it ends.

    A quote inside closes it only if what follows may follow a string, so quotes and apostrophes within are kept.
    """
    close, out, i = _CLOSING[text[at]], [], at + 1
    while i < len(text):
        ch = text[i]
        if ch == "\\" and i + 1 < len(text):
            code = text[i + 2 : i + 6]
            if text[i + 1] == "u" and re.fullmatch("[0-9a-fA-F]{4}", code):
                out.append(chr(int(code, 16)))
                i += 6
            else:
                out.append(_ESCAPES.get(text[i + 1], text[i + 1]))
                i += 2
            continue
        if ch == close:
            rest = i + 1
            while rest < len(text) and text[rest] in " \t\r\n":
                rest += 1
            if rest == len(text) or text[rest] in ",}]" or text[rest] == ":" and key or not key and _KEY_NEXT.match(text, i + 1):
                return "".join(out), i + 1
        out.append(ch)
        i += 1
    return "".join(out).rstrip("}] \t\r\n"), len(text)  # never closed: brackets at the end are the object's


def _value(word: str):
    if _NUMBER.match(word):
        return float(word) if any(c in word for c in ".eE") else int(word)
    return _PLAIN.get(word.lower(), word)


def repaired(text: str | None) -> str | None:
    """The object that starts at the first brace, as valid JSON; null without one.

    Understood are trailing, doubled and missing commas, brackets that are not or wrongly closed, single and curly
    quotes, quotes within strings, keys and values without quotes, raw line breaks, comments, Python's True, False
    and None, and keys without a value (an empty text). What follows the object is left out; of equal keys the last wins.
    """
    at = (text or "").find("{")
    if at < 0:
        return None
    stack: list[list] = []  # [container, key that waits for its value]
    root = None

    def put(value) -> None:
        top = stack[-1]
        if isinstance(top[0], list):
            top[0].append(value)
        elif top[1] is None:
            top[1] = value if isinstance(value, str) else json.dumps(value)
        else:
            top[0][top[1]] = value
            top[1] = None

    def settle() -> None:
        if stack[-1][1] is not None:
            put("")

    while at < len(text):
        ch = text[at]
        if ch in "{[":
            new: dict | list = {} if ch == "{" else []
            if stack and isinstance(stack[-1][0], dict) and stack[-1][1] is None:
                at += 1  # a bracket where a key belongs
                continue
            if stack:
                put(new)
            else:
                root = new
            stack.append([new, None])
            at += 1
        elif ch in "}]":
            kind = dict if ch == "}" else list
            if any(isinstance(s[0], kind) for s in stack):
                while True:
                    settle()
                    if isinstance(stack.pop()[0], kind):
                        break
            at += 1
            if not stack:
                break
        elif ch == ",":
            settle()
            at += 1
        elif ch in " \t\r\n:":
            at += 1
        elif ch in _CLOSING:
            key = isinstance(stack[-1][0], dict) and stack[-1][1] is None
            value, at = _string(text, at, key)
            put(value)
        elif m := _COMMENT.match(text, at):
            at = m.end()
        else:
            m = _WORD.match(text, at)
            word = _BEFORE_COMMENT.match(m[0])[0] if m else ch
            at += len(word)
            word = word.strip()
            if word:
                put(word if isinstance(stack[-1][0], dict) and stack[-1][1] is None else _value(word))
    while stack:
        settle()
        stack.pop()
    return json.dumps(root, ensure_ascii=False)


def strict(text: str | None) -> str | None:
    """The text itself if it is a JSON object by the letter, else what it means."""
    try:
        if text and isinstance(json.loads(text), dict):
            return text
    except (ValueError, RecursionError):
        pass
    return repaired(text)


@F.pandas_udf(StringType())
def repair(texts: pd.Series) -> pd.Series:
    return texts.map(strict)
