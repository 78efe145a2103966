"""The JSON object in a noisy answer: fenced, else from the first brace to the last, else the first balanced one."""

from __future__ import annotations

import json
import re
from typing import Any


def _object(text: str) -> dict[str, Any] | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _balanced(text: str, start: int) -> str | None:
    """The text from a brace to the one that closes it; braces in strings do not count."""
    depth, quoted, i = 0, False, start
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        else:
            depth += (c == "{") - (c == "}")
            if depth == 0:
                return text[start : i + 1]
        i += 1
    return None


def extract_json(text: str | None) -> dict[str, Any] | None:
    text = text or ""
    for fenced in re.findall(r"```(?:json)?\s*(.*?)```", text, re.S):
        if (found := _object(fenced)) is not None:
            return found
    first, last = text.find("{"), text.rfind("}")
    if 0 <= first < last and (found := _object(text[first : last + 1])) is not None:
        return found
    while first >= 0:
        part = _balanced(text, first)
        if part and (found := _object(part)) is not None:
            return found
        first = text.find("{", first + 1)
    return None
