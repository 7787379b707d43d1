"""Strings of JSON texts of any depth: a token reader with a stack of its own.

The reader walks a text once, from left to right, and never calls itself, so depth costs a list
entry. Where the text stops being JSON, what was read before stays. Of repeated keys of an object
the last value counts, as in a parsed tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import scanstring

from vozmill import lexicon as lx

_TOKEN = re.compile(
    r'[ \t\n\r]*(?:([{}\[\],:])|(")|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)'
)
_LONE = re.compile("[\ud800-\udfff]")
_VALUE, _ITEM, _KEY, _FIRST_KEY, _COLON, _NEXT = range(6)


def _whole(text: str) -> str:
    """Halves of surrogate pairs, which no UTF-8 text can hold, become a sign of their own."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if _LONE.search(text) else text


def events(text: str) -> Iterator[tuple[str, str]]:
    """Opening and closing brackets, ("key", name), ("string", value) and ("other", "") in order."""
    open_ends: list[str] = []
    state, at = _VALUE, 0
    while True:
        found = _TOKEN.match(text, at)
        if found is None:
            return
        at, sign, quoted = found.end(), found[1], found[2]
        value = ""
        if quoted:
            if state not in (_VALUE, _ITEM, _KEY, _FIRST_KEY):
                return
            try:
                value, at = scanstring(text, at, True)
            except ValueError:
                return
        if state in (_VALUE, _ITEM):
            if sign == "{" or sign == "[":
                yield sign, ""
                open_ends.append("}" if sign == "{" else "]")
                state = _FIRST_KEY if sign == "{" else _ITEM
                continue
            if sign == "]" and state == _ITEM:
                yield sign, ""
                open_ends.pop()
            elif sign:
                return
            else:
                yield ("string", _whole(value)) if quoted else ("other", "")
        elif state in (_KEY, _FIRST_KEY):
            if quoted:
                yield "key", _whole(value)
                state = _COLON
                continue
            if sign != "}" or state == _KEY:
                return
            yield sign, ""
            open_ends.pop()
        elif state == _COLON:
            if sign != ":":
                return
            state = _VALUE
            continue
        elif sign == ",":
            state = _KEY if open_ends[-1] == "}" else _VALUE
            continue
        elif sign and sign == open_ends[-1]:
            yield sign, ""
            open_ends.pop()
        else:
            return
        if not open_ends:
            return
        state = _NEXT


def strings(payload: str | None) -> list[tuple[int, str]]:
    """All string values in order, each with the number of hint words in the keys above it."""
    found: list[tuple[int, str] | None] = []
    hints: list[int] = []  # per open bracket: bits of the hint words in the keys above and of its key
    spans: list[dict[str, list[int]] | None] = []  # per open bracket: where an object's values lie
    last: list[list[int] | None] = []
    here = 0
    for kind, value in events(payload or ""):
        if kind == "key":
            if last[-1] is not None:
                last[-1][1] = len(found)
            before = spans[-1].get(value)
            if before is not None:
                found[before[0] : before[1]] = [None] * (before[1] - before[0])
            last[-1] = spans[-1][value] = [len(found), len(found)]
            low = value.lower()
            here = hints[-1] | sum(1 << i for i, word in enumerate(lx.JSON_PATH_HINTS) if word in low)
        elif kind == "string":
            found.append((here.bit_count(), value))
        elif kind in "{[":
            hints.append(here)
            spans.append({} if kind == "{" else None)
            last.append(None)
        elif kind in "}]":
            if last[-1] is not None:
                last[-1][1] = len(found)
            here = hints.pop()
            spans.pop()
            last.pop()
        if hints and kind in ("string", "other", "}", "]") and spans[-1] is None:
            here = hints[-1]
    return [x for x in found if x is not None]


def linked_texts(payloads: list[str] | None) -> list[tuple[str, str]]:
    """Text fields of the objects of all payloads, each with the type of its object, in order."""
    out: list[tuple[str, str]] = []
    for payload in payloads if payloads is not None else []:
        objects: list[dict[str, str]] = []
        stack: list[dict[str, str] | None] = []
        key = None  # of the value that comes next, None inside lists
        for kind, value in events(payload or ""):
            if kind == "key":
                key = value
                stack[-1].pop(key, None)
                continue
            if kind == "string":
                if key == "@type" or key in lx.LD_TEXT_KEYS:
                    stack[-1][key] = value
            elif kind == "{":
                objects.append({})
                stack.append(objects[-1])
            elif kind == "[":
                stack.append(None)
            elif kind in "}]":
                stack.pop()
            key = None
        for found in objects:
            out += [(found.get("@type", ""), found[k]) for k in lx.LD_TEXT_KEYS if k in found]
    return out
