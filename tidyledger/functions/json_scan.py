"""Small text helpers for JSON in prose and nested content; linear, and safe on hostile input."""

from __future__ import annotations

import json
import re

_OPEN = re.compile(r"[{\[]")
_SPACE = re.compile(r"[ \t\n\r]*")
_TOKEN = re.compile(
    r'(?P<string>"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*")'
    r"|(?P<plain>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)"
    r"|(?P<mark>[{}\[\],:])"
)
_TRAILING_COMMA = re.compile(r",\s*([}\]])")
#: What may come next: a value, a key, or one of some marks.
_AFTER_OPEN = {"[": ("value", "]"), "{": ("key", "}")}


def _span(text: str) -> tuple[int, int] | None:
    """Start and end of the first complete object or array.

    One pass: a container that breaks off ends at the place of the error, and the search
    goes on there.  Of the containers that were complete inside it, the first counts.
    """
    at = 0
    while start := _OPEN.search(text, at):
        place = start.end()
        stack = [(text[start.start()], start.start())]
        wanted: tuple[str, ...] = _AFTER_OPEN[stack[0][0]]
        inner: tuple[int, int] | None = None
        while stack:
            place = _SPACE.match(text, place).end()
            token = _TOKEN.match(text, place)
            if token is None:
                break
            kind, word = token.lastgroup, token[0]
            closes = word if kind == "mark" and word in "}]" else None
            if closes and closes in wanted:
                place = token.end()
                opened, begin = stack.pop()
                if stack and (inner is None or begin < inner[0]):
                    inner = (begin, place)
                wanted = (",", "]" if stack and stack[-1][0] == "[" else "}")
            elif kind == "mark" and word in "{[" and "value" in wanted:
                stack.append((word, token.start()))
                wanted = _AFTER_OPEN[word]
                place = token.end()
            elif kind == "string" and "key" in wanted:
                wanted, place = (":",), token.end()
            elif kind in ("string", "plain") and "value" in wanted:
                wanted, place = (",", "]" if stack[-1][0] == "[" else "}"), token.end()
            elif word == ":" and ":" in wanted:
                wanted, place = ("value",), token.end()
            elif word == "," and "," in wanted:
                wanted, place = ("value",) if stack[-1][0] == "[" else ("key",), token.end()
            else:
                break
        if not stack:
            return start.start(), place
        if inner:
            return inner
        at = max(place, start.end())
    return None


def first_json(text: str) -> str | None:
    """The first JSON object or array anywhere in a text, as written.

    If there is none, trailing commas are forgiven.
    """
    for candidate in (text, _TRAILING_COMMA.sub(r"\1", text)):
        if found := _span(candidate):
            return candidate[found[0] : found[1]]
    return None


def content_leaves(content: str, keys: tuple[str, ...]) -> str:
    """Texts of nested content parts, one to a line, at any depth.

    A part is a text, or an object whose first key with a text or a list counts.
    """
    work, found = [json.loads(content)], []
    if isinstance(work[0], list):
        work = [x for x in reversed(work[0]) if isinstance(x, str | dict)]
    while work:
        part = work.pop()
        if isinstance(part, str):
            if part:
                found.append(part)
            continue
        value = next((part[k] for k in keys if isinstance(part, dict) and isinstance(part.get(k), str | list)), None)
        if isinstance(value, str):
            work.append(value)
        elif value is not None:
            work += [x for x in reversed(value) if isinstance(x, str | dict)]
    return "\n".join(found)
