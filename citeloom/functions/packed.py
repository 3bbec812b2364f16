"""Quote-aware finite-state tokenizer for several values packed in one string.

States: outside (between values), quoted, bare. It tracks the open quote, escapes and the depth of
brackets; delimiters count only outside quotes. The scanner jumps between significant characters,
so its cost follows the number of values rather than the number of characters.

Results for odd input: null, blank and list-without-entries give no values; an unclosed quote is
ordinary text; values that repeat are kept, each with its own place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_SPACE = " \t\r\n\v\f  　﻿"
_PAIRS = {"[": "]", "{": "}", "(": ")"}
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
#: What ends a bare value: hard delimiters, a comma before a new value, white space before an address.
_STOP = re.compile(r"[;|\t\r\n\\•¦  ]|(?<=\s)/+(?=\s|$)|,(?=\s*(?:$|[,;|\"'\[\]{}/\d]|[a-z]))|\s(?=\s*(?:https?://|/\w+/))")
_ADDRESS = re.compile(r"https?://\S+$|/\w+/\S*$")
_AFTER = re.compile(r"\s*(?:$|[,;|•¦\]\}\t\r\n]|/(?:\s|$))")


def _escape(s: str, i: int) -> tuple[str, int]:
    """The character that the backslash at i stands for, and where to go on."""
    c = s[i + 1 : i + 2]
    width = {"u": 4, "x": 2}.get(c, 0)
    code = s[i + 2 : i + 2 + width]
    if width and re.fullmatch(rf"[0-9a-fA-F]{{{width}}}", code):
        high, j = int(code, 16), i + 2 + width
        low = re.match(r"\\u([dD][c-fC-F][0-9a-fA-F]{2})", s[j:]) if 0xD800 <= high < 0xDC00 else None
        if low:
            return chr(0x10000 + ((high - 0xD800) << 10) + int(low[1], 16) - 0xDC00), j + 6
        return chr(high), j
    return _ESCAPED.get(c, c or "\\"), i + 2


def _quoted(s: str, i: int) -> tuple[str, int] | None:
    """The value in quotes that opens at i, and the place after its close; None if it never closes."""
    q, out, j, n = s[i], [], i + 1, len(s)
    stop = re.compile(rf"[{q}\\]")
    while m := stop.search(s, j):
        k = m.start()
        out.append(s[j:k])
        if s[k] == "\\":
            c, j = _escape(s, k)
            out.append(c)
        elif s[k + 1 : k + 2] == q and not (k == i + 1 and _AFTER.match(s, k + 2)):
            out.append(q)  # a doubled quote
            j = k + 2
        elif _AFTER.match(s, k + 1):
            return "".join(out), k + 1
        else:
            out.append(q)  # an apostrophe inside the value
            j = k + 1
        if j > n:
            break
    return None


def _values(s: str) -> Iterator[str]:
    i, n, depth = 0, len(s), 0
    while i < n:
        c = s[i]
        if c in _SPACE or c in ",;|•¦\u2028\u2029" or (c == "/" and (i + 1 == n or s[i + 1] in _SPACE)):
            i += 1
        elif c in "[{" and depth < 8:
            depth, i = depth + 1, i + 1
        elif c in "]}":
            depth, i = max(0, depth - 1), i + 1
        elif c in "\"'" and (got := _quoted(s, i)):
            yield got[0]
            i = got[1]
        else:
            out, j = [], i
            while True:
                m = _STOP.search(s, j)
                k = m.start() if m else n
                out.append(s[j:k])
                if not m or s[k] != "\\":
                    break
                c, j = _escape(s, k)
                out.append(c)
            text = "".join(out).strip(_SPACE)
            if depth and (not m or not s[k:].strip(_SPACE + "]}")):
                text = text.rstrip(_SPACE).removesuffix("]").removesuffix("}")
            parts = text.split()
            if len(parts) > 1 and all(_ADDRESS.match(p) or p.isdigit() for p in parts):
                yield from parts
            elif len(parts) > 1 and any(_ADDRESS.match(p) for p in parts):
                yield from parts
            else:
                yield text
            i = max(k, i + 1)


def split_packed(s: str | None) -> list[str]:
    """The values of one packed string in order, without quoting, escapes and outer white space."""
    if s is None:
        return []
    s = s.strip(_SPACE)
    for _ in range(4):  # a list that was encoded more than once
        if s[:1] in "\"'" and s and (got := _quoted(s, 0)) and got[1] == len(s):
            inner = got[0].strip(_SPACE)
            if inner[:1] in ("[", "{", '"') and inner[-1:] in ("]", "}", '"') and len(inner) > 1:
                s = inner
                continue
        break
    return [v for x in _values(s) if (v := x.strip(_SPACE))]
