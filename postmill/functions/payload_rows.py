"""Per-page helper of the details job: raw field strings of a script payload.

The payload is a called function whose parameters stand for its arguments. The script is cut
into tokens once; strings are single tokens, so nothing inside them can be taken for structure.
"""

from __future__ import annotations

import re

from postmill.functions import fixed_values as fv
from postmill.functions.html_rows import Outline

# A name directly followed by a colon is one token: a key.
_TOKEN = re.compile(
    r'"[^"\\]*(?:\\.[^"\\]*)*"?'
    r"|'[^'\\]*(?:\\.[^'\\]*)*'?"
    r"|[A-Za-z_$][\w$]*:?"
    r"|-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    r"|\S",
    re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", re.S)
_CONTROL = {"n": "\n", "r": "\r", "t": "\t"}
_OPEN = {"}": "{", "]": "[", ")": "("}


def _unescape(body: str) -> str:
    if "\\" not in body:
        return body

    def decode(m):
        code = m[1] or m[2]
        if code:
            return chr(int(code, 16))
        return m[0] if m[3] in "ux" else _CONTROL.get(m[3], m[3])

    text = _ESCAPE.sub(decode, body)
    # Characters beyond the first plane are written as two escaped halves.
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Payload:
    def __init__(self, script: str):
        self.tokens = _TOKEN.findall(script)
        self.close = self._pair_brackets()
        self.arguments: dict[str, tuple[int, int]] = {}  # read only when asked for
        self.body = self._read_call()

    def _pair_brackets(self) -> dict[int, int]:
        """Closing token of each bracket; each kind of bracket is paired by itself."""
        pairs, waiting = {}, {"{": [], "[": [], "(": []}
        for i, token in enumerate(self.tokens):
            if token in waiting:
                waiting[token].append(i)
            elif token in _OPEN and waiting[_OPEN[token]]:
                pairs[waiting[_OPEN[token]].pop()] = i
        return pairs

    def _read_call(self) -> tuple[int, int] | None:
        """Fill the argument map; the range of body tokens, or None when this is no call."""
        t = self.tokens
        start = next((i for i in range(len(t) - 2)
                      if t[i] == "function" and t[i + 1] == "(" and t[i + 2] != ")"), None)
        if start is None:
            return None
        after = self.close.get(start + 1)
        if after is None or t[after + 1:after + 2] != ["{"]:
            return None
        end = self.close.get(after + 1)
        if end is None:
            return None
        names = [x for x in t[start + 2:after] if x != ","]
        if t[end + 1:end + 3] == [")", "("]:
            last = len(t) - 1 - t[::-1].index(")")
            values = self._split_arguments(end + 3, last)
            self.arguments = dict(zip(names, values, strict=False))
        return after + 2, end

    def _split_arguments(self, at: int, end: int) -> list[tuple[int, int]]:
        """One range per argument; an object or array counts as one."""
        ranges, begin = [], at
        while at < end:
            if self.tokens[at] in ("{", "[", "("):
                at = self.close.get(at, end)
            elif self.tokens[at] == ",":
                ranges.append((begin, at))
                begin = at + 1
            at += 1
        return [*ranges, (begin, end)] if begin < end else ranges

    def _literal(self, at: int, end: int):
        """A string, number, boolean or None; anything else counts as unknown."""
        token = self.tokens[at] if at < end else ""
        if token[:1] in ("'", '"'):
            closed = len(token) > 1 and token[-1] == token[0]
            return _unescape(token[1:-1] if closed else token[1:])
        if token in ("true", "false"):
            return token == "true"
        try:
            return float(token) if re.search("[.eE]", token) else int(token)
        except ValueError:
            return None

    def field(self, span: tuple[int, int], name: str, depth: int | None = None) -> int | None:
        """Index of the value of the first ``name:`` in the span, optionally at one brace depth."""
        key, level = name + ":", 0
        for i in range(*span):
            token = self.tokens[i]
            if token == key and depth in (None, level):
                return i + 1
            if token == "{":
                level += 1
            elif token == "}":
                level -= 1
        return None

    def object_at(self, at: int | None) -> tuple[int, int] | None:
        if at is None or self.tokens[at:at + 1] != ["{"]:
            return None
        end = self.close.get(at)
        return None if end is None else (at, end + 1)

    def value_at(self, at: int | None):
        if at is None or at >= len(self.tokens):
            return None
        token = self.tokens[at]
        return self._literal(*self.arguments.get(token, (at, at + 1)))


def _scalar(value) -> dict | None:
    """Value as text, with a sign telling numbers from strings."""
    if value is None:
        return None
    number = not isinstance(value, str)
    return {"value": str(int(value) if isinstance(value, bool) else value), "is_number": number}


def payload_row(script: str) -> dict:
    """Raw payload fields; ``payload`` tells whether the posting object was found."""
    row = {"payload": "unreadable"}
    payload = Payload(script)
    outer = payload.body and payload.object_at(payload.field(payload.body, fv.PAYLOAD_OUTER))
    inner = outer and payload.object_at(payload.field(outer, fv.PAYLOAD_INNER))
    if not inner:
        return row
    text, category, deadline, salary, views = (
        payload.field(inner, name, depth=1) for name in fv.PAYLOAD_FIELDS)
    body = payload.value_at(text)
    if isinstance(body, str):
        row["text_length"] = len(body)
        row["text"] = Outline(body).text(sep="\n")
    nested = payload.object_at(category)
    title = nested and payload.value_at(payload.field(nested, fv.PAYLOAD_CATEGORY_TITLE))
    row["category"] = title if isinstance(title, str) else None
    row["deadline"] = _scalar(payload.value_at(deadline))
    row["salary"] = _scalar(payload.value_at(salary))
    row["views"] = _scalar(payload.value_at(views))
    row["payload"] = "read"
    return row
