"""Where texts, comments, rows and statements begin and end in SQL, from any place of a file on."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

# Where a reader can be: in plain SQL, in a text, in a text with backslashes, in a quoted name, in a comment.
PLAIN, TEXT, ESCAPED, NAME, LINE, BLOCK = range(6)
MODES = (PLAIN, TEXT, ESCAPED, NAME, LINE, BLOCK)
# Signs of a statement that are kept to tell what it is.
HEAD = 1 << 16

_NEXT = {PLAIN: re.compile(r"""(?<![\w$])[eE]'|['"();]|--|/\*"""), TEXT: re.compile("'"),
         ESCAPED: re.compile(r"\\.|'", re.DOTALL), NAME: re.compile('"'), LINE: re.compile("\n"),
         BLOCK: re.compile(r"\*/")}
_OPENS = {"'": TEXT, "e'": ESCAPED, "E'": ESCAPED, '"': NAME, "--": LINE, "/*": BLOCK}

# The beginning of a statement that adds rows, up to the first row.
INSERT = re.compile(r'(?is)^\s*insert\s+into\s+(?:only\s+)?"?([^"\s(]+)"?\s*(?:\(([^)]*)\))?\s*values\s*$')
CREATE = re.compile(r"(?is)^\s*create\s+table\b")
# Signs that a backslash makes of letters.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": ""}


def walk(text: str, mode: int, plain: Callable[[str], None], sign: Callable[[str], None]) -> int:
    """Read ``text`` from a mode on; returns the mode at its end.

    ``plain`` gets all that belongs to statements, comments left out and texts with backslashes rewritten without;
    ``sign`` gets brackets and semicolons that stand outside texts.
    """
    at = 0
    while at < len(text):
        found = _NEXT[mode].search(text, at)
        if found is None:
            if mode not in (LINE, BLOCK):
                plain(text[at:])
            break
        token, start, end = found.group(), found.start(), found.end()
        if mode == PLAIN:
            if start > at:
                plain(text[at:start])
            if token in "();":
                sign(token)
            else:
                mode = _OPENS[token]
                if mode in (TEXT, ESCAPED, NAME):
                    plain(token[-1])
        elif mode == ESCAPED and token[0] == "\\":
            plain(text[at:start] + _ESCAPES.get(token[1], "''" if token[1] == "'" else token[1]))
        else:
            if mode in (TEXT, ESCAPED, NAME):
                plain(text[at:end])
            # A doubled quote ends a text and begins it again.
            if mode == ESCAPED and text[end:end + 1] == "'":
                plain("'")
                end += 1
            else:
                plain(" ") if mode in (LINE, BLOCK) else None
                mode = PLAIN
        at = end
    return mode


@dataclass(frozen=True)
class Span:
    """What reading some text leads to, from one mode on: the mode at its end, and the statement that is open there.

    ``depth`` counts open brackets, from the last semicolon on or, if there is none (``ended`` is false), relative to the
    beginning; ``low`` is the lowest it went. ``head`` is the first part of the open statement, or what
    continues the one that was open before.
    """

    mode: int
    ended: bool = False
    depth: int = 0
    low: int = 0
    head: str = ""

    def then(self, later: Span) -> Span:
        if later.ended:
            return later
        return Span(later.mode, self.ended, self.depth + later.depth, min(self.low, self.depth + later.low),
                    (self.head + later.head)[:HEAD])


def span(text: str, mode: int) -> Span:
    ended, depth, low, size = False, 0, 0, 0
    head: list[str] = []

    def plain(part: str) -> None:
        nonlocal size
        if size < HEAD:
            head.append(part[:HEAD - size])
            size += len(part)

    def sign(token: str) -> None:
        nonlocal ended, depth, low, size
        if token == ";":
            ended, depth, low, size = True, 0, 0, 0
            head.clear()
            return
        depth += 1 if token == "(" else -1
        low = min(low, depth)
        plain(token)

    mode = walk(text, mode, plain, sign)
    return Span(mode, ended, depth, low, "".join(head))


def shortened(head: str, ended: bool) -> str:
    """As much of a head as others need: of rows only what stands before them, of continued statements a part."""
    rows = _rows_at(head)
    return head[:rows + 1] if rows else head if ended else head[:HEAD >> 4]


def adds_rows(head: str) -> tuple[str, str] | None:
    """Table and column names of a statement whose beginning holds the beginning of its first row."""
    rows = _rows_at(head)
    found = INSERT.match(head[:rows]) if rows else None
    return (found[1], found[2] or "") if found else None


def _rows_at(head: str) -> int | None:
    """Where the first row of an INSERT begins."""
    return next((place for place in _first_brackets(head) if INSERT.match(head[:place])), None)


def _first_brackets(head: str) -> list[int]:
    """Places of the first two brackets that open outside of others: names may stand before the rows."""
    places, depth = [], 0
    quoted = None
    for place, c in enumerate(head):
        if quoted:
            quoted = None if c == quoted else quoted
        elif c in "'\"":
            quoted = c
        elif c == "(":
            if not depth:
                places.append(place)
                if len(places) == 2:
                    break
            depth += 1
        elif c == ")":
            depth -= 1
    return places


class Cutter:
    """Cuts rows of INSERT statements and whole CREATE TABLE statements out of a range whose beginning is known.

    ``done`` collects ``(kind, table, names, text, owner)``; an owner marks a fragment of a row that began in the range of
    that number.
    """

    def __init__(self, start: int, mode: int = PLAIN, depth: int = 0, head: str = "", owner: int | None = None):
        self.start, self.mode, self.depth, self.owner = start, mode, depth, owner
        self.done: list[tuple] = []
        self.head, self.size = [head], len(head)
        self.adds = adds_rows(head)
        self.in_row = self.adds is not None and depth > 0
        self.row: list[str] = []

    def _plain(self, part: str) -> None:
        if self.in_row:
            self.row.append(part)
        elif self.adds and part.strip(" \t\r\n,"):
            self.adds = ("", "")  # something follows the rows, to be passed over
        elif not self.adds and self.size < HEAD:
            self.head.append(part[:HEAD - self.size])
            self.size += len(part)

    def _sign(self, token: str) -> None:
        if token == ";":
            self._end()
        elif token == "(":
            if self.in_row:
                self.row.append(token)
            elif not self.depth and self._first_row():
                self.in_row, self.row, self.owner = True, [], None
            else:
                self._plain(token)
            self.depth += 1
        elif self.depth:
            self.depth -= 1
            if self.in_row and not self.depth:
                self._leave(None if self.owner is None else self.owner)
                self.in_row = False
            elif self.in_row:
                self.row.append(token)
            else:
                self._plain(token)

    def _first_row(self) -> bool:
        if self.adds is None:
            found = INSERT.match("".join(self.head))
            self.adds = (found[1], found[2] or "") if found else None
        return bool(self.adds and self.adds[0])

    def _leave(self, owner: int | None) -> None:
        self.done.append(("row", *self.adds, "".join(self.row), owner))
        self.row, self.owner = [], None

    def _end(self) -> None:
        text = "".join(self.head)
        if self.adds is None and CREATE.match(text):
            self.done.append(("create", "", "", text, None))
        self.head, self.size, self.adds, self.in_row, self.depth = [], 0, None, False, 0

    def feed(self, text: str) -> None:
        self.mode = walk(text, self.mode, self._plain, self._sign)

    def close(self, last: bool) -> None:
        """The end of the range: an open row leaves as a fragment; the end of a file ends a statement too."""
        if self.in_row:
            self._leave(self.start if self.owner is None else self.owner)
        elif last:
            self._end()
