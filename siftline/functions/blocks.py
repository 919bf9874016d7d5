"""The top-level blocks of a Markdown text, by the open containers of each line.

A line is first led through the block quotes and list items that are open, as
far as it carries their marks or indentation.  What is left of it opens new ones,
goes on with the open leaf (fence, table, HTML, indented code, paragraph), or
begins another.  A paragraph goes on without the marks of its containers if
nothing else begins there.  Inline marks are not looked at.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

from pyspark import cloudpickle

# what runs in workers goes along by value: they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Names of HTML elements whose tag begins a block, and those whose text is raw, by the CommonMark specification.
HTML_BLOCKS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
HTML_RAW = "pre script style textarea"

_ATTRIBUTE = r"""\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
_HTML = [  # how a block begins, how it ends (None: at a blank line), whether it may interrupt a paragraph
    (re.compile(rf"<(?:{HTML_RAW.replace(' ', '|')})(?=\s|>|$)", re.I), re.compile(rf"</(?:{HTML_RAW.replace(' ', '|')})>", re.I), True),
    (re.compile("<!--"), re.compile("-->"), True),
    (re.compile(r"<\?"), re.compile(r"\?>"), True),
    (re.compile("<![A-Za-z]"), re.compile(">"), True),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(rf"</?(?:{HTML_BLOCKS.replace(' ', '|')})(?=\s|/?>|$)", re.I), None, True),
    (re.compile(rf"(?:<[A-Za-z][\w-]*(?:{_ATTRIBUTE})*\s*/?>|</[A-Za-z][\w-]*\s*>)\s*$"), None, False),
]
_FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
_HEADING = re.compile(r"#{1,6}(?:\s|$)")
_RULE = re.compile(r"(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
_UNDERLINE = re.compile(r"(?:=+|-+)\s*$")
_ITEM = re.compile(r"([-+*]|(\d{1,9})[.)])( +|$)")
_DELIMITER = re.compile(r"[|:-][|: -]*$")
_TITLE = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)"""
_DEFINITION = re.compile(rf"[ ]{{0,3}}\[(?!\s*\])(?:[^\[\]\\]|\\.)+\]:\s*(?:<[^<>\n]*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:{_TITLE}))?[ \t]*(?:\n|$)", re.S)


@dataclass
class Block:
    """Lines [start, stop); kind is paragraph, heading, item, quote, table, fence, code, html or rule.  Every item of a list is a block."""

    kind: str
    start: int
    stop: int


@dataclass
class Open:
    """An open quote (indent 0) or list item, whose lines are indented by ``indent`` within its parent."""

    indent: int
    filled: bool = True


def cells(row: str) -> int:
    """Cells of a table row; a bar behind a backslash is text."""
    row = row.strip()
    parts = re.split(r"(?<!\\)\|", row)
    return len(parts) - (parts[0].strip() == "") - (len(parts) > 1 and parts[-1].strip() == "")


def delimits(line: str, header: str) -> bool:
    """Whether a line is the delimiter row of a table with this header."""
    line = line.strip()
    if "|" not in header or not _DELIMITER.match(line) or line.startswith("- "):
        return False
    parts = [p.strip() for p in line.split("|")]
    parts = parts[parts[0] == "" :]
    parts = parts[: len(parts) - (bool(parts) and parts[-1] == "")]
    return bool(parts) and all(re.fullmatch(":?-+:?", p) for p in parts) and len(parts) == cells(header)


def without_definitions(text: str) -> str:
    """A paragraph without the link definitions in front."""
    at = 0
    while found := _DEFINITION.match(text, at):
        at = found.end()
    return text[at:]


def html_start(rest: str, in_paragraph: bool):
    """(end pattern,) of the HTML block that begins here, or None."""
    if rest.startswith("<"):
        for begin, end, interrupts in _HTML:
            if (interrupts or not in_paragraph) and begin.match(rest):
                return (end,)
    return None


def begins_leaf(rest: str, in_paragraph: bool) -> bool:
    """Whether a fence, heading, rule or HTML block begins here (indented by less than four)."""
    return bool(_FENCE.match(rest) or _HEADING.match(rest) or _RULE.match(rest) or html_start(rest, in_paragraph))


def item_start(rest: str, in_paragraph: bool):
    """The list mark in front of ``rest``, if an item may begin here."""
    found = None if _RULE.match(rest) else _ITEM.match(rest)
    if found and in_paragraph and (not rest[found.end() :].strip() or found[2] not in (None, "1") and int(found[2]) != 1):
        return None
    return found


class Parser:
    """Takes lines one after another; ``blocks`` are those at the top so far."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack: list[Open] = []
        self.leaf: str | None = None  # the kind of leaf that is open in the innermost container
        self.end = None  # a pattern that ends it, where it has one
        self.text: list[str] = []  # of an open paragraph

    def begin(self, kind: str, number: int, leaf: str | None = None, end=None) -> None:
        if not self.stack:
            self.blocks.append(Block(kind, number, number + 1))
        self.leaf, self.end, self.text = leaf, end, []

    def led(self, s: str) -> tuple[int, int]:
        """How many containers the line goes on with, and the place behind their marks."""
        at = 0
        for depth, container in enumerate(self.stack):
            rest = s[at:].lstrip(" ")
            indent = len(s) - at - len(rest)
            if container.indent:
                if not rest.strip():
                    if not container.filled:
                        return depth, at
                elif indent < container.indent:
                    return depth, at
                else:
                    at += container.indent
                    container.filled = True
            elif indent < 4 and rest.startswith(">"):
                at += indent + 1
                at += s[at : at + 1] == " "
            else:
                return depth, at
        return len(self.stack), at

    def goes_on(self, rest: str, indent: int) -> bool:
        """Whether an open leaf other than a paragraph takes the line; a leaf that ends before it is closed."""
        blank = not rest.strip()
        if self.leaf == "fence":
            if indent < 4 and self.end.match(rest):
                self.leaf = None
            return True
        if self.leaf == "html":
            if self.end is not None:
                if self.end.search(rest):
                    self.leaf = None
                return True
            going = not blank
        elif self.leaf == "code":
            going = blank or indent >= 4
        elif self.leaf == "table":
            going = not blank and indent < 4 and not begins_leaf(rest, True) and not rest.startswith(">") and not item_start(rest, True)
        else:
            return False
        if not going:
            self.leaf = None
        return going

    def line(self, number: int, raw: str) -> None:
        s = (raw.expandtabs(4) if "\t" in raw else raw).rstrip("\r")
        depth, at = self.led(s)
        whole = depth == len(self.stack)
        rest = s[at:].lstrip(" ")
        indent = len(s) - at - len(rest)
        blank = not rest.strip()
        if not whole and self.leaf != "paragraph":
            self.leaf = None
        if whole and self.goes_on(rest, indent):
            if not blank and self.blocks:
                self.blocks[-1].stop = number + 1
            return
        if blank:
            self.leaf, self.stack = None, self.stack[:depth]
            return

        new = False
        while indent < 4:
            in_paragraph = self.leaf == "paragraph" and whole and not new
            if rest.startswith(">"):
                container, at = Open(0), at + indent + 1
                at += s[at : at + 1] == " "
                kind = "quote"
            elif mark := item_start(rest, in_paragraph):
                after = len(mark[3]) if rest[mark.end() :] else 0
                width = indent + len(mark[1]) + (after if 0 < after < 5 else 1)
                container, at, kind = Open(width, bool(rest[mark.end() :])), at + width, "item"
            else:
                break
            if not new:
                self.stack = self.stack[:depth]
            new = True
            self.begin(kind, number)
            self.stack.append(container)
            rest = s[at:].lstrip(" ")
            indent = max(0, len(s) - at - len(rest))
            if not rest:
                return
        if self.leaf == "paragraph" and not new:
            starts = indent < 4 and begins_leaf(rest, True)
            if whole and indent < 4 and self.underlined(number, rest):
                return
            if not starts:  # the paragraph goes on, whether the line has its containers' marks or not
                self.text.append(rest)
                self.blocks[-1].stop = number + 1
                return
        if not new:
            self.stack = self.stack[:depth]
        self.open_leaf(number, rest, indent)
        self.blocks[-1].stop = number + 1

    def underlined(self, number: int, rest: str) -> bool:
        """Whether the line makes a table's header or a heading of what is in front of it."""
        if delimits(rest, self.text[-1]):
            if not self.stack:
                last = self.blocks[-1]
                if len(self.text) > 1:
                    last.stop = number - 1
                    self.blocks.append(Block("table", number - 1, number + 1))
                else:
                    last.kind = "table"
            self.leaf = "table"
        elif _UNDERLINE.match(rest) and without_definitions("\n".join(self.text)).strip():
            if not self.stack:
                self.blocks[-1].kind = "heading"
            self.leaf = None
        else:
            return False
        self.blocks[-1].stop = number + 1
        return True

    def open_leaf(self, number: int, rest: str, indent: int) -> None:
        if indent >= 4:
            self.begin("code", number, "code")
        elif fence := _FENCE.match(rest):
            mark = fence[1] or fence[2]
            self.begin("fence", number, "fence", re.compile(rf"{re.escape(mark[0])}{{{len(mark)},}}\s*$"))
        elif _HEADING.match(rest):
            self.begin("heading", number)
        elif _RULE.match(rest):
            self.begin("rule", number)
        elif html := html_start(rest, False):
            done = html[0] is not None and html[0].search(rest)
            self.begin("html", number, None if done else "html", html[0])
        else:
            self.begin("paragraph", number, "paragraph")
            self.text = [rest]


def top_blocks(lines: list[str]) -> list[Block]:
    """The blocks of a text's lines, in order."""
    parser = Parser()
    for number, line in enumerate(lines):
        parser.line(number, line)
    return parser.blocks
