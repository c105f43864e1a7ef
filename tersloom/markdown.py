"""A block and inline scanner for Markdown with tables and strikethrough, giving document nodes.

Blocks become a small tree first; a walk over it then collects text as the node rules want it: a wrapped line of a list item joins without a space,
and an inner list clears what its outer list has gathered, whose later text is no list text any more.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from tersloom.kernel import Builder, Node, trim

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^\n]*)$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
_QUOTE = re.compile(r" {0,3}> ?")
_DELIM = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML_BLOCK = re.compile(
    r" {0,3}<(?:(script|pre|style|textarea)(?=[\s>]|$)|(!--)|(\?)|(![A-Z])|(!\[CDATA\[)|/?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?=[\s/>]|$)|/?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>\s*$)",
    re.I,
)
_REFERENCE = re.compile(r" {0,3}\[([^\[\]]+)\]:[ \t]*(\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")


@dataclass(slots=True)
class Block:
    kind: str  # doc quote item list para heading code table html rule
    text: str = ""
    level: int = 0
    lang: str | None = None
    ordered: bool = False
    tight: bool = True
    rows: list[list[str]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _indent(line: str) -> int:
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def _outdent(line: str, n: int) -> str:
    """Without n columns of leading white space."""
    at = 0
    for i, c in enumerate(line):
        if at >= n:
            return line[i:]
        if c == " ":
            at += 1
        elif c == "\t":
            step = 4 - at % 4
            if at + step > n:
                return " " * (at + step - n) + line[i + 1 :]
            at += step
        else:
            return line[i:]
    return ""


def _cells(line: str) -> list[str]:
    s = line.strip()
    s = s[1:] if s.startswith("|") else s
    parts, cur, i = [], "", 0
    while i < len(s):
        if s[i] == "\\" and s[i + 1 : i + 2] == "|":
            cur += "|"
            i += 2
            continue
        if s[i] == "|":
            parts.append(cur)
            cur = ""
        else:
            cur += s[i]
        i += 1
    if cur.strip() or not s.endswith("|"):
        parts.append(cur)
    return [p.strip() for p in parts]


class Blocks:
    def __init__(self):
        self.references: dict[str, str] = {}

    def parse(self, lines: list[str]) -> list[Block]:
        out: list[Block] = []
        i, n = 0, len(lines)
        while i < n:
            line = lines[i]
            if not line.strip():
                i += 1
                continue
            if _indent(line) >= 4:
                i = self.indented(lines, i, out)
            elif m := _FENCE.match(line):
                i = self.fenced(lines, i, m, out)
            elif m := _ATX.match(line):
                out.append(Block("heading", m[2] or "", len(m[1])))
                i += 1
            elif _RULE.match(line):
                out.append(Block("rule"))
                i += 1
            elif _QUOTE.match(line):
                i = self.quote(lines, i, out)
            elif self.starts_item(line, False):
                i = self.list(lines, i, out)
            elif m := _HTML_BLOCK.match(line):
                i = self.html(lines, i, m, out)
            elif m := _REFERENCE.match(line):
                self.references.setdefault(m[1].strip().lower(), m[2])
                i += 1
            elif "|" in line and i + 1 < n and "-" in lines[i + 1] and ("|" in lines[i + 1] or len(_cells(line)) == 1) and _DELIM.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
                i = self.table(lines, i, out)
            else:
                i = self.paragraph(lines, i, out)
        return out

    def starts_item(self, line: str, in_paragraph: bool) -> bool:
        m = _ITEM.match(line)
        if not m or _RULE.match(line):
            return False
        # an empty item, or a number other than 1, does not break a paragraph
        return not in_paragraph or bool(line[m.end() :].strip()) and (not m[2][0].isdigit() or m[2][:-1] == "1")

    def indented(self, lines, i, out) -> int:
        body = []
        while i < len(lines) and (not lines[i].strip() or _indent(lines[i]) >= 4):
            body.append(_outdent(lines[i], 4))
            i += 1
        while body and not body[-1].strip():
            body.pop()
        out.append(Block("code", "\n".join(body)))
        return i

    def fenced(self, lines, i, m, out) -> int:
        mark, info = m[1], m[2].strip()
        if mark[0] == "`" and "`" in info:
            return self.paragraph(lines, i, out)
        pad, body = _indent(lines[i]), []
        i += 1
        while i < len(lines):
            c = re.match(r" {0,3}(`+|~+)[ \t]*$", lines[i])
            if c and c[1][0] == mark[0] and len(c[1]) >= len(mark):
                i += 1
                break
            body.append(_outdent(lines[i], min(pad, _indent(lines[i]))))
            i += 1
        out.append(Block("code", "\n".join(body), lang=html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", info)) or None))
        return i

    def quote(self, lines, i, out) -> int:
        inner, lazy = [], False
        while i < len(lines):
            m = _QUOTE.match(lines[i])
            if m:
                inner.append(lines[i][m.end() :])
                lazy = bool(inner[-1].strip()) and not self.breaks(inner[-1])
            elif lazy and lines[i].strip() and not self.breaks(lines[i]):
                inner.append(lines[i].lstrip())
            else:
                break
            i += 1
        out.append(Block("quote", blocks=self.parse(inner)))
        return i

    def breaks(self, line: str) -> bool:
        """Whether a line ends a paragraph."""
        return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or _QUOTE.match(line) or self.starts_item(line, True) or ((h := _HTML_BLOCK.match(line)) and (any(h.groups()) or re.match(r" {0,3}</?[A-Za-z][\w-]*(?=[\s/>]|$)", line) and not re.match(r" {0,3}</?(?:a|b|i|em|strong|span|img|code|br|u|s|sub|sup|kbd|small|del|ins|font|input|button|label|svg|video|source)\b", line, re.I))))

    def list(self, lines, i, out) -> int:
        m = _ITEM.match(lines[i])
        kind = m[2][-1]
        block = Block("list", ordered=m[2][0].isdigit())
        gap = False
        while i < len(lines):
            m = _ITEM.match(lines[i])
            if not m or m[2][-1] != kind or _RULE.match(lines[i]):
                break
            if gap:
                block.tight = False
            marker = len(m[1]) + len(m[2])
            rest = lines[i][m.end(2) :]
            width = _indent(rest)
            empty = not rest.strip()
            need = marker + (1 if empty or width > 4 else width)
            first = "" if empty else _outdent(rest, need - marker)
            inner, i, gap = [first], i + 1, False
            lazy = bool(first.strip())
            while i < len(lines):
                line = lines[i]
                if not line.strip():
                    if len(inner) == 1 and empty and not inner[0].strip():
                        break
                    inner.append("")
                    lazy = False
                    i += 1
                    continue
                if _indent(line) >= need:
                    inner.append(_outdent(line, need))
                    lazy = True
                elif lazy and not self.breaks(line) and not _ITEM.match(line):
                    inner.append(line.lstrip())
                else:
                    break
                i += 1
            while inner and not inner[-1].strip():
                inner.pop()
                gap = True
            blocks = self.parse(inner)
            if _loose(inner, blocks):
                block.tight = False
            block.blocks.append(Block("item", blocks=blocks))
            while i < len(lines) and not lines[i].strip():
                gap = True
                i += 1
        out.append(block)
        return i

    def html(self, lines, i, m, out) -> int:
        ends = {1: f"</{m[1]}>" if m[1] else "", 2: "-->", 3: "?>", 4: ">", 5: "]]>"}
        which = next((k for k in range(1, 6) if m[k]), 0)
        while i < len(lines):
            if which and ends[which].lower() in lines[i].lower():
                i += 1
                break
            if not which and not lines[i].strip():
                break
            i += 1
        out.append(Block("html"))
        return i

    def table(self, lines, i, out) -> int:
        rows = [_cells(lines[i])]
        width = len(rows[0])
        i += 2
        while i < len(lines) and lines[i].strip() and not self.breaks(lines[i]):
            c = _cells(lines[i])[:width]
            rows.append(c + [""] * (width - len(c)))
            i += 1
        out.append(Block("table", rows=rows))
        return i

    def paragraph(self, lines, i, out) -> int:
        body = [lines[i].lstrip()]
        i += 1
        while i < len(lines) and lines[i].strip():
            m = _SETEXT.match(lines[i])
            if m:
                out.append(Block("heading", "\n".join(body).rstrip(), 1 if m[1][0] == "=" else 2))
                return i + 1
            if _indent(lines[i]) < 4 and self.breaks(lines[i]):
                break
            body.append(lines[i].lstrip())
            i += 1
        out.append(Block("para", "\n".join(body).rstrip()))
        return i


def _loose(lines: list[str], blocks: list[Block]) -> bool:
    """A blank line between two blocks of an item."""
    return len(blocks) > 1 and any(not x.strip() for x in lines) and not all(b.kind in ("list", "code") for b in blocks[1:]) or len([b for b in blocks if b.kind == "para"]) > 1


# --------------------------------------------------------------------------- inline text

_INLINE = re.compile(
    r"(?P<esc>\\[!-/:-@\[-`{-~])|(?P<hard>\\\n|  +\n)|(?P<soft>[ \t]*\n)|(?P<code>(?<!`)(?P<tick>`+)(?!`)(?P<body>.*?)(?<!`)(?P=tick)(?!`))|(?P<auto><(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w.-]+)>)"
    r"|(?P<tag><!--.*?-->|<\?.*?\?>|<![A-Z][^>]*>|</?[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>)|(?P<ent>&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)"
    r"|(?P<open>!?\[)|(?P<close>\])|(?P<mark>\*+|_+|~+)",
    re.S,
)
_TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S)
_LABEL = re.compile(r"\[([^\[\]]*)\]")
BREAK = "\x00"


def inline(text: str, references: dict[str, str]) -> list[str]:
    """Pieces of plain text; BREAK for a soft or hard line break. Markup, link targets and raw tags are dropped, an image's description stays."""
    out: list[str] = []
    marks: list[list] = []  # place in out, character, number left, may open, may close
    opens: list[int] = []
    at = 0
    while at < len(text):
        m = _INLINE.search(text, at)
        if not m:
            out.append(text[at:])
            break
        if m.start() > at:
            out.append(text[at : m.start()])
        at = m.end()
        kind = m.lastgroup if m.lastgroup not in ("tick", "body") else "code"
        if kind == "esc":
            out.append(m[0][1])
        elif kind in ("hard", "soft"):
            out.append(BREAK)
        elif kind == "code":
            body = m["body"].replace("\n", " ")
            out.append(body[1:-1] if body.startswith(" ") and body.endswith(" ") and body.strip() else body)
        elif kind == "auto":
            out.append(m[0][1:-1])
        elif kind == "ent":
            out.append(html.unescape(m[0]))
        elif kind == "open":
            opens.append(len(out))
            out.append(m[0])
        elif kind == "close":
            if not opens:
                out.append("]")
                continue
            start = opens.pop()
            target = _TARGET.match(text, at)
            label = _LABEL.match(text, at)
            inner = "".join(out[start + 1 :])
            if target:
                at = target.end()
            elif label and (label[1] or inner).strip().lower() in references:
                at = label.end()
            elif inner.strip().lower() not in references:
                out.append("]")
                continue
            out[start] = ""
        elif kind == "mark":
            before, after = text[m.start() - 1 : m.start()] or " ", text[at : at + 1] or " "
            punct = lambda c: not c.isalnum() and not c.isspace()
            left = not after.isspace() and (not punct(after) or before.isspace() or punct(before))
            right = not before.isspace() and (not punct(before) or after.isspace() or punct(after))
            c = m[0][0]
            can_open, can_close = (left and (not right or punct(before)), right and (not left or punct(after))) if c == "_" else (left, right)
            if c == "~" and len(m[0]) > 2:
                can_open = can_close = False
            out.append(m[0])
            marks.append([len(out) - 1, c, len(m[0]), can_open, can_close])
    _pair(marks, out)
    return [x for x in out if x]


def _pair(marks: list[list], out: list[str]) -> None:
    """Delimiters that pair up vanish; what is left stands as text."""
    stack: list[list] = []
    for mark in marks:
        place, c, _, can_open, can_close = mark
        while can_close and mark[2]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == c and stack[k][2]), None)
            if k is None:
                break
            opener = stack[k]
            if c != "~" and (opener[4] or can_open) and (len(out[opener[0]]) + len(out[place])) % 3 == 0 and not (len(out[opener[0]]) % 3 == 0 and len(out[place]) % 3 == 0):
                break
            use = 2 if c != "~" and opener[2] >= 2 and mark[2] >= 2 else min(opener[2], mark[2]) if c == "~" else 1
            if c == "~" and opener[2] != mark[2]:
                break
            opener[2] -= use
            mark[2] -= use
            del stack[k + (1 if opener[2] else 0) :]
        if can_open and mark[2]:
            stack.append(mark)
    for place, c, left, _, _ in marks:
        out[place] = c * left


# --------------------------------------------------------------------------- nodes


class _Walk:
    def __init__(self, builder: Builder, references: dict[str, str]):
        self.b, self.references = builder, references
        self.in_list, self.ordered = False, False
        self.items: list[str] = []
        self.item = self.text = ""

    def add(self, source: str) -> None:
        for piece in inline(source, self.references):
            if piece == BREAK:
                self.text += " "
            elif self.in_list:
                self.item += piece
            else:
                self.text += piece

    def walk(self, blocks: list[Block], tight: bool = False) -> None:
        for b in blocks:
            match b.kind:
                case "para":
                    if tight:  # only its text
                        self.add(b.text)
                        continue
                    self.text = ""
                    self.add(b.text)
                    t = trim(self.text)
                    if t:
                        self.b.para(t)
                    self.text = ""
                case "heading":
                    self.text = ""
                    self.add(b.text)
                    self.b.header(b.level, trim(self.text))
                    self.text = ""
                case "code":
                    self.b.nodes.append(Node("code", trim(b.text), lang=b.lang))
                case "table":
                    cells = [["".join(p for p in inline(c, self.references) if p != BREAK).strip() for c in r] for r in b.rows]
                    if cells[0]:
                        self.b.nodes.append(Node("table", headers=cells[0], rows=cells[1:]))
                case "quote":
                    self.walk(b.blocks)
                case "list":
                    self.in_list, self.ordered, self.items = True, b.ordered, []
                    for item in b.blocks:
                        self.item = ""
                        self.walk(item.blocks, b.tight)
                        t = trim(self.item)
                        if t:
                            self.items.append(t)
                        self.item = ""
                    self.in_list = False
                    if self.items:
                        self.b.nodes.append(Node("list", ordered=self.ordered, items=self.items))
                        self.items = []


def parse_markdown(text: str, into: Builder) -> None:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    blocks = Blocks()
    tree = blocks.parse(lines)
    _Walk(into, blocks.references).walk(tree)
