"""Scalar kernel: what one document's text becomes, in plain Python. It runs inside Arrow batches and is the yardstick of the column operators.

A node here is a small mutable list-free object; documents are lists of nodes.
"""

from __future__ import annotations

import html
import html.entities
import math
import re
from collections import Counter
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np

from tersloom import model as M

# White space as Unicode's White_Space property has it; str.split() would also split at U+001C to U+001F.
WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{WS}]+")
_TRIM = "".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_PUA = re.compile("[\ue000-\uf8ff]")


def trim(s: str) -> str:
    return s.strip(_TRIM)


def tokens_of(s: str) -> list[str]:
    return [x for x in _SPACES.split(s) if x]


@dataclass(slots=True)
class Node:
    kind: str
    text: str = ""
    level: int | None = None
    importance: float | None = None
    headers: list[str] | None = None
    rows: list[list[str]] | None = None
    lang: str | None = None
    ordered: bool | None = None
    items: list[str] | None = None
    key: str | None = None

    def row(self, idx: int) -> dict:
        return {"idx": idx, "kind": self.kind, "level": self.level, "text": None if self.kind in ("table", "list") else self.text, "importance": self.importance, "headers": self.headers, "rows": self.rows, "lang": self.lang, "ordered": self.ordered, "items": self.items, "key": self.key}


def node_of(r: dict) -> Node:
    return Node(r["kind"], r["text"] or "", r["level"], r["importance"], r["headers"], r["rows"], r["lang"], r["ordered"], r["items"], r["key"])


# --------------------------------------------------------------------------- tokens


def _class(ranges) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


_ASCII = re.compile(r"[\x00-\x7f]*")
_TWO, _THREE = re.compile(f"[{_class(M.TWO_PER_TOKEN)}]"), re.compile(f"[{_class(M.THREE_PER_TOKEN)}]")
_OTHER = re.compile(f"[{_class(M.TWO_PER_TOKEN)}{_class(M.THREE_PER_TOKEN)}\ue000-\uf8ff]")


def token_count(s: str) -> int:
    """Heuristic tokens: each character weighs 1/4, 1/3, 1/2 or 1; at least 1. Thirds are added up in order, as doubles round."""
    if s.isascii() or not _OTHER.search(s):
        return max(1, -(-len(s) // 4))
    if not _THREE.search(s):
        two, one = len(_TWO.findall(s)), len(_PUA.findall(s))
        return max(1, -(-(len(s) - two - one + 2 * two + 4 * one) // 4))
    total = 0.0
    for c in s:
        total += 1 / 3 if _THREE.match(c) else 1 / 2 if _TWO.match(c) else 1.0 if _PUA.match(c) else 1 / 4
    return max(1, math.ceil(total))


def strip_pua(s: str) -> str:
    return _PUA.sub("", s)


# --------------------------------------------------------------------------- parsing


def _importances() -> dict:
    f, out = np.float32, {}
    for pos in (1.0, 0.95, 0.9, 0.8, 0.65, 0.5):
        for size in (0.3, 0.55, 0.75, 0.9, 1.0):
            for head in (0.0, 1.0):
                v = (f(pos) * f(0.5) + f(size) * f(0.4)) + f(head) * f(0.1)
                out[pos, size, head] = float(min(max(v, f(0.1)), f(1.0)))
    return out


_IMPORTANCE = _importances()


def importance(place: int, chars: int, after_header: bool) -> float:
    pos = (1.0, 0.95, 0.9)[place] if place < 3 else 0.8 if place <= 5 else 0.65 if place <= 10 else 0.5
    size = 0.3 if chars <= 15 else 0.55 if chars <= 40 else 0.75 if chars <= 80 else 0.9 if chars <= 200 else 1.0
    return _IMPORTANCE[pos, size, 1.0 if after_header else 0.0]


@dataclass(slots=True)
class Builder:
    nodes: list[Node] = field(default_factory=list)
    paras: int = 0
    fresh: bool = True  # no paragraph since the last header

    def header(self, level: int, text: str) -> None:
        self.nodes.append(Node("header", text, level))
        self.fresh = True

    def para(self, text: str) -> None:
        self.nodes.append(Node("para", text, importance=importance(self.paras, len(text), self.fresh)))
        self.paras += 1
        self.fresh = False


def parse_plaintext(text: str, into: Builder | None = None) -> list[Node]:
    b = into or Builder()
    for block in text.split("\n\n"):
        block = trim(block)
        if not block:
            continue
        if block.startswith("# "):
            b.header(1, trim(block[2:]))
        elif block.startswith("## "):
            b.header(2, trim(block[3:]))
        else:
            b.para(block.replace("\n", " "))
    return b.nodes


_TITLE = re.compile(r"<title>(.*?)</title>", re.S | re.I | re.A)
_META = re.compile(r"<meta[^>]*>", re.I | re.A)
_BLOCK_TAG = re.compile(rf"<[{WS}]*/?(?:{'|'.join(M.BLOCK_ELEMENTS)})(?=[{WS}/>])[^>]*>", re.I | re.A)
_DROPPED = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", re.S | re.I | re.A)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>", re.S)
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _attribute(tag: str, name: str) -> str | None:
    for quote in ('"', "'"):
        m = re.search(f"{name}={quote}([^{quote}]*){quote}", tag, re.I)
        if m:
            return m[1]
    return None


def html_metadata(text: str) -> list[Node]:
    out = []
    m = _TITLE.search(text)
    if m and trim(m[1]):
        out.append(Node("metadata", trim(m[1]), key="title"))
    for tag in _META.findall(text):
        if re.search(r"""name=(?:"description"|'description')""", tag, re.I):
            value = _attribute(tag, "content")
            if value and trim(value):
                out.append(Node("metadata", trim(value), key="summary"))
    return out


def _closed_entity(m: re.Match) -> str:
    return html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0]


def html_text(text: str, closed: bool = False) -> str:
    """Text without tags, comments, scripts and styles; block tags leave a space; entities are decoded and ``& < >`` escaped again.
    ``closed``: only entities that end with a semicolon, as in the column version; else also old names without one, as browsers do."""
    s = _TAG.sub("", _BLOCK_TAG.sub(" ", _DROPPED.sub("", text)))
    s = _CLOSED.sub(_closed_entity, s) if closed else html.unescape(s)
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\xa0", "&nbsp;")


_FRONT = re.compile(r"\A---\r?\n(.*?)\n(?:---|\.\.\.)[^\n]*(?:\n|\Z)(.*)\Z", re.S)
_META_KEYS = {"title": "title", "summary": "summary", "description": "summary", "keywords": "keywords", "tags": "keywords"}


def front_matter(text: str) -> tuple[list[Node], str]:
    m = _FRONT.match(text)
    if not m:
        return [], text
    out = []
    for line in m[1].split("\n"):
        line = trim(line)
        if not line or line.startswith("#") or ":" not in line:
            continue
        key, value = line.split(":", 1)
        value = trim(value).strip('"').strip("'")
        name = _META_KEYS.get(trim(key).lower())
        if name and value:
            out.append(Node("metadata", value, key=name))
    return out, m[2]


def parse(text: str, kind: str, closed: bool = False) -> list[Node]:
    """``closed``: see html_text."""
    if kind == "plaintext":
        return parse_plaintext(text)
    if kind == "html":
        b = Builder(html_metadata(text))
        return parse_plaintext(strip_pua(html_text(text, closed)), b)
    from tersloom.markdown import parse_markdown

    meta, body = front_matter(text)
    b = Builder(meta)
    parse_markdown(body, b)
    return b.nodes


# --------------------------------------------------------------------------- compression


class Stopwords:
    def __init__(self, words=M.STOPWORDS):
        words = [w for w in words if token_count(w) > 1]
        plain = sorted({w.lower() for w in words if w.isascii()}, key=lambda w: (-len(w), w))
        self.other = frozenset(w for w in words if not w.isascii())
        self.pattern = re.compile(rf"(?<![A-Za-z0-9_])(?:{'|'.join(map(re.escape, plain))})(?![A-Za-z0-9_])[ \t]*", re.I | re.A) if plain else None

    def strip(self, text: str) -> str:
        if not (self.pattern or self.other):
            return text
        if self.pattern:
            text = self.pattern.sub("", text)
        return " ".join(x for x in tokens_of(text) if x not in self.other)


_DEFAULT = Stopwords()


def ratio(current: int, budget: int) -> float:
    return current / budget if budget else 1.0


def stage_of(current: int, budget: int, fidelity: str) -> int:
    r = ratio(current, budget)
    auto = sum(r >= x for x in M.STAGE_LIMITS)
    return max(auto, 1 if fidelity == "compressed" else 0)


def prune(nodes: list[Node], fifths: int = 1) -> list[Node]:
    """Drops paragraphs of the lowest ``fifths`` fifths of importance, in document order, two fifths of them at most."""
    values = sorted(n.importance for n in nodes if n.kind == "para")
    count = len(values)
    if count <= 1:
        return nodes
    cutoff = values[min(count * fifths // 5, count - 1)]
    if cutoff >= values[-1]:
        return nodes
    left, out = max(2 * count // 5, 1), []
    for n in nodes:
        if n.kind == "para" and n.importance <= cutoff and left:
            left -= 1
        else:
            out.append(n)
    return out


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def dedup(nodes: list[Node]) -> list[Node]:
    """Greedy: a paragraph goes if its token set is near that of a kept one. Sizes alone rule most pairs out."""
    kept: list[frozenset] = []
    out = []
    for n in nodes:
        if n.kind == "para":
            mine = frozenset(tokens_of(n.text.lower()))
            if mine:
                size = len(mine)
                if any(0.85 * max(size, len(k)) <= min(size, len(k)) + 1e-9 and jaccard(mine, k) >= M.NEAR_DUPLICATE for k in kept):
                    continue
                kept.append(mine)
        out.append(n)
    return out


_WORD_BEFORE = re.compile(r"(?:[^\W_]|\.)*\Z")
_LETTERS_AFTER = re.compile(r"(?:[A-Za-z]\.)*")
_STOPS = re.compile(f"[.{M.SENTENCE_ENDS}]")


def _continues(text: str, at: int) -> bool:
    """Whether the period at ``at`` is inside a number or an abbreviation."""
    after, before = text[at + 1 : at + 2], text[at - 1 : at] if at else ""
    if after.isdigit() and after.isascii():
        return True
    if before.isdigit() and before.isascii():
        return False
    token = _WORD_BEFORE.search(text, max(0, at - 64), at)[0] + _LETTERS_AFTER.match(text, at + 1)[0]
    letters = "".join(filter(str.isalpha, token)).lower()
    return letters in M.ABBREVIATIONS and (letters != "us" or "." in token)


def first_sentence(text: str) -> str:
    for m in _STOPS.finditer(text):
        if m[0] != "." or not _continues(text, m.start()):
            return trim(text[: m.end()])
    return trim(text)


def collapse_lists(nodes: list[Node]) -> list[Node]:
    return [Node("para", ", ".join(n.items), importance=0.5) if n.kind == "list" and n.items else n for n in nodes]


def rust_lines(s: str) -> list[str]:
    """Lines at \\n, a \\r before it dropped; no line after a closing \\n."""
    lines = s.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


_WEAK = float(np.float32(0.3))


def summarize_code(nodes: list[Node]) -> list[Node]:
    out = []
    for n in nodes:
        if n.kind == "code":
            k = sum(1 for x in rust_lines(n.text) if trim(x))
            n = Node("para", f"[{n.lang or 'code'} {k}L]", importance=_WEAK) if k else Node("para", "", importance=0.0)
        out.append(n)
    return out


def compress(nodes: list[Node], budget: int, current: int, fidelity: str, stopwords: Stopwords = _DEFAULT) -> list[Node]:
    if fidelity == "lossless":
        return nodes
    stage = stage_of(current, budget, fidelity)
    nodes = [replace(n, text=stopwords.strip(n.text)) if n.kind in ("para", "header") else n for n in nodes]
    if stage >= 1:
        nodes = prune(nodes)
    if stage >= 2:
        nodes = dedup(nodes)
    if stage >= 3:
        nodes = [replace(n, text=first_sentence(n.text)) if n.kind == "para" else n for n in nodes]
        if fidelity == "compressed":
            nodes = prune(summarize_code(collapse_lists(nodes)))
    return nodes


def compress_to_budget(nodes: list[Node], text: str, budget: int, fidelity: str, stopwords: Stopwords = _DEFAULT) -> list[Node]:
    """One pass by the raw text's tokens, then up to four by those of the rendered text, until it fits or nothing goes any more."""
    nodes = compress(nodes, budget, token_count(text), fidelity, stopwords)
    before = None
    for _ in range(4):
        now = token_count(render(nodes, fidelity, {}))
        if now <= budget or len(nodes) == before:
            break
        before = len(nodes)
        # over budget: the ratio is above 1, so the last stage
        nodes = compress(nodes, budget, now, fidelity, stopwords)
    return nodes


# --------------------------------------------------------------------------- symbols


def frequent_terms(nodes: list[Node], least: int = M.MIN_FREQ, most: int = M.MAX_TERMS) -> list[tuple[str, int]]:
    """The commonest terms by count, ties by code point, before any gate."""
    seen: Counter[str] = Counter()
    for n in nodes:
        if n.kind in ("para", "header"):
            seen.update(tokens_of(n.text))
        elif n.kind == "list":
            for x in n.items or ():
                seen.update(tokens_of(x))
    some = [(t, c) for t, c in seen.items() if c >= least and len(t.encode()) >= (3 if t.isascii() else 2)]
    return sorted(some, key=lambda x: (-x[1], x[0]))[:most]


def pays(count: int, tokens: int, cost: int = M.PUA_TOKEN_COST) -> bool:
    return tokens > cost and count * (tokens - cost) > cost + tokens + 4


def intern(nodes: list[Node]) -> dict[str, str]:
    """term -> private-use character, from the first on, in order of acceptance."""
    terms = [t for t, c in frequent_terms(nodes) if pays(c, token_count(t))]
    return {t: chr(M.PUA_FIRST + i) for i, t in enumerate(terms)}


class SymbolOverflow(ValueError):
    pass


class SymbolDict:
    """Terms and their private-use characters; interning is idempotent."""

    def __init__(self, terms: dict[str, str] | None = None):
        self.terms: dict[str, str] = dict(terms or {})

    def intern(self, term: str) -> str:
        if term not in self.terms:
            at = M.PUA_FIRST + len(self.terms)
            if at > M.PUA_LAST:
                raise SymbolOverflow(term)
            self.terms[term] = chr(at)
        return self.terms[term]

    def __len__(self) -> int:
        return len(self.terms)

    def encode(self, s: str) -> str:
        return encode(s, self.terms)

    def decode(self, s: str) -> str:
        back = {v: k for k, v in self.terms.items()}
        return "".join(back.get(c, c) for c in s)

    def header(self) -> str:
        return dict_block(self.terms)


@lru_cache(maxsize=64)
def _matcher(terms: tuple[str, ...]):
    return re.compile("|".join(map(re.escape, sorted(terms, key=lambda t: (-len(t), t)))))


def encode(s: str, terms: dict[str, str]) -> str:
    """Leftmost, then longest, without regard to word ends."""
    return _matcher(tuple(terms)).sub(lambda m: terms[m[0]], s) if terms and s else s


def dict_block(terms: dict[str, str]) -> str:
    return "<D>\n" + "".join(f"{v}={k}\n" for k, v in sorted(terms.items(), key=lambda x: x[1])) + "</D>\n" if terms else ""


# --------------------------------------------------------------------------- rendering


def linearize_table(headers: list[str], rows: list[list[str]]) -> str:
    if not rows:
        return ""
    h, cells = [trim(x) for x in headers], [[trim(x) for x in r] for r in rows]
    if len(rows) > 5:
        return "\n".join("|".join(r) for r in [h, *cells])
    return "\n".join(f"[{i}] " + ", ".join(f"{a}:{b}" for a, b in zip(h, r, strict=False)) for i, r in enumerate(cells, 1))


def render_node(n: Node, terms: dict[str, str]) -> str:
    match n.kind:
        case "header":
            return "#" * n.level + " " + trim(encode(n.text, terms))
        case "para":
            return encode(trim(_SPACES.sub(" ", n.text)), terms)
        case "table":
            return linearize_table(n.headers, n.rows)
        case "code":
            return f"```{n.lang or ''}\n{trim(n.text)}\n```"
        case "list":
            return "\n".join((f"{i}. " if n.ordered else "- ") + trim(encode(x, terms)) for i, x in enumerate(n.items, 1))
    return ""


_MARKS = {lang: mark for mark, langs in (("//", M.SLASH_LANGS), ("#", M.HASH_LANGS), ("--", M.DASH_LANGS)) for lang in langs}


def strip_comments(body: str, lang: str | None) -> str:
    mark, out, blank = _MARKS.get(lang or ""), [], False
    for line in rust_lines(body):
        t = trim(line)
        if mark and t.startswith(mark) and not (mark == "#" and t.startswith("#!")):
            continue
        if t or not blank:
            out.append(line)
        blank = not t
    return "\n".join(out)


def strip_repeated_header(para: str, header: str) -> str:
    h, p = trim(header), trim(para)
    if h and p.startswith(h):
        rest = p[len(h) :]
        if not rest or rest[0] in _TRIM:
            return trim(rest)
    return p


def yaml_header(nodes: list[Node]) -> str:
    first: dict[str, str] = {}
    for n in nodes:
        if n.kind == "metadata":
            first.setdefault(n.key, n.text)
    lines = [f"{k}: {first[name]}" for k, name in (("t", "title"), ("s", "summary")) if first.get(name)]
    if first.get("keywords"):
        lines.append("k: [" + ", ".join(trim(x) for x in first["keywords"].split(",")) + "]")
    return "\n".join(lines)


def render(nodes: list[Node], fidelity: str, terms: dict[str, str]) -> str:
    shrink, header, body = fidelity != "lossless", None, []
    for n in nodes:
        if n.kind == "metadata":
            continue
        if n.kind == "code" and shrink:
            out = f"```{n.lang or ''}\n{trim(strip_comments(n.text, n.lang))}\n```"
        else:
            out = render_node(n, terms)
        if n.kind == "para" and shrink and header is not None:
            out = strip_repeated_header(out, header)
        if n.kind == "header":
            header = n.text
        elif n.kind != "para" or shrink:
            header = None
        if out:
            body.append(out)
    head = yaml_header(nodes)
    return dict_block(terms) + (f"<H>\n{trim(head)}\n</H>\n" if head else "") + f"<B>\n{trim(chr(10).join(body))}\n</B>"


class InputTooLarge(ValueError):
    pass


def transpile(text: str, kind: str = "plaintext", fidelity: str = "semantic", budget: int | None = None, stopwords: Stopwords = _DEFAULT) -> str:
    if len(text.encode()) > M.MAX_INPUT_BYTES:
        raise InputTooLarge(len(text))
    clean = strip_pua(text)
    nodes = parse(clean, kind)
    if budget is not None and fidelity != "lossless":
        nodes = compress_to_budget(nodes, clean, budget, fidelity, stopwords)
    return render(nodes, fidelity, intern(nodes) if fidelity != "lossless" else {})


def stream(text: str, kind: str, fidelity: str, budget: int, terms: dict[str, str] | None = None, strict_final: bool = False) -> list[dict]:
    """Chunks of one document: a header chunk, then one a rendered node until the running tokens reach the budget. Without ``strict_final`` the last chunk
    of a document whose last node renders empty is not marked final."""
    if len(text.encode()) > M.MAX_INPUT_BYTES:
        raise InputTooLarge(len(text))
    nodes, terms = parse(strip_pua(text), kind), terms or {}
    head = yaml_header(nodes)
    content = dict_block(terms) + (f"<H>\n{trim(head)}\n</H>\n" if head else "") + "<B>"
    out = [{"sequence": 0, "content": content, "token_count": token_count(content), "is_final": not nodes}]
    if not nodes:
        return out
    spent = out[0]["token_count"]
    use = "compressed" if ratio(spent, budget) >= M.STREAM_SWITCH and fidelity != "lossless" else fidelity
    body = [n for n in nodes if n.kind != "metadata"]
    body = compress(body, budget, spent, use)
    for i, n in enumerate(body):
        shown = render_node(n, terms)
        if not shown:
            continue
        spent += token_count(shown)
        cut = 0 < budget <= spent
        final = cut or i == len(body) - 1
        content = trim(shown) + "\n</B>" if final else shown
        out.append({"sequence": len(out), "content": content, "token_count": token_count(content), "is_final": final})
        if cut:
            break
    if len(out) == 1 or (strict_final and not out[-1]["is_final"]):
        out.append({"sequence": len(out), "content": "</B>", "token_count": token_count("</B>"), "is_final": True})
    return out
