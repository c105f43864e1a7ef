"""Column functions on text and on token counts; all JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersloom import model as M
from tersloom.kernel import token_count as kernel_token_count

#: White space as Unicode's White_Space property, inside a Java character class.
WS = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def _class(ranges) -> str:
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


TWO, THREE, ONE = _class(M.TWO_PER_TOKEN), _class(M.THREE_PER_TOKEN), _class([(M.PUA_FIRST, M.PUA_LAST)])


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once. A column that a lambda refers to may be inlined and then computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_pua(c: Column | str) -> Column:
    return F.regexp_replace(col(c), ONE, "")


def trim(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^[{WS}]+|[{WS}]+$", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), f"[{WS}]+", " "))


def tokens_of(c: Column | str) -> Column:
    return F.filter(F.split(squeeze(c), " "), lambda x: x != "")


def too_large(c: Column | str) -> Column:
    return F.octet_length(col(c)) > M.MAX_INPUT_BYTES


def class_count(c: Column | str, chars: str) -> Column:
    c = col(c)
    return F.length(c) - F.length(F.regexp_replace(c, chars, ""))


def _weight(ch: Column) -> Column:
    return F.when(ch.rlike(THREE), F.lit(1.0) / F.lit(3.0)).when(ch.rlike(TWO), 0.5).when(ch.rlike(ONE), 1.0).otherwise(0.25)


def token_fold(c: Column | str) -> Column:
    """Weights added up one by one, as doubles round; for texts with characters of three to a token."""
    total = F.aggregate(F.filter(F.split(col(c), ""), lambda x: x != ""), F.lit(0.0), lambda acc, x: acc + _weight(x))
    return F.greatest(F.lit(1), F.ceil(total)).cast("int")


def token_count(c: Column | str) -> Column:
    """Heuristic tokens, at least 1. In twelfths of a token as integers unless a character weighs a third."""
    c = col(c)
    two, one, three = class_count(c, TWO), class_count(c, ONE), class_count(c, THREE)
    twelfths = (F.length(c) - two - one) * 3 + two * 6 + one * 12
    exact = F.greatest(F.lit(1), F.ceil(twelfths / 12)).cast("int")
    plain = F.greatest(F.lit(1), F.ceil(F.length(c) / 4)).cast("int")
    # one scan decides for most texts
    return F.when(~c.rlike(f"{TWO}|{THREE}|{ONE}"), plain).when(three > 0, token_fold(c)).otherwise(exact)


def strip_stopwords(c: Column | str, words=M.STOPWORDS) -> Column:
    """ASCII words without regard to case and where no ASCII word character adjoins, with the blanks after them; other words as whole tokens."""
    c = col(c)
    words = [w for w in words if kernel_token_count(w) > 1]
    ascii_words = sorted({w.lower() for w in words if w.isascii()}, key=lambda w: (-len(w), w))
    other = [w for w in words if not w.isascii()]
    if not words:
        return c
    if ascii_words:
        c = F.regexp_replace(c, r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(ascii_words) + r")(?![A-Za-z0-9_])[ \t]*", "")
    c = squeeze(c)
    if other:
        # only a text that holds one is split
        has = reduce(lambda a, b: a | b, (c.contains(w) for w in other))
        c = F.when(has, F.array_join(F.filter(F.split(c, " "), lambda x: ~x.isin(other)), " ")).otherwise(c)
    return c


def reduction_pct(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.lit(0.0)).otherwise(100.0 - after / before * 100.0)


def symbol(rank: Column) -> Column:
    """The private-use character of a rank from 1 on."""
    return F.decode(F.unhex(F.lpad(F.hex((rank + (M.PUA_FIRST - 1)).cast("long")), 4, "0")), "UTF-16BE")


def usage_ratio(current: Column, budget: Column) -> Column:
    return F.when(budget == 0, 1.0).otherwise(current.cast("double") / budget)


def stage(current: Column, budget: Column, fidelity: Column) -> Column:
    r = usage_ratio(current, budget)
    a, b, c = M.STAGE_LIMITS
    auto = F.when(r < a, 0).when(r < b, 1).when(r < c, 2).otherwise(3)
    return F.greatest(auto, F.when(fidelity == "compressed", 1).otherwise(0))


def detect_format(path: Column | str, default: str = "markdown") -> Column:
    ext = F.regexp_extract(col(path), r"\.([^./]+)$", 1)
    return F.when(ext.isin("html", "htm"), "html").when(ext == "txt", "plaintext").when(ext.isin("md", "markdown"), "markdown").otherwise(default)


def shortened(c: Column | str, most: int) -> Column:
    c = col(c)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 1)), F.lit("…"))).otherwise(c)


def html_escape(c: Column | str) -> Column:
    c = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def script_safe(c: Column | str) -> Column:
    c = F.replace(col(c), F.lit("</"), F.lit("<\\/"))
    return F.replace(F.replace(c, F.lit("\u2028"), F.lit("\\u2028")), F.lit("\u2029"), F.lit("\\u2029"))


def spaced_thousands(c: Column) -> Column:
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit(" "))


def pct_class(c: Column, ok: float = 5.0) -> Column:
    return F.when(c >= 20, "good").when(c >= ok, "ok").otherwise("low")


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value: in double quotes, else in single quotes."""
    double, single = F.regexp_extract(tag, f'(?i){name}="([^"]*)"', 1), F.regexp_extract(tag, f"(?i){name}='([^']*)'", 1)
    return F.when(double != "", double).otherwise(single)


def iso_second(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def run_id(iso: Column) -> Column:
    return F.translate(F.replace(iso, F.lit("T"), F.lit("_")), ":Z", "-")
