"""Line-first quality rules: punctuation, navigation and boilerplate rules per line, then rejection of documents that lose too much."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tersloom.llm.common import Words, mix, small_batches, table, texts_of

# Fixed values of the contract.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
# Fixed values of the method.
SHORT_LINE = 8  # a line of fewer words must end like a sentence
ENDS = r"""[.!?:;,…。！？"'”’»)\]][\x20\x09-\x0D]*$"""
SEPARATORS = "|›»•>"
BOILERPLATE = (
    r"all rights reserved|copyright (?:\(c\)|©)|terms of (?:use|service)|privacy policy|cookie policy|use of cookies|accept (?:all )?cookies|enable javascript|lorem ipsum"
    r"|click here|read more|sign up|log ?in to|subscribe to|skip to (?:main )?content|back to top|share (?:this|on)|follow us|powered by|licensed under|general public license"
    r"|permission is hereby granted|without warranty of any kind|redistribution and use in source"
)
MOST_LOST_PERCENT = 50

_END = re.compile(ENDS)
_BOILER = re.compile(BOILERPLATE)
_SEPS = re.compile(f"[{re.escape(SEPARATORS)}]")
_LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SYM = np.zeros(256, bool)
_SYM[list(SYMBOLS)] = True
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def failed_rule(line: bytes) -> str | None:
    """The first rule that a line with a word fails."""
    n = len(line.split())
    symbols = sum(map(line.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    text = line.translate(_LOW).decode()
    if 10 * symbols > sum(map(len, text.split(None))) if not text.isascii() else 10 * symbols > len(line) - sum(map(line.count, (b" ", b"\t", b"\v", b"\f", b"\r"))):
        return "punctuation"
    if n < SHORT_LINE and not _END.search(text):
        return "punctuation"
    seps = len(_SEPS.findall(text)) if not text.isascii() or b"|" in line or b">" in line else 0
    if seps >= 2 and 4 * seps >= n:
        return "navigation"
    if _BOILER.search(text):
        return "boilerplate"
    return None


def repeated_words(words: np.ndarray) -> int:
    """Words in 3-word windows that are found twice or more, first ones included."""
    n = len(words)
    if n < 4:
        return 0
    with np.errstate(over="ignore"):
        w = mix(words[:-2] * _K[0] + mix(words[1:-1] * _K[1]) + mix(mix(words[2:] * _K[2])))
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(w, np.unique(twice))
    covered = np.zeros(n, bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def measured(texts: list[bytes], cleaned: bool) -> dict[str, list]:
    w = Words(texts, lower=False)
    ends = np.append(w.at, len(w.buf))
    points = np.zeros(len(w.buf) + 1, np.int64)
    points[1:] = np.cumsum(((w.buf & 0xC0) != 0x80) & ~((w.buf == 32) | ((w.buf >= 9) & (w.buf <= 13))))
    marks = np.zeros(len(w.buf) + 1, np.int64)
    marks[1:] = np.cumsum(_SYM[w.buf])
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "lost_punctuation", "lost_navigation", "lost_boilerplate", "lost_words", *(["text"] if cleaned else []))}
    for i, text in enumerate(texts):
        mine = w.hash[w.first[i] : w.first[i + 1]]
        n, repeated = len(mine), repeated_words(mine)
        seen, dups, lines, lost, lost_words, left = set(), 0, 0, {"punctuation": 0, "navigation": 0, "boilerplate": 0}, 0, []
        for line in text.split(b"\n"):
            if not line or line.isspace():
                left.append(line)
                continue
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
            rule = failed_rule(line)
            if rule:
                lost[rule] += 1
                lost_words += len(line.split())
            else:
                left.append(line)
        base = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * n
        row = (n, int(points[ends[i + 1]] - points[ends[i]]), int(marks[ends[i + 1]] - marks[ends[i]]), dups, repeated, base, not base and 100 * lost_words <= MOST_LOST_PERCENT * n, lines, *lost.values(), lost_words)
        for k, v in zip(out, row, strict=False):
            out[k].append(v)
        if cleaned:
            out["text"].append(b"\n".join(left))
    return out


def cleaned_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, lines lost to each rule, and the text without the failing lines.

    One pass, no shuffle: a row in gives a row out. Null and empty texts have no words and fail the base. Lines without a word stay and are not
    judged. Repeated rows are judged alike; an empty table gives no rows; other columns are ignored. A text is judged whole, whatever its length.
    """
    cols = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, lost_punctuation long, lost_navigation long, lost_boilerplate long, lost_words long"
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, {cols}" + (", text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            got = measured(texts_of(b.column(1)), with_text)
            arrays = [pa.array(v, pa.bool_() if k in ("base_failed", "kept") else pa.string() if k == "text" else pa.int64()) for k, v in got.items() if k != "text"]
            if with_text:
                arrays.append(pa.array(got["text"], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", *got])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_lines(table(spark, sf_dir, "documents"), with_text=False)


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
pos AS (SELECT doc_id, generate_subscripts(words, 1) AS i, words FROM w),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS g FROM pos WHERE i + 2 <= len(words)),
twice AS (SELECT doc_id, g FROM win GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN twice USING (doc_id, g), (VALUES (0), (1), (2)) o(k)),
rep AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY 1),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
l0 AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM cut),
l1 AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, len(regexp_extract_all(line, '[#*$%&|<>]')) AS syms, len(regexp_extract_all(line, '[|›»•>]')) AS seps,
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l2 AS (SELECT *, CASE WHEN 10 * syms > chars OR (n < {SHORT_LINE} AND NOT regexp_matches(low, '{ENDS.replace(chr(39), chr(39) * 2)}')) THEN 'punctuation'
    WHEN seps >= 2 AND 4 * seps >= n THEN 'navigation' WHEN regexp_matches(low, '{BOILERPLATE}') THEN 'boilerplate' END AS rule FROM l1),
l3 AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE nth > 1) AS n_dup_lines, count(*) FILTER (WHERE rule = 'punctuation') AS lost_punctuation, count(*) FILTER (WHERE rule = 'navigation') AS lost_navigation,
    count(*) FILTER (WHERE rule = 'boilerplate') AS lost_boilerplate, coalesce(sum(n) FILTER (WHERE rule IS NOT NULL), 0)::BIGINT AS lost_words FROM l2 GROUP BY 1),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(lost_punctuation, 0)::BIGINT AS lost_punctuation, coalesce(lost_navigation, 0)::BIGINT AS lost_navigation, coalesce(lost_boilerplate, 0)::BIGINT AS lost_boilerplate, coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN l3 USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_words <= {MOST_LOST_PERCENT} * n_words AS kept, n_lines, lost_punctuation, lost_navigation, lost_boilerplate, lost_words
FROM m
"""
