"""Rates and scores of the evaluation, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersloom.functions import text as X


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def percent(part: Column, whole: Column) -> Column:
    """Ratio of sums in percent; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole * 100.0)


def tokens_per_ms(tokens: Column, micros: Column) -> Column:
    return F.when(micros == 0, tokens * 1000.0).otherwise(tokens / micros * 1000.0)


def composite(reduction: Column, coverage: Column, throughput: Column, lossless: Column, source: Column) -> Column:
    """Weights .40, .30, .15, .15; throughput on a log scale that ends at 1000 tokens a millisecond."""
    speed = F.when(throughput > 0, clamp(F.log10(throughput) / 3.0)).otherwise(0.0)
    growth = F.when(source == 0, F.lit(1.0)).otherwise(lossless / source)
    return 0.40 * clamp(reduction / 40.0) + 0.30 * clamp(coverage / 100.0) + 0.15 * speed + 0.15 * clamp(2.0 - growth)


def coverage_words(source: Column) -> Column:
    """Distinct words of more than 5 bytes that are letters only."""
    return F.array_distinct(F.filter(X.tokens_of(source), lambda w: (F.octet_length(w) > 5) & w.rlike(r"^\p{IsAlphabetic}+$")))


def word_coverage(source: Column, shown: Column) -> Column:
    """Share of the source's words that occur in the output, in percent; 100 if it has none."""
    share = lambda ws, s: F.when(F.size(ws) == 0, 100.0).otherwise(F.size(F.filter(ws, lambda w: F.contains(s, w))) / F.size(ws) * 100.0)
    return X.let(shown, lambda s: X.let(coverage_words(source), lambda ws: share(ws, s)))


def without_noncontent(c: Column) -> Column:
    """Comments, scripts and styles go, in lower case only; an unclosed one takes the rest."""
    for start, end in (("<!--", "-->"), ("<script", "</script>"), ("<style", "</style>")):
        c = F.regexp_replace(c, rf"(?s){start}.*?(?:{end}|\z)", "")
    return c


def nearest_rank(sorted_values: Column, p: int) -> Column:
    """The value at round(p / 100 * (n - 1)), half away from zero; no interpolation."""
    n = F.size(sorted_values)
    return F.get(sorted_values, F.round(F.lit(p / 100.0) * (n - 1)).cast("int"))
