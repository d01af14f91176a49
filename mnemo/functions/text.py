"""Query tokenizing and text-match predicates (whitespace as JavaScript
defines it, see ``mnemo.fixed``)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemo.fixed import JAVA_WS_CLASS, JS_WS_CLASS

_PY_WS = re.compile(JS_WS_CLASS + "+")
_PY_TRIM = re.compile(f"^{JS_WS_CLASS}+|{JS_WS_CLASS}+$")


def jvm_lower(s: str) -> str:
    """Lower-case exactly as Spark's ``lower`` does (the function that built
    ``search_text``), which, like JavaScript, is context-aware (a final
    sigma becomes 'ς'); Python's ``str.lower`` is not."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    try:
        return sc._jvm.org.apache.spark.unsafe.types.UTF8String.fromString(s).toLowerCase().toString()
    except Exception:  # noqa: BLE001 -- no JVM at hand (e.g. plain unit use)
        return s.lower()


def js_trim(s: str) -> str:
    return _PY_TRIM.sub("", s)


def is_blank_query(query: str | None) -> bool:
    """Missing, empty or whitespace-only: the query matches everything."""
    return query is None or js_trim(query) == ""


def tokenize(query: str | None) -> list[str]:
    """Query words: lower-case, trim, split on whitespace runs.

    No stemming, stop words or de-duplication. A blank query gives [].
    """
    if is_blank_query(query):
        return []
    return _PY_WS.split(js_trim(jvm_lower(query)))


def tokenize_col(query) -> Column:
    """Column form of :func:`tokenize`, for queries held as data. A blank
    query gives an empty array (splitting '' would give [''])."""
    q = F.col(query) if isinstance(query, str) else query
    trimmed = F.regexp_replace(F.lower(q), f"^{JAVA_WS_CLASS}+|{JAVA_WS_CLASS}+$", "")
    return F.when(q.isNull() | (trimmed == ""), F.array().cast("array<string>")) \
        .otherwise(F.split(trimmed, JAVA_WS_CLASS + "+"))


def any_word_matches(text_col, words: list[str]) -> Column:
    """Some word is a substring of the (lower-cased) search text.

    Unrolled into an OR of ``contains`` so it stays code-generated; an
    empty word list matches everything.
    """
    t = F.col(text_col) if isinstance(text_col, str) else text_col
    if not words:
        return F.lit(True)
    uniq = list(dict.fromkeys(words))
    return reduce(lambda a, b: a | b, [t.contains(F.lit(w)) for w in uniq])


def any_word_matches_col(text_col, words_col) -> Column:
    """Same as :func:`any_word_matches` with the words held in a column
    (bulk search); an empty array matches everything."""
    t = F.col(text_col) if isinstance(text_col, str) else text_col
    w = F.col(words_col) if isinstance(words_col, str) else words_col
    return (F.size(w) == 0) | F.exists(w, lambda x: t.contains(x))
