"""Scalar text functions, all built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts written without spaces, one token a character.
DENSE = "\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff"


def estimate_tokens(text: Column) -> Column:
    """Characters of dense scripts, plus a quarter of the others, rounded up."""
    others = F.length(F.regexp_replace(text, f"[{DENSE}]", ""))
    return (F.length(text) - others + F.ceil(others / 4)).cast("long")


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def normalize_tag(tag: Column) -> Column:
    """Trimmed lower case; null if empty, above 64 bytes or with control characters."""
    t = F.lower(F.trim(tag))
    return F.when((t != "") & (F.octet_length(t) <= 64) & ~t.rlike(r"[\x00-\x1f\x7f]"), t)


def project_root(path: Column) -> Column:
    """The directory after a known session root, else the parent directory, else the path; null gives ''."""
    known = F.regexp_extract(path, r"/\.(?:claude/projects|codex)/([^/]+)", 1)
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.coalesce(F.when(known != "", known).when(parent != "", parent).otherwise(path), F.lit(""))


def freshness(last: Column, now: int, fresh_seconds: int = 86400) -> Column:
    return F.when(last.isNull(), "never").when(F.lit(now) - last < fresh_seconds, "fresh").otherwise("stale")


def index_terms(text: Column) -> Column:
    """Distinct search terms: lower-case runs of letters, digits and underscores, dense scripts as pairs of characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(2)))
    cut = F.flatten(F.transform(words, lambda w: F.when(w.rlike(f"^[{DENSE}]+$"), pairs(w)).otherwise(F.array(w))))
    # Most texts have no dense script and skip the walk over their words.
    return F.array_distinct(F.when(text.rlike(f"[{DENSE}]"), cut).otherwise(words))


# Words that carry no meaning in a query.
STOP_WORDS = frozenset(
    "a an and are as at be by can do does for from had has have how i in is it its me my of on or our that the their this to was we what when where which who why will with you your".split()
)
# The same in Chinese, as the pairs of characters that terms of dense scripts are.
STOP_PAIRS = frozenset("一个 没有 自己 这个 那个 什么 怎么 我们 你们 他们 可以 因为 所以 但是 如果 就是 还是 不是 这些 那些 以及 或者 已经 关于".split())


def plan_query(text: str) -> tuple[list[str], list[str]]:
    """(strict, relaxed) terms of a query: all must occur, or any meaningful one; relaxed is empty for a single term."""
    words = re.findall(r"\w+", text.lower())
    dense = re.compile("^[぀-ヿ㐀-䶿一-鿿가-힯]+$")
    terms: list[str] = []
    for w in words:
        parts = [w[i : i + 2] for i in range(max(len(w) - 1, 1))] if dense.match(w) else [w]
        terms += [p for p in parts if p not in terms]
    salient = [t for t in terms if t not in STOP_WORDS | STOP_PAIRS] or terms
    return terms, [] if len(terms) <= 1 else salient
