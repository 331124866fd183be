"""Choosing episodes worth distilling and building the records derived from them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHORTEST, PLATEAU, HALF_LIFE, PASS = 40, 600, 30.0, 0.4


def gate_score(content: Column, created_at: Column, now: int) -> Column:
    """0.45 length + 0.20 recency + 0.35 density of letters, each in 0..1."""
    n = F.length(content)
    ramp = lambda x, low, high: F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    length = ramp(n, SHORTEST, PLATEAU)
    age = (F.lit(now) - created_at) / 86400.0
    recency = F.when(age <= 0, 1.0).otherwise(F.pow(F.lit(2.0), -age / HALF_LIFE))
    letters = F.length(F.regexp_replace(content, r"[^\p{L}]", ""))
    density = ramp(letters / F.greatest(n, F.lit(1)), 0.40, 0.65)
    return 0.45 * length + 0.20 * recency + 0.35 * density


def candidates(records: DataFrame, now: int, limit: int = 25, least: float = PASS) -> DataFrame:
    """The best episodes at or above the threshold, ties by id."""
    scored = records.filter(F.col("kind") == "episode").withColumn("score", F.round(gate_score(F.col("content"), F.col("created_at"), now), 6))
    return scored.filter(F.col("score") >= least).orderBy(F.col("score").desc(), "id").limit(limit)


def planned(chosen: DataFrame, most_calls: int, most_chars: int) -> DataFrame:
    """id, call, content of the episodes that stage two will send, best first: at most ``most_calls``, and none longer than ``most_chars``."""
    fits = chosen.filter(F.length("content") <= most_chars)
    call = F.row_number().over(Window.orderBy(F.col("score").desc(), "id"))  # over the bounded list of candidates
    return fits.select("id", "score", "content", call.alias("call")).filter(F.col("call") <= most_calls)


def first_sentences(text: str) -> str:
    """A provider for tests and offline use: the first sentences as a JSON list."""
    return json.dumps([s.strip() for s in text.replace("\n", " ").split(". ")[:2] if s.strip()], ensure_ascii=False)


def parse_items(answer: str) -> list[str]:
    """Items of a model's answer: a list of strings or of objects with content, one string, else the whole text."""
    try:
        value = json.loads(answer)
    except ValueError:
        return [answer.strip()] if answer.strip() else []
    if isinstance(value, str):
        value = [value]
    if not isinstance(value, list):
        return [answer.strip()]
    texts = [v if isinstance(v, str) else v.get("content") if isinstance(v, dict) else None for v in value]
    return [t.strip() for t in texts if isinstance(t, str) and t.strip()]


def derive(records: DataFrame, provider: Callable[[str], str] = first_sentences) -> DataFrame:
    """id, derived_from, kind, content of the records distilled from each given record; a failing call gives no row and an error instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    out += [(key, n, t, None) for n, t in enumerate(parse_items(provider(text)))]
                except Exception as e:  # a provider may fail in any way
                    out.append((key, 0, None, str(e)))
            c = list(zip(*out, strict=True)) if out else [()] * 4
            types = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=["derived_from", "seq", "content", "error"])

    rows = records.select("id", "content").mapInArrow(run, "derived_from string, seq int, content string, error string")
    return rows.select(F.sha2(F.concat_ws(":", "derived_from", F.col("seq").cast("string")), 256).alias("id"), "derived_from", F.lit("fact").alias("kind"), "content", "error")
