"""Prose measures that need more than a pattern: syllables and sentences."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import LONG_ENTROPY, LONG_TOKEN, REDACTIONS, SIGNATURES, entropy

_WORD = re.compile(r"[a-z]+")
_VOWELS = re.compile(r"[aeiouy]+")
#: Abbreviations that don't end a sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr prof st vs etc e.g i.e jr sr no".split())


def syllables(word: str) -> int:
    """Vowel groups of a lower-case word; a silent final e, es or ed doesn't count, and every word has one."""
    n = len(_VOWELS.findall(word))
    if n > 1 and (word.endswith("e") and not word.endswith("le") or re.search(r"[^aeiouytd](es|ed)$", word)):
        n -= 1
    return max(n, 1)


def sentences(text: str) -> int:
    """Stops followed by white space and not by an abbreviation or an initial before them."""
    n = 0
    for m in re.finditer(r"(\S+)[.!?]+(?=\s|$)", text):
        word = m[1].lower().lstrip("(\"'")
        n += not (word in ABBREVIATIONS or (len(word) == 1 and m[1].isupper()))
    return max(n, int(bool(text.strip())))


def _map(df: DataFrame, name: str, f) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], name: [f(x or "") for x in b["text"]]})

    return df.mapInPandas(run, f"doc_id long, {name} long")


def syllable_counts(df: DataFrame) -> DataFrame:
    return _map(df, "syllables", lambda x: sum(map(syllables, _WORD.findall(x.lower()))))


def sentence_counts(df: DataFrame) -> DataFrame:
    return _map(df, "sentences", sentences)


def composed(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, text) with texts in the normal form NFC, which Spark has no function for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[None if x is None else unicodedata.normalize("NFC", x) for x in b["text"]])

    return df.mapInPandas(run, df.schema)


def redacted(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, text) with what looks like personal data or a secret replaced, and a count for each detector. The
    detectors follow each other; a long token goes if it isn't all letters and its entropy is high."""
    for name, pattern, mark in REDACTIONS:
        df = df.withColumn(name, F.regexp_count("text", F.lit("(?U)" + pattern)).cast("long")).withColumn("text", F.regexp_replace("text", "(?U)" + pattern, F.lit(mark)))
    df = df.withColumn("_parts", F.split("text", "(?U)" + LONG_TOKEN)).withColumn("_tokens", F.regexp_extract_all("text", F.lit("(?U)" + LONG_TOKEN), 0))
    secret = lambda x: ~x.rlike(r"^\p{L}+$") & (entropy(x) >= LONG_ENTROPY)
    marked = F.transform("_tokens", lambda x: F.when(secret(x), "[SECRET]").otherwise(x))
    joined = F.array_join(F.flatten(F.zip_with("_parts", marked, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return df.select("doc_id", joined.alias("text"), *(n for n, _, _ in REDACTIONS), F.size(F.filter("_tokens", secret)).cast("long").alias("long_token"))


def _bits(x: str) -> float:
    return -sum(c / len(x) * math.log2(c / len(x)) for c in Counter(x).values())


def line_secrets(line: str, allowed: frozenset[str] = frozenset()) -> list[tuple[int, str, float, str, str]]:
    """(column, rule, entropy, fingerprint, shown part) of the secrets of a line. Rules go in order and the first to match a
    span owns it, also where its finding is allowed; a match under its rule's entropy leaves the span free."""
    taken: list[tuple[int, int]] = []
    found = []
    for rule, pattern, group, least in _RULES:
        for m in pattern.finditer(line):
            at, to = m.span(group)
            if at == to or any(a < to and at < b for a, b in taken) or least is not None and _bits(line[at:to]) < least:
                continue
            taken.append((at, to))
            mark = hashlib.sha256(f"{rule}:{line[at:to]}".encode()).hexdigest()[:16]
            if mark not in allowed and rule not in allowed:
                found.append((at + 1, rule, round(_bits(line[at:to]), 2), mark, f"{line[at : at + 4]}…({to - at} chars)"))
    return sorted(found)


_RULES = [(k, re.compile(p), g, least) for k, p, g, least in SIGNATURES]


def secrets_of(df: DataFrame, allowed: frozenset[str] = frozenset()) -> DataFrame:
    """doc_id, line, col, rule, entropy, fingerprint and shown part of every secret of ``df`` (doc_id, text). Only texts in
    which some rule's shape occurs leave the JVM."""
    some: Column = F.lit(False)
    for _, pattern, _, _ in SIGNATURES:
        some = some | F.col("text").rlike("(?U)" + pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k + 1, *x) for i, text in zip(b["doc_id"], b["text"], strict=True) for k, line in enumerate(text.split("\n")) for x in line_secrets(line, allowed)]
            yield pd.DataFrame(rows, columns=["doc_id", "line", "col", "rule", "entropy", "fingerprint", "shown"])

    return df.where(some).mapInPandas(run, "doc_id long, line int, col int, rule string, entropy double, fingerprint string, shown string")
