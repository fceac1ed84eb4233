"""Extraction from text as Column expressions: keywords, entities, structure, type, quality, secrets."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from engramlake.functions import scalar as S

# Stop words, markers of memory types, patterns.
STOP = "the and for with that this from are was were but not you all any can had her his how its may new now our out she too use who why been have they them than then will what when where which while would about after again also because before could does each into more most only other over same should some such their there these those through under until very your".split()
TYPES = (
    ("decision", r"\b(decided|decision|chose|we will use|agreed)\b"),
    ("todo", r"\b(todo|remember to|need to|must|should)\b"),
    ("error", r"\b(error|failed|failure|bug|broken|crash)\b"),
    ("preference", r"\b(prefer|always use|never use|favou?rite)\b"),
    ("instruction", r"\b(never let|always|do not|make sure|run step)\b"),
    ("workflow", r"\b(step|first|then|pipeline|process)\b"),
    ("reference", r"(https?://|\bsee\b|\bdocs\b)"),
    ("insight", r"\b(learned|realised|turns out|because|since)\b"),
    ("context", r"\b(today|tomorrow|this week|currently|meeting)\b"),
)
CAUSAL = r"\b(because|since|so that|as the|therefore|due to|leads to|caused by)\b"
TEMPORAL = r"\b(before|after|when|until|during|today|tomorrow|yesterday|week|night)\b"
COMPARATIVE = r"\b(more than|less than|vs\.?|better|worse|compare|instead of)\b"
#: Secrets: name, pattern, severity.
SECRETS = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 3),
    ("bearer", r"(?i)\bbearer\s+[a-z0-9._\-]{16,}", 3),
    ("assignment", r"(?i)\b(password|passwd|secret|token|api[_-]?key)\s*[:=]\s*\S{6,}", 3),
    ("url_login", r"(?i)\b[a-z]+://[^\s/:@]+:[^\s/@]+@", 3),
    ("card", r"\b(?:\d{4}[ -]){3}\d{4}\b", 2),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", 2),
    ("email", r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", 1),
    ("phone", r"\+\d[\d ()/.-]{7,}\d", 1),
    ("ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 1),
)


def words(text: Column) -> Column:
    """Search tokens of a text that do not begin with a digit."""
    return F.filter(S.search_tokens(text), lambda w: ~w.rlike(r"^\p{N}"))


def keywords(text: Column, k: int = 10) -> Column:
    """The first ``k`` distinct words without stop words, as they come."""
    kept = F.filter(words(text), lambda w: ~w.isin(STOP))
    return F.slice(F.array_distinct(kept), 1, k)


#: Capitalised words after a word or a comma, so not those that open a sentence.
ENTITY = r"[a-z,;)] ([A-Z][a-z]{3,}(?: [A-Z][a-z]{3,})*)"


def entities(text: Column) -> Column:
    """Distinct capitalised words that do not open the text or a sentence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1)))


def memory_type(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for name, pattern in TYPES:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("fact")


def structure(text: Column) -> Column:
    """What a text is: json, table, csv, key_value, code, list or prose."""
    t = F.trim(text)
    lines = F.split(t, "\n")
    commas = F.size(F.filter(lines, lambda x: x.rlike(r"^[^,\n]+(,[^,\n]+){2,}$")))
    pairs = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[\w .-]{1,40}[:=]\s*\S")))
    return (
        F.when(t.isNull() | (t == ""), "empty")
        .when(t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull(), "json")
        .when(t.rlike(r"(?m)^\|.*\|\s*$"), "table")
        .when(t.rlike(r"(?m)^```"), "code")
        .when((F.size(lines) > 1) & (commas == F.size(lines)), "csv")
        .when((F.size(lines) > 1) & (pairs * 2 > F.size(lines)), "key_value")
        .when(t.rlike(r"(?m)^\s*([-*•]|\d+\.)\s"), "list")
        .otherwise("prose")
    )


def importance(text: Column) -> Column:
    low = F.lower(text)
    bonus = F.when(low.rlike(CAUSAL), 1).otherwise(0) + F.when(low.rlike(r"\b(decided|decision|never|must|critical)\b"), 2).otherwise(0) + F.when(F.length(text) > 200, 1).otherwise(0) - F.when(F.length(text) < 20, 2).otherwise(0)
    return S.clamp(5 + bonus, 1, 10).cast("int")


def quality(text: Column) -> Column:
    low = F.lower(text)
    score = sum((F.when(c, 1).otherwise(0) for c in (F.length(text) >= 20, F.length(text) >= 50, low.rlike(CAUSAL), low.rlike(TEMPORAL), low.rlike(COMPARATIVE), memory_type(text) != "fact")), F.lit(0))
    return F.coalesce(score, F.lit(0)).cast("int")


def arousal(text: Column) -> Column:
    low = F.lower(text)
    return F.least(F.lit(1.0), 0.3 * F.size(F.regexp_extract_all(low, F.lit(r"\b(critical|urgent|never|fails?|failed|broken|stop)\b"), F.lit(1))) + 0.2 * F.size(F.regexp_extract_all(text, F.lit("(!)"), F.lit(1))))


def secrets(text: Column) -> Column:
    """Names of the kinds of secrets in a text."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p, _ in SECRETS]))


def redact_secrets(text: Column, least: int = 2) -> Column:
    out = text
    for name, pattern, severity in SECRETS:
        if severity >= least:
            out = F.regexp_replace(out, pattern, f"[{name.upper()}]")
    return out


def repetitive(text: Column) -> Column:
    """Whether fewer than half of the three-word runs of a text of 12 or more words are distinct."""

    def test(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, F.lit(3)), " "))
        return F.when(F.size(w) >= 12, F.size(F.array_distinct(runs)) * 2 < F.size(runs)).otherwise(False)

    return F.transform(F.array(words(text)), test)[0]  # the words are worked out once


def sentences(text: Column) -> Column:
    """Runs of text up to a mark that ends a sentence, trimmed."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([^.!?。！？]+[.!?。！？]*)"), F.lit(1)), lambda s: F.trim(s)), lambda s: s != "")


def essence(text: Column, limit: int = 150) -> Column:
    """The sentence with the most distinct long words, shortened."""
    scored = F.transform(sentences(text), lambda s, i: F.struct(F.size(F.array_distinct(F.filter(words(s), lambda w: F.length(w) > 4))).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.substring(F.array_max(scored)["s"], 1, limit)


def simhash(text: Column) -> Column:
    """64-bit similarity hash over three-character pieces (MD5, low byte first), 0 for a blank text.

    Arrow batches in numpy: each distinct piece of a batch is hashed once.
    """
    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}

        def signs(piece: str) -> np.ndarray:
            if piece not in known:
                raw = np.frombuffer(hashlib.md5(piece.encode("utf-8", "replace")).digest()[:8], np.uint8)
                known[piece] = np.unpackbits(raw, bitorder="little").astype(np.int32) * 2 - 1
            return known[piece]

        def one(text: str | None) -> int:
            t = " ".join((text or "").lower().split())
            if not t:
                return 0
            total = sum(signs(t[i : i + 3]) for i in range(max(1, len(t) - 2)))
            return int(np.packbits(total > 0, bitorder="little").view(np.int64)[0])

        return pd.Series([one(t) for t in texts], dtype="int64")

    return run(text)


#: Clauses around a marker: the pattern and the relation it states.
RELATIONS = (
    (r"([^.!?\n]{5,80}?) because ([^.!?\n]{5,80})", "caused_by"),
    (r"([^.!?\n]{5,80}?) so that ([^.!?\n]{5,80})", "leads_to"),
    (r"([^.!?\n]{5,80}?) since ([^.!?\n]{5,80})", "caused_by"),
    (r"([^.!?\n]{5,80}?) (?:leads to|results in|causes) ([^.!?\n]{5,80})", "leads_to"),
    (r"([^.!?\n]{3,60}?) (?:vs\.?|versus|compared to|instead of) ([^.!?\n]{3,60})", "similar_to"),
    (r"([^.!?\n]{5,80}?) (?:before|until) ([^.!?\n]{5,80})", "before"),
    (r"([^.!?\n]{5,80}?) (?:after|once) ([^.!?\n]{5,80})", "after"),
)


def relations(text: Column) -> Column:
    """``array<struct(source, relation, target)>`` of clauses around causal, temporal and comparative markers."""
    found = lambda pattern, name: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.trim(F.regexp_extract(m, pattern, 1)).alias("source"), F.lit(name).alias("relation"), F.trim(F.regexp_extract(m, pattern, 2)).alias("target")))
    return F.concat(*[found(p, n) for p, n in RELATIONS])
