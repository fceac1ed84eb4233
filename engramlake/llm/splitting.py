"""Sections of Markdown files that are too long, cut at natural boundaries.

Dynamic programming over the positions between words: a piece is a run of at most
``max_words`` words, consecutive pieces share exactly ``overlap`` words, and the sum of
cut penalties (blank line, list item, line, sentence, clause, inside a sentence, inside
code) and of squared deviations from an even size is least.  Pieces below ``min_words``
cost more than any other choice, so there are none where that is possible.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.runtime import spread

_LINE = re.compile(r"[^\n]*\n?")
_HEADING = re.compile(r"#{1,6} .*\S")
_WORD = re.compile(r"\S+")
_SENTENCE_END = re.compile(r"[.!?…。！？؟।]+[\"'”’»)\]」』）]*$")
_CLAUSE_END = re.compile(r"[,;:、，；：،–—]+[\"'”’»)\]」』）]*$")
_ITEM = re.compile(r"\s*([-*+•]|\d+[.)])\s")
#: Penalties of a cut. Fixed values.
BLANK, ITEM, LINE, SENTENCE, CLAUSE, INSIDE, CODE_LINE, CODE_INSIDE = 0.0, 0.8, 1.6, 1.0, 4.0, 8.0, 5.0, 12.0
PIECE, UNEVEN, TOO_SHORT = 3.0, 6.0, 1e6


def sections(body: str) -> list[tuple[int, int]]:
    """Character ranges of the sections of a Markdown text, by section number.

    Front matter and heading lines belong to none.  Section 0 always exists.
    """
    lines = [(m.start(), m.end()) for m in _LINE.finditer(body) if m.end() > m.start()]
    bare = [body[a:b].rstrip("\r\n") for a, b in lines]
    first = 0
    if bare and bare[0].rstrip() == "---":
        close = next((i for i in range(1, len(bare)) if bare[i].rstrip() == "---"), None)
        first = 0 if close is None else close + 1
    start = lines[first][0] if first < len(lines) else len(body)
    out, fenced = [], False
    for (a, b), text in zip(lines[first:], bare[first:]):
        if text.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced and _HEADING.match(text):
            out.append((start, a))
            start = b
    return [*out, (start, len(body))]


def cut_penalties(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Penalty of a cut after each word but the last."""
    fences = [m.start() for m in re.finditer(r"(?m)^[ \t]*```", text)]
    inside = np.searchsorted(fences, [a for a, _ in spans], side="right") % 2 == 1
    out = np.empty(max(len(spans) - 1, 0))
    inside = inside.tolist()
    for i in range(len(spans) - 1):
        end, start = spans[i][1], spans[i + 1][0]
        breaks = 0 if start - end == 1 and text[end] == " " else text.count("\n", end, start)
        word = text[spans[i][0] : end]
        if not breaks and word[-1].isalnum() and not inside[i]:
            out[i] = INSIDE  # by far the most
        elif inside[i] and inside[i + 1]:
            out[i] = CODE_LINE if breaks else CODE_INSIDE
        elif breaks > 1:
            out[i] = BLANK
        elif breaks and (_ITEM.match(text, start) or text[start] == "|"):
            out[i] = ITEM
        elif _SENTENCE_END.search(word):
            out[i] = SENTENCE
        elif breaks:
            out[i] = LINE
        else:
            out[i] = CLAUSE if _CLAUSE_END.search(word) else INSIDE
    return out


def best_cuts(penalties: np.ndarray, max_words: int, overlap: int, min_words: int) -> list[tuple[int, int]]:
    """Word ranges ``[first, end)`` of the pieces of ``len(penalties) + 1`` words."""
    n = len(penalties) + 1
    if n <= max_words:
        return [(0, n)]
    overlap = max(0, min(overlap, max_words - 1))
    pieces = -(-(n - overlap) // (max_words - overlap))
    even = (n + (pieces - 1) * overlap) / pieces

    def size_cost(length: np.ndarray) -> np.ndarray:
        return PIECE + UNEVEN * ((length - even) / max_words) ** 2 + TOO_SHORT * (length < min_words)

    sizes = size_cost(np.arange(max_words + 1))  # by number of words
    falling = sizes[::-1].copy()
    cost, back = np.full(n + 1, np.inf), np.full(n + 1, -1)
    after = np.append(np.append([0.0], penalties), [0.0])  # after[e]: the cut that ends a piece at e
    for e in range(1, n + 1):
        if e <= max_words:
            cost[e] = sizes[e]
        lo, hi = max(overlap, e - (max_words - overlap)), e  # ends of the piece before
        if lo < hi and lo > 0 or (lo == 0 and hi > 1):
            lo = max(lo, 1)
            shift = max_words - overlap - e
            total = cost[lo:hi] + falling[lo + shift : hi + shift]
            k = int(total.argmin())
            if total[k] < cost[e]:
                cost[e], back[e] = total[k], lo + k
        cost[e] += after[e]
    ends, e = [], n
    while e > 0:
        ends.append(e)
        e = int(back[e])
    ends.reverse()
    return [(0, ends[0])] + [(p - overlap, e) for p, e in zip(ends, ends[1:])]


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file_id", "section_no", "section_words", "piece_no", "first_word", "n_words", "text"]
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            for number, (a, b) in enumerate(sections(r.body)):
                text = r.body[a:b]
                spans = [m.span() for m in _WORD.finditer(text)] if b - a > 2 * r.max_words else []
                if len(spans) <= r.max_words:
                    continue
                cuts = best_cuts(cut_penalties(text, spans), int(r.max_words), int(r.overlap), int(r.min_words))
                rows += [(r.file_id, number, len(spans), i, x, y - x, text[spans[x][0] : spans[y - 1][1]]) for i, (x, y) in enumerate(cuts)]
            if len(rows) > 2000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)


def split_sections(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Pieces of the sections with more words than the ``max_chunk_words`` of their config.

    ``(file_id, section_no, section_words, piece_no, first_word, n_words, text)``; sections
    that are short enough have no rows.  Copies of a file count once (the newest).  A null
    or unknown config, a null or non-positive limit, a null body or file id give no rows; a
    null overlap or minimum is 0, an overlap not below the limit is the limit less one.
    """
    limits = configs.where("config_id IS NOT NULL AND max_chunk_words > 0").groupBy("config_id").agg(
        F.max("max_chunk_words").alias("max_words"),
        F.max(F.coalesce("overlap_words", F.lit(0))).alias("overlap"),
        F.max(F.coalesce("min_chunk_words", F.lit(0))).alias("min_words"),
    )
    one = (
        files.where("file_id IS NOT NULL")
        .groupBy("file_id")
        .agg(F.max_by(F.struct("body", "config_id"), F.struct("created_at", F.xxhash64("body", "config_id"))).alias("_f"))
        .select("file_id", "_f.*")
        .where("body IS NOT NULL AND config_id IS NOT NULL")
    )
    work = spread(one.join(limits, "config_id").select("file_id", "body", "max_words", "overlap", "min_words"), "file_id")
    kind = dict(files.dtypes)["file_id"]
    return work.mapInPandas(_pieces, f"file_id {kind}, section_no int, section_words int, piece_no int, first_word int, n_words int, text string")


def oversized_sections(files: DataFrame, configs: DataFrame) -> DataFrame:
    """``(file_id, section_no)`` of the sections that ``split_sections`` cut."""
    return split_sections(files, configs).where("piece_no = 0").select("file_id", "section_no")
