"""Evaluation passages inside a corpus, found by template windows.

Numbers, names and units are typed placeholders in a window; windows are hashed and
joined, and what filled the placeholders (the slots) is then compared.

``leaked_passages`` takes windows of characters of the normalised text (lower case,
letters and digits only).  What a window's template is depends on the window alone, so
equal stretches always have equal templates: an item gives a window at every position, a
document one every ``stride`` characters, and a stretch of ``length`` characters holds one
whole document window when ``window + stride - 1 <= length``.  A verbatim leak is the case
of identical slots: the stretch around the two windows must be the same, slots and all.

``reparameterised`` takes windows of words in which a placeholder is one word whatever
filled it, so a question with other numbers and names keeps its windows; slots must map
one to one.  Scripts without spaces are cut into characters, and a window is measured by
its plain characters, so it is as long in one script as in another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.runtime import cut, spread

#: Hashes of item windows up to this number are broadcast (4 MB) to leave out other windows
#: before they are shuffled; with more of them all windows are shuffled.
BROADCAST_WINDOWS = 500_000
#: Names of the items that are placeholders in character windows, at most (the most frequent).
#: They decide which windows meet, never which leaks are found.
NAMES = 5000
#: Units that follow a number in a template. Fixed values.
UNITS = ("ms", "sec", "seconds", "sekunden", "secondes", "segundos", "секунд", "mb", "gb", "kb", "km", "kg", "grams", "cm", "mm", "percent", "rows", "zeilen", "lignes", "filas", "строк", "%", "s", "m", "g")
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _patterns():
    import regex

    units = "|".join(sorted((regex.escape(u) for u in UNITS if u != "%"), key=len, reverse=True))
    unspaced = r"\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
    return {
        "other": regex.compile(r"[^\p{L}\p{N}]+"),
        "digit": regex.compile(r"\p{N}"),
        "unit": regex.compile(f"(?<=0)(?:{units})"),
        "word": regex.compile(rf"\p{{N}}+(?:[.,:]\p{{N}}+)*|%|[\p{{Katakana}}ー]{{2,}}|[{unspaced}]|(?:(?![{unspaced}])[\p{{L}}\p{{M}}])(?:(?![{unspaced}])[\p{{L}}\p{{M}}'’\-])*"),
        "caseless": regex.compile(r"[\p{Han}\p{Hiragana}\p{Arabic}\p{Devanagari}\p{Hebrew}\p{Thai}\p{Bengali}\p{Tamil}\p{Hangul}]"),
        "dense": regex.compile(rf"[{unspaced}]"),
        "latin": regex.compile(r"[\p{Latin}\-'’]+"),
        "capital": regex.compile(r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}{2,}"),
    }


def normalised(text: str) -> str:
    """Lower case without anything that is not a letter or a digit."""
    return _patterns()["other"].sub("", text.lower())


class Templates:
    """Hashes of the templates of character windows."""

    def __init__(self, names: list[str], window: int):
        self.names, self.window = names, window
        self._search = None
        r = np.random.default_rng(17)
        self.factors = r.integers(1, 1 << 63, window, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __getstate__(self):
        return {**self.__dict__, "_search": None}

    def hashes(self, norm: str, starts: np.ndarray) -> np.ndarray:
        """One hash for each window of ``norm`` that begins at one of the ``starts`` (ascending)."""
        if not len(starts):
            return np.empty(0, np.int64)
        p, size = _patterns(), self.window
        typed = p["digit"].sub("0", norm)
        codes = np.frombuffer(typed.encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = codes[starts[:, None] + np.arange(size)]
        for i in np.flatnonzero((rows == ord("0")).any(1)):
            for m in p["unit"].finditer(typed, int(starts[i]), int(starts[i]) + size):
                if m.start() > starts[i]:
                    rows[i, m.start() - starts[i] : m.end() - starts[i]] = 1
        if self.names:
            if self._search is None:
                import ahocorasick

                self._search = ahocorasick.Automaton()
                for name in self.names:
                    self._search.add_word(name, len(name))
                self._search.make_automaton()
            for end, length in self._search.iter(norm):
                begin = end - length + 1  # a name is a placeholder in the windows that hold it whole
                for i in range(int(np.searchsorted(starts, end + 1 - size)), int(np.searchsorted(starts, begin, side="right"))):
                    rows[i, begin - starts[i] : end + 1 - starts[i]] = 2
        h = (rows.astype(np.uint64) * self.factors).sum(1, dtype=np.uint64)
        h ^= h >> np.uint64(31)
        return (h * _ODD).view(np.int64)


def _names(items: DataFrame) -> list[str]:
    """Capitalised words inside the sentences of the items, lower case, at most ``NAMES``."""
    found = F.regexp_extract_all("text", F.lit(r"(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}{2,})"), F.lit(1))
    counts = items.select(F.explode(found).alias("name")).groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"))
    return sorted(r["name"] for r in counts.orderBy(F.desc("n"), "name").limit(NAMES).collect())  # at most NAMES


def _hash_set(windows: DataFrame) -> np.ndarray | None:
    """The distinct hashes of the items' windows, sorted, or None if they are too many to broadcast."""
    hashes = windows.select("h").distinct()
    if hashes.count() > BROADCAST_WINDOWS:
        return None
    return np.sort(np.array([r.h for r in hashes.collect()], np.int64))


def _held(hashes: np.ndarray, among: np.ndarray | None) -> np.ndarray:
    if among is None:
        return np.ones(len(hashes), bool)
    if not len(among):
        return np.zeros(len(hashes), bool)
    return among[np.minimum(np.searchsorted(among, hashes), len(among) - 1)] == hashes


def leaked_passages(docs: DataFrame, items: DataFrame, *, length: int = 50, window: int = 25) -> DataFrame:
    """``(doc_id, item_id)``, distinct: the two share ``length`` consecutive normalised characters.

    ``docs(doc_id, text)``, ``items(item_id, text)``; other columns are ignored.  Null,
    empty and short texts share nothing, nor does a row with a null id.  Copies of a
    document are each reported.
    """
    if not 0 < window <= length:
        raise ValueError("window is between 1 and length")
    stride = length - window + 1
    if stride < window:
        raise ValueError("window is at most (length + 1) / 2")
    spark = docs.sparkSession
    reach = length - window
    kept = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    shared = spark.sparkContext.broadcast(Templates(_names(kept), window))

    def windows(step: int, among):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            templates, known = shared.value, None if among is None else among.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    owner, hashes, before, around = [], [], [], []
                    for i, text in enumerate(part.column(1).to_pylist()):
                        norm = normalised(text)
                        if len(norm) < length:
                            continue
                        starts = np.arange(0, len(norm) - window + 1, step)
                        h = templates.hashes(norm, starts)
                        for k in np.flatnonzero(_held(h, known)):
                            left = max(0, int(starts[k]) - reach)
                            owner.append(i)
                            hashes.append(int(h[k]))
                            before.append(int(starts[k]) - left)
                            around.append(norm[left : starts[k] + window + reach])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(owner, pa.int64())), pa.array(hashes, pa.int64()), pa.array(before, pa.int32()), pa.array(around, pa.string())], names=["id", "h", "before", "around"]
                    )

        return run

    shape = "id {}, h bigint, before int, around string"
    theirs = cut(kept.mapInArrow(windows(1, None), shape.format(dict(items.dtypes)["item_id"])).distinct())
    hashes = _hash_set(theirs)
    among = spark.sparkContext.broadcast(hashes) if hashes is not None else None
    corpus = spread(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"), "doc_id")
    ours = corpus.mapInArrow(windows(stride, among), shape.format(dict(docs.dtypes)["doc_id"]))
    met = ours.select(F.col("id").alias("doc_id"), "h", F.col("before").alias("b"), F.col("around").alias("a")).join(theirs.select(F.col("id").alias("item_id"), "h", F.col("before").alias("d"), F.col("around").alias("c")), "h")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for b, a, d, c in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                if a[b : b + window] != c[d : d + window]:  # other slots
                    good.append(False)
                    continue
                left = right = 0
                while left < min(b, d) and a[b - left - 1] == c[d - left - 1]:
                    left += 1
                rest = min(len(a) - b, len(c) - d) - window
                while right < rest and a[b + window + right] == c[d + window + right]:
                    right += 1
                good.append(left + window + right >= length)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], names=["doc_id", "item_id"])

    checked = met.select("doc_id", "item_id", "b", "a", "d", "c").mapInArrow(same, f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}")
    return checked.distinct()


def template_words(text: str) -> list[tuple[str, str | None, int]]:
    """``(template word, slot, plain characters)`` of the words of a text.

    A number, a unit after a number and a name are placeholders with the word as their slot.
    A name is a capitalised word; in a text of a script without case, any Latin or katakana
    word.  A character of a script without spaces is a word and counts three times.
    """
    p = _patterns()
    caseless = bool(p["caseless"].search(text))
    out: list[tuple[str, str | None, int]] = []
    for m in p["word"].finditer(text):
        word = m[0]
        low = word.lower()
        if word[0].isnumeric():
            out.append(("<number>", low, 0))
        elif low in UNITS and out and out[-1][0] == "<number>":
            out.append(("<unit>", low, 0))
        elif word[0].isupper() and word[1:2].islower() or caseless and p["latin"].fullmatch(word) or len(word) > 1 and "ァ" <= word[0] <= "ヿ":
            out.append(("<name>", low, 0))
        else:
            out.append((low, None, 3 if p["dense"].match(word) else len(word)))
    return out


def _word_windows(text: str, plain: int) -> tuple[np.ndarray, list[list[str]]]:
    """Hashes and slots of the windows that hold a slot: from each word on to the first ``plain`` plain characters."""
    from xxhash import xxh64_intdigest

    words = template_words(text)
    if not words:
        return np.empty(0, np.int64), []
    size = np.cumsum([0, *(n for _, _, n in words)])
    filled = np.cumsum([0, *(s is not None for _, s, _ in words)])
    first = np.arange(len(words))
    last = np.searchsorted(size, size[:-1] + plain)  # words before this one
    good = (last <= len(words)) & (filled[np.minimum(last, len(words))] > filled[first])
    hashes = [xxh64_intdigest("\x1f".join(t for t, _, _ in words[a:b])) for a, b in zip(first[good], last[good])]
    slots = [[f"{t}{s}" for t, s, _ in words[a:b] if s is not None] for a, b in zip(first[good], last[good])]
    return np.array(hashes, np.uint64).view(np.int64), slots


def reparameterised(docs: DataFrame, items: DataFrame, *, plain: int = 40) -> DataFrame:
    """``(doc_id, item_id, windows, renamed)``: an item's template with other names or numbers.

    ``windows`` counts the shared template windows of ``plain`` plain characters, at least
    one slot, and slots that map one to one; ``renamed`` those with at least one slot filled
    otherwise.  Only pairs with ``renamed > 0`` come out.  Null texts and ids have none, an
    item with fewer plain characters neither.  A template that many documents share is
    counted by map-side aggregation; only its windows in the items are ever joined.
    """

    def windows(among):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = None if among is None else among.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    owner, hashes, slots = [], [], []
                    for i, text in enumerate(part.column(1).to_pylist()):
                        h, s = _word_windows(text, plain)
                        for k in np.flatnonzero(_held(h, known)):
                            owner.append(i)
                            hashes.append(int(h[k]))
                            slots.append(s[k])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(hashes, pa.int64()), pa.array(slots, pa.list_(pa.string()))], names=["id", "h", "slots"])

        return run

    shape = "id {}, h bigint, slots array<string>"
    kept = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    theirs = cut(kept.mapInArrow(windows(None), shape.format(dict(items.dtypes)["item_id"])).distinct())
    hashes = _hash_set(theirs)
    among = docs.sparkSession.sparkContext.broadcast(hashes) if hashes is not None else None
    corpus = spread(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"), "doc_id")
    ours = corpus.mapInArrow(windows(among), shape.format(dict(docs.dtypes)["doc_id"]))
    both = ours.select(F.col("id").alias("doc_id"), "h", F.col("slots").alias("x")).join(theirs.select(F.col("id").alias("item_id"), "h", F.col("slots").alias("y")), "h").where("size(x) = size(y)")
    pairs = F.array_distinct(F.zip_with("x", "y", lambda d, i: F.struct(d.alias("d"), i.alias("i"))))
    both = both.select("doc_id", "item_id", pairs.alias("p"))
    one_to_one = (F.size(F.array_distinct(F.transform("p", lambda x: x["d"]))) == F.size("p")) & (F.size(F.array_distinct(F.transform("p", lambda x: x["i"]))) == F.size("p"))
    renamed = F.exists("p", lambda x: x["d"] != x["i"])
    return both.where(one_to_one).groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"), F.count_if(renamed).alias("renamed")).where("renamed > 0")
