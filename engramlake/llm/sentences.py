"""Sentence positions of texts in many languages and scripts.

Document-centred disambiguation: whether a word before a period is an abbreviation, and
whether a capitalised word after one is a proper name or a common word that opens a
sentence, is decided from unambiguous occurrences elsewhere in the document; only where
the document has none do the counts of the whole corpus decide, and only where those say
nothing either do short lists (they are told by case: "Me." is a title, "me." is not).
Scripts without case or spaces have their own terminators, quotes and brackets keep what
they enclose together, and blank lines always end a sentence.

Two passes over the texts: the first counts words for the corpus and asks about those that
the document cannot decide, the second gives the positions.  Answers reach a document
through joins, so no vocabulary is ever held whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.runtime import cut, spread

# Abbreviations, months, words that open sentences, terminators, brackets.
#: Names follow these.
TITLES = set(
    "Mr Mrs Ms Dr Prof St Messrs Gen Col Capt Lt Sgt Rev Hon Pres Gov Sen Rep Hr Fr Frl Mme Mlle MM Me Sr Sra Srta Dña Dn Ing Lic Arq Drs mr mrs dr prof messrs capt lt sgt mme mlle sra srta dña gral डॉ श्री प्रो पं د أ م ص".split()
)
#: More of the sentence follows these, unless what comes is a word that opens one.
LINKING = set(
    "vs approx appr cf viz ca vgl bzw evtl ggf inkl exkl sog geb gest env aprox ej ex p.ej p.ex c.-à-d e.g i.e z.b d.h u.a s.o s.u i.d т.е напр им ул см рис табл проф акад ред изд тел стр гл ср".split()
)
#: A period after these ends no sentence if a number follows.
BEFORE_NUMBER = set("no nos nr nro núm num p pp pg pág págs s vol fig figs art arts abs abb tab kap cap sec ch bd aufl eq ref n nº № п пт".split())
#: A period after these may also end the sentence.
MAY_END = set(
    "etc usw u.s.w al ff ltd inc co corp bros jr esq plc llc gmbh a.m p.m u.s u.k e.u u.n d.c b.c a.d ph.d uu ee г гг в вв д др пр руб тыс млн млрд min max dept est janv févr avr juil déc ene abr ago dic sept".split()
)
DATES = set("Mon Tue Tues Wed Thu Thur Thurs Fri Sat Sun Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mär Okt Dez".split())
#: These close a list, so a capital after them opens a sentence.
LISTED = {"etc", "usw", "u.s.w"}
MONTHS = set(
    "januar februar märz april mai juni juli august september oktober november dezember jänner "
    "january february march may june july october december jan feb mär apr jun jul aug sep okt nov dez".split()
)
OPENERS = set(
    "the a an this that these those he she it we they you i his her its our their my your there here then now when if while after before but and or so yet as at in on by for from with what who why how where which everyone everybody nobody somebody all both each some many "
    "der die das ein eine er sie es wir ihr ich dies diese dieser dann danach nun wenn als während nach vor aber und oder warum wie wo wer was alle le la les un une il elle nous vous ils elles ce cette ces puis alors quand si mais et ou pourquoi comment où qui tout "
    "el los las una él ella ellos esto este esta luego entonces cuando pero y o por qué cómo dónde quién todo on lo gli uno lei noi loro questo poi quando ma perché o os as um uma ele ela eles isto então mas это он она они мы вы я тот эта потом затем когда если но и или почему как где кто все".split()
)
SPACED = ".!?…؟।॥۔։።။།༎។"  # need white space or an end after them
WIDE = "。！？｡．"  # never do
PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“", "‹": "›", "「": "」", "『": "』", "（": "）", "《": "》", "【": "】", "〈": "〉"}
_SIGNS = {*PAIRS, *PAIRS.values(), '"'}
QUOTES = set('"«“„‹「『')
FURTHER = set(",;:，、；：)]}»”」』）》】〉—–-%/\\=&+_|~^*`@")

_SIGN = re.compile("[" + re.escape("".join(sorted(_SIGNS))) + "]")
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_TERMINATOR = re.compile(f"[{re.escape(SPACED + WIDE)}]+")
_WORD = re.compile(r"[^\W\d_][^\W\d_]*(?:[’'\-][^\W\d_]+)*")
_TOKEN = re.compile(r"[\"'«“„‹(\[¿¡]*([^\W\d_]+(?:[.’'\-]+[^\W\d_]+)*)(\.?)([\"'»”“›)\],;:!?…]*)")
_INITIALS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]$")
#: Particles that close a Thai or Lao sentence; these scripts have no terminator, and a space may be a comma.
_PARTICLE = re.compile(r"(?<=[ก-๛ກ-ໟ])(?:(?<=ครับ)|(?<=ค่ะ)|(?<=คะ)|(?<=จ้ะ)|(?<=นะ)|(?<=แล้ว)|(?<=ແລ້ວ)|(?<=ເດີ)|(?<=ແດ່))(?=\s+[ก-๛ກ-ໟ])|(?<=[ก-๛ກ-ໟ])(?=\s{2,}[ก-๛ກ-ໟ])")
_NO_MARKS = re.compile(r"[ก-๛ກ-ໟ]")
_MARKS = re.compile(r"(?:[#>\-*+•–—]+\s*|\[[\d:]+\]\s*|\w+:\s+)*")


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of the runs of lines that are not blank."""
    at, open_at = 0, None
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            open_at = at if open_at is None else open_at
            last = end
        elif open_at is not None:
            yield open_at, last
            open_at = None
        at = m.end() if m else end
    if open_at is not None:
        yield open_at, last


def _enclosed(par: str) -> list[tuple[int, int]]:
    """Outermost matched pairs of quotes and brackets."""
    stack: list[tuple[str, int]] = []
    open_for: Counter = Counter()  # openers in the stack by what closes them
    found = []
    for m in _SIGN.finditer(par):
        i, ch = m.start(), m[0]
        if open_for[ch]:
            while stack[-1][0] != ch:
                open_for[stack.pop()[0]] -= 1
            open_for[ch] -= 1
            found.append((stack.pop()[1], i))
        elif ch in PAIRS or ch == '"':
            stack.append((PAIRS.get(ch, ch), i))
            open_for[stack[-1][0]] += 1
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


_SEEN: dict[str, tuple | None] = {}


def _parsed(token: str) -> tuple | None:
    """What ``count_words`` counts for a token that is one word, else None; kind 1 is capitalised, 2 lower case."""
    m = _TOKEN.fullmatch(token)
    found = None
    if m:
        word, low = m[1], m[1].lower()
        kind = 1 if word[0].isupper() and word[1:] == low[1:] else 2 if word == low and low[0] != low[0].upper() else 0
        found = (kind, "s:" + low, "m:" + low, "l:" + low, "n:" + low, "n:" + word, bool(m[2]), "d:" + word, "a:" + word, m[3])
    if len(_SEEN) > 50_000:
        _SEEN.clear()
    _SEEN[token] = found
    return found


def count_words(text: str, into: dict[str, int], parts: list[tuple[int, int]] | None = None) -> None:
    """Unambiguous occurrences of cased words and of words with a period.

    Keys: ``l:w`` lower case, ``m:w`` capitalised inside a sentence, ``s:w`` capitalised
    where a sentence surely starts (``w`` in lower case); ``a:w`` with a period before a
    lower-case word or a comma, ``d:w`` with a period before anything, ``n:w`` without one
    (``w`` as it is, but in lower case where a sentence starts).  ``into`` counts from 0;
    ``parts`` are the text's paragraphs where they are known.
    """
    seen = _SEEN
    for a, b in paragraphs(text) if parts is None else parts:
        words = text[a:b].split()
        start, before = True, ""
        for i, token in enumerate(words):
            p = seen[token] if token in seen else _parsed(token)
            if p:
                kind, opens, inside, lower, plain_low, plain, dot, dotted, goes_on, rest = p
                if kind == 1:
                    if start or before in "!?。！？":
                        into[opens] += 1
                    elif before.isalpha() or before in ",;":
                        into[inside] += 1
                elif kind == 2:
                    into[lower] += 1
                if dot:
                    into[dotted] += 1
                    if rest[:1] == "," or not rest and i + 1 < len(words) and words[i + 1][0].islower():
                        into[goes_on] += 1
                else:
                    into[plain_low if start and kind == 1 else plain] += 1
                start = False
            before = token[-1]


def verdicts(c: dict[str, int], word: str) -> str:
    """``c`` (common word), ``n`` (name) or an empty string, from counts."""
    low, mid, first = c.get("l:" + word, 0), c.get("m:" + word, 0), c.get("s:" + word, 0)
    if low > mid or (first >= 2 and mid * 20 <= first):
        return "c"
    return "n" if mid else ""


def is_abbreviation(c: dict[str, int], word: str, here: int = 0) -> bool | None:
    """True or False where the counts tell, else None; ``here`` occurrences before lower case are the one in question."""
    seen, before_low, plain = c.get("d:" + word, 0) - here, c.get("a:" + word, 0) - here, c.get("n:" + word, 0)
    if before_low > 0 and before_low * 3 >= seen and plain <= seen:
        return True
    return False if plain else None


class Splitter:
    """Sentence ranges of one text.

    ``answers`` holds what the corpus says about words (``+w`` common, ``-w`` abbreviation,
    ``*w`` ordinary word that may stand before a period).  With ``asked`` given, the words
    that the document itself cannot decide are added to it, all of them in one pass: ``+w``
    of words after a period, ``-w`` of words before one.
    """

    def __init__(self, text: str, answers: frozenset[str] | set[str] = frozenset(), asked: set[str] | None = None, own: dict[str, int] | None = None, parts: list[tuple[int, int]] | None = None):
        self.text, self.answers, self.asked, self._own = text, answers, asked, own
        self.parts = list(paragraphs(text)) if parts is None else parts

    @property
    def own(self) -> dict[str, int]:
        """The document's evidence; counted where a period needs it."""
        if self._own is None:
            self._own = defaultdict(int)
            count_words(self.text, self._own, self.parts)
        return self._own

    def common(self, word: str) -> bool:
        own = verdicts(self.own, word)
        if own:
            return own == "c"
        return "+" + word in self.answers or word in OPENERS

    def kind(self, word: str, here: int = 0) -> str:
        """``a`` (abbreviation), ``o`` (ordinary word) or nothing, by the document, then by the corpus."""
        own = is_abbreviation(self.own, word, here)
        if own is not None:
            return "a" if own else "o"
        return "a" if "-" + word in self.answers else "o" if "*" + word in self.answers else ""

    def sentences(self) -> list[tuple[int, int]]:
        out = []
        for a, b in self.parts:
            out += [(a + x, a + y) for x, y in self._paragraph(self.text[a:b])]
        return out

    def _paragraph(self, par: str) -> Iterator[tuple[int, int]]:
        outer = _enclosed(par)
        size, k, start = len(par.rstrip()), 0, 0
        while start < size and par[start].isspace():
            start += 1
        marks = _TERMINATOR.finditer(par)
        if _NO_MARKS.search(par):
            marks = sorted([*marks, *_PARTICLE.finditer(par)], key=lambda m: m.start())
        for m in marks:
            if m.start() < start:
                continue
            while k < len(outer) and outer[k][1] < m.start():
                k += 1
            end, opened = m.end(), None
            if k < len(outer) and outer[k][0] < m.start():
                close = outer[k][1]
                if par[end:close].strip("\"'»”“›)]}」』）》】   "):
                    continue  # inside, with more to come before the close
                end, opened = close + 1, outer[k][0]
            while end < size and par[end] in "\"'»”›)]」』）*_" and not (par[end] == '"' and any(x == end for x, _ in outer)):
                end += 1
            if self._ends(par, size, start, m, end, opened):
                yield start, end
                start = end
                while start < size and par[start].isspace():
                    start += 1
        if start < size:
            yield start, size

    def _ends(self, par: str, size: int, start: int, m: re.Match, end: int, opened: int | None) -> bool:
        if end >= size:
            return True
        if not m[0]:
            return opened is None  # the end of a Thai or Lao sentence
        rest = par[end : end + 80]
        after = rest.lstrip()
        if not after:
            return True
        mark = m[0][-1]
        wide = mark in WIDE or (mark in "!?" and m.start() and ord(par[m.start() - 1]) > 0x2E7F)
        if mark == "…" and ord(par[m.start() - 1] if m.start() else "a") > 0x2E7F:
            return False
        if after[0] in FURTHER and not (after[0] in "-—–*" and rest[0] == "\n" or after[0] in "-*" and after[1:2] == " "):
            return False
        if wide:
            if opened is None:
                return True
            if after.startswith(("と", "って", "という")):
                return False
            at_start = not _MARKS.sub("", par[start:opened], count=1).strip("\"'*_# ")
            return not (at_start and par[opened] in QUOTES)
        if not rest[0].isspace():
            return mark in "।॥؟۔།༎" or (ord(rest[0]) > 0x2E7F and mark in "!?.")
        body = after.lstrip("\"'«“„‹([{「『（¿¡#>-*•_`~ ​‌‍﻿⁠")
        nxt = _WORD.match(body)
        word = nxt[0] if nxt else ""
        if word and word[0].islower() and (opened is not None or end > m.end()) and not (opened is not None and par[max(0, opened - 8) : opened].rstrip().endswith(":")):
            return False  # what was quoted goes on
        if mark in "।॥؟۔։።။།༎។!?":
            return True
        if mark == "…" or m[0].endswith(".."):
            return bool(word) and not word[0].islower() and word[0] != word[0].lower() and self.common(word.lower())
        return self._period(par, start, m.start(), body, word)

    def _period(self, par: str, start: int, dot: int, body: str, word: str) -> bool:
        at = dot
        while at > start and not par[at - 1].isspace():
            at -= 1
        raw = par[at:dot].lstrip("\"'«“„‹([{「『（¿¡*_`")
        low = raw.lower()
        number = body[:1].isdigit()
        cased = bool(word) and word[0] != word[0].lower()
        if raw.isdigit():
            if word and word[0].islower():
                return False
            first = not _MARKS.sub("", par[start:at], count=1).strip("\"'*_# ")
            if first and len(raw) <= 3:
                return False  # the number of a list item
            return word.lower() not in MONTHS
        if raw in TITLES:
            return False
        if not raw or not raw[-1].isalpha() and low not in LINKING:
            return not (word and word[0].islower()) or not raw or not raw[-1].isdigit()
        here = int(bool(word) and word[0].islower())
        if self.asked is not None and (here or cased):
            known = verdicts(self.own, word.lower()) if cased else ""
            # where a word that opens sentences follows, it does not matter what stands before
            if not (known == "c" or cased and not known and word.lower() in OPENERS):
                if is_abbreviation(self.own, raw, here) is None:
                    self.asked.add("-" + raw)
                if not here and not known:
                    self.asked.add("+" + word.lower())
        kind = self.kind(raw, here)
        joined = bool(_INITIALS.fullmatch(low))
        if word and word[0].islower():
            known = low in LINKING or low in MAY_END or raw in DATES or low in BEFORE_NUMBER or bool(_INITIALS.search(low)) or len(low) == 1
            # a word as long as this is hardly an abbreviation
            return not known and (kind == "o" or not kind and len(low) > 12)
        if low in BEFORE_NUMBER and (number or body[:1] in "IVX§"):
            return False
        # the lists are for words that the document does not use as ordinary ones
        listed = self.own.get("n:" + raw, 0) <= self.own.get("d:" + raw, 0)
        if low in LINKING and listed:
            numbered = word.lower() in BEFORE_NUMBER and body[len(word) :].lstrip(". ")[:1].isdigit()  # "cf. No. 4"
            return cased and "." not in low and not numbered and self.common(word.lower())
        if (low in MAY_END or raw in DATES) and listed or joined:
            if not word or not cased:
                return not number
            # an opening such as "On Tues. X met" is short; after more words a capital opens a sentence
            return low in LISTED or len(par[start:dot].split()) > 5 or self.common(word.lower())
        if len(raw) == 1:
            return raw.isupper() and cased and len(word) > 1 and self.common(word.lower())
        if cased and low not in ("no", "p", "s") and kind == "a":
            return self.common(word.lower())
        return True


def _first(batches: Iterator[pa.RecordBatch], least: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Counts of the corpus (rows with ``n``) and the words that documents ask about (rows with ``doc``)."""
    counts: dict[str, int] = defaultdict(int)

    def rows(doc: pa.Array, words: list[str], n: list[int | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc, pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["doc", "word", "n"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            owner, words = [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                own: dict[str, int] = defaultdict(int)
                parts = list(paragraphs(text))
                count_words(text, own, parts)
                for key, n in own.items():
                    counts[key] += n
                asked: set[str] = set()
                Splitter(text, asked=asked, own=own, parts=parts).sentences()
                owner += [i] * len(asked)
                words += sorted(asked)
            yield rows(part.column(0).take(pa.array(owner, pa.int64())), words, [None] * len(words))
            if len(counts) > least:
                yield rows(pa.nulls(len(counts), kind), list(counts), list(counts.values()))
                counts.clear()
    if counts:
        yield rows(pa.nulls(len(counts), kind), list(counts), list(counts.values()))


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows, starts, ends, texts = [], [], [], []
            for i, (text, said) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                for a, b in Splitter(text, frozenset(said or ())).sentences():
                    rows.append(i)
                    starts.append(a)
                    ends.append(b)
                    texts.append(text[a:b])
            columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "start_pos", "end_pos", "sentence"])


def split_sentences(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, start_pos int, end_pos int, sentence string)``: the sentences of every text.

    Positions count Unicode characters from 0.  Null, empty and blank texts have none.
    Repeated rows are split each for themselves; a null key is kept.
    """
    kind = dict(docs.dtypes)[key]
    rows = spread(docs.select(F.col(key).alias("doc"), F.col(text).alias("body")).where(F.col("body").isNotNull()), "doc")
    first = cut(rows.mapInArrow(_first, f"doc {kind}, word string, n bigint"))
    counts = first.where("n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    word, sort = F.substring("word", 3, 1 << 30), F.substring("word", 1, 1)
    by = counts.groupBy(word.alias("word")).agg(*[F.coalesce(F.sum(F.when(sort == s, F.col("n"))), F.lit(0)).alias(s) for s in "lmsadn"])
    is_common = (F.col("l") > F.col("m")) | ((F.col("s") >= 2) & (F.col("m") * 20 <= F.col("s")))
    is_abbr = (F.col("a") >= 2) & (F.col("a") * 3 >= F.col("d")) & (F.col("n") <= F.col("d"))
    is_ordinary = (F.col("n") > F.col("a")) | ((F.col("d") >= 3) & (F.col("a") * 3 < F.col("d")))
    told = F.array_compact(F.array(F.when(is_common, F.struct(F.concat(F.lit("+"), "word").alias("ask"), F.lit("+").alias("sign"))), F.when(is_abbr | is_ordinary, F.struct(F.concat(F.lit("-"), "word").alias("ask"), F.when(is_abbr, "-").otherwise("*").alias("sign")))))
    answers = by.select(F.explode(told).alias("t")).select("t.ask", "t.sign")
    asked = first.where("n IS NULL").select("doc", F.col("word").alias("ask")).distinct()
    said = asked.join(answers, "ask").groupBy("doc").agg(F.collect_set(F.concat("sign", F.substring("ask", 2, 1 << 30))).alias("said"))  # words of one document
    out = rows.join(said, "doc", "left").select("doc", "body", "said").mapInArrow(_positions, f"doc {kind}, start_pos int, end_pos int, sentence string")
    return out.withColumnRenamed("doc", key)
