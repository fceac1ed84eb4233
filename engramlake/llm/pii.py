"""Personal information in free text: a linear-chain conditional random field.

Words are tagged from their shape and affixes, those of their neighbours, coarse classes of
neighbouring words, and the last and next word that announces a kind of number; labels are
chained.  The model is fitted in numpy from a small labelled table (``pii_table``; its size
is a parameter) by ``python -m engramlake.llm.pii``, which writes the weights beside this
module, and decoded by Viterbi over padded batches.  What a word contributes to each
neighbour's label scores is computed once for each distinct word.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.pii_table import CHINESE, GIVEN, JAPANESE, labelled_table
from engramlake.runtime import spread

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"], "M-name")  # M: the comma of a name with the family name first
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
#: Sentences of the labelled table the model is fitted from, and rounds of fitting.
ROWS, ROUNDS = 12_000, 70
#: Times a feature must occur in the labelled table, so that made-up words are not learned by heart.
LEAST = 8
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
_REACH = 2  # words to either side
_BACK, _AHEAD = 5, 3  # words within which an announcing word counts
_MEMO = 150_000
_PADDED = 100_000  # words of a decoded batch with its padding
_NEVER = np.float32(-1e4)
# Words of street names, of kinds of numbers, of telephones, of other numbers.
_STREET = set(
    "street st road rd avenue ave lane ln drive dr boulevard blvd court ct way place square terrace close crescent parkway highway row hill gardens rue chemin allée impasse quai calle avenida plaza carrera paseo camino via viale piazza "
    "corso rua travessa straße strasse str weg gasse allee platz ul улица улице ул проспект проспекте пр переулок пер бульвар đường phố".split()
)
_STEM = ("straße", "strasse", "str", "weg", "gasse", "allee", "platz", "brücke", "ufer")
_HAN_PLACE = set("路街号號区區市省县道巷室楼町丁目番都府")
_IDWORD = set(
    "ssn social security passport national identity id card tax tin insurance driving driver driver's license licence nin permit steuer-id steuernummer personalausweis reisepass reisepassnummer ausweis führerschein sozialversicherungsnummer "
    "passeport identité sécurité permis conduire pasaporte dni nie seguridad carnet conducir паспорт паспорта инн снилс パスポート マイナンバー पासपोर्ट आधार الجواز الهوية".split()
)
_PHONEWORD = set("phone call tel telephone fax dial ring mobile cell hotline pager whatsapp text line telefon ruf mobil rufbereitschaft tél téléphone appeler appelez teléfono llame llamar móvil telefono chiamare ligue телефон звоните फ़ोन هاتف".split())
_CODEWORD = set("build ticket chunk order row rows batch invoice record request commit line error code port page version v sku serial tracking epoch timestamp window range room column chapter section job run shard event auftrag vorgang commande pedido заказ".split())
_HAN_WORD = {**dict.fromkeys("护照证証税险険", 1), **dict.fromkeys("话話拨電电", 2), **dict.fromkeys("单単行", 3)}
_GIVEN = {g.lower() for g in GIVEN}
_HAN_NAME = {*CHINESE[0], *(x[0] for x in JAPANESE[0])}


@lru_cache(1)
def _tokenizer():
    import regex

    return regex.compile(
        r"[\[({]\s?(?:at|ät|dot|punkt|punto|point|arroba)\s?[\])}]|(?<=\s)(?-i:AT|DOT)(?=\s)"
        r"|(?>[+(]*\d[\d()]*(?:[.\-/:][\d()]+)*+)(?![^\W\d_\p{Han}\p{Hiragana}\p{Katakana}])"
        r"|\p{Han}|\p{Hiragana}+|[\p{Katakana}ー]+"
        r"|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[^\W_])+(?:[-'’.@_+]+(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[^\W_])+)*"
        r"|\S",
        regex.IGNORECASE,
    )


def tokens(text: str) -> list[tuple[int, int]]:
    """Ranges of the words, numbers and signs of a text; a Han character is a word."""
    return [m.span() for m in _tokenizer().finditer(text)]


_PLAIN = {**dict.fromkeys(range(48, 58), "9"), **dict.fromkeys(range(65, 91), "X"), **dict.fromkeys(range(97, 123), "x")}
_DIGIT, _LETTER = re.compile(r"\d"), re.compile(r"[^\W\d_]")
_RUN = re.compile(r"([^9])\1+")


def _shape(word: str) -> str:
    if word.isascii():
        return _RUN.sub(r"\1", word.translate(_PLAIN))
    out = []
    for ch in word:
        c = "9" if ch.isdigit() else "X" if ch.isupper() else "x" if ch.isalpha() else ch
        if not out or c == "9" or out[-1] != c:
            out.append(c)
    return "".join(out)


_CLASSES = ("", "given", "cap", "low", "caps", "initial", "n1", "n2", "n3", "n4", "n5", "n6", "n7", "n10", "nn", "+n", "(n", "nx", "xn", "mail", "at", "dotted", "street", "stem", "idword", "han", "hanname", "hanplace", "kana", ".", ",", "|", ":", "open", "close", "sign", "@", "phoneword", "codeword")
_CLASS = {c: i for i, c in enumerate(_CLASSES)}
_AT = ("at", "ät", "dot", "punkt", "punto", "point", "arroba")


def _coarse(word: str) -> int:
    low = word.lower()
    if word in ".,|:@":
        return _CLASS[word]
    if len(word) == 1 and not word.isalnum():
        return _CLASS["open" if word in "<([{„\"«（「" else "close" if word in ">)]}”»）」" else "sign"]
    if word in ("AT", "DOT") or word[0] in "[({" and low.strip("[({})] ") in _AT:
        return _CLASS["at"]
    if "@" in word:
        return _CLASS["mail" if "." in word.partition("@")[2] and any(c.isalpha() for c in word.partition("@")[2]) else "sign"]
    if word[0] == "+":
        return _CLASS["+n"]
    if word[0] == "(":
        return _CLASS["(n"]
    if word.isdigit():
        n = len(word)
        return _CLASS[f"n{n}" if n <= 7 else "n10"]
    if word[0].isdigit():
        return _CLASS["nx" if _LETTER.search(word) else "nn"]
    if _DIGIT.search(word):
        return _CLASS["xn"]
    if "一" <= word[0] <= "鿿" or "㐀" <= word[0] <= "䶿":
        return _CLASS["hanplace" if word in _HAN_PLACE else "hanname" if word in _HAN_NAME else "han"]
    if "぀" <= word[0] <= "ヿ":
        return _CLASS["kana"]
    for name, words in (("street", _STREET), ("idword", _IDWORD), ("phoneword", _PHONEWORD), ("codeword", _CODEWORD)):
        if low in words:
            return _CLASS[name]
    if low.endswith(_STEM) and len(low) > 5:
        return _CLASS["stem"]
    if low in _GIVEN:
        return _CLASS["given"]
    if "." in word:
        return _CLASS["dotted"]
    if word.isupper():
        return _CLASS["initial" if len(word) == 1 else "caps"]
    return _CLASS["cap" if word[0].isupper() else "low"]


def _announces(word: str) -> int:
    """1 for a word of identity numbers, 2 of telephones, 3 of other numbers, else 0."""
    low = word.lower()
    return 1 if low in _IDWORD else 2 if low in _PHONEWORD else 3 if low in _CODEWORD else _HAN_WORD.get(word, 0)


def _around(told: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For every word the last and the next announcing word within reach, as one number.

    ``told`` is what each word announces; ``first`` and ``last`` are the ends of its text.
    """
    n, at = len(told), np.arange(len(told))
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(1, _BACK + 1):
        there = at - k
        before = np.where((before == 0) & (there >= first), told[np.maximum(there, 0)], before)
    for k in range(1, _AHEAD + 1):
        there = at + k
        after = np.where((after == 0) & (there <= last), told[np.minimum(there, n - 1)], after)
    return before * 4 + after


def _features(word: str, coarse: int) -> list[str]:
    low, shape = word.lower(), _shape(word)
    out = ["s" + shape, "c" + str(coarse), "k" + shape.lower()]
    if "@" in low:
        return [*out, "o" + "".join(c for c in shape.lower() if not c.isalnum())]
    digits = len(_DIGIT.findall(low))
    if digits:
        out.append("w" + low)
    elif _LETTER.search(low):
        first, last = low.split("-")[0], low.split("-")[-1]
        out += ["w" + low, "p" + first[:3], "q" + first[:4], "u" + last[-3:], "v" + last[-4:], "t" + last[-5:], "y" + last[-2:], f"l{min(len(low), 12)}"]
        if "-" in low:
            out.append("h" + first[-3:])
    out.append(f"d{min(digits, 14)}")
    return out


class Tagger:
    """A fitted field: weights of features by offset, of class pairs and triples, of announcing words, of label pairs."""

    def __init__(self, index: dict[str, int], words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, told: np.ndarray, chain: np.ndarray, start: np.ndarray, seen: np.ndarray):
        self.index, self.words, self.pairs, self.triples, self.told, self.chain, self.start = index, words, pairs, triples, told, chain, start
        self.seen = seen  # which labels words of a class had in the labelled table
        self.never = np.where(seen, 0, _NEVER).astype(np.float32)
        self._row: dict[str, int] = {"": 0}  # row 0 is what stands between texts
        self._table = np.zeros((1024, words.shape[0], len(LABELS)), np.float32)
        self._class = np.zeros(1024, np.int64)
        self._told = np.zeros(1024, np.int64)
        # a span goes on only after its own beginning; a name and an address have more than one word
        self.allowed = chain.copy()
        for j, label in enumerate(LABELS):
            for i, before in enumerate(LABELS):
                goes_on = label[2:] == before[2:] and label[0] in "IM"
                if label[0] in "IM" and not goes_on or before in ("B-name", "B-address", "M-name") and not goes_on or before == label == "M-name":
                    self.allowed[i, j] = _NEVER
        self.opens = np.array([_NEVER if x[0] in "IM" else 0 for x in LABELS], np.float32)
        self.closes = np.array([_NEVER if x in ("B-name", "B-address", "M-name") else 0 for x in LABELS], np.float32)

    def save(self, path: Path) -> None:
        """Write the weights in half precision, features without weight left out."""
        keep = np.flatnonzero(np.abs(self.words).max((0, 2)) >= 0.02)
        names = sorted(self.index, key=self.index.get)
        used = np.flatnonzero(np.abs(self.triples).max(1) > 0)
        out = io.BytesIO()
        half = {"words": self.words[:, keep], "pairs": self.pairs, "told": self.told, "chain": self.chain, "start": self.start, "triple_rows": self.triples[used]}
        np.savez_compressed(out, names=np.frombuffer("\n".join(names[i] for i in keep).encode(), np.uint8), triples=used, seen=self.seen, **{k: v.astype(np.float16) for k, v in half.items()})
        path.write_bytes(out.getvalue())

    @staticmethod
    def load(path: Path) -> Tagger:
        with np.load(path) as z:
            names = z["names"].tobytes().decode().split("\n")
            triples = np.zeros((len(_CLASSES) ** 3, len(LABELS)), np.float32)
            triples[z["triples"]] = z["triple_rows"]
            full = {k: z[k].astype(np.float32) for k in ("words", "pairs", "told", "chain", "start")}
            seen = z["seen"]
        return Tagger({f: i for i, f in enumerate(names)}, full["words"], full["pairs"], triples, full["told"], full["chain"], full["start"], seen)

    def _id(self, word: str) -> int:
        row = self._row.get(word)
        if row is None:
            row = len(self._row)
            if row == len(self._class):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
                self._class = np.concatenate([self._class, np.zeros_like(self._class)])
                self._told = np.concatenate([self._told, np.zeros_like(self._told)])
            coarse = _coarse(word)
            known = [self.index[f] for f in _features(word, coarse) if f in self.index]
            self._table[row] = self.words[:, known].sum(1)
            self._class[row] = coarse
            self._told[row] = _announces(word)
            self._row[word] = row
        return row

    def scores(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Label scores of the words of every text, worked out for all texts at once."""
        reach, m, gap = _REACH, len(_CLASSES), [0] * _REACH
        rows, starts = list(gap), []
        for words in texts:
            starts.append(len(rows))
            rows += [self._id(w) for w in words]
            rows += gap
        ids, first = np.array(rows), np.array(starts)
        length = np.array([len(w) for w in texts])
        n = len(ids)
        out = np.zeros((n, len(LABELS)), np.float32)
        for k in range(-reach, reach + 1):  # what the word k places on contributes
            a, b = max(0, -k), min(n, n - k)
            out[a:b] += self._table[ids[a + k : b + k], k + reach]
        c, here = self._class[ids], slice(1, n - 1)
        out[here] += self.pairs[0][c[:-2] * m + c[1:-1]] + self.pairs[1][c[1:-1] * m + c[2:]]
        out[here] += self.triples[(c[:-2] * m + c[1:-1]) * m + c[2:]]
        told = self._told[ids]
        around = 0
        if told.any():
            low, high = np.zeros(n, np.int64), np.full(n, -1)
            for s, k in zip(starts, length):
                low[s : s + k], high[s : s + k] = s, s + k - 1
            around = _around(told, low, high)
        out += self.told[around * m + c] + self.never[c]
        out[first] += self.start + self.opens
        out[first + length - 1] += self.closes
        return [out[s : s + k] for s, k in zip(starts, length)]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """``(start, end, kind)`` of every text, decoded in batches of similar length."""
        if len(self._row) > _MEMO:
            self._row = {"": 0}
        cuts = [tokens(t) for t in texts]
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        groups: list[list[int]] = [[]]
        for i in sorted((i for i in range(len(texts)) if cuts[i]), key=lambda i: len(cuts[i])):
            if groups[-1] and (len(groups[-1]) == 64 or (len(groups[-1]) + 1) * len(cuts[i]) > _PADDED):
                groups.append([])
            groups[-1].append(i)
        for group in groups:
            if not group:
                continue
            best = viterbi(self.scores([[texts[i][a:b] for a, b in cuts[i]] for i in group]), self.allowed)
            for i, path in zip(group, best):
                out[i] = _join(path, cuts[i])
        return out


def _join(path: np.ndarray, cut: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    before = 0
    for label, (a, b) in zip(path, cut):
        if label:
            kind = LABELS[label][2:]
            if LABELS[label][0] != "B" and before and LABELS[before][2:] == kind:
                found[-1] = (found[-1][0], b, kind)
            else:
                found.append((a, b, kind))
        before = label
    return found


def viterbi(scores: list[np.ndarray], chain: np.ndarray) -> list[np.ndarray]:
    """Best label paths of sequences of different lengths, all at once."""
    size, count = max(map(len, scores)), len(scores)
    length = np.array([len(s) for s in scores])
    all_scores = np.zeros((size, count, chain.shape[0]), np.float32)
    for i, s in enumerate(scores):
        all_scores[: len(s), i] = s
    best = all_scores[0]
    back = np.zeros((size, count, chain.shape[0]), np.int8)
    hold = np.arange(chain.shape[0], dtype=np.int8)
    for t in range(1, size):
        go = length > t
        both = best[:, :, None] + chain[None]
        back[t] = np.where(go[:, None], both.argmax(1), hold[None])
        best = np.where(go[:, None], both.max(1) + all_scores[t], best)
    path = np.zeros((size, count), np.int64)
    path[-1] = best.argmax(1)
    for t in range(size - 1, 0, -1):
        path[t - 1] = back[t, np.arange(count), path[t]]
    return [path[:n, i] for i, n in enumerate(length)]


def _labels(text: str, cut: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> list[int]:
    out, s = [], 0
    for a, b in cut:
        while s < len(spans) and spans[s][1] <= a:
            s += 1
        if s < len(spans) and spans[s][0] < b:
            first = spans[s][0] >= a or not out or out[-1] == 0
            comma = spans[s][2] == "name" and text[a:b] == ","
            out.append(LABELS.index("M-name" if comma else ("B-" if first else "I-") + spans[s][2]))
        else:
            out.append(0)
    return out


def fit(table: list[tuple[str, list[tuple[int, int, str]]]], *, rounds: int = ROUNDS, rate: float = 0.1, decay: float = 0.2) -> Tagger:
    """Fit by maximum likelihood (forward-backward over padded batches, Adam)."""
    seqs = []
    for text, spans in table:
        cut = tokens(text)
        if cut:
            seqs.append(([text[a:b] for a, b in cut], _labels(text, cut, spans)))
    seqs.sort(key=lambda s: len(s[0]))
    index: dict[str, int] = {}
    tally: dict[str, int] = {}
    for words, _ in seqs:
        for w in words:
            for f in _features(w, _coarse(w)):
                tally[f] = tally.get(f, 0) + 1
    for f in sorted(tally):
        if tally[f] >= LEAST:
            index[f] = len(index)
    m, width, size, reach = len(_CLASSES), len(LABELS), len(index), _REACH
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in seqs for w in words))}
    of_word = [sorted({index[f] for f in _features(w, _coarse(w)) if f in index} or {0}) for w in vocabulary]
    feature = np.concatenate([np.array(f) for f in of_word])
    word_start = np.r_[0, np.cumsum([len(f) for f in of_word])[:-1]]
    by_feature = np.argsort(feature, kind="stable")
    feature_word = np.repeat(np.arange(len(of_word)), [len(f) for f in of_word])[by_feature]
    feature_start = np.searchsorted(feature[by_feature], np.arange(size))
    coarse = np.array([_coarse(w) for w in vocabulary])

    length = np.array([len(w) for w, _ in seqs])
    owner = np.repeat(np.arange(len(seqs)), length)
    step = np.concatenate([np.arange(x) for x in length])
    ids = np.array([vocabulary[w] for words, _ in seqs for w in words])
    gold = np.array([x for _, labels in seqs for x in labels])
    n, longest = len(ids), int(length.max())
    at = np.arange(n)
    near = [(at[(step + k >= 0) & (step + k < length[owner])], k) for k in range(-reach, reach + 1)]
    left = np.where(step > 0, coarse[ids[np.maximum(at - 1, 0)]], 0)
    right = np.where(step < length[owner] - 1, coarse[ids[np.minimum(at + 1, n - 1)]], 0)
    here = coarse[ids]
    told = np.array([_announces(w) for w in vocabulary])[ids]
    ends = np.cumsum(length)
    around = _around(told, (ends - length)[owner], (ends - 1)[owner])
    joint = [left * m + here, here * m + right, (left * m + here) * m + right, around * m + here]
    used, triple = np.unique(joint[2], return_inverse=True)
    joint[2] = triple

    def gathered(values: np.ndarray, groups: np.ndarray, count: int) -> np.ndarray:
        return np.stack([np.bincount(groups, values[:, j], count) for j in range(width)], 1)

    sizes = (m * m, m * m, len(used), 16 * m)
    theta = [np.zeros((2 * reach + 1, size, width)), *[np.zeros((x, width)) for x in sizes], np.zeros((width, width)), np.zeros(width)]
    chain, start = theta[5], theta[6]
    want = np.zeros((n, width))
    want[at, gold] = 1
    same = owner[1:] == owner[:-1]
    want_chain = np.zeros((width, width))
    np.add.at(want_chain, (gold[:-1][same], gold[1:][same]), 1)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in theta]
    for r in range(1, rounds + 1):
        emit = sum(theta[1 + i][joint[i]] for i in range(4))
        for rows, k in near:
            emit[rows] += np.add.reduceat(theta[0][k + reach][feature], word_start, axis=0)[ids[rows + k]]
        e = np.zeros((longest, len(length), width))
        e[step, owner] = emit
        e[0] += start
        alpha, beta, link = np.empty_like(e), np.ones_like(e), np.exp(chain)
        for t in range(longest):
            live = e[t] if t == 0 else e[t] + np.log(alpha[t - 1] @ link)
            alpha[t] = np.exp(live - live.max(1, keepdims=True))
            alpha[t] /= alpha[t].sum(1, keepdims=True)
        expected = np.zeros((width, width))
        for t in range(longest - 2, -1, -1):
            go = length > t + 1
            ahead = beta[t + 1][go] * np.exp(e[t + 1][go] - e[t + 1][go].max(1, keepdims=True))
            back = ahead @ link.T
            beta[t][go] = back / back.sum(1, keepdims=True)
            both = alpha[t][go][:, :, None] * link[None] * ahead[:, None, :]
            expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
        chance = alpha * beta
        chance /= chance.sum(2, keepdims=True)
        wrong = want - chance[step, owner]
        of_features = np.empty_like(theta[0])
        for rows, k in near:
            of_features[k + reach] = np.add.reduceat(gathered(wrong[rows], ids[rows + k], len(of_word))[feature_word], feature_start, axis=0)
        grads = [of_features, *[gathered(wrong, joint[i], sizes[i]) for i in range(4)], want_chain - expected, wrong[step == 0].sum(0)]
        for x, g, s in zip(theta, grads, state):
            g = g - decay * x
            s[0] *= 0.85
            s[0] += 0.15 * g
            s[1] *= 0.98
            s[1] += 0.02 * g * g
            x += rate * (s[0] / (1 - 0.85**r)) / (np.sqrt(s[1] / (1 - 0.98**r)) + 1e-6)
    seen = np.bincount(here * width + gold, minlength=m * width).reshape(m, width) > 0
    seen[:, 0] = True
    triples = np.zeros((m * m * m, width), np.float32)
    triples[used] = theta[3]
    return Tagger(index, theta[0].astype(np.float32), np.stack(theta[1:3]).astype(np.float32), triples, theta[4].astype(np.float32), chain.astype(np.float32), start.astype(np.float32), seen)


@lru_cache(1)
def default_tagger() -> Tagger:
    """The fitted tagger; its weights are read, and fitted only where they were never written."""
    if not WEIGHTS.exists():
        fit(labelled_table(ROWS)).save(WEIGHTS)
    return Tagger.load(WEIGHTS)


def accuracy(tagger: Tagger, table: list[tuple[str, list[tuple[int, int, str]]]]) -> dict[str, tuple[float, float]]:
    """Precision and recall of whole spans by kind."""
    right, found, there = (dict.fromkeys(KINDS, 0) for _ in range(3))
    for (_, want), got in zip(table, tagger.spans([t for t, _ in table])):
        for _, _, k in want:
            there[k] += 1
        for x in got:
            found[x[2]] += 1
            right[x[2]] += x in set(want)
    return {k: (right[k] / max(found[k], 1), right[k] / max(there[k], 1)) for k in KINDS}


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its placeholder, the rest as it is."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


def tag_personal(rows: DataFrame, *, key: str = "id", text: str = "content", tagger: Tagger | None = None) -> DataFrame:
    """``(key, kinds array<string>, spans array<struct>, redacted string)`` for every row with a text.

    ``spans`` holds ``start``, ``end`` (in characters) and ``kind``.  Rows with a null text
    have none; an empty or blank text comes out as it is with no spans.  Repeated rows come
    out repeated.  The model (a few MB, bounded by the labelled table) is broadcast.
    """
    shared = rows.sparkSession.sparkContext.broadcast(tagger or default_tagger())
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                spans = model.spans(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([sorted({k for _, _, k in s}) for s in spans], pa.list_(pa.string())),
                        pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))),
                        pa.array([redact(t, s) for t, s in zip(texts, spans)], pa.string()),
                    ],
                    names=[key, "kinds", "spans", "redacted"],
                )

    work = spread(rows.select(key, text).where(F.col(text).isNotNull()), key)
    return work.mapInArrow(run, f"{key} {kind}, kinds array<string>, spans array<struct<start:int,end:int,kind:string>>, redacted string")


def personal_kinds(rows: DataFrame, *, key: str = "id", text: str = "content") -> DataFrame:
    """``(neuron_id, kind)``, distinct: the kinds of personal information in each content."""
    found = tag_personal(rows.where(F.col(key).isNotNull()).select(key, text), key=key, text=text)
    return found.select(F.col(key).alias("neuron_id"), F.explode("kinds").alias("kind")).distinct()


if __name__ == "__main__":
    held_out = labelled_table(3000, seed=99, part="held")
    apart = fit(labelled_table(ROWS, part="train"))
    for kind, (precision, recall) in accuracy(apart, held_out).items():
        print(f"{kind}: precision {precision:.3f}, recall {recall:.3f} on held-out patterns and names")
    fit(labelled_table(ROWS)).save(WEIGHTS)
