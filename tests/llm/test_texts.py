"""p2, p7, p8, p9 on small and odd texts."""

import random

import numpy as np
import pytest
import regex

from engramlake.llm import encode, leakage, near_duplicates, sentences


def canon(t):
    return " ".join(t.lower().split())


def grams(t):
    return {t[i : i + 3] for i in range(len(t) - 2)}


def edited(r, t):
    w = t.split()
    for _ in range(r.randrange(1, 4)):
        w[r.randrange(len(w))] = "".join(r.choice("abcdefghij") for _ in range(5))
    return " ".join(w)


def corpus(n, seed):
    r = random.Random(seed)
    base = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 8))) for _ in range(14)) for _ in range(n)]
    return [x for b in base for x in (b, edited(r, b), b.upper())]


NEURON = "id string, content string, rep string, body int"


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, NEURON)
    return {(r.neuron_a, r.neuron_b) for r in near_duplicates.near_duplicate_pairs(df, **options).collect()}


def brute(texts, t=0.7, least=60):
    kept = {i: canon(x) for i, x in texts.items() if x and len(canon(x)) >= least}
    ids = sorted(kept)
    g = {i: grams(kept[i]) for i in ids}
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(g[a] & g[b]) >= t * len(g[a] | g[b])}


def test_near_duplicates_equal_brute_force(spark):
    texts = {f"n{i:04d}": x for i, x in enumerate(corpus(60, 4))}
    assert found(spark, [(i, x, "r", 1) for i, x in texts.items()]) == brute(texts)


def test_hot_pieces_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 12)
    monkeypatch.setattr(near_duplicates, "PROBES", 64)
    r = random.Random(9)
    stem = "the same long opening of every text that a third of all rows share between them "
    texts = {f"n{i:04d}": stem + " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(r.randrange(40)) for _ in range(8)) for i in range(90)}
    assert found(spark, [(i, x, "r", 1) for i, x in texts.items()]) == brute(texts)


def forest(sets, t):
    """The trees of sets in their own order, all entered under one first piece."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    tails = [np.array(sets[i][1:], np.uint16) for i in order]
    bits = np.zeros((len(sets), near_duplicates.WORDS), np.uint64)
    return order, near_duplicates.Forest(n[order], np.zeros(len(n), np.int64), np.ones(len(n), bool), np.concatenate(tails), np.cumsum([len(x) for x in tails]), bits, t)


def test_branches_share_overlaps_and_end_early():
    r = random.Random(3)
    stem = list(range(1, 31))
    sets = [[0, *stem, *sorted(r.sample(range(100, 140), 12))] for _ in range(40)] + [[0, *sorted(r.sample(range(1000, 9000), 42))] for _ in range(40)]
    order, trees = forest(sets, 0.7)
    x, y = trees.pairs([(0, len(sets))])
    got = {tuple(sorted((int(order[a]), int(order[b])))) for a, b in zip(x, y)}
    near = {(a, b) for a in range(80) for b in range(a + 1, 80) if len(set(sets[a]) & set(sets[b])) >= 0.7 * len(set(sets[a]) | set(sets[b]))}
    assert near and near <= got and all(b < 40 for _, b in got)
    depth = int(trees.steps[0])
    assert depth < len(stem)  # branches end when the remaining lengths allow no more misses
    assert trees.walked <= 41 * depth and trees.unshared == 80 * depth  # the stem is one branch


def test_trees_lose_no_pair_at_any_size():
    r = random.Random(5)
    for t in (0.5, 0.7, 0.9):
        base = [[0, *sorted(r.sample(range(1, 400), r.randrange(1, 60)))] for _ in range(30)]
        sets = base + [[0, *sorted(({*s[1:]} - set(r.sample(s[1:], len(s) // 8))) | set(r.sample(range(1, 400), len(s) // 9)))] for s in base]
        order, trees = forest(sets, t)
        x, y = trees.pairs([(0, len(sets))])
        got = {tuple(sorted((int(order[a]), int(order[b])))) for a, b in zip(x, y)}
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                if len(set(sets[a]) & set(sets[b])) >= t * len(set(sets[a]) | set(sets[b])):
                    assert (a, b) in got


def test_near_duplicates_on_odd_rows(spark):
    long = "word " * 30_000 + "end"
    rows = [("a", None, None, None), ("b", "", None, None), ("c", "   ", None, None), ("d", "short", None, None), (None, "x" * 70, None, None), ("e", long, None, None), ("f", long + ".", None, None), ("e", long, None, None), ("g", "記憶" * 40, None, None), ("h", "記憶" * 40, None, None)]
    assert found(spark, rows) == {("e", "f"), ("g", "h")}
    assert found(spark, []) == set()


def test_classes_keep_copies_together(spark):
    t = "a text that is long enough to take part in the join of all the texts here"
    members, links = near_duplicates.near_duplicates(spark.createDataFrame([("b", t, "", 1), ("a", t.upper(), "", 1), ("c", t + " x", "", 1)], NEURON))
    assert {(r.neuron_id, r.class_id) for r in members.collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert {tuple(sorted((r.class_a, r.class_b))) for r in links.collect()} == {("a", "c")}


def test_classes_of_copies_in_both_forms(spark):
    t = "a text that is long enough to take part in the join of all the texts here"
    rows = [(f"c{i}", t, "", 1) for i in range(6)] + [("d0", t + " x", "", 1), ("d1", t + " x", "", 1)]
    ids = sorted(r[0] for r in rows)
    assert found(spark, rows) == {(a, b) for a in ids for b in ids if a < b}
    assert found(spark, rows, copies="representative") == {("c0", f"c{i}") for i in range(1, 6)} | {("d0", "d1"), ("c0", "d0")}
    with pytest.raises(ValueError):
        found(spark, rows, copies="some")


def test_chunks_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CHUNK", 64)
    monkeypatch.setattr(near_duplicates, "PACK", 8)
    monkeypatch.setattr(near_duplicates, "BLOCK", 12)
    texts = {f"n{i:04d}": x for i, x in enumerate(corpus(60, 6))}
    assert found(spark, [(i, x, "r", 1) for i, x in texts.items()]) == brute(texts)


def test_units_of_sizes_apart_lose_no_pair(monkeypatch):
    monkeypatch.setattr(near_duplicates, "FEW", 4)
    test_trees_lose_no_pair_at_any_size()


def test_large_classes_have_several_units(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "COPIES", 3)
    t = "a text that is long enough to take part in the join of all the texts here"
    rows = [(f"c{i}", t, "", 1) for i in range(8)] + [("d0", "quite another one, of which there are only two copies in all the rows", "", 1)] * 2 + [("d1", "Quite another one, of which there are only two copies in all the rows", "", 1)]
    assert found(spark, rows) == {(f"c{i}", f"c{j}") for i in range(8) for j in range(i + 1, 8)} | {("d0", "d1")}


def test_shuffle_is_in_proportion_to_the_texts(spark):
    texts = corpus(150, 8)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert found(spark, [(f"n{i:04d}", x, "r", 1) for i, x in enumerate(texts)])
    assert written() - before < 20 * sum(map(len, texts))  # measured: 12 times these short texts, 31 with entries as rows


VOCABULARY = encode.DEFAULT_VOCABULARY
TEXTS = ["", " ", "Hello world's   end\n\n x", "naïve café ☕ 記憶のグラフ", "a" * 5000, "abab" * 3000, "<|endoftext|>", "\t\x1c　x 1234567", "don't 'RE we'll", "𝒳𝒴 é ​"]


def test_ids_equal_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("ab \n'é記1") for _ in range(r.randrange(1, 200))) for _ in range(300)]
    got = encode.encode_corpus(spark.createDataFrame([(i, x, 0) for i, x in enumerate(texts)], "doc_id bigint, text string, ids int")).collect()
    want = t.encode_batch(texts, add_special_tokens=False)
    assert {x.doc_id: list(x.ids) for x in got} == {i: w.ids for i, w in enumerate(want)}
    assert all(t.decode(x.ids, skip_special_tokens=False) == texts[x.doc_id] for x in got)


def test_ids_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (1, None)], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), list(r.ids)) for r in encode.encode_corpus(df).collect()) == [("1", []), ("1", []), ("2", []), ("None", [64])]
    assert encode.encode_corpus(df.limit(0)).count() == 0


def norm(t):
    return regex.sub(r"[^\p{L}\p{N}]+", "", t.lower())


def test_leaks_equal_brute_force(spark):
    r = random.Random(7)
    items = [(i, " ".join("".join(r.choice("abcdef0123") for _ in range(5)) for _ in range(r.randrange(8, 30)))) for i in range(12)]
    docs = []
    for d in range(60):
        text = " ".join("".join(r.choice("abcdef0123") for _ in range(4)) for _ in range(20))
        if d % 2:
            whole = r.choice(items)[1]
            n = r.randrange(40, 90)
            at = r.randrange(0, max(1, len(whole) - n))
            piece = whole[at : at + n]
            if d % 4 == 1:
                piece = piece.upper().replace(" ", ",\n-- ")
            text += piece + text
        docs.append((d, text, "h"))
    docs += [(100, None, ""), (101, "", ""), (None, items[0][1], ""), (102, items[0][1] * 2000, "")]
    want = {(d, i) for d, t, _ in docs if t and d is not None for i, x in items if any(norm(x)[j : j + 50] in norm(t) for j in range(len(norm(x)) - 49))}
    got = leakage.leaked_passages(spark.createDataFrame(docs, "doc_id int, text string, h string"), spark.createDataFrame([*items, (77, None), (78, "x"), (None, "y" * 60)], "item_id int, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert leakage.leaked_passages(spark.createDataFrame([], "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")).count() == 0


def test_leaks_with_other_slots_are_not_verbatim(spark):
    item = "In the morning Anna moved 12 crates by hand and later Bob moved 40 mm of the same old rope again"
    docs = [(1, item), (2, item.replace("12", "47").replace("40", "31")), (3, item.replace("Anna", "Elsa")), (4, item.upper())]
    got = leakage.leaked_passages(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(9, item)], "item_id int, text string")).collect()
    keep = {d for d, t in docs if any(norm(item)[j : j + 50] in norm(t) for j in range(len(norm(item)) - 49))}
    assert {r.doc_id for r in got} == keep == {1, 3, 4}  # one number apart is not the same stretch
    t = leakage.Templates(["anna", "elsa"], 25)
    at = np.array([0])
    assert t.hashes("theanna12mmfellofftheoldx", at) == t.hashes("theelsa47mmfellofftheoldx", at) != t.hashes("theanna12zzfellofftheoldx", at)


def test_many_item_windows_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 3)
    test_leaks_equal_brute_force(spark)
    test_reparameterised_finds_planted_questions(spark)


PLANTED = [
    ("If {a} has {x} apples and gives {y} of them to {b} then how many apples does {a} keep for lunch today", ("Anna", "Bob"), ("Carla", "Dirk")),
    ("Wenn {a} am Morgen {x} Kisten trägt und {b} danach {y} davon wieder abgibt, wie viele bleiben dann bei {a}", ("Anna", "Bernd"), ("Clara", "Dieter")),
    ("如果{a}早上有{x}个苹果并且给了{b}其中的{y}个，那么{a}在晚上还剩下多少个苹果可以吃", ("Zorvan", "Tanquil"), ("Belmor", "Dravix")),
    ("もし{a}が朝に{x}個のりんごを持っていて{b}にそのうちの{y}個をあげたら、{a}には夜に何個のりんごが残りますか", ("アンナ", "ボブ"), ("カルラ", "ディルク")),
    ("अगर {a} के पास सुबह {x} सेब हैं और वह {b} को उनमें से {y} दे देता है तो शाम को {a} के पास कितने बचेंगे", ("Zorvan", "Tanquil"), ("Belmor", "Dravix")),
    ("إذا كان لدى {a} في الصباح {x} تفاحة وأعطى {b} منها {y} فكم تفاحة تبقى مع {a} في المساء", ("Zorvan", "Tanquil"), ("Belmor", "Dravix")),
]


def test_reparameterised_finds_planted_questions(spark):
    items = [(i, t.format(a=n[0], b=n[1], x=12, y=5)) for i, (t, n, _) in enumerate(PLANTED)]
    docs = []
    for i, (t, n, other) in enumerate(PLANTED):
        docs += [
            (10 * i + 1, "Some text before. " + t.format(a=other[0], b=other[1], x=408, y=37) + " And some after."),
            (10 * i + 2, items[i][1]),  # verbatim
            (10 * i + 3, t.format(a=n[0], b=n[1], x=13, y=5)),  # one number
            (10 * i + 4, t.format(a=n[1], b=n[1], x=12, y=5)),  # two names become one
        ]
    docs += [(90, None), (91, ""), (None, docs[0][1]), (92, "12 apples and 5 pears were sold to Bob on Monday before Anna came home")]
    rows = leakage.reparameterised(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([*items, (77, None), (None, items[0][1])], "item_id int, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.doc_id % 10 in (1, 3)} == {(10 * i + k, i) for i in range(len(PLANTED)) for k in (1, 3)}  # all planted ones
    wrong = [r for r in rows if r.doc_id // 10 != r.item_id or r.doc_id % 10 == 2]
    assert not wrong  # nothing else but windows that hold one of the two names only
    assert all(r.windows >= r.renamed > 0 for r in rows)


SENTENCES = [
    ("Mr. Ash met Dr. Lee. They left at 3 p.m. on Friday.", ["Mr. Ash met Dr. Lee.", "They left at 3 p.m. on Friday."]),
    ("It costs 3.50. Cheap!", ["It costs 3.50.", "Cheap!"]),
    ('"Stop!" said Ann. She left.', ['"Stop!" said Ann.', "She left."]),
    ("(See the notes.) We go on.", ["(See the notes.)", "We go on."]),
    ("# Title\n\nA line\nthat goes on. End", ["# Title", "A line\nthat goes on.", "End"]),
    ("a\r\n \r\nb\n\t\nc", ["a", "b", "c"]),
    ("今日は晴れ。「行こう。」と言った。終わり", ["今日は晴れ。", "「行こう。」と言った。", "終わり"]),
    ("他来了。“好吗？”她问。走！", ["他来了。", "“好吗？”她问。", "走！"]),
    ("Am 3. Mai kam Dr. Ott. Das war z. B. gut.", ["Am 3. Mai kam Dr. Ott.", "Das war z. B. gut."]),
    ("M. Roy répondit : « C'est prêt. » On garde tout, etc. Env. 9 lignes restent, p. ex. la fin !", ["M. Roy répondit : « C'est prêt. »", "On garde tout, etc.", "Env. 9 lignes restent, p. ex. la fin !"]),
    ("¿Qué tal? ¡Bien! Vive en EE. UU. desde ayer.", ["¿Qué tal?", "¡Bien!", "Vive en EE. UU. desde ayer."]),
    ("यह घर है। वह गया।", ["यह घर है।", "वह गया।"]),
    ("هل تم؟ نعم.", ["هل تم؟", "نعم."]),
    ("Так и т. д. сделано в 2024 г. и позже. Да!", ["Так и т. д. сделано в 2024 г. и позже.", "Да!"]),
    ("Really?! Yes... and no.", ["Really?!", "Yes... and no."]),
    ("1. First point\n\n- second. Third.", ["1. First point", "- second.", "Third."]),
]


@pytest.mark.parametrize("text, want", SENTENCES)
def test_sentences_of_one_text(text, want):
    common = frozenset({"+they", "+she", "+we", "+das", "+third", "+on", "+env", "*lee", "*friday"})
    assert [text[a:b] for a, b in sentences.Splitter(text, common).sentences()] == want


@pytest.mark.parametrize("text", ["He told me. Then she left the room.", "Please wait for me. Everyone is ready now.", "My ex. She called.", "We moved to ca. Then it rained.", "The rep. Then came.", "He sat. Then he slept.", "We saw the sun. Alice smiled at it.", "Compute the max. Then stop."])
def test_words_that_only_look_like_abbreviations(text):
    a, b = sentences.Splitter(text).sentences()
    assert text[b[0] :] == text.split(". ")[1] and a[1] == text.index(".") + 1


@pytest.mark.parametrize("text", ["Me. Roux and Mr. Ash met on Sun. morning.", "See cf. No. 140: the rest.", "Er kam ca. 5 Minuten, vgl. Tabelle 3.", "डॉ. Lee ने कहा।"])
def test_listed_abbreviations_go_on(text):
    assert sentences.Splitter(text).sentences() == [(0, len(text))]


def test_the_document_comes_before_the_lists():
    text = "He said approx and approx again, then approx. Lee agreed with that approx number."
    assert len(sentences.Splitter("It took approx. Lee hours.").sentences()) == 1
    own = sentences.Counter()
    sentences.count_words(text, own)
    assert sentences.is_abbreviation(own, "approx") is False
    assert len(sentences.Splitter(text).sentences()) == 2
    listed = "The quux. item and the quux. list. We saw quux. Lee was there. Lee is a name, says Lee."
    assert len(sentences.Splitter(listed).sentences()) == 3


def test_scripts_without_terminators():
    for text, n in (("สวัสดีครับ ผมชื่อสมชายครับ ยินดีที่ได้รู้จัก", 3), ("བཀྲ་ཤིས། བདེ་ལེགས།", 2), ("ສະບາຍດີແລ້ວ ຂ້ອຍໄປ", 2)):
        parts = sentences.Splitter(text).sentences()
        assert len(parts) == n and [text[a:b] for a, b in parts] == text.split(" ")


def test_long_quotes_and_brackets_enclose():
    inner = "We went there. It was late. " * 60
    for left, right in ("()", "“”", '""'):
        par = f"He said {left}{inner}{right} and left."
        assert sentences._enclosed(par) == [(par.index(left), len(par) - len(" and left.") - 1)]
        assert [par[x:y] for x, y in sentences.Splitter(par, sentences.Counter()).sentences()] == [par]
    assert sentences._enclosed("( a [b] " + "x" * 2000 + " { “c” ") == [(4, 6), (2011, 2013)]


def test_sentences_of_a_corpus(spark):
    docs = [(1, None), (2, ""), (3, " \n\n "), (4, "We ran. They sat."), (None, "Is it? Yes."), (4, "We ran. They sat."), (5, "no end " * 60_000)]
    rows = sentences.split_sentences(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.start_pos) for r in rows) == [("4", 0), ("4", 0), ("4", 8), ("4", 8), ("5", 0), ("None", 0), ("None", 7)]
    for r in rows:
        if r.doc_id == 4:
            assert "We ran. They sat."[r.start_pos : r.end_pos] == r.sentence


def test_the_corpus_tells_abbreviations(spark):
    docs = [(i, f"the quux. item {i} is here and the quux. list too") for i in range(5)] + [(9, "We saw the quux. Plan of it.")] + [(20 + i, "Here is the Plan of it") for i in range(3)]
    rows = sentences.split_sentences(spark.createDataFrame(docs, "doc_id bigint, text string")).where("doc_id = 9").collect()
    assert len(rows) == 1
