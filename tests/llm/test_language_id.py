"""Language spans: Viterbi against a plain one, words against a plain reading, accuracy on held-out documents."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bocage.llm import language_id as m

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, lang_pred string, score string, _text string"
SAYS = {
    "en": "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state those people too mr how little good world make very year still see own work men day get here old life both between being under three never know same last another while us might great since against right came take go place",
    "nl": "de van het een en in is dat op te zijn met voor niet aan er om ook als dan maar hij bij uit nog naar heeft over zo door wat wel kan tot worden was werd geen had dit wij deze jaar moet veel meer hun waar ik nu al zich men onder haar die na daar hem dus ze tegen ons zou kunnen alle mijn zonder twee zeer toch iets goed mensen tijd eerste andere moeten grote jaren weer worden tussen hebben gaan wil hier zelf maken laten zien komen vragen",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой ее мочь год от так о для ты же все тот мочь вы человек такой его сказать только или еще бы себя один как уже до время если сам когда другой вот говорить наш мой знать стать при чтобы дело жизнь кто первый очень два день ее новый рука даже во со раз где там под можно ну какой после их работа без самый потом надо хотеть ли слово идти большой должен место иметь ничто",
    "el": "και το να του η της με που την από για τα είναι των σε ο οι στο θα τη στην τον τους δεν τις ένα μια ότι ή στη στον αλλά αυτό όπως πολύ μας ήταν έχει πως αν μου κατά σας μετά αυτή όταν μόνο πιο χρόνια",
}


def _plain_words(text):
    """Runs of letters and marks of one script: begin, end, letters."""
    kind, script, _ = m._characters()
    out, begin = [], None
    for i, c in enumerate(text + "\n"):
        inside = kind[ord(c)] > 0
        if begin is not None and (not inside or script[ord(c)] != script[ord(text[i - 1])]):
            out.append((begin, i, sum(text[j].isalpha() for j in range(begin, i))))
            begin = None
        if inside and begin is None:
            begin = i
    return out


TEXTS = ["", "a", "Ünïcode wörds; 12 (x)", "русскийtext и ελληνικά", "नमस्ते दुनिया", "漢字かなカナ混じり", " \n\t", "é" * 50, "İstanbul ǅ ﬁ"]


def test_words_as_read_plainly():
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab é12.жщ漢字́\n") for _ in range(80)) for _ in range(30)]
    w = m.read_words([(i, 0, t) for i, t in enumerate(texts)], 1 << 12)
    got = list(zip(w.piece.tolist(), w.begin.tolist(), w.end.tolist(), w.letters.tolist()))
    assert got == [(i, *x) for i, t in enumerate(texts) for x in _plain_words(t)]
    assert m.read_words([(0, 0, "")], 1 << 12).first.tolist() == []


def test_ngrams_of_a_word_do_not_depend_on_its_neighbours():
    def grams(text, k):
        w = m.read_words([(0, 0, text)], 1 << 16)
        ends = [*w.first[1:], w.grams.shape[1]]
        return [w.grams[:, a:b].tolist() for a, b in zip(w.first, ends)][k]

    assert grams("one", 0) == grams("Two, one!", 1) == grams("ONE", 0) == grams("жone", 1) != grams("ones", 0)
    assert len(grams("one", 0)[0]) == 4


def test_viterbi_as_by_trying_all():
    rng = np.random.default_rng(1)
    scores, sequence, want = [], [], []
    prior = rng.normal(size=3)
    for n, length in enumerate([3, 1, 6, 5, 1, 4]):
        own = rng.normal(size=(length, 3)) * 3
        best = max(
            np.ndindex(*[3] * length),
            key=lambda path: prior[path[0]] + sum(own[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:])),
        )
        scores.append(own)
        sequence += [n] * length
        want += best
    assert m.viterbi(np.concatenate(scores), np.array(sequence), prior, 2.0).tolist() == want


def test_pieces_are_whole_and_cut_at_blanks():
    texts = ["ab cd ef gh", "", None, "x" * 25, "end"]
    flat = [p for pieces in m.pieces_of(texts, 8) for p in pieces]
    for n, text in enumerate(texts):
        own = [p for p in flat if p[0] == n]
        assert "".join(p[2] for p in own) == (text or "") and all(len(p[2]) <= 8 for p in own)
        assert [p[1] for p in own] == [sum(len(q[2]) for q in own[:i]) for i in range(len(own))]
    assert [p[2] for p in flat if p[0] == 0] == ["ab cd ", "ef gh"]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(SAYS[lang].split(), k=80)), lang, None, None, None, None) for i, lang in enumerate([*SAYS] * 30)]
    rows += [(None, None, "en", None, None, None, None), (3, "", "nl", None, None, None, None), (4, "the", None, None, None, None, None)]
    return m.fit(spark.createDataFrame(rows, SCHEMA))


def _sentence(rng, lang, n):
    return " ".join(rng.choices(SAYS[lang].split(), k=n))


def test_spans_of_mixed_texts(spark, model):
    assert model.languages == sorted(SAYS)
    rng = random.Random(9)
    rows, want = [], []
    for i in range(40):
        langs = rng.sample(sorted(SAYS), 2)
        parts = [_sentence(rng, langs[0], 40), _sentence(rng, langs[1], 15)]
        rows.append((i, ". ".join(parts), None, None, None, None, None))
        want.append((langs, len(parts[0])))
    got = {r.doc_id: r for r in m.label(spark.createDataFrame(rows, SCHEMA).repartition(3), model).collect()}
    right = 0
    for i, (langs, border) in enumerate(want):
        spans = got[i].spans
        assert got[i].lang_pred == langs[0] and 0 < got[i].score < 1 and got[i].n_spans == len(spans)
        right += [s.lang for s in spans] == langs and abs(spans[0].end - border) < 12
    assert right >= 36


def test_odd_texts(spark, model):
    texts = [None, "", " 12 -- 3", "жизнь", "שלום עולם", "the " * 100_000, "de van het" * 60_000, "the", "ΚΑΙ ΤΟ", "THE OF AND with"]
    rows = [(None if i == 7 else i, t, "x", None, "y", "z", "w") for i, t in enumerate(texts)] + [(8, "ΚΑΙ ΤΟ", None, None, None, None, None)]
    got = [tuple(r)[:3] for r in m.label(spark.createDataFrame(rows, SCHEMA), model).collect()]
    names = {k: v for k, v, _ in got}
    assert [names[i] for i in (0, 1, 2)] == ["und"] * 3 and names[3] == "ru" and names[5] == "en" and names[8] == "el" and names[9] == "en"
    assert names[4] in SAYS and all(0 <= s <= 1 for _, _, s in got) and len(got) == len(rows) and None in names
    assert m.label(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "the", None, None, None, None, None)], SCHEMA)
    assert m.fit(docs) is None and m.fit(docs.limit(0)) is None
    assert [tuple(r) for r in m.label(docs, None).collect()] == [(1, "und", 0.0, 0, [])]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    found = m.op12(spark, DATA).join(docs, "doc_id")
    by = {r.held_out: r for r in found.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).collect()}
    assert by[True].right > 0.99 and by[False].right > 0.99 and by[True].n + by[False].n == 1000


def test_predictions_do_not_see_labels(spark, model):
    docs = spark.createDataFrame([(5, "the of and", "ru", "s", None, None, None)], SCHEMA)
    assert m.label(docs, model).first().lang_pred == "en"
