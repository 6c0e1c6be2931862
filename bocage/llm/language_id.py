"""The languages of a text: spans of one language each, and the language with most of its letters.

Method.  A word is a run of letters of one script.  The script narrows the languages that come
into question to those that are written in it: languages with at least a hundredth of their
training letters there.  Each of them scores the word by its n-grams of two to four characters,
word ends included.  Viterbi then finds the best sequence of languages over the words, where every
switch costs a fixed penalty, so that a foreign word or a name does not start a span.

Training counts hashed n-grams per language: a table of fixed size, added up by Spark over all
training texts.  Only the finished scores are broadcast, at most ``CELLS`` numbers.
Prediction works on blocks of many texts; step t of Viterbi is taken for all texts of a block that have a word t.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (2, 3, 4)
CELLS = 1 << 24  # scores in the model: 64 MB
BUCKETS = 1 << 16  # hashed n-grams per language, fewer where there are more than 256 languages
SMOOTHING = 0.5
SWITCH = 8.0  # cost of a change of language, in nats
WORST = 6.0  # a word speaks against a language by no more than this
OUTSIDE = 1000.0  # a language that is not written in the word's script
OWN_SCRIPT = 0.01  # share of a language's training letters from which a script is one of its own
PIECE = 1 << 18  # characters read at once; a longer text is cut, at white space where there is some
BLOCK = 1 << 22  # scores of words held at once

# Blocks of the Unicode standard (first and last code point) by script.
SCRIPTS = [
    ("Latin", [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)]),
    ("Greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("Cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("Armenian", [(0x530, 0x58F)]),
    ("Hebrew", [(0x590, 0x5FF), (0xFB1D, 0xFB4F)]),
    ("Arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("Devanagari", [(0x900, 0x97F)]),
    ("Bengali", [(0x980, 0x9FF)]),
    ("Gurmukhi", [(0xA00, 0xA7F)]),
    ("Gujarati", [(0xA80, 0xAFF)]),
    ("Tamil", [(0xB80, 0xBFF)]),
    ("Telugu", [(0xC00, 0xC7F)]),
    ("Kannada", [(0xC80, 0xCFF)]),
    ("Malayalam", [(0xD00, 0xD7F)]),
    ("Sinhala", [(0xD80, 0xDFF)]),
    ("Thai", [(0xE00, 0xE7F)]),
    ("Lao", [(0xE80, 0xEFF)]),
    ("Tibetan", [(0xF00, 0xFFF)]),
    ("Myanmar", [(0x1000, 0x109F)]),
    ("Georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)]),
    ("Ethiopic", [(0x1200, 0x139F)]),
    ("Khmer", [(0x1780, 0x17FF)]),
    ("Mongolian", [(0x1800, 0x18AF)]),
    ("Hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("Kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]),
    ("Han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)]),
]
OTHER = len(SCRIPTS)  # letters of any other script


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 2 for letters, 1 for marks, else 0; the script; the small letter."""
    import unicodedata

    kind, script = np.zeros(0x110000, np.uint8), np.full(0x110000, OTHER, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            kind[i] = 2
            small = c.lower()
            if len(small) == 1:
                lower[i] = ord(small)
        elif i > 127 and unicodedata.category(c)[0] == "M":
            kind[i] = 1
    for n, (_, blocks) in enumerate(SCRIPTS):
        for first, last in blocks:
            script[first : last + 1] = n
    return kind, script, lower


@dataclass
class Words:
    """Words of some pieces of text; ``grams`` are the buckets of their n-grams, ``first`` where each word's begin."""

    piece: np.ndarray  # number of the piece
    begin: np.ndarray  # first character in the text
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    first: np.ndarray
    grams: np.ndarray  # order x place


def _shifted(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, values.dtype), values[:-1]])


def read_words(pieces: list[tuple[int, int, str]], buckets: int) -> Words:
    """Words of pieces ``(number of the text, characters before, text)``."""
    kind_of, script_of, lower = _characters()
    chars = np.frombuffer(("\n".join(p[2] for p in pieces) + "\n").encode("utf-32-le"), "<u4")
    start = np.cumsum([0, *[len(p[2]) + 1 for p in pieces[:-1]]])
    kind, script = kind_of[chars], script_of[chars]
    inside = kind > 0
    same = inside & _shifted(inside) & (script == _shifted(script))  # goes on the word of the character before
    at, begins = np.flatnonzero(inside), np.flatnonzero(inside & ~same)
    ends = np.flatnonzero(_shifted(inside) & ~same)  # the place after each word
    word = np.cumsum(inside & ~same) - 1
    small = np.where(inside, lower[chars], 0).astype(np.uint32)
    # characters before each one in its word; an n-gram may also end after the word
    before = [small]
    for _ in ORDERS:
        before.append(np.where(same, _shifted(before[-1]), np.uint32(0)))
    owner = np.concatenate([word[at], np.arange(len(ends))])
    order = np.argsort(owner, kind="stable")
    mixed = np.concatenate([small[at], np.zeros(len(ends), np.uint32)])[order] * np.uint32(0x9E3779B1)
    shift = np.uint32(33 - buckets.bit_length())
    grams = np.empty((len(ORDERS), len(owner)), np.int32)
    for n in range(len(ORDERS)):
        past = np.concatenate([before[n + 1][at], before[n][ends - 1]])[order]
        mixed = (mixed ^ past) * np.uint32(0x85EBCA6B) + np.uint32(n + 1)
        grams[n] = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> shift
    piece = np.searchsorted(start, begins, side="right") - 1
    offset = (np.array([p[1] for p in pieces], int) - start)[piece]
    letters = np.bincount(word[at], kind[at] == 2, len(begins)).astype(np.int64)
    first = np.searchsorted(owner[order], np.arange(len(begins)))
    return Words(piece, begins + offset, ends + offset, letters, script[begins], first, grams)


def pieces_of(texts, size: int) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of pieces ``(number of the text, characters before, text)`` of about ``size`` characters in all."""
    held, room = [], size
    for n, text in enumerate(texts):
        begin = 0
        while text and begin < len(text):
            end = min(len(text), begin + size)
            if end < len(text):
                blank = max(text.rfind(" ", begin, end), text.rfind("\n", begin, end))
                end = blank + 1 if blank >= begin else end
            if held and end - begin > room:
                yield held
                held, room = [], size
            held.append((n, begin, text[begin:end]))
            room -= end - begin
            begin = end
    if held:
        yield held


# --- training -------------------------------------------------------------------------------------


@dataclass
class Model:
    languages: list[str]
    buckets: int
    scores: np.ndarray  # bucket x language
    own: np.ndarray  # script x language: comes into question
    prior: np.ndarray


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", buckets: int | None = None) -> Model | None:
    """The model of all labelled texts; None without any label.  Null texts teach nothing but that their language exists."""
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang IS NOT NULL")
    n = known.select("lang").distinct().count()
    if not n:
        return None
    if buckets is None:
        buckets = min(BUCKETS, 1 << max(0, (CELLS // n).bit_length() - 1))
        if buckets < 256:
            raise ValueError(f"{n} languages are too many")
    width = buckets + OTHER + 2

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for frame in frames:
            for language, own in frame.groupby("lang")["text"]:
                total = found.setdefault(language, np.zeros(width, np.int64))
                total[-1] += len(own)
                for pieces in pieces_of(own, PIECE):
                    words = read_words(pieces, buckets)
                    total[:buckets] += np.bincount(words.grams.ravel(), minlength=buckets)
                    total[buckets:-1] += np.bincount(words.script, words.letters, OTHER + 1).astype(np.int64)
        for language, total in found.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": language, "at": at, "n": total[at]})

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width)
        total[frame["at"]] = frame["n"]
        grams, letters = total[:buckets], total[buckets:-1]
        scores = np.log((grams + SMOOTHING) / (grams.sum() + SMOOTHING * buckets)).astype(np.float32)
        own = letters >= OWN_SCRIPT * max(letters.sum(), 1)
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "scores": [scores.tobytes()], "own": [own.tobytes()], "texts": [int(total[-1])]})

    counts = known.mapInPandas(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").applyInPandas(finish, "lang string, scores binary, own binary, texts long").collect()
    rows.sort(key=lambda r: r.lang)  # one row of at most 256 KB per language, CELLS numbers in all
    texts = np.array([r.texts for r in rows], float)
    return Model(
        [r.lang for r in rows], buckets, np.stack([np.frombuffer(r.scores, np.float32) for r in rows], 1).copy(),
        np.stack([np.frombuffer(r.own, bool) for r in rows], 1).copy(), np.log(texts / texts.sum()),
    )


# --- prediction -----------------------------------------------------------------------------------


def word_scores(words: Words, model: Model) -> np.ndarray:
    """word x language, 0 for the best language of a word."""
    if not len(words.first):
        return np.zeros((0, len(model.languages)), np.float32)
    each = model.scores[words.grams[0]]
    for grams in words.grams[1:]:
        each += model.scores[grams]
    out = np.add.reduceat(each, words.first, axis=0) / len(ORDERS)
    own = model.own[words.script]
    none = ~own.any(1) | (words.letters == 0)
    out[~own] = -np.inf
    out[none] = 0
    out -= out.max(1, keepdims=True)
    return np.where(own | none[:, None], np.maximum(out, -WORST), -OUTSIDE).astype(np.float32)


def viterbi(scores: np.ndarray, sequence: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best state of every row of ``scores`` (step x state); ``sequence`` (ascending) says whose step a row is."""
    states = np.zeros(len(scores), np.int64)
    if not len(scores):
        return states
    begin = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
    length = np.diff([*begin, len(sequence)])
    longest = np.argsort(-length, kind="stable")
    begin, length = begin[longest], length[longest]
    # only the first live[t] sequences have a step t
    live = np.append(np.searchsorted(-length, -np.arange(length[0]), side="left"), 0)
    best, moved = np.zeros(len(scores), np.int32), np.zeros(scores.shape, bool)
    now, state = np.repeat(prior[None, :], len(begin), 0), np.zeros(len(begin), np.int64)
    for t in range(length[0]):
        rows = begin[: live[t]] + t
        now = now[: live[t]]
        if t:
            best[rows] = now.argmax(1)
            jump = now.max(1, keepdims=True) - switch
            moved[rows] = now < jump
            now = np.maximum(now, jump)
        now = now + scores[rows]
        state[live[t + 1] : live[t]] = now[live[t + 1] :].argmax(1)
    for t in range(length[0] - 1, -1, -1):
        rows, here = begin[: live[t]] + t, state[: live[t]]
        states[rows] = here
        state[: live[t]] = np.where(moved[rows, here], best[rows], here)
    return states


class Reader:
    """Labels the texts of a batch."""

    def __init__(self, model: Model, spans: bool, switch: float = SWITCH):
        self.model, self.spans, self.switch = model, spans, switch

    def read(self, texts: list[str | None]) -> pd.DataFrame:
        """``lang_pred, score, n_spans`` per text, and ``spans`` if asked for."""
        n, some = len(self.model.languages), len(texts)
        letters, totals = np.zeros((some, n)), np.zeros((some, n))
        counts = np.zeros(some, np.int64)
        spans: list[list] = [[] for _ in texts]
        held: list[tuple[Words, np.ndarray, np.ndarray, np.ndarray]] = []
        pieces_so_far = 0

        def decode():
            if not held:
                return
            scores, text, piece = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            states = viterbi(scores, piece, self.model.prior, self.switch)
            n_letters = np.concatenate([h[0].letters for h in held])
            letters.ravel()[:] += np.bincount(text * n + states, n_letters, some * n)
            own = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            totals[text[own]] += np.add.reduceat(scores, own, axis=0, dtype=float)
            turn = np.concatenate([[True], (piece[1:] != piece[:-1]) | (states[1:] != states[:-1])])
            firsts = np.flatnonzero(turn)
            counts[:] += np.bincount(text[firsts], minlength=some)
            if self.spans:
                begin, end = (np.concatenate([getattr(h[0], name) for h in held]) for name in ("begin", "end"))
                lasts = np.append(firsts[1:], len(turn)) - 1
                for t, a, b, k in zip(text[firsts], begin[firsts], end[lasts], states[firsts]):
                    spans[t].append({"begin": int(a), "end": int(b), "lang": self.model.languages[k]})
            held.clear()

        size = min(PIECE, max(20_000, BLOCK // (8 * n)))
        # texts of like length together: a block takes as many steps as its longest has words
        by_length = np.argsort([len(t or "") for t in texts], kind="stable")
        for pieces in pieces_of([texts[i] for i in by_length], size):
            words = read_words(pieces, self.model.buckets)
            if len(words.first):
                held.append((words, word_scores(words, self.model), by_length[[p[0] for p in pieces]][words.piece], pieces_so_far + words.piece))
                words.grams = words.grams[:, :0].copy()
            pieces_so_far += len(pieces)
            if sum(len(h[1]) for h in held) * n > BLOCK:
                decode()
        decode()
        totals += self.model.prior
        all_letters = letters.sum(1)
        most = letters.max(1, keepdims=True)
        pred = np.where(letters == most, totals, -np.inf).argmax(1)
        sure = 1 / np.exp(np.minimum(totals - totals[np.arange(some), pred][:, None], 700)).sum(1)
        share = most[:, 0] / np.maximum(all_letters, 1)
        out = pd.DataFrame({
            "lang_pred": [self.model.languages[k] if m else UNKNOWN for k, m in zip(pred, all_letters)],
            "score": np.where(all_letters > 0, np.minimum(share * sure, 1.0), 0.0),
            "n_spans": counts,
        })
        if self.spans:
            out["spans"] = spans
        return out


UNKNOWN = "und"


def label(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), spans: bool = True, switch: float = SWITCH) -> DataFrame:
    """Columns ``keep`` with ``lang_pred, score, n_spans`` and, if asked for, ``spans`` (begin, end, lang; in characters).

    lang_pred is the language with most letters (ties: the better score), score its share of the letters times its
    probability among all languages of the model.  Null text, or one without a letter: ``und``, 0, no span; so is every
    text if nothing was learned.  A letter whose script none of the languages is written in says nothing; a text of
    such letters is of the most frequent language.  Marks belong to the word around them.  Texts of more than ``PIECE`` characters
    are cut at white space, or within a word where there is none, and spans end there.  Empty table: no rows.
    """
    kept = [docs.schema[c] for c in keep]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "lang_pred string, score double, n_spans long"])
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    if spans:
        schema += ", spans array<struct<begin: int, end: int, lang: string>>"
    if model is None:
        found = rows.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_spans"))
        return found.withColumn("spans", F.array().cast("array<struct<begin: int, end: int, lang: string>>")) if spans else found
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value, spans, switch)
        for frame in frames:
            found = reader.read([None if pd.isna(t) else t for t in frame["_text"]])
            yield pd.concat([frame[list(keep)].reset_index(drop=True), found], axis=1)

    return rows.mapInPandas(run, schema)


def held_out(doc_id: Column) -> Column:
    """The quarter of documents that nothing is learned from; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = label(docs.select("doc_id", "text"), model, spans=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")
