"""SentencePiece encoding with seeded merge-dropout, and decoding.

Method.  A word's characters are merged along an agenda, best score first, then leftmost.  A
candidate merge is skipped for good when the keyed hash of (seed, doc_id, place
of the word in the text, where its left part starts, where they meet, where its right part
ends) falls below ``dropout``.  The same seed gives the same pieces everywhere, in any task
and after any retry; every occurrence of a word, in one document or another, is cut on its
own.  Characters outside the vocabulary become byte pieces.  Every cut decodes to the same
text.

No piece goes on over the space mark after another character, so a text is cut before each
run of spaces.  The agendas of some thousand words are worked off side by side: each round
takes the best candidate of every word that has one, and looks at the two pairs that the
merge makes.  A candidate that would be skipped does not get on the agenda, since whether it
is depends on its place alone.  A word beyond ``LONG`` characters has a heap of its own, as
it would take a round per merge.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # stands for a space inside pieces
LONG = 64  # characters of a word
TEXTS = 64  # encoded at once
CHUNK = 1 << 17  # characters whose agendas are worked off side by side
_MIX = 0x9E3779B97F4A7C15
_LEFT, _MEET = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_FULL = (1 << 64) - 1
_NONE = np.int64((1 << 63) - 1)  # no candidate; others are rank, start and piece in 19, 20 and 24 bits


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(_MIX)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


class Pairs:
    """Which symbol a pair of symbols merges to: a table with open addresses."""

    def __init__(self, found: dict[int, int]):
        keys, to = np.array(list(found), dtype=np.int64), np.array(list(found.values()), dtype=np.int64)
        bits = len(keys).bit_length() + 3
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.to = np.full(1 << bits, -1), np.full(1 << bits, -1)
        at, left = self._at(keys), np.arange(len(keys))
        while len(left):
            free = left[self.key[at[left]] < 0]
            self.key[at[free]] = keys[free]
            left = left[self.key[at[left]] != keys[left]]
            at[left] = at[left] + 1 & self.mask
        self.to[at] = to

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(_MIX) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The symbols, -1 where a pair does not merge."""
        at = self._at(keys)
        own, to = self.key[at], self.to[at]
        other = np.flatnonzero(own != keys)
        to[other] = -1
        other = other[own[other] >= 0]
        while len(other):
            at[other] = at[other] + 1 & self.mask
            own = self.key[at[other]]
            same = own == keys[other]
            to[other[same]] = self.to[at[other[same]]]
            other = other[~same & (own >= 0)]
        return to


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.score, self.bytes_of, self.byte_id = {}, {}, [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        # symbols are the pieces, then characters that only occur inside pieces, and last all others
        self.pieces = model.get_piece_size()
        self.symbols = dict(self.ids)
        for c in sorted({c for piece in self.ids for c in piece} - set(self.ids)):
            self.symbols[c] = self.pieces + len(self.symbols) - len(self.ids)
        self.other = self.pieces + len(self.symbols) - len(self.ids)
        self.of_char = np.full(0x110000, self.other, dtype=np.int64)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        # a mark in the text itself is no space: it goes the way of unknown characters
        self.of_char[ord(" ")], self.of_char[ord(MARK)] = self.of_char[ord(MARK)], self.of_char[0]
        self.rank = np.zeros(self.pieces, dtype=np.int64)
        scores = -np.array(list(self.score.values()))
        self.rank[list(self.ids.values())] = np.unique(scores, return_inverse=True)[1]
        self.pairs = Pairs(
            {
                self.symbols[piece[:k]] * (self.other + 1) + self.symbols[piece[k:]]: i
                for piece, i in self.ids.items() for k in range(1, len(piece))
                if piece[:k] in self.symbols and piece[k:] in self.symbols
            }
        )

    def _word(self, word: str, key: int, limit: int) -> tuple[list[int], list[int]]:
        """Starts and symbols of one part of a text, its spaces still spaces."""
        text = word.replace(MARK, "\0").replace(" ", MARK)
        n = len(text)
        score, push, pop = self.score.get, heapq.heappush, heapq.heappop
        end = list(range(1, n + 1))  # of the symbol that starts here; 0 once merged away
        before = list(range(-1, n - 1))
        agenda: list[tuple] = []

        def pair(left: int, right: int, stop: int) -> None:
            s = score(text[left:stop])
            if s is None:
                return
            h = (key ^ left * _LEFT + right * _MEET + stop & _FULL) * _MIX & _FULL
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & _FULL
            if h ^ h >> 32 >= limit:
                push(agenda, (-s, left, right, stop))

        for i in range(n - 1):
            pair(i, i + 1, i + 2)
        while agenda:
            _, left, right, stop = pop(agenda)
            if end[left] != right or end[right] != stop:
                continue  # one of its parts has changed
            end[left], end[right] = stop, 0
            if stop < n:
                before[stop] = left
                pair(left, stop, end[stop])
            if before[left] >= 0:
                pair(before[left], left, stop)
        starts = [i for i in range(n) if end[i]]
        return starts, [self.symbols.get(text[i : end[i]], self.other) for i in starts]

    def _candidates(self, left, right, start, meet, stop, key, limit) -> np.ndarray:
        """Of pairs of symbols: their rank, start and piece in one number, ``_NONE`` if they do not merge or are skipped."""
        to = self.pairs.find(left.astype(np.int64) * (self.other + 1) + right)
        found = np.flatnonzero(to >= 0)
        if limit:
            a, b, c = (x[found].astype(np.uint64) for x in (start, meet, stop))
            h = _mixed(key[found] ^ a * np.uint64(_LEFT) + b * np.uint64(_MEET) + c)
            found = found[h >= np.uint64(limit)]
        out = np.full(len(to), _NONE)
        out[found] = (self.rank[to[found]] << 44) | (start[found].astype(np.int64) << 24) | to[found]
        return out

    def _words(self, symbol: np.ndarray, first: np.ndarray, key: np.ndarray, limit: int) -> np.ndarray:
        """Per character the symbol that starts there in the end, or -1; ``first``: where words begin."""
        out = np.full(len(symbol), -1)
        count = np.diff(np.append(first, len(symbol)))
        at = np.arange(len(symbol), dtype=np.int32)
        stop = at + np.int32(1)
        symbol, candidate = symbol.astype(np.int32), np.full(len(symbol), _NONE)
        i = np.ones(len(symbol), dtype=bool)
        i[np.cumsum(count) - 1] = False
        i = np.flatnonzero(i)
        own, ptr = np.repeat(np.arange(len(first)), count - 1), first
        while True:
            x, y, z, base = at[i] - first[own], stop[i] - first[own], stop[i + 1] - first[own], key[own]
            candidate[i] = self._candidates(symbol[i], symbol[i + 1], x, y, z, base, limit)
            best = np.minimum.reduceat(candidate, ptr)
            live = best != _NONE
            done = np.flatnonzero(np.repeat(~live, count))
            out[at[done]] = symbol[done]
            if not live.any():
                return out
            i = np.flatnonzero(candidate == np.repeat(np.where(live, best, -1), count))  # one per live word
            symbol[i], stop[i] = best[live] & 0xFFFFFF, stop[i + 1]
            keep = np.ones(len(symbol), dtype=bool)
            keep[i + 1] = keep[done] = False
            place = np.cumsum(keep)[i] - 1
            keep = np.flatnonzero(keep)
            symbol, at, stop, candidate = (x.take(keep) for x in (symbol, at, stop, candidate))
            i, count, key, first = place, count[live] - 1, key[live], first[live]
            ends = np.cumsum(count)
            ptr = ends - count
            candidate[i] = _NONE
            after, before = np.flatnonzero(i + 1 < ends), np.flatnonzero(i > ptr)
            own = np.concatenate([after, before])
            i = np.concatenate([i[after], i[before] - 1])

    def encode(self, text: str, dropout: float = 0.0, seed: int = 0, doc: int = 0) -> list[int]:
        return self.encode_all([text], dropout, seed, [doc])[0]

    def encode_all(self, texts: list[str], dropout: float, seed: int, docs: list[int]) -> list[list[int]]:
        whole = "".join([" " + t for t in texts if t])
        if not whole:
            return [[] for _ in texts]
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        lengths = np.array([len(t) + 1 if t else 0 for t in texts])
        ends = np.cumsum(lengths)
        space, line = chars == ord(" "), chars == ord("\n")
        new = line.copy()
        new[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        new[(ends - lengths)[lengths > 0]] = True
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(chars)))
        before = np.searchsorted(first, ends - lengths)
        parts = np.searchsorted(first, ends) - before
        limit = min(int(dropout * (1 << 64)), _FULL)
        starts = [xxhash.xxh64_intdigest(int(d).to_bytes(8, "little", signed=True), seed & _FULL) for d in docs]
        places = np.arange(1, len(first) + 1) - np.repeat(before, parts)
        keys = _mixed(np.repeat(np.array(starts, dtype=np.uint64), parts) + places.view(np.uint64) * np.uint64(_MIX))
        symbol = self.of_char[chars]
        out = np.full(len(chars), -1)
        long = sizes > LONG
        for i in np.flatnonzero(long).tolist():
            at = int(first[i])
            begins, found = self._word(whole[at : at + int(sizes[i])], int(keys[i]), limit)
            out[at + np.array(begins)] = found
        short, done = np.flatnonzero(~long), 0
        until = np.cumsum(sizes[short])
        while done < len(short):
            to = int(np.searchsorted(until, (until[done - 1] if done else 0) + CHUNK, "right"))
            some = short[done : max(to, done + 1)]
            done += len(some)
            n = sizes[some]
            own = np.cumsum(n) - n
            at = np.arange(int(n.sum())) + np.repeat(first[some] - own, n)
            out[at] = self._words(symbol[at], own, keys[some], limit)
        at = np.flatnonzero(out >= 0)
        ids, n = out[at], np.ones(len(at), dtype=np.int64)
        unknown = np.flatnonzero(ids >= self.pieces)
        points, which = np.unique(chars[at[unknown]], return_inverse=True)
        spelt = [[self.byte_id[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in points.tolist()]
        n[unknown] = np.array([len(x) for x in spelt], dtype=np.int64)[which]
        stops = np.cumsum(n)
        ids = np.repeat(ids, n)
        for j in range(4):
            of = np.array([x[j] if j < len(x) else -1 for x in spelt], dtype=np.int64)[which]
            ids[(stops[unknown] - n[unknown] + j)[of >= 0]] = of[of >= 0]
        bounds = np.append(0, stops)[np.searchsorted(at, np.append(0, ends))].tolist()
        ids = ids.tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


@cache
def _codec(path: str) -> Codec:
    return Codec(path)


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    own, text_ = F.col(doc_id).cast("long"), F.col(text).cast("string")
    key = F.coalesce(own, F.xxhash64(text_))
    return docs.select(own.alias("doc_id"), text_.alias("text"), key.alias("key"))


def _encoded(codec: Codec, frame: pd.DataFrame, dropout: float, seed: int) -> Iterator[list[int]]:
    for at in range(0, len(frame), TEXTS):
        some = frame.iloc[at : at + TEXTS]
        yield from codec.encode_all([t or "" for t in some["text"]], dropout, seed, some["key"].tolist())


def encoded(
    docs: DataFrame,
    model: str,
    dropout: float = 0.1,
    seed: int = 0,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """``doc_id, ids, text``: piece ids of every text, and the text decoded from them.

    Null text: null ids and null text.  Empty text: no ids, empty text.  Null doc_id: a
    hash of the text takes its place in the key.  Repeated rows give repeated results.  Empty table: no rows.  Other columns are not
    read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(model)
        for frame in frames:
            for at in range(0, len(frame), 500):  # ids of few documents at a time
                some = frame.iloc[at : at + 500]
                ids = [
                    None if t is None else i for t, i in zip(some["text"], _encoded(codec, some, dropout, seed))
                ]
                yield pd.DataFrame(
                    {
                        "doc_id": some["doc_id"].astype("Int64").to_numpy(),
                        "ids": [None if i is None else np.array(i, dtype=np.int32) for i in ids],
                        "text": [None if i is None else codec.decode(i) for i in ids],
                    }
                )

    rows = _rows(docs, text, doc_id)
    return rows.mapInPandas(run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, lossless``: what ``encoded`` gives, short."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(model)
        for frame in frames:
            rows = []
            for t, ids in zip(frame["text"], _encoded(codec, frame, dropout, seed)):
                crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
                rows.append((len(ids), crc, codec.decode(ids) == (t or "")))
            out = pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "lossless"])
            yield out.assign(doc_id=frame["doc_id"].astype("Int64"))[["doc_id", "n_pieces", "ids_crc32", "lossless"]]

    rows = _rows(docs, "text", "doc_id")
    return rows.mapInPandas(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
