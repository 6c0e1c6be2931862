"""Quality rules for documents: plain counts, and bands of perplexity per language.

Method.  Modified Kneser-Ney models of three words, one per language and half of the texts.
A word is named by a 64-bit hash seeded by its language, so that languages share no n-gram;
a word of its own stands for the two before a text's first one.  The least hash of a text's
n-grams deals it to one of two halves, and it is scored by the model of the other half: no text
vouches for itself; copies lie in one half, near copies with a similarity of s in n-grams
with a probability of (1 + s) / 2, and so do not vouch for each other either.  Of both halves
side by side the n-grams are counted, and from these counts come the continuation counts,
discounts and weights of every order, and the probability that the other half's model gives to
every word; what a model has not seen falls back on shorter n-grams, and an unseen word on the
weight that the lowest order keeps for one.  Discounts are of all languages of a half together.
Per language, documents whose mean log perplexity lies more than ``low`` robust deviations
below or ``high`` above the median of that language are rejected; median and deviation are taken over
all documents of the language that pass the counts.

Scale.  Words are kept once, as numbers within blocks of texts.  N-grams are dealt by their
middle word, so that a bucket has all it takes for the counts of three and of two words; a common word has
several buckets, dealt by the first word, whose counts of two are added up.  One slice of the
buckets is shuffled at a time, once to be counted and once to be scored, and its shuffle files are given up
before the next.  Counts of single words go back to the buckets that have them.  What reaches
the driver are counts of counts and the common words, some for each bucket.  A single pair of
words is not split: its n-grams lie in one bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, shared_folder, small

HALVES = (0, 1)
LOW, HIGH = 15.0, 5.0  # robust deviations below and above the median; near copies dealt apart lie about 13 below
LEAST_SPREAD = 0.02  # of log perplexity; languages of equal texts keep a band
UNITS = 1e9  # parts of a log probability that are summed, as whole numbers: order does not matter
SYMBOLS = b"#*$%&|<>"
SLICES, PARTS = 16, 6  # n-grams are shuffled a slice at a time, counts of words a part at a time
PIECE_BYTES = 3 << 22  # of texts that are cut into words together


def discounts(of: list[int]) -> list[float]:
    """What modified Kneser-Ney takes from counts of 0, 1, 2 and more; ``of``: how many
    n-grams have the counts 1 to 4."""
    y = of[0] / max(of[0] + 2 * of[1], 1)
    return [0.0] + [min(max(i - (i + 1) * y * of[i] / max(of[i - 1], 1), 0.1 * i), 0.9 * i) for i in (1, 2, 3)]


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: exactly the blanks space and \t to \r
    blanks = len(raw) - sum(map(len, words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    repeated = 0
    if len(ids) >= 4:
        pairs = np.unique(ids[:-2] * len(numbers) + ids[1:-1], return_inverse=True)[1]
        _, at, n = np.unique(pairs * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
        often = n[at] > 1
        covered = np.zeros(len(ids), dtype=bool)
        for i in range(3):
            covered[i : len(ids) - 2 + i] |= often
        repeated = int(covered.sum())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def word_hashes(text: str | None, seed: int = 0) -> np.ndarray:
    """The words of a text as 64-bit hashes after two of the edge; words as in ``base_counts``.
    Empty where there is no word."""
    seed &= (1 << 64) - 1
    edge = xxhash.xxh64_intdigest(b"", seed)
    known: dict[bytes, int] = {}
    out = [edge, edge]
    for w in (text or "").encode("utf-8", "surrogatepass").split():
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w, seed)
        out.append(h)
    return np.array(out if len(out) > 2 else [], dtype=np.uint64).view(np.int64)


def half_of(words: np.ndarray) -> int:
    """0 or 1 by the least hash of the n-grams of ``word_hashes``."""
    if not len(words):
        return 0
    with np.errstate(over="ignore"):
        w = words.view(np.uint64)
        return int(_mixed_grams(w[:-2], w[1:-1], w[2:]).min() & np.uint64(1))


def word_grams(words: DataFrame) -> DataFrame:
    """``row, half, lang, a, b, c`` per word c of ``row, half, lang, words``; a and b are the two before."""
    n = F.greatest(F.size("words") - 2, F.lit(0))
    zipped = F.arrays_zip(*[F.slice("words", F.lit(i), n).alias(c) for i, c in enumerate("abc", 1)])
    return words.select("row", "half", "lang", F.inline(zipped).alias("a", "b", "c"))


def _cuts(counts: DataFrame) -> list[list[float]]:
    """Discounts of both halves."""
    of = [F.count_if(F.col(f"n{h}") == i).alias(f"of{h}{i}") for h in HALVES for i in (1, 2, 3, 4)]
    found = counts.agg(*of).first()
    return [discounts([found[f"of{h}{i}"] for i in (1, 2, 3, 4)]) for h in HALVES]


def _contexts(counts: DataFrame, cuts: list[list[float]], *by: str) -> DataFrame:
    """Per context and half its total, what the discounts take from it, and how many n-grams it has."""
    found = []
    for h in HALVES:
        n = F.col(f"n{h}")
        of = [F.count_if(n == 1), F.count_if(n == 2), F.count_if(n >= 3)]
        taken = sum((c * cut for c, cut in zip(of, cuts[h][1:])), F.lit(0.0))
        found += [F.sum(n).alias(f"total{h}"), taken.alias(f"taken{h}"), F.count_if(n > 0).alias(f"kinds{h}")]
    return counts.groupBy(*by).agg(*found)


def _interpolated(h: int, cuts: list[list[float]], lower: Column) -> Column:
    """``p`` of half h; a context that the half has not seen leaves it to the lower order."""
    n, total = F.col(f"n{h}"), F.col(f"total{h}")
    own = n - F.element_at(F.array(*map(F.lit, cuts[h])), F.least(n, F.lit(3)).cast("int") + 1)
    return F.when(total > 0, (own + F.col(f"taken{h}") * lower) / total).otherwise(lower).alias(f"p{h}")


def word_model(grams: DataFrame) -> DataFrame:
    """``a, b, c, p0, p1``: the interpolated modified Kneser-Ney probability of every n-gram of
    either half, by the model of half 0 and by that of half 1.  As one table; ``row_losses`` takes
    the same probabilities a slice at a time."""
    kinds = [F.count_if(F.col(f"n{h}") > 0).alias(f"n{h}") for h in HALVES]  # different words before an n-gram
    three = saved(grams.groupBy("lang", "a", "b", "c").agg(*[F.count_if(F.col("half") == h).alias(f"n{h}") for h in HALVES]), "three")
    two = saved(three.groupBy("lang", "b", "c").agg(*kinds), "two")
    one = saved(two.groupBy("lang", "c").agg(*kinds), "one")
    cuts = _cuts(one)
    whole = small(saved(_contexts(one, cuts, "lang"), "languages"))
    # one part of the lowest weight is for words that the half has not seen
    low = one.join(whole, "lang").select(
        "c", *[_interpolated(h, cuts, 1 / (F.col(f"kinds{h}") + 1)).alias(f"low{h}") for h in HALVES]
    )
    cuts = _cuts(two)
    middle = two.join(_contexts(two, cuts, "b"), "b").join(low, "c").select(
        "b", "c", *[_interpolated(h, cuts, F.col(f"low{h}")).alias(f"low{h}") for h in HALVES]
    )
    cuts = _cuts(three)
    return three.join(_contexts(three, cuts, "a", "b"), ["a", "b"]).join(middle, ["b", "c"]).select(
        "a", "b", "c", *[_interpolated(h, cuts, F.col(f"low{h}")) for h in HALVES]
    )


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
))
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashes_at(raw: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of many pieces of ``raw`` side by side: bytes ``start`` to ``start + size``, each with its seed."""
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(raw) + 1,), "<u4", padded, strides=(1,))
    h = seed + P5 + size.astype(np.uint64)
    for i in range(3):
        at = np.flatnonzero(size >= 8 * i + 8)
        if not len(at):
            break
        k = _turned(eight[start[at] + 8 * i] * P2, 31) * P1
        h[at] = _turned(h[at] ^ k, 27) * P1 + P4
    done = size & ~7
    at = np.flatnonzero(size & 4)
    h[at] = _turned(h[at] ^ (four[start[at] + done[at]].astype(np.uint64) * P1), 23) * P2 + P3
    done = size & ~3
    for i in range(3):
        at = np.flatnonzero((size & 3) > i)
        h[at] = _turned(h[at] ^ (padded[start[at] + done[at] + i].astype(np.uint64) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32):  # few words are so long
        h[i] = xxhash.xxh64_intdigest(raw[start[i] : start[i] + size[i]].tobytes(), int(seed[i]))
    return h


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # every bit depends on all
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit names of pairs."""
    return _mixed(a * np.uint64(0x9E3779B97F4A7C15) ^ _turned(b, 29))


def _mixed_grams(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _mixed((a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(0xBF58476D1CE4E5B9) ^ c)


class Block(NamedTuple):
    """Some texts: ``words``, their different words, ``at``, the places therein of their words one after the
    other, two of the edge before each text, and per text how many words it has, its row, language and half."""

    words: np.ndarray
    at: np.ndarray
    sizes: np.ndarray
    row: np.ndarray
    lang: np.ndarray
    half: np.ndarray


BLOCK = "words binary, at binary, sizes binary, row binary, lang binary, half binary"


def _firsts(sizes: np.ndarray) -> np.ndarray:
    """Where each text's own words begin, after two of the edge."""
    return np.cumsum(sizes + 2) - sizes


def _inner(sizes: np.ndarray) -> np.ndarray:
    """Which words are the texts' own."""
    inner = np.ones(int(sizes.sum()) + 2 * len(sizes), dtype=bool)
    inner[_firsts(sizes) - 1] = inner[_firsts(sizes) - 2] = False
    return inner


def _block(words: np.ndarray, sizes: np.ndarray, row: np.ndarray, lang: np.ndarray, half: np.ndarray | None = None) -> Block:
    """Of hashes of words, with those of the edge.  Without ``half`` it is taken as in ``half_of``."""
    if half is None:
        own = np.flatnonzero(_inner(sizes))
        half = np.minimum.reduceat(_mixed_grams(words[own - 2], words[own - 1], words[own]), np.cumsum(sizes) - sizes) & np.uint64(1)
    kinds, at, n = np.unique(words, return_inverse=True, return_counts=True)
    place = np.empty(len(kinds), dtype=np.int64)
    # frequent words have small numbers, rare ones follow in the order of their hashes
    place[order := np.argsort(np.where(n < 4, 0, -n), kind="stable")] = np.arange(len(kinds))
    return Block(kinds[order], place[at], sizes, row, lang, half.astype(np.uint8))


def blocks_of_words(batch: pa.RecordBatch) -> Iterator[Block]:
    """Of rows ``row, half, lang, words``."""
    frame = batch.to_pandas()
    frame = frame[[w is not None and len(w) > 2 for w in frame["words"]]]
    if len(frame):
        sizes = frame["words"].map(len).to_numpy() - 2
        words = np.concatenate([np.asarray(w) for w in frame["words"]]).astype(np.int64).view(np.uint64)
        yield _block(words, sizes, *(frame[c].to_numpy(np.int64) for c in ("row", "lang", "half")))


def blocks_of_texts(batch: pa.RecordBatch) -> Iterator[Block]:
    """Of rows ``row, lang, text``; words and halves as in ``word_hashes`` and ``half_of``."""
    text = batch.column("text").cast(pa.large_string())
    row, lang = (batch.column(c).to_numpy() for c in ("row", "lang"))
    if not len(text) or text.buffers()[2] is None:
        return
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE_BYTES, "right")) - 1)
        raw, begin = data[ends[at] : ends[to]], ends[at:to] - ends[at]
        full = ~BLANK[raw]
        cut = np.zeros(len(raw) + 1, dtype=bool)  # a text begins or the last one ended
        cut[begin] = cut[-1] = True
        start = np.flatnonzero(full & (cut[:-1] | np.concatenate([[True], ~full[:-1]])))
        end = np.flatnonzero(full & (cut[1:] | np.concatenate([~full[1:], [True]]))) + 1
        if len(start):
            doc = np.searchsorted(begin, start, "right") - 1
            n = np.bincount(doc, minlength=to - at)
            some = np.flatnonzero(n)
            seed = lang[at:to].view(np.uint64)
            words = np.empty(len(start) + 2 * len(some), dtype=np.uint64)
            words[_inner(n[some])] = hashes_at(raw, start, end - start, seed[doc])
            first = _firsts(n[some])
            edge = np.array([xxhash.xxh64_intdigest(b"", int(s)) for s in seed[some]], dtype=np.uint64)
            words[first - 1] = words[first - 2] = edge
            yield _block(words, n[some], row[at:to][some], lang[at:to][some])
        at = to


def stored(source: DataFrame, blocks_of) -> DataFrame:
    """The blocks of ``source``, once written: less than three bytes a word on ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks_of(batch):
                row = (
                    _squeezed(np.diff(b.words, prepend=np.uint64(0))), _squeezed(b.at.astype(np.uint64)), _packed(b.sizes),
                    b.row.tobytes(), b.lang.tobytes(), b.half.tobytes(),
                )
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=list(Block._fields))

    return saved(source.mapInArrow(run, BLOCK), "blocks")


def _squeezed(x: np.ndarray) -> bytes:
    """64-bit numbers: how many, then their lowest bytes, the next ones and so on, each packed by zstd."""
    out = [len(x).to_bytes(8, "little")]
    for i in range(8):
        z = pa.compress((x >> np.uint64(8 * i)).astype(np.uint8).tobytes(), "zstd", asbytes=True)
        out += [len(z).to_bytes(8, "little"), z]
    return b"".join(out)


def _spread(x: bytes) -> np.ndarray:
    n, begin = int.from_bytes(x[:8], "little"), 8
    found = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        end = begin + 8 + int.from_bytes(x[begin : begin + 8], "little")
        part = np.frombuffer(pa.decompress(x[begin + 8 : end], n, "zstd", asbytes=True), np.uint8)
        if part.any():
            found |= part.astype(np.uint64) << np.uint64(8 * i)
        begin = end
    return found


def _read(words: bytes, at: bytes, sizes: bytes, row: bytes, lang: bytes, half: bytes) -> Block:
    kinds = np.cumsum(_spread(words), dtype=np.uint64)
    return Block(
        kinds, _spread(at).astype(np.int32), _unpacked(sizes).astype(np.int64), np.frombuffer(row, np.int64),
        np.frombuffer(lang, np.int64), np.frombuffer(half, np.uint8),
    )


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0, as bytes; the first byte says how many each takes."""
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=f"<u{x[0]}", offset=1)


PARCEL = "bucket int, b binary, nb binary, words binary, a binary, c binary, doc binary, row binary, lang binary, half binary"


def _numbered(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different values of x, below ``most``, and the place of each x therein."""
    if 16 * len(x) < most:
        return np.unique(x, return_inverse=True)
    there = np.zeros(most, dtype=bool)
    there[x] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[x]


class Common(NamedTuple):
    """Common words, ascending; the first bucket of each, and how many it has."""

    words: np.ndarray
    bucket: np.ndarray
    buckets: np.ndarray


def common_words(blocks: DataFrame, buckets: int) -> Common:
    """Words that would fill half a bucket alone: their n-grams are dealt by the first word, too.
    A few hundred for each bucket of a slice at most; they are estimated, as any choice gives the same losses."""
    share = 0.5 / (SLICES * buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = _read(*(batch.column(c)[k].as_py() for c in Block._fields))
                n = np.bincount(block.at, minlength=len(block.words))
                often = np.flatnonzero(n >= 0.5 * share * len(block.at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.words[often].view(np.int64)), pa.array(n[often]), pa.array(np.where(np.arange(len(often)), 0, len(block.at)))],
                    names=["word", "n", "total"],
                )

    counts = saved(blocks.mapInArrow(run, "word long, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "often")
    total = counts.agg(F.sum("total")).first()[0] or 0
    found = counts.where(F.col("n") >= share * total).toPandas()
    words = found["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    n = np.ceil(found["n"].to_numpy(np.float64)[order] / max(share * total, 1)).astype(np.int64)
    return Common(words[order], SLICES * buckets + np.cumsum(n) - n, n)


def parcels(blocks: DataFrame, part: int, buckets: int, common: Common) -> DataFrame:
    """The n-grams of a slice, dealt by their middle word: one row per bucket and block.

    A bucket is a range of mixed hashes of the middle word, a slice is ``buckets`` of them in turn.
    A common word has buckets of its own, dealt by the first word, and the slices take turns.
    """
    low, of = part * buckets, SLICES * buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = _read(*(batch.column(c)[k].as_py() for c in Block._fields))
                mixed = _mixed(block.words)
                bucket = ((mixed >> np.uint64(32)) * np.uint64(of)) >> np.uint64(32)
                bucket = bucket.astype(np.int64)
                here = (bucket >= low) & (bucket < low + buckets)
                kind = np.searchsorted(common.words, block.words)
                kind[kind == len(common.words)] = 0
                often = common.words[kind] == block.words if len(common.words) else np.zeros(len(kind), dtype=bool)
                own = np.flatnonzero(_inner(block.sizes)[1:] & (here | often)[block.at[:-1]]) + 1
                b = block.at[own - 1]
                dealt, many = bucket[b], np.flatnonzero(often[b])
                if len(many):
                    k = kind[b[many]]
                    first = mixed[block.at[own[many] - 2]] >> np.uint64(8)
                    dealt[many] = common.bucket[k] + (first % common.buckets[k].astype(np.uint64)).astype(np.int64)
                    mine = dealt < of
                    mine[many] = (dealt[many] - of) % SLICES == part
                    own, dealt = own[mine], dealt[mine]
                if not len(own):
                    continue
                order = np.lexsort((block.at[own - 1], dealt))
                own, dealt = own[order], dealt[order]
                a, b, c = (block.at[own - i] for i in (2, 1, 0))
                doc = np.searchsorted(_firsts(block.sizes), own, "right") - 1
                bounds = np.flatnonzero(np.diff(dealt, prepend=-1))
                out = []
                for i, j in zip(bounds, [*bounds[1:], len(own)]):
                    begin = np.flatnonzero(np.diff(b[i:j].astype(np.int64), prepend=-1))
                    words, place = _numbered(np.concatenate([a[i:j], c[i:j]]), len(mixed))
                    docs, at = _numbered(doc[i:j], len(block.sizes))
                    out.append((
                        int(dealt[i]), block.words[b[i:j][begin]].tobytes(), _packed(np.diff(begin, append=j - i)),
                        block.words[words].tobytes(), _packed(place[: j - i]), _packed(place[j - i :]), _packed(at),
                        block.row[docs].tobytes(), block.lang[docs].tobytes(), block.half[docs].tobytes(),
                    ))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.binary() if f else pa.int32()) for f, x in enumerate(zip(*out))],
                    names=[c.split()[0] for c in PARCEL.split(", ")],
                )

    return blocks.mapInArrow(run, PARCEL)


class Grams(NamedTuple):
    """N-grams a, b, c; ``doc`` is the place of an n-gram's text in row, lang and half."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    doc: np.ndarray
    row: np.ndarray
    lang: np.ndarray
    half: np.ndarray


def _opened(frame: pd.DataFrame) -> Grams:
    """The n-grams of the parcels of a bucket."""
    parts, docs = [], 0
    for p in frame.itertuples():
        words = np.frombuffer(p.words, np.uint64)
        row, lang, half = np.frombuffer(p.row, np.int64), np.frombuffer(p.lang, np.int64), np.frombuffer(p.half, np.uint8)
        b = np.repeat(np.frombuffer(p.b, np.uint64), _unpacked(p.nb).astype(np.int64))
        parts.append((words[_unpacked(p.a)], b, words[_unpacked(p.c)], _unpacked(p.doc).astype(np.int64) + docs, row, lang, half))
        docs += len(row)
    return Grams(*map(np.concatenate, zip(*parts)))


class Groups:
    """Equal names: ``first`` has one place of each, ``of`` the group of every place."""

    def __init__(self, names: np.ndarray):
        order = np.argsort(names)
        new = np.diff(names[order], prepend=~names[order[:1]]) != 0
        self.order, self.begin = order, np.flatnonzero(new)
        self.first = order[self.begin]
        self.of = np.empty(len(names), dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.order], self.begin)


def _counted(g: Grams) -> tuple[Groups, list[np.ndarray], Groups, list[np.ndarray]]:
    """Different n-grams of three words, their counts in both halves; of two, and how many words stand before them."""
    pair = _named(g.b, g.c)
    three = Groups(_named(g.a, pair))
    half = g.half[g.doc]
    n3 = [three.sums((half == h).astype(np.int64)) for h in HALVES]
    two = Groups(pair[three.first])
    return three, n3, two, [two.sums((n > 0).astype(np.int64)) for n in n3]


def _context(groups: Groups, counts: list[np.ndarray], cuts: list[list[float]], h: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_contexts``: total and what is taken, of half h, per group."""
    return groups.sums(counts[h]), groups.sums(np.array(cuts[h])[np.minimum(counts[h], 3)])


def _share(n, cuts, total, taken, lower):
    """As ``_interpolated``, of one half."""
    own = n - np.array(cuts)[np.minimum(n, 3)]
    return np.where(total > 0, (own + taken * lower) / np.maximum(total, 1), lower)


TALLY = "bucket int, middle long, of3 array<long>, of2 array<long>, c array<long>, lang array<long>, k0 array<long>, k1 array<long>"


def tally(parcel: DataFrame, rare: int) -> DataFrame:
    """Per bucket: how many n-grams of three and of two words have the counts 1 to 4 in half 0 and in half 1; its
    last words, their languages, and how many different words of the bucket stand before each in either half.
    Buckets from ``rare`` on are of one common word, ``middle``: there what counts is the words before the two."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        g = _opened(frame)
        three, n3, two, n2 = _counted(g)
        last = three.first[two.first]
        one = Groups(g.c[last])
        of = [[int((n == i).sum()) for n in ns for i in (1, 2, 3, 4)] for ns in (n3, n2)]
        c = last[one.first]
        bucket, middle = frame["bucket"].iloc[0], None
        if bucket >= rare:
            of[1], middle = [0] * 8, int(g.b[:1].view(np.int64)[0])
        k = [one.sums(n if bucket >= rare else (n > 0).astype(np.int64)) for n in n2]
        return pd.DataFrame({
            "bucket": [bucket], "middle": pd.array([middle], dtype="Int64"), "of3": [of[0]], "of2": [of[1]],
            "c": [g.c[c].view(np.int64)], "lang": [g.lang[g.doc[c]]], "k0": [k[0]], "k1": [k[1]],
        })

    return parcel.groupBy("bucket").applyInPandas(run, TALLY)


def scored(parcel: DataFrame, answers: DataFrame, cuts: list[list[list[float]]]) -> DataFrame:
    """``row, loss, n`` per bucket and row: the losses of its words by the other half, and how many they are.

    ``answers``: per bucket, the counts of its last words, and of its languages what the lowest order takes.
    """

    def run(frame: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"row": [], "loss": [], "n": []}).astype("int64")
        g = _opened(frame)
        three, n3, two, n2 = _counted(g)
        t = three.first  # one place of each n-gram of three words
        y = t[two.first]  # and of each of two
        known = {v["lang"]: v for v in answer["langs"].iloc[0]}
        langs, voice = np.unique(g.lang[g.doc[y]], return_inverse=True)
        # without a word in both halves there is no list
        words, *ones = (np.array([] if (x := answer[c].iloc[0]) is None else x, dtype=np.int64) for c in ("c", "n0", "n1"))
        order = np.argsort(words)
        last = g.c[y].view(np.int64)
        at = np.searchsorted(words[order], last)
        hit = at < len(words)
        hit[hit] = words[order[at[hit]]] == last[hit]
        contexts, middles = Groups(_named(g.a[t], g.b[t])), Groups(g.b[y])
        split = answer["pairs"].iloc[0] is not None  # a bucket of a common word: counts of two are of all its buckets
        if split:
            pairs, *twos = (np.array(answer[c].iloc[0], dtype=np.int64) for c in ("pairs", "m0", "m1"))
            in_order = np.argsort(pairs)
            n2 = [m[in_order[np.searchsorted(pairs[in_order], last)]] for m in twos]
        half = g.half[g.doc]
        loss = np.zeros(len(g.c))
        for h in HALVES:
            n1 = np.zeros(len(y), dtype=np.int64)
            n1[hit] = ones[h][order[at[hit]]]
            total, taken, kinds = (np.array([known[v][f"{k}{h}"] for v in langs.tolist()])[voice] for k in ("total", "taken", "kinds"))
            p = _share(n1, cuts[0][h], total, taken, 1 / (kinds + 1))
            if split:
                total, taken = (np.full(len(y), float(answer[f"{k}{h}"].iloc[0])) for k in ("total", "taken"))
            else:
                total, taken = (x[middles.of] for x in _context(middles, n2, cuts[1], h))
            p = _share(n2[h], cuts[1][h], total, taken, p)
            total, taken = _context(contexts, n3, cuts[2], h)
            p = _share(n3[h], cuts[2][h], total[contexts.of], taken[contexts.of], p[two.of])
            mine = half != h
            loss[mine] = np.rint(-np.log(p) * UNITS)[three.of[mine]]
        rows = Groups(g.row[g.doc].view(np.uint64))
        return pd.DataFrame({
            "row": g.row[g.doc][rows.first], "loss": rows.sums(loss.astype(np.int64)), "n": rows.sums(np.ones(len(loss), dtype=np.int64)),
        })

    return parcel.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(run, "row long, loss long, n long")


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Within, the files of a shuffle are given up when the table that it was for is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _one_by_one(frames: Iterator[DataFrame], name: str) -> DataFrame:
    """As ``saved``, of several tables of the same columns, written one after the other into one folder."""
    path = None
    for df in frames:
        path = path or f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_words(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Counts of both halves added up; only a part of the words ``c`` is shuffled at a time."""
    sums = [F.sum(f"k{h}").alias(f"n{h}") for h in HALVES]
    part = F.pmod("c", F.lit(PARTS))
    return _one_by_one((df.where(part == i).groupBy(*by).agg(*sums) for i in range(PARTS)), name)


def row_losses(source: DataFrame, blocks_of) -> DataFrame:
    """``row, loss, n`` per row with words: minus the log probabilities of its words by the other half,
    summed in ``UNITS``, and how many words; of rows that share ``row``, together."""
    spark = source.sparkSession
    buckets = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 6)
    with _shuffles_end(spark):
        blocks = stored(source, blocks_of)
        common, rare = common_words(blocks, buckets), SLICES * buckets
        every = _one_by_one(
            (tally(parcels(blocks, i, buckets, common), rare).withColumn("slice", F.lit(i)) for i in range(SLICES)), "tally"
        )
        lists = F.inline(F.arrays_zip("c", "lang", "k0", "k1"))
        split = every.where("middle IS NOT NULL").select("middle", lists)
        pairs = _by_words(split, ["middle", "lang", "c"], "pairs")
        of = every.agg(*[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("of3", "of2") for i in range(8)]).first()
        of = {k: v or 0 for k, v in of.asDict().items()}
        more = pairs.agg(*[F.count_if(F.col(f"n{h}") == i + 1).alias(f"of2{4 * h + i}") for h in HALVES for i in range(4)]).first()
        for k, v in more.asDict().items():
            of[k] += v
        cuts = [[discounts([of[f"{c}{4 * h + i}"] for i in range(4)]) for h in HALVES] for c in ("of2", "of3")]
        told = every.where("middle IS NULL").select(lists).union(
            pairs.select("c", "lang", *[(F.col(f"n{h}") > 0).cast("long") for h in HALVES])
        )
        one = _by_words(told, ["lang", "c"], "one")
        cuts.insert(0, _cuts(one))
        whole = saved(_contexts(one, cuts[0], "lang"), "languages")
        both = saved(one.where("n0 > 0 AND n1 > 0").drop("lang"), "both")  # a word that the other half lacks needs no answer
        middles = saved(_contexts(pairs, cuts[1], "middle"), "middles").drop("kinds0", "kinds1")
        twos = pairs.select("middle", "c", F.col("n0").alias("m0"), F.col("n1").alias("m1"))

        def part(i: int) -> DataFrame:
            own = every.where(F.col("slice") == i)
            langs = own.select("bucket", F.explode(F.array_distinct("lang")).alias("lang")).join(small(whole), "lang")
            langs = langs.groupBy("bucket").agg(F.collect_list(F.struct(*whole.columns)).alias("langs"))
            words = own.select("bucket", F.explode("c").alias("c")).join(both, "c")
            words = words.groupBy("bucket").agg(*[F.collect_list(c).alias(c) for c in ("c", "n0", "n1")])
            asked = own.where("middle IS NOT NULL").select("bucket", "middle", F.explode("c").alias("c")).join(twos, ["middle", "c"])
            asked = asked.groupBy("bucket", "middle").agg(*[F.collect_list(c).alias(k) for c, k in (("c", "pairs"), ("m0", "m0"), ("m1", "m1"))])
            answers = langs.join(words, "bucket", "left").join(asked.join(small(middles), "middle").drop("middle"), "bucket", "left")
            return _added(scored(parcels(blocks, i, buckets, common), answers, cuts))

        return saved(_added(_one_by_one(map(part, range(SLICES)), "parts")), "losses")


def _added(losses: DataFrame) -> DataFrame:
    return losses.groupBy("row").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))


def losses(words: DataFrame) -> DataFrame:
    """``row, loss`` of ``row, half, lang, words``: as ``row_losses``, without units."""
    return row_losses(words, blocks_of_words).select("row", (F.col("loss") / UNITS).alias("loss"))


def judged(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", low: float = LOW, high: float = HIGH) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept``, ``log_perplexity``.

    log_perplexity is the mean over words; null where there are none.  Null or empty text: no
    words, base_failed.  Null lang: a language of its own.  A language with texts in one half
    only: log_perplexity 0.  Repeated rows and ids: each row is judged.  Empty table: no rows.  Other columns are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BASE.split(", ")]
        for frame in frames:
            out = pd.DataFrame([base_counts(t) for t in frame["text"]], columns=names, index=frame.index)
            yield out.assign(row=frame["row"], doc_id=frame["doc_id"].astype("Int64"), lang=frame["lang"])[
                ["row", "doc_id", "lang", *names]
            ]

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"),
    ).withColumn("voice", F.xxhash64(F.coalesce("lang", F.lit("\0"))))
    # equal texts of a language share their row: texts are read again and again, in whatever order
    rows = rows.withColumn("row", F.xxhash64("voice", "text"))
    counts = saved(rows.mapInPandas(run, f"row long, doc_id long, lang string, {BASE}"), "counts")
    found = row_losses(rows.select("row", F.col("voice").alias("lang"), "text"), blocks_of_texts)
    counted = (
        counts.join(small(found), "row", "left")
        .withColumn("log_perplexity", F.col("loss") / UNITS / F.col("n")).drop("row", "loss", "n")
    )
    own = saved(
        counted.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")), "rules"
    )
    fair = own.where("NOT base_failed").withColumn("lang", F.coalesce("lang", F.lit("\0")))
    middle = small(saved(fair.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("mid")), "mid"))
    spread = F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("mid")), 0.5, 10000)
    bands = saved(
        fair.join(middle, "lang").groupBy("lang", "mid").agg(
            F.greatest(spread * 1.4826, F.lit(LEAST_SPREAD)).alias("deviation")
        ),
        "bands",
    ).withColumnRenamed("lang", "of")
    inside = ((F.col("log_perplexity") - F.col("mid")) / F.col("deviation")).between(-low, high)
    return (
        own.join(small(bands), F.coalesce("lang", F.lit("\0")) == F.col("of"), "left")
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
        .drop("of", "mid", "deviation", "lang")
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
