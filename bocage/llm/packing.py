"""Pack tokenised documents into sequences of at most ``size`` tokens.

Method (shortest-pack-first over the length histogram).  A document is cut into pieces of
``size`` tokens and a rest.  Full pieces are sequences by themselves.  The rests are counted
by length; lengths are placed longest first, each time into the packs that are shortest so
far and still have room, which updates the number of packs of each pattern.  A rest's rank
among the rests of its length then tells its pack and its offset.

Scale.  The histogram has ``size`` - 1 entries whatever the input, and the patterns are
computed from it alone on the driver; each pattern is a list of (length, copies), and a step
either ends a length or ends a pattern, so their number depends on ``size`` only.  Ranks are
numbered inside (length, bucket) and shifted by counts of ``BUCKETS`` buckets per length, so
that one very common length is spread over all tasks.  Texts are tokenised once.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SIZE = 2048
END_ID = 1
BUCKETS = 32
CACHED_WORDS = 300_000  # per Python worker; the words seen are forgotten beyond that


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class WordEncoder:
    """Ids of whole texts, remembered by word.

    The tokenizer splits at white space and never joins what it split, so a text's ids are
    those of its words in order.  Words of letters below U+0250, with dots or commas after
    them, go straight to the tokenizer's merge model; all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.known: dict[str, tuple[int, ...]] = {}
        self.cores: dict[str, tuple[int, ...]] = {}
        # the printable stand-ins of bytes in byte-level vocabularies
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.byte = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}

    def _core(self, core: str) -> tuple[int, ...]:
        ids = self.cores.get(core)
        if ids is None:
            text = core if core.isascii() else "".join(self.byte[b] for b in core.encode())
            ids = self.cores[core] = tuple([t.id for t in self.model.tokenize(text)])
        return ids

    def _word(self, word: str) -> tuple[int, ...]:
        core = word.rstrip(".,")
        tail = word[len(core) :]
        core = core.lower() if core.isascii() else unicodedata.normalize("NFC", core).lower()
        if core.isalpha() and max(core) < "\u0250":
            ids = self._core(core)
            return ids + self._tail(tail) if tail else ids
        return tuple(self.whole.encode(word, add_special_tokens=False).ids)

    @cache
    def _tail(self, tail: str) -> tuple[int, ...]:
        return tuple(self.whole.encode(tail, add_special_tokens=False).ids)

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        if len(known) + len(self.cores) > 2 * CACHED_WORDS:
            known.clear()
            self.cores.clear()
        for word in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._word(word) if word else ()
            out += ids
        return out


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` and ``row``, which tells apart pieces
    of rows that are equal in all of these."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(vocabulary).encode
        for frame in frames:
            rows = []
            for doc, text_, row in zip(frame["doc_id"], frame["text"], frame["row"]):
                ids = np.array([*encode(text_ or ""), END_ID], dtype="<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), row))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.mapInPandas(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"
    )


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first: (number of packs, [(length, copies), ...]) for a histogram."""
    room: dict[int, list[list]] = defaultdict(list)  # free tokens -> [packs, pattern]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # shortest packs first; what was placed in this step keeps its place for the next
        for free in sorted((f for f in room if f >= length), reverse=True):
            if not left:
                break
            for entry in room.pop(free):
                packs, pattern = entry
                copies = min(free // length, -(-left // packs)) if left else 0
                if not copies:
                    room[free].append(entry)
                    continue
                # whole rounds: every pack gets `copies`; a last round may not reach all packs
                full = packs if packs * copies <= left else left - packs * (copies - 1)
                for count, n in ((full, copies), (packs - full, copies - 1)):
                    if count:
                        room[free - n * length].append([count, [*pattern, (length, n)] if n else pattern])
                left -= full * copies + (packs - full) * (copies - 1)
        if left:
            copies = size // length
            packs, over = divmod(left, copies)
            if packs:
                room[size - copies * length].append([packs, [(length, copies)]])
            if over:
                room[size - over * length].append([1, [(length, over)]])
    return [(packs, pattern) for free in sorted(room) for packs, pattern in room[free]]


def _places(found: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple]:
    """Rows ``length, first, last, copies, sequence, offset``: ranks first..last of a length
    fill the packs from ``sequence`` on, ``copies`` each, from ``offset`` in the pack."""
    seen: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for packs, pattern in found:
        offset = 0
        for length, copies in pattern:
            first = seen[length]
            seen[length] += packs * copies
            rows.append((length, first, first + packs * copies - 1, copies, sequence, offset))
            offset += length * copies
        sequence += packs
    return rows


def packed(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Add ``sequence_id, offset`` to saved pieces."""
    spark = cut.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", "row"), F.lit(BUCKETS)).cast("int")
    rest = cut.withColumn("bucket", bucket)
    counts = {
        (r.length, r.bucket): r.n
        for r in rest.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # size x BUCKETS rows at most
    }
    histogram: dict[int, int] = defaultdict(int)
    shifts = []
    for (length, b), n in sorted(counts.items()):
        shifts.append((length, b, histogram[length]))
        histogram[length] += n
    full = histogram.pop(size, 0)
    places = [(size, 0, full - 1, 1, 0, 0)] if full else []
    places += [(*r[:4], r[4] + full, r[5]) for r in _places(patterns(histogram, size))]
    shift = spark.createDataFrame(shifts, "length long, bucket int, before long")
    # one row per length: its places in order of rank
    place = (
        spark.createDataFrame(places, "length long, first long, last long, copies long, sequence long, at long")
        .groupBy("length")
        .agg(F.sort_array(F.collect_list(F.struct("first", "last", "copies", "sequence", "at"))).alias("places"))
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "row", "start")
    ranked = (
        rest.withColumn("rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(shift), ["length", "bucket"])  # bounded by size x BUCKETS
        .withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))
        .join(F.broadcast(place), "length")  # bounded by the number of patterns
        .withColumn("p", F.filter("places", lambda x: F.col("rank").between(x["first"], x["last"]))[0])
    )
    nth = F.col("rank") - F.col("p.first")
    return ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("p.sequence") + F.floor(nth / F.col("p.copies"))).cast("long").alias("sequence_id"),
        (F.col("p.at") + F.col("length") * (nth % F.col("p.copies"))).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Null or empty text: the end id alone.  Null doc_id: kept.  Repeated rows: each is packed.
    Empty table: no rows.  Other columns are not read.
    """
    return packed(saved(pieces(docs, vocabulary, size, text, doc_id), "pieces"), size)


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
