"""Each operator against a brute-force version, with odd rows."""

import hashlib
import math
import random
import re
import sys
import textwrap
import zlib
from collections import Counter
from fractions import Fraction
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from bocage.llm import (  # noqa: E402
    license_scan, line_dedup, packing, piece_codec, quality_classifier, quality_rules, simhash_dedup,
    suffix_dedup, token_counts, topk_search,
)
from bocage.llm.common import components, local_roots  # noqa: E402

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, root int, gone int, raw int"
WORDS = "the of and thanedble erea stor ing anwh haor onea rest tion lyed".split()


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "er", "an", "ix"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, exact and near copies, repeated rows, shared and missing ids."""
    rng = random.Random(5)
    texts = [_prose(rng, 80) + "\n" + _prose(rng, 40) for _ in range(12)]
    near = [t.replace("erea", "Erea!", 1) for t in texts[:6]]
    line = _prose(rng, 30)
    lines = [f"{_prose(rng, 9)}\n{line[:i]}x{line[i:]}\n \n{_prose(rng, 7)}" for i in range(4, 60, 8)]
    odd = [None, "", " \n\t", "ab", "é ☃\n日本", "aa " * 400, _prose(rng, 6000), texts[0], "q#*$ " * 60, "A▁b  c "]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t or "")) for i, t in enumerate([*texts, *near, *lines, *odd])]
    out += [out[0], (3, "another text of a shared id " * 9, "en", None, None), (None, texts[1], None, None, None)]
    return [(*r, "x", 1, 2, 3) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    nodes, roots = local_roots(*np.array(links).T)
    want = {int(x): int(x) for pair in links for x in pair} | dict(zip(nodes.tolist(), roots.tolist()))
    assert got == want


def test_simhash_components(docs, rows, nothing):
    got = [tuple(r) for r in simhash_dedup.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    prints = [(r[0], simhash_dedup.fingerprint(r[1].encode() if r[1] is not None else None)) for r in rows]
    assert sorted((str(a), b % (1 << 64)) for a, b, _ in got) == sorted((str(a), b) for a, b in prints)
    named = [(a, b) for a, b in prints if a is not None]
    pairs = [(a, c) for (a, b), (c, d) in combinations(named, 2) if (b ^ d).bit_count() <= 4]
    nodes, roots = local_roots(*np.array(pairs).T)
    root = dict(zip(nodes.tolist(), roots.tolist()))
    assert all(c == root.get(a, a) for a, _, c in got if a is not None)
    assert simhash_dedup.near_duplicates(nothing).isEmpty()
    kept = simhash_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {root.get(a, a) for a, _ in named} | {None}


def test_anchors_meet_every_close_pair():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        met = False
        for first, width in simhash_dedup.PARTS:
            anchors = []
            for v, radius in ((x, 1), (y, 2)):
                part = v >> first & (1 << width) - 1
                s = int(simhash_dedup._syndromes(np.array([part]))[0])
                anchors.append({part ^ int(f) for f in simhash_dedup._flips(width, radius)[s]})
            met |= bool(anchors[0] & anchors[1])
        assert met


def _brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_repeated_strings(spark, docs, rows, nothing):
    unique = [(r[0], r[1]) for r in rows if r[0] is not None and r[0] not in (0, 3)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(unique, "doc_id long, text string").repartition(4))
    want = _brute_repeats(unique)
    assert {r.doc_id: (r.n_bytes, r.n_spans, hashlib.sha256(r.raw).hexdigest()) for r in got.collect()} == want
    every = suffix_dedup.without_repeats(docs)
    assert every.columns == docs.columns and every.count() == len(rows)
    # rows equal in id and text are one document and do not erase each other
    assert {r.text for r in every.where("doc_id = 0").collect()} != {""}
    assert suffix_dedup.remove_repeats(nothing).isEmpty()


def _brute_lines(rows):
    """Lines that go, by exact similarity of all pairs."""
    places, sets = [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for n, line in enumerate((t or "").split("\n")):
            line = line.strip(" ").lower()
            if line:
                places.append((i, n, line))
                sets[line] = {line[k : k + 8] for k in range(max(len(line) - 7, 1))}
    number = {line: k for k, line in enumerate(sets)}
    pairs = [
        (number[a], number[b]) for a, b in combinations(sets, 2)
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ]
    nodes, roots = local_roots(*np.array(pairs).reshape(-1, 2).T)
    root = dict(zip(nodes.tolist(), roots.tolist()))
    seen, gone = set(), {i: [] for i, _ in rows}
    for i, n, line in places:
        r = root.get(number[line], number[line])
        if r in seen:
            gone[i].append(n)
        seen.add(r)
    return gone


def test_line_dedup(spark, docs, rows, nothing):
    unique = [(r[0], r[1]) for r in rows if r[0] is not None and r[0] not in (0, 3)]
    frame = spark.createDataFrame(unique, "doc_id long, text string").repartition(4)
    want = _brute_lines(unique)
    assert {r.doc_id: r.gone for r in line_dedup.line_dedup(frame).collect()} == want
    kept = {r.doc_id: r.text for r in line_dedup.without_removed(frame).collect()}
    for i, t in unique:
        assert kept[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i]))
    every = line_dedup.without_removed(docs)
    assert every.columns == docs.columns and every.count() == len(rows)
    assert line_dedup.line_dedup(nothing).isEmpty()


def test_crowded_band_values_lose_no_link(spark):
    """Chains of lines inside groups of like lines that are mostly below the similarity."""
    rng = random.Random(11)
    base = _prose(rng, 14)
    texts = []
    for _ in range(60):
        line = list(base)
        for _ in range(6):
            for at in rng.sample(range(len(line)), 2):
                line[at] = rng.choice("abcdefgh")
            texts.append("".join(line))
    rng.shuffle(texts)
    rows = [(i, "\n".join(texts[9 * i : 9 * i + 9])) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lines = line_dedup.lines_of(line_dedup.keyed(frame)[0])
    members = line_dedup.candidates(lines)[1]
    assert members.groupBy("key").count().where("count > 20").count() > 0
    alone = spark.createDataFrame([], "id long, root long")
    found = {tuple(r) for r in line_dedup.crowded_candidates(lines, members, alone).collect()}
    held = {}
    for r in members.collect():
        held.setdefault(r.key, set()).add(r.id)
    text = {r.id: line_dedup.shingles(r.line) for r in lines.collect()}
    for ids in held.values():
        for a, b in combinations(sorted(ids), 2):
            if len(text[a] & text[b]) >= 0.8 * len(text[a] | text[b]):
                assert (a, b) in found
    got = {r.doc_id: r.gone for r in line_dedup.line_dedup(frame).collect()}
    assert got == _brute_lines(rows)


def test_signatures_of_short_lines_take_few_calls():
    """A bin that borrows finds its lender at once; shingles of many lines are those of each."""
    rng = random.Random(2)
    lines = [_prose(rng, n)[: rng.randrange(1, 90)] for n in (1, 2, 3, 9) for _ in range(50)]
    lines += ["é" * 20, "a", "日本語 слово и ещё слово", "abcdefgh", "x" * 40]
    calls = 0

    def count(*_):
        nonlocal calls
        calls += 1

    sys.setprofile(count)
    try:
        got = line_dedup.band_keys(lines)
    finally:
        sys.setprofile(None)
    assert calls < 5000
    for line, keys in zip(lines, got):
        bins = {}
        for h in line_dedup._mix(line_dedup.windows(line.ljust(8, "\0")), np.uint64(line_dedup.SEED)).tolist():
            slot = (h >> 32) * line_dedup.BINS >> 32
            bins[slot] = min(h, bins.get(slot, h))
        for j in range(line_dedup.BINS):
            at, step = j, 0
            while at not in bins or (step and at == j):
                step += 1
                at = line_dedup.xxhash.xxh32_intdigest(bytes([j, step & 255, step >> 8])) % line_dedup.BINS
            bins[-1 - j] = bins[at]
        for band in range(line_dedup.BANDS):
            key = np.full(1, np.uint64(band))
            for r in range(line_dedup.ROWS):
                key = line_dedup._mix(np.array([bins[-1 - band * line_dedup.ROWS - r]], dtype=np.uint64), key)
            assert key.view(np.int64)[0] == keys[band]
    for line, ids in zip(lines, line_dedup.all_shingle_ids(lines)):
        assert ids.tolist() == line_dedup.shingle_ids(line).tolist()
        if line.isascii() and len(line) >= 8:
            want = {int.from_bytes(line[k : k + 8].encode(), "little") for k in range(len(line) - 7)}
            assert ids.tolist() == sorted(want)


def test_shingles_of_mixed_lines_meet():
    a = "a long line with one accent at its very end e"
    assert len(line_dedup.shingles(a) & line_dedup.shingles(a[:-1] + "é")) == len(a) - 8


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got = packing.pack(docs, path).toPandas()
    want = []
    for r in rows:
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(str(r[0]), s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    have = [(str(int(r.doc_id)) if r.doc_id == r.doc_id else "None", r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()]
    assert sorted(have) == sorted(want)
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert (sequence["offset"] == sequence["length"].cumsum() - sequence["length"]).all()
        assert sequence["length"].sum() <= 2048
    assert packing.pack(nothing, path).isEmpty()


def test_patterns_hold_every_length_once():
    rng = random.Random(3)
    for _ in range(200):
        size = rng.choice([16, 64, 2048])
        histogram = {rng.randint(1, size - 1): rng.choice([1, 2, 5, 1000]) for _ in range(rng.randint(0, 60))}
        total = dict.fromkeys(histogram, 0)
        for packs, pattern in packing.patterns(histogram, size):
            assert packs > 0 and sum(a * n for a, n in pattern) <= size
            for a, n in pattern:
                total[a] += packs * n
        assert total == histogram


def test_piece_codec(docs, rows, nothing):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = piece_codec.Codec(path)
    for r in rows:
        if r[1] is not None and "▁" not in r[1]:  # the library reads that character as a space
            assert codec.encode(r[1]) == library.encode(r[1])
    cuts = {tuple(piece_codec.Codec(path).encode(rows[1][1], 0.3, seed)) for seed in range(4)}
    assert len(cuts) == 4 and {codec.decode(c) for c in cuts} == {rows[1][1]}
    first = sorted(map(str, piece_codec.encoded(docs, path, 0.3, 7).collect()))
    assert first == sorted(map(str, piece_codec.encoded(docs.repartition(5), path, 0.3, 7).collect()))
    assert sorted(str(r.text) for r in piece_codec.encoded(docs, path).collect()) == sorted(str(r[1]) for r in rows)
    assert piece_codec.encoded(nothing, path).isEmpty()


def _brute_cut(codec, word, skips):
    """Merges one after the other, best score first, then leftmost, over a plain list."""
    text = word.replace(" ", piece_codec.MARK)
    edges, gone = list(range(len(text) + 1)), set()
    while True:
        found = [
            (-codec.score[text[a:c]], a, b, c) for a, b, c in zip(edges, edges[1:], edges[2:])
            if text[a:c] in codec.score and (a, b, c) not in gone
        ]
        if not found:
            break
        _, a, b, c = min(found)
        if skips(a, b, c):
            gone.add((a, b, c))
        else:
            edges.remove(b)
    return [codec.ids[text[a:b]] for a, b in zip(edges, edges[1:])]


def test_dropout_is_dealt_by_occurrence():
    """Equal words are cut on their own in one document and in many, and as the agenda says."""
    codec = piece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    word, full, skipping = " international", (1 << 64) - 1, int(0.3 * (1 << 64))
    whole = [codec.encode_all([(word * 50)[1:]], 0.3, 1, [d])[0] for d in range(20)]
    assert len({tuple(ids) for ids in whole}) == 20
    assert whole == codec.encode_all([(word * 50)[1:]] * 20, 0.3, 1, list(range(20)))

    def mixed(h):
        h = h * piece_codec._MIX & full
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & full
        return h ^ h >> 32

    cuts = set()
    for d, ids in enumerate(whole):
        want = []
        start = piece_codec.xxhash.xxh64_intdigest(d.to_bytes(8, "little"), 1)
        for place in range(1, 51):
            key = mixed(start + place * piece_codec._MIX & full)
            at = lambda a, b, c: mixed(key ^ (a * 0xC2B2AE3D27D4EB4F + b * 0x165667B19E3779F9 + c & full))  # noqa: E731, B023
            cut = _brute_cut(codec, word, lambda a, b, c: at(a, b, c) < skipping)  # noqa: B023
            cuts.add(tuple(cut))
            want += cut
        assert ids == want
    assert len(cuts) > 10


def test_agendas_of_many_words_are_worked_off_side_by_side():
    """Words never seen before take no Python call of their own; long ones and odd characters are cut alike."""
    codec = piece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiorstn") for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    calls = 0

    def count(*_):
        nonlocal calls
        calls += 1

    sys.setprofile(count)
    try:
        got = codec.encode(" ".join(words), 0.2, 3, 9)
    finally:
        sys.setprofile(None)
    assert calls < 2 * len(words) and codec.decode(got) == " ".join(words)
    texts = [" ".join(words[:300]), "", "é日😀\0 \n\n  ▁x " * 9, "  ", "international" * 8 + " " + "日本" * 80 + "\n", "a"]
    texts += [" ".join(w * 9 for w in words[:40])]
    docs = [-5, 0, 3, 1 << 40, 8, 9, 10]
    for dropout in (0.0, 0.2, 1.0):
        whole = codec.encode_all(texts, dropout, 3, docs)
        assert [codec.decode(ids) for ids in whole] == texts
        assert whole == [codec.encode(t, dropout, 3, d) for t, d in zip(texts, docs)]
        long, chunk = piece_codec.LONG, piece_codec.CHUNK
        try:
            piece_codec.LONG, piece_codec.CHUNK = 0, 1  # every word by its own heap
            assert codec.encode_all(texts, dropout, 3, docs) == whole
            piece_codec.LONG = 1 << 10  # none
            assert codec.encode_all(texts, dropout, 3, docs) == whole
        finally:
            piece_codec.LONG, piece_codec.CHUNK = long, chunk


def test_token_counts(docs, rows, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    known = token_counts.byte_pieces(path) | {bytes([b]) for b in range(256)}

    def greedy(word):
        n = 0
        while word:
            end = next(e for e in range(len(word), 0, -1) if word[:e] in known)
            word, n = word[end:], n + 1
        return n

    words = [(r[1] or "").encode().split() for r in rows]
    want = sorted((str(r[0]), len(w), sum(greedy(b" " + x) for x in w)) for r, w in zip(rows, words))
    assert sorted((str(r[0]), r[1], r[2]) for r in token_counts.token_counts(docs, path).collect()) == want
    assert token_counts.token_counts(nothing, path).isEmpty()
    with_tail = token_counts.Automaton({b"ab", b"abcd", b"cx"})  # a failure in the middle of a piece
    assert with_tail.count(b"abcx") == 2


def _naive_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, rows, nothing):
    for r in rows:
        if len(r[1] or "") < 5000:
            assert quality_rules.base_counts(r[1]) == _naive_base(r[1])
    got = quality_rules.judged(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in got) >= 18  # prose
    assert quality_rules.judged(nothing).isEmpty()


def test_word_models_by_brute_force(spark):
    """Every probability of both halves from plain counts; over all words of a context and an unseen one they sum to 1."""
    rng = random.Random(8)
    texts = [_prose(rng, 60) for _ in range(20)] + ["слово за словом в строке", "λόγος 日本 word", "", "слово за слово"]
    rows = [(i, i % 2, i // 8, quality_rules.word_hashes(t, i // 8).tolist()) for i, t in enumerate(texts)]
    words = spark.createDataFrame(rows, "row long, half int, lang long, words array<long>").repartition(3)
    grams = quality_rules.word_grams(words)
    got = {(r.a, r.b, r.c): (r.p0, r.p1) for r in quality_rules.word_model(grams).collect()}
    want: dict = {}
    for half in (0, 1):
        lang = {w: v for _, _, v, ws in rows for w in ws}
        counts = [Counter(tuple(ws[i : i + 3]) for _, h, _, ws in rows if h == half for i in range(len(ws) - 2))]
        for _ in range(2):
            counts.append(Counter(k[1:] for k in counts[-1]))
        cuts = [quality_rules.discounts([sum(n == i for n in c.values()) for i in (1, 2, 3, 4)]) for c in counts]

        def probability(key, level=0):
            if level < 2:
                same = {k: n for k, n in counts[level].items() if k[:-1] == key[:-1]}
                lower = lambda: probability(key[1:], level + 1)
            else:
                same = {k: n for k, n in counts[2].items() if lang[k[0]] == of}
                lower = lambda: 1 / (len(same) + 1)
            total = sum(same.values())
            if not total:
                return lower()
            taken = {k: cuts[level][min(n, 3)] for k, n in same.items()}
            return (same.get(key, 0) - taken.get(key, 0) + sum(taken.values()) * lower()) / total

        for key in got:
            of = lang[key[2]]
            want.setdefault(key, []).append(probability(key))
        for a, b, c in list(got)[:5]:
            of = lang[c]
            seen = [w for (w,) in counts[2] if lang[w] == of]
            assert sum(probability((a, b, w)) for w in [*seen, 0]) == pytest.approx(1)
    assert set(got) == {tuple(ws[i : i + 3]) for _, _, _, ws in rows for i in range(len(ws) - 2)}
    for key, p in got.items():
        assert p == pytest.approx(tuple(want[key]))
    lost = {r[0]: -sum(np.log(got[tuple(r[3][k : k + 3])][1 - r[1]]) for k in range(len(r[3]) - 2)) for r in rows if r[3]}
    assert {r.row: r.loss for r in quality_rules.losses(words).collect()} == pytest.approx(lost, abs=1e-6)


def test_words_are_hashed_side_by_side():
    """Words, halves and languages of texts as one by one, also in small pieces."""
    rng = random.Random(1)
    texts = [None, "", " \n", "a", "héé ☃ 日本"] + [
        "".join(rng.choice("ab é日\t\n") * rng.choice([1, 1, 1, 5, 17]) for _ in range(rng.randrange(90))) for _ in range(200)
    ]
    seeds = [rng.randrange(-(2**63), 2**63) for _ in texts]
    batch = pa.RecordBatch.from_pydict({"row": [*range(len(texts))], "lang": seeds, "text": texts})
    want = {i: words for i, (t, v) in enumerate(zip(texts, seeds)) if len(words := quality_rules.word_hashes(t, v))}
    for of in (quality_rules.blocks_of_texts(batch.slice(0, 90)), quality_rules.blocks_of_texts(batch.slice(90))):
        for block in of:
            at = 0
            for row, n, lang, half in zip(block.row, block.sizes, block.lang, block.half):
                words = want.pop(row)
                assert block.words[block.at[at : at + n + 2]].view(np.int64).tolist() == words.tolist()
                assert (lang, half) == (seeds[row], quality_rules.half_of(words))
                at += n + 2
    assert not want


def test_every_ngram_is_dealt_once(spark):
    """Over all slices; words are kept in less than three bytes; a common word has several buckets, one holds no more than its share."""
    rng = random.Random(2)
    rare = [f"w{i}" for i in range(3000)]
    rows = [(i, i % 2, 7, quality_rules.word_hashes(" ".join(rng.choice(rare) if k % 3 else "the" for k in range(400))).tolist()) for i in range(300)]
    words = spark.createDataFrame(rows, "row long, half int, lang long, words array<long>").repartition(2)
    blocks = quality_rules.stored(words, quality_rules.blocks_of_words)
    kept = blocks.selectExpr("sum(length(words) + length(at))").first()[0]
    assert kept < 3 * 300 * 402
    common = quality_rules.common_words(blocks, 4)
    the = quality_rules.word_hashes("the")[2:].view(np.uint64)
    assert common.buckets[common.words == the] >= 30
    got, sizes = Counter(), Counter()
    for i in range(quality_rules.SLICES):
        frame = quality_rules.parcels(blocks, i, 4, common).toPandas()
        for bucket, part in frame.groupby("bucket"):
            g = quality_rules._opened(part)
            sizes[bucket] += len(g.a)
            got.update(zip(*(x.view(np.int64).tolist() for x in (g.a, g.b, g.c)), g.row[g.doc].tolist()))
    assert got == Counter((*ws[k : k + 3], row) for row, _, _, ws in rows for k in range(len(ws) - 2))
    assert max(sizes.values()) < 3 * 300 * 400 / (4 * quality_rules.SLICES)


def test_words_in_senseless_order_and_other_scripts_are_seen(spark):
    """The same words in another order, and in a script beyond ASCII, stand out."""
    rng = random.Random(4)
    for kinds in (WORDS, "слово за строк вод мир дом лес кот пёс сад".split()):
        phrases = [" ".join(rng.choice(kinds) for _ in range(6)) for _ in range(12)]
        texts = [" ".join(rng.choice(phrases) for _ in range(20)) for _ in range(40)]
        mixed = texts[0].split()
        rng.shuffle(mixed)
        rows = [(i, t, "en") for i, t in enumerate([*texts[1:], " ".join(mixed)])]
        got = {r.doc_id: r.log_perplexity for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
        assert got.pop(39) > 1.3 * max(got.values())


def test_bands_by_brute_force(spark):
    """Random letters and words of all languages are rejected, prose stays; the bands are those of plain medians."""
    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    words = sorted({w for r in docs.collect() for w in (r.text or "").split()})
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    odd = [(10**6 + i, " ".join(letters() for _ in range(200)), "en") for i in range(10)]
    odd += [(2 * 10**6 + i, " ".join(rng.choice(words) for _ in range(200)), "en") for i in range(10)]
    got = quality_rules.judged(docs.union(spark.createDataFrame(odd, docs.schema))).collect()
    assert not any(r.kept for r in got if r.doc_id >= 10**6)
    fair = [r for r in got if r.doc_id < 10**6 and not r.base_failed]
    symbols = lambda r: 20 * r.n_symbols > r.word_chars
    prose = [r for r in fair if not symbols(r)]
    assert sum(r.kept for r in prose) >= 0.99 * len(prose)
    assert sum(not r.kept for r in fair if symbols(r)) >= 10
    lang = {r.doc_id: r.lang for r in docs.collect()}
    for of in ("de", "en", "es", "fr"):
        mine = [r for r in got if not r.base_failed and lang.get(r.doc_id, "en") == of]
        x = np.array([r.log_perplexity for r in mine])
        middle = np.quantile(x, 0.5, method="inverted_cdf")
        deviation = max(1.4826 * np.quantile(np.abs(x - middle), 0.5, method="inverted_cdf"), quality_rules.LEAST_SPREAD)
        z = (x - middle) / deviation
        assert [r.kept for r in mine] == [-quality_rules.LOW <= v <= quality_rules.HIGH for v in z]


def test_near_copies_lie_in_one_half():
    rng = random.Random(6)
    same = 0
    for _ in range(300):
        words = _prose(rng, 200).split()
        words[rng.randrange(200)] = "other"
        near = " ".join(words)
        words[rng.randrange(200)] = "words"
        same += quality_rules.half_of(quality_rules.word_hashes(near)) == quality_rules.half_of(quality_rules.word_hashes(" ".join(words)))
    assert same >= 285
    halves = [quality_rules.half_of(quality_rules.word_hashes(_prose(rng, 50))) for _ in range(400)]
    assert 150 < sum(halves) < 250 and quality_rules.half_of(quality_rules.word_hashes(None)) == 0


def test_license_scan(spark, docs, nothing):
    mit = license_scan.KNOWN["MIT"][0]
    texts = [mit, "Copyright (c) 2020 A. Writer\n" + mit.upper(), mit.replace("sublicense", "sub-licence"), mit + " plus", None, "", "é"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.digest, r.license) for r in license_scan.license_scan(frame).collect()}
    assert [got[i][1] for i in range(7)] == ["MIT", "MIT", "MIT", None, None, None, None]
    for i, t in enumerate(texts):
        assert got[i][0] == (None if t is None else hashlib.sha256(license_scan.canonical_text(t).encode()).hexdigest())
    assert license_scan.license_scan(docs).count() == docs.count()
    assert license_scan.license_scan(nothing).isEmpty()


def test_full_licence_texts(spark):
    """Whole texts, also in other case and spacing, or without the appendix; not such with other words."""
    folder = Path(license_scan.__file__).parent / "licenses"
    want = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-SA-4.0"]
    texts = {name: (folder / f"{name}~0.txt").read_text(encoding="utf-8") for name in want}
    rows = [(name, f"Copyright 2021 Some One\n{t.upper()}\n\n") for name, t in texts.items()]
    rows += [(name, t.replace("  ", " ") + "  ") for name, t in texts.items()]
    rows += [("Apache-2.0", texts["Apache-2.0"].split("END OF TERMS")[0]), (None, texts["GPL-3.0"] + " and more")]
    rows += [(None, texts["MPL-2.0"][:9000])]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in license_scan.license_scan(frame).collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows]
    names = dict(license_scan.known_digests(license_scan.KNOWN))
    assert len(names) == len(set(license_scan.known_digests(license_scan.KNOWN)))  # no text has two names


def test_other_line_breaks_give_the_same_form(spark):
    """Each shipped text with its paragraphs broken at 40 to 120 columns, in the three versions of the form."""
    texts = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(license_scan.__file__).parent / "licenses").glob("*.txt"))}
    texts |= {name: license_scan.KNOWN[name][0] for name in ("MIT", "ISC", "0BSD")}
    fill = lambda t, w: "\n\n".join(
        textwrap.fill(q, w, break_long_words=False, break_on_hyphens=False) for q in re.split(r"\n\s*\n", t)
    )
    rows = []
    for name, t in texts.items():
        form = license_scan.canonical_text(t)
        for w in range(40, 121):
            # the notice of a holder that is broken itself leaves its second line
            if not (name == "BSD-3-Clause~0" and w < 60 or name == "Zlib~0" and w == 40):
                assert license_scan.canonical_text(fill(t, w)) == form, (name, w)
        rows += [(name.split("~")[0], fill(t, w)) for w in (66, 72, 90, 120)]
    running = "The rules of copyright 1998 or of (c) You must, and\ncopyright law and\n(c) You must keep\u00a0them"
    assert license_scan.canonical_text(running) == "the rules of copyright 1998 or of c you must and copyright law and c you must keep them "
    for notice in ("Copyright (c) 2020 A. Writer", "(C) 2021 B", "\u00a9 Copyright 2022 C", "Copyright 1999-2003 D", "Copyright E"):
        assert license_scan.canonical_text(f"{notice}\nAll rights reserved.\nMay be used.") == "may be used "
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate([*rows, (None, running)])], "doc_id long, text string")
    got = {r.doc_id: (r.digest, r.license) for r in license_scan.license_scan(frame).collect()}
    assert [got[i][1] for i in range(len(rows) + 1)] == [name for name, _ in rows] + [None]
    con = duckdb.connect()
    texts_of = frame.toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM texts_of")
    assert {r[0]: r[1:] for r in con.execute(license_scan.op4_sql()).fetchall()} == got


def test_top_k(spark):
    rng = np.random.default_rng(4)
    values = [[float(x) for x in v] for v in rng.normal(size=(400, 24)) * 0.2]
    values[7] = values[9]
    table = [*enumerate(values), (400, None), (500, [float("nan")] * 24), (600, [None] * 24), (700, [1.0, 2.0]), (800, [float("inf")] * 24), (None, values[0])]
    vectors = topk_search.quantised(spark.createDataFrame(table, "vec_id long, embedding array<float>").repartition(3))
    got = topk_search.top_k(vectors.where("vec_id % 100 = 0"), vectors).collect()
    whole = np.floor(1024 * np.array(values, dtype=np.float32).astype(float)).astype(int)
    want = []
    for q in (0, 100, 200, 300):
        scores = whole @ whole[q]
        best = [i for i in np.lexsort((np.arange(400), -scores)) if i != q][:10]
        want += [(q, n, int(i), int(scores[i])) for n, i in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == want
    assert topk_search.top_k(vectors.where("false"), vectors).isEmpty()


def test_blocks_grow_with_the_vectors(spark):
    many = spark.range(0, 4000, 1, 40)
    parts = lambda rows: topk_search.in_blocks(many, rows).rdd.getNumPartitions()
    assert [parts(n) for n in (0, 4000, 20 * topk_search.BLOCK_ROWS, 30 * topk_search.BLOCK_ROWS + 1, 10**9)] == [12, 12, 20, 31, 40]


def test_top_k_with_large_components(spark):
    """Every finite vector counts, whatever its size, as candidate and as query."""
    rng = np.random.default_rng(6)
    values = [[float(x) for x in v] for v in rng.normal(size=(300, 24)) * 0.2]
    sizes = [2.0**19, 2.0**20, 3.0e6, 1e9, 1e15, 3e18, 1e30, 1e200, 1.7e308]
    for i in range(0, 300, 7):
        values[i][i % 24] = float(rng.choice([-1.0, 1.0])) * sizes[i // 7 % len(sizes)]
    values[14], values[200][3], values[201][3] = list(values[28]), 2e6, 2e6 + 1 / 1024
    table = spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<double>").repartition(3)
    vectors = topk_search.quantised(table)
    got = topk_search.top_k(vectors.where("vec_id % 25 = 0 OR vec_id % 28 = 0"), vectors).collect()
    whole = [[math.floor(Fraction(x) * 1024) for x in v] for v in values]
    want = []
    for q in (q for q in range(300) if q % 25 == 0 or q % 28 == 0):
        scores = {i: sum(a * b for a, b in zip(whole[q], v)) for i, v in enumerate(whole) if i != q}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:10]
        want += [(q, n, i, scores[i] if -(2**63) <= scores[i] < 2**63 else None) for n, i in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == want
    assert len({r[2] for r in want if r[2] % 7 == 0}) > 10


def test_classifier_on_held_out_labels(spark, docs, nothing):
    data = DATA.replace("0.001", "0.01")
    all_docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    scored = quality_classifier.scored(all_docs, train).join(test, "doc_id").collect()
    assert len(scored) > 80 and sum(r.kept == (r.quality == 1) for r in scored) >= 0.97 * len(scored)
    assert all(r.kept for r in scored if r.quality == 1)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.scored(docs, none).collect()} == {1.0}
    kept = quality_classifier.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality_classifier.scored(nothing, labels).isEmpty()


def test_few_labels_give_a_model(spark):
    """Both classes are fitted and held out, however few labels there are."""
    for n in (1, 2, 3, 30):
        y = np.array([0.0] * n + [1.0] * 2)
        train, held = quality_classifier.parted(y, np.arange(len(y)))
        assert all(set(y[part]) == {0.0, 1.0} for part in (train, held)) and (train | held).all()
    data = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    few = labels.where("quality = 0").orderBy("doc_id").limit(1).union(labels.where("quality = 1").orderBy("doc_id").limit(1))
    assert quality_classifier.trained(data, few) is not None


def test_sums_over_tasks_are_the_fit():
    """Pseudo-labels are given by every sure document, and steps from summed parts fit as one."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40_000, 3))
    y = (x[:, 0] + rng.normal(size=len(x)) > 0).astype(float)
    w = np.zeros(4)
    for _ in range(25):
        w = w + quality_classifier.stepped(sum(quality_classifier.sums(x[i::7], y[i::7], w) for i in range(7)), w)
    assert w == pytest.approx(quality_classifier.fit(x, y), abs=1e-6)
    strong = [np.array([5.0, 0, 0, 0]), np.array([0, 0.1, 0, 0])]
    (_, _), (rows, labels) = quality_classifier.taught([x, x], [strong])
    sure = np.flatnonzero(np.abs(5 * x[:, 0]) >= np.log(0.97 / 0.03))
    assert rows.tolist() == sure.tolist() and (labels == (x[sure, 0] > 0)).all() and len(rows) > 8000


def test_stages_take_any_extra_columns(spark, nothing):
    """Columns named as those that the stages add stay as they came."""
    rng = random.Random(7)
    text = _prose(rng, 60)
    own = ["_doc", "_print", "_gone", "_new", "_runs", "_Kept_id", "__doc", "doc", "print", "lang"]
    rows = [(1, text, *own), (2, text, *own), (3, None, *own), (4, _prose(rng, 70) + "\n" + text, *own)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *own])
    want = {
        line_dedup.without_removed: [text, "", None, rows[3][1].split("\n")[0]],
        suffix_dedup.without_repeats: None,
        simhash_dedup.keep_one_of_each: [text, None, rows[3][1]],
    }
    for stage, texts in want.items():
        got = sorted(stage(docs).collect())
        assert stage(docs).columns == docs.columns and all(list(r[2:]) == own for r in got)
        assert texts is None or [r.text for r in got] == texts
        assert stage(nothing).isEmpty()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if "doc_id" in docs.columns else []
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps[name] = (before, docs)
    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert all(after.columns == columns for _, after in [*steps.values()][:-1])
    before, after = steps["line dedup"]
    gone = _brute_lines(before)
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in before}
    assert {r.doc_id: r.text for r in after.collect()} == want
    before, after = steps["SimHash near-dedup"]
    prints = [(i, simhash_dedup.fingerprint(t.encode())) for i, t in before]
    pairs = [(a, c) for (a, b), (c, d) in combinations(prints, 2) if (b ^ d).bit_count() <= 4]
    second, _ = local_roots(*np.array(pairs).reshape(-1, 2).T)
    assert {r.doc_id for r in after.collect()} == {i for i, _ in prints} - set(second.tolist())
    before, after = steps["suffix-array dedup"]
    sha = {i: s for i, (_, _, s) in _brute_repeats(before).items()}
    same = [hashlib.sha256(r.text.encode()).hexdigest() == sha[r.doc_id] for r in after.collect()]
    assert sum(same) >= 0.97 * len(same)  # a cut inside a character drops the rest of it
    before, after = steps["packing"]
    assert {r.doc_id for r in after.collect()} == {i for i, _ in before}


def test_parities_never_overstate_a_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        common = rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64)
        own = [np.unique(np.concatenate([common, rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64)])) for _ in range(2)]
        bits = [line_dedup.parities(t) for t in own]
        differ = sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64))
        assert len(bits[0]) == line_dedup.WORDS and differ <= len(np.setxor1d(*own))
