"""The Merkle manifest against a plain tree built in memory."""

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from bocage.llm import merkle_manifest as m

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, key string"


def _h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def _leaf(row, text):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def _tree(row):
    """All levels of a tree of threes."""
    levels = [row]
    while len(row) > 1:
        row = [_h(*row[i : i + 3]) for i in range(0, len(row), 3)]
        levels.append(row)
    return levels


def _brute(rows):
    groups, out = {}, []
    for row in rows:
        groups.setdefault((row[1] is not None, (row[1] or "").encode()), []).append((row[0] is not None, row[0] or 0, _leaf(row, row[4]), row))
    trees = {k: (sorted(v, key=lambda x: x[:3]), _tree([x[2] for x in sorted(v, key=lambda x: x[:3])])) for k, v in groups.items()}
    order = sorted(trees)
    top = _tree([trees[k][1][-1][0] for k in order])
    for n, k in enumerate(order):
        members, levels = trees[k]
        for i, (_, _, leaf, row) in enumerate(members):
            text = row[4]
            if row[0] is not None and text is not None and crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now, proof = _leaf(row, text), []
            for at, tree in ((i, levels), (n, top)):
                for level in tree[:-1]:
                    b = at - at % 3
                    left, right = level[b:at], level[at + 1 : b + 3]
                    proof += left + right
                    now = _h(*left, now, *right)
                    at //= 3
            out.append((row[0], leaf, levels[-1][0], top[-1][0], _h(*proof), now, now == top[-1][0]))
    return out


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def _check(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    got = [tuple(r) for r in m.verified(docs, cut, **options).collect()]
    assert sorted(got, key=_key) == sorted(_brute(rows), key=_key)
    return got


def _rows(n, of):
    return [(i * 7 % 1000, of(i), "en" if i % 3 else None, i, f"é {i}\nline" if i % 5 else None, "x", "y") for i in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_sources_over_several_subtrees(spark, levels):
    sizes = [i for n in (1, 2, 3, 9, 10, 27, 28, 85, 400) for i in [n] * n]
    _check(spark, _rows(len(sizes), lambda i: f"s{sizes[i]}"), levels=levels)


def test_one_document_is_its_own_root(spark):
    _check(spark, _rows(1, lambda i: "s"))


def test_hot_source_nulls_ties_and_many_sources(spark):
    rows = _rows(900, lambda i: "hot" if i % 3 else [None, "", "ä", "z", f"s{i}"][i // 3 % 5])
    rows += [(None, None, None, None, None, None, None), (None, "hot", "", 0, "", None, None), rows[5], (35, "hot", "en", 1, "\n" * 9, "", "")]
    got = _check(spark, rows, levels=2)
    assert {r[-1] for r in got} == {True, False}


def test_nothing_gives_nothing(spark):
    assert m.verified(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("levels", range(1, 9))
def test_layout_places_every_node_once(levels):
    at = m.addresses(levels)
    assert sorted(x for row in at for x in row) == list(range((3**levels - 1) // 2))
    # the upper half of the levels lies together, before all that hangs below it
    upper = max(int(row.max()) for row in at[: levels // 2]) if levels > 1 else 0
    assert all(int(row.min()) > upper for row in at[levels // 2 :]) or levels == 1
