"""The conversation trie against a plain one in memory."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pytest

from bocage.llm import conversation_trie as m

SCHEMA = "conv_id long, turn int, role string, text string, conv long, depth int, weight string, a long"


def _sha(text):
    return sha256(text.encode()).hexdigest()


def _brute(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = _sha(f"{len(role.encode())}:{role}{text}")
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    members = {}
    built = {}
    for c in own:
        h = crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
    out = {}
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        below = [out[k] for k in kids.get(node, [])]
        ends = sorted(c for c in members[node] if built[c] == node)
        size = len(node[-1][1].encode()) if node else 0
        out[node] = (
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below),
            sum(b[5] for b in below) if below else 1,
            (len(members[node]) - 1) * size + sum(b[6] for b in below), _sha(",".join(map(str, ends))),
        )
    return sorted(out.values(), key=str)


def _rows():
    rng = random.Random(3)
    rows = []
    for c in [*range(40), *range(47, 70, 4), 1001, 1002, 1013, 9999]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["hé", "", None, "x\ny", "a" * 500])))
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 400) for t in range(5)]  # a frequent conversation
    rows += [(c, 0, "user", "hello") for c in range(500, 600)] + [(c, 1, "user", str(c)) for c in range(500, 600)]
    rows += [(600, t, "user", "deep" if t % 2 else str(t)) for t in range(300)] + [(605, t, "user", "deep") for t in range(250)]
    rows += [(2, 0, "user", "twice"), (2, 0, "user", "twice"), (3, None, "bot", "first"), (None, 0, "user", "nobody")]
    rows = [(*r, 7, 8, "w", 9) for r in rows]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("local", [20_000, 30])
def test_trie_as_in_memory(spark, local):
    rows = _rows()
    got = m.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), local=local).collect()
    assert sorted(map(tuple, got), key=str) == _brute(rows)


def test_one_turn_and_no_turn(spark):
    rows = [(1, 0, None, None, None, None, None, None)]
    assert [tuple(r) for r in m.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()] == _brute(rows)
    assert m.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_local_rollup_on_random_trees():
    rng = random.Random(8)
    for shape in (lambda i: i - 1, lambda i: 0, lambda i: rng.randrange(i), lambda i: rng.randrange(max(0, i - 3), i)):
        n = 200
        parent = [-1, *[shape(i) for i in range(1, n)]]
        convs = [rng.randrange(1, 9) for _ in range(n)]
        depth, leaf = [0] * n, [rng.randrange(5) for _ in range(n)]
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        ends, want = convs[:], leaf[:]
        for i in range(n - 1, 0, -1):
            ends[parent[i]] += ends[i]
            want[parent[i]] += want[i]
        names = np.array([100 + i for i in range(n)])
        frame = pd.DataFrame({
            "a": names, "b": names, "pa": [99 if p < 0 else names[p] for p in parent], "pb": [99 if p < 0 else names[p] for p in parent],
            "depth": depth, "conv": 0, "weight": ends, "leaf": leaf, "saved": 0, "ta": 100, "tb": 100, "more_leaf": 0, "more_saved": 0,
        })
        assert m.local_rollup(frame)["n_leaves"].tolist() == want


def test_hash_of_ends_goes_on_over_batches():
    pieces = pd.DataFrame({"a": [1, 1, 2], "b": [1, 1, 2], "ids": ["3,4", "5", "6"]})
    got = pd.concat(m._hashed(iter([pieces[:1], pieces[1:]])))
    assert got["ends_sha256"].tolist() == [_sha("3,4,5"), _sha("6")]
