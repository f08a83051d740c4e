"""The conversation trie, clustering and exact search against plain Python, on odd rows and on whole small tables."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import clustering, conversations, topk, vectors

SF = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>"


def brute_trie(rows):
    """Nodes as tuples, with the prefixes themselves as keys."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(xs, key=lambda x: x[:2])] for c, xs in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(c)
            if d:
                children[rebuilt[: d - 1]].add(rebuilt[:d])
        ends[rebuilt].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    digest = lambda node: hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
    up = lambda node: min(members[node[:-1]]) if node else None
    return sorted((min(who), len(n), up(n) if n else -1, len(who), len(children[n]), leaves[n], saved[n], digest(n)) for n, who in members.items())


def tree(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def talk(seed, convs, words=3, longest=9):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"][: 1 + (t > 2)]), " ".join(rng.choices("ab", k=rng.randint(0, words)))) for c in convs for t in range(rng.randint(1, longest))]


ODD = [
    (100, None, "user", "null turn"), (100, None, None, None), (100, 0, "user", ""), (100, 0, "user", ""), (100, 0, "", "é\U0001f600"), (101, 5, "user", "x"), (102, -3, None, "x"), (102, -3, None, "x"),
    (None, 1, "user", "no conversation"), (203, 1, "user", "no donor"), (0, 1, "user", "a:b"), (1, 1, "user:a", "b"), (-7, 1, "user", "below zero"), (-105, 2, "user", "below zero"), (-100, 2, "user", "below zero"),
    ((1 << 63) - 1, 1, "user", "largest"), (-(1 << 63), 1, "user", "least"),
]


@pytest.mark.parametrize("rows", [ODD, ODD + ODD, [(c, t, r, x) for c, t, r, x in ODD if c == 203], talk(1, range(300)), talk(2, range(95, 240), words=1, longest=40)])
def test_trie(spark, rows):
    random.Random(3).shuffle(rows)
    assert tree(conversations.trie(spark.createDataFrame(rows, TURNS).repartition(3))) == brute_trie(rows)


def test_trie_of_a_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert tree(conversations.trie(table)) == brute_trie([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()])


def test_trie_of_nothing_and_of_clashing_names(spark):
    rows = talk(4, range(30))
    frame = spark.createDataFrame(rows, TURNS)
    assert conversations.trie(frame.limit(0)).count() == 0
    assert conversations.trie(frame.filter("turn < 0").union(spark.createDataFrame([(None, 1, "user", "x")], TURNS))).count() == 0
    clashing = frame.withColumns({c: F.lit(7) for c in ("depth", "fp", "split", "run", "term", "part", "edge", "place", "own", "k", "h", "donor", "row", "d0", "chars")})
    assert tree(conversations.trie(clashing)) == brute_trie(rows)


def test_collisions_are_split(spark):
    """Fingerprints modulo 31: groups hold unlike prefixes, also ones that differ above only."""
    rows = talk(5, range(25), words=2, longest=5)
    frame = spark.createDataFrame(rows, TURNS)
    assert tree(conversations.trie(frame, prime=31)) == brute_trie(rows)
    with pytest.raises(RuntimeError):
        conversations.trie(frame, prime=31, bases=conversations.BASES[:2])


def test_hot_conversations(spark):
    """A conversation longer than a range, equal turns that no range can hold, copies, one turn that nearly all begin with, a node at which thousands end."""
    rng = random.Random(6)
    rows = [(0, t, "user", rng.choice("abc")) for t in range(150)] + [(0, 500, "user", "same turn")] * 100 + [(c, t, "user", "same") for c in range(1, 9000, 2) for t in range(2)]
    rows += [(c, t, "user", "same" if t == 0 else str(c % 50)) for c in range(10_000, 10_200) for t in range(4)]
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = tree(conversations.trie(spark.createDataFrame(rows, TURNS).repartition(4)))
        few = tree(conversations.trie(spark.createDataFrame(rows[:250] + rows[-60:], TURNS).repartition(4)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_trie(rows) and few == brute_trie(rows[:250] + rows[-60:])


def test_arithmetic_modulo_primes():
    rng = np.random.default_rng(1)
    for prime in (conversations.PRIME, 13, (1 << 31) - 1):
        a, b = (rng.integers(0, prime, 1000, dtype=np.uint64) for _ in range(2))
        a[0], b[0] = prime - 1, prime - 1
        assert conversations.mulmod(a, b, prime).tolist() == [int(x) * int(y) % prime for x, y in zip(a, b, strict=True)]
        e = np.concatenate([np.arange(70), rng.integers(0, 1 << 40, 200)])
        base = 1_234_567_891_011
        assert conversations.powers(base, e, prime).tolist() == [pow(base, int(x), prime) for x in e]


def whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(1024 * struct.unpack("f", struct.pack("f", x))[0]) for x in v]


def brute_clusters(rows, k=8, rounds=10, size=64):
    kept = [(i, w) for i, v in rows if (w := whole(v)) is not None and len(w) == size]
    digest = lambda w: hashlib.sha256(np.array(w, dtype="<i4").tobytes()).digest()
    begin = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"3:{x[0]}".encode()).hexdigest() if x[0] is not None else "", digest(x[1])))[:k]
    centres = [w for _, w in begin]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda w: min(range(len(centres)), key=lambda c: (far(w, centres[c]), c))
    for _ in range(rounds):
        at = [place(w) for _, w in kept]
        for c in range(len(centres)):
            of = [w for (_, w), p in zip(kept, at, strict=True) if p == c]
            if of:
                centres[c] = [sum(xs) // len(of) for xs in zip(*of, strict=True)]
    at = [place(w) for _, w in kept]
    d = [far(w, centres[p]) for (_, w), p in zip(kept, at, strict=True)]
    inertia = defaultdict(int)
    for p, x in zip(at, d, strict=True):
        inertia[p] += x
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), p, x, inertia[p], sum(d), sha[p]) for (i, _), p, x in zip(kept, at, d, strict=True))


def clustered(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def cloud(seed, n, size=64, copies=0):
    rng = random.Random(seed)
    centres = [[rng.uniform(-0.5, 0.5) for _ in range(size)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in centres[i % 5]]) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(copies)]


HALF = [0.5] * 64
ODD_VECTORS = [
    (1, None), (2, []), (3, [0.5] * 63), (4, [0.5] * 65), (5, [0.5] * 63 + [None]), (6, [0.5] * 63 + [float("nan")]), (7, [0.5] * 63 + [float("inf")]), (8, [-0.0001] * 64), (None, HALF), (None, [0.1] * 64),
    (10, HALF), (10, HALF), (10, [0.25] * 64), (200, [100.0] * 64), (300, [-100.0] * 64), (0, HALF), (-100, [0.0] * 64), (11, [-0.5, 0.5] * 32), (12, [0.0004883, -0.0004883] * 32),
]


@pytest.mark.parametrize("rows", [ODD_VECTORS, ODD_VECTORS[8:11], ODD_VECTORS[:8], cloud(1, 120, copies=150)])
def test_clusters(spark, rows):
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert clustered(clustering.clusters(frame)) == brute_clusters(rows)
    clashing = frame.withColumns({c: F.lit(7) for c in ("cluster", "n", "key", "vector", "distance", "label")})
    assert clustered(clustering.clusters(clashing)) == brute_clusters(rows)


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert clustering.clusters(none).count() == 0
    assert clustering.clusters(spark.createDataFrame([(1, None), (2, [1.0])], VECTORS)).count() == 0


def test_clusters_of_heavy_vectors_are_looked_up(spark, monkeypatch):
    """Beyond the broadcast bound heavy vectors are looked up apart; sums that overflow a long are exact."""
    from tesserae.llm import common

    monkeypatch.setattr(common, "BROADCAST_KEYS", 3)
    monkeypatch.setattr(common, "HEAVY_ROWS", 2)
    monkeypatch.setattr(clustering, "SAFE", 1 << 20)
    rows = cloud(2, 60, copies=80)
    assert clustered(clustering.clusters(spark.createDataFrame(rows, VECTORS))) == brute_clusters(rows)


def test_huge_components_are_clipped():
    import pyarrow as pa

    sound, starts, ints = vectors.quantised(pa.array([[1e30, -1e30, 131072.0, 0.9999], None, []], pa.list_(pa.float64())))
    assert sound.tolist() == [True, False, True] and ints.tolist() == [1 << 27, -(1 << 27), 1 << 27, 1023] and starts.tolist() == [0, 4, 4, 4]


def brute_top(rows, k=10, every=100):
    kept = [(i, w) for i, v in rows if (w := whole(v)) is not None]
    asking = {}
    for i, w in kept:
        if i is not None and i % every == 0:
            asking[i] = min(asking.get(i, w), w)
    out = []
    for q, v in asking.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i is None, i or 0) for i, w in kept if i != q)[:k]
        out += [(q, rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(scored)]
    return sorted(out)


def best(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("shard", [1 << 20, 256])
@pytest.mark.parametrize("rows", [ODD_VECTORS, cloud(3, 900, size=16, copies=300), [(i, [0.0] * 30 + [float(i % 7 - 3)] * (i % 3)) for i in range(400)], [(100, HALF)]])
def test_top_k(spark, monkeypatch, rows, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    frame = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({c: F.lit(7) for c in ("rank", "score", "query_id", "label")})
    assert best(topk.top_k(frame)) == brute_top(rows)


def test_queries_in_blocks(spark, monkeypatch):
    rows = cloud(4, 600, size=8)
    monkeypatch.setattr(topk, "BLOCK", 40)
    assert best(topk.top_k(spark.createDataFrame(rows, VECTORS), every=20)) == brute_top(rows, every=20)
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    assert topk.top_k(spark.createDataFrame([(5, [1.0])], VECTORS)).count() == 0


def test_terms_are_left_out():
    """With a threshold, few rows are scored on all terms, and none that may be among the best is lost."""
    rng = np.random.default_rng(7)
    rows = rng.integers(-400, 400, (5000, 64))
    rows[rng.random((5000, 64)) < 0.8] = 0
    shard = topk.Shard(np.arange(5000), np.zeros(5000, dtype=bool), rows)
    assert sum(at is not None for at, _ in shard.postings) == 64
    for query in rng.integers(-400, 400, (20, 64)):
        scores = rows @ query
        threshold = int(np.sort(scores)[-10])
        found, got = shard.competing(query, threshold)
        assert sorted(zip(found.tolist(), got.tolist(), strict=True)) == [(i, int(scores[i])) for i in np.flatnonzero(scores >= threshold)]
        assert len(shard.competing(query, 1 << 40)[0]) == 0
