"""The whole pipeline against the contracts of its stages in plain Python, one after the other."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from . import brute
from .test_operators import BASE, EDGE, SCHEMA, check_packing

CLASHING = ("doc", "t", "found", "hidden", "size", "target", "kept", "m0", "position", "copy", "removed_id", "n", "key", "__t", "sequence_id", "a.b")


def rows():
    rng = random.Random(17)
    words = [f"word{i}" for i in range(900)] + ["the", "of", "and", "to"] * 60
    texts = list(EDGE)
    for i in range(60):
        ws = rng.choices(words, k=rng.choice([25, 60, 150, 400]))
        texts.append(" ".join(ws))
        if i % 3 == 0:  # a near copy, and an exact one
            texts += [" ".join([*ws[:-1], "changed"]), " ".join(ws)]
        if i % 5 == 0:
            texts.append(" ".join(rng.choices(words, k=40)) + "\nid QWERTYUIOPASDFGHJK12 key wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY\npassword=correcthorse1\n" + " ".join(rng.choices(words, k=10)))
    texts.append("the of and " + "many words and the like of it " * 4000 + " ".join(rng.choices(words, k=30_000)))
    made = [(3 * i, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    made += [made[40], made[40], (None, BASE.replace("w3 ", "z3 "), "en", "s1", 9), (None, None, None, None, None)]
    rng.shuffle(made)
    return made


def redacted(text):
    """The text with all spans but endpoints masked, overlapping ones by one."""
    out, at = [], 0
    for _, s, e in sorted((x for x in brute.secrets_all(text) if x[0] != "endpoint"), key=lambda x: (x[1], x[2])):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3).withColumns({c: F.concat(F.lit("clash "), F.col("doc_id")) for c in CLASHING})
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_pipeline_as_by_plain_python(spark, tables, tmp_path):
    docs, outs = spark.read.parquet(f"{tables}/documents.parquet"), []
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        outs.append([tuple(r[c] for c in ("doc_id", "text", "source")) for r in docs.collect()] if i < 4 else docs)
        if i < 4:
            assert docs.columns == columns
            assert docs.filter(" or ".join(f"`{c}` is distinct from 'clash ' || doc_id" for c in CLASHING)).count() == 0
    # 1. quality rules
    now = [(d, t, s) for d, t, _, s, _ in rows() if brute.quality_kept(t)]
    assert Counter(outs[0]) == Counter(now) and len(now) > 80
    # 2. near-duplicates
    label = brute.components(sorted({d: t for d, t, _ in now if d is not None}.items()), 5)
    now = [(d, t, s) for d, t, s in now if d is None or label[d][1] == d]
    assert Counter(outs[1]) == Counter(now) and len(now) < len(outs[0]) - 30
    # 3. secrets
    now = [(d, redacted(t), s) for d, t, s in now]
    assert Counter(outs[2]) == Counter(now) and sum("[SECRET]" in t for _, t, _ in now) >= 10
    # 4. mixing: each source's words reach its target, in whole copies but for one document
    _, goals = brute.targets(now)
    texts, taken, cut = defaultdict(set), Counter(), defaultdict(set)
    for d, t, s in now:
        texts[d].add(t)
    for d, t, s in outs[3]:
        taken[s] += len(brute.WORD.findall(t))
        if t not in texts[d]:
            assert any(whole.startswith(t) for whole in texts[d])
            cut[s].add(d)
    assert all(abs(taken[s] - goals[s]) <= 1 for s in goals) and all(len(c) <= 1 for c in cut.values())
    copies = Counter((d, s) for d, _, s in outs[3])
    held = Counter((d, s) for d, _, s in now)
    assert all(n <= 3 * held[k] for k, n in copies.items())
    # 5. packing: every copy's ids, whole and in order
    pieces = outs[4].collect()
    counted = Counter(r["doc_id"] for r in pieces if r["start"] == 0)
    assert counted == Counter(d for d, _, _ in outs[3])
    want = Counter()
    from tesserae.llm.packing import WordIds

    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    ids = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for (d, _, _), stream in zip(outs[3], ids.streams(pa.array([t for _, t, _ in outs[3]])), strict=True):
        want[d] += len(np.frombuffer(stream, dtype="<u4")) + 1
    got = Counter()
    for r in pieces:
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_pieces_of_the_pipelines_last_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id is not null").dropDuplicates(["doc_id"])
    out = corpus_pipeline.packed(spark, docs, tables)
    assert check_packing(out.collect(), docs) < 0.02


def test_run_is_the_stages_and_leaves_one_table(spark, tables, tmp_path):
    import os

    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 50
    assert [x for x in set(os.listdir(shared)) - before if x.startswith("pipeline-")] == [out.inputFiles()[0].rsplit("/", 2)[1]]
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
