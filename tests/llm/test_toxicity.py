"""The toxicity classifier: held-out rows, counts by brute force, long texts, edges."""

import math
import zlib
from collections import Counter

import numpy as np
from conftest import DATA

from creditpath.llm import queries as llm_queries
from creditpath.llm import toxicity as tox

DOCS = "doc_id long, text string"
LABELS = "doc_id long, toxic int"


def grams(text):
    text = "".join(" " if ord(c) < 33 else c for c in f" {text.lower()} ")
    return {text[i : i + n] for n in tox.SIZES for i in range(len(text) - n + 1)}


def place(gram):
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c)) % 2**32
    return (((h ^ len(gram)) * 0x9E3779B1) % 2**32) >> 12


def test_places_against_brute_force(monkeypatch):
    texts = ["", "A", "ab", "Fool!\n\tyou fool", "ünïcode 😀 text " * 30, "xyz" * 200]
    for block in (tox.BLOCK, 50, 7):
        monkeypatch.setattr(tox, "BLOCK", block)
        for text in texts:
            assert sorted(tox.places_of(text).tolist()) == sorted({place(g) for g in grams(text)})
            assert len(tox.places_of(text)) == len(set(tox.places_of(text).tolist()))


def test_counts_and_ratios_against_brute_force(spark):
    rows = [("some fool here", 1), ("a fool", 1), ("a nice day", 0), ("a day", 0), (None, 0), ("fool fool", 1)]
    counts = tox.place_counts(spark.createDataFrame(rows, "text string, toxic int").repartition(3))
    want = {1: Counter(), 0: Counter()}
    for text, kind in rows:
        want[kind].update({place(g) for g in grams(text or "")})
    got = {r["place"]: (r["toxic"], r["other"]) for r in counts.collect()}
    assert got == {p: (want[1][p], want[0][p]) for p in want[1] | want[0]}
    places, ratio = tox.log_count_ratios(counts)
    p_sum = sum(a + 0.5 for a, _ in got.values())
    q_sum = sum(b + 0.5 for _, b in got.values())
    for at, value in zip(places.tolist(), ratio):
        a, b = got[at]
        assert math.isclose(value, math.log((a + 0.5) / p_sum) - math.log((b + 0.5) / q_sum), rel_tol=1e-12)
    assert place("fool") in places.tolist()


def made(n=400):
    """Documents of which every fifth has a slur, in a form that differs from row to row."""
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioubdgklmnprst"), 5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [words[k] for k in rng.integers(0, 300, 40)]
        if i % 5 == 0:
            text[rng.integers(0, 40)] = f"zwekkort{words[rng.integers(0, 300)][:2]}"
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 5 == 0)))
    return docs, labels


def test_learns_a_word_stem(spark):
    docs, labels = made()
    found = tox.toxicity(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    rows = found.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["doc_id"] % 5 == 0), r
        assert r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1


def test_labels_of_the_held_out_third_teach_nothing(spark):
    docs, labels = made(200)
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    turned = [(i, 1 - t if i in held else t) for i, t in labels] + [(None, 1), (3, None), (4, 7)]
    docs = spark.createDataFrame(docs, DOCS)
    first, second = (
        {r["doc_id"]: r["score"] for r in tox.toxicity(docs, spark.createDataFrame(some, LABELS)).collect()}
        for some in (labels, turned)
    )
    assert first == second


def test_edges(spark):
    docs, labels = made(100)
    extra = [(None, "zwekkort"), (1000, None), (1001, ""), (1001, ""), (1002, "nothing " * 200_000 + "you zwekkortba"), (0, docs[0][1])]
    both = spark.createDataFrame([(*r, 0.5, "a") for r in docs + extra], DOCS + ", score double, toxic string")
    rows = tox.toxicity(both, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs) + len(extra) and set(rows[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    by_id = {r["doc_id"]: r for r in rows}
    assert not by_id[None]["held_out"] and by_id[1002]["predicted"] == 1 and by_id[1000]["score"] == by_id[1001]["score"]
    assert tox.toxicity(both.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []
    one_kind = tox.toxicity(both, spark.createDataFrame([(1, 0)], LABELS)).collect()
    assert {(r["score"], r["predicted"]) for r in one_kind} == {(0.5, 0)}


def test_query_on_held_out_rows(spark):
    folder = f"{DATA}/sf0.1"
    rows = llm_queries.op12_toxicity(spark, folder)
    known = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    counted = rows.where("held_out").join(known, "doc_id").groupBy("toxic", "predicted").count().collect()
    seen = {(r["toxic"], r["predicted"]): r["count"] for r in counted}
    # Some of the labels are noise: such texts have nothing that tells them apart.
    assert seen[1, 1] / (seen[1, 1] + seen[1, 0]) > 0.8
    assert seen.get((0, 1), 0) / seen[0, 0] < 0.01
    assert rows.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
