"""Findings of round 3 on the text operators."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from harmonium.llm import common, jaccard_join, sentencepiece, vector_search


@pytest.mark.parametrize(("rows", "queries", "d", "spread"), [(1, 2, 64, 1.0), (5, 3, 64, 1.0), (9, 4, 10, 1.0), (600, 150, 64, 1.0), (600, 150, 70, 0.05)])
def test_queries_of_a_list_advance_together(rows, queries, d, spread):
    """One call for all queries of a list, near rows and ties whole (before: one pass and one table per query and list)."""
    rng, k = np.random.default_rng(rows), 6
    centres = rng.standard_normal((5, d))
    v = vector_search.unit(centres[rng.integers(0, 5, rows)] + spread * rng.standard_normal((rows, d)))
    q = vector_search.unit(centres[rng.integers(0, 5, queries)] + spread * rng.standard_normal((queries, d)))
    q[0] = v[0]
    if rows > 100:
        v[10:20] = v[3]
        q[1] = v[3]
    at, found = vector_search.survivors(q, v, k)
    distance = ((q[:, None] - v) ** 2).sum(2)
    for i in range(queries):
        last = np.sort(distance[i])[min(k, rows) - 1]
        assert sorted(found[at == i]) == np.flatnonzero(distance[i] <= last + 1e-9).tolist()
    exact = [float(q[i] @ v[j] / np.sqrt((q[i] @ q[i]) * (v[j] @ v[j]))) for i, j in zip(at, found, strict=True)]
    assert np.allclose(vector_search.cosines(q * 1e200, v * 1e-200, at, found), exact, rtol=0, atol=1e-12)


def test_near_copies_are_joined_before_their_pairs_are_formed(spark, monkeypatch):
    """Of a cluster in which a few in a hundred pairs link, the pairs that are verified grow with its size (before: with the square)."""
    rng = random.Random(5)
    base, rows = [f"w{rng.randrange(20_000)}" for _ in range(150)], []
    for i in range(500):
        text = list(base)
        for _ in range(rng.choice([2, 2, 3, 3])):
            text[rng.randrange(150)] = f"w{rng.randrange(20_000)}"
        rows.append((i, " ".join(text)))
    seen, verified = [], jaccard_join.JaccardJoin._verified

    def counted(self, pairs, texts):
        seen.append(pairs.count())
        return verified(self, pairs, texts)

    monkeypatch.setattr(jaccard_join.JaccardJoin, "_verified", counted)
    got = jaccard_join.JaccardJoin().fit(spark.createDataFrame(rows, "doc_id long, text string")).membership.collect()
    sets = [set(jaccard_join.shingles(t).tolist()) for _, t in rows]
    root, links = list(range(len(rows))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(rows))}
    # the last call has the pairs across components
    assert links > 4 * len(rows) and seen[-1] < links, (links, seen)


def test_batches_are_bounded_by_bytes(spark):
    """Texts of 100,000 characters do not make a batch of 1,024 of them (before: 20 MB here)."""
    common.prepared(spark)
    rows = spark.range(200, numPartitions=1).selectExpr("repeat('word ', 20000) as text")

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_pydict({"n": [part.nbytes]})

    assert rows.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] <= 3 << 20


def test_paths_of_chunks_stand_in_arrays(monkeypatch):
    """A gather of texts is put together from arrays, and what is remembered stays bounded (before: Python objects for each chunk of a text)."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdethos\u00e9-\u6f22\u0378\U0001f600") for _ in range(rng.choice([1, 3, 5, 8, 80])))
    vocabulary = [word() for _ in range(700)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(90)] + [None, "", " ", "\n\t", "a" * 300]
    whole = list(sentencepiece.PieceModel().segmentations(texts, 4))
    for name, value in (("REMEMBERED", 100), ("REMEMBERED_CHARS", 2000), ("GATHERED", 500), ("TOGETHER", 2), ("ABREAST", 3)):
        monkeypatch.setattr(sentencepiece, name, value)
    small = sentencepiece.PieceModel()
    assert list(small.segmentations(texts, 4)) == whole and all(equal for _, equal in whole)
    for _ in range(40):
        list(small.segmentations(texts[-4:], 4))
    assert len(small._number) <= 100 + 310 and len(small._number) == len(small._scores) == len(small._first) == len(small._met)
    alone = sentencepiece.PieceModel()
    for text, (found, _) in zip(texts, whole, strict=True):
        if text:
            assert found[0][1] == b"".join(alone.best(c)[0] for c in alone.chunks(" " + text))
            assert found[0][0] == sum(alone.best(c)[1] for c in alone.chunks(" " + text))
