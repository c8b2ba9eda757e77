"""Findings on the join of near copies: disk of a run, time of the shingles."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from harmonium.llm import jaccard_join
from harmonium.llm.common import words
from harmonium.session import shared_folder


def test_tables_nobody_reads_any_more_are_deleted(spark):
    """Before: keys, pairs, hashes and edges of every round stayed on disk until the application ended, and all shuffle files beside them."""
    rng = random.Random(3)
    base, rows = [f"w{rng.randrange(5000)}" for _ in range(80)], []
    for i in range(30):
        text = list(base) if i % 3 else [f"own{i}x{j}" for j in range(40)]
        text[rng.randrange(len(text))] = f"new{i}"
        rows.append((i, " ".join(text)))
    folder = Path(shared_folder(spark).removeprefix("file:")) / "harmonium" / spark.sparkContext.applicationId
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    join = jaccard_join.JaccardJoin().fit(spark.createDataFrame(rows, "doc_id long, text string"))
    left = [p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before]
    assert not {"keys", "pairs", "hashes", "wanted", "within"} & set(left), left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert {r.doc_id: r.component_id for r in join.membership.collect()} == {i: 1 if i % 3 else i for i in range(30)}


def test_texts_are_hashed_together_as_one_by_one(monkeypatch):
    """Shingles of many texts in one pass (before: each word by itself): the same sets as of every text alone, whatever the blocks."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abABÉé\x1c\x85\udc80漢") for _ in range(rng.choice([1, 2, 5, 90])))
    vocabulary = [word() for _ in range(40)]
    texts = [rng.choice(" \t\n\x0b\r ").join(rng.choices(vocabulary, k=rng.randrange(30))) + rng.choice(["", " ", "\x0c"]) for _ in range(80)]
    texts += [None, "", " \t", "a", " b", "A b c d E", "a B C D e", "a b c d e f", "x" * 3000 + " y"]
    want = [len({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}) if (w := words(t)) else 0 for t in texts]
    together = jaccard_join.shingle_sets(texts)
    assert [len(h) for h in together] == want
    assert all(np.array_equal(h, jaccard_join.shingles(t)) and np.array_equal(h, np.unique(h)) for h, t in zip(together, texts, strict=True))
    assert np.array_equal(together[-4], together[-3]) and not np.array_equal(together[-4], together[-2])
    different = {w for t in texts for w in words(t)}
    assert len({int(h) for w in different for h in jaccard_join.shingles(w.decode("utf-8", "surrogatepass"))}) == len(different)
    monkeypatch.setattr(jaccard_join, "HASHED_BYTES", 64)
    jaccard_join._powers.cache_clear()
    assert [len(h) for h in jaccard_join.shingle_sets(texts)] == want
    jaccard_join._powers.cache_clear()
