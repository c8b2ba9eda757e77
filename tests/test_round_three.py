"""Tests of the third round's findings."""

from __future__ import annotations

import numpy as np
import pytest

from harmonium import session
from harmonium.operators import factors, scoring, splits
from harmonium.operators.feature_training import Adagrad


def test_split_is_written_in_many_small_tasks(spark, monkeypatch):
    seen = []
    write = splits.materialise

    def watched(df, name, by=None):
        seen.append({c: spark.conf.get(c, None) for c in session.FINE_SETTINGS})
        return write(df, name, by)

    monkeypatch.setattr(splits, "materialise", watched)
    before = {c: spark.conf.get(c, None) for c in session.FINE_SETTINGS}
    rows = [(u, i) for u in range(40) for i in range(10)] + [(None, 1)] * 3
    out = splits.user_stratified_split(spark.createDataFrame(rows, "userID long, artistID long"))
    assert seen and all(s == session.FINE_SETTINGS for s in seen)
    assert {c: spark.conf.get(c, None) for c in session.FINE_SETTINGS} == before
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 281, "test": 81, "val": 41}


def test_top_items_leave_out_item_blocks_below_a_users_list(spark, monkeypatch):
    rng = np.random.default_rng(4)
    users = spark.createDataFrame([(u, rng.normal(size=4).tolist(), float(u % 3)) for u in range(30)] + [(None, [0.5] * 4, 0.0)], "userID long, factors array<double>, bias double")
    rows = [(i, rng.normal(size=4).tolist(), float(i % 10) * 4) for i in range(400)] + [(7, [0.0] * 4, 36.5), (900, [1.0] * 4, 36.0), (901, [1.0] * 4, 36.0)]
    items = spark.createDataFrame(rows, "artistID long, factors array<double>, bias double")
    barred = spark.createDataFrame([(u, i) for u in range(0, 30, 2) for i in (9, 19, 29, 900, 5000)], "userID long, artistID long")
    for exclude in (None, barred):
        expected = scoring.top_items(users, items, 3, exclude).collect()
        with monkeypatch.context() as small:
            for name, size in (("USER_BLOCK", 8), ("ITEM_BLOCK", 20), ("BOUNDED_FROM", 50)):
                small.setattr(scoring, name, size)
            pairs, whole = [], scoring._block_pairs

            def counted(u, i, *names):
                out = whole(u, i, *names)
                pairs.append((out.count(), out.sparkSession, u, i))
                return out

            small.setattr(scoring, "_block_pairs", counted)
            got = scoring.top_items(users, items, 3, exclude).collect()
        key = lambda r: (r["userID"] is not None, r["userID"], r["rank"])
        assert [(r["userID"], r["artistID"], r["rank"], round(r["score"], 9)) for r in sorted(got, key=key)] == \
            [(r["userID"], r["artistID"], r["rank"], round(r["score"], 9)) for r in sorted(expected, key=key)]
        assert 0 < pairs[-1][0] < 4 * 20 / 2


def test_training_without_features_does_not_copy_all_items_for_every_batch(monkeypatch):
    rng, asked = np.random.default_rng(2), []
    users, items = np.sort(rng.integers(0, 50, 3000)), rng.integers(0, 4000, 3000)
    u, f = (Adagrad(rng.normal(size=(n, 9)), np.ones((n, 9)), 0.05) for n in (50, 4000))
    whole = factors._Own.vectors

    def watched(self, rows, table):
        out = whole(self, rows, table)
        asked.append((len(self), out.size // 9))
        return out

    monkeypatch.setattr(factors._Own, "vectors", watched)
    before = u.values.copy()
    factors._train_bucket(users, factors._Own(items), items, np.ones(3000), factors._Own(np.arange(4000)), np.arange(4000), u, f, "bpr", 4000, rng)
    assert not np.allclose(before, u.values) and all(taken <= factors._BATCH for _, taken in asked)


def test_adagrad_adds_up_equal_rows_before_it_moves_them():
    rng = np.random.default_rng(3)
    for rows in (rng.integers(0, 5, 40), np.zeros(0, np.int64)):
        grads, table = rng.normal(size=(len(rows), 3)), Adagrad(np.zeros((6, 3)), np.ones((6, 3)), 0.1)
        total = np.zeros((6, 3))
        np.add.at(total, rows, grads)
        table.step(rows, grads)
        assert np.allclose(table.values, -0.1 * total) and np.allclose(table.squares, 1 + total * total)


@pytest.mark.parametrize("scale", [1.0, 1e-160, 1e160, 1e300])
def test_area_counts_are_exact_without_every_ordered_sum(scale, monkeypatch):
    """Only scores within rounding of a wanted one are added up in order (before: those of all items)."""
    rng = np.random.default_rng(3)
    u, v, bias = rng.standard_normal((30, 20)) * min(scale, 1e150), rng.standard_normal((400, 20)), rng.standard_normal(400) * scale
    v[50:90], bias[50:90] = v[7], bias[7]
    v[200] = 0.0
    exact = np.zeros((30, 400))
    for x, y in zip(u.T, v.T, strict=True):
        exact += np.multiply.outer(x, y)
    exact += bias
    sums, added = scoring._ordered_sums, []
    monkeypatch.setattr(scoring, "_ordered_sums", lambda a, b: added.append(len(b)) or sums(a, b))
    wanted = [(r, exact[r, [7, 60, 3, 200]]) for r in range(0, 30, 2)]
    got = list(scoring._below(u, v, bias, wanted))
    for (r, part), (less, upto) in zip(wanted, got, strict=True):
        assert [(exact[r] < x).sum() for x in part] == less.tolist() and [(exact[r] <= x).sum() for x in part] == upto.tolist()
    assert scale >= 1e300 or sum(added) < exact.size / 2
