"""Content sort, count streams and segment bounds against brute force, over ranges that cut groups, and their edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from harmonium.llm.collocations import Collocations, count_phrases, tokens
from harmonium.llm.content_sort import LOWER, UPPER, ContentSort
from harmonium.llm.hard_negatives import HardNegatives, Scan, exact_scores, levels, summaries


@pytest.fixture
def many_ranges(spark):
    """Sorted ranges that Spark doesn't merge, so that groups go on over their borders."""
    settings = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in settings}
    for n, v in settings.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


# -- content sort ---------------------------------------------------------------

FOLD = str.maketrans(UPPER, LOWER)


def brute_groups(rows, largest=True):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(FOLD)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known, default=None)
        ordered = sorted(known, reverse=largest) + [None] * (len(ids) - len(known))
        out += [(i, keep, len(ids), place == 0, hashlib.sha256(text.encode()).hexdigest()) for place, i in enumerate(ordered)]
    return collections.Counter(out)


@pytest.mark.parametrize("largest", [True, False])
def test_content_sort_equals_brute_force(many_ranges, largest):
    rng = random.Random(3)
    long_text = "word " * 100_000
    rows = [(i, rng.choice(["Hot", "hOT", "hot", "x", "", None, "Ä", "ä", "same beginning " * 9 + str(rng.randrange(4))]) if rng.random() < 0.9 else str(i)) for i in range(-50, 1500)]
    rows += [(None, "hot"), (None, "solo"), (None, "solo"), (5, "dup"), (5, "dup"), (9998, long_text), (9999, long_text.upper()), (10_000, long_text + "!")]
    df = many_ranges.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, norm string, id int").repartition(7)
    out = ContentSort(keep_largest=largest).transform(df)
    assert out.columns == ["id", "keep", "size", "kept", "digest"]
    assert collections.Counter(map(tuple, out.collect())) == brute_groups(rows, largest)
    kept = ContentSort(keep_largest=largest).deduplicated(df)
    assert kept.columns == ["doc_id"] and kept.count() == len({(t or "").translate(FOLD) for _, t in rows})


def test_content_sort_splits_a_text_that_all_rows_share(many_ranges):
    df = many_ranges.range(2000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"))
    rows = ContentSort().transform(df).collect()
    assert {(r["keep"], r["size"]) for r in rows} == {(1999, 2000)} and [r["id"] for r in rows if r["kept"]] == [1999]


def test_content_sort_of_an_empty_table(spark):
    assert ContentSort().transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- collocations ---------------------------------------------------------------

def brute_collocations(rows, shortest=2, longest=3, least=10, inside=50, top=2000):
    counts = collections.defaultdict(collections.Counter)
    total = collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        covered = collections.defaultdict(int)
        for p, a in cands.items():
            for i, j in itertools.combinations(range(len(p) + 1), 2):
                if j - i < len(p):
                    covered[p[i:j]] = max(covered[p[i:j]], a)
        found = []
        for p, a in cands.items():
            if len(p) >= shortest and not 100 * covered[p] >= inside * a:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "a\x01", "a", "é", "new", "york", "City", "漢字", "x\x00y", "b", "-", "'"]
    return [("".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", " ", ". ", "\n", "?!"]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "en", "fr", None])) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"longest": 4, "least": 5, "inside": 80, "top": 30}, {"shortest": 3, "least": 2}])
def test_collocations_equal_brute_force(many_ranges, options):
    rows = texts(160, 4) + [(None, "en"), ("", None), (" \t\n", "fr"), ("New York City " * 4000, "en"), ("one", "de")]
    df = many_ranges.createDataFrame([(t, lang, "p", 1) for t, lang in rows], "text string, lang string, phrase string, n int").repartition(5)
    out = Collocations(**options, held_words=700, bucket_chars=5000).mine(df)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == brute_collocations(rows, **options)


def test_collocations_of_nothing(spark):
    assert Collocations().mine(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert Collocations().mine(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def test_phrases_of_long_texts():
    words = list(tokens("a b " * 5 + "! c")) + list(tokens(""))
    got = {p.decode(): int(n) for phrases, _, counts in count_phrases(words, 3) for p, n in zip(phrases.to_pylist(), counts, strict=True)}
    assert got == {"a ": 5, "b ": 5, "c ": 1, "a b ": 5, "b a ": 4, "a b a ": 4, "b a b ": 4}


def test_scores_beyond_64_bits(spark):
    """1,000,000 * a * a passes 64 bits from about three million occurrences on; the counts are given here."""
    class Given(Collocations):
        def counts(self, docs):
            return docs

    a, x, y = 3_000_000_007, 4_000_000_019, 9_000_000_011
    phrases = spark.createDataFrame([("en", "", 0, 10**14), ("en", "x ", 1, x), ("en", "y ", 1, y), ("en", "x y ", 2, a)], "lang string, phrase string, words int, n long")
    assert [tuple(r) for r in Given().mine(phrases).collect()] == [("en", 1, "x y", a, x, y, 10**14, 10**6 * a * a // (x * y))]


# -- hard negatives -------------------------------------------------------------

def brute_negatives(rows, anchors, positives=5, negatives=5, low=80, high=100, scale=256):
    known = {}
    for i, label, v in sorted((r for r in rows if None not in r and r[2] and all(x is not None and math.isfinite(x * scale) for x in r[2])), key=lambda r: (r[0], r[1], r[2])):
        known.setdefault(i, (label, [math.floor(scale * x) for x in v]))
    dot = lambda a, b: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))
    out = []
    for i, (label, v) in known.items():
        if not anchors(i):
            continue
        others = sorted((-dot(v, w), j, other) for j, (other, w) in known.items() if j != i and len(w) == len(v))
        for s, j, _ in [o for o in others if o[2] == label][:positives]:
            fits = [o for o in others if o[2] != label and low * -s <= 100 * -o[0] <= high * -s][:negatives]
            out += [(i, j, r + 1, o[1], -s, -o[0]) for r, o in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"positives": 2, "negatives": 3, "low": 10, "high": 130, "scale": 8}, {"block": 3, "chunk": 20, "finest": 1}])
def test_hard_negatives_equal_brute_force(spark, options):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, None]), [float(np.float32(rng.gauss(0, 1) + (i % 3))) for _ in range(10)]) for i in range(300)]
    rows += [(i, i % 2, [0.5, -0.25, 1.0]) for i in range(300, 340)]  # ties, another length
    rows += [(400, 1, None), (401, 1, []), (402, None, [1.0] * 10), (None, 1, [1.0] * 10), (403, 1, [None] + [1.0] * 9), (404, 1, [float("nan")] * 10), (405, 0, [float("inf")] * 10),
             (406, 0, [0.0] * 10), (410, 0, [1e7] * 10), (420, 0, [1e300] * 10), (421, 1, [1e300] * 10), (430, 0, [-1e7] * 10), (440, 7, [1.0] * 10), rows[10], (20, 0, [9.0] * 10)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, block int, score int")
    plain = {k: v for k, v in options.items() if k not in ("block", "chunk", "finest")}
    out = HardNegatives(**options).mine(df, F.col("vec_id") % 10 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = brute_negatives(rows, lambda i: i % 10 == 0, **plain)
    assert expected and sorted(map(tuple, out.collect())) == expected


def test_hard_negatives_of_nothing(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert HardNegatives().mine(spark.createDataFrame([], schema), F.col("vec_id") == 0).count() == 0
    assert HardNegatives().mine(spark.createDataFrame([(0, 1, [1.0])], schema), F.col("vec_id") == 0).count() == 0


def test_bounds_hold_at_every_level_and_spare_exact_scores():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 300, (20, 16)).repeat(4, 1)
    x = np.floor(centres[rng.integers(0, 20, 2000)] + rng.normal(0, 8, (2000, 64)))
    a = x[0]
    true = x @ a
    widths = []
    for borders in levels(64):
        (m, s), (ma, sa) = summaries(x, borders), summaries(a[None, :], borders)
        centre, reach = m @ ma[0], s @ sa[0]
        assert (np.abs(true - centre) <= reach + 1e-3).all()
        widths.append(reach.mean())
    assert widths == sorted(widths, reverse=True)
    scan = Scan(np.arange(2000), x)
    at, score = next(scan.best(a, [(-(2**62), 2**62)], 5, np.arange(2000) != 0))
    assert sorted(score, reverse=True) == sorted(true[1:], reverse=True)[:5] and scan.scored < 400


def test_exact_scores_pass_doubles():
    a, rows = np.array([2.0**40 + 1, 3.0]), np.array([[2.0**21 + 1, 5.0], [1e300, 0.0], [-1e300, 0.0]])
    assert exact_scores(a, rows[:1]).tolist() == [(2**40 + 1) * (2**21 + 1) + 15]
    assert exact_scores(a, rows).tolist()[1:] == [2**63 - 1, -(2**63) + 1]


# -- mended operators -----------------------------------------------------------

def test_cosines_of_very_large_and_very_small_numbers(spark):
    from harmonium.llm.vector_search import VectorSearch

    shapes = [[1.0, 2.0, 2.0], [2.0, -1.0, 0.5], [0.0, 3.0, 1.0], [1.0, 1.0, 1.0]]
    rows = [(10 * s + i, [x * scale for x in v]) for s, scale in enumerate((1.0, 1e200, 1e-200)) for i, v in enumerate(shapes)]
    rows += [(90, [5e-324, 1e-323, 1e-323])]  # the smallest numbers there are
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in VectorSearch(k=12).search(df, df).collect()}
    assert len(got) == 13 * 12 and None not in got.values()
    vectors = {i: shapes[i % 10] for i, _ in rows[:-1]} | {90: shapes[0]}
    for (a, b), score in got.items():
        x, y = np.array(vectors[a]), np.array(vectors[b])
        assert score == pytest.approx(x @ y / np.sqrt((x @ x) * (y @ y)), rel=1e-12, abs=1e-12)


def test_scores_keep_every_doc_id(spark):
    from harmonium.llm.class_lm import ClassModel

    text = "one two three one two unseen"
    rows = [(-2, text), (-1, text), (5, "one two three"), (9, text), (4294967301, "one two three"), (None, text), (9, text), (9, "two one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = ClassModel().fit(docs.where("doc_id < 9"))
    got = model.score(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i is None, i or 0, len(t.split()) + 1) for i, t in rows)
    assert len({(r["n_tokens"], round(r["score"], 9), round(r["base_score"], 9)) for r in got}) == 3
