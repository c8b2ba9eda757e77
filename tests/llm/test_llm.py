"""The text operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import collections
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from harmonium.llm import class_lm, fingerprints, html_text, jaccard_join, langid, mixing, revisits, sentencepiece, token_counts, vector_search
from harmonium.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot string, component_id string"
random.seed(7)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


def prose(n, k=40):
    return " ".join(f"{random.choice(WORDS)}{random.randrange(k)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, other columns with clashing names."""
    long_text = prose(6000)
    rows = [
        (1, long_text, "en", "a"), (2, long_text + " more", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \t\n", None, "b"), (6, "one two", "en", "a"), (7, "ONE  two", "fr", None),
        (7, "ONE  two", "fr", None), (None, "one two", "en", "a"), (8, "a b c d e f", "de", "c"), (8, "other text with the same id here", "de", "c"), (9, "!!! 123 ...", "en", "c"), (10, "é▁漢\x00 \U0001f600", "xx", "c"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", "y") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join_equals_brute_force(spark):
    rows = []
    for size in (1, 4, 5, 6, 7, 9, 12, 20, 34, 60, 150, 400):
        base = [f"{w}" for w in prose(size + 4, 200).split()]
        for _ in range(14):
            copy = list(base)
            for _ in range(random.randrange(1 + len(copy) // 25 + 1)):
                copy[random.randrange(len(copy))] = prose(1, 500)
            rows.append(" ".join(copy))
    line = prose(30)
    rows += [line + " " + prose(20) for _ in range(40)] + [line] * 5
    rows = list(enumerate(rows))
    got = jaccard_join.JaccardJoin().fit(spark.createDataFrame(rows, "doc_id long, text string")).membership.collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert len(got) == len(rows)


def linked_at(rows, percent):
    """The smallest id that each text is connected with at this threshold."""
    sets = {i: set(jaccard_join.shingles(text).tolist()) for i, text in rows}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    return group


def test_small_sets_link_by_an_appended_word(spark):
    """Sets of all small sizes with one or two words put before or after them, at several thresholds."""
    for percent in (80, 50, 30, 75, 100):
        rows = []
        for size in range(1, 16):
            base = [f"s{size}x{i}" for i in range(size + 4)]
            rows += [base, [*base, "more"], ["less", *base], [*base, "and", "more"]]
        rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
        got = jaccard_join.JaccardJoin(percent=percent).fit(spark.createDataFrame(rows, "doc_id long, text string")).membership.collect()
        assert {r.doc_id: r.component_id for r in got} == linked_at(rows, percent), percent
    for percent in range(1, 101):
        n = jaccard_join.smallest_linked(percent)
        assert percent == 100 or 100 * n >= percent * (n + 1) and (n == 1 or 100 * (n - 1) < percent * n)
        for r in (1, 2, 3, 5, 9, 40, 333):
            reached = jaccard_join.bands(r, percent)
            assert all(jaccard_join.bands(s, percent)[0] in reached for s in range(r, r * 100 // percent + 1)), (percent, r)


def test_crowded_pairs_are_formed_about_once(spark, monkeypatch):
    """Texts with a common passage: the rows of the crowded join grow no faster than the pairs that differ."""
    base, rows = prose(200, 17).split(), []
    for i in range(40):
        copy = list(base)
        for at in random.Random(i).sample(range(len(copy)), 7):
            copy[at] = f"own{i}x{at}"
        rows.append((i, " ".join(copy)))
    formed = []
    plain = jaccard_join.JaccardJoin._crowded_pairs

    def counted(self, *args):
        found = plain(self, *args)
        formed.append((found.count(), found.distinct().count()))
        return found

    monkeypatch.setattr(jaccard_join, "CROWDED", 1)
    monkeypatch.setattr(jaccard_join, "HUB_ROUNDS", 1)
    monkeypatch.setattr(jaccard_join.JaccardJoin, "_crowded_pairs", counted)
    got = jaccard_join.JaccardJoin().fit(spark.createDataFrame(rows, "doc_id long, text string")).membership.collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert formed and all(n <= 2 * different for n, different in formed)


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    from harmonium.llm.common import slices

    texts = ["a" * n for n in (0, 10, 5000, 20, 30, 3000, 1)]
    parts = list(slices(iter([pa.record_batch([pa.array(texts)], ["text"])]), rows=5, size=1000))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or p.nbytes <= 1000 for p in parts)


def test_crowded_keys_give_the_same_links(spark, monkeypatch):
    base = prose(120, 300).split()
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(4):
            copy[random.randrange(len(copy))] = f"new{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for crowded, rounds, earlier in ((1, 1, 24), (1, 1, 1), (64, 1, 24), (4, 3, 2)):
        monkeypatch.setattr(jaccard_join, "CROWDED", crowded)
        monkeypatch.setattr(jaccard_join, "EARLIER", earlier)
        monkeypatch.setattr(jaccard_join, "HUB_ROUNDS", rounds)
        got = jaccard_join.JaccardJoin().fit(docs).membership.collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_join_edges(odd, empty):
    got = jaccard_join.JaccardJoin().fit(odd).membership.collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[2] == {(by[2].copy().pop()[0], 1)} and by[3] == {(0, 3)} and by[5] == {(0, 5)} and by[7] == {(1, 6)} and by[None] == {(1, None)}
    assert len(by[8]) == 2
    assert jaccard_join.JaccardJoin().fit(empty).membership.count() == 0


def test_every_pair_at_the_threshold_shares_a_point():
    """For pairs of all kinds, the points cover the largest difference whatever is left out."""
    for n in range(2, 400):
        for r in range(math.ceil(0.8 * n), n + 1):
            assert jaccard_join.bands(n)[0] in jaccard_join.bands(r), (n, r)
        m, _ = jaccard_join.band_shape(jaccard_join.bands(n)[0])
        assert m >= jaccard_join.largest_difference(n, n, 80) + 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[300] == 100 and len(got) == 54


def test_near_duplicate_stage_keeps_one_of_each_group(spark, odd):
    kept = jaccard_join.stage_near_duplicates(spark, odd, "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert [i for none, i in ids if not none] == [1, 3, 4, 5, 6, 8, 8, 9, 10] and sum(none for none, _ in ids) == 1


def test_mixing_keeps_every_source_within_a_block(spark, odd, empty):
    shares = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1), ("d", 7)], "source string, share long")
    docs = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(400)], "doc_id long, source string")
    rows = mixing.mixed(docs, shares, block_docs=2).collect()
    assert len({(r.slot, r.place) for r in rows}) == 400
    first = [r for r in rows if r.place == 0]
    assert all(r.release <= r.slot < r.deadline for r in first)
    weight = dict(a=5, b=3, c=1, d=7)
    for t in range(1, 100):
        for s, w in weight.items():
            have = sum(r.source == s and r.slot < t for r in first)
            assert abs(have - t * w / 16) < 1 or have == 50
    assert mixing.mixed(odd).count() == odd.count() and mixing.mixed(empty).count() == 0
    assert mixing.stage_mix(spark, odd, "").count() == odd.count()


def test_nbest_equals_all_paths():
    m = sentencepiece.PieceModel()

    def paths(s, i=0, score=0.0, ids=()):
        if i == len(s):
            yield score, list(ids)
            return
        if s[i] not in m.pieces:
            b = tuple(m.byte_ids[x] for x in s[i].encode())
            yield from paths(s, i + 1, score + m.byte_score * len(b), ids + b)
        for j in range(i + 1, min(len(s), i + m.longest) + 1):
            found = m.pieces.get(s[i:j])
            if found:
                yield from paths(s, j, score + found[1], (*ids, found[0]))

    for _ in range(60):
        text = "".join(random.choice("abthe on é\n▁漢") for _ in range(random.randint(1, 8)))
        want = sorted(paths(" " + text), key=lambda x: -x[0])
        got = m.encode(text, 6)
        assert len(got) == min(6, len(want)) and len({tuple(ids) for _, ids in got}) == len(got)
        assert np.allclose([s for s, _ in got], [s for s, _ in want[: len(got)]])
        assert all(m.decode(ids) == text for _, ids in got)


def test_search_ends_on_long_texts_without_spaces():
    m = sentencepiece.PieceModel()
    letters = random.Random(5)
    for text in ("a" * 100_000, "-" * 20_000, "".join(letters.choice("abcdefghij") for _ in range(100_000)), "the\u0378" * 20_000):
        begun = time.process_time()
        (found, equal), = m.segmentations([text], 4)
        assert time.process_time() - begun < 20
        assert equal and len({ids for _, ids in found}) == 4
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
        assert all(m.decode(np.frombuffer(ids, np.int32)) == text for _, ids in found)


def test_chunks_together_equal_chunks_alone():
    m = sentencepiece.PieceModel()
    letters = random.Random(6)
    chunks = list({" " + "".join(letters.choice("abcdethosé-") for _ in range(letters.randint(1, 9))) for _ in range(3000)} | {" ", "a"})
    by_length: dict = {}
    for c in chunks:
        by_length.setdefault(len(c), []).append(c)
    for some in by_length.values():
        assert list(m.best_of_length(some)) == [m.best(c) for c in some]
    texts = ["".join(letters.sample(chunks, 40)).strip() for _ in range(50)] + [None, "", " ", "\n"]
    alone = [next(iter(sentencepiece.PieceModel().segmentations([x], 4))) for x in texts[:3]]
    assert list(m.segmentations(texts, 4))[:3] == alone


def test_sentencepiece_edges(odd, empty):
    got = sentencepiece.encode(odd).collect()
    assert len(got) == odd.count() and all(r.decoded_equal for r in got)
    assert [len(r.segmentations[0].ids) for r in got if r.doc_id in (3, 4)] == [0, 0]
    assert sentencepiece.encode(empty).count() == 0


def test_sketches_merge_and_contain(spark, odd):
    part, rest = prose(400, 400), prose(4000, 400)
    df = spark.createDataFrame([(part, part + " " + rest)], "a string, b string").select(fingerprints.sketch("a").alias("a"), fingerprints.sketch("b").alias("b"))
    import pyspark.sql.functions as F

    row = df.select(fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.likeness(F.col("a"), F.col("b")).alias("j"), (fingerprints.merge(F.col("a"), F.col("b")) == F.col("b")).alias("m"), F.size("b").alias("n")).first()
    assert row.c == 1.0 and row.j < 0.2 and row.m and 800 < row.n < 1400
    tiny = spark.createDataFrame([("only",), ("",), ("  ",)], "t string").select(fingerprints.sketch("t").alias("s")).collect()
    assert len(tiny[0].s) == 1 and tiny[1].s == [] and tiny[2].s == []


def test_token_counts_against_counting(spark, odd, empty):
    counted = token_counts.encoded_length(odd)
    lengths = [r.n_tokens for r in counted.collect()]
    enc = token_counts.encoding()
    assert lengths == [len(enc.encode_ordinary(r.text)) if r.text else 0 for r in odd.collect()]
    table = token_counts.limits(token_counts.histogram(counted))
    for r in table.collect():
        assert r.docs_over == sum(n > r.n_tokens for n in lengths) and r.kept_tokens == sum(min(n, r.n_tokens) for n in lengths) and r.total_tokens == sum(lengths)
    for limit in (0, 3, 50, 10**6):
        assert token_counts.at_limit(table, limit).first().kept_tokens == sum(min(n, limit) for n in lengths)
    assert token_counts.quantile(table, 0.5).first().n_tokens == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]
    assert token_counts.limits(token_counts.histogram(token_counts.encoded_length(empty))).count() == 0


def test_language_of_held_out_texts(spark, folder):
    docs = langid.document_records(spark.read.parquet(f"{folder}/documents.parquet"))
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    fitted = langid.LanguageIdentifier().fit(train)
    import pyspark.sql.functions as F

    told_nothing = test.withColumn("truth", F.col("declared")).withColumn("declared", F.lit(None).cast("string")).withColumn("host", F.lit(None).cast("string"))
    found = fitted.transform(told_nothing).collect()
    assert np.mean([r.language.lang == r.truth for r in found]) > 0.95


def test_priors_decide_without_text_evidence(spark):
    rows = [(f"{w} {w}er {w}ing and the of", "en", "h.example.org") for w in WORDS * 3] + [(f"{w} und der die {w}ung", "de", "g.example.de") for w in WORDS * 3]
    records = spark.createDataFrame([(t, d, None, h.split(".", 1)[1], h) for t, d, h in rows], "text string, declared string, suffix string, domain string, host string")
    fitted = langid.LanguageIdentifier().fit(records)
    weak = spark.createDataFrame([("a", None, None, "example.org", "h.example.org"), ("a", None, None, "example.de", "g.example.de"), ("123", "en", None, None, None), (None, "en", None, None, None)], records.schema)
    assert [r.language.lang for r in fitted.transform(weak).collect()] == ["en", "de", "und", "und"]


def test_languages_come_from_pages_too(spark, tmp_path):
    """A language that only pages declare is a possible answer, for pages and for documents."""
    say = {"en": "the {} of this and that {} with", "de": "der {} und die {} nicht mit", "it": "gli {} della che sono {} perché"}
    text = lambda lang, i: " ".join(say[lang].format(WORDS[(i + k) % 10], WORDS[(i * 3 + k) % 10]) for k in range(8))
    docs = [(i, text(lang, i), lang, "a") for i, lang in enumerate(["en", "de"] * 20)] + [(100, text("it", 3), None, "b")]
    pages = [(i, f"http://h{i % 4}.example.org/x", f"<html lang='{lang}'><body><script>the = of</script><p>{text(lang, i)}</p></body></html>") for i, lang in enumerate(["en", "it"] * 20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = langid.op6_language_id(spark, str(tmp_path)).collect()
    found = {(r.kind, r.doc_id if r.kind == "document" else r.page_id): (r.lang, r.accepted) for r in rows}
    assert len(rows) == len(found) == 81 and found["document", 100] == ("it", True)
    assert all(found["page", i] == (["en", "it"][i % 2], True) for i in range(40)) and all(found["document", i] == (["en", "de"][i % 2], True) for i in range(40))


def test_language_stage_edges(spark, odd, empty):
    kept = langid.stage_language(spark, odd, "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not {3, 4, 5, 9} & {r.doc_id for r in kept.collect()} and {1, 2} <= {r.doc_id for r in kept.collect()}
    assert langid.stage_language(spark, empty, "").count() == 0


def test_class_model_counts_and_normalises(spark, odd, empty):
    texts = [prose(60, 3) + " end." for _ in range(80)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = class_lm.ClassModel(classes=6, items=16, sweeps=3, local_words=16).fit(docs)
    counts = collections.Counter()
    for t in texts:
        counts.update([*(t or "").lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    assert (model.tokens, model.vocabulary) == (n, v)
    for r in model.score(docs).collect():
        tokens = [*(texts[r.doc_id] or "").lower().split(), None]
        assert r.n_tokens == len(tokens) == r.n_known
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
    # words of a class and its unknown words add to one, and so do the transitions
    assert np.allclose((10**model.log_transition).sum(1), 1)
    by_class = collections.Counter()
    for w, c in counts.items():
        ids = class_lm.token_ids((w or ""))[:1]
        item = class_lm._Lookup(model).find(ids)[2][0]
        by_class[model.classes[item]] += (c - model.discount) / 10 ** model.log_class[model.classes[item]]
    for c, mass in by_class.items():
        assert math.isclose(mass + 10 ** model.log_unknown[c], 1, rel_tol=1e-6)
    got = model.score(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) for r in got)
    assert class_lm.ClassModel(classes=4, items=8, sweeps=2).fit(empty).score(odd).count() == odd.count()
    assert model.score(empty).count() == 0


def test_held_out_texts_score_above_the_base(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = class_lm.ClassModel().fit(docs.where(~class_lm.held_out()))
    rows = model.score(docs.where(class_lm.held_out())).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 2}
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_vector_search(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CHUNK", 50)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 24)).astype(np.float32)
    x[100:300] = x[0]  # a third of all
    rows = [(i, [float(v) for v in r], "z") for i, r in enumerate(x)] + [(1000, None, "z"), (1050, [0.0] * 24, "z"), (1100, [float("nan")] * 24, "z"), (1150, [None] * 24, "z"), (None, [1.0] * 24, "z"), (50, [float(v) for v in x[50]], "z")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = collections.defaultdict(dict)
    for r in vector_search.VectorSearch(probed_share=1.0).search(table, table.where("vec_id % 50 = 0")).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    y = x.astype(float)
    cos = (y @ y.T) / np.sqrt(np.outer((y * y).sum(1), (y * y).sum(1)))
    hit = 0
    assert set(got) == set(range(0, 600, 50))
    for q in got:
        want = sorted((-round(cos[q, j], 12), j) for j in range(600) if j != q)[:5]
        hit += len({j for _, j in want} & {v for v, _ in got[q].values()})
        assert all(math.isclose(s, cos[q, v], abs_tol=1e-12) for v, s in got[q].values()) and sorted(got[q]) == [1, 2, 3, 4, 5]
    assert hit >= 0.95 * 5 * len(got)
    assert vector_search.VectorSearch().search(table.limit(0), table).count() == 0
    few = table.where("vec_id in (0, 50, 52)")
    assert vector_search.VectorSearch().search(few, few).count() == 6


def test_main_text(spark):
    tree = html_text.train(spark)
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div class="cookie-banner"><p>We use cookies here.</p></div><div id="content"><h1>Title</h1><p>Short.</p>
      <p>A long paragraph of text with <a href="#">a link</a> in it and more words to read for you.</p><form><label>Search</label></form><p>x &lt; y &amp;amp;  z<br>end</p></div>
      <section class="comments"><p>I think that this is a very good text and I have much to say about it, really.</p></section><footer>(c) me</footer><script>var a="<p>x</p>"</script></body>"""
    assert html_text.main_text(page, tree) == "Title\n\nShort.\n\nA long paragraph of text with a link in it and more words to read for you.\n\nx < y &amp; z end"
    pages = spark.createDataFrame([(1, page, "x"), (1, page, "x"), (2, None, "x"), (3, "", "x"), (4, "<p", "x"), (5, "<article><p>" + "word " * 50_000, "x")], "page_id long, html string, text string")
    got = html_text.extract(pages, tree=tree).collect()
    assert [r.n_chars for r in got[2:]] == [0, 0, 0, 249_999] and got[0].text == got[1].text
    assert html_text.extract(pages.limit(0), tree=tree).count() == 0


def test_articles_of_many_forms(spark):
    tree = html_text.train(spark)

    def features_used(node):
        return {html_text.FEATURES[node[0]]} | features_used(node[2]) | features_used(node[3]) if isinstance(node, tuple) else set()

    assert {"words", "link_density"} <= features_used(tree) and {"density_before", "density_after"} & features_used(tree)
    one, two = ("the river runs past the old mill and the town " * 3).strip(), ("many people came to see the bridge last year " * 2).strip()
    article = f"<h1>A day out</h1><p>{one}</p><p>{two}</p>"
    want = f"A day out\n\n{one}\n\n{two}"
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>News today</a></li><li><a href=c>About us</a></li><li><a href=d>Shop</a></li></ul>"
    end = "<div><a href=x>Imprint</a> | <a href=y>Privacy</a></div><div><a href=z>Contact</a></div>"
    for open_, close in (
        ('<div class="content has-sidebar">', "</div>"), ('<div class="post type-post category-news tag-x">', "</div>"), ("<article><header>", "</header></article>"),
        ("<article>", "</article>"), ('<div class="row">', "</div>"), ("", ""),
    ):
        inner = article.replace("</h1>", "</h1></header>").replace("</p></header>", "</p>") if "<header>" in open_ else article
        page = f"{open_}{inner}{close.replace('</header>', '')}"
        for before, after in (("", ""), (f"<nav>{menu}</nav>", f"<footer>{end}</footer>"), (menu, end)):
            assert html_text.main_text(f"<html><body>{before}{page}{after}</body></html>", tree) == want, (open_, before)
    lines = [" ".join(one.split()[: 8 + i]) for i in range(6)]
    assert html_text.main_text("<body>" + "".join(f"<p>{x}</p>" for x in [one, two] * 3) + "</body>", tree) == "\n\n".join([one, two] * 3)
    assert html_text.main_text("<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>", tree) == "\n\n".join(lines)
    assert html_text.main_text(f"<body>{menu}" + "".join(f"<div>{x}</div>" for x in lines) + f"{end}</body>", tree) == "\n\n".join(lines)
    advert = '<div class="nb"><p>Advertisement</p></div>'
    assert html_text.main_text(f"<article><h1>A day out</h1><p>{one}</p>{advert}<p>{two}</p></article>", tree) == want
    comments = f'<div class="post-comments"><p>{one}</p></div>'
    assert html_text.main_text(f"<body><article>{article}</article>{comments}</body>", tree) == want
    assert html_text.main_text(f"<body><div class=story>{article}{menu}</div></body>", tree) == want
    short = "<p>See the <a href=r>report</a> for more.</p>"
    assert html_text.main_text(f"<body>{menu}<article><h1>A day out</h1>{short}<p>{one}</p>{short}</article></body>", tree) == f"A day out\n\nSee the report for more.\n\n{one}\n\nSee the report for more."


def test_scripts_and_open_heads_end_where_they_end():
    read = lambda page: [b[0] for b in html_text.blocks(page)]
    text = "<p>First text.</p>{}<p>Second text.</p>"
    for inner in (
        "<script>for(i=0;i<n;i++)f(i)</script>", "<script>if(a<b && c=='\"')</SCRIPT >", "<style>a<b{}</style>", "<script><!-- a<b\n</script>", "<script><!-- w('<script>x<y</script>') --></script>",
        "<textarea><p a='</textarea>", "<svg><style>a<b</style><title>x</svg>", "<noscript><script>i<n</script></noscript>", "<script>'</scripts>'</script>", "<script src='x'/>",
    ):
        assert read(text.replace("{}", inner, 1)) == ["First text.", "Second text."], inner
        head = f"<html><head><meta charset=x>{inner if inner.startswith(('<script', '<style')) else ''}"
        for rest in ("</head><body>", "<body class=b>", ""):
            assert read(f"{head}<title>T <b</title>{rest}{text.replace('{}', inner, 1)}") == ["First text.", "Second text."], (inner, rest)
    assert read("<head><title>T</title><noscript><img src=x></noscript><script>a<b</script>\n<link rel=x>Text <b>here</b>") == ["Text here"]
    assert read("<head><title>T</head><body><p>Text</p>") == ["Text"] and read("<head><title>T</title>Text only") == ["Text only"]
    assert read("<p>Text</p><script>var a='<p>x</p>'") == ["Text"] and read("<head><title>T</title>") == []
    many = "<svg><title></svg>" * 20_000 + "<p>end</p>"
    assert read(many) == ["end"]


def test_revisits_against_a_loop(spark):
    rows = []
    for i in range(300):
        url = f"http://Example.org:80/p{i % 3 if i % 2 else 0}?b=2&a=1&utm_source=z#f"
        full = i % 4 == 0
        headers = {"ETag": f'"{i % 3}"' if full else f'W/"{i % 3}"', "Content-Length": str(i), "X": str(i)} if i % 5 else ({"Last-Modified": "d"} if i % 7 else None)
        rows.append((f"r{i:03d}", "response" if full else "revisit", url, random.randrange(400_000), headers, "extra"))
    rows += [("n1", "revisit", None, 5, None, ""), ("n2", "revisit", "http://a", None, {"X": "1"}, ""), ("q", "request", "http://a", 1, None, "")]
    df = spark.createDataFrame(rows, "record_id string, kind string, url string, ts long, headers map<string,string>, outcome string")
    got = {r.record_id: r for r in revisits.resolve(df, span=50_000).collect()}
    assert set(got) == {r[0] for r in rows if r[1] == "revisit"}
    key = lambda u: None if u is None else u.split("?")[0]
    for rid, kind, url, ts, headers, _ in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[1] == "response" and url and ts is not None and key(r[2]) == key(url) and r[3] < ts]
        best = max(earlier, key=lambda r: (r[3], r[0]), default=None)
        assert got[rid].refers_to == (best[0] if best else None)
        new = {k.lower(): v for k, v in (headers or {}).items()}
        if best is None:
            assert got[rid].outcome == "orphan" and (got[rid].headers or {}) == new
            continue
        old = {k.lower(): v for k, v in (best[4] or {}).items()}
        if "etag" in new and "etag" in old:
            want = "resolved" if new["etag"].removeprefix("W/") == old["etag"] else "changed"
        elif "last-modified" in new and "last-modified" in old:
            want = "resolved"
        else:
            want = "unvalidated"
        assert got[rid].outcome == want
        merged = {**old, **{k: v for k, v in new.items() if k != "content-length"}} if want != "changed" else new
        assert got[rid].headers == merged
    assert revisits.resolve(df.limit(0)).count() == 0


def test_pipeline_runs_whole(spark, folder):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, folder).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    roots = brute_components(list(docs.items()))
    assert {r.doc_id for r in rows} == {i for i, (_, c) in roots.items() if c == i} and all(r.decoded_equal for r in rows)
    m = sentencepiece.PieceModel()
    assert all(m.decode(r.ids) == docs[r.doc_id] for r in rows)


def test_pipeline_keeps_the_mixture(spark, folder):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, folder).collect()
    assert [(r.slot, r.place) for r in rows] == sorted((r.slot, r.place) for r in rows) and len({(r.slot, r.place) for r in rows}) == len(rows)
    kept = spark.createDataFrame([(r.doc_id, r.source) for r in rows], "doc_id long, source string")
    share = {r.source: r.share for r in mixing.root_shares(kept).collect()}
    period, size = sum(share.values()), collections.Counter(r.source for r in rows)
    have, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        slots[r.slot].append(r.source)
    assert all(len(set(found)) == 1 and len(found) <= mixing.BLOCK_DOCS for found in slots.values())
    for t in range(max(slots) + 1):
        for s, w in share.items():
            assert abs(have[s] - t * w / period) < 1 or have[s] == math.ceil(size[s] / mixing.BLOCK_DOCS), (t, s)
        have.update(slots[t][:1])
