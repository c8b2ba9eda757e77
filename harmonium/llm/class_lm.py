"""Class-based bigram language model after Brown et al. (operator 7).

``log10 P(text)`` is the sum over its words, and one end, of ``P(class | class before) * P(word | class)``.

* Words are counted over all training texts by a grouped aggregation.  The most frequent ones are items of their own;
  all others are pooled into items by their last bytes, so that every word, known or not, has an item and a class.
* Exchange clustering moves items between classes while that raises the likelihood of the class bigrams.  A sweep
  sums, for every item, its left and right neighbours by class, as a Spark job over the table of item bigrams.  Items
  are then exchanged one after the other against the class matrix, which every move updates; the driver holds items x
  classes numbers, a size fixed by the parameters.
* Emission discounts each count by an amount from the numbers of words seen once and twice.  What this frees in a class is
  the probability of an unknown word of that class.  Transitions are smoothed towards the class frequencies.

The counts of the most frequent words (at most ``LOCAL_WORDS``) travel to every task.  The other words of a text are
joined with the whole table of counts, summed by word and text beforehand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonium.llm.common import batches, materialise, mix, read, slices, word_hashes, words

CLASSES, SWEEPS = 64, 8
#: Items with a class of their own choice; pools of the other words (2 ** POOL_BITS).
ITEMS, POOL_BITS = 4096, 6
LOCAL_WORDS = 1 << 17
#: Pseudo-count of the class frequencies in a transition.
SMOOTH = 64.0
#: Tokens that a task sums up before it hands the sums on.
CHUNK_TOKENS = 2_000_000

POOLS = 1 << POOL_BITS


def token_ids(text: str | None) -> np.ndarray:
    """Ids of a text's words and the end: a hash with the pool in the lowest bits."""
    tokens = words(text)
    ids = np.empty(len(tokens) + 1, np.uint64)
    ids[-1] = END
    if tokens:
        raw = np.frombuffer(b"  " + b" ".join(tokens), np.uint8).astype(np.uint64)
        last = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        second = raw[last - 1]
        third = np.where(second == 32, np.uint64(0), raw[last - 2])  # of a single byte, the byte before is another word's
        tail = raw[last] | second << np.uint64(8) | third << np.uint64(16)
        ids[:-1] = (word_hashes(tokens) & ~np.uint64(POOLS - 1)) | (mix(tail) & np.uint64(POOLS - 1))
    return ids.view(np.int64)


#: The end's id; no word is empty.
END = np.uint64(xxhash.xxh3_64_intdigest(b"") & ~(POOLS - 1))


def _summed(schema: pa.Schema, of):
    """A step that yields the distinct values of ``of(text)`` and their numbers, summed over many texts."""

    def run(parts):
        held, size = [], 0

        def flush():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return batches(schema, [values, n])

        for part in slices(parts):
            for text in part.column(0).to_pylist():
                held.append(of(text))
                size += len(held[-1])
            if size >= CHUNK_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _likelihood(n: np.ndarray) -> float:
    x = lambda a: float(np.sum(a * np.log(np.maximum(a, 1e-300))))
    return x(n) - x(n.sum(0)) - x(n.sum(1))


def exchange(classes: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, order: np.ndarray, only: np.ndarray) -> np.ndarray:
    """One sweep: each item of ``only`` goes to the class where the likelihood of the class bigrams is largest.

    left[i, c], right[i, c]: how often a word of class c stands before, after item i; own[i]: item i before itself.
    Ties keep the present class, or go to the first.
    """
    classes = classes.copy()
    k = left.shape[1]
    n = np.zeros((k, k))
    np.add.at(n.T, classes, left)  # n[c, classes[i]] += left[i, c]
    f = lambda a: a * np.log(np.maximum(a, 1.0))
    for i in order[only[order]]:
        a = classes[i]
        l, r = left[i].copy(), right[i].copy()
        if not (l.any() or r.any()):
            continue
        l[a] = max(0.0, l[a] - own[i])
        r[a] = max(0.0, r[a] - own[i])
        n[:, a] -= l
        n[a, :] -= r
        n[a, a] -= own[i]
        np.maximum(n, 0.0, out=n)
        fn = f(n)
        rows = f(n + r[None, :]) - fn  # item as a member of class b on the left side
        cols = f(n + l[:, None]) - fn
        at = np.arange(k)
        gain = rows.sum(1) - rows[at, at] + cols.sum(0) - cols[at, at] + f(n[at, at] + l + r + own[i]) - fn[at, at]
        out, into = n.sum(1), n.sum(0)
        gain -= f(out + r.sum() + own[i]) - f(out) + f(into + l.sum() + own[i]) - f(into)
        b = int(np.argmax(gain))
        if gain[b] <= gain[a] + 1e-9:
            b = a
        classes[i] = b
        n[:, b] += l
        n[b, :] += r
        n[b, b] += own[i]
    return classes


class ClassModel:
    """``fit(texts)`` on a column ``text``; `score` gives a row per document.

    Null and empty texts are one end.  Without training texts every known-word probability is missing and a text's score
    is that of unknown words only.
    """

    def __init__(self, classes: int = CLASSES, items: int = ITEMS, sweeps: int = SWEEPS, local_words: int = LOCAL_WORDS):
        self.k, self.items, self.sweeps, self.local_words = classes, items, sweeps, max(local_words, items)

    def fit(self, docs: DataFrame) -> ClassModel:
        texts = docs.select("text")
        counted = texts.mapInArrow(_summed(pa.schema([("id", pa.int64()), ("n", pa.int64())]), token_ids), "id long, n long")
        self.counts = materialise(counted.groupBy("id").agg(F.sum("n").alias("n")), "words")
        row = self.counts.agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).first()
        self.tokens, self.vocabulary, once, twice = (int(x or 0) for x in row)
        self.discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
        top = self.counts.orderBy(F.desc("n"), "id").limit(self.local_words).toPandas()
        ids, n = top["id"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
        item = np.full(len(ids), -1, np.int64)
        item[: self.items] = np.arange(min(self.items, len(ids)))
        by_id = np.argsort(ids)
        self._ids, self._n, self._item = ids[by_id], n[by_id], item[by_id]
        self._pool_words = {int(r["pool"]): (int(r["w"]), int(r["n"])) for r in self._pooled(ids[: self.items]).collect()}
        self._cluster(texts)
        return self

    def _pooled(self, own: np.ndarray) -> DataFrame:
        """Words and tokens in each pool, without the words that are items."""
        spark = self.counts.sparkSession
        items = spark.createDataFrame([(int(x),) for x in own], "id long")
        return self.counts.join(F.broadcast(items), "id", "left_anti").groupBy(F.col("id").bitwiseAND(POOLS - 1).alias("pool")).agg(F.count("*").alias("w"), F.sum("n").alias("n"))

    def _cluster(self, texts: DataFrame) -> None:
        size = self.items + POOLS
        lookup = _Lookup(self)
        spark = texts.sparkSession
        shared = spark.sparkContext.broadcast(lookup)

        def bigrams(text):
            items = shared.value.items(token_ids(text))
            return np.concatenate([items[-1:], items[:-1]]) * size + items

        pairs = texts.mapInArrow(_summed(pa.schema([("pair", pa.int64()), ("n", pa.int64())]), bigrams), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        pairs = materialise(pairs, "bigrams")
        k = self.k
        present = np.concatenate([np.arange(self.items) < len(self._ids), [p in self._pool_words for p in range(POOLS)]])
        tokens = np.zeros(size)
        tokens[self._item[self._item >= 0]] = self._n[self._item >= 0]
        for p, (_, n) in self._pool_words.items():
            tokens[self.items + p] = n
        order = np.lexsort((np.arange(size), -tokens))
        classes = np.empty(size, np.int64)
        classes[order] = np.arange(size) % k
        own = np.zeros(size)
        for r in pairs.where(F.expr(f"pair div {size}L = pair % {size}L")).collect():  # at most one per item
            own[r["pair"] % size] = r["n"]
        # neighbours are summed once per sweep, so items that move together can overshoot; then fewer move at once
        best, moved, turn = (-np.inf, classes, None, None, None), 1, mix(np.arange(size, dtype=np.uint64))
        for sweep in range(self.sweeps + 1):
            left, right = _neighbours(pairs, classes, size, k)
            n = np.zeros((k, k))
            np.add.at(n.T, classes, left)
            now = _likelihood(n)
            if now > best[0]:
                best = (now, classes, n, left, right)
            else:
                moved *= 3
            only = present & ((turn + np.uint64(sweep)) % np.uint64(moved) == 0)
            classes = exchange(best[1], best[3], best[4], own, order, only) if sweep < self.sweeps else best[1]
        self.likelihood, self.classes, matrix = best[0], best[1], best[2]
        share = (matrix.sum(0) + 1) / (matrix.sum() + k)
        self.log_transition = np.log10((matrix + SMOOTH * share[None, :]) / (matrix.sum(1)[:, None] + SMOOTH))
        in_class = np.zeros(k)
        np.add.at(in_class, self.classes, tokens)
        kinds = np.zeros(k)
        np.add.at(kinds, self.classes[self._item[self._item >= 0]], 1)
        for p, (w, _) in self._pool_words.items():
            kinds[self.classes[self.items + p]] += w
        self.log_class = np.log10(np.maximum(in_class, 1e-300))
        self.log_unknown = np.where(in_class > 0, np.log10(np.maximum(self.discount * kinds, 1e-300)) - self.log_class, 0.0)

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_tokens, n_known, base_score, score) for each row of ``docs`` (doc_id, text), repeated rows each."""
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast(_Lookup(self))
        denominator = self.tokens + self.vocabulary + 1
        schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("found", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("doc_id", pa.int64()), ("is_doc", pa.int32())])

        def run(parts):
            m = shared.value
            for part in slices(parts):
                docs_out, rare = [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    row = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"))  # tells texts under one doc_id apart
                    row -= (row >> 63) << 64
                    ids = token_ids(text)
                    n_found, base, score, others = m.local(ids)
                    docs_out.append((row, row, len(ids), n_found, base, score, doc, 1))
                    if len(others):
                        at, n = np.unique(others, return_counts=True)
                        rare.append((np.full(len(at), row, np.int64), at, n, np.full(len(at), doc or 0, np.int64), np.full(len(at), doc is None)))
                columns = list(zip(*docs_out, strict=True))
                yield batches(schema, [list(c) for c in columns])
                if rare:
                    row, at, n, doc, no_doc = (np.concatenate(x) for x in zip(*rare, strict=True))
                    none, number = pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.float64())
                    yield batches(schema, [row, at, n.astype(np.int64), none, number, number, pa.array(doc, mask=no_doc), np.zeros(len(row), np.int32)])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "row long, id long, n long, found long, base double, score double, doc_id long, is_doc int")
        joined = rows.join(self.counts.select("id", F.col("n").alias("seen")), "id", "left")
        pool = F.col("id").bitwiseAND(POOLS - 1).cast("int") + 1
        of_pool = self.classes[self.items :]
        by_pool = lambda values: F.element_at(F.array(*[F.lit(float(values[c])) for c in of_pool]), pool)
        is_doc, known = F.col("is_doc") == 1, F.col("seen").isNotNull()
        base = F.col("n") * F.log10((F.coalesce("seen", F.lit(0)) + 1) / F.lit(float(denominator)))
        emitted = F.col("n") * F.when(known, F.log10(F.col("seen") - F.lit(self.discount)) - by_pool(self.log_class)).otherwise(by_pool(self.log_unknown))
        summed = (
            joined.select("row", "doc_id", "is_doc", F.when(is_doc, F.col("n")).alias("tokens"), F.when(is_doc, F.col("found")).when(known, F.col("n")).alias("known"),
                          F.when(is_doc, F.col("base")).otherwise(base).alias("base"), F.when(is_doc, F.col("score")).otherwise(emitted).alias("score"))
            .groupBy("row", "doc_id").agg(F.sum("is_doc").cast("int").alias("copies"), F.sum("tokens").alias("tokens"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
        )
        each = lambda c: (F.col(c) / F.col("copies"))
        return summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
            "doc_id", each("tokens").cast("long").alias("n_tokens"), F.coalesce(each("known"), F.lit(0)).cast("long").alias("n_known"), each("base").alias("base_score"), each("score").alias("score"))


class _Lookup:
    """What tasks need of a model; before clustering, the items only."""

    def __init__(self, model: ClassModel):
        self.m = {x: getattr(model, x, None) for x in ("_ids", "_n", "_item", "classes", "log_transition", "log_class", "discount")}
        self.size = model.items
        self.denominator = model.tokens + model.vocabulary + 1

    def items(self, ids: np.ndarray) -> np.ndarray:
        return self.find(ids)[2]

    def find(self, ids: np.ndarray):
        known, pool = self.m["_ids"], self.size + (ids & (POOLS - 1))
        if not len(known):
            return np.zeros(len(ids), bool), np.zeros(len(ids), np.int64), pool
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        found = known[at] == ids
        item = np.where(found, self.m["_item"][at], -1)
        return found, at, np.where(item >= 0, item, pool)

    def local(self, ids: np.ndarray) -> tuple[int, float, float, np.ndarray]:
        """Of one text: known local tokens, their base score, transitions and their emissions, the other tokens."""
        found, at, item = self.find(ids)
        c = self.m["classes"][item]
        before = np.concatenate([c[-1:], c[:-1]])
        score = float(self.m["log_transition"][before, c].sum())
        n = self.m["_n"][at[found]] if len(self.m["_ids"]) else np.empty(0)
        base = float(np.log10((n + 1) / self.denominator).sum())
        score += float((np.log10(n - self.m["discount"]) - self.m["log_class"][c[found]]).sum())
        return int(found.sum()), base, score, ids[~found]


def _neighbours(pairs: DataFrame, classes: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For every item, its left and right neighbours by class; at most size x k cells reach the driver."""
    schema = pa.schema([("cell", pa.int64()), ("l", pa.float64()), ("r", pa.float64())])

    def run(parts):
        codes, n = [], []
        for part in parts:
            codes.append(part.column(0).to_numpy())
            n.append(part.column(1).to_numpy())
        if codes:
            code, n = np.concatenate(codes), np.concatenate(n)
            before, after = code // size, code % size
            l = np.bincount(after * k + classes[before], n, size * k)
            r = np.bincount(before * k + classes[after], n, size * k)
            at = np.flatnonzero(l + r)
            yield batches(schema, [at, l[at], r[at]])

    cells = pairs.mapInArrow(run, "cell long, l double, r double").groupBy("cell").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).toPandas()
    left, right = np.zeros(size * k), np.zeros(size * k)
    left[cells["cell"]], right[cells["cell"]] = cells["l"], cells["r"]
    return left.reshape(size, k), right.reshape(size, k)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept out of training; one without a doc_id is not."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2


def op7_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = ClassModel().fit(docs.where(~held_out()))
    return model.score(docs).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
