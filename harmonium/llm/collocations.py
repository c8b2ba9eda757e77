"""Collocations from sorted count streams (operator 12).

All phrases of up to ``longest`` words that occur often enough form one stream of (phrase, count); the empty phrase counts
all words.  Sorted by their words from the left (prefix order), a phrase comes right after all phrases it starts with, so
one pass in lockstep over all lengths hands each phrase the counts of its beginnings (left counts) and the largest count of
its one-word extensions.  Sorted by their words from the right (suffix order) the same pass hands out the counts of its ends
(right counts) and extensions to the left.  Neither pass looks anything up by hash: both merge sorted streams.

The counts themselves come from texts counted some words at a time in a task; these partial counts travel packed, a row for
each language and bucket of phrases, and the number of buckets grows with the text, so that a bucket fits in memory.

Spark samples each order for splitters, deals the stream into ranges and sorts them externally; one frequent first word
fills as many ranges as it needs.  What a range's first rows need from the ranges before it is one row of numbers a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harmonium.llm.common import bounded_batches, broadcast_if_small, materialise, mix, read, word_hashes

SHORTEST, LONGEST, LEAST, INSIDE, TOP = 2, 3, 10, 50, 2_000
#: Words a task counts together before it hands the counts on, and characters of text for each bucket of partial counts.
HELD_WORDS, BUCKET_CHARS = 1_000_000, 4_000_000
#: Candidates that are ranked together before a language's best are.
SLICE = 20_000
#: Leading characters of a phrase that are part of the splitters.
LEAD = 64
#: Ends of pieces become one sign that no word can hold; tabs become spaces.
_SIGNS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\x0a" * 10 + b"\x20")
#: Partial counts travel packed: the phrases' bytes, their lengths (int32) and counts (int64) of one language and bucket.
_PACKED = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("phrases", pa.binary()), ("lengths", pa.binary()), ("counts", pa.binary())])
_COUNTED = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def tokens(text: str | None) -> Iterator[bytes]:
    """The words of a text in lower case (A-Z only); a line feed ends every piece."""
    signs = (text or "").encode("utf-8", "surrogatepass").lower().translate(_SIGNS)
    return filter(None, (signs.replace(b"\x0a", b"\x20\x0a\x20") + b"\x20\x0a").split(b"\x20"))


def count_phrases(words: list[bytes], longest: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(phrases, hashes, counts) for each length up to ``longest``; every word of a phrase ends in a space.

    The phrases of one length are numbered by (number of the phrase without its last word, last word), so sorted numbers
    are enough to count them.
    """
    coded = pa.array(words, pa.binary()).dictionary_encode()
    names = coded.dictionary
    code = coded.indices.to_numpy().astype(np.int64)
    end = pc.index(names, pa.scalar(b"\x0a", pa.binary())).as_py()
    n_words = len(names)
    spaced = pc.binary_join_element_wise(names, pa.scalar(b"", pa.binary()), pa.scalar(b"\x20", pa.binary()))
    hashed = word_hashes(names.to_pylist())
    at = np.flatnonzero(code != end)
    number, phrases, hashes = code, spaced, hashed
    for length in range(1, longest + 1):
        if length > 1:
            at = at[at + length - 1 < len(code)]
            at = at[code[at + length - 1] != end]  # a shorter phrase at this place reaches no end either
            known = number[at] * n_words + code[at + length - 1]
        else:
            known = code[at]
        if not len(at):
            return
        seen, place, counts = np.unique(known, return_inverse=True, return_counts=True)
        if length == 1:
            phrases, hashes = spaced.take(pa.array(seen)), hashed[seen]
        else:
            before, word = seen // n_words, seen % n_words
            phrases = pc.binary_join_element_wise(phrases.take(pa.array(before)), spaced.take(pa.array(word)), pa.scalar(b"", pa.binary()))
            hashes = mix(hashes[before]) + hashed[word]
        yield phrases, hashes, counts
        number = np.full(len(code), -1, np.int64)
        number[at] = place


def packed(phrases: pa.Array, counts: np.ndarray) -> list[bytes]:
    """The bytes, lengths and counts of ``phrases``."""
    phrases = pa.concat_arrays([phrases])  # without an offset
    ends = np.frombuffer(phrases.buffers()[1], np.int32)[: len(phrases) + 1]
    data = phrases.buffers()[2]
    return [data[ends[0] : ends[-1]].to_pybytes() if data and len(phrases) else b"", np.diff(ends).tobytes(), counts.astype(np.int64).tobytes()]


def counter(longest: int, buckets: int, held_words: int = HELD_WORDS):
    """The function that counts the phrases of a partition's (lang, text) batches, some words at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                out, every = [], 0
                for phrases, hashes, counts in count_phrases(words, longest):
                    every = every or int(counts.sum())
                    bucket = (mix(hashes) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    phrases, counts, bucket = phrases.take(pa.array(order)), counts[order], bucket[order]
                    ends = np.flatnonzero(np.diff(bucket)) + 1
                    out += [(lang, int(bucket[i]), *packed(phrases[i:j], counts[i:j])) for i, j in zip([0, *ends], [*ends, len(bucket)], strict=True)]
                if every:
                    out.append((lang, 0, *packed(pa.array([b""], pa.binary()), np.array([every]))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PACKED, strict=True)], schema=_PACKED)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                mine = held.setdefault(lang, [])
                before = len(mine)
                mine.extend(tokens(text))
                total += len(mine) - before
                if total >= held_words:
                    yield from flush()
                    total = 0
        yield from flush()

    return count


def merger(least: int):
    """The function that adds up the packed counts of one language and bucket and keeps those of at least ``least``."""

    def merge(table: pa.Table) -> pa.Table:
        arrays, counts = [], []
        for data, lengths, n in zip(*(table.column(c).to_pylist() for c in ("phrases", "lengths", "counts")), strict=True):
            ends = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int32))]).astype(np.int32)
            arrays.append(pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]))
            counts.append(np.frombuffer(n, np.int64))
        whole = pa.table({"phrase": pa.chunked_array(arrays), "n": np.concatenate(counts)}).group_by("phrase").aggregate([("n", "sum")])
        whole = whole.filter(pc.greater_equal(whole.column("n_sum"), least))
        phrase = whole.column("phrase").cast(pa.string())
        lang = pa.array([table.column("lang")[0].as_py()] * len(whole), pa.string())
        return pa.table([lang, pc.count_substring(phrase, " ").cast(pa.int32()), phrase, whole.column("n_sum")], schema=_COUNTED)

    return merge


def lockstep(longest: int):
    """The function that passes once over a sorted range of (lang, key, words, n, ...).

    ``up0``, ``up1``, ... are the counts of the phrases a key starts with, by length (-1: it stands in an earlier range), ``ext``
    is the largest count of its one-word extensions.  A phrase is open until one comes that is not longer; only the last
    row of each length is held for that.  The rows still ``open`` at the end may have extensions in later ranges.  A last
    row with a null key holds what other ranges need, in lists by length: ``last`` (count of the open phrase), ``seen`` (a phrase
    that is not longer stands in this range) and ``ahead`` (largest extension of the phrase left open by earlier ranges).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = np.int32(TaskContext.get().partitionId())
        opened: list[pd.DataFrame | None] = [None] * longest
        ext, last, ahead = np.zeros(longest, np.int64), np.full(longest, -1, np.int64), np.zeros(longest, np.int64)
        seen = np.zeros(longest, bool)
        lists = {"last": None, "seen": None, "ahead": None}
        sample = None
        for frame in frames:
            if not len(frame):
                continue
            n, words = frame["n"].to_numpy(np.int64), frame["words"].to_numpy()
            rows = np.arange(len(frame))
            best, done, over = np.zeros(len(frame), np.int64), np.ones(len(frame), bool), []
            up = {}
            for length in range(longest):
                place = np.maximum.accumulate(np.where(words == length, rows, -1))
                up[f"up{length}"] = np.where(words > length, np.where(place >= 0, n[np.maximum(place, 0)], last[length]), -1)
                longer = np.where(words == length + 1, n, 0)
                ends = np.flatnonzero(words <= length)  # here a phrase of this length is over
                head = longer[: ends[0] if len(ends) else None].max(initial=0)
                if opened[length] is not None:
                    ext[length] = max(ext[length], head)
                elif not seen[length]:
                    ahead[length] = max(ahead[length], head)
                if not len(ends):
                    continue
                seen[length] = True
                mine = words[ends] == length
                best[ends[mine]] = np.maximum.reduceat(longer, ends)[mine]
                if opened[length] is not None:
                    over.append(opened[length].assign(ext=ext[length], open=False))
                    opened[length] = None
                last[length] = n[ends[-1]] if mine[-1] else -1
                if mine[-1]:
                    done[ends[-1]] = False
                    ext[length] = best[ends[-1]]
            frame = frame.assign(part=part, **up, ext=best, open=False, **lists)
            for at in np.flatnonzero(~done):
                opened[words[at]] = frame.iloc[at : at + 1]
            sample = frame.iloc[:1]
            yield from over
            yield frame[done]
        for length, row in enumerate(opened):
            if row is not None:
                yield row.assign(ext=ext[length], open=True)
        if sample is not None:
            yield sample.assign(key=None, last=[last.tolist()], seen=[seen.tolist()], ahead=[ahead.tolist()])

    return run


class Collocations:
    """``mine(docs)``: the phrases whose words occur together far more often than their parts would suggest, by language.

    ``docs`` has ``text`` and ``lang``; other columns are not read.  A null text counts as empty, a null lang as ``und``;
    rows without words add nothing, repeated rows count each.  Scores are exact up to 10^15 occurrences.  Phrases stay within pieces (no sign of ``.,;:!?`` or line
    break inside) and count with overlaps.  Of cuts that tie the one with the
    fewest words before it counts; phrases that tie are ordered by count, then by their bytes.  An empty table gives an empty table.

    ``shortest`` to ``longest``: words of a candidate; ``least``: its occurrences at least; ``inside``: a candidate is dropped
    if a longer one around it has this percentage of its occurrences; ``top``: rows of a language.
    """

    def __init__(self, shortest: int = SHORTEST, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP,
                 held_words: int = HELD_WORDS, bucket_chars: int = BUCKET_CHARS):
        self.shortest, self.longest, self.least, self.inside, self.top = shortest, longest, least, inside, top
        self.held_words, self.bucket_chars = held_words, bucket_chars

    def counts(self, docs: DataFrame) -> DataFrame:
        """(lang, phrase, words, n) of every phrase with at least ``least`` occurrences; the empty one counts all words.

        A phrase's parts occur at least as often as the phrase, so they are all in the table.
        """
        texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
        chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        buckets = 1 + chars // self.bucket_chars
        with bounded_batches(docs.sparkSession):
            partial = texts.mapInArrow(counter(self.longest, buckets, self.held_words), "lang string, bucket long, phrases binary, lengths binary, counts binary")
            whole = partial.groupBy("lang", "bucket").applyInArrow(merger(self.least), "lang string, words int, phrase string, n long")
            return materialise(whole, "phrases")

    def _pass(self, stream: DataFrame) -> DataFrame:
        """``stream`` with the columns of ``lockstep``, whole across ranges, in the order of (lang, key)."""
        numbers = "part int, " + "".join(f"up{i} long, " for i in range(self.longest)) + "ext long, open boolean, last array<long>, seen array<boolean>, ahead array<long>"
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
        dealt = stream.repartitionByRange("lang", F.substring("key", 1, LEAD)).sortWithinPartitions("lang", "key")
        passed = materialise(dealt.mapInPandas(lockstep(self.longest), f"{fields}, {numbers}"), "pass")
        ranges = passed.where("key is null").select("part", "last", "seen", "ahead").orderBy("part").collect()  # one row a range
        before, after = [], []
        carry, follow = [-1] * self.longest, [0] * self.longest
        for r in ranges:
            before.append(list(carry))
            carry = [now if s else old for now, s, old in zip(r["last"], r["seen"], carry, strict=True)]
        for r in reversed(ranges):
            after.append(list(follow))
            follow = [a if s else max(a, f) for a, s, f in zip(r["ahead"], r["seen"], follow, strict=True)]
        borders = stream.sparkSession.createDataFrame([(r["part"], b, a) for r, b, a in zip(ranges, before, reversed(after), strict=True)], "part int, before array<long>, after array<long>")
        whole = passed.where("key is not null").join(broadcast_if_small(borders), "part")
        ups = [F.when((F.col(f"up{i}") < 0) & (F.col("words") > i), F.col("before")[i]).otherwise(F.col(f"up{i}")).alias(f"up{i}") for i in range(self.longest)]
        ext = F.when(F.col("open"), F.greatest("ext", F.get("after", F.col("words")))).otherwise(F.col("ext")).alias("ext")
        return whole.select(*stream.columns, *ups, ext)

    def scored(self, docs: DataFrame) -> DataFrame:
        """(lang, phrase, words, a, l, r, n, score, inside): every candidate; ``inside``: a longer one around it counts more."""
        phrases = self.counts(docs)
        left = self._pass(phrases.withColumn("key", F.col("phrase")))
        parts = F.slice(F.split("phrase", " "), 1, F.col("words"))
        backwards = F.concat(F.array_join(F.reverse(parts), " "), F.when(F.col("words") > 0, " ").otherwise(""))
        named = {f"up{i}": f"left{i}" for i in range(self.longest)} | {"ext": "left_ext"}
        both = self._pass(left.withColumnsRenamed(named).withColumn("key", backwards))
        both = both.where(F.col("words") >= max(2, self.shortest)).withColumn("longer", F.greatest("ext", "left_ext"))
        exact = lambda c: F.col(c).cast("decimal(38,0)") if isinstance(c, str) else c.cast("decimal(38,0)")
        cuts = []
        for k in range(1, self.longest):
            # the phrase without its first k words has (words - k) words and is known by its end
            rest = F.get(F.array(*[F.col(f"up{i}") for i in range(self.longest)]), F.col("words") - k)
            score = F.call_function("div", exact("n") * exact("n") * F.lit(1_000_000).cast("decimal(7,0)"), exact(f"left{k}") * exact(rest))
            cuts.append(F.when(F.col("words") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"left{k}").alias("l"), rest.alias("r"))))
        lowest = F.array_min(F.filter(F.array(*cuts), lambda c: c.isNotNull()))
        return both.withColumn("cut", lowest).select(
            "lang", F.rtrim("phrase").alias("phrase"), "words", F.col("n").alias("a"), "cut.l", "cut.r", F.col("left0").alias("n"), "cut.score", (F.col("longer") * 100 >= F.col("n") * self.inside).alias("inside"))

    def mine(self, docs: DataFrame) -> DataFrame:
        """(lang, rank, phrase, a, l, r, n, score)."""
        found = materialise(self.scored(docs).where("not inside"), "candidates")
        slices = 1 + found.count() // SLICE
        best = lambda *keys: F.row_number().over(W.partitionBy("lang", *keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))
        # a language may hold most candidates: the best of each slice first, then the best of those
        some = found.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(slices))).withColumn("rank", best("slice")).where(F.col("rank") <= self.top)
        ranked = some.withColumn("rank", best()).where(F.col("rank") <= self.top)
        return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_count_streams(spark: SparkSession, folder: str) -> DataFrame:
    """The collocations of all ``documents``; see ``Collocations`` for odd rows."""
    return Collocations().mine(read(spark, folder, "documents").select("text", "lang"))


OP12_SQL = f"""WITH pieces AS (SELECT COALESCE(lang, 'und') AS lang, doc_id, UNNEST(STRING_SPLIT_REGEX(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, REGEXP_EXTRACT_ALL(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, g AS words, ARRAY_TO_STRING(w[i:i + g - 1], ' ') AS phrase FROM (SELECT lang, w, g, UNNEST(RANGE(1, LEN(w) - g + 2)) AS i FROM worded, (SELECT UNNEST([1, 2, 3]) AS g))),
f AS (SELECT lang, words, phrase, COUNT(*) AS n FROM grams GROUP BY ALL),
total AS (SELECT lang, SUM(n)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
cand AS (SELECT lang, words, phrase, n AS a, STRING_SPLIT(phrase, ' ') AS w FROM f WHERE words > 1 AND n >= {LEAST}),
cuts AS (SELECT c.*, k, ARRAY_TO_STRING(w[1:k], ' ') AS head, ARRAY_TO_STRING(w[k + 1:words], ' ') AS tail FROM cand c, (SELECT UNNEST([1, 2]) AS k) WHERE k < words),
scored AS (SELECT c.lang, c.words, c.phrase, a, w, k, h.n AS l, t.n AS r, (1000000::HUGEINT * a * a // (h.n::HUGEINT * t.n))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.words = k AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.words = c.words - k AND t.phrase = c.tail),
best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, phrase, words ORDER BY score, k) AS cut FROM scored) t WHERE cut = 1),
longer AS (SELECT lang, part, MAX(a) AS a FROM (SELECT lang, a, UNNEST([ARRAY_TO_STRING(w[1:2], ' '), ARRAY_TO_STRING(w[2:3], ' ')]) AS part FROM cand WHERE words = 3) t GROUP BY lang, part),
ranked AS (SELECT b.*, ROW_NUMBER() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, phrase) AS rank
  FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.part = b.phrase AND b.words = 2 WHERE x.a IS NULL OR 100 * x.a < {INSIDE} * b.a)
SELECT lang, rank, phrase, a, l, r, t.n, score FROM ranked JOIN total t USING (lang) WHERE rank <= {TOP}"""
