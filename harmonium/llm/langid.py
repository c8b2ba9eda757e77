"""Language identification by fusing independent evidence with Bayes' rule (operator 6).

Evidence for a record's language:

* the text: hashed character trigrams under one multinomial model per language, trained on all records by the
  languages they declare, and a flat model ``und`` for text that fits no language;
* the declared (markup) language: how often texts of a language carry which declaration;
* the address suffix: the same for the top-level domain together with a language folder in the path;
* the host: a prior from the texts of the host's other records, smoothed towards its domain's, and that towards all.

All tables are grouped aggregations over all records.  The number of languages is bounded by the well-formed two- and
three-letter codes, so the trained tables may travel to every task; the tables of hosts and addresses are joined, and
broadcast only after a count.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonium.llm.common import DOCUMENT_COLUMNS, batches, broadcast_if_small, materialise, prepared, read, slices

BUCKET_BITS = 14
#: Neighbouring trigrams overlap, so their joint evidence is a third of the sum.
TEMPER = 1 / 3
#: Pseudo-counts: of a trigram bucket, of a declared value or address, of the wider group in a host's prior.
SMOOTH_TEXT, SMOOTH_VALUE, SMOOTH_HOST = 0.5, 0.5, 10.0
#: Prior of text in no known language.
UNKNOWN_PRIOR = 1e-6
UNKNOWN = "und"
#: A text is rejected if it is in no known language with at least this posterior; a doubtful one keeps its declaration.
SURE = 0.999

_LETTERS = None
_LANGUAGE = r"^[a-z]{2,3}$"


def trigram_buckets(text: str | None) -> np.ndarray:
    """Bucket of every character trigram with a letter; runs of other characters count as one space."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(i).isalpha() for i in range(1 << 16)])
    codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _LETTERS[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    codes, letter = np.where(letter, codes, 32)[keep].astype(np.uint32), letter[keep]
    if len(codes) < 3 or not letter.any():
        return np.empty(0, np.int64)
    h = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA6B) + codes[2:] * np.uint32(0xC2B2AE35)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def visible_text(html: str | None) -> str:
    """The text of a page without markup, scripts and styles."""
    return unescape(re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html or ""))


_COUNTS = pa.schema([("declared", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def _count_trigrams(is_html: bool):
    def run(parts):
        sums: dict[str, np.ndarray] = {}
        for part in slices(parts):
            for text, declared in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = trigram_buckets(visible_text(text) if is_html else text)
                if declared not in sums:
                    sums[declared] = np.zeros(1 << BUCKET_BITS, np.int64)
                sums[declared] += np.bincount(found, minlength=1 << BUCKET_BITS)
        for declared, n in sums.items():
            at = np.flatnonzero(n)
            yield batches(_COUNTS, [[declared] * len(at), at.astype(np.int32), n[at]])

    return run


class LanguageIdentifier:
    """``fit`` on and ``transform`` records with columns text, declared, suffix, domain, host (all may be null).

    ``transform`` returns the given columns and ``language`` (struct: lang, confidence, trigrams).  A text without any
    letter, null and empty texts included, is ``und`` with confidence 1.  Ties go to the language first in the
    alphabet.  An empty table yields an empty table.  A record never votes in its own host's prior.
    """

    def __init__(self, html: bool = False, temper: float = TEMPER):
        self.html, self.temper = html, temper

    def fit(self, records: DataFrame) -> LanguageIdentifier:
        self.fit_text((records, self.html))
        return self.fit_context(records)

    def fit_text(self, *tables: tuple[DataFrame, bool]) -> LanguageIdentifier:
        """Train the text models on the declared languages of one or more tables; the flag says whether a table's text is markup."""
        counts = None
        for records, is_html in tables:
            rows = records.where(F.col("declared").rlike(_LANGUAGE)).select("text", "declared").mapInArrow(_count_trigrams(is_html), "declared string, bucket int, n long")
            counts = rows if counts is None else counts.unionByName(rows)
        rows = counts.groupBy("declared", "bucket").agg(F.sum("n").alias("n")).toPandas()
        self.languages = sorted(x for x in rows["declared"].unique() if x != UNKNOWN)
        table = np.full((len(self.languages) + 1, 1 << BUCKET_BITS), SMOOTH_TEXT)
        table[-1] = 1.0
        for i, lang in enumerate(self.languages):
            own = rows[rows["declared"] == lang]
            table[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
        self._logp = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)
        return self

    def like(self, html: bool) -> LanguageIdentifier:
        """The same text models for other records."""
        twin = LanguageIdentifier(html, self.temper)
        twin.languages, twin._logp = self.languages, self._logp
        return twin

    def _likelihoods(self, text: Column) -> Column:
        """Array: tempered log likelihood under each language and ``und``, then the number of trigrams."""
        logp, temper, is_html = self._logp, self.temper, self.html

        def run(texts):
            out = []
            for text in texts:
                found = trigram_buckets(visible_text(text) if is_html else text)
                counted = np.bincount(found, minlength=1 << BUCKET_BITS)
                at = np.flatnonzero(counted)
                out.append(np.append(temper * (logp[:, at].astype(float) @ counted[at]), len(found)))
            return pd.Series(out, index=texts.index, dtype=object)

        return F.pandas_udf(run, "array<double>")(text)

    def fit_context(self, records: DataFrame) -> LanguageIdentifier:
        """Count what the texts say by declaration, address and host."""
        size = len(self.languages) + 1
        by_text = records.select(self._likelihoods(F.col("text")).alias("ll"), "declared", "suffix", "domain", "host")
        by_text = by_text.withColumn("vote", _best(F.slice("ll", 1, size))).where(F.col("ll")[size] > 0)
        votes = by_text.groupBy("declared", "suffix", "domain", "host").agg(F.array(*[F.sum((F.col("vote") == i).cast("double")) for i in range(size)]).alias("n"))
        votes = materialise(votes, "votes")
        per = lambda *keys: votes.groupBy(*keys).agg(F.array(*[F.sum(F.col("n")[i]) for i in range(size)]).alias("n"))
        total = per().first()
        self._total = [float(x or 0) for x in (total["n"] if total else [None] * size)]
        self._tables = {}
        for key, keys in (("declared", ["declared"]), ("suffix", ["suffix"]), ("domain", ["domain"]), ("host", ["domain", "host"])):
            table = per(*keys).select(*[F.col(k).alias(f"_{k}_{key}") for k in keys], F.col("n").alias(f"_n_{key}"))
            self._tables[key] = (keys, broadcast_if_small(table), table.count() if key in ("declared", "suffix") else 0)
        return self

    def transform(self, records: DataFrame) -> DataFrame:
        size, kept = len(self.languages) + 1, records.columns
        out = records.withColumn("_ll", self._likelihoods(F.col("text")))
        for key, (keys, table, _) in self._tables.items():
            same = None
            for k in keys:
                one = F.col(k).eqNullSafe(F.col(f"_{k}_{key}"))
                same = one if same is None else same & one
            out = out.join(table, same, "left")
        ll, none = F.slice("_ll", 1, size), F.array(*[F.lit(0.0)] * size)
        vote, seen = _best(ll), F.col("_ll")[size] > 0
        own = F.array(*[(seen & (vote == i)).cast("double") for i in range(size)])
        less_own = lambda n: F.zip_with(F.coalesce(F.col(n), none), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
        total = sum(self._total)
        known = max(total - self._total[-1], 0.0)
        overall = [(n + 1) / (known + size - 1) * (1 - UNKNOWN_PRIOR) for n in self._total[:-1]] + [UNKNOWN_PRIOR]
        prior = F.array(*[F.lit(p) for p in overall])
        for n in ("_n_domain", "_n_host"):
            prior = _smoothed(less_own(n), prior)
        score = F.zip_with(ll, prior, lambda a, p: a + F.log(p))
        for key in ("declared", "suffix"):
            values = self._tables[key][2] + 1
            everywhere = F.array(*[F.lit(x) for x in self._total])
            rate = F.zip_with(less_own(f"_n_{key}"), everywhere, lambda a, n: F.log((a + SMOOTH_VALUE) / (n + SMOOTH_VALUE * values)))
            score = F.zip_with(score, F.when(F.col(key).isNotNull(), rate).otherwise(none), lambda a, b: a + b)
        names = F.array(*[F.lit(x) for x in [*self.languages, UNKNOWN]])
        out = out.withColumn("_score", score).withColumn("_top", F.array_max("_score")).withColumn("_at", _best(F.col("_score")))
        mass = F.aggregate(F.transform("_score", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda a, x: a + x)
        language = F.when(seen, F.struct(names[F.col("_at")].alias("lang"), (1 / mass).alias("confidence"), F.col("_ll")[size].cast("long").alias("trigrams"))).otherwise(
            F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("trigrams")))
        return out.withColumn("language", language).select(*kept, "language")


def _best(scores: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _smoothed(n: Column, prior: Column) -> Column:
    """Shares of the counts ``n`` with ``SMOOTH_HOST`` pseudo-counts dealt by ``prior``."""
    size = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(n, prior, lambda a, p: (a + SMOOTH_HOST * p) / (size + SMOOTH_HOST))


def _code(c: Column) -> Column:
    """A language tag's primary subtag; null if it isn't well-formed."""
    first = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_][A-Za-z0-9_-]*)?\s*$", 1))
    return F.when(first != "", first)


def document_records(docs: DataFrame) -> DataFrame:
    """Records of documents: the column lang is the declaration, the source the host."""
    return docs.withColumns({"declared": _code(F.col("lang")), "suffix": F.lit(None).cast("string"), "domain": F.lit(None).cast("string"), "host": F.col("source")})


def page_records(pages: DataFrame) -> DataFrame:
    """Records of web pages: the declaration stands in the html tag, the rest in the address."""
    address = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    folder = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^?#]*?://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    lang = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    blank = lambda c: F.when(c != "", c)
    return pages.select("page_id", F.col("html").alias("text"), _code(blank(lang)).alias("declared"),
                        F.concat_ws("/", blank(F.substring_index(address, ".", -1)), blank(folder)).alias("suffix"),
                        blank(F.substring_index(address, ".", -2)).alias("domain"), blank(address).alias("host"))


def _accepted() -> Column:
    return (F.col("language.lang") != UNKNOWN) | (F.col("language.confidence") < SURE)


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document and every page (doc_id or page_id is null), and whether it is accepted."""
    docs = document_records(read(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    pages = page_records(read(spark, folder, "pages").select("page_id", "url", "html"))
    of_all = LanguageIdentifier().fit_text((docs, False), (pages, True))
    of_docs, of_pages = of_all.like(html=False).fit_context(docs), of_all.like(html=True).fit_context(pages)
    found = lambda df, kind, key, other: df.select(
        F.lit(kind).alias("kind"), F.col(key), F.lit(None).cast("long").alias(other), "declared", F.col("language.lang").alias("lang"), F.round("language.confidence", 6).alias("confidence"),
        F.col("language.trigrams").alias("n_trigrams"), _accepted().alias("accepted"))
    return found(of_docs.transform(docs), "document", "doc_id", "page_id").unionByName(found(of_pages.transform(pages), "page", "page_id", "doc_id"))


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the language found in ``lang``; texts that are surely in no known language are dropped."""
    prepared(spark)
    docs = document_records(docs.select(*DOCUMENT_COLUMNS))
    found = LanguageIdentifier().fit(docs).transform(docs).where(_accepted())
    lang = F.when(F.col("language.lang") != UNKNOWN, F.col("language.lang")).otherwise(F.coalesce("declared", F.lit(UNKNOWN)))
    return found.withColumn("lang", lang).select(*DOCUMENT_COLUMNS)
