"""Threshold-scaled sketches of word shingles (operator 4, built-in functions only).

A text's sketch holds the hash of every shingle whose hash lies below a fixed fraction of the hash range.  What is kept
depends on the shingle alone.  So sketches of parts merge into the sketch of the whole, and the sketch of a short text
can be looked up in that of a text thousands of times longer: the share of its hashes found there estimates its
containment without bias, where sketches of equal length would compare the wrong tails.

A text none of whose hashes lies below the threshold keeps its smallest one, marked by ``!``; merging drops marked hashes
as soon as there is an unmarked one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harmonium.llm.common import broadcast_if_small, materialise, read

#: Words of a shingle, hexadecimal digits of a hash (48 bits), and the first hash that is not kept (a quarter of them is).
WORDS, DIGITS, BELOW = 5, 12, "4"
#: Documents of a group in which neighbours by doc_id are found.
GROUP_ROWS = 1024


def sketch(text: str) -> Column:
    """Sorted array of the kept shingle hashes of the text column; empty for a text without words.

    Words are runs of characters other than ``\\x20`` and ``\\x09-\\x0D``; fewer than five make one shingle.
    """
    return F.expr(rf"""
        transform(array(transform(array(filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')),
            w -> if(size(w) = 0, cast(array() as array<string>),
                    transform(sequence(1, greatest(size(w) - {WORDS - 1}, 1)), i -> substr(md5(array_join(slice(w, i, {WORDS}), ' ')), 1, {DIGITS}))))[0]),
          all -> transform(array(filter(all, h -> h < '{BELOW}')),
            low -> if(size(low) > 0, sort_array(array_distinct(low)), if(size(all) > 0, array(concat('!', array_min(all))), low)))[0])[0]
    """)


def fingerprint(hashes: Column) -> Column:
    """A sketch as one string."""
    return F.array_join(hashes, "")


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda h: ~h.startswith("!"))
    return F.sort_array(F.when(F.size(low) > 0, low).otherwise(F.slice(F.sort_array(both), 1, 1)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; an empty sketch is contained in any."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def grouped(docs: DataFrame) -> DataFrame:
    """(group, doc_id, text): groups of about ``GROUP_ROWS`` documents with neighbouring ids; null texts become empty.

    Rows without a doc_id are dealt by their text into groups below all others.
    """
    ids = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n")).first()
    low, high = ids["low"] or 0, ids["high"] or 0
    width = max(1, -(-(high - low + 1) * GROUP_ROWS // max(1, ids["n"])))
    text = F.coalesce("text", F.lit(""))
    group = F.coalesce(F.expr(f"(doc_id - {low}L) div {width}L"), -1 - F.pmod(F.xxhash64(text), F.lit(4096)))
    return docs.select(group.alias("group"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _down() -> W:
    """The order of the texts in a group: doc_id descending, of equal ids the larger text first."""
    return W.partitionBy("group").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))


def first_of_next(rows: DataFrame) -> DataFrame:
    """(group, next_text): the first text of the next smaller group, for the smallest that of the largest.

    The ids of the first rows are found before their texts are fetched, so that one text per group is moved.
    """
    heads = rows.groupBy("group").agg(F.max("doc_id").alias("head"))
    found = rows.join(broadcast_if_small(heads), "group").where(F.col("doc_id").eqNullSafe(F.col("head")))
    heads = materialise(found.groupBy("group").agg(F.max("text").alias("text")), "heads")
    # one row per group, thus a thousandth of the documents
    numbered = heads.select("group", F.row_number().over(W.orderBy(F.desc("group"))).alias("place"))
    after = numbered.select((F.col("place") - 1).alias("place"), F.col("group").alias("next_group"))
    target = numbered.join(after, "place", "left").withColumn("next_group", F.coalesce("next_group", F.lit(heads.agg(F.max("group")).first()[0])))
    return target.join(heads.select(F.col("group").alias("next_group"), F.col("text").alias("next_text")), "next_group").select("group", "next_text")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sketch, edited, next_sketch): each text, and its second half replaced by the next one's beginning.

    The next text is that of the next smaller doc_id, after the smallest the first again.  One shuffle moves the texts.
    """
    rows = grouped(docs)
    rows_next = rows.withColumn("after", F.lead("text").over(_down())).withColumn("sketch", sketch("text")).withColumn("next_sketch", F.lead("sketch").over(_down()))
    out = rows_next.join(first_of_next(rows), "group")
    # only the last row of a group takes what stands beyond it
    out = out.withColumn("beyond", F.when(F.col("after").isNull(), F.col("next_text")))
    out = out.withColumn("next_sketch", F.when(F.col("beyond").isNull(), F.col("next_sketch")).otherwise(sketch("beyond"))).withColumn("after", F.coalesce("after", "beyond"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("after", F.lit(1), half))
    return out.select("doc_id", "text", "sketch", edited.alias("edited"), "next_sketch")


def op4_scaled_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and its edited text.

    Null texts count as empty: their fingerprints are empty strings, and two empty sketches are alike (1.0).  An empty
    table gives an empty result; repeated rows follow one another.
    """
    rows = edited_pairs(read(spark, folder, "documents").select("doc_id", "text")).withColumn("edited_sketch", sketch("edited"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def _sql_sketch(text: str) -> str:
    hashes = f"""CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1),
      lambda i: substr(md5(array_to_string(w[i:i + {WORDS - 1}], ' ')), 1, {DIGITS})) END"""
    return f"""(SELECT CASE WHEN len(list_filter(h, lambda x: x < '{BELOW}')) > 0 THEN list_sort(list_distinct(list_filter(h, lambda x: x < '{BELOW}')))
      WHEN len(h) > 0 THEN ['!' || list_min(h)] ELSE h END
      FROM (SELECT {hashes} AS h FROM (SELECT list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w)))"""


OP4_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, lead(text) OVER o AS after, first_value(text) OVER o AS top FROM t WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, text DESC)),
e AS (SELECT doc_id, text, coalesce(after, top) AS after FROM n),
f AS (SELECT doc_id, text, after, substr(text, 1, length(text) - length(text) // 2) || substr(after, 1, length(text) // 2) AS edited FROM e),
s AS (SELECT doc_id, text, edited, {_sql_sketch('text')} AS a, {_sql_sketch('edited')} AS b, {_sql_sketch('after')} AS c FROM f),
j AS (SELECT *, len(list_intersect(a, b)) AS ab, len(list_intersect(a, c)) AS ac FROM s)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE CAST(ab AS DOUBLE) / (len(a) + len(b) - ab) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE CAST(ac AS DOUBLE) / (len(a) + len(c) - ac) END AS near_next
FROM j
"""
