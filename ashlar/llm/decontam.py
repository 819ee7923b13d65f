"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are far smaller than the documents that may hold them, so a signature
of the document would be swamped. Items are partitioned by size (powers of two of
their distinct shingles) and sketched: for each of m hash functions, m by the
partition, the item's shingle of the smallest hash. A document's shingles are
looked up in these sketches alone. An item of which a share c stands in a document
has each sketch shingle there with chance c, so at containment ``SIMILARITY`` no
hit at all has a chance below ``MISS``. What is hit is a candidate pair; only
documents of such pairs are read again, and the pair is verified by the exact share
of the item's distinct shingles that the document holds.

A shingle is five words (lower case, without punctuation) as a 64-bit hash; of an
item of fewer words it is all of them, and documents are cut to runs of that
length as well. Items with the same shingles are one, named by its least id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

SHINGLE = 5
SIMILARITY = 0.8
MISS = 1e-9
SKETCH = math.ceil(math.log(MISS) / math.log(1.0 - SIMILARITY))
#: Rows of 16 to 24 bytes up to which a counted table is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def shingles(text: Column, sizes: tuple[int, ...] = (SHINGLE,)) -> Column:
    """Distinct hashes of the runs of each of ``sizes`` words; none for null."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    hashed = F.transform(F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")

    def windows(k: int):
        run = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return lambda h: F.when(F.size(h) >= k, run(h)).otherwise(none)

    made = [F.transform(F.array(hashed), windows(k))[0] for k in sizes]
    return F.array_distinct(F.concat(*made) if len(made) > 1 else made[0])


def item_sets(items: DataFrame) -> DataFrame:
    """item_id, item_ids, k, set, sketch: one row a distinct item. ``item_ids``
    has the ids of all items with these shingles, comma-joined."""
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    k = F.least(F.size(F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(SHINGLE))
    own = F.lit(None).cast("array<bigint>")
    for size in range(1, SHINGLE + 1):
        own = F.when(F.col("k") == size, shingles(F.col("text"), (size,))).otherwise(own)
    made = items.select(F.col("item_id").cast("long").alias("item_id"), "text", k.alias("k")).filter("k > 0")
    made = made.select("item_id", "k", F.array_sort(own).alias("set")).groupBy("k", "set").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    size_class = F.floor(F.log2(F.size("set").cast("double"))).cast("int")
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return made.select(F.get("ids", F.lit(0)).alias("item_id"), joined.alias("item_ids"), "k", "set", sketch(F.col("set"), size_class).alias("sketch"))


def sketch(items: Column, size_class: Column) -> Column:
    """The item's shingles of least hash under the hash functions of its partition."""
    m = F.least(F.lit(SKETCH), F.pow(F.lit(2.0), size_class + 1).cast("int"))
    least = lambda j: F.array_min(F.transform(items, lambda s: F.struct(F.xxhash64(s, j).alias("h"), s.alias("s"))))["s"]
    return F.array_distinct(F.transform(F.sequence(F.lit(1), m), least))


def search(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, item_id, item_ids, n_shared, n_shingles, containment: one
    row for each document row and distinct item contained to ``similarity`` or more.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are
    not read. Null and empty texts hold and are nothing; items without id are not
    searched; rows that repeat are found each.
    """
    sets = durable(item_sets(items.filter("item_id is not null")), "item-sets")
    sizes = tuple(sorted(r["k"] for r in sets.select("k").distinct().collect())) or (SHINGLE,)  # SHINGLE numbers at most
    looked_up = sets.select(F.explode("sketch").alias("s"), "item_id")
    bounded = lambda df, most: F.broadcast(df) if df.limit(most + 1).count() <= most else df
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    each = rows.select("text_hash", F.explode(shingles(F.col("text"), sizes)).alias("s"))
    candidates = durable(each.join(bounded(looked_up, BROADCAST_ROWS), "s").select("text_hash", "item_id").distinct(), "candidates")
    pairs = candidates.groupBy("text_hash").agg(F.collect_set("item_id").alias("items"))  # a text's candidates: items of the benchmark
    held = rows.join(bounded(pairs, BROADCAST_ROWS), "text_hash").select("doc_id", "text_hash", "items", shingles(F.col("text"), sizes).alias("held"))
    pair = held.select("doc_id", "text_hash", "held", F.explode("items").alias("item_id")).join(bounded(sets.select("item_id", "item_ids", "set"), BROADCAST_ROWS // 64), "item_id")
    found = pair.select("doc_id", "text_hash", "item_id", "item_ids", F.size(F.array_intersect("set", "held")).cast("long").alias("n_shared"), F.size("set").cast("long").alias("n_shingles"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= similarity)


def drop_contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that contain an item, all columns kept."""
    found = search(docs, items, similarity).select(F.col("text_hash").alias("__hash")).distinct()
    return docs.join(found, F.xxhash64("text") == F.col("__hash"), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it contains."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


_PLAIN = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
OP8_SQL = f"""
with item_words as (
  select item_id, {_PLAIN} as w from benchmark where item_id is not null
), item_sets as (
  select item_id, least(5, len(w)) as k, list_sort(list_distinct(list_transform(generate_series(1, len(w) - least(5, len(w)) + 1), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' ')))) as shingles from item_words where len(w) > 0
), items as (
  select min(item_id) as item_id, string_agg(item_id::varchar, ',' order by item_id) as item_ids, k, shingles, len(shingles) as n_shingles from item_sets group by k, shingles
), vocabulary as (
  select item_id, item_ids, n_shingles, k, unnest(shingles) as s from items
), doc_words as (
  select row_number() over () as rid, doc_id, {_PLAIN} as w from documents
), doc_shingles as (
  select rid, doc_id, k, unnest(list_distinct(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' ')))) as s
  from doc_words, (select distinct k from items) where len(w) >= k
)
select doc_id, item_id, item_ids, count(*) as n_shared, n_shingles, count(*) / n_shingles as containment
from doc_shingles join vocabulary using (k, s) group by rid, doc_id, item_id, item_ids, n_shingles having count(*) / n_shingles >= 0.8
"""
QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLES = {"op8_decontaminate": OP8_SQL}
