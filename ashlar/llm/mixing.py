"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / w``: ``u`` is fixed by its id
and text, so that rows that repeat an id, or have none, spread over all keys;
``w`` is its quality weight. Within its source the documents are ordered by
key and their sizes prefix-summed to the source's budget; before that, whole
epochs are taken while the budget holds the whole source.

The prefix sums are made in two levels, so that no source is ever sorted in one
task: the keys of a source are cut into up to ``MAX_BUCKETS`` ranges of about
``BUCKET_ROWS`` documents; sums a range tell which ranges are taken whole or
not at all, and only the range in which the budget ends is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, table, uniform, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2.0
BUCKET_ROWS, MAX_BUCKETS = 256, 4096
SEED = "mix-1"


def quality_weight(text: Column, size: Column) -> Column:
    """0.25 to 1, highest where words are 6.5 characters long on the mean with
    the space after them; 0.25 for a text without words."""
    mean = F.length(text) / size
    return F.coalesce(F.when(size > 0, F.lit(0.25) + F.lit(0.75) / (F.lit(1.0) + F.abs(mean - 6.5) / 6.5)), F.lit(0.25))


def source_targets(stats: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(skey, source_size, ...) with rank and ``target`` added.

    The total ``share`` * all sizes is dealt by weight; a source stops at
    ``max_epochs`` times its size and the excess is dealt anew until none is
    above. That fixpoint is the water level: sources in order of cap / weight
    are full as long as the level of the rest lies above their cap, and the first
    that is not has the level (further on it only falls). Works on
    one row a source.
    """
    by_name = W.orderBy("skey")
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    ranked = stats.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    fill = W.orderBy(F.col("cap") / F.col("weight"), "skey").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        ranked.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("at", F.max(F.when(F.col("open"), F.col("level"))).over(every))
        .withColumn("target", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at") * F.col("weight"))))
        .drop("total", "level", "open", "at", "cap")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, source: one row a document.

    ``taken`` is the words of the document that the mix holds: its size times
    the whole epochs of its source, once more if the fractional epoch selects
    it. The document in which a budget ends is taken if that brings the source
    nearer to its target. A null text has size 0; a null source is a source of
    its own, the last; rows that repeat an id are documents of their own, and
    only rows of equal id and text have the same key (ties go by id, then size);
    an empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    text = F.col("text")
    rows = docs.select("doc_id", "source", text, words(text).alias("size"))
    weight = quality_weight(text, F.col("size")) if weight is None else weight
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    key = -F.log(uniform(named, seed)) / weight
    skey = F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce("source", F.lit("")))
    rows = durable(rows.select("doc_id", "source", "size", skey.alias("skey"), key.alias("key")), "mix")

    stats = rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.avg("key").alias("mean_key"))
    n_buckets = F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("n") / F.lit(BUCKET_ROWS))).cast("double")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = durable(
        source_targets(stats, weights, share)
        .withColumn("n_buckets", n_buckets)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .select("skey", "source_size", "target", "mean_key", "n_buckets", "epochs", "rest"),
        "mix-plan",
    )
    bucket = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key") / F.col("mean_key"))) * F.col("n_buckets")), F.col("n_buckets") - 1).cast("long")
    placed = rows.join(plan, "skey").withColumn("bucket", bucket)

    sums = placed.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    placed = placed.join(sums, ["skey", "bucket"])
    ends_here = (F.col("start") <= F.col("rest")) & (F.col("start") + F.col("bucket_size") > F.col("rest"))
    clear = placed.filter(~ends_here).withColumn("again", (F.col("start") + F.col("bucket_size") <= F.col("rest")).cast("long"))
    in_order = W.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.col("start") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    edge = placed.filter(ends_here).withColumn("again", (ahead + F.col("size") / F.lit(2.0) <= F.col("rest")).cast("long"))
    return clear.unionByName(edge).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("again"))).alias("taken"), "source")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, length(text) as chars, md5(coalesce(text, '')) as digest from documents
), keyed as (
  select doc_id, source, size, case when source is null then '1' else '0' end || coalesce(source, '') as skey,
    -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || digest || ':mix-1'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
      / coalesce(case when size > 0 then 0.25::double + 0.75::double / (1.0::double + abs(chars / size - 6.5::double) / 6.5::double) end, 0.25::double) as key
  from sized
), stats as (
  select skey, sum(size)::bigint as source_size, [3.0, 1.0, 2.0][((row_number() over (order by skey) - 1) % 3 + 1)::int]::double as weight from keyed group by skey
), levels as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(source_size * 2.0::double) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
  from stats window w as (order by source_size * 2.0::double / weight, skey rows between unbounded preceding and 1 preceding)
), filled as (
  select *, max(case when level * weight <= source_size * 2.0::double then level end) over () as water from levels
), plan as (
  select skey, source_size, case when water is null then source_size * 2.0::double else least(source_size * 2.0::double, water * weight) end as target from filled
), ordered as (
  select k.*, p.source_size, p.target, case when p.source_size > 0 then floor(p.target / p.source_size)::bigint else 0 end as epochs,
    coalesce(sum(k.size) over (partition by k.skey order by k.key, k.doc_id, k.size rows between unbounded preceding and 1 preceding), 0) as ahead
  from keyed k join plan p using (skey)
)
select doc_id, size, source_size, target,
  (size * (epochs + case when ahead + size / 2.0::double <= target - epochs * source_size then 1 else 0 end))::bigint as taken, source
from ordered
"""
QUERIES = {"op9_mix_sources": op9_mix_sources}
ORACLES = {"op9_mix_sources": OP9_SQL}
