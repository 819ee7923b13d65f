"""Spelling variants: a trie self-join with active-node sets over the vocabulary.

Two words are near if one inserted, deleted or replaced code point parts them.
In a trie every node carries its active nodes: those whose strings are within
distance one of its own. They are handed down: the node of ``xc`` gets the node
of ``x``, the siblings, its own children, and from every node at distance one
of ``x`` the child by ``c``. Where a node and an active one both end words the pair
is near.

The vocabulary's trie is parted by prefixes. With one edit, two words whose
shorter one has L code points share their first L/2 or their last L/2, so each
word is put under both, for each length the shorter word can have; the words that
share a prefix (or an ending) are one part, and its trie holds what lies between.
A part of more than ``PART`` words is parted again by the halves of what its words do
not share yet. One code point is left in the end, so parts are bounded by
the alphabet however skewed the vocabulary is. A pair is emitted once: under the ending
only if it does not meet under the prefix.

Tokens are counted by Spark's functions with map-side sums; tries live in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, release, table
from .urls import lower_ascii

LEAST_CHARS, LEAST_COUNT, DOMINATES = 5, 3, 2
PART = 4096
_KEY = ["size", "lo", "hi", "bar", "head", "tail"]


def changed(doc_id: Column, run: Column, modulus: int = 97) -> Column:
    """``run`` without one code point, where ``modulus`` divides the CRC-32 of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % modulus == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts that are long and frequent enough.

    A run of letters that is too short cannot become a word by losing a letter, so
    only longer ones are taken from the texts.
    """
    runs = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"[a-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))
    tokens = docs.select("doc_id", F.explode(runs).alias("run")).select(changed(F.col("doc_id"), F.col("run")).alias("word"))
    return tokens.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def trie_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of positions of ``words`` (all different) at distance one, each once."""
    kids: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, word in enumerate(words):
        at = 0
        for c in word:
            to = kids[at].get(c)
            if to is None:
                to = kids[at][c] = len(kids)
                kids.append({})
                ends.append(-1)
            at = to
        ends[at] = i
    todo = [(0, set(kids[0].values()))]
    while todo:
        node, active = todo.pop()
        own = ends[node]
        if own >= 0:
            for other in active:
                if ends[other] > own:
                    yield own, ends[other]
        below = kids[node]
        if not below:
            continue
        near = set(below.values())
        near.add(node)
        for c, child in below.items():
            handed = near | set(kids[child].values())
            for other in active:
                to = kids[other].get(c)
                if to is not None:
                    handed.add(to)
            handed.discard(child)
            todo.append((child, handed))


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near pairs of the rows of a partition, which is sorted by part."""

    def pairs(size: int, lo: int, hi: int, bar: int, part: list[tuple[str, int]]) -> Iterator[tuple]:
        for i, j in trie_pairs([w[lo : len(w) - hi] for w, _ in part]):
            (a, na), (b, nb) = part[i], part[j]
            if min(len(a), len(b)) == size and (bar < 0 or a[:bar] != b[:bar]):
                yield a, na, b, nb

    out: list[tuple] = []
    key, part = None, []
    for batch in batches:
        for *at, word, n in zip(*(batch[c] for c in [*_KEY, "word", "n"]), strict=True):
            if at != key:
                if len(part) > 1:
                    out.extend(pairs(*key[:4], part))
                key, part = at, []
            part.append((word, n))
        yield pd.DataFrame(out, columns=["a", "na", "b", "nb"])
        out = []
    if len(part) > 1:
        yield pd.DataFrame(list(pairs(*key[:4], part)), columns=["a", "na", "b", "nb"])


def _halved(rows: DataFrame) -> DataFrame:
    """Every row under the first and under the last half of what its part does not share."""
    half = F.floor((F.col("size") - F.col("lo") - F.col("hi")) / 2).cast("int")
    edge = F.col("lo") + half
    head = F.struct(edge.alias("lo"), F.col("hi").alias("hi"), F.col("bar").alias("bar"))
    tail = F.struct(F.col("lo").alias("lo"), (F.col("hi") + half).alias("hi"), F.when(F.col("bar") < 0, edge).otherwise(F.least("bar", edge)).alias("bar"))
    halves = rows.select("word", "n", "size", F.explode(F.array(head, tail)).alias("h")).select("word", "n", "size", "h.*")
    return halves.withColumns({"head": F.substring("word", F.lit(1), F.col("lo")), "tail": F.substring("word", F.length("word") - F.col("hi") + 1, F.col("hi"))})


def near_pairs(vocab: DataFrame, part: int = PART) -> DataFrame:
    """a, na, b, nb: every two words (word, n; words differ) at distance one, once."""
    sizes = F.explode(F.array(F.length("word"), F.length("word") - 1))
    rows = vocab.select("word", "n", sizes.alias("size")).filter(F.col("size") > 0)
    rows = rows.withColumns({"lo": F.lit(0), "hi": F.lit(0), "bar": F.lit(-1)})
    found = None
    while True:
        halves = _halved(rows)
        parts = halves.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("words"))
        # a part of one word joins nothing; what shares all but one code point is never parted again
        crowded = (F.col("words") > part) & (F.col("size") - F.col("lo") - F.col("hi") > 1)
        placed = durable(halves.join(parts.filter("words > 1").withColumn("crowded", crowded), _KEY), "parts")
        ready = placed.filter(~F.col("crowded")).select(*_KEY, "word", "n")
        made = ready.repartition(*_KEY).sortWithinPartitions(*_KEY, "word").mapInPandas(_joined, "a string, na long, b string, nb long")
        found = made if found is None else found.unionByName(made)
        rows = placed.filter("crowded").select("word", "n", "size", "lo", "hi", "bar")
        if rows.isEmpty():
            return found


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow from a word (word, form).

    Forms lead to ever more frequent words; the way is halved in every round.
    """
    at = durable(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = durable(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        release(at)
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, part: int = PART, dominates: int = DOMINATES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts.

    ``form`` is the near word of the largest count (ties: the first in code-point
    order) if that is ``dominates`` times the word's own or more, else null;
    ``root`` the last of the forms that follow, the word itself without one.

    Null and empty texts hold no words; a null id counts as an empty one; rows that
    repeat count again; words of any length are joined, in memory that grows with
    their length; an empty table gives no rows; other columns are not read.
    """
    vocab = durable(vocabulary(docs), "vocabulary")
    pairs = durable(near_pairs(vocab, part), "near")
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n"))))
    best = pairs.select(ends.alias("e")).groupBy("e.word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("e.near_n")).alias("down"), F.col("e.near").alias("near"))).alias("best"))
    leads = -F.col("best.down") >= F.col("n") * dominates
    words = vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.down")).alias("form_n")
    )
    words = durable(words, "words")
    ways = roots(words.filter(F.col("form").isNotNull()))
    return words.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


# CRC-32 byte by byte from a table made by its polynomial; near words meet on themselves or on what one deletion leaves.
OP11_SQL = r"""
with recursive crc as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) order by i) as t from (select unnest(range(256)) as i)
), runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{5,}')) as run from documents
), counted as (
  select run, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as bytes, count(*) as n from runs group by run, doc_id
), hashed as (
  select run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(bytes) // 2), lambda i: ('0x' || substr(bytes, (i * 2 + 1)::bigint, 2))::bigint)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) as h from counted, crc
), words as materialized (
  select word, sum(n)::bigint as n from (
    select case when h % 97 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run) + 2)::bigint) else run end as word, n from hashed
  ) where length(word) >= 5 group by word having sum(n) >= 3
), cut as (
  select word, n, p, left(word, p - 1) || substr(word, p + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as p from words)
), near as (
  select distinct a.word, b.word as other, b.n as other_n from cut a join cut b on a.rest = b.rest and a.p = b.p and a.word <> b.word
  union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
  union select b.word, a.word, a.n from cut a join words b on a.rest = b.word
), best as (
  select word, count(*)::bigint as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word
), formed as materialized (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when other_n >= 2 * w.n then other end as form, case when other_n >= 2 * w.n then other_n end as form_n
  from words w left join best b using (word)
), ways as (
  select word, word as at, form as further from formed
  union all select w.word, f.word, f.form from ways w join formed f on f.word = w.further
)
select f.word, f.form, w.at as root, f.n, f.n_near, f.form_n from formed f join ways w on w.word = f.word and w.further is null
"""
QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLES = {"op11_spelling_variants": OP11_SQL}
