"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

A text is cut without loss into leaves: sentences, with at most ``LEAF`` code
points before the mark that ends them. A line is a paragraph, the leaves of it. A
section ends after a blank line and after a paragraph whose digest says so (one in
four), so that an insertion moves the borders of its own section alone. The node of
a leaf is the MD5 of its text with its length, that of a section the MD5 of its
paragraphs, and the root the SHA-256 of the sections' nodes.

The fingerprint is the tree as text: the root, then for each section its node
and leaves, cut to twelve hexadecimal digits:
``root|section=leaf:length,leaf:length;leaf:length|...``. Equal texts have equal
fingerprints; roots tell texts apart; two trees are compared from above: sections
that both hold are not entered, of the others equal paragraphs are not, and
what is left is compared leaf by leaf. The same order locates an edit.

All of it is column functions within a row. Only the order of the documents,
which gives each its next one, moves texts, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, table

LEAF = 160
PIECE = rf"[^\n.!?]{{1,{LEAF}}}[.!?]*\n?|[.!?]+\n?|\n"
BLANK = "68b329da9893e34099c7d8ad5cb9c940:1"  # the leaf of a lone line feed: its MD5 and length
RANGE_ROWS, MAX_RANGES, HEADS = 128, 16384, 100_000


def fingerprint(text: Column) -> Column:
    """The tree of a text (null: empty), as text."""
    return _serialised(_sections(text))


def _sections(text: Column) -> Column:
    """The sections of a text, each the text of its leaves with whole digests."""
    leaves = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    marked = F.transform(leaves, lambda x: F.concat(F.md5(x.cast("binary")), F.lit(":"), F.length(x).cast("string"), F.when(x.endswith("\n"), F.lit(";")).otherwise(F.lit(","))))
    paragraphs = F.split(F.regexp_replace(F.array_join(marked, ""), "[,;]$", ""), ";")
    ends = lambda p: (F.substring(F.md5(p.cast("binary")), 1, 1) < "4") | (p == BLANK)
    joined = F.array_join(F.transform(paragraphs, lambda p: F.concat(p, F.when(ends(p), F.lit("|")).otherwise(F.lit(";")))), "")
    return F.split(F.regexp_replace(joined, "[|;]$", ""), r"\|")


def _serialised(sections: Column) -> Column:
    nodes = F.transform(sections, lambda s: F.md5(s.cast("binary")))
    root = F.sha2(F.array_join(nodes, ""), 256)
    short = F.transform(sections, lambda s: F.concat(F.substring(F.md5(s.cast("binary")), 1, 12), F.lit("="), F.regexp_replace(s, "([0-9a-f]{12})[0-9a-f]{20}:", "$1:")))
    return F.concat(root, F.lit("|"), F.array_join(short, "|"))


def _branches(tree: Column) -> Column:
    return F.slice(F.split(tree, r"\|"), F.lit(2), F.size(F.split(tree, r"\|")))


def _weight(parts: Column) -> Column:
    """Code points of all leaves of a list of sections, paragraphs or leaves."""
    return F.aggregate(F.regexp_extract_all(F.array_join(parts, ","), F.lit(r":(\d+)"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """Share of two trees' code points, 0 to 1, that lies in branches of both.

    Twice the common ones by the sum of both; a branch that repeats among its
    like counts once. 1 for equal fingerprints, 0 if one text is empty.
    """
    left, right = _branches(a), _branches(b)
    same = F.array_intersect(left, right)
    inner = lambda parts: F.flatten(F.transform(parts, lambda s: F.split(F.substring_index(s, "=", -1), ";")))
    leaves = lambda parts: F.array_distinct(F.flatten(F.transform(parts, lambda p: F.split(p, ","))))
    # arrays that are used more than once are bound by one-element transforms, so that they are made once
    at_leaves = lambda x: F.struct(x["c"].alias("c"), F.array_intersect(x["l"], x["r"]).alias("s"), x["l"].alias("l"), x["r"].alias("r"))
    by_paragraph = F.transform(
        F.array(F.struct(_weight(same).alias("c"), inner(F.array_except(left, right)).alias("l"), inner(F.array_except(right, left)).alias("r"))),
        lambda x: F.struct((x["c"] + _weight(F.array_intersect(x["l"], x["r"]))).alias("c"), leaves(F.array_except(x["l"], x["r"])).alias("l"), leaves(F.array_except(x["r"], x["l"])).alias("r")),
    )
    sums = F.transform(F.transform(by_paragraph, at_leaves), lambda x: F.struct((x["c"] + _weight(x["s"])).alias("s"), (x["c"] * 2 + _weight(x["l"]) + _weight(x["r"])).alias("t")))
    ratio = F.transform(sums, lambda x: F.when(x["t"] > 0, x["s"] * F.lit(2.0) / x["t"]).otherwise(F.lit(0.0)))[0]
    return F.when(a == b, F.lit(1.0)).otherwise(ratio)


def edit_span(a: Column, b: Column) -> Column:
    """start, end: code points of the text of ``a`` outside which it agrees with
    ``b``, up to leaves; null if the trees are equal."""
    leaves = lambda tree: F.filter(F.split(F.array_join(F.transform(_branches(tree), lambda s: F.substring_index(s, "=", -1)), ","), "[,;]"), lambda x: x != "")
    size = lambda x: F.substring_index(x, ":", -1).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("open"))

    def agreed(x: Column, y: Column) -> Column:
        step = lambda acc, p: F.when(acc["open"] & (p["x"] == p["y"]), F.struct((acc["n"] + size(p["x"])).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("open")))
        pairs = F.zip_with(x, y, lambda p, q: F.struct(F.coalesce(p, F.lit("")).alias("x"), F.coalesce(q, F.lit("-")).alias("y")))
        return F.aggregate(pairs, start, step)["n"]

    both = F.transform(F.array(F.struct(leaves(a).alias("l"), leaves(b).alias("r"))), lambda t: F.struct(
        agreed(t["l"], t["r"]).alias("head"), agreed(F.reverse(t["l"]), F.reverse(t["r"])).alias("tail"), _weight(t["l"]).alias("n")))[0]
    # one-element transforms bind; where head and tail meet in repeated leaves the span is empty at the head's end
    span = F.transform(F.array(both), lambda t: F.struct(t["head"].alias("start"), F.greatest(t["head"], t["n"] - t["tail"]).alias("end")))[0]
    return F.when(a != b, span)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: each document with the text of the next one.

    The order is descending doc_id, nulls last, ties by the MD5 of the text; the
    last document is followed by the first. Ids are cut into ranges at quantiles,
    an id that is itself a border (a hot one, or null) by the digest, and the
    next row is looked up within the range, to which the first row of the next
    range is added. So texts are shuffled once and no task gets more than a
    range; only rows that repeat both id and text are not parted.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    count = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    ranges = min(MAX_RANGES, 1 + count // RANGE_ROWS)
    borders: list[int] = []
    if ranges > 1:
        shares = F.split(F.lit(",".join(str(i / ranges) for i in range(1, ranges))), ",").cast("array<double>")
        borders = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, F.lit(10 * ranges)).alias("b")).first()["b"] or []))
    border = F.split(F.lit(",".join(map(str, borders)) or str(2**63 - 1)), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(borders).bit_length()))] or [F.lit(0)])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(border, at + step - 1) < F.col("doc_id"), at + step).otherwise(at))
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("below", below)
    alone = F.coalesce(F.get(border, F.col("below")) == F.col("doc_id"), F.col("doc_id").isNull())
    number = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("below") * 2 + alone.cast("int"))
    rows = rows.select("doc_id", "text", "digest", number.alias("range"), F.when(alone, F.substring("digest", 1, 3)).otherwise(F.lit("")).alias("part"))

    heads = rows.groupBy("range", "part").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("down"), "digest")).alias("h"))
    every = W.orderBy(F.desc("range"), "part")  # one row a range
    around = every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    here = F.struct("range", "part")
    heads = heads.withColumn("to", F.coalesce(F.lag(here).over(every), F.last(here).over(around)))
    heads = durable(heads.select("range", "part", F.bitwise_not("h.down").alias("head_id"), F.col("h.digest").alias("head_digest"), "to"), "heads")
    found = F.broadcast(heads) if heads.count() <= HEADS else heads
    extra = rows.join(found, ["range", "part"]).filter(F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("digest") == F.col("head_digest")))
    extra = extra.select("doc_id", "text", "digest", "to.range", "to.part", F.lit(True).alias("extra"))
    order = W.partitionBy("range", "part").orderBy("extra", F.desc_nulls_last("doc_id"), "digest")
    both = rows.withColumn("extra", F.lit(False)).unionByName(extra)
    return both.withColumn("next_text", F.lead("text").over(order)).filter(~F.col("extra")).select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of an edited form of it, and how alike they are.

    doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint,
    near_edited, near_next (likeness to the edited text's and to the next document's
    fingerprint), edit_start, edit_end (code points of the text that hold the edit;
    null if the texts are equal). Edited text: the last floor(n/2) code points are
    replaced by the first as many of the next document (``with_next``).

    A null text is an empty one, whose tree has no leaf. A document that is alone
    is its own next. Equal rows have equal fingerprints, and each has the other as
    its next. Very long texts take memory in proportion within their row; an
    empty table gives no rows; other columns are not read.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("half")), F.substring("next_text", F.lit(1), F.col("half")))
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumns({"s": _sections(F.col("text")), "e": _sections(F.col("edited")), "x": _sections(F.col("next_text"))}).drop("text", "next_text", "half")
    rows = rows.withColumns({"fingerprint": _serialised(F.col("s")), "edited_fingerprint": _serialised(F.col("e")), "next_fingerprint": _serialised(F.col("x"))})
    own, other, following = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    rows = rows.withColumns({"near_edited": likeness(own, other), "near_next": likeness(own, following), "span": edit_span(own, other)})
    return rows.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.col("span.start").alias("edit_start"), F.col("span.end").alias("edit_end"))


def op12_doc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints(table(spark, sf_dir, "documents"))
    return made.withColumn("edited_sha256", F.sha2(F.col("edited"), 256)).drop("edited")


def _tree_sql(text: str) -> str:
    """SQL for a row of the tree's sections: ``s`` with whole digests, ``f`` the fingerprint."""
    return rf"""(select sha256(array_to_string(list_transform(s, lambda v: md5(v)), '')) || '|' || array_to_string(list_transform(s, lambda v:
      substr(md5(v), 1, 12) || '=' || regexp_replace(v, '([0-9a-f]{{12}})[0-9a-f]{{20}}:', '\1:', 'g')), '|') from (
      select string_split(regexp_replace(array_to_string(list_transform(p, lambda v: v || case when substr(md5(v), 1, 1) < '4' or v = '{BLANK}' then '|' else ';' end), ''), '[|;]$', ''), '|') as s from (
      select string_split(regexp_replace(array_to_string(list_transform(regexp_extract_all({text}, '{PIECE}'), lambda v:
        md5(v) || ':' || length(v) || case when v[-1] = chr(10) then ';' else ',' end), ''), '[,;]$', ''), ';') as p)))"""


def _weight_sql(parts: str) -> str:
    return rf"coalesce(list_sum(list_transform(regexp_extract_all(array_to_string({parts}, ','), ':(\d+)', 1), lambda v: v::bigint)), 0)::bigint"


def _except_sql(a: str, b: str) -> str:
    return f"list_filter(list_distinct({a}), lambda v: not list_contains({b}, v))"


def _near_sql(name: str, a: str, b: str) -> str:
    """CTEs that give ``name`` (doc_id, near) from the trees in columns a and b of ``trees``."""
    inner = lambda x: f"flatten(list_transform({x}, lambda v: string_split(v[14:], ';')))"
    leaves = lambda x: f"list_distinct(flatten(list_transform({x}, lambda v: string_split(v, ','))))"
    return f"""{name}_1 as (
  select doc_id, {a} = {b} as same, string_split({a}, '|')[2:] as l, string_split({b}, '|')[2:] as r from trees
), {name}_2 as (
  select doc_id, same, {_weight_sql("list_intersect(l, r)")} as c, {inner(_except_sql("l", "r"))} as l, {inner(_except_sql("r", "l"))} as r from {name}_1
), {name}_3 as (
  select doc_id, same, c + {_weight_sql("list_intersect(l, r)")} as c, {leaves(_except_sql("l", "r"))} as l, {leaves(_except_sql("r", "l"))} as r from {name}_2
), {name}_4 as (
  select doc_id, same, c + {_weight_sql("list_intersect(l, r)")} as s, c * 2 + {_weight_sql("l")} + {_weight_sql("r")} as t from {name}_3
), {name} as (
  select doc_id, case when same then 1.0::double when t > 0 then s * 2.0::double / t else 0.0::double end as near from {name}_4
)"""


# The edited span is left to a comparison leaf by leaf: unnested leaves of both trees, first and last difference.
OP12_SQL = rf"""
with texts as (
  select doc_id, coalesce(text, '') as text,
    coalesce(lead(coalesce(text, '')) over w, first_value(coalesce(text, '')) over (order by doc_id desc nulls last, md5(coalesce(text, '')))) as next_text
  from documents window w as (order by doc_id desc nulls last, md5(coalesce(text, '')))
), edits as (
  select *, length(text)::bigint as n_chars, left(text, (length(text) - length(text) // 2)::bigint) || left(next_text, (length(text) // 2)::bigint) as edited from texts
), trees as materialized (
  select doc_id, n_chars, sha256(edited) as edited_sha256, {_tree_sql("text")} as own, {_tree_sql("edited")} as other, {_tree_sql("next_text")} as following from edits
), leaves as (
  select doc_id, own, other, list_filter(regexp_split_to_array(array_to_string(list_transform(string_split(own, '|')[2:], lambda v: v[14:]), ','), '[,;]'), lambda v: v <> '') as l,
    list_filter(regexp_split_to_array(array_to_string(list_transform(string_split(other, '|')[2:], lambda v: v[14:]), ','), '[,;]'), lambda v: v <> '') as r from trees
), ends as (
  select doc_id, l, {_weight_sql("l")} as n,
    coalesce(list_position(list_transform(range(greatest(len(l), len(r))), lambda i: coalesce(l[i + 1] = r[i + 1], false)), false), 1 + len(l)) as head,
    coalesce(list_position(list_transform(range(greatest(len(l), len(r))), lambda i: coalesce(l[len(l) - i] = r[len(r) - i] and i < len(l) and i < len(r), false)), false), 1 + len(l)) as tail
  from leaves where own <> other
), spans as (
  select doc_id, {_weight_sql("l[1:head - 1]")} as edit_start, greatest({_weight_sql("l[1:head - 1]")}, n - {_weight_sql("l[len(l) - tail + 2:]")}) as edit_end from ends
), {_near_sql("edited", "own", "other")}, {_near_sql("following", "own", "following")}
select t.doc_id, t.n_chars, t.edited_sha256, t.own as fingerprint, t.other as edited_fingerprint, e.near as near_edited, f.near as near_next, s.edit_start, s.edit_end
from trees t join edited e using (doc_id) join following f using (doc_id) left join spans s using (doc_id)
"""
QUERIES = {"op12_doc_fingerprints": op12_doc_fingerprints}
ORACLES = {"op12_doc_fingerprints": OP12_SQL}
