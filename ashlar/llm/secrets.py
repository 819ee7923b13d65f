"""Secret scans: fixed patterns and a battery of randomness tests.

Patterns give the base spans. Beyond them every unbroken token of ``MIN_TOKEN``
or more encoding characters that mixes two of lower case, upper case and digits
is a candidate. Its encoding is inferred (hexadecimal to base 64), and three
tests ask whether its symbols could be uniform random draws from that alphabet:
chi-squared uniformity, runs above and below the middle of the alphabet, and
lag-one serial correlation. A token's p-value is Sidak's of the least of the three,
``1 - (1 - p) ** 3``, which is uniform for random tokens.

Structured ones pile up near 0. So in each class of length the number of random
tokens is estimated from the upper half of the p-values, and the cut is the
smallest p at which the share of structured tokens above it is estimated at
``MAX_FALSE`` or less, ``LEAST_P`` at least. Long tokens, whose tests have more
power, thus get another cut than short ones. The counts of a class are joined by
``SUPPORT`` tokens spread as those of all classes, and these by as many spread evenly, as
random ones are; so a class of few tokens goes by all of them, and a table of
few by the plain test of each token (``LEAST_P``), without a step between. The p-values are
counted in ``BINS`` bins a class of length, so nothing grows with the corpus but
the span rows themselves.

Everything is DataFrame functions. Positions count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_TOKEN = 20
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}={{0,2}}"
KINDS = ("assign", "access", "hex", "random")
BINS = 100
MAX_FALSE = 0.05
LEAST_P = 0.01
SUPPORT = 100

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings in the order in which they are tried: pattern and alphabet.
ENCODINGS = (
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", _UPPER + "234567"),
    (r"^[a-z0-9]+$", _LOWER + _DIGITS),
    (r"^[A-Z0-9]+$", _UPPER + _DIGITS),
    (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    (r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    (r"^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    (r"", _UPPER + _LOWER + _DIGITS + "+/-_"),
)


def two_sided(z: Column) -> Column:
    """Two-sided p-value of a normal deviate (rational approximation of the
    complementary error function, absolute error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def mixed(token: Column) -> Column:
    """Two of lower case, upper case and digits occur."""
    kinds = [token.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]")]
    return (kinds[0] + kinds[1] + kinds[2]) >= 2


def battery(token: Column) -> Column:
    """p-value of the three tests for a token, its '=' padding left out."""
    body = F.rtrim(token, F.lit("="))
    inferred = F.lit(None).cast("string")
    for pattern, alphabet in reversed(ENCODINGS):
        inferred = F.when(body.rlike(pattern), F.lit(alphabet)).otherwise(inferred)

    def tests(s: Column) -> Column:
        codes, k = s["codes"], s["k"]
        n = F.size(codes).cast("double")
        counted = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter(codes, lambda x: x == c)).cast("double"), F.lit(2.0)))
        df = k - 1.0
        chi = k / n * counted - n
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1.0 / 3.0)) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))
        pairs = F.arrays_zip(F.slice(codes, F.lit(1), F.size(codes) - 1).alias("a"), F.slice(codes, F.lit(2), F.size(codes) - 1).alias("b"))
        middle = k / 2.0
        changes = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + ((p["a"] < middle) != (p["b"] < middle)).cast("double"))
        z_runs = (changes - (n - 1.0) / 2.0) / F.sqrt((n - 1.0) / 4.0)
        mean = (k - 1.0) / 2.0
        serial = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["a"] - mean) * (p["b"] - mean))
        z_serial = serial / (F.sqrt(n - 1.0) * (k * k - 1.0) / 12.0)
        return 1.0 - F.pow(1.0 - F.least(F.lit(1.0), two_sided(z_chi), two_sided(z_runs), two_sided(z_serial)), F.lit(3.0))

    codes = F.transform(F.split(body, ""), lambda c: (F.instr(inferred, c) - 1).cast("double"))
    state = F.array(F.struct(codes.alias("codes"), F.length(inferred).cast("double").alias("k")))
    return F.transform(state, tests)[0]


def _pieces(kind: int, pattern: str, drop) -> Column:
    """For each match of a pattern: its kind, number, the lengths of the text
    before it and of itself, the match, and whether it fails."""
    text = F.col("text")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    made = F.transform(hits, lambda h, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.get(gaps, i).alias("gap"), F.length(h).alias("len"), h.alias("hit"), drop(h).alias("drop")))
    return F.when(text.rlike(pattern), made)


def matches(docs: DataFrame) -> DataFrame:
    """docs (rid, doc_id, text) exploded to one row a match, with start and end;
    a document without any match keeps one row of nulls."""
    never = lambda h: F.lit(False)
    short = lambda h: F.length(F.regexp_extract(h, ASSIGN, 1)) < 8
    kinds = [_pieces(0, ASSIGN, short), _pieces(1, ACCESS, never), _pieces(2, HEX, never), _pieces(3, TOKEN, lambda h: ~mixed(h))]
    found = docs.select("rid", "doc_id", *[k.alias(f"k{i}") for i, k in enumerate(kinds)])
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,hit:string,drop:boolean>>")
    found = found.select("rid", "doc_id", F.explode_outer(F.concat(*[F.coalesce(F.col(f"k{i}"), none) for i in range(4)])).alias("m"))
    found = found.select("rid", "doc_id", "m.*").repartition("rid")
    in_order = W.partitionBy("rid", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(in_order)
    found = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    return found.filter(F.col("kind").isNull() | ~F.col("drop") | (F.col("i") == 0)).withColumn("kind", F.when(~F.coalesce("drop", F.lit(False)), F.col("kind"))).drop("i", "gap", "len", "drop")


def cuts(spans: DataFrame) -> DataFrame:
    """length_class, cut: for each class of length (a power of two) the p-value
    from which on a token counts as random; see the module's text. A class without row
    has none. Works on a count for each class and bin."""
    bins = spans.filter("kind = 3").groupBy("length_class", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = bins.select("length_class").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    grid = grid.join(bins, ["length_class", "bin"], "left").fillna(0, ["n"])
    pool = F.sum("n").over(W.partitionBy("bin")) + F.lit(SUPPORT / BINS)
    share = pool / (F.sum("n").over(W.partitionBy()) + F.lit(float(SUPPORT)))
    grid = grid.withColumn("m", F.col("n") + F.lit(float(SUPPORT)) * share)
    whole = W.partitionBy("length_class")
    above = F.sum("m").over(whole.orderBy(F.col("bin").desc()))
    rate = F.sum(F.when(F.col("bin") >= BINS // 2, F.col("m")).otherwise(0.0)).over(whole) * 2.0
    grid = grid.withColumn("false", 1.0 - rate * (1.0 - F.col("bin") / float(BINS)) / above).filter(F.col("false") <= MAX_FALSE)
    return grid.groupBy("length_class").agg(F.greatest(F.min("bin") / float(BINS), F.lit(LEAST_P)).alias("cut"))


def scan(docs: DataFrame) -> DataFrame:
    """rid, doc_id, secrets: the spans of every document, as an array of
    (start, kind, end) by start, then kind (0 to 3 as in ``KINDS``).

    ``docs`` has rid (unique), doc_id and text. A random token that touches a
    base span is not added. A null or empty text has no span.
    """
    spans = matches(docs)
    size = F.length("hit")
    spans = durable(
        spans.withColumn("p", F.when(F.col("kind") == 3, battery(F.col("hit"))))
        .withColumn("length_class", F.when(F.col("kind") == 3, F.floor(F.log2(size.cast("double")))).cast("int"))
        .drop("hit"),
        "secret-spans",
    )
    spans = spans.join(F.broadcast(cuts(spans)), "length_class", "left")  # at most 31 rows: one a power of two
    spans = spans.withColumn("span", F.when(F.col("kind").isNotNull() & ((F.col("kind") < 3) | (F.col("p") >= F.col("cut"))), F.struct("start", "kind", "end")))
    found = spans.groupBy("rid", "doc_id").agg(F.array_sort(F.collect_list("span")).alias("all"))
    # Base spans in order of start, with the furthest end so far, decide overlap in one pass.
    base = F.filter("all", lambda s: s["kind"] < 3)
    added = F.filter("all", lambda s: (s["kind"] == 3) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.select("rid", "doc_id", F.array_sort(F.concat(base, added)).alias("secrets"))


def joined(secrets: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op7 for every row of ``docs`` (doc_id, text; other columns
    are not read). Rows that repeat an id stay rows of their own."""
    found = scan(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"))
    of = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select("doc_id", of(0), of(1), of(2), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), of(3))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``.

    Texts without secrets and all other columns stay, but a column n_chars
    follows the new text. The corpus is read twice, first for the cuts (at most
    one number a power of two of token length), then to rewrite each row on its
    own: no text is shuffled.
    """
    text = F.col("text")
    tokens = docs.select(F.explode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("hit")).filter(mixed(F.col("hit")))
    measured = tokens.select(F.lit(3).alias("kind"), F.floor(F.log2(F.length("hit").cast("double"))).cast("int").alias("length_class"), battery(F.col("hit")).alias("p"))
    bounds = {r["length_class"]: r["cut"] for r in cuts(measured).collect() if r["cut"] is not None}
    cut = F.array(*[F.lit(bounds.get(k, 2.0)) for k in range(32)])

    def rewritten(text: Column, pattern: str, secret) -> Column:
        hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.when(secret(h), F.lit(mask)).otherwise(h))
        pieces = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, h: F.concat(gap, F.coalesce(h, F.lit(""))))
        return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)

    random = lambda h: mixed(h) & (battery(h) >= F.element_at(cut, F.floor(F.log2(F.length(h).cast("double"))).cast("int") + 1))
    out = docs.withColumn("text", rewritten(text, ASSIGN, lambda h: F.length(F.regexp_extract(h, ASSIGN, 1)) >= 8))
    out = out.withColumn("text", F.regexp_replace("text", f"{ACCESS}|{HEX}", mask.replace("$", "\\$")))
    out = out.withColumn("text", rewritten(text, TOKEN, random))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


QUERIES = {"op7_secret_scan": op7_secret_scan}


def _oracle() -> str:
    patterns = (ASSIGN, ACCESS, HEX, TOKEN.split(")", 1)[1])  # runs are maximal, so the look-behind changes nothing
    quoted = [p.replace("'", "''") for p in patterns]
    hits = "\n  union all ".join(
        f"select rid, {k} as kind, unnest(regexp_extract_all(text, '{q}')) as hit, unnest(string_split_regex(text, '{q}')[1:len(regexp_extract_all(text, '{q}'))]) as gap, "
        f"generate_subscripts(regexp_extract_all(text, '{q}'), 1) as i from docs where regexp_matches(text, '{q}')"
        for k, q in enumerate(quoted)
    )
    alphabet = "case " + " ".join(f"when regexp_matches(body, '{p}') then '{a}'" for p, a in ENCODINGS[:-1]) + f" else '{ENCODINGS[-1][1]}' end"
    tail = lambda z: f"(t_{z} * (0.254829592 + t_{z} * (-0.284496736::double + t_{z} * (1.421413741 + t_{z} * (-1.453152027::double + t_{z} * 1.061405429::double)))) * exp(-{z} * {z} / 2.0::double))"
    name = "['" + "', '".join(KINDS) + "'][kind + 1]"
    joined = f"coalesce(string_agg({name} || ':' || start || ':' || stop, ',' order by start, kind"
    return f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
hits as ({hits}),
placed as (select *, (sum(length(gap) + length(hit)) over (partition by rid, kind order by i))::bigint as stop from hits),
kept as (select rid, kind, hit, stop - length(hit) as start, stop, rtrim(hit, '=') as body from placed
  where case kind when 0 then length(regexp_extract(hit, '{quoted[0]}', 1)) >= 8 when 3 then regexp_matches(hit, '[a-z]')::int + regexp_matches(hit, '[A-Z]')::int + regexp_matches(hit, '[0-9]')::int >= 2 else true end),
coded as (select *, {alphabet} as alphabet from kept where kind = 3),
listed as (select *, list_transform(string_split(body, ''), lambda c: (instr(alphabet, c) - 1)::double) as codes, length(alphabet)::double as k, length(body)::double as n from coded),
sums as (select *, list_sum(list_transform(list_distinct(codes), lambda c: power(len(list_filter(codes, lambda x: x = c)), 2)))::double as counted,
  list_sum(list_transform(range(1, n::bigint), lambda j: case when (codes[j] < k / 2) <> (codes[j + 1] < k / 2) then 1.0::double else 0 end))::double as changes,
  list_sum(list_transform(range(1, n::bigint), lambda j: (codes[j] - (k - 1) / 2) * (codes[j + 1] - (k - 1) / 2)))::double as serial from listed),
tests as (select *, (power(greatest(k / n * counted - n, 0.0::double) / (k - 1), 1.0::double / 3.0::double) - (1.0::double - 2.0::double / (9.0::double * (k - 1)))) / sqrt(2.0::double / (9.0::double * (k - 1))) as za,
  (changes - (n - 1) / 2) / sqrt((n - 1) / 4) as zb, serial / (sqrt(n - 1) * (k * k - 1) / 12) as zc from sums),
tails as (select *, 1.0::double / (1.0::double + 0.3275911::double * abs(za) / sqrt(2.0::double)) as t_za, 1.0::double / (1.0::double + 0.3275911::double * abs(zb) / sqrt(2.0::double)) as t_zb, 1.0::double / (1.0::double + 0.3275911::double * abs(zc) / sqrt(2.0::double)) as t_zc from tests),
judged as (select rid, start, stop, floor(log2(length(hit)))::int as length_class, 1.0::double - power(1.0::double - least(1.0::double, {tail("za")}, {tail("zb")}, {tail("zc")}), 3.0::double) as p from tails),
bins as (select length_class, least(floor(p * {BINS}), {BINS - 1})::bigint as bin, count(*) as n from judged group by all),
grid as (select c.length_class, c.bin, coalesce(b.n, 0) as n from (select length_class, unnest(range({BINS})) as bin from (select distinct length_class from bins)) c left join bins b using (length_class, bin)),
pooled as (select *, n + {float(SUPPORT)}::double * ((sum(n) over (partition by bin) + {SUPPORT / BINS}::double) / (sum(n) over () + {float(SUPPORT)}::double)) as m from grid),
shares as (select *, 1.0::double - sum(case when bin >= {BINS // 2} then m else 0 end) over (partition by length_class) * 2.0::double * (1.0::double - bin / {float(BINS)}::double)
  / sum(m) over (partition by length_class order by bin desc) as false_share from pooled),
cuts as (select length_class, greatest(min(bin) / {float(BINS)}::double, {LEAST_P}::double) as cut from shares where false_share <= {MAX_FALSE}::double group by length_class),
spans as (select rid, kind, start, stop from kept where kind < 3
  union all select j.rid, 3, j.start, j.stop from judged j join cuts c using (length_class) where j.p >= c.cut and not exists (select 1 from kept b where b.kind < 3 and b.rid = j.rid and b.start < j.stop and j.start < b.stop))
select any_value(d.doc_id) as doc_id, count(*) filter (kind = 0)::bigint as n_assign, count(*) filter (kind = 1)::bigint as n_access, count(*) filter (kind = 2)::bigint as n_hex, count(*) filter (kind = 3)::bigint as n_random,
  sha256({joined}) filter (kind < 3), '')) as base_sha256, {joined}) filter (kind is not null), '') as spans
from docs d left join spans s on s.rid = d.rid group by d.rid
"""


ORACLES = {"op7_secret_scan": _oracle()}
