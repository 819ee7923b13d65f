"""Text functions over columns: match positions, lines, entropy, comments, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nz(*columns: Column) -> Column:
    """The first column that is neither null, nor 0, nor empty; else the last."""
    tests = [F.when((c.cast("string") != "") & (c.cast("string") != "0"), c) for c in columns[:-1]]
    return F.coalesce(*tests, columns[-1])


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def _sums_before(values: Column, chunk: int = 256) -> Column:
    """The sum of all values before each one. Sums run within chunks and over the
    chunks' totals, so that arrays that grow by appending stay short."""
    start = lambda at: F.struct(at.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    run = lambda xs, at: F.aggregate(xs, start(at), step)["out"]
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / chunk).cast("int")), lambda i: F.slice(values, i * chunk + 1, F.lit(chunk)))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + x)
    joined = F.transform(F.array(F.struct(chunks.alias("c"))), lambda s: F.flatten(F.zip_with(s["c"], run(F.transform(s["c"], total), F.lit(0)), run)))[0]
    return F.when(F.size(values) > 0, joined).otherwise(F.array().cast("array<bigint>"))


def placed(hits: Column, gaps: Column) -> Column:
    """Array of (start 0-based, line 1-based, match) from the matches of a text and
    the pieces between them. Positions are running sums: nothing is shuffled."""
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).cast("long").alias("g"), breaks(g).cast("long").alias("gl"), (F.length(g) + F.length(h)).cast("long").alias("all"), (breaks(g) + breaks(h)).cast("long").alias("lines"), h.alias("match")))

    def run(x: Column) -> Column:
        before = F.arrays_zip(x.alias("x"), _sums_before(F.transform(x, lambda s: s["all"])).alias("at"), _sums_before(F.transform(x, lambda s: s["lines"])).alias("line"))
        return F.transform(before, lambda b: F.struct((b["at"] + b["x"]["g"]).cast("int").alias("start"), (b["line"] + b["x"]["gl"] + 1).cast("int").alias("line"), b["x"]["match"].alias("match")))

    return F.transform(F.array(sizes), run)[0]


def match_array(c: Column, pattern: str) -> Column:
    """The non-overlapping matches in a text, as ``placed`` has them; null where
    nothing matches."""
    return F.when(c.rlike(pattern), placed(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)))


def matches(df: DataFrame, key: list[str], text: str, pattern: str) -> DataFrame:
    """One row a match of ``pattern`` in column ``text``: the key columns, start, line, match."""
    return df.select(*key, F.explode(match_array(F.col(text), pattern)).alias("__m")).select(*key, "__m.start", "__m.line", "__m.match")


def entropy(c: Column) -> Column:
    """Shannon entropy in bits a character; 0 for null and empty."""
    chars = F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    state = lambda rest, bits, left, n: F.struct(rest.alias("rest"), bits.alias("bits"), left.alias("left"), n.alias("n"))

    def step(acc: Column, x: Column) -> Column:
        """Takes a character out of what is left, which so shrinks; its share is what went."""

        def less(rest: Column) -> Column:
            p = (acc["left"] - F.length(rest)) / acc["n"]
            return state(rest, acc["bits"] + -p * F.log2(p), F.length(rest), acc["n"])

        return F.transform(F.array(F.replace(acc["rest"], x, F.lit(""))), less)[0]

    start = state(c, F.lit(0.0), F.length(c), F.length(c).cast("double"))
    return F.when(F.length(c) > 0, F.aggregate(chars, start, step)["bits"]).otherwise(F.lit(0.0))


def distinct_chars(c: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def snippet(c: Column, line: Column, around: int = 2, width: int = 200) -> Column:
    """The lines around a line, each cut to ``width``."""
    first = F.greatest(line - around, F.lit(1))
    part = F.slice(lines(c), first, line + around - first + 1)
    return F.array_join(F.transform(part, lambda x: F.substring(x, 1, width)), "\n")


def marked_snippet(c: Column, line: Column, around: int = 6, width: int = 280) -> Column:
    """Numbered lines around a line, which carries a marker."""
    first = F.greatest(line - around, F.lit(1))
    part = F.slice(lines(c), first, line + around - first + 1)
    each = lambda x, i: F.concat(F.when(i + first == line, F.lit(">>> ")).otherwise(F.lit("    ")), (i + first).cast("string"), F.lit(": "), F.substring(x, 1, width))
    return F.array_join(F.transform(part, each), "\n")


#: Comment patterns by language family.
COMMENTS = {
    "python": ('(?s)(?:\"\"\".*?\"\"\"|\'\'\'.*?\'\'\')', r"(?m)(?:^|[ \t])#[^\n]*"),
    "c": (r"(?s)/\*.*?\*/", r"(?m)(?:^|[^:\"'\\\n])//[^\n]*"),
    "hash": (r"(?m)(?:^|[ \t])#[^\n]*",),
    "sql": (r"--[^\n]*",),
}


def blank(c: Column, pattern: str) -> Column:
    """All but line breaks of every match becomes spaces: offsets stay."""
    hits = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda h: F.regexp_replace(h, r"[^\n]", " "))
    pieces = F.zip_with(F.split(c, pattern, -1), hits, lambda gap, h: F.concat(gap, F.coalesce(h, F.lit(""))))
    return F.when(c.rlike(pattern), F.array_join(pieces, "")).otherwise(c)


def strip_comments(c: Column, family: str) -> Column:
    for pattern in COMMENTS[family]:
        c = blank(c, pattern)
    return c


def minified(path: Column, c: Column) -> Column:
    """A minified bundle by name, or by the length of its first five lines."""
    head = F.slice(lines(c), 1, 5)
    sizes = F.transform(head, lambda x: F.length(x) + 1)
    mean = F.aggregate(sizes, F.lit(0), lambda a, x: a + x) / F.size(sizes)
    return path.rlike(r"\.min\.(js|ts)$") | F.exists(sizes, lambda x: x > 1001) | (mean > 501)


def normal_match(c: Column) -> Column:
    """White space collapsed, cut to 120."""
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, 120)


def stable_id(*parts: Column) -> Column:
    """MD5 of the parts, the last as ``normal_match`` has it."""
    return F.md5(F.concat_ws("::", *parts[:-1], normal_match(parts[-1])))


def short_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12))


def path_class(path: Column) -> Column:
    """test, docs or production by path; tests come first."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    test = p.rlike(r"(^|/)(tests?|__tests__|specs?|fixtures)(/|$)|(^|/)test_[^/]*$|[._](test|spec)\.[a-z]+$")
    docs = p.rlike(r"\.(md|rst|adoc|txt)$|(^|/)(docs?|documentation|examples?|samples?|helm|charts|k8s|monitoring)(/|$)|(^|/)(openapi|swagger)[^/]*\.(ya?ml|json)$")
    return F.when(test, F.lit("test")).when(docs, F.lit("docs")).otherwise(F.lit("production"))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def printable(c: Column) -> Column:
    """Control and format characters but line breaks and tabs become spaces."""
    return F.regexp_replace(c, r"[\p{C}&&[^\n\t]]", " ")


def title_label(slug: Column, label: Column) -> Column:
    words = F.transform(F.split(F.translate(slug, "_-", "  "), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000))))
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), F.array_join(words, " "))


def mmss(seconds: Column) -> Column:
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("int")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), s % 60)
