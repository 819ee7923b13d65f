"""Hosts, routes and repository facts from texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPRECATED = r"/deprecated|/legacy|/v1/|/beta"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))


def route(url: Column) -> Column:
    """The path without query, doubled and trailing slashes; empty for the root."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+", "/")
    return F.regexp_replace(path, "/$", "")


def boundary(name: Column, internal: tuple[str, ...] = (".local", ".internal")) -> Column:
    inside = name.isin("localhost", "127.0.0.1")
    for tail in internal:
        inside = inside | name.endswith(tail)
    return F.when(inside, "internal").otherwise("external")


def urls(df: DataFrame, key: list[str], text: str) -> DataFrame:
    return df.select(*key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"), F.lit(0))).alias("url"))


def facts(files: DataFrame, probes: dict[str, str], by: str = "repo") -> DataFrame:
    """One row a repository: for each probe whether any file matches it."""
    return files.groupBy(by).agg(*[F.bool_or(F.col("content").rlike(p)).alias(k) for k, p in probes.items()])


#: Names of runtimes as facts give them, and the other names they go by.
RUNTIMES = {"Python": ("python", "cpython"), "Node.js": ("node", "node.js", "nodejs"), "JVM": ("java", "jvm", "jdk"), "Go": ("go", "golang"), ".NET": (".net", "dotnet", "net")}


def runtime_name(runtime: Column) -> Column:
    out = runtime
    for name, others in RUNTIMES.items():
        out = F.when(F.lower(F.trim(runtime)).isin(*others), F.lit(name)).otherwise(out)
    return out


def runtime_version(runtime: Column, version: Column) -> Column:
    """The version's bucket: major and minor of Python and Go; Node.js <18, 18.x, 20.x, then
    each; JVM 8, 11, 17, then N+; .NET <6, 6-7, then N+. A version without number stays."""
    text, name = F.trim(F.coalesce(version, F.lit(""))), runtime_name(runtime)
    number = F.regexp_extract(text, r"(\d{1,6})", 1)
    major = F.try_to_number(number, F.lit("999999")).cast("int")
    exact = F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+\.\d+)", 1), F.lit("")), major.cast("string"))
    plus = F.concat(major.cast("string"), F.lit("+"))
    node = F.when(major < 18, "<18").when(major < 20, "18.x").when(major < 22, "20.x").otherwise(F.concat(major.cast("string"), F.lit(".x")))
    jvm = F.when(major <= 8, "8").when(major <= 11, "11").when(major <= 17, "17").otherwise(plus)
    net = F.when(major < 6, "<6").when(major < 8, "6-7").otherwise(plus)
    return F.when(major.isNull(), text).when(name.isin("Python", "Go"), exact).when(name == "Node.js", node).when(name == "JVM", jvm).when(name == ".NET", net).otherwise(text)


def runtime_bucket(runtime: Column, version: Column) -> Column:
    """Runtime with its version's bucket, as Python 3.9 or Node.js 18.x; the runtime alone without version."""
    bucket = runtime_version(runtime, version)
    return F.when(bucket == "", runtime_name(runtime)).otherwise(F.concat_ws(" ", runtime_name(runtime), bucket))


def outdated(runtime: Column, version: Column) -> Column:
    """Python up to 3.9, Node.js below 18, JVM 8 and 11 with all that their buckets hold, Go below 1.21, .NET below 6."""
    name, bucket = runtime_name(runtime), runtime_version(runtime, version)
    part = lambda i: F.coalesce(F.try_to_number(F.regexp_extract(bucket, r"^(\d{1,6})(?:\.(\d{1,6}))?$", i), F.lit("999999")).cast("int"), F.lit(0))
    numeric = bucket.rlike(r"^\d+(\.\d+)?$")
    before = lambda major, minor: numeric & ((part(1) < major) | ((part(1) == major) & (part(2) < minor)))
    old = ((name == "Python") & before(3, 10)) | ((name == "Node.js") & (bucket == "<18")) | ((name == "JVM") & bucket.isin("8", "11")) | ((name == "Go") & before(1, 21)) | ((name == ".NET") & (bucket == "<6"))
    return F.coalesce(old, F.lit(False))


def dependencies(files: DataFrame) -> DataFrame:
    """repo, path, name: declared in package.json, requirements, pyproject, go.mod and pom files."""
    name = F.element_at(F.split("path", "/"), -1)
    js = files.filter(name == "package.json").withColumn("section", F.explode(F.array(*[F.lit(s) for s in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")])))
    js = js.select("repo", "path", F.explode(F.json_object_keys(F.when(F.col("section") == "dependencies", F.get_json_object("content", "$.dependencies")).when(F.col("section") == "devDependencies", F.get_json_object("content", "$.devDependencies")).when(F.col("section") == "peerDependencies", F.get_json_object("content", "$.peerDependencies")).otherwise(F.get_json_object("content", "$.optionalDependencies")))).alias("name"))
    every = lambda rows, p: rows.select("repo", "path", F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(1))).alias("name"))
    req = every(files.filter(name.rlike(r"^requirements[^/]*\.txt$")), r"(?m)^[ \t]*([A-Za-z0-9][A-Za-z0-9._-]*)")
    toml = every(files.filter(name == "pyproject.toml"), r"(?m)^[ \t]*\"([A-Za-z0-9][A-Za-z0-9._-]*)[^\"]*\"[ \t]*,?[ \t]*$")
    go = every(files.filter(name == "go.mod"), r"(?m)^[ \t]*(?:require[ \t]+)?([a-z0-9.-]+\.[a-z]+/[^\s]+)[ \t]+v")
    pom = every(files.filter(name == "pom.xml"), r"<artifactId>([^<]+)</artifactId>")
    return js.unionByName(req).unionByName(toml).unionByName(go).unionByName(pom).select("repo", "path", F.lower("name").alias("name")).distinct()


def code_owner(files: DataFrame) -> DataFrame:
    """The first owner that a CODEOWNERS file names."""
    rows = files.filter(F.col("path").rlike(r"(^|/)CODEOWNERS$")).select("repo", "path", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    owner = F.regexp_extract("line", r"^[^#]*?\s(@\S+|\S+@\S+)", 1)
    return rows.withColumn("owner", owner).filter("owner <> ''").groupBy("repo").agg(F.min_by("owner", F.struct("path", "n")).alias("owner"))
