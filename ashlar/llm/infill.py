"""Fill-in-middle transformation by an Aho-Corasick event scan.

A text is cut into units (white space with the word after it; white space at
the end is a unit too), two ranks drawn from the document's id part the units
into prefix, middle and suffix, and the parts are put in another order between
sentinels. Units are never made: one automaton reports the white-space characters
and the sentinels of a text as events, a gap between two white-space events holds
one word, so the places where units end are the events after the gaps, and the
place of a rank is looked up in them.

The scan is a Pandas UDF that returns three numbers a row; texts are cut and put
together by Spark's own functions, and a row depends on no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WHITE = "\t\n\x0b\x0c\r "
SENTINELS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
_EVENT = np.dtype([("end", np.int64), ("sentinel", np.bool_)])


def automaton() -> ahocorasick.Automaton:
    """Finds white space (value False) and sentinels (True)."""
    made = ahocorasick.Automaton()
    for c in WHITE:
        made.add_word(c, False)
    for s in SENTINELS:
        made.add_word(s, True)
    made.make_automaton()
    return made


def scan(found: ahocorasick.Automaton, text: str) -> tuple[np.ndarray, bool, int]:
    """Ends of the words of ``text``, whether it holds a sentinel, and its number of units.

    Nine bytes an event are held, whatever the length of the text.
    """
    events = np.fromiter(found.iter(text), dtype=_EVENT)
    edges = np.concatenate(([-1], events["end"][~events["sentinel"]], [len(text)]))
    ends = edges[1:][np.diff(edges) > 1]
    trailing = bool(text) and edges[-2] == len(text) - 1
    return ends, bool(events["sentinel"].any()), len(ends) + trailing


def place(ends: np.ndarray, size: int, rank: int) -> int:
    """Code point at which the unit of this rank ends; 0 for rank 0."""
    return 0 if rank == 0 else int(ends[rank - 1]) if rank <= len(ends) else size


def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    found = automaton()
    for texts, ones, twos in batches:
        rows = []
        for text, h1, h2 in zip(texts, ones, twos, strict=True):
            ends, sentinel, n = scan(found, text)
            if sentinel or not text:
                rows.append((n, None, None))
            else:
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                rows.append((n, place(ends, len(text), low), place(ends, len(text), high)))
        yield pd.DataFrame(rows, columns=["n", "first", "second"]).astype("Int64")


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of the SHA-256 of ``seed:doc_id`` (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. A sentinel can't overlap another or
    arise where parts meet, so splitting at sentinels is exact."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for every row of ``docs``.

    ``rate`` percent of the documents are transformed, ``spm_rate`` percent of
    those suffix first. A null text is an empty one; empty texts and texts that
    hold a sentinel stay plain, and their lengths are null. A null id draws as an
    empty one; rows that repeat an id draw alike, so that equal rows have equal
    results. Very long texts cost nine bytes for each white-space character. An empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    cuts = F.pandas_udf(_cuts, "n long, first long, second long")
    rows = rows.withColumn("cut", cuts("text", h1, h2)).select("doc_id", "text", "cut.*", (h3 % 100).alias("h3"), (h4 % 100).alias("h4"))
    form = F.when(F.col("first").isNull() | (F.col("h3") >= rate), "plain").when(F.col("h4") < spm_rate, "spm").otherwise("psm")
    first, second = F.col("first").cast("int"), F.col("second").cast("int")
    rows = rows.withColumns(
        {
            "form": form,
            "head": F.substring("text", F.lit(1), first),
            "mid": F.substring("text", first + 1, second - first),
            "tail": F.substring("text", second + 1, F.length("text")),
        }
    )
    psm = F.concat(F.lit(PREFIX), "head", F.lit(SUFFIX), "tail", F.lit(MIDDLE), "mid")
    spm = F.concat(F.lit(SUFFIX), "tail", F.lit(PREFIX), "head", F.lit(MIDDLE), "mid")
    moved = F.col("form") != "plain"
    return rows.select(
        "doc_id", "n", "form",
        F.when(moved, F.col("first")).alias("prefix_chars"),
        F.when(moved, F.col("second") - F.col("first")).alias("middle_chars"),
        F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    restored = restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
with units as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as digest,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as unit from documents
), drawn as (
  select *, len(unit)::bigint as n, ('0x' || substr(digest, 1, 8))::bigint as h1, ('0x' || substr(digest, 9, 8))::bigint as h2,
    ('0x' || substr(digest, 17, 8))::bigint % 100 as h3, ('0x' || substr(digest, 25, 8))::bigint % 100 as h4 from units
), cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 >= 50 then 'plain'
      when h4 < 80 then 'spm' else 'psm' end as form from drawn
), parts as (
  select *, array_to_string(unit[1:low], '') as head, array_to_string(unit[low + 1:high], '') as mid, array_to_string(unit[high + 1:], '') as tail from cut
)
select doc_id, n, form, case when form <> 'plain' then length(head) end::bigint as prefix_chars, case when form <> 'plain' then length(mid) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || head || '<S>' || tail || '<M>' || mid else '<S>' || tail || '<P>' || head || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""
QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {"op13_fill_in_middle": OP13_SQL}
