"""License scans: recognition of licence sentences and their sequences.

A text is cut into sentences, each is normalised (lower case, letters, digits
and inner dots only) and mapped to the identifier of a known licence sentence.
The identifiers in text order, with a break where more than ``MAX_GAP`` other
sentences lie between two, are matched against licence rules in order: first the
rules of several sentences, which consume what they match, then grants and tags,
which name a licence by themselves. Everything is DataFrame functions. Only texts
in which a known sentence can begin are cut: ``TRIGGER`` is made of the catalogue
itself, so it leaves nothing out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_GAP = 2
# Licence identifiers and the names by which grants call them, as
# patterns over normalised text.
_NAMES = (
    ("MIT", r"(?:mit|expat) licen[cs]e"),
    ("Apache-2.0", r"apache (?:software )?licen[cs]e (?:version |v)?2(?:\.0)?|apache 2(?:\.0)? licen[cs]e"),
    ("AGPL-3.0", r"gnu affero general public licen[cs]e (?:version |v)?3(?:\.0)?|agpl ?v?3(?:\.0)?"),
    ("LGPL-2.1", r"gnu (?:lesser|library) general public licen[cs]e (?:version |v)?2\.1|lgpl ?v?2\.1"),
    ("LGPL-3.0", r"gnu lesser general public licen[cs]e (?:version |v)?3(?:\.0)?|lgpl ?v?3(?:\.0)?"),
    ("GPL-2.0", r"gnu general public licen[cs]e (?:version |v)?2(?:\.0)?|(?:gnu )?gpl ?v?2(?:\.0)?"),
    ("GPL-3.0", r"gnu general public licen[cs]e (?:version |v)?3(?:\.0)?|(?:gnu )?gpl ?v?3(?:\.0)?"),
    ("MPL-2.0", r"mozilla public licen[cs]e (?:version |v)?2(?:\.0)?|mpl ?v?2(?:\.0)?"),
    ("EPL-2.0", r"eclipse public licen[cs]e (?:version |v)?2(?:\.0)?"),
    ("BSD-2-Clause", r"(?:simplified bsd|bsd 2 clause|2 clause bsd) licen[cs]e"),
    ("BSD-3-Clause", r"(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|bsd) licen[cs]e"),
    ("ISC", r"isc licen[cs]e"),
    ("Zlib", r"zlib licen[cs]e"),
    ("BSL-1.0", r"boost software licen[cs]e(?: (?:version |v)?1\.0)?"),
    ("Artistic-2.0", r"artistic licen[cs]e (?:version |v)?2(?:\.0)?"),
    ("Unlicense", r"unlicense"),
    ("CC0-1.0", r"(?:cc0|cc zero)(?: 1\.0)?(?: universal)?"),
)
_CC = (("BY-NC-SA", r"by nc sa|attribution noncommercial sharealike"), ("BY-NC-ND", r"by nc nd|attribution noncommercial noderiv(?:ative)?s"), ("BY-NC", r"by nc|attribution noncommercial"), ("BY-SA", r"by sa|attribution sharealike"), ("BY-ND", r"by nd|attribution noderiv(?:ative)?s"), ("BY", r"by|attribution"))
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
NAMES = _NAMES + tuple((f"CC-{kind}-{v}", rf"(?:cc|creative commons) (?:{name}) {v[0]}\.{v[2]}") for kind, name in _CC for v in _CC_VERSIONS)
_GRANT = r"(?:^|.* )(?:licen[cs]ed|released|distributed|published|available|provided|redistributed) under (?:the terms of )?(?:the |an? )?"
_TAG = r"(?:^|.* )spdx licen[cs]e identifier "

#: Sentences of licence texts: identifier and the start of the normalised sentence.
SENTENCES = (
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-as-is", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-endorse", "neither the name of * may be used to endorse or promote products derived from this software"),
    ("bsd-as-is", "this software is provided by the copyright holders and contributors as is"),
    ("apache-use", "you may not use this file except in compliance with the license"),
    ("apache-obtain", "you may obtain a copy of the license at"),
    ("apache-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("agpl-free-3", "free software you can redistribute it and or modify it under the terms of the gnu affero general public license * version 3"),
    ("lgpl-free-2.1", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license * version 2.1"),
    ("lgpl-free-3", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license * version 3"),
    ("gpl-free-2", "free software you can redistribute it and or modify it under the terms of the gnu general public license * version 2"),
    ("gpl-free-3", "free software you can redistribute it and or modify it under the terms of the gnu general public license * version 3"),
    ("lgpl-redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-either-2.1", "either version 2.1 of the license or at your option any later version"),
    ("gpl-either-2", "either version 2 of the license or at your option any later version"),
    ("gpl-either-3", "either version 3 of the license or at your option any later version"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-copy", "you should have received a copy of the gnu general public license along with this program"),
    ("mpl-form", "this source code form is subject to the terms of the mozilla public license v. 2.0"),
    ("mpl-copy", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
)
#: Where a known sentence can begin in a raw text: a grant or a tag, or a sentence's first three words with any signs between.
_VERBS = "licen[cs]ed|released|distributed|published|available|provided|redistributed"
TRIGGER = r"(?i)(?:" + "|".join([rf"(?:{_VERBS})[^A-Za-z0-9]+under\b", r"spdx[^A-Za-z0-9]+licen[cs]e", *sorted({"[^A-Za-z0-9]+".join(start.split()[:3]) for _, start in SENTENCES})]) + ")"

#: Rules in order: licence and the sequence of sentences that states it.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("grant=Apache-2.0", "apache-use", "apache-obtain", "apache-as-is")),
    ("Apache-2.0", ("grant=Apache-2.0", "apache-use", "apache-obtain")),
    ("Apache-2.0", ("grant=Apache-2.0", "apache-use")),
    ("AGPL-3.0", ("agpl-free-3",)),
    ("LGPL-2.1", ("lgpl-free-2.1",)),
    ("LGPL-3.0", ("lgpl-free-3",)),
    ("GPL-2.0", ("gpl-free-2", "gpl-hope", "gpl-copy")),
    ("GPL-2.0", ("gpl-free-2",)),
    ("GPL-2.0", ("gpl-redistribute", "gpl-either-2")),
    ("LGPL-2.1", ("lgpl-redistribute", "lgpl-either-2.1")),
    ("GPL-3.0", ("gpl-free-3", "gpl-hope", "gpl-copy")),
    ("GPL-3.0", ("gpl-free-3",)),
    ("GPL-3.0", ("gpl-redistribute", "gpl-either-3")),
    ("GPL", ("gpl-free", "gpl-hope", "gpl-copy")),
    ("GPL", ("gpl-free", "gpl-hope")),
    ("MPL-2.0", ("mpl-form", "mpl-copy")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("GPL", ("gpl-free",)),
    ("GPL", ("gpl-redistribute",)),
    ("MPL-2.0", ("mpl-form",)),
    ("Unlicense", ("public-domain",)),
)
#: Sentences end after . ! ? ;, at empty lines, and before lines that open a licence.
BOUNDARY = r"(?<=[.!?;])[\x20\x09-\x0D]+|\n[\x20\t\r]*\n|\n(?=[\x20\t]*(?:[#*/;-]+[\x20\t]*)?(?:This|Licen[cs]ed|Released|Distributed|Published|Permission|SPDX|Copyright|Redistribution|THE|You|Unless)\b)"


def normalise(sentence: Column) -> Column:
    """Lower case; all but letters, digits and dots inside numbers become one space."""
    plain = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.]+|\.(?![0-9])|(?<![0-9v])\.", " ")
    return F.trim(F.regexp_replace(plain, " +", " "))


def identify(sentence: Column) -> Column:
    """Identifier of a normalised sentence; null if it is not a licence sentence."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(NAMES):
        found = F.when(sentence.rlike(rf"{_GRANT}(?:{pattern})(?: |$)"), F.lit(f"grant={name}")).otherwise(found)
    # A tag names the licence by its identifier.
    tag = F.regexp_extract(sentence, rf"{_TAG}([a-z0-9. ]+)$", 1)
    for name, _ in NAMES:
        found = F.when(tag == name.lower().replace("-", " "), F.lit(f"tag={name}")).otherwise(found)
    for name, start in reversed(SENTENCES):
        stated = sentence.contains(start) if "*" not in start else sentence.rlike(".*".join(re.escape(part) for part in start.split("*")))
        found = F.when(stated, F.lit(name)).otherwise(found)
    return found


def recognise(known: Column) -> Column:
    """Licences (distinct, in order of name) of an array of (pos, id) in text order. Each
    identifier has bars of its own, so that sequences that follow one another are all consumed."""
    text = F.aggregate(
        known,
        F.struct(F.lit("").alias("s"), F.lit(-1).alias("last")),
        lambda acc, x: F.struct(F.concat(acc["s"], F.when((acc["last"] >= 0) & (x["pos"] - acc["last"] > MAX_GAP + 1), F.lit("|~|")).otherwise(F.lit("")), F.lit("|"), x["id"], F.lit("|")).alias("s"), x["pos"].alias("last")),
    )["s"]
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"|{i}|" for i in ids)).alias("ids")) for name, ids in RULES])
    empty = F.array().cast("array<string>")
    # Each rule consumes its sentences, so that a shorter one does not see them again.
    state = F.aggregate(
        rules,
        F.struct(text.alias("s"), empty.alias("names")),
        lambda acc, r: F.struct(F.replace(acc["s"], r["ids"], F.lit("|-|")).alias("s"), F.when(F.contains(acc["s"], r["ids"]), F.array_append(acc["names"], r["name"])).otherwise(acc["names"]).alias("names")),
    )
    single = F.transform(F.array(state), lambda s: F.concat(s["names"], F.regexp_extract_all(s["s"], F.lit(r"\|(?:grant|tag)=([^|]+)"), F.lit(1))))[0]
    return F.array_sort(F.array_distinct(single))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known, sentences, licenses: one row for each row of ``docs``.

    ``sentences`` has the identifiers in text order and ``licenses`` the names
    found, both comma-joined and empty if there are none, as for null and empty
    texts. Columns other than doc_id and text are not read.
    """
    text = F.col("text")
    pieces = F.transform(F.split(text, BOUNDARY, -1), lambda s, i: F.struct(i.alias("pos"), s.alias("s")))
    likely = F.transform(F.filter(pieces, lambda p: p["s"].rlike(TRIGGER)), lambda p: F.struct(p["pos"].alias("pos"), normalise(p["s"]).alias("s")))
    known = F.filter(F.transform(likely, lambda p: F.struct(p["pos"].alias("pos"), identify(p["s"]).alias("id"))), lambda p: p["id"].isNotNull())
    none = F.array().cast("array<struct<pos:int,id:string>>")
    found = docs.select("doc_id", F.when(text.rlike(TRIGGER), known).otherwise(none).alias("known"))
    found = found.withColumn("known", F.coalesce("known", none))
    ids = F.array_join(F.transform("known", lambda k: k["id"]), ",")
    names = F.when(F.size("known") > 0, F.array_join(recognise(F.col("known")), ",")).otherwise(F.lit(""))
    return found.select("doc_id", F.size("known").cast("long").alias("n_known"), ids.alias("sentences"), names.alias("licenses"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES: dict[str, str] = {}
