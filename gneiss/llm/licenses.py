"""License scans by sentence rules.

Each line or sentence is normalised to its words in lower case. Known sentences of licences have identifiers; the
document becomes the sequence of its identifiers, in which a run of other sentences is one gap. Licence rules are
sequences of identifiers, tried in their order, and what a rule has matched is not matched again.

A null or empty text has no sentences and no licence. Repeated rows get equal results; an empty table gives an empty
result; other columns are ignored. Whole texts are read, of any length; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers of known sentences, as they are normalised.
SENTENCES = {
    "apache-ref": "licensed under the apache license version 2.0",
    "apache-may-not": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
    "mit-ref": "released under the mit license",
    "mit-ref2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is",
    "cc-by-ref": "licensed under cc by 4.0",
    "cc-by-sa-ref": "licensed under cc by-sa 4.0",
    "cc-by-nc-ref": "licensed under cc by-nc 4.0",
    "cc0-ref": "released under cc0 1.0",
    "reserved": "all rights reserved",
}
#: The rules, in the order in which they are tried: licence, sequence of identifiers.
RULES = (
    ("Apache-2.0", ("apache-ref", "apache-may-not", "apache-obtain")),
    ("MIT", ("mit-grant", "mit-as-is")),
    ("GPL-3.0", ("gpl-free", "gpl-warranty")),
    ("BSD", ("bsd-redistribute", "bsd-as-is")),
    ("Apache-2.0", ("apache-ref",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref2",)),
    ("MIT", ("mit-grant",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL", ("gpl-free",)),
    ("BSD", ("bsd-redistribute",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("Proprietary", ("reserved",)),
)
#: A text without any of these has none of the sentences.
CUE = r"(?i)licen|redistribut|permission|warrant|program|software|cc0|rights"
#: Where sentences end: at line ends, and after a full stop or question mark before white space.
BREAK = r"[\n\r]+|[.?][ \t]+"


def normalised(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), r"[^a-z0-9.\-]+", " ")
    return F.trim(F.regexp_replace(c, r"(?:^|(?<= ))[.\-]+|[.\-]+(?= |$)", ""))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_known, identifiers (in order, "-" for a gap), n_rules, licences (as found, in order)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.filter(F.split(text, BREAK), lambda s: F.trim(s) != "").alias("s"), text.rlike(CUE).alias("cue"))
    ids = F.create_map(*[F.lit(x) for k, v in SENTENCES.items() for x in (v, k)])
    d = d.withColumn("ids", F.when(F.col("cue"), F.transform("s", lambda s: F.coalesce(F.try_element_at(ids, normalised(s)), F.lit("-")))).otherwise(F.expr("cast(array() as array<string>)")))
    seq = F.concat(F.lit(" "), F.regexp_replace(F.array_join("ids", " "), r"-(?: -)+", "-"), F.lit(" "))
    d = d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.size(F.filter("ids", lambda x: x != "-")).cast("long").alias("n_known"), seq.alias("seq"))
    d = d.withColumn("seq", F.when(F.col("n_known") > 0, F.col("seq")).otherwise(F.lit("")))
    found = F.col("seq")
    for licence, rule in RULES:
        pattern = r" ".join(rule)
        found = F.regexp_replace(found, f"(?<= ){pattern}(?= )", f"#{licence}")
    d = d.withColumn("found", F.when(F.col("n_known") > 0, F.regexp_extract_all(found, F.lit(r"#(\S+)"), F.lit(1))).otherwise(F.expr("cast(array() as array<string>)")))
    return d.select("doc_id", "n_sentences", "n_known", F.trim("seq").alias("identifiers"), F.size("found").cast("long").alias("n_rules"), F.array_join("found", ",").alias("licences"))
