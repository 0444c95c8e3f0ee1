"""Licence scan by sentence rules.

Texts are split into sentences, sentences are normalised (lower case, runs of other characters than a-z and 0-9 as one blank) and looked up among known licence sentences; the identifiers found, in order of the text, form a sequence, and ordered rules take their licences out of that sequence, each rule consuming what it matched. Identifiers that no rule consumes are reported as UNKNOWN.

A mark of [.!?;:] before white space may end a sentence, but needn't: known sentences have such marks inside ('SPDX-License-Identifier: MIT', 'free software; you can', 'v. 2.0'). A known sentence therefore lies between any two ends with any marks inside, and of those that begin at one place the longest counts.

Two splits are scanned, since licence texts are often wrapped: one in which every line break ends a sentence, and one in which only a blank line does. A document has the licences that either finds.

Defined cases: null and empty texts have no licence and no row; several rows alike give one row each licence; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: identifier -> normalised sentences
SENTENCES: dict[str, list[str]] = {
    "ApacheRef": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "this project is licensed under the apache license version 2 0", "released under the apache license version 2 0", "spdx license identifier apache 2 0"],
    "ApacheUse": ["you may not use this file except in compliance with the license"],
    "ApacheCopy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "ApacheAsIs": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "ApacheSee": ["see the license for the specific language governing permissions and limitations under the license"],
    "MitRef": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "this software is released under the mit license", "distributed under the mit license", "spdx license identifier mit"],
    "MitGrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MitNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MitAsIs": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "MitLiable": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "BsdGrant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BsdSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BsdBinary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BsdEndorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BsdRef2": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "BsdRef3": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "Gpl3Ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "spdx license identifier gpl 3 0 only"],
    "Gpl2Ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2", "spdx license identifier gpl 2 0 only"],
    "GplFree": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "Gpl2Free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "GplHope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "this program is distributed in the hope that it will be useful but without any warranty"],
    "GplSee": ["see the gnu general public license for more details"],
    "LgplRef": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3 0 only"],
    "AgplRef": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3 0 only"],
    "MplRef": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "CcByRef": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CcBySaRef": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CcByNcRef": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CcByNdRef": ["licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"],
    "Cc0Ref": ["licensed under cc0 1 0", "this work is dedicated to the public domain under license cc0 1 0"],
    "UnlicenseRef": ["this is free and unencumbered software released into the public domain"],
    "IscGrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "Reserved": ["copyright all rights reserved", "all rights reserved copyright"],
}
#: Every known sentence has one of these, so texts without any need no splitting.
HINTS = ("licen", "copyright", "permission", "redistribut", "warrant", "public domain")
#: Ordered: an earlier rule takes its identifiers before a later one looks.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["ApacheRef", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs", "MitLiable"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("GPL-3.0-or-later", ["GplFree", "GplHope", "GplSee"]),
    ("GPL-2.0-or-later", ["Gpl2Free", "GplHope", "GplSee"]),
    ("GPL-3.0-or-later", ["GplFree"]),
    ("GPL-2.0-or-later", ["Gpl2Free"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("MIT", ["MitRef"]),
    ("BSD-3-Clause", ["BsdRef3"]),
    ("BSD-2-Clause", ["BsdRef2"]),
    ("GPL-3.0-only", ["Gpl3Ref"]),
    ("GPL-2.0-only", ["Gpl2Ref"]),
    ("LGPL-3.0-only", ["LgplRef"]),
    ("AGPL-3.0-only", ["AgplRef"]),
    ("MPL-2.0", ["MplRef"]),
    ("CC-BY-4.0", ["CcByRef"]),
    ("CC-BY-SA-4.0", ["CcBySaRef"]),
    ("CC-BY-NC-4.0", ["CcByNcRef"]),
    ("CC-BY-ND-4.0", ["CcByNdRef"]),
    ("CC0-1.0", ["Cc0Ref"]),
    ("Unlicense", ["UnlicenseRef"]),
    ("ISC", ["IscGrant"]),
]


def _step(ids: list[str]) -> str:
    return "".join(f"<{x}>" for x in ids)


def _sentence_pattern() -> str:
    """A known sentence between two ends: longer ones first, and its words may have soft ends (E) between them."""
    every = sorted({s for group in SENTENCES.values() for s in group}, key=lambda s: (-len(s), s))
    return "[EL] ?(" + "|".join(s.replace(" ", "[ E]+") for s in every) + ")(?= ?[EL])"


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, row, split, seq: the identifiers of the known sentences of each row and split, in order of the text; rows without any are left out."""
    known = F.create_map(*[F.lit(x) for k, group in SENTENCES.items() for s in group for x in (s, k)])
    # the text isn't normalised yet: a hint's blank is whatever becomes one
    hinted = docs.select("doc_id", "text").where(F.col("text").rlike("(?i)" + "|".join(HINTS).replace(" ", "[^a-z0-9]+"))).withColumn("row", F.monotonically_increasing_id())
    # lower case first, so that capitals can mark ends: E may also lie inside a known sentence, L may not
    soft = F.regexp_replace(F.lower("text"), r"[.!?;:](?=[ \t\n\x0B\f\r]|\z)", "E")
    splits = F.array(
        F.struct(F.lit("line").alias("split"), F.regexp_replace("soft", r"[\r\n]+", "L").alias("t")),
        F.struct(F.lit("block").alias("split"), F.regexp_replace("soft", r"\n[ \t]*\r?\n[\r\n]*", "L").alias("t")),
    )
    rows = hinted.select("doc_id", "row", soft.alias("soft")).select("doc_id", "row", F.inline(splits))
    marked = F.concat(F.lit("L"), F.regexp_replace("t", "[^a-z0-9EL]+", " "), F.lit("L"))
    found = rows.select("doc_id", "row", "split", F.regexp_extract_all(marked, F.lit(_sentence_pattern()), F.lit(1)).alias("found")).where(F.size("found") > 0)
    return found.select("doc_id", "row", "split", F.concat_ws("", F.transform("found", lambda x: F.concat(F.lit("<"), F.element_at(known, F.regexp_replace(x, "[ E]+", " ")), F.lit(">")))).alias("seq"))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document and licence: doc_id, license, n_matches (the most times that either split has it)."""
    seq = identified(docs)
    hits = []
    for license_, ids in RULES:
        step = _step(ids)
        left = F.replace(F.col("seq"), F.lit(step), F.lit(""))
        name = f"n{len(hits)}"
        seq = seq.withColumn(name, ((F.length("seq") - F.length(left)) / len(step)).cast("long")).withColumn("seq", left)
        hits.append(F.struct(F.lit(license_).alias("license"), F.col(name).alias("n")))
    hits.append(F.struct(F.lit("UNKNOWN").alias("license"), F.coalesce(F.regexp_count("seq", F.lit("<")), F.lit(0)).cast("long").alias("n")))
    per = seq.select("doc_id", "row", "split", F.inline(F.filter(F.array(*hits), lambda h: h["n"] > 0))).groupBy("doc_id", "row", "split", "license").agg(F.sum("n").alias("n"))
    return per.groupBy("doc_id", "license").agg(F.max("n").alias("n_matches"))


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    known = ", ".join(f"('{s}', '{k}')" for k, group in SENTENCES.items() for s in group)
    seq, columns, arms = "q", [], []
    steps = []
    for i, (license_, ids) in enumerate(RULES):
        step = _step(ids)
        steps.append(f"r{i} AS (SELECT * EXCLUDE (seq), replace(seq, '{step}', '') AS seq, ((length(seq) - length(replace(seq, '{step}', ''))) // {len(step)})::BIGINT AS n{i} FROM {seq})")
        seq = f"r{i}"
        arms.append(f"SELECT doc_id, row, split, '{license_}' AS license, n{i} AS n FROM z")
    arms.append("SELECT doc_id, row, split, 'UNKNOWN' AS license, (length(seq) - length(replace(seq, '<', '')))::BIGINT AS n FROM z")
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
d AS (SELECT doc_id, row_number() OVER () AS row, text FROM documents),
u AS (
  SELECT doc_id, row, 'line' AS split, string_split(regexp_replace(text, '[.!?;:]+([ \t\n\v\f\r]+|$)|[\r\n]+', chr(10), 'g'), chr(10)) AS parts FROM d
  UNION ALL
  SELECT doc_id, row, 'block', string_split(regexp_replace(regexp_replace(text, '\r?\n[ \t]*(\r?\n)+', '.' || chr(10), 'g'), '[.!?;:]+([ \t\n\v\f\r]+|$)', chr(1), 'g'), chr(1)) FROM d),
x AS (SELECT doc_id, row, split, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM u),
f AS (SELECT x.*, id FROM x JOIN known ON trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) = sentence),
q AS (SELECT doc_id, row, split, string_agg('<' || id || '>', '' ORDER BY pos) AS seq FROM f GROUP BY ALL),
{", ".join(steps)},
z AS (SELECT * FROM {seq}),
h AS ({" UNION ALL ".join(arms)}),
p AS (SELECT doc_id, row, split, license, sum(n)::BIGINT AS n FROM h WHERE n > 0 GROUP BY ALL)
SELECT doc_id, license, max(n) AS n_matches FROM p GROUP BY doc_id, license
"""


SQL = _sql()
