"""Licence scans by sentence rules, in DataFrame functions only (the way of German, Manabe and Inoue 2010).

Texts are cut into sentences, sentences are normalised (letters and digits, lower-cased, one blank between) and looked up
among known licence sentences.  The identifiers found in a text, in order, are matched against rules, the first rule
first; what a rule has matched is taken by its licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cloudframe.llm.common import C

# Sentences of well-known licences and notices, normalised, by identifier.
SENTENCES = {
    "MITgrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MITnotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MITwarranty": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "MITref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "this software is released under the mit license", "distributed under the mit license"],
    "ISCgrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "BSDgrant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSDsource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSDbinary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BSDendorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BSD2ref": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license"],
    "BSD3ref": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "released under the bsd license", "licensed under the bsd license"],
    "Apache2ref": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "licensed under the apache license 2 0", "this project is licensed under the apache license version 2 0"],
    "ApacheMay": ["you may not use this file except in compliance with the license"],
    "ApacheBasis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "GPL2ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "GPL3ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "GPL2later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "GPL3later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "GPLfree": ["this program is free software", "this software is free software"],
    "LGPL3ref": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"],
    "AGPL3ref": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "MPL2ref": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "CCBYref": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CCBYSAref": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CCBYNCref": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CCBYNDref": ["licensed under cc by nd 4 0", "this work is licensed under cc by nd 4 0"],
    "CC0ref": ["this work is dedicated to the public domain under the cc0 license", "licensed under cc0 1 0"],
    "AllRights": ["all rights reserved under copyright", "copyright all rights reserved"],
}
# Sequences of sentences and their licence, in the order in which they are tried.
RULES = [
    (["MITgrant", "MITnotice", "MITwarranty"], "MIT"), (["MITgrant", "MITnotice"], "MIT"),
    (["BSDgrant", "BSDsource", "BSDbinary", "BSDendorse"], "BSD-3-Clause"), (["BSDgrant", "BSDsource", "BSDbinary"], "BSD-2-Clause"),
    (["Apache2ref", "ApacheMay", "ApacheBasis"], "Apache-2.0"), (["Apache2ref", "ApacheMay"], "Apache-2.0"),
    (["GPLfree", "GPL2later"], "GPL-2.0-or-later"), (["GPLfree", "GPL3later"], "GPL-3.0-or-later"),
    (["GPL2later"], "GPL-2.0-or-later"), (["GPL3later"], "GPL-3.0-or-later"), (["GPL2ref"], "GPL-2.0-only"), (["GPL3ref"], "GPL-3.0-only"),
    (["LGPL3ref"], "LGPL-3.0-only"), (["AGPL3ref"], "AGPL-3.0-only"), (["MPL2ref"], "MPL-2.0"), (["MITref"], "MIT"), (["ISCgrant"], "ISC"),
    (["BSD2ref"], "BSD-2-Clause"), (["BSD3ref"], "BSD-3-Clause"), (["Apache2ref"], "Apache-2.0"), (["CCBYref"], "CC-BY-4.0"),
    (["CCBYSAref"], "CC-BY-SA-4.0"), (["CCBYNCref"], "CC-BY-NC-4.0"), (["CCBYNDref"], "CC-BY-ND-4.0"), (["CC0ref"], "CC0-1.0"),
]
#: What known sentences begin with, word by word; a run of lines can only be a known sentence if its first line is one of
#: these.  No known sentence has more words, and so no more lines with words, than ``MOST_LINES``.
PREFIXES = sorted({" ".join(s.split()[:n + 1]) for all_ in SENTENCES.values() for s in all_ for n in range(len(s.split()))})
KNOWN = sorted(s for all_ in SENTENCES.values() for s in all_)
MOST_LINES = max(len(s.split()) for s in KNOWN)
#: Each known sentence has one of these, so a text without them has no known sentence.
HINTS = ["licen", "software", "permission", "copyright", "redistribut"]


def _apply(sequence: Column) -> Column:
    for identifiers, licence in RULES:
        sequence = F.replace(sequence, F.lit("".join(f"<{i}>" for i in identifiers)), F.lit(f"[{licence}]"))
    return sequence


def _longest_run(first: Column) -> Column:
    """``line, end, text`` of the longest run of ``_lines`` from the line ``first`` on that is a known sentence; end 0: none.

    A run grows as long as a known sentence begins like it.
    """
    def grown(run: Column, line: Column) -> Column:
        text = F.ltrim(F.concat(run["begun"], F.lit(" "), line))
        whole = text.isin(KNOWN)
        longer = F.struct(text.alias("begun"), (run["n"] + 1).alias("n"), F.when(whole, first + run["n"]).otherwise(run["end"]).alias("end"),
                          F.when(whole, text).otherwise(run["text"]).alias("text"))
        over = F.struct(F.lit(None).cast("string").alias("begun"), run["n"].alias("n"), run["end"].alias("end"), run["text"].alias("text"))
        return F.when(run["begun"].isNull(), run).when(text.isin(PREFIXES), longer).otherwise(over)

    none = F.struct(F.lit("").alias("begun"), F.lit(0).alias("n"), F.lit(0).alias("end"), F.lit("").alias("text"))
    run = F.aggregate(F.slice("_lines", first, F.lit(MOST_LINES)), none, grown)
    return F.struct(first.alias("line"), run["end"].alias("end"), run["text"].alias("text"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, licenses`` (in order, comma-joined, each mention), ``sentences`` (identifiers
    in order) and ``n_unmatched`` (known sentences that no rule took).

    Sentences end at a line without letters and digits (blank, or only marks of a comment), or at ``. ! ? ; :`` after
    a word and before blanks.  A sentence is known as a whole or by any run of its lines, so that a title or a line above it does no harm;
    of runs that lie within one another the longest counts.  NULL and empty texts and texts of one very long sentence
    have what is in them (empty lists at the least); an empty table gives no rows; repeated rows are rows of their own.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), C(doc_id).alias("_id"), C(text).alias("_text"))
    low = F.lower("_text")
    hinted = F.contains(low, F.lit(HINTS[0]))
    for hint in HINTS[1:]:
        hinted = hinted | F.contains(low, F.lit(hint))
    ended = F.regexp_replace(F.regexp_replace("_text", r"([^ \t\r\n.!?;:][.!?;:]+)[ \t\r\n]+", "$1\x01"), r"\n[^\p{L}\p{N}]*\n", "\x01")
    rows = rows.select("_row", "_id", F.posexplode_outer(F.when(hinted, F.split(ended, "\x01"))).alias("_at", "_sentence"))
    normal = F.transform(F.split("_sentence", "\n"), lambda line: F.trim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " ")))
    rows = rows.select("_row", "_id", "_at", F.filter(normal, lambda line: line != "").alias("_lines"))
    found = F.transform(F.sequence(F.lit(1), F.size("_lines")), _longest_run)
    found = F.filter(F.when(F.size("_lines") > 0, found), lambda run: run["end"] > 0)
    rows = rows.select("_row", "_id", "_at", F.explode_outer(found).alias("_run"))
    known = docs.sparkSession.createDataFrame([(s, i) for i, all_ in SENTENCES.items() for s in all_], "_known string, _name string")
    rows = rows.join(F.broadcast(known), C("_run.text") == C("_known"), "left")  # a fixed table
    rows = rows.select("_row", "_id", "_at", C("_run.line").alias("_line"), C("_run.end").alias("_end"), "_name")
    rows = rows.groupBy("_row", "_id").agg(F.sort_array(F.collect_list(F.when(C("_name").isNotNull(), F.struct("_at", "_line", (-C("_end")).alias("_end"), "_name")))).alias("_runs"))
    none = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("end"), F.array().cast("array<string>").alias("names"))
    longest = F.aggregate("_runs", none, lambda kept, run: F.when(
        (run["_at"] == kept["at"]) & (-run["_end"] <= kept["end"]), kept).otherwise(
        F.struct(run["_at"].alias("at"), (-run["_end"]).alias("end"), F.concat(kept["names"], F.array(run["_name"])).alias("names"))))
    found = rows.select("_row", "_id", longest["names"].alias("_names"))
    taken = found.withColumn("_taken", _apply(F.array_join(F.transform("_names", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")))
    return taken.select(C("_id").alias("doc_id"), F.array_join(F.regexp_extract_all("_taken", F.lit(r"\[([^\]]+)\]"), F.lit(1)), ",").alias("licenses"),
                        F.array_join("_names", ",").alias("sentences"),
                        F.size(F.regexp_extract_all("_taken", F.lit("<[^>]+>"), F.lit(0))).cast("bigint").alias("n_unmatched"))


def oracle() -> str:
    """The same in DuckDB SQL, which looks up every run of lines of every sentence."""
    known = ", ".join(f"('{s}', '{i}')" for i, all_ in SENTENCES.items() for s in all_)
    taken = "coalesce(string_agg('<' || name || '>', '' ORDER BY pos, line), '')"
    for identifiers, licence in RULES:
        taken = f"replace({taken}, '{''.join(f'<{i}>' for i in identifiers)}', '[{licence}]')"
    return rf"""
    WITH known(known, name) AS (VALUES {known}),
    d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    b AS (SELECT r, unnest(list_zip(range(len(l)), l)) AS u FROM (SELECT r, regexp_split_to_array(
          regexp_replace(text, '([^ \t\r\n.!?;:][.!?;:]+)[ \t\r\n]+', '\1' || chr(10) || chr(10), 'g'), '\n[^\p{{L}}\p{{N}}]*\n') AS l FROM d)),
    n AS (SELECT r, u[1] AS pos, list_filter(list_transform(string_split(u[2], chr(10)), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS l FROM b),
    i AS (SELECT r, pos, l, unnest(range(len(l))) AS line FROM n),
    e AS (SELECT r, pos, l, line, unnest(range(line + 1, least(len(l), line + {MOST_LINES}) + 1)) AS e FROM i),
    f AS (SELECT r, pos, line, e, name FROM e JOIN known ON array_to_string(l[line + 1:e], ' ') = known.known),
    m AS (SELECT * FROM (SELECT *, max(e) OVER (PARTITION BY r, pos ORDER BY line, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM f)
          WHERE upto IS NULL OR e > upto),
    t AS (SELECT r, {taken} AS taken, string_agg(name, ',' ORDER BY pos, line) AS sentences FROM m GROUP BY r)
    SELECT doc_id, coalesce(array_to_string(regexp_extract_all(taken, '\[([^\]]+)\]', 1), ','), '') AS licenses,
           coalesce(sentences, '') AS sentences, coalesce(len(regexp_extract_all(taken, '<[^>]+>')), 0)::BIGINT AS n_unmatched
    FROM d LEFT JOIN t USING (r)"""
