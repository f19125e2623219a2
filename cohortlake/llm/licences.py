"""Licence scan by sentence rules: normalised sentences become known identifiers, and the identifier sequence of a text
is matched against ordered rules. Spark functions only.

Texts are lower-cased; comment marks at line begins go; web addresses, blank lines, colons and semicolons end a sentence, as do
full stops, question and exclamation marks before white space (but "v. 2.0" is one word). Everything but ASCII letters, digits
and inner dots becomes one space, wrapped lines thus being joined. A line that ends without a mark may be a notice of its own,
so the lines are read by themselves as well, and what only they give is added at the end. A sentence is known if it equals a known
one, ends with one of 8 words or more (a heading may stand before it), or has the beginning and end of a slot, as
where a holder's name varies. Rules apply in order; what a rule has taken is closed to later ones, so a full text is not reported
again as a mention. The sentences of a rule come in its order, whatever known ones stand between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licences and notices, and their identifiers.
SENTENCES = {
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu general public license version 2": "gpl2",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl21later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gnuhope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gnuwarranty",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnuwarranty",
    "see the gnu general public license for more details": "gnudetails",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mitgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mitnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mitwarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mitliability",
    "licensed under the apache license version 2.0": "apache2",
    "licensed under the apache license version 2.0 the license": "apache2",
    "you may not use this file except in compliance with the license": "apachefile",
    "you may obtain a copy of the license at": "apachecopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apachewarranty",
    "see the license for the specific language governing permissions and limitations under the license": "apachedetails",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsdgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsdsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsdbinary",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "iscgrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "zerobsdgrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "iscwarranty",
    "this source code form is subject to the terms of the mozilla public license v.2.0": "mpl2",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mplcopy",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlibgrant",
    "the origin of this software must not be misrepresented": "zliborigin",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boostgrant",
    "licensed under cc by 4.0": "ccby4",
    "licensed under cc by sa 4.0": "ccbysa4",
    "licensed under cc by nc 4.0": "ccbync4",
    "this work is licensed under a creative commons attribution 4.0 international license": "ccby4",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "ccbysa4",
    "licensed under cc0 1.0": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
# The beginning and the end of sentences that name a holder between them, and their identifiers.
SLOTS = [
    ("neither the name of ", " may be used to endorse or promote products derived from this software without specific prior written permission", "bsdnames"),
    ("this software is provided by ", " are disclaimed", "bsdwarranty"),
    ("copyright ", " all rights reserved", "reserved"),
]
# Fixed values: (identifiers in order, licence), longer rules before the mentions they contain.
RULES = [
    (["mitgrant", "mitnotice"], "MIT"), (["apache2", "apachefile", "apachewarranty"], "Apache-2.0"), (["apache2", "apachefile"], "Apache-2.0"),
    (["bsdgrant", "bsdnames"], "BSD-3-Clause"), (["bsdgrant", "bsdsource", "bsdbinary"], "BSD-2-Clause"),
    (["gpl3later", "gnuwarranty"], "GPL-3.0-or-later"), (["gpl2later", "gnuwarranty"], "GPL-2.0-or-later"), (["gpl3later"], "GPL-3.0-or-later"), (["gpl2later"], "GPL-2.0-or-later"),
    (["lgpl3later"], "LGPL-3.0-or-later"), (["lgpl21later"], "LGPL-2.1-or-later"), (["agpl3later"], "AGPL-3.0-or-later"), (["gpl3"], "GPL-3.0"), (["gpl2"], "GPL-2.0"),
    (["mit"], "MIT"), (["mitgrant"], "MIT"), (["apache2"], "Apache-2.0"), (["iscgrant"], "ISC"), (["zerobsdgrant"], "0BSD"), (["mpl2"], "MPL-2.0"), (["zlibgrant", "zliborigin"], "Zlib"), (["boostgrant"], "BSL-1.0"),
    (["ccby4"], "CC-BY-4.0"), (["ccbysa4"], "CC-BY-SA-4.0"), (["ccbync4"], "CC-BY-NC-4.0"), (["cc0"], "CC0-1.0"), (["unlicense"], "Unlicense"), (["reserved"], "all-rights-reserved"),
]
LONG = 8
ENDS = r"[.!?]+\s|[.!?]+$|[;:]|\n"
#: What is replaced before the split, in order: line ends, comment marks, addresses, "v. 2", blank lines by a mark, single ones by a space.
BEFORE = [(r"\r\n?", "\n"), (r"(^|\n)[ \t]*(//+|/\*+|\*+/|\*+|#+|--|<!--|dnl |rem )[ \t]*", "{1}"), (r"https?://\S+", " : "), (r"\bv\. ([0-9])", "v.{1}")]
JOIN = [(r"\n[ \t]*\n\s*", " : "), (r"\n", " ")]
#: Each known sentence holds one of these, so others are not looked up.
CUES = "licens|permi|redistribut|copyright|rights|warrant|public domain|liable|mpl|misrepresented"


def _identified(parts) -> F.Column:
    """The identifiers of the known ones among raw sentences, in order."""
    table = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    ends = sorted(((k, v) for k, v in SENTENCES.items() if len(k.split()) >= LONG), key=lambda x: -len(x[0]))

    def known(s) -> F.Column:
        tails = [F.when(F.endswith(s, F.lit(f" {k}")), v) for k, v in ends]
        slots = [F.when(F.startswith(s, F.lit(a)) & F.endswith(s, F.lit(b)), v) for a, b, v in SLOTS]
        return F.coalesce(F.try_element_at(table, s), *slots, *tails)

    plain = F.transform(F.filter(parts, lambda s: s.rlike(CUES)), lambda s: F.rtrim(F.trim(F.regexp_replace(s, "[^a-z0-9.]+", " ")), F.lit(".")))
    return F.filter(F.transform(plain, known), lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known (recognised sentences), known (their identifiers in order, comma-joined), licences (sorted,
    comma-joined) for every row of ``docs`` (doc_id, text).

    Null and empty texts have none; very long texts are read whole; repeated rows each get a row; an empty table gives no rows.
    Other columns are not read.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    text = F.when(text.rlike(CUES), text).otherwise("")
    for rule, by in BEFORE:
        text = F.regexp_replace(text, rule, by.replace("{1}", "$1"))
    rows = docs.select("doc_id", text.alias("t"))
    joined = F.col("t")
    for rule, by in JOIN:
        joined = F.regexp_replace(joined, rule, by)
    rows = rows.select("doc_id", _identified(F.split(joined, ENDS)).alias("a"), _identified(F.split("t", ENDS)).alias("b"))
    rows = rows.select("doc_id", F.concat("a", F.filter("b", lambda x: ~F.array_contains(F.col("a"), x))).alias("k"))
    rest, found, steps = F.array_join(F.transform("k", lambda x: F.concat(F.lit("|"), x, F.lit("|"))), ""), [], []
    rows = rows.withColumn("rest", rest)
    for ids, name in RULES:
        before = steps[-1] if steps else F.col("rest")
        found.append(F.when(before.rlike(_rule(ids)), F.lit(name)))
        steps.append(F.regexp_replace(before, _rule(ids), "#"))
    names = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))), ",")
    none = F.col("rest") == ""
    return rows.select("doc_id", F.size("k").cast("long").alias("n_known"), F.array_join("k", ",").alias("known"), F.when(none, "").otherwise(names).alias("licences"))


def _rule(ids: list[str]) -> str:
    return r"(\|[a-z0-9]+\|)*?".join(rf"\|{x}\|" for x in ids)


def _sql() -> str:
    """The same in DuckDB's SQL."""
    values = ", ".join(f"('{s}', '{k}', {len(s.split())})" for s, k in SENTENCES.items())
    slots = ", ".join(f"('{a}', '{b}', '{k}')" for a, b, k in SLOTS)
    text, joined = "lower(coalesce(text, ''))", "t"
    for rule, by in BEFORE:
        text = f"regexp_replace({text}, '{rule}', '{by.replace('{1}', chr(92) + '1')}', 'g')".replace("'\n'", "chr(10)")
    for rule, by in JOIN:
        joined = f"regexp_replace({joined}, '{rule}', '{by}', 'g')"
    steps, names = "SELECT doc_id, n_known, known, rest AS r0 FROM seq", []
    for i, (ids, name) in enumerate(RULES):
        steps = f"SELECT *, regexp_replace(r{i}, '{_rule(ids)}', '#', 'g') AS r{i + 1} FROM ({steps})"
        names.append(f"CASE WHEN regexp_matches(r{i}, '{_rule(ids)}') THEN '{name}' END")
    return f"""
WITH known(s, k, w) AS (VALUES {values}), slots(a, b, k) AS (VALUES {slots}),
texts AS (SELECT row_number() OVER () AS i, doc_id, {text} AS t FROM documents),
parts AS (SELECT i, doc_id, 0 AS way, string_split_regex({joined}, '{ENDS}') AS p FROM texts UNION ALL SELECT i, doc_id, 1, string_split_regex(t, '{ENDS}') FROM texts),
each AS (SELECT i, way, unnest(p) AS s, generate_subscripts(p, 1) AS pos FROM parts),
plain AS (SELECT i, way, pos, rtrim(trim(regexp_replace(s, '[^a-z0-9.]+', ' ', 'g')), '.') AS s FROM each WHERE regexp_matches(s, '{CUES}')),
distinct_ones AS (SELECT DISTINCT s FROM plain),
hits AS (SELECT d.s, known.k, 3 AS rank, length(known.s) AS n FROM distinct_ones d JOIN known ON d.s = known.s
  UNION ALL SELECT d.s, slots.k, 2, 0 FROM distinct_ones d JOIN slots ON starts_with(d.s, slots.a) AND suffix(d.s, slots.b)
  UNION ALL SELECT d.s, known.k, 1, length(known.s) FROM distinct_ones d JOIN known ON known.w >= {LONG} AND suffix(d.s, ' ' || known.s)),
named AS (SELECT s, arg_max(k, rank * 1000000 + n) AS k FROM hits GROUP BY s),
found AS (SELECT i, way, pos, k FROM plain JOIN named USING (s)),
both_ways AS (SELECT * FROM found WHERE way = 0 UNION ALL SELECT f.* FROM found f WHERE way = 1 AND NOT EXISTS (SELECT 1 FROM found g WHERE g.way = 0 AND g.i = f.i AND g.k = f.k)),
seq AS (SELECT texts.doc_id, count(k) AS n_known, coalesce(string_agg(k, ',' ORDER BY way, pos), '') AS known, coalesce(string_agg('|' || k || '|', '' ORDER BY way, pos), '') AS rest FROM texts LEFT JOIN both_ways USING (i) GROUP BY texts.i, texts.doc_id)
SELECT doc_id, n_known, known, array_to_string(list_sort(list_distinct([x FOR x IN [{", ".join(names)}] IF x IS NOT NULL])), ',') AS licences FROM ({steps})
"""


LICENCE_SQL = _sql()
