"""License scans by sentence rules (DataFrame functions only).

A text is cut into parts at line ends and punctuation, each is normalised (A-Z
lowered, every run of other characters than letters and digits a space, which
also takes comment signs away). A known licence sentence is a run of whole parts,
so sentences wrapped over lines or holding a colon or semicolon are found; of
two sentences that begin at one part the longer counts. The identifiers found,
in text order, are then matched against ordered licence rules: a rule is a
sequence of identifiers that must follow each other; earlier rules take their
identifiers first, so that a whole licence text wins over a one-line notice
inside it.

The SQL knows ``SENTENCES`` and ``RULES`` in single parts only. It agrees where a
text holds short notices; on full or wrapped licence texts the operator finds
more.

Each known sentence holds a cue word, so texts without any cue skip the
sentence work with the same result.

Defined results: a null or empty text has no sentence and no licence; repeated
rows are scanned each for itself; a sentence with text before or after it in
the same sentence is not that sentence; other columns are left unchanged
(columns that carry a result's name are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences by identifier.
SENTENCES = {
    "apache-short": "licensed under the apache license version 2 0",
    "apache-long": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "bsd-redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-short": "released under the bsd license",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-short": "licensed under cc by 4 0",
    "gpl3": "this work is licensed under the gnu general public license version 3",
    "gpl-redist": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl3": "this work is licensed under the gnu lesser general public license version 3",
    "agpl3": "this work is licensed under the gnu affero general public license version 3",
    "mit-short": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "reserved": "all rights reserved under copyright",
}
# Licence rules in the order in which they are tried.
RULES = (
    ("MIT", "permissive", ("mit-grant", "mit-notice")),
    ("Apache-2.0", "permissive", ("apache-long", "apache-use", "apache-copy")),
    ("BSD-3-Clause", "permissive", ("bsd-redist", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", "copyleft", ("gpl-redist", "gpl-warranty")),
    ("GPL-3.0-or-later", "copyleft", ("gpl-redist",)),
    ("MIT", "permissive", ("mit-grant",)),
    ("BSD-2-Clause", "permissive", ("bsd-redist", "bsd-source")),
    ("Apache-2.0", "permissive", ("apache-long",)),
    ("Apache-2.0", "permissive", ("apache-short",)),
    ("MIT", "permissive", ("mit-short",)),
    ("BSD", "permissive", ("bsd-short",)),
    ("GPL-3.0", "copyleft", ("gpl3",)),
    ("LGPL-3.0", "copyleft", ("lgpl3",)),
    ("AGPL-3.0", "copyleft", ("agpl3",)),
    ("MPL-2.0", "copyleft", ("mpl2",)),
    ("CC-BY-NC-4.0", "non-commercial", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa",)),
    ("CC-BY-4.0", "permissive", ("cc-by",)),
    ("CC-BY-4.0", "permissive", ("cc-by-short",)),
    ("proprietary", "reserved", ("reserved",)),
)
# Sentences of the full standard texts, by identifier.
FULL_SENTENCES = (
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("bsd-endorse", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl2-redist", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl3-redist", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl3-redist", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache-copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-copy", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
)
# The third BSD clause, which names the holder between these.
ENDORSE = ("neither the name of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission")
HOLDER_WORDS = 16
# Rules of the full texts, tried before RULES.
FULL_RULES = (
    ("MIT", "permissive", ("mit-grant", "mit-notice")),
    ("Apache-2.0", "permissive", ("apache-long", "apache-use", "apache-copy")),
    ("BSD-3-Clause", "permissive", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", "permissive", ("bsd-redist", "bsd-source", "bsd-binary")),
    ("GPL-2.0-or-later", "copyleft", ("gpl2-redist", "gpl-warranty")),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl3-redist", "gpl-warranty")),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3-redist", "gpl-warranty")),
    ("GPL-2.0-or-later", "copyleft", ("gpl2-redist",)),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl3-redist",)),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3-redist",)),
) + RULES
# Every known sentence holds one of these.
CUES = ("licens", "permission", "redistribut", "warranty", "copyright")
SENTENCE_END = "[\\n\\r]+|[.!?:;]+[ \\t\\n\\f\\r\"')]+|[.!?]+\\z"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(sentence: Column, other: str = "[^a-z0-9]+") -> Column:
    return F.trim(F.regexp_replace(sentence, other, " "))


def _pattern() -> str:
    """Every known sentence between two part ends ``Z`` (a lowered text has no
    such letter), with a part end or a space between any two words."""
    def run(words: str) -> str:
        return words.replace(" ", "[ Z]")
    known = sorted([*SENTENCES.values(), *(s for _, s in FULL_SENTENCES)], key=lambda s: (-len(s), s))
    holder = f"[ Z](?:[a-z0-9]+[ Z]){{1,{HOLDER_WORDS}}}?"
    return f"Z({'|'.join(map(run, known))}|{run(ENDORSE[0])}{holder}{run(ENDORSE[1])})(?=Z)"


def _identifiers(low: Column) -> Column:
    parts = normalise(F.regexp_replace(low, SENTENCE_END, "Z"), "[^a-z0-9Z]+")
    parts = F.regexp_replace(F.concat(F.lit("Z"), parts, F.lit("Z")), "[ Z]*Z[ Z]*", "Z")
    found = F.transform(F.regexp_extract_all(parts, F.lit(_pattern()), F.lit(1)), lambda s: F.translate(s, "Z", " "))
    ids = F.create_map(*[F.lit(x) for k, v in (*SENTENCES.items(), *FULL_SENTENCES) for x in (v, k)])
    return F.transform(found, lambda s: F.when(s.startswith(ENDORSE[0]), F.lit("bsd-endorse"))
                       .otherwise(F.element_at(ids, s)))


def _match(ids: Column) -> Column:
    """The identifier list as one string, each rule's runs replaced in turn by
    ``=n`` for rule n. Items stand between two bars, so neighbours never share
    a bar and every run is found."""
    out = F.concat_ws("", F.transform(ids, lambda x: F.concat(F.lit("|"), x, F.lit("|"))))
    for n, (_, _, run) in enumerate(FULL_RULES):
        out = F.replace(out, F.lit("".join(f"|{x}|" for x in run)), F.lit(f"|={n:02d}|"))
    return out


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` (known sentences in text order,
    comma-joined), ``licenses`` and ``license_kinds`` (distinct names and
    kinds of the rules that matched, sorted, comma-joined), ``n_matches``
    (rule matches) and ``n_loose`` (known sentences that no rule took)."""
    low = F.translate(F.col(text), UPPER, LOWER)
    cue = None
    for c in CUES:
        cue = low.contains(c) if cue is None else cue | low.contains(c)
    ids = F.when(cue, _identifiers(low)).otherwise(F.array().cast("array<string>"))
    made = ("sentence_ids", "licenses", "license_kinds", "n_matches", "n_loose")
    rest = [c for c in docs.columns if c not in made]

    def names(col: int) -> Column:
        m = F.create_map(*[x for n, r in enumerate(FULL_RULES) for x in (F.lit(f"{n:02d}"), F.lit(r[col]))])
        return F.array_join(F.array_sort(F.array_distinct(F.transform("__ls_rules", lambda x: F.element_at(m, x)))), ",")

    return (docs.select(*rest, F.coalesce(ids, F.array().cast("array<string>")).alias("__ls_ids"))
            .withColumn("__ls_text", _match(F.col("__ls_ids")))
            .withColumn("__ls_rules", F.regexp_extract_all("__ls_text", F.lit("=([0-9]+)"), F.lit(1)))
            .select(*rest, F.array_join("__ls_ids", ",").alias("sentence_ids"), names(0).alias("licenses"),
                    names(1).alias("license_kinds"), F.size("__ls_rules").cast("long").alias("n_matches"),
                    F.size(F.regexp_extract_all("__ls_text", F.lit("[|][^=|]+[|]"), F.lit(0))).cast("long")
                    .alias("n_loose")))


def _oracle() -> str:
    ids = "MAP {" + ", ".join(f"'{v}': '{k}'" for k, v in SENTENCES.items()) + "}"
    run = "array_to_string([('|' || x || '|') for x in ids], '')"
    for n, (_, _, seq) in enumerate(RULES):
        run = f"replace({run}, '{''.join(f'|{x}|' for x in seq)}', '|={n:02d}|')"

    def names(col):
        m = "MAP {" + ", ".join(f"'{n:02d}': '{r[col]}'" for n, r in enumerate(RULES)) + "}"
        return f"array_to_string(list_sort(list_distinct([{m}[x] for x in rules])), ',')"

    end = SENTENCE_END.replace("'", "''")
    return f"""
WITH s AS (
  SELECT doc_id, [trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) for x in
    regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{end}')] AS n FROM documents),
i AS (SELECT doc_id, [m[x] for x in n if m[x] IS NOT NULL] AS ids FROM s, (SELECT {ids} AS m)),
r AS (SELECT doc_id, ids, {run} AS t FROM i),
q AS (SELECT doc_id, ids, t, regexp_extract_all(t, '=([0-9]+)', 1) AS rules FROM r)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, {names(0)} AS licenses,
  {names(1)} AS license_kinds, len(rules)::BIGINT AS n_matches,
  len(regexp_extract_all(t, '[|][^=|]+[|]'))::BIGINT AS n_loose
FROM q
"""


ORACLE = _oracle()
