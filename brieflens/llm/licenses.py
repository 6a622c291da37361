"""Licence texts by sentence rules: sentences -> sentence ids -> ordered rules.

A text is cut at sentence ends, blank lines and line breaks; the parts are normalised
(letters and digits of the Latin alphabet in lower case, single spaces).  A known
sentence is one part or several in a row that only single line breaks separate, so
titles of one line and hard-wrapped texts are both found; marks at the beginning of
a line (comments, indent) count for nothing, and a blank line before an address
counts as a single break.  The ids found, in order, are matched against the rules: a rule fits
where its ids stand next to each other among the known sentences, the longest
rule first, from left to right.  Everything happens in the row that holds the
text, with built-in functions; texts without a word that every known sentence
needs are not cut up at all.

Cases: null and empty texts have no sentences; the same licence twice is listed
twice; where a known sentence begins another one, the longer one counts; a sentence
of any length is looked up whole; ids and rules are fixed, so
equal texts give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# The oracle's cuts: it knows sentences of one line only.
CUT = r"[.!?;][\x20\x09-\x0D]+|[\x0A\x0D]+"
OTHER = r"[^a-z0-9]+"
# In turn: line ends in one form; comment marks; sentence ends and blank lines to bars; the rest to single spaces.
STEPS = [
    (r"\r\n?", "\n"), (r"(?<![^\n])(?:[^a-z0-9\n]|(?:rem|dnl)[\x20\t])+", ""), (r"[.!?;][\x20\x09-\x0D]+", "|"),
    (r"\n\n++(?!https?\b)", "|"), (r"[^a-z0-9\n|]+", " "), (r"[\x20\n]*+\|[\x20\n|]*+", "|"), (r"\x20?\n[\x20\n]*+", "\n"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Known sentences: id, text (public licence wordings).
SENTENCES = {
    "mit-name": "MIT License",
    "mit-the-name": "The MIT License (MIT)",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-this": "This project is licensed under the MIT License",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-licensed-the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-spdx": "SPDX-License-Identifier: Apache-2.0",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl3-later-spdx": "SPDX-License-Identifier: GPL-3.0-or-later",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-no-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd2-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd3-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ccby4-licensed": "Licensed under CC BY 4.0",
    "ccby4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ccbync4-licensed": "Licensed under CC BY-NC 4.0",
    "ccbync4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
}

# Rules: licence, ids in order.
RULES = [
    ("MIT", ["mit-name", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-the-name", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-released"]), ("MIT", ["mit-licensed"]), ("MIT", ["mit-this"]), ("MIT", ["mit-spdx"]),
    ("MIT", ["mit-name"]), ("MIT", ["mit-the-name"]),
    ("Apache-2.0", ["apache-licensed-the", "apache-use", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-licensed-the", "apache-use"]),
    ("Apache-2.0", ["apache-licensed"]), ("Apache-2.0", ["apache-licensed-the"]), ("Apache-2.0", ["apache-spdx"]),
    ("GPL-3.0-or-later", ["gpl3-free", "gpl-hope", "gpl-implied", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl3-free"]), ("GPL-3.0-or-later", ["gpl3-later-spdx"]),
    ("GPL-3.0-only", ["gpl3-work"]), ("GPL-3.0-only", ["gpl3-spdx"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-implied", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-no-endorse"]), ("BSD-3-Clause", ["bsd3-spdx"]),
    ("BSD-2-Clause", ["bsd-redistribution"]), ("BSD-2-Clause", ["bsd2-spdx"]),
    ("ISC", ["isc-grant", "mit-as-is"]), ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("CC-BY-4.0", ["ccby4-licensed"]), ("CC-BY-4.0", ["ccby4-work"]),
    ("CC-BY-NC-4.0", ["ccbync4-licensed"]), ("CC-BY-NC-4.0", ["ccbync4-work"]),
    ("Unlicense", ["unlicense-free"]),
]

# Every known sentence holds one of these words as it stands.
ANCHORS = ["licen", "permission", "software", "warrant", "redistribution"]


def plain(text: str) -> list[str]:
    """Normalised sentences of a known text: the same steps as the oracle's, in Python."""
    lower = text.translate(str.maketrans(UPPER, LOWER))
    return [x for x in (re.sub(OTHER, " ", s).strip(" ") for s in re.split(CUT, lower)) if x]


def telling(text: str) -> list[str]:
    """Its sentences that hold an anchor; the rest ("2 0" after an abbreviation) say nothing alone."""
    return [p for p in plain(text) if any(a in p for a in ANCHORS)]


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> id; a wording of several sentences is known by each of them, numbered."""
    out: dict[str, str] = {}
    for name, text in SENTENCES.items():
        parts = telling(text)
        for k, part in enumerate(parts):
            out.setdefault(part, name if len(parts) == 1 else f"{name}.{k + 1}")
    return out


def rule_ids() -> list[tuple[str, list[str]]]:
    """Rules over the ids of `known_sentences`, the longest first."""
    by_text = known_sentences()
    rules = [(licence, [by_text[p] for name in names for p in telling(SENTENCES[name])]) for licence, names in RULES]
    return sorted(rules, key=lambda r: -len(r[1]))


def parts(text: Column) -> Column:
    """The normalised parts of a text, each between bars (cuts) or line ends (single breaks)."""
    out = F.translate(text, UPPER + "|", LOWER + ",")
    for pattern, mark in STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(mark))
    return F.concat(F.lit("|"), F.trim(out), F.lit("|"))


def sentence_pattern() -> str:
    """A known sentence, wrapped or not, as whole parts; the longest first."""
    words = (x.replace(" ", r"[\x20\n]") for x in sorted(known_sentences(), key=lambda x: (-len(x), x)))
    return rf"(?<=[|\n])(?:{'|'.join(words)})(?=[|\n])"


def rule_pattern() -> str:
    return "|".join("".join(f"<{re.escape(x)}>" for x in ids) for _, ids in rule_ids())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licenses (joined by commas in order), n_licenses."""
    text = whole_text(text_col)
    known = F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in pair])
    licence_of = F.create_map(*[F.lit(x) for name, ids in reversed(rule_ids()) for x in ("".join(f"<{i}>" for i in ids), name)])
    lower = F.translate(text, UPPER, LOWER)
    maybe = F.contains(lower, F.lit(ANCHORS[0]))
    for word in ANCHORS[1:]:
        maybe = maybe | F.contains(lower, F.lit(word))
    found = F.regexp_extract_all(parts(text), F.lit(sentence_pattern()), F.lit(0))
    ids = F.when(maybe, F.transform(found, lambda s: F.element_at(known, F.translate(s, "\n", " "))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    line = F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    hits = F.transform(F.regexp_extract_all(line, F.lit(rule_pattern()), F.lit(0)), lambda x: F.element_at(licence_of, x))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
                       F.array_join(hits, ",").alias("licenses"), F.size(hits).cast("long").alias("n_licenses"))


def oracle() -> str:
    """DuckDB SQL over `documents`: the same result where no known sentence goes over several lines."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in known_sentences().items())
    rules = ", ".join(f"({quote(''.join(f'<{i}>' for i in ids))}, {quote(name)})" for name, ids in rule_ids())
    return f"""
WITH known(sentence, id) AS (VALUES {known}), rules(line, licence) AS (VALUES {rules}),
s AS (
  SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS place
  FROM (SELECT doc_id, string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{CUT}') AS parts FROM documents)),
hits AS (
  SELECT doc_id, list(id ORDER BY place) AS ids FROM s JOIN known ON sentence = trim(regexp_replace(part, '{OTHER}', ' ', 'g'), ' ')
  GROUP BY doc_id),
named AS (
  SELECT doc_id, ids, regexp_extract_all(list_aggregate(['<' || x || '>' for x in ids], 'string_agg', ''),
                                         {quote(rule_pattern().replace(chr(92), ''))}) AS lines FROM hits),
told AS (
  SELECT doc_id, list(licence ORDER BY place) AS names
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM named) JOIN (SELECT DISTINCT * FROM rules) USING (line)
  GROUP BY doc_id)
SELECT doc_id, coalesce(len(ids), 0) AS n_sentences, coalesce(list_aggregate(ids, 'string_agg', ','), '') AS sentence_ids,
       coalesce(list_aggregate(names, 'string_agg', ','), '') AS licenses, coalesce(len(names), 0) AS n_licenses
FROM documents LEFT JOIN named USING (doc_id) LEFT JOIN told USING (doc_id)
"""
