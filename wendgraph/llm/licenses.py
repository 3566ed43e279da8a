"""Licence recognition: sentences -> identifiers of known licence sentences -> ordered licence rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers of known sentences and the sentences, from the public texts of the licences and usual notices.
SENTENCES = {
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit_liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit_named": "Released under the MIT License.",
    "mit_licensed": "Licensed under the MIT License.",
    "mit_bare": "MIT License",
    "mit_spdx": "SPDX-License-Identifier: MIT",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc_warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc_spdx": "SPDX-License-Identifier: ISC",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd2_spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd3_spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "apache_named": "Licensed under the Apache License, Version 2.0.",
    "apache_grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache_warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache_see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache_spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl3_named": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2_named": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3_grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl_warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_see": "See the GNU General Public License for more details.",
    "gpl3_spdx": "SPDX-License-Identifier: GPL-3.0-or-later",
    "gpl3only_spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl2_spdx": "SPDX-License-Identifier: GPL-2.0-or-later",
    "gpl2only_spdx": "SPDX-License-Identifier: GPL-2.0-only",
    "lgpl_grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl_grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl_subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl_spdx": "SPDX-License-Identifier: MPL-2.0",
    "ccbync_named": "Licensed under CC BY-NC 4.0.",
    "ccby_named": "Licensed under CC BY 4.0.",
    "ccbysa_named": "Licensed under CC BY-SA 4.0.",
    "ccby_long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa_long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbync_long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0_spdx": "SPDX-License-Identifier: CC0-1.0",
    "unlicense_grant": "This is free and unencumbered software released into the public domain.",
    "boost_named": "Distributed under the Boost Software License, Version 1.0.",
    "zlib_warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "all_rights": "All rights reserved.",
}
#: Ordered rules: the first ones take their sentences first. A rule is a run of identifiers; what lies between two
#: known sentences doesn't matter.
RULES = [
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty", "mit_liability"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("ISC", ["isc_grant", "isc_warranty"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("Apache-2.0", ["apache_grant", "apache_copy", "apache_warranty", "apache_see"]),
    ("Apache-2.0", ["apache_grant", "apache_copy"]),
    ("GPL-3.0-or-later", ["gpl3_grant", "gpl_warranty", "gpl_see"]),
    ("GPL-2.0-or-later", ["gpl2_grant", "gpl_warranty", "gpl_see"]),
    ("MPL-2.0", ["mpl_subject", "mpl_copy"]),
    *((name, [one]) for name, ones in (("MIT", ("mit_grant", "mit_named", "mit_licensed", "mit_bare", "mit_spdx")), ("ISC", ("isc_grant", "isc_spdx")), ("BSD-2-Clause", ("bsd2_spdx",)), ("BSD-3-Clause", ("bsd3_spdx",)), ("Apache-2.0", ("apache_named", "apache_grant", "apache_spdx")), ("GPL-3.0-only", ("gpl3_named", "gpl3only_spdx")), ("GPL-2.0-only", ("gpl2_named", "gpl2only_spdx")), ("GPL-3.0-or-later", ("gpl3_grant", "gpl3_spdx")), ("GPL-2.0-or-later", ("gpl2_grant", "gpl2_spdx")), ("LGPL-2.1-or-later", ("lgpl_grant",)), ("AGPL-3.0-or-later", ("agpl_grant",)), ("MPL-2.0", ("mpl_subject", "mpl_spdx")), ("CC-BY-NC-4.0", ("ccbync_named", "ccbync_long")), ("CC-BY-4.0", ("ccby_named", "ccby_long")), ("CC-BY-SA-4.0", ("ccbysa_named", "ccbysa_long")), ("CC0-1.0", ("cc0_spdx",)), ("Unlicense", ("unlicense_grant",)), ("BSL-1.0", ("boost_named",))) for one in ones),
]
#: Every known sentence has one of these, so that a text without any has no known sentence. No blanks: in a text, two words
#: may be apart by a line end or a hyphen.
TELLING = ("licen", "permission", "copyright", "warrant", "redistribut", "liable", "domain", "mpl", "reserved")

# The same patterns serve Java's and DuckDB's regular expressions.
_MARGIN = r"(^|\n)[ \t]*(//+|#+|\*+|;+|--+|/\*+)[ \t]*"
_WRAPPED = r"([^.!?:;\n])\n([a-z(])"
_NUMBERED = r"(^|\n)[ \t]*[0-9]+\.[ \t]+"
_ENDS = r"[.!?]+[ \t\r\n\f]+|\n"
_OTHER = r"[^a-z0-9\x01]+"
_SPLIT = r" ?\x01[ \x01]*"


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _known() -> dict[str, str]:
    """Normalised sentences, as the splitting leaves them, and their identifiers: ends within one ("v. 2.0") cut it."""
    out = {}
    for name, s in SENTENCES.items():
        parts = [normalised(p) for p in re.split(_ENDS, s)]
        out[max(parts, key=len)] = name
    if len(out) != len(SENTENCES) or not all(any(t in s for t in TELLING) for s in out):
        raise ValueError("two sentences are the same when normalised, or one has no telling word")
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_sentences (known ones), sequence (their identifiers in order, joined by blanks) and licenses
    (names of the rules that matched, each once, in the order of the rules, joined by blanks).

    A row at a time, without a shuffle, Python or a join: comment signs and list numbers at the start of lines
    go, lines that go on in lower case are joined, the text is cut after sentence ends and at line ends, and
    each sentence, in lower case without punctuation, is looked up among the known ones. Rules take their run
    of identifiers out of the sequence, one after the other. Null and empty texts have no sentences ("" and 0).
    Repeated rows each get their row; an empty table gives none; other columns are not looked at.
    """
    known = _known()
    text = F.col("text").cast("string")
    clean = F.regexp_replace(F.regexp_replace(text, _MARGIN, "$1"), _NUMBERED, "$1")
    whole = F.lower(F.regexp_replace(clean, _WRAPPED, "$1 $2"))
    flat = F.regexp_replace(F.regexp_replace(whole, _ENDS, "\x01"), _OTHER, " ")
    sentences = F.filter(F.split(F.trim(flat), _SPLIT), lambda s: F.trim(s).isin(list(known)))
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    telling = F.lit(False)
    for t in TELLING:
        telling = telling | F.contains(F.lower(text), F.lit(t))
    ids = F.when(telling, F.transform(sentences, lambda s: F.element_at(names, F.trim(s)))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sequence"))
    return rows.select("doc_id", "n_sentences", "sequence", _licenses(F.col("sequence")).alias("licenses"))


def _licenses(sequence: Column) -> Column:
    """The rules, one after the other, over an array of what is left of the sequence and the names so far."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f" {'  '.join(ids)} ").alias("run")) for name, ids in RULES])
    start = F.struct(F.concat(F.lit(" "), F.replace(sequence, F.lit(" "), F.lit("  ")), F.lit(" ")).alias("rest"), F.lit("").alias("names"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["run"])
        new = hit & ~F.contains(F.concat(F.lit(" "), state["names"], F.lit(" ")), F.concat(F.lit(" "), rule["name"], F.lit(" ")))
        names = F.when(new, F.ltrim(F.concat(state["names"], F.lit(" "), rule["name"]))).otherwise(state["names"])
        return F.struct(F.replace(state["rest"], rule["run"], F.lit(" | ")).alias("rest"), names.alias("names"))

    return F.when(sequence == "", F.lit("")).otherwise(F.aggregate(rules, start, step, lambda s: s["names"]))


def sql() -> str:
    """The same in DuckDB's SQL."""
    known = _known()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    clean = f"regexp_replace(regexp_replace(text, {quoted(_MARGIN)}, '\\1', 'g'), {quoted(_NUMBERED)}, '\\1', 'g')"
    whole = f"lower(regexp_replace({clean}, {quoted(_WRAPPED)}, '\\1 \\2', 'g'))"
    flat = f"regexp_replace(regexp_replace({whole}, {quoted(_ENDS)}, chr(1), 'g'), {quoted(_OTHER)}, ' ', 'g')"
    entries = ", ".join(f"{quoted(s)}: {quoted(n)}" for s, n in known.items())
    steps = ["SELECT doc_id, ids, ' ' || replace(sequence, ' ', '  ') || ' ' AS rest, '' AS names, sequence FROM found"]
    for name, ids in RULES:
        run = quoted(f" {'  '.join(ids)} ")
        new = f"contains(rest, {run}) AND NOT contains(' ' || names || ' ', {quoted(f' {name} ')})"
        steps.append(f"SELECT doc_id, ids, replace(rest, {run}, ' | ') AS rest, CASE WHEN {new} THEN ltrim(names || {quoted(' ' + name)}) ELSE names END AS names, sequence FROM r{len(steps) - 1}")
    ctes = ", ".join(f"r{i} AS ({s})" for i, s in enumerate(steps))
    return f"""WITH known AS (SELECT MAP {{{entries}}} AS m), cut AS (SELECT doc_id, coalesce([m[trim(s)] FOR s IN regexp_split_to_array(trim({flat}), {quoted(_SPLIT)}) IF map_contains(m, trim(s))], []) AS ids FROM documents, known), found AS (SELECT doc_id, ids, array_to_string(ids, ' ') AS sequence FROM cut), {ctes} SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, sequence, names AS licenses FROM r{len(steps) - 1}"""
