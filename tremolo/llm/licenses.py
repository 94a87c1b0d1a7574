"""Licence scans by sentence rules.

A text is cut into sentences, which are normalised; runs of them are looked up among known licence sentences, since the
cut also falls at line breaks and inside a clause. The identifiers, in the order of the text, are matched against
licence rules, which are ordered sequences of identifiers; a longer rule goes first, and what it matches is used up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import small_batches

# The sentences of public licence texts and notices, normalised (small letters, digits, single spaces).
SENTENCES = {
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "no_liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit_released": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache_licensed": "licensed under the apache license version 2 0",
    "apache_notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache_unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_received": "you should have received a copy of the gnu general public license along with this program",
    "gpl3_licensed": "this work is licensed under the gnu general public license version 3",
    "ccbync_licensed": "licensed under cc by nc 4 0",
    "ccby_licensed": "licensed under cc by 4 0",
    "mpl_notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl_copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl_copy_http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mit0_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc_no_liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd_advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd_as_is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd_no_liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl_see": "see the gnu general public license for more details",
    "lgpl_hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl21_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl_see": "see the gnu lesser general public license for more details",
    "lgpl_received": "you should have received a copy of the gnu lesser general public license along with this library",
    "agpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl_see": "see the gnu affero general public license for more details",
    "agpl_received": "you should have received a copy of the gnu affero general public license along with this program",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "unlicense_anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_no_liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib_origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib_altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib_notice": "this notice may not be removed or altered from any source distribution",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "boost_distributed": "distributed under the boost software license version 1 0",
    "epl1_terms": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
    "epl2_terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "cc0_dedicated": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0_no_warranty": "this software is distributed without any warranty",
    "wtfpl_terms": "you can redistribute it and or modify it under the terms of the do what the fuck you want to public license version 2 as published by sam hocevar",
    "perl_terms": "this is free software you can redistribute it and or modify it under the same terms as perl itself",
}
# Short names of licences in identifier lines and in one-line statements.
SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "WTFPL", "Zlib"]
CREATIVE = {"CC-BY": "attribution", "CC-BY-SA": "attribution sharealike", "CC-BY-ND": "attribution noderivatives", "CC-BY-NC": "attribution noncommercial", "CC-BY-NC-SA": "attribution noncommercial sharealike", "CC-BY-NC-ND": "attribution noncommercial noderivatives"}
EDITIONS = {"3.0": "3 0 unported", "4.0": "4 0 international"}
NAMED = {"mit license": "MIT", "isc license": "ISC", "bsd 2 clause license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause", "apache 2 0 license": "Apache-2.0", "apache license 2 0": "Apache-2.0", "mozilla public license 2 0": "MPL-2.0", "gnu general public license v3 0": "GPL-3.0-only", "gnu affero general public license v3 0": "AGPL-3.0-only", "boost software license 1 0": "BSL-1.0"}


def plain(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


#: Statements in one sentence, by rule: sentence -> licence.
STATED = {f"spdx license identifier {plain(k)}": k for k in SPDX}
STATED |= {f"this work is licensed under a creative commons {words} {edition} license": f"{k}-{v}" for k, words in CREATIVE.items() for v, edition in EDITIONS.items()}
STATED |= {f"licensed under {plain(k)} {plain(v)}": f"{k}-{v}" for k in CREATIVE for v in EDITIONS}
STATED |= {f"{start} under the {k}": v for start in ("licensed", "released", "distributed", "this project is licensed") for k, v in NAMED.items()}
STATED = {k: v for k, v in STATED.items() if k not in SENTENCES.values()}
SENTENCES |= {k.replace(" ", "_"): k for k in STATED}
RULES = [
    ("MIT", ["mit_grant", "mit_notice", "as_is", "no_liability"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("Apache-2.0", ["apache_notice", "apache_copy", "apache_unless"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_received"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope", "gpl_received"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("ISC", ["isc_grant"]),
    ("MIT", ["mit_released"]),
    ("MIT", ["mit_licensed"]),
    ("Apache-2.0", ["apache_notice"]),
    ("Apache-2.0", ["apache_licensed"]),
    ("GPL-3.0-only", ["gpl3_licensed"]),
    ("CC-BY-NC-4.0", ["ccbync_licensed"]),
    ("CC-BY-4.0", ["ccby_licensed"]),
    ("MPL-2.0", ["mpl_notice"]),
    ("MPL-2.0", ["mpl_notice", "mpl_copy"]),
    ("MPL-2.0", ["mpl_notice", "mpl_copy_http"]),
    ("MIT-0", ["mit0_grant", "as_is", "no_liability"]),
    ("ISC", ["isc_grant", "isc_as_is", "isc_no_liability"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_as_is", "bsd_no_liability"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is", "bsd_no_liability"]),
    ("BSD-4-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_names"]),
    ("Apache-2.0", ["apache_notice", "apache_copy", "apache_unless", "apache_see"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_see", "gpl_received"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope", "gpl_see", "gpl_received"]),
    ("LGPL-2.1-or-later", ["lgpl21_free", "lgpl_hope", "lgpl_see", "lgpl_received"]),
    ("LGPL-2.1-or-later", ["lgpl21_free"]),
    ("LGPL-3.0-or-later", ["lgpl3_free", "lgpl_hope", "lgpl_see", "lgpl_received"]),
    ("LGPL-3.0-or-later", ["lgpl3_free"]),
    ("AGPL-3.0-or-later", ["agpl_free", "gpl_hope", "agpl_see", "agpl_received"]),
    ("AGPL-3.0-or-later", ["agpl_free"]),
    ("Unlicense", ["unlicense_free", "unlicense_anyone"]),
    ("Unlicense", ["unlicense_free"]),
    ("Zlib", ["zlib_as_is", "zlib_no_liability", "zlib_grant", "zlib_origin", "zlib_altered", "zlib_notice"]),
    ("Zlib", ["zlib_grant", "zlib_origin", "zlib_altered", "zlib_notice"]),
    ("BSL-1.0", ["boost_grant"]),
    ("BSL-1.0", ["boost_distributed"]),
    ("EPL-1.0", ["epl1_terms"]),
    ("EPL-2.0", ["epl2_terms"]),
    ("CC0-1.0", ["cc0_dedicated", "cc0_no_warranty"]),
    ("CC0-1.0", ["cc0_dedicated"]),
    ("WTFPL", ["wtfpl_terms"]),
    ("Artistic-1.0-Perl", ["perl_terms"]),
    *[(v, [k.replace(" ", "_")]) for k, v in STATED.items()],
]
#: A sentence ends at a mark before white space or the end of the text, and at a line break.
ENDS = r"[.!?;:]+([\x20\x09-\x0D]+|$)|[\n\r]+"


def known_tree(sentences: dict[str, str]) -> dict:
    """Words to subtrees; under None, the identifier of the sentence that ends there."""
    tree: dict = {}
    for k, v in sentences.items():
        node = tree
        for word in v.split(" "):
            node = node.setdefault(word, {})
        node[None] = k
    return tree


def known_in(text: str, tree: dict) -> list[str]:
    """The known sentences of a text whose normalised sentences stand on lines. A known one may go over line ends. It starts
    where a line does, or behind another known one; and it ends where a line does, or before another known one.

    One pass from the end to the start finds where known sentences begin that lead to the end of a line; one pass from the
    start takes them. A word costs no more than the longest known sentence has words."""
    words: list[str] = []
    starts = []
    for line in text.split("\n"):
        starts.append(len(words))
        words += line.split(" ")
    first, n, best = set(starts), len(words), {}
    for i in [i for i, word in enumerate(words) if word in tree][::-1]:
        node, j = tree.get(words[i]), i + 1
        while node is not None:
            if None in node and (j == n or j in first or j in best):
                best[i] = j, node[None]  # a longer one comes later
            node = node.get(words[j]) if j < n else None
            j += 1
    out, at = [], 0
    for i in starts if best else ():
        if i >= at:
            at = i
            while at in best and (at == i or at not in first):
                at, known = best[at]
                out.append(known)
    return out


def finder(sentences: dict[str, str]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = known_tree(sentences)
        for texts in batches:
            yield pd.Series([known_in(t, tree) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<string>")


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """Per row of docs: doc_id, n_sentences, sentence_ids (the known ones, in order, comma-joined), licenses (names of
    the rules that match, sorted, comma-joined), n_matches, n_unmatched (known sentences that no rule used).

    A known sentence is one sentence of the text or several in a row that give it when joined, so that hard-wrapped
    lines, blank lines, ';', ':' and "v." inside it do not matter; it starts and ends where sentences do, or where
    another known one ends or starts. Of those that start at one place the longest goes, and the next is sought behind it.

    Sentences that are not known, such as names or titles between the clauses, do not part a rule's sentences. A null
    or empty text has no sentences. Rows stay as they are, with no shuffle. Known sentences are found in time that grows
    with the text, however often they repeat; all else is by Spark's functions."""
    small_batches(docs.sparkSession)
    code = {k: f"{i:03d}" for i, k in enumerate(sentences)}
    marked = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), ENDS, "\n")
    parts = F.transform(F.split(marked, "\n"), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    parts = F.filter(parts, lambda s: s != "")
    base = docs.select("doc_id", parts.alias("s"))
    base = base.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), finder(sentences)(F.array_join("s", "\n")).alias("known"))
    codes = F.create_map(*[F.lit(x) for k, v in code.items() for x in (k, v)])
    line = F.concat_ws("", F.transform("known", lambda k: F.concat(F.lit("<"), codes[k], F.lit(">"))))
    out = base.select("doc_id", "n_sentences", F.concat_ws(",", "known").alias("sentence_ids"), line.alias("line"))
    longer, single = split_rules(rules)
    if longer:
        # a matched run leaves a bar, so that what stood on its two sides does not join
        start = F.struct(F.col("line").alias("rest"), F.array().cast("array<string>").alias("names"), F.lit(0).cast("bigint").alias("n"))

        def use(now, rule):
            rest = F.replace(now["rest"], rule["seq"], F.lit("|"))
            n = ((F.length(now["rest"]) - F.length(rest)) / (F.length(rule["seq"]) - 1)).cast("bigint")
            return F.struct(rest.alias("rest"), F.when(n > 0, F.array_append(now["names"], rule["name"])).otherwise(now["names"]).alias("names"), (now["n"] + n).alias("n"))

        steps = F.array(*[F.struct(F.lit("".join(f"<{code[k]}>" for k in seq)).alias("seq"), F.lit(name).alias("name")) for name, seq in longer])
        used = F.when(F.col("line") == "", start).otherwise(F.aggregate(steps, start, use))
    else:
        used = F.struct(F.col("line").alias("rest"), F.array().cast("array<string>").alias("names"), F.lit(0).cast("bigint").alias("n"))
    out = out.withColumn("used", used)
    alone = F.regexp_extract_all("used.rest", F.lit("<([0-9]+)>"), F.lit(1))
    named = F.create_map(*[F.lit(x) for k, v in single.items() for x in (code[k], v)]) if single else F.create_map().cast("map<string,string>")
    out = out.withColumn("alone", F.transform(alone, lambda c: named[c]))
    known_alone = F.array_compact("alone")
    names = F.array_sort(F.array_distinct(F.concat("used.names", known_alone)))
    n_alone = F.size(known_alone).cast("bigint")
    return out.select("doc_id", "n_sentences", "sentence_ids", F.concat_ws(",", names).alias("licenses"), (F.col("used.n") + n_alone).alias("n_matches"), (F.size("alone") - n_alone).cast("bigint").alias("n_unmatched"))


def split_rules(rules: list[tuple[str, list[str]]]) -> tuple[list[tuple[str, list[str]]], dict[str, str]]:
    """Rules of several sentences, longest first, and the licence of each sentence that is a rule by itself."""
    single: dict[str, str] = {}
    for name, seq in rules:
        if len(seq) == 1:
            single.setdefault(seq[0], name)
    return sorted((r for r in rules if len(r[1]) > 1), key=lambda r: -len(r[1])), single


def scan_sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL for texts whose known sentences are single sentences; SQL does not join runs of them, for which
    the tests have a plain matcher."""
    longer, single = split_rules(RULES)
    code = {k: f"{i:03d}" for i, k in enumerate(SENTENCES)}
    known = ", ".join(f"('{v}', '{k}', '{code[k]}')" for k, v in SENTENCES.items())
    steps, names, counts = [], [], []
    for i, (name, seq) in enumerate(longer):
        pattern = "".join(f"<{code[k]}>" for k in seq)
        steps.append(f"r{i + 1} AS (SELECT *, replace(left{i}, '{pattern}', '|') AS left{i + 1}, CAST((len(left{i}) - len(replace(left{i}, '{pattern}', '|'))) / {len(pattern) - 1} AS BIGINT) AS n{i} FROM r{i})")
        names.append(f"CASE WHEN n{i} > 0 THEN '{name}' END")
        counts.append(f"n{i}")
    n = len(longer)
    alone = ", ".join(f"'{code[k]}': '{v}'" for k, v in single.items())
    return rf"""
WITH known(sentence, id, code) AS (VALUES {known}),
cut AS (
  SELECT doc_id, pos, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s
  FROM (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS pos
        FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '{ENDS}', chr(10), 'g'), chr(10)) AS l FROM {table}))),
seqs AS (
  SELECT doc_id, count(*) AS n_sentences, coalesce(string_agg(id, ',' ORDER BY pos), '') AS sentence_ids,
         coalesce(string_agg('<' || code || '>', '' ORDER BY pos), '') AS left0
  FROM cut LEFT JOIN known ON s = sentence WHERE s <> '' GROUP BY doc_id),
r0 AS (
  SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(left0, '') AS left0
  FROM {table} d LEFT JOIN seqs USING (doc_id)),
{", ".join(steps)},
rest AS (SELECT *, list_transform(regexp_extract_all(left{n}, '<([0-9]+)>', 1), lambda c: MAP {{{alone}}}[c]) AS alone FROM r{n}),
ends AS (SELECT *, list_filter(alone, lambda x: x IS NOT NULL) AS named FROM rest)
SELECT doc_id, n_sentences, sentence_ids,
       array_to_string(list_sort(list_distinct(list_concat(list_filter([{", ".join(names)}], lambda x: x IS NOT NULL), named))), ',') AS licenses,
       {" + ".join(counts)} + len(named) AS n_matches, CAST(len(alone) - len(named) AS BIGINT) AS n_unmatched
FROM ends
"""
