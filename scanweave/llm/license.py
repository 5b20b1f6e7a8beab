"""Licence scans by sentence rules (operator 8), in DataFrame functions only.

A text is cut into sentences twice: at sentence ends and blank lines, for wrapped paragraphs, and at every line end too,
for notices that stand alone in a line. Normalised sentences (lower case, runs of other characters than a-z and 0-9 made
one blank) are mapped to the identifiers of known licence sentences. What is left is a short sequence of identifiers, in
which ordered rules are looked for: a rule is a run of identifiers, with only unknown sentences between them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence sentences as their texts have them; a place in the list, from 1, is the identifier.
SENTENCES = (
    "Released under the MIT License",
    "Licensed under the Apache License, Version 2.0",
    "This work is licensed under the GNU General Public License, version 3",
    "Licensed under CC BY-NC 4.0",
    "MIT License",
    "The MIT License (MIT)",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "you may not use this file except in compliance with the License",
    "You may obtain a copy of the License at",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "See the License for the specific language governing permissions and limitations under the License",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "This program is free software",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "either version 2 of the License, or (at your option) any later version",
    "either version 3 of the License, or (at your option) any later version",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "See the GNU General Public License for more details",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "This is free and unencumbered software released into the public domain",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "This library is free software",
    "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "either version 2.1 of the License, or (at your option) any later version",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "This software is provided 'as-is', without any express or implied warranty",
    "In no event will the authors be held liable for any damages arising from the use of this software",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "Distributed under the Boost Software License, Version 1.0",
    "Boost Software License - Version 1.0",
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "SPDX-License-Identifier",
    "MIT",
    "Apache-2.0",
    "BSD-2-Clause",
    "BSD-3-Clause",
    "GPL-2.0-only",
    "GPL-2.0-or-later",
    "GPL-3.0-only",
    "GPL-3.0-or-later",
    "LGPL-2.1-or-later",
    "LGPL-3.0-or-later",
    "AGPL-3.0-or-later",
    "MPL-2.0",
    "ISC",
    "Zlib",
    "BSL-1.0",
    "CC0-1.0",
    "EPL-2.0",
    "Unlicense",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    "Licensed under the BSD 3-Clause License",
    "Licensed under the BSD 2-Clause License",
    "Licensed under the Mozilla Public License 2.0",
    "Licensed under the ISC License",
)
#: A licence and the identifiers that show it, in this order.
RULES = (
    ("MIT", (1,)),
    ("MIT", (5, 7)),
    ("MIT", (6, 7)),
    ("MIT", (7, 8)),
    ("MIT", (7, 8, 9)),
    ("Apache-2.0", (2,)),
    ("Apache-2.0", (10, 11)),
    ("Apache-2.0", (10, 11, 12, 13, 14)),
    ("GPL-3.0-or-later", (15,)),
    ("GPL-3.0-or-later", (16, 17, 19)),
    ("GPL-2.0-or-later", (16, 17, 18)),
    ("GPL-3.0", (3,)),
    ("BSD-3-Clause", (23, 24, 25, 30)),
    ("BSD-2-Clause", (23, 24, 25)),
    ("CC-BY-NC-4.0", (4,)),
    ("CC-BY-NC-4.0", (28,)),
    ("CC-BY-4.0", (26,)),
    ("CC-BY-SA-4.0", (27,)),
    ("Unlicense", (29,)),
    ("LGPL-3.0-or-later", (32,)),
    ("LGPL-3.0-or-later", (31, 33, 19)),
    ("LGPL-2.1-or-later", (31, 33, 34)),
    ("LGPL-3.0-or-later", (31, 68)),
    ("LGPL-2.1-or-later", (31, 69)),
    ("AGPL-3.0-or-later", (16, 35)),
    ("AGPL-3.0-or-later", (16, 36, 19)),
    ("GPL-3.0-or-later", (16, 66)),
    ("GPL-2.0-or-later", (16, 67)),
    ("MPL-2.0", (37,)),
    ("MPL-2.0", (38,)),
    ("ISC", (39,)),
    ("Zlib", (40, 41, 42)),
    ("BSL-1.0", (43,)),
    ("BSL-1.0", (44,)),
    ("CC0-1.0", (45,)),
    ("EPL-2.0", (46,)),
    ("MIT", (47, 48)),
    ("Apache-2.0", (47, 49)),
    ("BSD-2-Clause", (47, 50)),
    ("BSD-3-Clause", (47, 51)),
    ("GPL-2.0-only", (47, 52)),
    ("GPL-2.0-or-later", (47, 53)),
    ("GPL-3.0-only", (47, 54)),
    ("GPL-3.0-or-later", (47, 55)),
    ("LGPL-2.1-or-later", (47, 56)),
    ("LGPL-3.0-or-later", (47, 57)),
    ("AGPL-3.0-or-later", (47, 58)),
    ("MPL-2.0", (47, 59)),
    ("ISC", (47, 60)),
    ("Zlib", (47, 61)),
    ("BSL-1.0", (47, 62)),
    ("CC0-1.0", (47, 63)),
    ("EPL-2.0", (47, 64)),
    ("Unlicense", (47, 65)),
    ("BSD-3-Clause", (70,)),
    ("BSD-2-Clause", (71,)),
    ("MPL-2.0", (72,)),
    ("ISC", (73,)),
)
AT_ENDS = r"[.!?;:]+[ \t\r\n]+|\n[ \t\r]*\n"
AT_LINES = r"[.!?;:]+[ \t\r\n]+|\n"


def normal(x: str) -> str:
    return re.sub("[^a-z0-9]+", " ", x.lower()).strip(" ")


def _identifiers(text: Column, pattern: str, known: Column) -> Column:
    """The identifiers of the known sentences in a text, in order."""
    sentences = F.transform(F.split(F.lower(text), pattern, -1), lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " ")))
    return F.filter(F.transform(sentences, lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull())


def _ordered(rules: tuple) -> list[tuple[str, str]]:
    """Names and runs, the longest first, then as given. Each identifier stands between two commas of its own."""
    return [(name, "".join(f",{i}," for i in ids)) for name, ids in sorted(rules, key=lambda r: -len(r[1]))]


def license_scan(docs: DataFrame, sentences: tuple = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses per row of docs (doc_id, text).

    sentence_ids are the identifiers found by line, in order, and licenses the distinct names of the matching rules in
    ascending order, both joined by commas and empty if there are none; n_sentences counts the identifiers. Null or empty
    text has none. A long text is cut into sentences whole, in one row of one task. Repeated rows get equal results. Other
    columns are not read, whatever their names. Empty table: no rows.
    """
    known = F.create_map(*[F.lit(x) for i, s in reversed([*{normal(s): (i, normal(s)) for i, s in enumerate(sentences, 1)}.values()]) for x in (s, i)])
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", _identifiers(text, AT_ENDS, known).alias("by_end"), _identifiers(text, AT_LINES, known).alias("by_line"))
    wrapped = lambda c: F.array_join(F.transform(F.col(c), lambda x: F.concat(F.lit(","), x.cast("string"), F.lit(","))), "")
    found = found.select("doc_id", F.size("by_line").cast("long").alias("n_sentences"), F.concat_ws(",", F.col("by_line").cast("array<string>")).alias("sentence_ids"), F.concat(wrapped("by_end"), F.lit(";"), wrapped("by_line")).alias("both"))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(run).alias("run")) for name, run in _ordered(rules)])
    start = F.struct(F.col("both").alias("rest"), F.array().cast("array<string>").alias("names"))

    def used(so_far: Column, rule: Column) -> Column:
        hit = so_far["rest"].contains(rule["run"])
        rest = F.when(hit, F.replace(so_far["rest"], rule["run"], F.lit(";"))).otherwise(so_far["rest"])
        return F.struct(rest.alias("rest"), F.when(hit, F.array_append(so_far["names"], rule["name"])).otherwise(so_far["names"]).alias("names"))

    names = F.when(F.col("both") == ";", F.array().cast("array<string>")).otherwise(F.aggregate(table, start, used, lambda x: x["names"]))
    return found.select("doc_id", "n_sentences", "sentence_ids", F.concat_ws(",", F.array_sort(F.array_distinct(names))).alias("licenses"))


def license_sql(sentences: tuple = SENTENCES, rules: tuple = RULES) -> str:
    """The same in DuckDB SQL."""
    values = ", ".join("('{}', {})".format(s.replace("'", "''"), i) for i, s in {normal(s): (i, normal(s)) for i, s in enumerate(sentences, 1)}.values())
    ordered = _ordered(rules)
    steps = ", ".join(f"replace(rest_{k}, '{run}', ';') as rest_{k + 1}" for k, (_, run) in enumerate(ordered))
    hits = ", ".join(f"case when contains(rest_{k}, '{run}') then '{name}' end" for k, (name, run) in enumerate(ordered))

    def identifiers(pattern: str) -> str:
        escaped = pattern.replace("\\t", "' || chr(9) || '").replace("\\r", "' || chr(13) || '").replace("\\n", "' || chr(10) || '")
        return f"""select doc, string_agg(cast(id as varchar), ',' order by pos) as ids, string_agg(',' || id || ',', '' order by pos) as wrapped, count(*) as n
            from (select doc, pos, trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g'), ' ') as s
                  from (select doc, unnest(parts) as part, generate_subscripts(parts, 1) as pos from (select doc, string_split_regex(lower(coalesce(text, '')), '{escaped}') as parts from rows)))
            join known using (s) group by doc"""

    return f"""with rows as (select row_number() over () as doc, doc_id, text from documents),
        known as (select s, id from (values {values}) t(s, id)),
        by_end as ({identifiers(AT_ENDS)}),
        by_line as ({identifiers(AT_LINES)}),
        found as (select r.doc, r.doc_id, coalesce(l.n, 0) as n_sentences, coalesce(l.ids, '') as sentence_ids, coalesce(e.wrapped, '') || ';' || coalesce(l.wrapped, '') as rest_0
                  from rows r left join by_line l using (doc) left join by_end e using (doc)),
        used as (select *, {steps} from found)
        select doc_id, cast(n_sentences as bigint) as n_sentences, sentence_ids, coalesce(array_to_string(list_sort(list_distinct([{hits}])), ','), '') as licenses from used"""
