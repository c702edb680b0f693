"""Licence scans by sentence recognition and ordered rules, in built-in functions alone.

A text is reduced to lower-case letters, digits and single blanks; sentences end at ``.!?`` before white space or
at an empty line.  A sentence is looked up among known licence sentences; where the whole is not known, the longest
known runs of its consecutive lines are taken instead, ``MOST_LINES`` lines at most and none that begins inside an
earlier one, so a heading or list mark that shares the paragraph does not hide a wrapped sentence.  The identifiers found, in their order in the text, form a sequence; a rule is an ordered list of
identifiers and matches where they follow each other in that sequence.  Longer rules match first and use up
what they match.

The catalogue holds notices, SPDX lines and headers of MIT, BSD, ISC, Apache, Boost, the Unlicense, CC0, Creative
Commons 4.0, GPL, LGPL, AGPL, MPL, EPL and CDDL, and reserved rights; whole licence texts only of the short ones.

Null and empty texts have no sentences and no licences.  Rows are independent: ties, repeated rows and extra
columns need no special care.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and of their usual notices.
SENTENCES = {
    "mit-notice": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.",
                   "Distributed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
                  "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "mit-condition": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "as-is": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",),
    "apache-notice": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.",
                      "Licensed under the Apache License, Version 2.0 (the \"License\");", "SPDX-License-Identifier: Apache-2.0"),
    "apache-header": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",),
    "apache-copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                    "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "apache-basis": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-names": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "gpl3-notice": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.",
                    "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "gpl2-notice": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.",
                    "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "gpl3-terms": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "gpl2-terms": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "gpl-hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "lgpl3-notice": ("Licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU Lesser General Public License, version 3.",
                     "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "lgpl21-notice": ("Licensed under the GNU Lesser General Public License, version 2.1.", "This work is licensed under the GNU Lesser General Public License, version 2.1.",
                      "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "lgpl3-terms": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "lgpl21-terms": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "lgpl-hope": ("This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "agpl3-notice": ("Licensed under the GNU Affero General Public License, version 3.", "This work is licensed under the GNU Affero General Public License, version 3.",
                     "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "agpl3-terms": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "epl-terms": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html",
                  "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
                  "SPDX-License-Identifier: EPL-2.0"),
    "cddl-terms": ("The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").", "SPDX-License-Identifier: CDDL-1.0"),
    "bsl-notice": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "bsd3-notice": ("Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "bsd2-notice": ("Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "isc-notice": ("Licensed under the ISC License.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "mpl-terms": ("This Source Code Form is subject to the terms of the Mozilla Public License, v.", "SPDX-License-Identifier: MPL-2.0"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("SPDX-License-Identifier: CC0-1.0", "This work has been dedicated to the public domain."),
    "reserved": ("All rights reserved.",),
}
# Licence, kind and the ordered sentences of each rule.
RULES = (
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("MIT", "permissive", ("mit-grant", "mit-condition", "as-is")),
    ("Apache-2.0", "permissive", ("apache-header", "apache-copy", "apache-basis")),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", "permissive", ("mit-grant", "mit-condition")),
    ("MIT", "permissive", ("mit-grant", "as-is")),
    ("Apache-2.0", "permissive", ("apache-header", "apache-copy")),
    ("ISC", "permissive", ("isc-grant", "as-is")),
    ("GPL-3.0", "copyleft", ("gpl3-terms", "gpl-hope")),
    ("GPL-2.0", "copyleft", ("gpl2-terms", "gpl-hope")),
    ("LGPL-3.0", "copyleft", ("lgpl3-terms", "lgpl-hope")),
    ("LGPL-2.1", "copyleft", ("lgpl21-terms", "lgpl-hope")),
    ("AGPL-3.0", "copyleft", ("agpl3-terms", "gpl-hope")),
    ("MIT", "permissive", ("mit-grant",)),
    ("MIT", "permissive", ("mit-notice",)),
    ("Apache-2.0", "permissive", ("apache-header",)),
    ("Apache-2.0", "permissive", ("apache-notice",)),
    ("ISC", "permissive", ("isc-grant",)),
    ("GPL-3.0", "copyleft", ("gpl3-terms",)),
    ("GPL-3.0", "copyleft", ("gpl3-notice",)),
    ("GPL-2.0", "copyleft", ("gpl2-terms",)),
    ("GPL-2.0", "copyleft", ("gpl2-notice",)),
    ("LGPL-3.0", "copyleft", ("lgpl3-terms",)),
    ("LGPL-3.0", "copyleft", ("lgpl3-notice",)),
    ("LGPL-2.1", "copyleft", ("lgpl21-terms",)),
    ("LGPL-2.1", "copyleft", ("lgpl21-notice",)),
    ("AGPL-3.0", "copyleft", ("agpl3-terms",)),
    ("AGPL-3.0", "copyleft", ("agpl3-notice",)),
    ("EPL-2.0", "copyleft", ("epl-terms",)),
    ("CDDL-1.0", "copyleft", ("cddl-terms",)),
    ("BSL-1.0", "permissive", ("bsl-notice",)),
    ("Unlicense", "permissive", ("unlicense",)),
    ("BSD-3-Clause", "permissive", ("bsd3-notice",)),
    ("BSD-2-Clause", "permissive", ("bsd2-notice",)),
    ("ISC", "permissive", ("isc-notice",)),
    ("MPL-2.0", "copyleft", ("mpl-terms",)),
    ("CC-BY-4.0", "permissive", ("cc-by",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", "non-commercial", ("cc-by-nc",)),
    ("CC0-1.0", "permissive", ("cc0",)),
    ("Proprietary", "reserved", ("reserved",)),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END, LINE = "\x01", "\x02"
# Each step is (pattern, replacement) in the syntax that both Java and RE2 read.
STEPS = (
    (r"[\x01\x02]", " "),
    (r"([.!?])[ \t\r\n\f]+", END),
    (r"\n", LINE),
    (r"[^a-z0-9\x01\x02]+", " "),
    (r" ?\x02 ?", LINE),
    (r"\x02\x02+", END),
    (r"[ \x02]*\x01[ \x02]*", END),
)


def normal(sentence: str) -> str:
    """A sentence in the form in which texts are compared."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


KNOWN = {normal(s): name for name, forms in SENTENCES.items() for s in forms}
STARTS = sorted({sentence.split()[0] for sentence in KNOWN})
MOST_LINES = 24


def reduced(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for pattern, replacement in STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def _runs(lines: Column, known: Column) -> Column:
    """The longest known run of consecutive lines from each line that may begin one: ``id, i, j``."""
    size = F.size(lines)

    def longest(i: Column) -> Column:
        runs = F.transform(
            F.sequence(i, F.least(size, i + MOST_LINES) - 1),
            lambda j: F.struct(F.element_at(known, F.array_join(F.slice(lines, i + 1, j - i + 1), " ")).alias("id"), i.alias("i"), j.alias("j")),
        )
        return F.try_element_at(F.filter(runs, lambda r: r["id"].isNotNull()), F.lit(-1))

    starts = F.filter(
        F.sequence(F.lit(0), size - 1), lambda i: F.substring_index(F.get(lines, i), " ", 1).isin(*STARTS)
    )
    return F.filter(F.transform(starts, longest), lambda r: r.isNotNull())


def _found(sentence: Column, known: Column) -> Column:
    """The identifier of a sentence, or else those of runs of its lines."""
    whole = F.element_at(known, F.replace(sentence, F.lit(LINE), F.lit(" ")))
    runs = F.flatten(F.transform(F.array(F.split(sentence, LINE)), lambda lines: _runs(lines, known)))
    kept = F.flatten(
        F.transform(
            F.array(runs),
            lambda all_: F.transform(
                F.filter(all_, lambda r: ~F.exists(all_, lambda o: (o["i"] < r["i"]) & (o["j"] >= r["i"]))), lambda r: r["id"]
            ),
        )
    )
    none = F.array().cast("array<string>")
    return F.when(whole.isNotNull(), F.array(whole)).when(F.contains(sentence, F.lit(LINE)), kept).otherwise(none)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    return F.flatten(F.transform(F.split(reduced(text), END), lambda s: _found(s, known)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``n_known``, ``sequence``, ``licences`` and ``kinds`` (sorted, distinct, joined by commas)."""
    # The identifiers leave through a one-row generator, so they are computed once for all rules.
    out = docs.withColumn("_gw_ids", F.explode(F.array(sentence_ids(F.col(text)))))
    sequence = F.concat_ws(",", "_gw_ids")
    left = F.concat(F.lit(","), F.replace(sequence, F.lit(","), F.lit(",,")), F.lit(","))
    out = out.withColumn("_gw_left", F.explode(F.array(left)))
    left, hits = F.col("_gw_left"), []
    for licence, kind, ids in RULES:
        wanted = F.lit("".join(f",{i}," for i in ids))
        hits.append(F.when(F.contains(left, wanted), F.struct(F.lit(licence).alias("l"), F.lit(kind).alias("k"))))
        left = F.replace(left, wanted, F.lit(";"))
    matched = F.when(F.size("_gw_ids") > 0, F.filter(F.array(*hits), lambda h: h.isNotNull()))
    out = out.withColumn("_gw_hits", F.explode(F.array(matched)))
    joined = {name: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.col("_gw_hits")[field])), ","), F.lit(""))
              for name, field in (("licences", "l"), ("kinds", "k"))}
    return (
        out.withColumns({"n_known": F.size("_gw_ids").cast("bigint"), "sequence": sequence} | joined)
        .drop("_gw_ids", "_gw_left", "_gw_hits")
    )


def oracle() -> str:
    """DuckDB SQL for ``doc_id, n_known, sequence, licences, kinds`` of all documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    mark = lambda s: s.replace(END, "' || chr(1) || '").replace(LINE, "' || chr(2) || '")
    text = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    for pattern, replacement in STEPS:
        text = f"regexp_replace({text}, '{pattern}', ('{mark(replacement)}'), 'g')"
    known = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in KNOWN.items()) + "}"
    starts = "[" + ", ".join(map(quote, STARTS)) + "]"
    runs = (
        f"list_filter(list_transform(list_filter(range(0, len(l)), lambda i: list_contains({starts}, string_split(l[i + 1], ' ')[1])), lambda i: "
        f"list_filter(list_transform(range(i, least(len(l), i + {MOST_LINES})), lambda j: "
        "{'id': m[array_to_string(l[i + 1:j + 1], ' ')], 'i': i, 'j': j}), lambda r: r.id IS NOT NULL)[-1]), lambda r: r IS NOT NULL)"
    )
    left = "CASE WHEN len(ids) = 0 THEN ',,' ELSE ',' || array_to_string(ids, ',,') || ',' END"
    steps, hits = [f"s0 AS (SELECT *, {left} AS r0 FROM found)"], []
    for k, (licence, kind, ids) in enumerate(RULES):
        wanted = quote("".join(f",{i}," for i in ids))
        steps.append(
            f"s{k + 1} AS (SELECT * EXCLUDE (r{k}), replace(r{k}, {wanted}, ';') AS r{k + 1}, "
            f"contains(r{k}, {wanted}) AS h{k} FROM s{k})"
        )
        hits.append((k, licence, kind))
    pick = lambda i: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(
        f"CASE WHEN h{h[0]} THEN {quote(h[i])} END" for h in hits) + "], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH texts AS (SELECT doc_id, trim({text}, ' ') AS t FROM documents),
known AS (SELECT {known} AS m),
found AS (
  SELECT doc_id, flatten(list_transform(string_split(t, chr(1)), lambda s:
    CASE WHEN m[replace(s, chr(2), ' ')] IS NOT NULL THEN [m[replace(s, chr(2), ' ')]]
    WHEN NOT contains(s, chr(2)) THEN []
    ELSE list_transform([list_transform([string_split(s, chr(2))], lambda l: {runs})[1]], lambda q:
      list_transform(list_filter(q, lambda r: len(list_filter(q, lambda o: o.i < r.i AND o.j >= r.i)) = 0), lambda r: r.id))[1] END)) AS ids
  FROM texts, known),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ',') AS sequence,
  {pick(1)} AS licences, {pick(2)} AS kinds
FROM s{len(RULES)}"""
