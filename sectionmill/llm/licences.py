"""License scans by sentence rules.

A text's sentences are normalised and mapped to identifiers of known licence sentences; the
sequence of identifiers is matched against ordered rules, each of which names a licence and the
identifiers that must follow one another, with others between them allowed. A rule whose identifiers are a
part of a longer rule's, in order, gives way where the longer one matches. Texts are read
twice: line by line, and with single line ends taken as blanks, since notices are often wrapped. A sentence with a
holder's name in it is known by what stands around the name. A tag line (``SPDX-License-Identifier: ...``) is an expression: each of its licences
is an identifier, whatever joins them (``OR``, ``AND``); an exception (``WITH ...``) isn't a licence; older names count as the newer ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which texts speak of a licence, and its identifier.
NAMES = {
    "MIT License": "MIT", "MIT Licence": "MIT", "Expat License": "MIT", "ISC License": "ISC", "zlib License": "Zlib", "Unlicense": "Unlicense",
    "Apache License 2.0": "Apache-2.0", "Apache License, Version 2.0": "Apache-2.0", "Apache 2.0 License": "Apache-2.0", "Apache-2.0 License": "Apache-2.0",
    "BSD 2-Clause License": "BSD-2-Clause", "Simplified BSD License": "BSD-2-Clause", "BSD 3-Clause License": "BSD-3-Clause", "New BSD License": "BSD-3-Clause", "Modified BSD License": "BSD-3-Clause",
    "GNU General Public License v2.0": "GPL-2.0-only", "GNU General Public License, version 2": "GPL-2.0-only", "GPLv2": "GPL-2.0-only", "GPL-2.0": "GPL-2.0-only",
    "GNU General Public License v3.0": "GPL-3.0-only", "GNU General Public License, version 3": "GPL-3.0-only", "GPLv3": "GPL-3.0-only", "GPL-3.0": "GPL-3.0-only",
    "GNU Lesser General Public License v2.1": "LGPL-2.1-only", "GNU Lesser General Public License, version 2.1": "LGPL-2.1-only", "GNU Lesser General Public License v3.0": "LGPL-3.0-only", "GNU Lesser General Public License, version 3": "LGPL-3.0-only",
    "GNU Affero General Public License v3.0": "AGPL-3.0-only", "GNU Affero General Public License, version 3": "AGPL-3.0-only", "AGPLv3": "AGPL-3.0-only",
    "Mozilla Public License 2.0": "MPL-2.0", "Mozilla Public License, v. 2.0": "MPL-2.0", "MPL 2.0": "MPL-2.0", "Eclipse Public License 2.0": "EPL-2.0", "Eclipse Public License v2.0": "EPL-2.0", "Boost Software License 1.0": "BSL-1.0", "Boost Software License, Version 1.0": "BSL-1.0",
    "Artistic License 2.0": "Artistic-2.0", "European Union Public Licence 1.2": "EUPL-1.2", "Open Software License 3.0": "OSL-3.0", "Academic Free License 3.0": "AFL-3.0", "PostgreSQL License": "PostgreSQL", "Python Software Foundation License": "PSF-2.0", "University of Illinois/NCSA Open Source License": "NCSA",
    "SIL Open Font License 1.1": "OFL-1.1", "Do What The F*ck You Want To Public License": "WTFPL", "CC0 1.0 Universal": "CC0-1.0", "Creative Commons Zero v1.0 Universal": "CC0-1.0",
    "Creative Commons Attribution 4.0 International License": "CC-BY-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License": "CC-BY-ND-4.0",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "CC-BY-NC-SA-4.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License": "CC-BY-SA-3.0", "Creative Commons Attribution 3.0 Unported License": "CC-BY-3.0",
    "CC BY 4.0": "CC-BY-4.0", "CC BY-SA 4.0": "CC-BY-SA-4.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "CC BY-ND 4.0": "CC-BY-ND-4.0", "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0", "CC BY 3.0": "CC-BY-3.0", "CC BY-SA 3.0": "CC-BY-SA-3.0", "CC0": "CC0-1.0",
}
#: The sentences in which a text says its licence; ``{}`` is a name.
PHRASES = [
    "Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "Distributed under the {}.", "Available under the {}.", "License: {}", "Licence: {}", "This work is licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
    "This project is licensed under the {}.", "This software is licensed under the {}.", "This file is licensed under the {}.", "This program is licensed under the {}.", "This code is released under the {}.", "This software is released under the {}.", "The code is available under the {}.",
]
#: Identifiers that tag lines name besides those of ``NAMES``.
TAGS = ["0BSD", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "GPL-2.0+", "GPL-3.0+", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-1.1", "EPL-1.0", "BSD-4-Clause", "CC-BY-2.0", "MIT-0", "MS-PL", "MS-RL", "CDDL-1.0", "Apache-1.1", "X11", "LPPL-1.3c", "UPL-1.0", "BlueOak-1.0.0", "MulanPSL-2.0"]
#: Older identifiers, and those that replaced them.
OLDER = {
    "GPL-1.0": "GPL-1.0-only", "GPL-1.0+": "GPL-1.0-or-later", "GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later",
    "LGPL-2.0": "LGPL-2.0-only", "LGPL-2.0+": "LGPL-2.0-or-later", "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later", "LGPL-3.0": "LGPL-3.0-only", "LGPL-3.0+": "LGPL-3.0-or-later",
    "AGPL-3.0": "AGPL-3.0-only", "AGPL-3.0+": "AGPL-3.0-or-later",
}
#: What sentences with a name or address in them hold, in normal form; the part with the name; and what it is taken for.
NAMED = [
    ("used to endorse", "^neither the names? of .+? nor the names of (?:its|their|any) contributors may be used to endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    ("used to endorse", "^the names? of .+? may not be used to endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    (" at http", " at https? .*$", " at"),
]
#: Identifier and sentence.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-2-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-2-comply": "you may not use this file except in compliance with the License.",
    "apache-2-obtain": "You may obtain a copy of the License at",
    "apache-2-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-notice": "This notice may not be removed or altered from any source distribution.",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "epl-2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl-2-notice-v": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at",
    "epl-1-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
    "lgpl-3-text": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "mpl-2-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl-2-covered": "\"Covered Software\" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof.",
    "gpl-2-of": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "cc0": "This work is dedicated to the public domain.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights": "All rights reserved.",
    "gpl-2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2-free-comma": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "gpl-3-free-semicolon": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "gpl-2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl-2-1-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
}
#: Licence and the sentences that must stand in this order.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("Apache-2.0", ["apache-2-header", "apache-2-comply", "apache-2-obtain", "apache-2-basis"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-received"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD-4-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"]),
    ("Zlib", ["zlib-as-is", "zlib-grant", "zlib-notice"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("PostgreSQL", ["postgresql-grant"]),
    ("EPL-2.0", ["epl-2-notice"]),
    ("EPL-2.0", ["epl-2-notice-v"]),
    ("EPL-1.0", ["epl-1-notice"]),
    ("LGPL-3.0-only", ["lgpl-3-text"]),
    ("MPL-2.0", ["mpl-2-obtain"]),
    ("MPL-2.0", ["mpl-2-covered"]),
    ("GPL-2.0-only", ["gpl-2-of"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("all-rights-reserved", ["all-rights"]),
    ("GPL-2.0-or-later", ["gpl-2-free"]),
    ("GPL-2.0-or-later", ["gpl-2-free-comma"]),
    ("GPL-3.0-or-later", ["gpl-3-free-semicolon"]),
    ("GPL-2.0-only", ["gpl-2-only"]),
    ("LGPL-2.1-or-later", ["lgpl-2-1-free"]),
    ("LGPL-3.0-or-later", ["lgpl-3-free"]),
    ("AGPL-3.0-or-later", ["agpl-3-free"]),
    ("MPL-2.0", ["mpl-2-header"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-and"]),
    ("0BSD", ["0bsd-grant"]),
]
_STOP = r"[.!?:;]+(?:[ \t\r\n]+|$)|\n+"
#: The expression of a tag line, what parts its licences, and a licence's identifier.
_TAG, _JOINS, _ID = r"(?i)SPDX-License-Identifier:[ \t]*([^\n]*)", r"(?i)[ \t()]+(?:or|and)[ \t()]+", r"^[ \t(]*([A-Za-z0-9.+-]*[A-Za-z0-9+])"


def normal(sentence: str) -> str:
    """The same normal form as :func:`identifiers` gives a text's sentences."""
    import re

    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def cut(sentences: dict[str, str], rules: list[tuple[str, list[str]]]) -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """The tables with each sentence cut at its stops as texts are.

    Each part has an identifier of its own, the first one that of the sentence; a part that an earlier
    sentence also has keeps the identifier from there. Tables that are cut already stay as they are.
    """
    import re

    parts, names, made = {}, {}, {}
    for name, sentence in sentences.items():
        ends = [0, *(m.end() for m in re.finditer(_STOP, sentence)), len(sentence)]
        found = [p for p in (sentence[a:b].strip() for a, b in zip(ends, ends[1:], strict=False)) if normal(p)]
        for i, part in enumerate(found):
            key = normal(part)
            if key not in made:
                made[key] = name if i == 0 else f"{name}-{i + 1}"
                parts[made[key]] = part
            names.setdefault(name, []).append(made[key])
    return parts, [(licence, [part for name in wanted for part in names.get(name, [name])]) for licence, wanted in rules]


def tables() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """All sentences and rules: those written out, every phrase with every name, and the tag lines."""
    sentences, rules = dict(SENTENCES), list(RULES)
    for i, (name, licence) in enumerate(NAMES.items()):
        for j, phrase in enumerate(PHRASES):
            sentences[f"said-{i}-{j}"] = phrase.format(name)
            rules.append((licence, [f"said-{i}-{j}"]))
    rules += [(licence, [name]) for name, licence in tag_identifiers().items()]
    return cut(sentences, rules)


def tag_identifiers() -> dict[str, str]:
    """The identifier of each licence that tag lines name, and the licence."""
    return {f"tag-{licence}": licence for licence in dict.fromkeys([*NAMES.values(), *(OLDER.get(t, t) for t in TAGS), *OLDER.values()])}


def _tag_table() -> dict[str, str]:
    """What tag lines may say, in lower case, to identifiers."""
    return {licence.lower(): name for name, licence in tag_identifiers().items()} | {old.lower(): f"tag-{new}" for old, new in OLDER.items()}


SENTENCES, RULES = tables()


def _within(short: list[str], long: list[str]) -> bool:
    left = iter(long)
    return len(short) < len(long) and all(x in left for x in short)


def split_rules(rules: list[tuple[str, list[str]]]) -> tuple[dict[str, int], list[tuple[int, list[str], list[int]]]]:
    """Rules of one identifier as a table to their number, and those of more as (number, identifiers, longer): the
    places of rules before which one gives way."""
    number = {licence: i for i, licence in enumerate(dict.fromkeys(licence for licence, _ in rules))}
    many = list({tuple(names): number[licence] for licence, names in rules if len(names) > 1}.items())
    one = {names[0]: number[licence] for licence, names in reversed(rules) if len(names) == 1}
    return one, [(n, list(names), [j for j, (other, _) in enumerate(many) if _within(list(names), list(other))]) for names, n in many]


def identifiers(text: Column, sentences: dict[str, str]) -> Column:
    """The known sentences of a text, in order, as an array of identifiers.

    ``sentences`` are as :func:`cut` gives them: one with a stop inside is several here, as it is in a
    text. Stops are taken only where a blank or the end follows.
    """
    known = {normal(s): name for name, s in sentences.items()}

    def named(s: Column) -> Column:
        out = s
        for holds, pattern, to in NAMED:
            out = F.when(F.contains(s, F.lit(holds)) & s.rlike(pattern), F.regexp_replace(s, pattern, to)).otherwise(out)
        return out

    # Two steps, so that a sentence's normal form is worked out once and not wherever a pattern looks at it.
    said = F.transform(F.split(text, _STOP), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    said = F.transform(said, named)
    found = F.filter(said, lambda s: s.isin(*known))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.transform(found, lambda s: F.element_at(table, s))


def tags(text: Column) -> Column:
    """The identifiers of the licences that a text's tag lines name, in order."""
    known = _tag_table()
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_TAG), F.lit(1)), lambda e: F.split(e, _JOINS)))
    said = F.transform(parts, lambda x: F.lower(F.regexp_extract(x, _ID, 1)))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found = F.transform(F.filter(said, lambda x: x.isin(*known)), lambda x: F.element_at(table, x))
    return F.when(F.contains(F.lower(text), F.lit("spdx-license-identifier")), found).otherwise(F.array().cast("array<string>"))


def _follows(sequence: Column, names: list[str]) -> Column:
    return sequence.rlike(r"\|" + r"\|(?:.*\|)?".join(names) + r"\|")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(id, sentence_ids, licences) for every row: two strings, comma-joined, empty if none. Identifiers of tag lines come after those of sentences.

    ``licences`` are in the order of the rules, each once. A null or empty text has none; repeated rows and
    null ids, of any type, are scanned like others, very long texts whole. An empty table gives no rows. Columns other than the two named aren't read.
    """
    sentences, rules = cut(sentences or SENTENCES, rules or RULES)
    one, many = split_rules(rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = docs.select(
        F.col(id_col).alias("id"), identifiers(text, sentences).alias("by_line"),
        identifiers(F.regexp_replace(text, r"([^\n])\n([^\n])", "$1 $2"), sentences).alias("unwrapped"), tags(text).alias("tags"),
    )
    joined = lambda c: F.concat(F.lit("|"), F.array_join(c, "|"), F.lit("|"))
    hits = [_follows(joined("by_line"), names) | _follows(joined("unwrapped"), names) for _, names, _ in many]
    wins = []
    for i, (n, _, longer) in enumerate(many):
        won = hits[i]
        for j in longer:
            won &= ~hits[j]
        wins.append(F.when(won, F.lit(n)))
    table = F.create_map(*[F.lit(x) for pair in one.items() for x in pair])
    single = F.transform(F.filter(F.concat("by_line", "unwrapped", "tags"), lambda x: x.isin(*one)), lambda x: F.element_at(table, x))
    names = F.array(*[F.lit(x) for x in dict.fromkeys(licence for licence, _ in rules)])
    numbers = F.array_sort(F.array_distinct(F.concat(single, F.array_compact(F.array(*wins)))))
    # Most texts have no known sentence, and no rule is tried on them.
    licences = F.when(F.size("by_line") + F.size("unwrapped") + F.size("tags") == 0, "").otherwise(F.array_join(F.transform(numbers, lambda n: F.get(names, n)), ","))
    ids = F.concat(F.when(F.size("unwrapped") > F.size("by_line"), F.col("unwrapped")).otherwise(F.col("by_line")), F.col("tags"))
    return seen.select(F.col("id").alias(id_col), F.array_join(ids, ",").alias("sentence_ids"), licences.alias("licences"))


def _oracle() -> str:
    known = {normal(s): name for name, s in SENTENCES.items()}
    one, many = split_rules(RULES)
    made = lambda pairs: "MAP {" + ", ".join(f"'{k}': {v}" for k, v in pairs) + "}"
    stop = _STOP.replace(r"\n", "' || chr(10) || '").replace(r"\t", "' || chr(9) || '").replace(r"\r", "' || chr(13) || '")
    form = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
    plain = form
    for holds, pattern, to in NAMED:
        form = f"CASE WHEN contains({plain}, '{holds}') AND regexp_matches({plain}, '{pattern}') THEN regexp_replace({plain}, '{pattern}', '{to}') ELSE {form} END"
    ids = lambda t: f"list_filter(list_transform(regexp_split_to_array({t}, '{stop}'), lambda s: m[{form}]), lambda x: x IS NOT NULL)"
    says = f"flatten(list_transform(regexp_extract_all(text, '{_TAG}', 1), lambda e: regexp_split_to_array(e, '{_JOINS}')))"
    tags_ = f"list_filter(list_transform({says}, lambda x: g[lower(regexp_extract(x, '{_ID}', 1))]), lambda x: x IS NOT NULL)"
    follows = lambda names: "(" + " OR ".join(f"regexp_matches('|' || coalesce(array_to_string({c}, '|'), '') || '|', '\\|" + r"\|(?:.*\|)?".join(names) + r"\|')" for c in ("a", "b")) + ")"
    hits = ", ".join(f"{follows(names)} AS h{i}" for i, (_, names, _) in enumerate(many))
    wins = ", ".join("CASE WHEN " + " AND ".join([f"h{i}", *(f"NOT h{j}" for j in longer)]) + f" THEN {n} END" for i, (n, _, longer) in enumerate(many))
    licences = ", ".join(f"'{x}'" for x in dict.fromkeys(licence for licence, _ in RULES))
    return f"""
WITH known_ AS MATERIALIZED (SELECT {made((k, f"'{v}'") for k, v in known.items())} AS m, {made(one.items())} AS o, {made((k, f"'{v}'") for k, v in _tag_table().items())} AS g),
t AS (SELECT doc_id, coalesce(text, '') AS text, m, o, g FROM documents, known_),
s AS (SELECT doc_id, o, {tags_} AS t, {ids("text")} AS a, {ids("regexp_replace(text, '([^' || chr(10) || '])' || chr(10) || '([^' || chr(10) || '])', '\1 \2', 'g')")} AS b FROM t),
h AS (SELECT *, {hits} FROM s),
n AS (SELECT *, list_sort(list_distinct(list_filter(list_concat(list_transform(list_concat(list_concat(a, b), t), lambda x: o[x]), [{wins}]), lambda x: x IS NOT NULL))) AS numbers FROM h)
SELECT doc_id, coalesce(array_to_string(list_concat(CASE WHEN len(b) > len(a) THEN b ELSE a END, t), ','), '') AS sentence_ids,
  coalesce(array_to_string(list_transform(numbers, lambda i: ([{licences}])[i + 1]), ','), '') AS licences FROM n
"""


ORACLE = _oracle()
