"""License scans by sentence rules: the normalised sentences of a text are looked up in a table of known
licence sentences, and the sequence of the identifiers found is matched against ordered rules.

A sentence begins at the text's, behind a full stop and white space (but not that of "v. 2"), behind a line
without words, and at every line, as the line before may lack its full stop; it runs over line ends up to
the next full stop or line without words. Normalised, it is lower case with every run of other characters
than a-z, 0-9 and + as one space, so signs of comments vanish, and without what stands before its first
telling word: a list number or letter, and "this file is" with any one word for file. Known sentences are
looked up by their words, exactly and the longest first; they are the beginnings of a licence's sentences up
to where names or wordings begin to differ. So a look-up costs the same however many sentences are known.

Rules are tried in order, longest first. A match consumes its part of the sequence and leaves a border, so a
sentence counts for one licence only and what stood on both sides of a match is never taken as neighbours.
What no rule takes is reported as unmatched.

The SQL of `oracle` cuts at every line end (END); both agree on texts whose known sentences have a line each.

Native: DataFrame functions only, row by row, no shuffle.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, unpacked

# Beginnings of normalised sentences of public licences, and their identifiers.
SENTENCES = [
    ("licensed under the gnu general public license version 3", "GPL3Ref"),
    ("licensed under the gnu general public license version 2", "GPL2Ref"),
    ("licensed under the gnu lesser general public license version 3", "LGPL3Ref"),
    ("licensed under the gnu lesser general public license version 2 1", "LGPL21Ref"),
    ("licensed under the gnu affero general public license version 3", "AGPL3Ref"),
    ("licensed under the apache license version 2 0", "Apache2Ref"),
    ("licensed under the apache license 2 0", "Apache2Ref"),
    ("released under the apache license version 2 0", "Apache2Ref"),
    ("distributed under the apache license version 2 0", "Apache2Ref"),
    ("released under the mit license", "MITRef"),
    ("licensed under the mit license", "MITRef"),
    ("distributed under the mit license", "MITRef"),
    ("licensed under the bsd 2 clause license", "BSD2Ref"),
    ("licensed under the bsd 3 clause license", "BSD3Ref"),
    ("released under the bsd 2 clause license", "BSD2Ref"),
    ("released under the bsd 3 clause license", "BSD3Ref"),
    ("licensed under the mozilla public license version 2 0", "MPL2Ref"),
    ("licensed under the eclipse public license version 2 0", "EPL2Ref"),
    ("licensed under the boost software license version 1 0", "BSL1Ref"),
    ("distributed under the boost software license version 1 0", "BSL1Ref"),
    ("licensed under cc by nc nd 4 0", "CCBYNCND4Ref"),
    ("licensed under cc by nc sa 4 0", "CCBYNCSA4Ref"),
    ("licensed under cc by nc 4 0", "CCBYNC4Ref"),
    ("licensed under cc by nd 4 0", "CCBYND4Ref"),
    ("licensed under cc by sa 4 0", "CCBYSA4Ref"),
    ("licensed under cc by 4 0", "CCBY4Ref"),
    ("licensed under a creative commons attribution 4 0 international license", "CCBY4Ref"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "CCBYSA4Ref"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "CCBYNC4Ref"),
    ("released under cc0", "CC0Ref"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "MITPermission"),
    ("the above copyright notice and this permission notice shall be included in all copies", "MITNotice"),
    ("the software is provided as is without warranty of any kind", "NoWarrantyMIT"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy", "BSL1Permission"),
    ("permission to use copy modify and or distribute this software for any purpose", "ISCPermission"),
    ("permission to use copy modify and distribute this software for any purpose", "ISCPermission"),
    ("the software is provided as is and the author disclaims all warranties", "NoWarrantyISC"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "BSDPermission"),
    ("redistributions of source code must retain the above copyright notice", "BSDSource"),
    ("redistributions in binary form must reproduce the above copyright notice", "BSDBinary"),
    ("all advertising materials mentioning features or use of this software must display", "BSDAdvertising"),
    ("neither the name of", "BSDEndorse"),
    ("this software is provided by the copyright holders and contributors as is", "NoWarrantyBSD"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "GPLPermission"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "LGPLPermission"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "AGPLPermission"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "GPL3Later"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "GPL2Later"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "AGPL3Later"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "LGPL3Later"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "LGPL21Later"),
    ("either version 3 of the license or at your option any later version", "Version3OrLater"),
    ("either version 2 of the license or at your option any later version", "Version2OrLater"),
    ("this program is distributed in the hope that it will be useful but without any warranty", "NoWarrantyGPL"),
    ("this library is distributed in the hope that it will be useful but without any warranty", "NoWarrantyGPL"),
    ("you should have received a copy of the gnu general public license", "GPLReceived"),
    ("you should have received a copy of the gnu lesser general public license", "GPLReceived"),
    ("you should have received a copy of the gnu affero general public license", "GPLReceived"),
    ("you may not use this file except in compliance with the license", "Apache2Compliance"),
    ("you may obtain a copy of the license at", "Apache2Copy"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "Apache2AsIs"),
    ("see the license for the specific language governing permissions and limitations under the license", "Apache2Limits"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "MPL2Subject"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "MPL2Copy"),
    ("this is free and unencumbered software released into the public domain", "Unlicense"),
    ("released into the public domain", "PublicDomain"),
    ("this software is provided as is without any express or implied warranty", "NoWarrantyZlib"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications", "ZlibPermission"),
    ("the origin of this software must not be misrepresented", "ZlibOrigin"),
    ("altered source versions must be plainly marked as such", "ZlibAltered"),
    ("this notice may not be removed or altered from any source distribution", "ZlibNotice"),
    ("everyone is permitted to copy and distribute verbatim or modified copies of this license document", "WTFPLCopy"),
    ("you just do what the fuck you want to", "WTFPL"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation", "GPL2Only"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation", "GPL3Only"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2", "GPL2Only"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3", "GPL3Only"),
    ("gnu general public license version 2 june 1991", "GPL2Text"),
    ("gnu general public license version 3 29 june 2007", "GPL3Text"),
    ("gnu lesser general public license version 3 29 june 2007", "LGPL3Text"),
    ("gnu affero general public license version 3 19 november 2007", "AGPL3Text"),
    ("everyone is permitted to copy and distribute verbatim copies of this license document", "GPLCopy"),
    ("made available under the terms of the eclipse public license 2 0", "EPL2Ref"),
    ("made available under the terms of the eclipse public license v2 0", "EPL2Ref"),
    ("made available under the terms of the eclipse public license v 2 0", "EPL2Ref"),
    ("governed by a bsd style license", "BSDStyleRef"),
    ("all rights reserved", "AllRightsReserved"),
    ("copyright c", "Copyright"),
]
# Names behind "SPDX-License-Identifier:", and the licence that each means.
SPDX = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3.0-only", "GPL-2.0": "GPL-2.0-only", "GPL-3.0-only": "GPL-3.0-only", "GPL-2.0-only": "GPL-2.0-only",
    "GPL-3.0-or-later": "GPL-3.0-or-later", "GPL-2.0-or-later": "GPL-2.0-or-later", "GPL-3.0+": "GPL-3.0-or-later", "GPL-2.0+": "GPL-2.0-or-later",
    "LGPL-3.0-only": "LGPL-3.0-only", "LGPL-2.1-only": "LGPL-2.1-only", "LGPL-3.0-or-later": "LGPL-3.0-or-later", "LGPL-2.1-or-later": "LGPL-2.1-or-later",
    "AGPL-3.0-only": "AGPL-3.0-only", "AGPL-3.0-or-later": "AGPL-3.0-or-later", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "0BSD": "0BSD", "ISC": "ISC",
    "MPL-2.0": "MPL-2.0", "EPL-2.0": "EPL-2.0", "BSL-1.0": "BSL-1.0", "Zlib": "Zlib", "Unlicense": "Unlicense", "WTFPL": "WTFPL", "CC0-1.0": "CC0-1.0",
    "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0",
}
# Ordered rules, sequences of sentence identifiers and the licence they mean; an empty name
# means that the sequence tells of no licence.
RULES = [
    (("Copyright", "AllRightsReserved"), ""),
    (("BSDPermission", "BSDSource", "BSDBinary", "BSDAdvertising", "BSDEndorse", "NoWarrantyBSD"), "BSD-4-Clause"),
    (("BSDPermission", "BSDSource", "BSDBinary", "BSDEndorse", "NoWarrantyBSD"), "BSD-3-Clause"),
    (("Apache2Ref", "Apache2Compliance", "Apache2Copy", "Apache2AsIs", "Apache2Limits"), "Apache-2.0"),
    (("NoWarrantyZlib", "ZlibPermission", "ZlibOrigin", "ZlibAltered", "ZlibNotice"), "Zlib"),
    (("BSDPermission", "BSDSource", "BSDBinary", "NoWarrantyBSD"), "BSD-2-Clause"),
    (("GPLPermission", "Version3OrLater", "NoWarrantyGPL", "GPLReceived"), "GPL-3.0-or-later"),
    (("GPLPermission", "Version2OrLater", "NoWarrantyGPL", "GPLReceived"), "GPL-2.0-or-later"),
    (("MITPermission", "MITNotice", "NoWarrantyMIT"), "MIT"),
    (("BSL1Permission", "NoWarrantyMIT"), "BSL-1.0"),
    (("Apache2Ref", "Apache2Compliance", "Apache2Copy"), "Apache-2.0"),
    (("GPLPermission", "Version3OrLater", "NoWarrantyGPL"), "GPL-3.0-or-later"),
    (("GPLPermission", "Version2OrLater", "NoWarrantyGPL"), "GPL-2.0-or-later"),
    (("GPL3Later", "NoWarrantyGPL", "GPLReceived"), "GPL-3.0-or-later"),
    (("GPL2Later", "NoWarrantyGPL", "GPLReceived"), "GPL-2.0-or-later"),
    (("LGPL3Later", "NoWarrantyGPL", "GPLReceived"), "LGPL-3.0-or-later"),
    (("LGPL21Later", "NoWarrantyGPL", "GPLReceived"), "LGPL-2.1-or-later"),
    (("AGPL3Later", "NoWarrantyGPL", "GPLReceived"), "AGPL-3.0-or-later"),
    (("GPL3Later", "NoWarrantyGPL"), "GPL-3.0-or-later"),
    (("GPL2Later", "NoWarrantyGPL"), "GPL-2.0-or-later"),
    (("LGPL3Later", "NoWarrantyGPL"), "LGPL-3.0-or-later"),
    (("LGPL21Later", "NoWarrantyGPL"), "LGPL-2.1-or-later"),
    (("AGPL3Later", "NoWarrantyGPL"), "AGPL-3.0-or-later"),
    (("MPL2Subject", "MPL2Copy"), "MPL-2.0"),
    (("ISCPermission", "NoWarrantyISC"), "ISC"),
    (("WTFPLCopy", "WTFPL"), "WTFPL"),
    (("GPL3Later",), "GPL-3.0-or-later"),
    (("GPL2Later",), "GPL-2.0-or-later"),
    (("LGPL3Later",), "LGPL-3.0-or-later"),
    (("LGPL21Later",), "LGPL-2.1-or-later"),
    (("AGPL3Later",), "AGPL-3.0-or-later"),
    (("GPL2Only", "NoWarrantyGPL", "GPLReceived"), "GPL-2.0-only"),
    (("GPL3Only", "NoWarrantyGPL", "GPLReceived"), "GPL-3.0-only"),
    (("GPL2Text", "GPLCopy"), "GPL-2.0-only"),
    (("GPL3Text", "GPLCopy"), "GPL-3.0-only"),
    (("LGPL3Text", "GPLCopy"), "LGPL-3.0-only"),
    (("AGPL3Text", "GPLCopy"), "AGPL-3.0-only"),
    (("GPL2Only",), "GPL-2.0-only"),
    (("GPL3Only",), "GPL-3.0-only"),
    (("GPL2Text",), "GPL-2.0-only"),
    (("GPL3Text",), "GPL-3.0-only"),
    (("LGPL3Text",), "LGPL-3.0-only"),
    (("AGPL3Text",), "AGPL-3.0-only"),
    (("BSDStyleRef",), "LicenseRef-BSD-style"),
    (("MITPermission",), "MIT"),
    (("ISCPermission",), "ISC"),
    (("ZlibPermission",), "Zlib"),
    (("GPL3Ref",), "GPL-3.0-only"),
    (("GPL2Ref",), "GPL-2.0-only"),
    (("LGPL3Ref",), "LGPL-3.0-only"),
    (("LGPL21Ref",), "LGPL-2.1-only"),
    (("AGPL3Ref",), "AGPL-3.0-only"),
    (("Apache2Ref",), "Apache-2.0"),
    (("MITRef",), "MIT"),
    (("BSD2Ref",), "BSD-2-Clause"),
    (("BSD3Ref",), "BSD-3-Clause"),
    (("MPL2Ref",), "MPL-2.0"),
    (("MPL2Subject",), "MPL-2.0"),
    (("EPL2Ref",), "EPL-2.0"),
    (("BSL1Ref",), "BSL-1.0"),
    (("CCBYNCND4Ref",), "CC-BY-NC-ND-4.0"),
    (("CCBYNCSA4Ref",), "CC-BY-NC-SA-4.0"),
    (("CCBYNC4Ref",), "CC-BY-NC-4.0"),
    (("CCBYND4Ref",), "CC-BY-ND-4.0"),
    (("CCBYSA4Ref",), "CC-BY-SA-4.0"),
    (("CCBY4Ref",), "CC-BY-4.0"),
    (("CC0Ref",), "CC0-1.0"),
    (("Unlicense",), "Unlicense"),
    (("PublicDomain",), "public-domain"),
    (("WTFPL",), "WTFPL"),
]
#: Every known sentence has one of these inside a word. Words come through normalisation as they are, so a
#: text without any has no known sentence and need not be normalised.
SIGNS = ("licens", "permission", "copyright", "warrant", "distribut", "reserved", "advertising", "neither", "domain", "misrepresented", "altered", "cc0", "fuck")
#: What may stand before the telling words of a normalised sentence: a list number or letter, and a slot for a name
#: with "is" or "are". ("Permission is" tells by itself.)
NUMBER, SLOT = "(?:(?:[0-9]{1,2}|[a-z]) )?", "(?:(?:[a-z0-9+]+ ){1,6}(?:is|are) )?"
OPENING = f"{NUMBER}(?:(?!permission is ){SLOT})?"
#: A reference to a licence that no known sentence names.
REFERENCE = "^(?:licensed|released|distributed) under (?:[a-z0-9+]+ ){0,8}?licen[cs]e "
UNKNOWN = "UnknownRef"
#: An SPDX expression: names, perhaps in brackets, with operators between, behind its label. Every name gets a line and
#: a label of its own (OWN) before sentences are looked up; \\G goes on where an operator was.
OWN = "SPDX-License-Name:"
LABEL, SPDX_NAME = "SPDX-License-Identifier:", "[A-Za-z0-9][A-Za-z0-9.+:_-]*"
EXPRESSION = rf"(?:\b(?i:{LABEL})|\G(?<=[\x20\t)](?:AND|OR|WITH)))[(\x20\t]*({SPDX_NAME})[)\x20\t]*(?:(?<=[)\x20\t])(?:AND|OR|WITH)(?=[(\x20\t]))?"
#: Where the oracle cuts.
END = r"\n|\.[\x20\x09-\x0D]+|\.$"
#: Comment signs that are words, at the beginning of a line.
LEADERS = r"(?m)^[\x20\x09]*(?:dnl|rem)(?=[\x20\x09\r]|$)"
#: The full stop of "v. 2" ends no sentence. BREAK does; LINE stands for a line end inside a sentence. As
#: capitals they are in no lower-case text.
VERSION, BREAK, LINE = r"(?<![a-z0-9+])v\.(?=[\x20\x09-\x0D]+[0-9])", "Z", "Y"
BREAKS = r"\n[^a-z0-9+\n]*(?=\n)|\.[\x20\x09-\x0D]+"


def _table() -> dict[str, str]:
    """Known sentences without their openings, and their identifiers."""
    spdx = [("spdx license identifier " + re.sub("[^a-z0-9+]+", " ", name.lower()).strip(), f"SPDX {name}") for name in SPDX]
    return {re.sub(f"^{OPENING}", "", start) if name[:4] != "SPDX" else start: name for start, name in SENTENCES + spdx}


def _shortened(rules: list[tuple[tuple[str, ...], str]]) -> list[tuple[tuple[str, ...], str]]:
    """The rules, longest first, and every beginning of two sentences or more that leads to one licence only: a notice may
    lack its end."""
    means: dict[tuple[str, ...], set[str]] = {}
    for sequence, name in rules:
        for n in range(2, len(sequence)):
            means.setdefault(sequence[:n], set()).add(name)
    given = {sequence for sequence, _ in rules}
    added = [(sequence, next(iter(names))) for sequence, names in means.items() if len(names) == 1 and sequence not in given]
    return sorted(rules + added, key=lambda r: -len(r[0]))


KNOWN = _table()
ALL_RULES = _shortened(RULES) + [((f"SPDX {name}",), means) for name, means in SPDX.items()]
FIRST = "|".join(sorted({re.escape(s.split()[0]) for s in KNOWN}))
#: Numbers of words of the known sentences, longest first.
LENGTHS = sorted({len(s.split()) for s in KNOWN}, reverse=True)


def normalised(text: Column) -> Column:
    """Lower case a-z, 0-9 and +, BREAK and LINE, all else as single spaces; begins with BREAK."""
    apart = F.when(F.contains(F.lower(text), F.lit(LABEL.lower())), F.regexp_replace(text, EXPRESSION, f"\n{OWN} $1\n")).otherwise(text)
    lines = F.regexp_replace(F.regexp_replace(F.lower(apart), LEADERS, ""), VERSION, "v")
    broken = F.replace(F.regexp_replace(lines, BREAKS, f"\n {BREAK} "), F.lit("\n"), F.lit(f" {LINE} "))
    return F.concat(F.lit(f"{BREAK} "), F.trim(F.regexp_replace(broken, f"[^a-z0-9+{BREAK}{LINE}]+", " ")), F.lit(" "))


def identified(text: Column) -> Column:
    """The identifiers of the known sentences in a normalised text, in order. Wherever the first word of
    a known sentence stands at the beginning of a sentence or line, the words from there are looked up;
    beginnings inside a sentence that was found are passed over. Behind an SPDX label all words of the line are one
    name; one that is not known, an exception too, is `SPDX? ` and its words. A reference to a licence that is not known is
    UNKNOWN."""
    first = FIRST
    over = f"(?:{LINE} )*"
    found = F.regexp_extract_all(text, F.lit(f"(?<=[{BREAK}{LINE}] ){OPENING}(?=((?:{first}) {over}(?:[a-z0-9+]+ {over}){{0,{LENGTHS[0] - 1}}}))"), F.lit(1))
    known = F.str_to_map(F.lit(",".join(f"{s}:{name};{len(s.split())}" for s, name in KNOWN.items())), F.lit(","), F.lit(":"))
    bare = lambda s: F.replace(s, F.lit(f"{LINE} "), F.lit(""))
    size = lambda s: F.size(F.split(s, " ")).cast("string")
    label = F.lit("spdx license name ")
    line = lambda s: F.trim(F.regexp_extract(s, "^[a-z0-9+ ]*", 0))
    spdx = lambda s: F.coalesce(F.try_element_at(known, F.replace(line(s), label, F.lit("spdx license identifier "))), F.concat(F.lit("SPDX? "), F.substr(line(s), F.length(label) + 1), F.lit(";"), size(line(s))))
    reference = lambda s: F.regexp_extract(bare(s), REFERENCE, 0)
    unknown = lambda s: F.when(reference(s) != "", F.concat(F.lit(f"{UNKNOWN};"), size(F.trim(reference(s)))))
    sentence = lambda s: F.coalesce(*[F.try_element_at(known, F.trim(F.substring_index(bare(s), " ", n))) for n in LENGTHS], unknown(s))
    hits = F.transform(found, lambda s: F.struct(s.alias("s"), F.when(F.startswith(s, label), spdx(s)).otherwise(sentence(s)).alias("hit")))
    name, n = lambda h: F.substring_index(h["hit"], ";", 1), lambda h: F.substring_index(h["hit"], ";", -1).cast("int")
    taken = lambda h: F.regexp_substr(h["s"], F.concat(F.lit(f"^(?:[a-z0-9+]+ {over}){{"), (n(h) - 1).cast("string"), F.lit("}[a-z0-9+]+ ")))
    inside = lambda h: F.regexp_count(taken(h), F.lit(f"{LINE} {OPENING}(?:{first}) "))
    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("names"))
    step = lambda s, h: F.when(s["skip"] > 0, F.struct((s["skip"] - 1).alias("skip"), s["names"].alias("names"))).when(
        h["hit"].isNotNull(), F.struct(inside(h).alias("skip"), F.concat(s["names"], F.array(name(h))).alias("names"))).otherwise(s)
    return F.aggregate(hits, start, step, lambda s: s["names"])


def scan_licenses(docs: DataFrame, rules: list[tuple[tuple[str, ...], str]] = ALL_RULES, text_col: str = "text") -> DataFrame:
    """The documents with license_sentences (identifiers in the order of the text), licenses (names
    by rules, sorted, each once) and unmatched (identifiers that no rule takes, in order).

    A null, empty or plain text has empty arrays. Whole texts are read, whatever their length.
    Repeated rows each return a row; an empty table gives none. Input columns with the names of
    outputs are replaced, all others stay.
    """
    columns = [c for c in docs.columns if c not in ("license_sentences", "licenses", "unmatched")]
    none = F.array().cast("array<string>")
    signed = F.exists(F.array(F.lower("text")), lambda t: functools.reduce(operator.or_, [F.contains(t, F.lit(s)) for s in SIGNS]))
    df = packed(docs, text=text_col).withColumn("license_sentences", F.when(signed, identified(normalised(F.col("text")))).otherwise(none))
    steps = F.struct(F.concat(F.lit(";"), F.array_join("license_sentences", ";;"), F.lit(";")).alias("left"), F.array().cast("array<string>").alias("found"))
    table = F.split(F.lit(",".join("".join(f";{i};" for i in sequence) + f"={name}" for sequence, name in rules)), ",")
    pattern, name = lambda r: F.substring_index(r, "=", 1), lambda r: F.substring_index(r, "=", -1)
    matched = F.aggregate(table, steps, lambda s, r: F.when(F.contains(s["left"], pattern(r)), F.struct(
        F.replace(s["left"], pattern(r), F.lit(";|;")).alias("left"), F.concat(s["found"], F.array(name(r))).alias("found"))).otherwise(s))
    df = df.withColumn("m", F.when(F.size("license_sentences") > 0, matched))
    licenses = F.sort_array(F.array_distinct(F.filter(F.coalesce(F.col("m.found"), none), lambda x: x != "")))
    left = F.filter(F.split(F.coalesce(F.col("m.left"), F.lit("")), ";"), lambda i: (i != "") & (i != "|"))
    return df.select(*unpacked(df, columns, text=text_col), "license_sentences", licenses.alias("licenses"), left.alias("unmatched"))


def oracle() -> str:
    """DuckDB SQL of doc_id, license_sentences, licenses and unmatched, joined by commas."""
    quoted = ", ".join(f"('{start}', '{name}')" for start, name in KNOWN.items())
    before = "SELECT doc_id, seq, ';' || array_to_string(seq, ';;') || ';' AS l, []::VARCHAR[] AS f FROM sequences"
    for sequence, name in ALL_RULES:
        pattern = "".join(f";{i};" for i in sequence)
        before = f"SELECT doc_id, seq, replace(l, '{pattern}', ';|;') AS l, CASE WHEN contains(l, '{pattern}') THEN list_append(f, '{name}') ELSE f END AS f FROM ({before})"
    names = rf"{SPDX_NAME}(?:[)\x20\t]*[)\x20\t](?:AND|OR|WITH)[(\x20\t]+{SPDX_NAME})*[)\x20\t]*"
    label = rf"\b(?i:{LABEL})[(\x20\t]*"
    each = f"list_transform(list_filter(regexp_split_to_array(x, '[()\\x20\\t]+'), lambda y: y NOT IN ('AND', 'OR', 'WITH', '')), lambda y: '{OWN} ' || y)"
    pieces = f"CASE WHEN regexp_matches(s, '(?i){LABEL}') THEN flatten(list_transform(range(1, len(regexp_split_to_array(s, '{label}{names}')) + 1), lambda i: list_concat([regexp_split_to_array(s, '{label}{names}')[i]], coalesce(list_transform([regexp_extract_all(s, '{label}({names})', 1)[i]], lambda x: {each})[1], [])))) ELSE [s] END"
    held = r"regexp_replace({0}, '^((?:(?:[0-9]{{1,2}}|[a-z]) )?)permission is ', '\1permission_is ')"
    bare = "trim(regexp_replace(lower(s), '[^a-z0-9+]+', ' ', 'g')) || ' '"
    telling = f"coalesce(nullif(regexp_extract({held.format(bare)}, '^{NUMBER}{SLOT}((?:{FIRST.replace('permission|', 'permission|permission_is|')}) .*)$', 1), ''), {bare})"
    return f"""
WITH known(start, name) AS (VALUES {quoted}),
    parts AS (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS i FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{END}') AS s FROM documents)),
    cut AS (SELECT doc_id, i, unnest(l) AS s, unnest(range(len(l))) AS j FROM (SELECT doc_id, i, {pieces} AS l FROM parts)),
    plain AS (SELECT doc_id, i, j, replace({telling}, 'permission_is ', 'permission is ') AS s FROM cut),
    hits AS (SELECT doc_id, i, j, arg_max(name, length(start)) AS name FROM (
        SELECT doc_id, i, j, name, start FROM plain JOIN known ON starts_with(s, start || ' ') OR s = replace(start, 'spdx license identifier', 'spdx license name') || ' '
        UNION ALL SELECT doc_id, i, j, 'SPDX? ' || trim(s[19:]), '' FROM plain WHERE starts_with(s, 'spdx license name ')
        UNION ALL SELECT doc_id, i, j, '{UNKNOWN}', '' FROM plain WHERE regexp_matches(s, '{REFERENCE}')) GROUP BY doc_id, i, j),
    sequences AS (SELECT d.doc_id, coalesce(list(name ORDER BY i, j) FILTER (name IS NOT NULL), []) AS seq FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY d.doc_id),
    matched AS ({before})
SELECT doc_id, array_to_string(seq, ',') AS license_sentences, array_to_string(list_sort(list_distinct(list_filter(f, lambda x: x <> ''))), ',') AS licenses,
    array_to_string(list_filter(string_split(l, ';'), lambda x: x <> '' AND x <> '|'), ',') AS unmatched
FROM matched"""
