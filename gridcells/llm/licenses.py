"""Licence scan by sentence rules (operator 8), in DataFrame functions only.

A text is cut into sentences, each is normalised (lower case, words of a-z and
0-9 joined by one space) and looked up among known licence sentences; the found
identifiers, in order, are matched against the licences' rules. A rule is an
ordered list of sentence identifiers, with other known sentences allowed between
(so a sentence left out of a rule is optional); of a sentence that holds an end mark
it needs all pieces, with nothing between.

The known sentences are tables: those of licence texts and notices (SENTENCES,
WORDINGS), and those made by rule of a licence's names (NAMES in TEMPLATES) and of the
Creative Commons kinds and versions. Where a wording has ``*``, up to HOLDER words may
stand, such as the name of a copyright holder. All go into one expression, a tree by
first words, so a sentence that begins like none costs one look.

Notices are distributed wrapped, so a known sentence may run over lines (with
comment marks before each), but not over an end mark or a blank line. It begins
and ends where a sentence or a line does, so notices of one line need no end mark.
The SQL has the tables of notices in one line and sees no others; of a sentence in
pieces it asks for the last.

Edge cases: null and empty texts have one empty sentence and no licence; repeated
sentences count each; where several known sentences begin at one place (a tie) the
longest that ends with a sentence or line counts; texts of any length are read whole;
rows may repeat; an empty table gives no rows; further columns of the input stay, but
those named like the added ones, which are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.runtime import spread, table

#: Sentences of public licence notices and texts.
SENTENCES = {
    "apache-ref": "Licensed under the Apache License, Version 2.0",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "mit-ref": "Released under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-under": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-ref": "This work is licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-see": "See the GNU General Public License for more details",
    "bsd-ref": "Released under the BSD License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0",
    "cc-by-ref": "Licensed under CC BY 4.0",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0",
    "cc0-ref": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "mpl-ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
RULES = {
    "Apache-2.0": [["apache-ref"], ["apache-comply", "apache-copy", "apache-asis"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]],
    "BSD-unspecified": [["bsd-ref"]],
    "CC-BY-4.0": [["cc-by-ref"]],
    "CC-BY-NC-4.0": [["cc-by-nc-ref"]],
    "CC-BY-SA-4.0": [["cc-by-sa-ref"]],
    "CC0-1.0": [["cc0-ref"]],
    "GPL-2.0": [["gpl2-ref"]],
    "GPL-3.0": [["gpl3-ref"], ["gpl-free", "gpl-warranty", "gpl-see"]],
    "ISC": [["isc-grant"]],
    "MIT": [["mit-ref"], ["mit-title"], ["mit-under"], ["mit-grant", "mit-notice"]],
    "MPL-2.0": [["mpl-ref"]],
}
#: Names of licences in sentences that only name one.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License v3.0", "AGPLv3", "GNU AGPLv3"),
    "Apache-2.0": ("Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0 License"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC0-1.0": ("CC0 1.0 Universal License", "CC0 license"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "GPL-2.0": ("GNU General Public License v2.0", "GNU General Public License version 2", "GPLv2", "GNU GPLv2"),
    "GPL-3.0": ("GNU General Public License v3.0", "GNU General Public License version 3", "GPLv3", "GNU GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License version 3", "LGPLv3"),
    "MIT": ("MIT License", "Expat License"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL",),
    "Zlib": ("zlib License",),
}
TEMPLATES = ("Licensed under the {}", "Released under the {}", "Distributed under the {}", "This project is licensed under the {}", "This software is licensed under the {}", "This work is licensed under the {}", "This code is released under the {}")
CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def _named() -> None:
    """The sentences of NAMES and of Creative Commons, beside those that are there."""
    made = [(spdx, t.format(name)) for spdx, names in NAMES.items() for name in names for t in TEMPLATES]
    for kind, name in CC_KINDS.items():
        for version, port in CC_VERSIONS.items():
            made += [(f"CC-{kind}-{version}", f"{lead} CC {kind} {version}") for lead in ("Licensed under", "This work is licensed under")]
            made += [(f"CC-{kind}-{version}", f"This work is licensed under {a} Creative Commons {name} {version} {port} License") for a in ("a", "the")]
    there = {_norm(x) for x in SENTENCES.values()}
    for spdx, sentence in made:
        rules = RULES.setdefault(spdx, [])
        if _norm(sentence) not in there:
            there.add(_norm(sentence))
            name = f"{spdx.lower()}-named-{len(rules)}"
            SENTENCES[name] = sentence
            rules.append([name])


#: Further wordings, which the SQL does not have: those of the texts as they are
#: distributed. An identifier may come again for a sentence of one piece. A blank
#: line here is any break there, or none.
WORDINGS = [
    ("apache-ref", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("apache-ref", "The ASF licenses this file to you under the Apache License, Version 2.0 (the \"License\")"),
    ("apache-ref", "Apache License\n\nVersion 2.0, January 2004"),
    ("apache-copy", "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-copy", "You may obtain a copy of the License at\n\nhttps://www.apache.org/licenses/LICENSE-2.0"),
    ("mit-notice", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl2-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License"),
    ("gpl2-comma", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"),
    ("gpl3-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version"),
    ("bsd-endorse", "Neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "Neither the name of the copyright holders nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-endorse", "Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "Neither the name of * nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "The name of * may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-advert", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-style", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("mit-ref", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT"),
    ("mit-ref", "* is released under the MIT License"),
    ("mit-ref", "* is licensed under the MIT License"),
    ("mit-ref", "Licensed under the MIT license (https://opensource.org/licenses/MIT)"),
    ("apache-ref", "* is licensed under the Apache License, Version 2.0"),
    ("apache-ref", "* licenses this file to you under the Apache License, Version 2.0 (the \"License\")"),
    ("gpl-see", "See the GNU General Public License for details"),
    ("gpl2-title", "GNU GENERAL PUBLIC LICENSE\n\nVersion 2, June 1991"),
    ("gpl3-title", "GNU GENERAL PUBLIC LICENSE\n\nVersion 3, 29 June 2007"),
    ("lgpl2-title", "GNU LESSER GENERAL PUBLIC LICENSE\n\nVersion 2.1, February 1999"),
    ("lgpl3-title", "GNU LESSER GENERAL PUBLIC LICENSE\n\nVersion 3, 29 June 2007"),
    ("agpl3-title", "GNU AFFERO GENERAL PUBLIC LICENSE\n\nVersion 3, 19 November 2007"),
    ("fsf-verbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("gpl3-star", "* is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl2-star", "* is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-warranty", "* is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("lgpl2-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl3-free", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl3-program", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-see", "See the GNU Lesser General Public License for more details"),
    ("agpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl-see", "See the GNU Affero General Public License for more details"),
    ("epl1-ref", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at *"),
    ("epl2-ref", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at *"),
    ("epl1-title", "Eclipse Public License - v 1.0"),
    ("epl2-title", "Eclipse Public License - v 2.0"),
    ("mpl1-ref", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")"),
    ("mpl2-title", "Mozilla Public License Version 2.0"),
    ("cddl-ref", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")"),
    ("unlicense-free", "This is free and unencumbered software released into the public domain"),
    ("unlicense-grant", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib-origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("zlib-altered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("zlib-notice", "This notice may not be removed or altered from any source distribution"),
    ("boost-title", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("boost-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("boost-ref", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at *"),
    ("artistic2-title", "The Artistic License 2.0"),
    ("perl-terms", "This program is free software; you can redistribute it and/or modify it under the same terms as Perl itself"),
    ("perl-terms", "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself"),
    ("psf-title", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"),
    ("wtfpl-title", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("wtfpl-verbatim", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("cc0-title", "CC0 1.0 Universal"),
    ("cc0-deed", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("cc0-ref", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
]
#: Alternatives to RULES for the identifiers that only WORDINGS has.
MORE_RULES = {
    "AGPL-3.0": [["agpl3-free", "gpl-warranty", "agpl-see"], ["agpl3-title", "fsf-verbatim"]],
    "Artistic-2.0": [["artistic2-title"]],
    "BSD-4-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]],
    "BSD-unspecified": [["bsd-style"]],
    "BSL-1.0": [["boost-title", "boost-grant"], ["boost-ref"]],
    "CC0-1.0": [["cc0-title"], ["cc0-deed"]],
    "CDDL-unspecified": [["cddl-ref"]],
    "EPL-1.0": [["epl1-ref"], ["epl1-title"]],
    "EPL-2.0": [["epl2-ref"], ["epl2-title"]],
    "GPL-2.0": [["gpl2-free", "gpl-warranty", "gpl-see"], ["gpl2-only", "gpl-warranty", "gpl-see"], ["gpl2-comma", "gpl-warranty", "gpl-see"], ["gpl2-star", "gpl-warranty", "gpl-see"], ["gpl2-title", "fsf-verbatim"]],
    "GPL-3.0": [["gpl3-free", "gpl-warranty", "gpl-see"], ["gpl3-star", "gpl-warranty", "gpl-see"], ["gpl3-title", "fsf-verbatim"]],
    "LGPL-2.1": [["lgpl2-free", "gpl-warranty", "lgpl-see"], ["lgpl2-title", "fsf-verbatim"]],
    "LGPL-3.0": [["lgpl3-free", "gpl-warranty", "lgpl-see"], ["lgpl3-program", "gpl-warranty", "lgpl-see"], ["lgpl3-title", "fsf-verbatim"]],
    "MPL-1.1": [["mpl1-ref"]],
    "MPL-2.0": [["mpl2-title"]],
    "Perl-5": [["perl-terms"]],
    "Python-2.0": [["psf-title"]],
    "Unlicense": [["unlicense-free", "unlicense-grant"]],
    "WTFPL": [["wtfpl-title", "wtfpl-verbatim"]],
    "Zlib": [["zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]],
}
#: The most words in the place of a star.
HOLDER = 8
#: Sentences end at these marks before white space, and at line breaks.
SPLIT = r"[.!?;:]+[ \t]+|[ \t\r]*\n"
#: The same breaks told apart: after an end mark (H) or of lines alone (S).
END, BREAK = r"[.!?;:]+(?:[ \t]+|\r[ \t\r]*\n|\n)", r"[ \t\r]*\n"


def _norm(sentence: str) -> str:
    """What ``normalised`` does, for the known sentences."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def _parts(sentence: str) -> list[str]:
    """A known sentence may hold marks that end one: its pieces, but empty ones."""
    return [x for x in map(_norm, re.split(SPLIT, sentence)) if x]


_named()


def known_sentences() -> dict[str, str]:
    """Normalised piece -> identifier. A sentence of several pieces is named by
    its last, the others get a suffix."""
    out = {}
    for name, sentence in SENTENCES.items():
        *first, last = _parts(sentence)
        out |= {p: f"{name}-{i}" for i, p in enumerate(first)}
        out[last] = name
    return out


def rule_pattern(rules: list[list[str]]) -> str:
    """Regular expression over ' id id id '."""
    return "|".join(" " + r" (?:[^ ]+ )*".join(rule) + " " for rule in rules)


_SPACE, _ANY = r"(?: ?S ?| )", r"[a-z0-9]+"
_STAR = rf"{_ANY}(?:{_SPACE}{_ANY}){{0,{HOLDER - 1}}}"


def _words(piece: str) -> str:
    """The expression of a normalised piece, in which an X stands for a star."""
    return _SPACE.join(_STAR if w == "X" else w for w in piece.split())


def _starred(sentence: str) -> str:
    return " X ".join(map(_norm, sentence.split("*"))).strip()


def known_wordings() -> tuple[dict[str, str], dict[str, str]]:
    """``known_sentences`` with the pieces of WORDINGS (stars as X), and the regular
    expression of each piece in a text of ``marked``."""
    out, patterns = known_sentences(), {}
    for piece in out:
        patterns[piece] = _words(piece)
    for name, sentence in WORDINGS:
        loose = [[_starred(x) for x in part.split("\n\n")] for part in re.split(END, sentence)]
        for i, halves in enumerate(loose):
            piece = " ".join(halves)
            out.setdefault(piece, name if i == len(loose) - 1 else f"{name}-{i}")
            patterns[piece] = "[ HS]+".join(map(_words, halves))
    return out, patterns


def one_pattern(patterns: dict[str, str]) -> str:
    """All pieces as a tree by first word, the longest first where they share it."""
    by_first: dict[str, list[str]] = {}
    for piece in sorted(patterns, key=len, reverse=True):
        by_first.setdefault(piece.split()[0], []).append(piece)
    branches = []
    for first in sorted(by_first, key=lambda w: (w == "X", w)):  # a star begins anything, so it is tried last
        head = _STAR if first == "X" else first
        branches.append(head + "(?:" + "|".join(patterns[p][len(head) :] for p in by_first[first]) + ")")
    return "|".join(branches)


def whole_rules() -> dict[str, list[list[str]]]:
    """RULES and MORE_RULES with each sentence as all its pieces, one directly after
    the other: a piece may be as short as the '2.0' of Mozilla's notice. The forms of
    an identifier that come in different pieces are alternatives."""
    known, _ = known_wordings()
    pieces: dict[str, set[str]] = {}
    for name, s in SENTENCES.items():
        pieces.setdefault(name, set()).add(" ".join(known[p] for p in _parts(s)))
    for name, sentence in WORDINGS:
        pieces.setdefault(name, set()).add(" ".join(known[" ".join(map(_starred, p.split("\n\n")))] for p in re.split(END, sentence)))
    either = {name: next(iter(x)) if len(x) == 1 else "(?:" + "|".join(sorted(x)) + ")" for name, x in pieces.items()}
    return {name: [[either[i] for i in r] for r in RULES.get(name, []) + MORE_RULES.get(name, [])] for name in RULES | MORE_RULES}


def marked(text: Column) -> Column:
    """The normalised text between an H at each end, with each break of SPLIT as
    H or S: capitals, which lower case leaves free."""
    broken = F.regexp_replace(F.regexp_replace(F.lower(text), END, "H"), BREAK, "S")
    return F.concat(F.lit("H"), F.regexp_replace(broken, "[^a-z0-9HS]+", " "), F.lit("H"))


def recognise(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and n_sentences, sentence_ids (array, in order),
    sentence_at (the numbers of the sentences, in the cut by SPLIT, where they
    begin), licenses (array): these replace columns of those names."""
    known, patterns = known_wordings()
    lookup = F.create_map(*[F.lit(x) for kv in known.items() if "X" not in kv[0] for x in kv])
    pattern = f"([HS]) ?({one_pattern(patterns)})(?= ?[HS])"
    starred = [(F.lit(known[p]), "^(?:" + e.replace(_SPACE, " ") + ")$") for p, e in sorted(patterns.items()) if "X" in p]
    text = F.coalesce("text", F.lit(""))
    base = docs.drop("n_sentences", "sentence_ids", "sentence_at", "licenses", "_marked", "_hits", "_at", "_found", "_line")
    out = base.withColumn("n_sentences", F.size(F.split(text, SPLIT)).cast("long")).withColumn("_marked", marked(text))
    out = out.withColumn("_hits", F.regexp_extract_all("_marked", F.lit(pattern), F.lit(2)))
    # an X before each hit: the pieces that begin with one have its number
    pieces = F.split(F.regexp_replace("_marked", pattern, "$1X$2"), "[HS]")
    begins = F.filter(F.transform(pieces, lambda p, i: F.when(p.startswith("X"), i - 1)), lambda i: i.isNotNull())
    out = out.withColumn("_at", F.when(F.size("_hits") > 0, begins).otherwise(F.array().cast("array<int>")))
    plain = lambda hit: F.regexp_replace(hit, "[ HS]+", " ")
    name = lambda hit: F.coalesce(F.element_at(lookup, plain(hit)), *[F.when(plain(hit).rlike(e), i) for i, e in starred])
    # no column of the text's size inside the function: it would be computed for each hit
    out = out.withColumn("_found", F.zip_with("_hits", "_at", lambda hit, at: F.struct(at.alias("at"), name(hit).alias("id"))))
    # an _ where words that are not known lie before a hit
    gaps = F.when(F.size("_hits") > 0, F.split("_marked", pattern))
    ids = F.zip_with("_found.id", gaps, lambda i, gap: F.concat(F.when(gap.rlike("[a-z0-9]"), F.lit("_ ")).otherwise(F.lit("")), i))
    line = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    out = out.withColumn("_line", line)
    matched = F.array(*[F.when(F.col("_line").rlike(rule_pattern(r)), F.lit(name)) for name, r in sorted(whole_rules().items())])
    licenses = F.when(F.size("_found") > 0, F.array_compact(matched)).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"sentence_ids": F.col("_found.id"), "sentence_at": F.col("_found.at"), "licenses": licenses}).drop("_marked", "_hits", "_at", "_found", "_line")


def op8_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recognise(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    values = ", ".join(f"('{k}', '{v}')" for k, v in known_sentences().items())
    cases = ", ".join(f"CASE WHEN regexp_matches(seq, '{rule_pattern(r)}') THEN '{name}' END" for name, r in sorted(RULES.items()))
    return f"""
WITH known(s, id) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split_regex(coalesce(text, ''), '{SPLIT}') AS ss FROM documents),
u AS (SELECT rid, unnest(ss) AS s, unnest(range(len(ss))) AS pos FROM d),
f AS (SELECT rid, string_agg(id, ' ' ORDER BY pos) AS ids
      FROM u JOIN known ON known.s = trim(regexp_replace(lower(u.s), '[^a-z0-9]+', ' ', 'g')) GROUP BY rid),
g AS (SELECT doc_id, len(ss)::BIGINT AS n_sentences, coalesce(ids, '') AS ids, ' ' || coalesce(ids, '') || ' ' AS seq FROM d LEFT JOIN f ON d.rid = f.rid)
SELECT doc_id, n_sentences, replace(ids, ' ', ',') AS sentence_ids, concat_ws(',', {cases}) AS licenses FROM g
"""


QUERIES = {"op8_license_sentences": op8_license_sentences}
SQL = {"op8_license_sentences": _sql()}
