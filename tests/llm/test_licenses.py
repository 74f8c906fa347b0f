import functools
import random
import re

from gridcells.llm import licenses as L


def test_rules_need_order_and_all_sentences(make_docs):
    s = L.SENTENCES
    texts = [
        f"Intro.\n{s['mit-ref']}.", f"{s['gpl-free']}. {s['gpl-warranty']}. {s['gpl-see']}.", f"{s['gpl-see']}. {s['gpl-free']}. {s['gpl-warranty']}.",
        f"{s['mit-grant']}:\n\n{s['mit-notice']}.", f"{s['mit-grant']}", f"## {s['apache-ref'].upper()}.\n{s['cc-by-ref']}.", None, "", "the license of nobody",
        f"{s['bsd-grant']}:\n1. {s['bsd-source']}.\n2. {s['bsd-binary']}.\n3. {s['bsd-endorse']}.", f"{s['apache-comply']}. {s['apache-copy']}\n{s['mit-ref']}\n{s['apache-asis']}.",
    ]
    got = {r["doc_id"]: r["licenses"] for r in L.recognise(make_docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [["MIT"], ["GPL-3.0"], [], ["MIT"], [], ["Apache-2.0", "CC-BY-4.0"], [], [], [], ["BSD-2-Clause", "BSD-3-Clause"], ["Apache-2.0", "MIT"]]


def test_known_sentences_are_distinct():
    known = L.known_sentences()
    assert set(L.SENTENCES) <= set(known.values()) and len(set(known.values())) == len(known)
    assert all(i in L.SENTENCES for rules in L.RULES.values() for r in rules for i in r)


def test_odd_rows_and_empty(odd_docs, no_docs):
    out = L.recognise(odd_docs).collect()
    assert len(out) == odd_docs.count() and all(r["licenses"] == [] for r in out) and "shard" in out[0].asDict()
    assert L.recognise(no_docs).collect() == []


def test_plan_is_native(make_docs):
    plan = L.recognise(make_docs(["a"]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
ASF = """Licensed to the Apache Software Foundation (ASF) under one
or more contributor license agreements.  See the NOTICE file
distributed with this work for additional information
regarding copyright ownership.  The ASF licenses this file
to you under the Apache License, Version 2.0 (the
"License"); you may not use this file except in compliance
with the License.  You may obtain a copy of the License at
"""
MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
WRAPPED = [(APACHE, ["Apache-2.0"]), (ASF, ["Apache-2.0"]), (MIT, ["MIT"]), (GPL3, ["GPL-3.0"]), (GPL2, ["GPL-2.0"]), (BSD, ["BSD-2-Clause", "BSD-3-Clause"]), (ISC, ["ISC"]), (MPL, ["MPL-2.0"])]


def test_texts_as_distributed(make_docs):
    """Wrapped, in comments of three kinds, with the line ends of Windows, and
    with the body of Apache's notice alone."""
    forms = [lambda t: t, lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */\nint x;", lambda t: "".join(f"# {x}\n" for x in t.splitlines()), lambda t: "".join(f"//{x}\r\n" for x in t.splitlines())]
    cases = [(form(t), want) for t, want in WRAPPED for form in forms] + [(APACHE[APACHE.index("you may not") :], ["Apache-2.0"])]
    got = {r["doc_id"]: r["licenses"] for r in L.recognise(make_docs([t for t, _ in cases])).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_blank_lines_and_end_marks_end_a_sentence(make_docs):
    texts = ["Released under\n\nthe MIT License", "Released under. The MIT License", "Not released\nunder the MIT License", "x\nReleased under\nthe MIT License\ny", "a. b\nReleased under the\nMIT License"]
    rows = {r["doc_id"]: r for r in L.recognise(make_docs(texts)).collect()}
    assert [rows[i]["licenses"] for i in range(5)] == [[], [], [], ["MIT"], ["MIT"]]
    assert rows[3]["sentence_at"] == [1] and rows[4]["sentence_at"] == [2] and rows[4]["n_sentences"] == 4


def test_a_sentence_in_pieces_is_needed_whole(make_docs):
    s = L.SENTENCES
    head, last = s["mpl-ref"].split(". ")
    free, rest = s["gpl-free"].split(": ")
    tail = f"{s['gpl-warranty']}. {s['gpl-see']}."
    texts = ["2.0", "Release notes\nVersion: 2.0\nfixes", "Changes in v. 2.0", f"{head}. Chapter two. {last}", f"{last}. {head}.", f"{rest}. {tail}", f"{free}: {tail} {rest}.", s["mpl-ref"], f"a. {head}.\n * {last}. b", f"{free}: {rest}. Thanks. {tail}"]
    rows = {r["doc_id"]: r["licenses"] for r in L.recognise(make_docs(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == [[]] * 7 + [["MPL-2.0"]] * 2 + [["GPL-3.0"]]


HOLDER = BSD.replace("the copyright holder nor", "Some Company, Incorporated, nor").replace("1. ", "* ")
LGPL = GPL3.replace("This program is free software:", "This library is free software;").replace("GNU General", "GNU Lesser General").replace("Foundation, either version 3", "Foundation; either version 2.1").replace("This program is dist", "This library is dist")
AGPL = GPL3.replace("GNU General", "GNU Affero General")
NAMED = GPL2.replace("This program is", "Frobnicator Two is")
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment would be appreciated.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""
TITLE2 = """                    GNU GENERAL PUBLIC LICENSE
                       Version 2, June 1991

 Copyright (C) 1989, 1991 Free Software Foundation, Inc.
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
"""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/
"""
MORE = [
    (HOLDER, ["BSD-2-Clause", "BSD-3-Clause"]), (LGPL.replace("program", "library"), ["LGPL-2.1"]), (AGPL, ["AGPL-3.0"]), (NAMED, ["GPL-2.0"]), (ZLIB, ["Zlib"]), (UNLICENSE, ["Unlicense"]), (BOOST, ["BSL-1.0"]), (TITLE2, ["GPL-2.0"]), (EPL, ["EPL-2.0"]),
    ("Frobnicator is released under the MIT License.", ["MIT"]), ("One two three four five six seven eight nine is released under the MIT License.", []), ("Distributed under the Boost Software License 1.0", ["BSL-1.0"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike\n3.0 Unported License.", ["CC-BY-NC-SA-3.0"]), ("Licensed under CC BY-ND 4.0", ["CC-BY-ND-4.0"]), ("Released under the LGPLv3", ["LGPL-3.0"]), ("Released under the sun", []),
]


def test_more_licences_stars_and_names(make_docs):
    forms = [lambda t: t, lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */\nint x;"]
    cases = [(form(t), want) for t, want in MORE for form in forms]
    got = {r["doc_id"]: r["licenses"] for r in L.recognise(make_docs([t for t, _ in cases])).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_tables_made_by_rule(make_docs):
    """Every sentence of SENTENCES that is a whole rule gives its licence, and only that."""
    single = {r[0]: name for name, rules in L.RULES.items() for r in rules if len(r) == 1}
    assert len(single) > 300
    ids = sorted(single)
    got = {r["doc_id"]: r["licenses"] for r in L.recognise(make_docs([f"x.\n{L.SENTENCES[i]}.\ny" for i in ids])).collect()}
    assert [got[k] for k in range(len(ids))] == [[single[i]] for i in ids]


def test_very_long_text(make_docs):
    texts = ["a " * 1_000_000, "word. " * 300_000 + L.SENTENCES["mit-ref"], "x" * 2_000_000, "\n" * 1_000_000, ". " * 1_000_000]
    rows = L.recognise(make_docs(texts)).orderBy("doc_id").collect()
    assert [r["licenses"] for r in rows] == [[], ["MIT"], [], [], []]
    assert [r["n_sentences"] for r in rows] == [1, 300_001, 1, 1_000_001, 1_000_001]


def test_many_sentences_in_one_text(make_docs):
    """Time grows with the hits, not with their square."""
    import time

    took = []
    for n in (20, 5_000, 20_000):  # the first one compiles
        lines = [L.SENTENCES["mit-ref" if k % 2 else "apache-ref"] + "." for k in range(n)]
        began = time.time()
        r = L.recognise(make_docs(["\n".join(lines)])).first()
        took.append(time.time() - began)
        assert len(r["sentence_ids"]) >= n and set(r["licenses"]) == {"MIT", "Apache-2.0"}
        assert r["sentence_at"] == sorted(r["sentence_at"])
    assert took[2] < 8 * took[1] + 10


def tokens(text):
    """The words, and between them the breaks: H after end marks, S of lines alone."""
    words, gaps = [], ["H"]
    for m in re.finditer(rf"(?P<H>{L.END})|(?P<S>{L.BREAK})|[a-z0-9]+", text.lower()):
        if m.lastgroup:
            gaps[-1] += m.lastgroup
        else:
            words.append(m.group())
            gaps.append("")
    gaps[-1] += "H"
    return words, gaps


def after(words, gaps, at, piece):
    """The words after a piece that begins at word ``at``, the longest stars first; None if
    it does not. A piece holds words, stars (X) and places for any break (None)."""
    if not piece:
        return at if gaps[at] else None
    first, *rest = piece
    if first is None:
        return after(words, gaps, at, rest)
    reach, free = at, True
    while reach < len(words) and reach - at < (L.HOLDER if first == "X" else 1) and (reach == at or free):
        reach += 1
        free = gaps[reach] in ("", "S")
    for end in range(reach, at, -1):
        if first != "X" and words[at] != first:
            return None
        if not rest or rest[0] is None or gaps[end] in ("", "S"):
            found = after(words, gaps, end, rest)
            if found is not None:
                return found
    return None


def all_pieces():
    """(identifier, piece) of all tables, in the order in which they are tried."""
    known, _ = L.known_wordings()
    halves = {p: [p.split()] for p in known if "X" not in p}
    for _, sentence in L.WORDINGS:
        for part in re.split(L.END, sentence):
            own = [" X ".join(L._norm(x) for x in half.split("*")).split() for half in part.split("\n\n")]
            halves[" ".join(w for h in own for w in h)] = own
    flat = {p: [w for k, h in enumerate(own) for w in ([None] if k else []) + h] for p, own in halves.items()}
    return [(known[p], flat[p]) for p in sorted(flat, key=lambda p: (p.startswith("X "), -len(p)))]


def brute(text, pieces):
    """Identifiers, the breaks before each, and licences, word by word."""
    words, gaps = tokens(text)
    ids, places, line, at, last = [], [], [], 0, 0
    while at < len(words):
        hit = next(((i, end) for i, p in pieces if (p[0] in ("X", words[at])) and (end := after(words, gaps, at, p)) is not None), None) if gaps[at] else None
        if hit is None:
            at += 1
            continue
        ids.append(hit[0])
        places.append(len("".join(gaps[: at + 1])) - 1)
        line += ["_"] * (at > last) + [hit[0]]
        at = last = hit[1]
    return ids, places, sorted(n for n, rules in rule_blocks().items() if any(in_order(line, r) for r in rules))


@functools.cache
def rule_blocks():
    """Of each licence the rules, each a list of sentences, each one or several lists of
    identifiers that stand next to each other."""
    known, _ = L.known_wordings()
    forms = {}
    for name, s in [*L.SENTENCES.items(), *L.WORDINGS]:
        parts = [" ".join(" ".join(" X ".join(L._norm(x) for x in half.split("*")).split()) for half in part.split("\n\n")) for part in re.split(L.END, s)]
        forms.setdefault(name, []).append([known[p] for p in parts if p])
    return {n: [[forms[i] for i in r] for r in L.RULES.get(n, []) + L.MORE_RULES.get(n, [])] for n in L.RULES | L.MORE_RULES}


def in_order(line, rule):
    at = 0
    for forms in rule:
        ends = [k + len(f) for f in forms for k in range(at, len(line)) if line[k : k + len(f)] == f]
        if not ends:
            return False
        at = min(ends)
    return True


def test_all_wordings_and_rules_against_brute_force(make_docs):
    """Every sentence of the tables, wrapped anywhere, with comment marks and names of one
    to nine words in the place of stars; every rule in order, with other lines between,
    turned round, and without one of its sentences."""
    rng = random.Random(5)
    told = [*L.SENTENCES.items(), *L.WORDINGS]

    def written(sentence):
        name = lambda: " ".join(rng.choice(["Jane", "Doe", "the", "Example", "3d", "Group"]) for _ in range(rng.randint(1, 9)))
        halves = [re.sub(r"\*", lambda _: name(), h) for h in sentence.split("\n\n")]
        text, mark = halves[0], rng.choice(["", "", " * ", "# ", "    "])
        for h in halves[1:]:
            text += rng.choice([" ", "\n", "\n\n"]) + h
        often = rng.choice([0, 0.05, 0.2])
        return re.sub(" ", lambda _: "\n" + mark if rng.random() < often else " ", text) + rng.choice([".", "\n", ". ", ".\n\n"])

    by_name = {}
    for n, s in told:
        by_name.setdefault(n, []).append(s)
    texts = ["Some words.\n" + written(s) + rng.choice(["int x", "", "\nmore"]) for _, s in told for _ in range(3)]
    for rules in (L.RULES, L.MORE_RULES):
        for own in rules.values():
            for rule in (r for r in own if len(r) > 1 or rng.random() < 0.1):
                parts = [written(rng.choice(by_name[i])) for i in rule]
                between = [rng.choice(["", "", "\nother words\n", "\n" + written(rng.choice(told)[1])]) for _ in parts]
                texts += ["\n".join(map("".join, zip(parts, between))), "\n".join(parts), "\n".join(parts[::-1]), "\n".join(parts[:-1])]
    pieces = all_pieces()
    want = [brute(t, pieces) for t in texts]
    got = {r["doc_id"]: (r["sentence_ids"], r["sentence_at"], sorted(r["licenses"])) for r in L.recognise(make_docs(texts)).collect()}
    wrong = [(texts[k], got[k], want[k]) for k in range(len(texts)) if got[k] != want[k]]
    assert not wrong, (len(wrong), wrong[0])
    assert {i for ids, _, _ in want for i in ids} == {i for i, _ in pieces}
    assert {n for _, _, names in want for n in names} >= set(L.MORE_RULES)
