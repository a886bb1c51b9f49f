import itertools
import re

import brute
import duckdb
import pytest

from rampstat.llm import license_scan as s

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
BSD2 = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * 1. Redistributions of source code must retain the above copyright notice.
 * 2. Redistributions in binary form must reproduce the above copyright notice.
 * THIS SOFTWARE IS PROVIDED BY THE AUTHORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
BSD3 = BSD2.replace(" * THIS", " * Neither the name of the author nor the names of others may be used to endorse or promote products derived from this software.\n * THIS")
CASES = [
    ("Prose.\nReleased under the MIT License.", "MIT", "permissive"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC", "noncommercial"),
    ("x y\nThis work is licensed under the GNU General Public License, version 3.", "GPL-3.0", "copyleft"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0", "permissive"), (MIT, "MIT", "permissive"), (BSD2, "BSD-2-Clause", "permissive"),
    (BSD3, "BSD-3-Clause", "permissive"), ("Released under the MIT Licence. Licensed under CC BY-SA 4.0.", "CC-BY-SA,MIT", "copyleft"),
    ("Licensed to nobody at all", "", "unknown"), ("They left the café. Silence.", "", "none"), (None, "", "none"), ("", "", "none"),
    ("This file is free; you can use it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the "
     "License, or (at your option) any later version.", "GPL-2.0-or-later", "copyleft"), ("MIT " * 5000 + "All rights reserved.", "All-Rights-Reserved", "restricted"),
    ("Released under the MIT License. Released under the MIT License. Released under the MIT License.", "MIT", "permissive"),
]


def test_known_licences(spark):
    rows = [(i, c[0]) for i, c in enumerate(CASES)]
    got = {r.doc_id: (r.licenses, r.verdict) for r in s.scan(brute.frame(spark, rows)).collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES)}


def test_order_decides(spark):
    got = {r.doc_id: r for r in s.scan(brute.frame(spark, [(1, BSD2), (2, "\n".join(reversed(BSD2.split("\n"))))])).collect()}
    assert got[1].licenses == "BSD-2-Clause" and "BSD" not in got[2].licenses


def test_oracle_agrees(spark):
    notices = [NOTICE.format(what=n[0], name=n[1], cut=n[2], version=n[3]) for n in NOTICES]
    rows = [(i, x) for i, x in enumerate([c[0] for c in CASES + WORDED] + notices)] + [(100 + i, x) for i, x in brute.odd_rows() if i is not None]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    brute.same(s.scan(brute.frame(spark, rows)).collect(), con.execute(s.ORACLE).fetchall())


def test_empty_and_null_ids(spark):
    assert s.scan(brute.frame(spark, [])).collect() == []
    assert [r.doc_id for r in s.scan(brute.frame(spark, [(None, "x")] * 2)).collect()] == [None, None]


@pytest.mark.parametrize("name", [n for n, _, _ in s.RULES])
def test_rules_use_known_identifiers(name):
    known = {n for n, _ in s.SENTENCES}
    assert all(set(ids) <= known for n, _, ids in s.RULES if n == name)


def branches(pattern):
    """One text for every choice of the groups of a pattern; gaps are of one word."""
    parts = re.split(r"(\([^()]*\)[?*]?)", re.sub(r"\.\{1,\d+\}", "x", pattern.replace(" ?", "( )?")).replace("[12][0-9]{3}", "2020").replace("[1-4]", "4").replace("$", ""))
    choices = [[x] if not x.startswith("(") else x.strip("()?*").split("|") + [""] * (x[-1] in "?*") for x in parts]
    return {re.sub(" +", " ", "".join(c)).strip() for c in itertools.product(*choices)}


def test_filter_passes_every_branch(spark):
    """Each branch of each pattern, by a plain version without any filter."""
    texts = sorted(set().union(*[branches(p) for _, p in s.SENTENCES]))
    texts += ["Released under CC BY 4.0.", "Available under CC BY-NC 4.0.", "Distributed under the GNU GPL v2.", "Available under the\n * Creative\n * Commons Attribution 4.0"]
    want = {}
    for i, x in enumerate(texts):
        norm = re.sub("[^a-z0-9]+", " ", x.lower()).strip().replace("licence", "license")
        want[i] = next((n for n, p in s.SENTENCES if re.search(rf"\b(?:{p})\b", norm)), "Unknown" if re.search(r"\blicensed? ", norm) else "")
    assert set(want.values()) >= {n for n, _ in s.SENTENCES}
    # alone, and beside a line that lets the text through the filter
    rows = [(i, x) for i, x in enumerate(texts)] + [(len(texts) + i, f"All rights reserved.\n\n{x}") for i, x in enumerate(texts)]
    got = {r.doc_id: r.sentence_ids for r in s.scan(brute.frame(spark, rows)).collect()}
    assert {i: got[i] for i in want} == want
    assert {i: got[len(texts) + i] for i in want} == {i: f"AllRights,{x}".rstrip(",") for i, x in want.items()}


# The notices as the licences' own texts word them.
NOTICE = """ * This {what} is free software; you can redistribute it and/or
 * modify it under the terms of the GNU {name}
 * as published by the Free Software Foundation{cut} either
 * version {version} of the License, or (at your option) any later version.
 *
 * It is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.
 *
 * You should have received a copy of the GNU {name}
 * along with this {what}; if not, write to the Free Software Foundation."""
NOTICES = [
    ("program", "General Public License", ";", "2", "Gpl2Any", "GPL-2.0-or-later"), ("program", "General Public License", ",", "3", "Gpl3Any", "GPL-3.0-or-later"),
    ("program", "General Public License", ";", "3", "Gpl3Any", "GPL-3.0-or-later"), ("library", "Lesser General Public License", ";", "2.1", "LgplAny", "LGPL-2.1-or-later"),
    ("library", "Library General Public License", ";", "2", "LgplAny", "LGPL-2.1-or-later"), ("program", "Affero General Public License", ";", "3", "AgplAny", "AGPL-3.0-or-later"),
]


def test_gnu_notices_as_worded(spark):
    rows = [(i, NOTICE.format(what=n[0], name=n[1], cut=n[2], version=n[3])) for i, n in enumerate(NOTICES)]
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.verdict) for r in s.scan(brute.frame(spark, rows)).collect()}
    assert got == {i: (f"{n[4]},{n[4][:-3].rstrip('23')}Copy", n[5], "copyleft") for i, n in enumerate(NOTICES)}


# Notices and texts as the licences' publishers word them.
MIT_WHOLE = MIT.replace("EXPRESS OR IMPLIED.", """EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.""")
ISC = """Copyright 2020 Someone

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted%s.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DAMAGES."""
KEPT = ", provided that the above copyright notice and this permission notice appear in all copies"
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
EPL = """ * This program and the accompanying materials are made available under
 * the terms of the Eclipse Public License %s which is available at https://www.eclipse.org/legal/"""
APACHE = """Copyright 2020 Someone. All rights reserved.

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
WORDED = [
    (MIT_WHOLE, "MIT", "permissive"), (ISC % KEPT, "ISC", "permissive"), (ISC % "", "0BSD", "permissive"), ((ISC % KEPT).replace("and/or", "and"), "ISC", "permissive"),
    (MPL, "MPL-2.0", "copyleft"), (EPL % "v. 2.0", "EPL", "copyleft"), (EPL % "v1.0", "EPL", "copyleft"), (EPL % "2.0", "EPL", "copyleft"), (APACHE, "Apache-2.0", "permissive"),
    ("Copyright (c) 2020, The Authors.\nAll rights reserved.\n\n" + BSD3, "BSD-3-Clause", "permissive"), ("Copyright (c) 2020, The Authors. All rights reserved.\n\n" + BSD2, "BSD-2-Clause", "permissive"),
    (BSD3.replace(" * Neither", " * All advertising materials mentioning features or use of this software must display the following acknowledgement: x.\n * Neither"), "BSD-4-Clause", "permissive"),
    ("Released under the GNU GPL v. 2.", "GPL-2.0", "copyleft"), ("Released under the GNU GPLv3.", "GPL-3.0", "copyleft"), ("Released under the GNU GPL.", "GPL", "copyleft"),
    ("Released under MIT.", "MIT", "permissive"), ("Distributed under the BSD.", "BSD", "permissive"), ("Licensed under Apache 2.0.", "Apache-2.0", "permissive"),
    ("modify it under the terms of version 3 of the GNU General Public License as published by the Free Software Foundation.", "GPL-3.0", "copyleft"),
    ("Use it by version 2 of the GNU General Public License, or (at your option) any later version.", "GPL-2.0-or-later", "copyleft"),
    ("Version 2.1 of the GNU Lesser General Public License applies.", "LGPL", "copyleft"), ("Version 3 of the GNU Affero General Public License applies.", "AGPL-3.0", "copyleft"),
    ("You should have received a copy of the GNU General Public License along with it.", "GPL", "copyleft"),
    ("You should have received a copy of the GNU Lesser General Public License along with it.", "LGPL", "copyleft"),
    ("You should have received a copy of the GNU Affero General Public License along with it.", "AGPL-3.0", "copyleft"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND", "noncommercial"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA", "noncommercial"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND", "noderivatives"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY", "permissive"), ("Creative Commons Zero.", "CC0-1.0", "permissive"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense", "permissive"), ("All rights reserved.", "All-Rights-Reserved", "restricted"),
    ("Released under the MIT umbrella.", "", "none"), ("Copyright 2020 Someone.", "", "none"), ("Volume v. 2 of the works.", "", "none"),
]


def test_published_notices(spark):
    rows = [(i, c[0]) for i, c in enumerate(WORDED)]
    got = {r.doc_id: (r.licenses, r.verdict) for r in s.scan(brute.frame(spark, rows)).collect()}
    assert got == {i: c[1:] for i, c in enumerate(WORDED)}


def test_other_semicolons_still_cut(spark):
    text = "All rights reserved; copyright 2020 x; either way, released under the MIT license; nothing else"
    assert [r.sentence_ids for r in s.scan(brute.frame(spark, [(1, text)])).collect()] == ["AllRights,Copyright,MitRef"]
