import pytest

from tidewake.llm import license_scan as L


@pytest.fixture(scope="module")
def model(spark):
    texts = [("the of and to " * 5 + f"word{i} other{i % 3} text.\nSecond line number {i}",) for i in range(40)]
    return L.train(spark.createDataFrame(texts, "text string"))


def test_families_unknown_and_clean(docs, clashing, model):
    texts = ["text before\n" + t[0] + "\ntext after" for t in L.TEMPLATES.values()]
    texts += ["no such notice here, only words of a story about the sea", "She renewed her driving license at the public office last week", None, "", "\n\n \n", "all rights reserved.\nReleased under the MIT License.", "z " * 50_000 + "\nAll rights reserved."]
    out = {r.doc_id: r for r in L.scan(clashing(docs(texts)), model).collect()}
    names = list(L.TEMPLATES)
    for i, family in enumerate(names):
        assert out[i].families == [family], (family, out[i])
    n = len(names)
    assert [out[n + k].families for k in (0, 1, 2, 3, 4)] == [[]] * 5
    assert out[n + 5].families == ["mit", "proprietary"] and out[n + 5].n_units == 2
    assert out[n + 6].families == ["proprietary"]
    assert model.temperature > 0


def test_wrapped_blocks_rows_and_empty(docs, model):
    wrapped = "intro\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction\n\nend"
    out = L.scan(docs([(None, wrapped), (None, wrapped)]), model).collect()
    assert [r.families for r in out] == [["mit"], ["mit"]]
    assert L.scan(docs(["x"]).limit(0), model).count() == 0


def wrapped_in(text, k):
    w = text.split()
    n = -(-len(w) // k)
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


def test_wrapped_notices_without_blank_lines(docs, model):
    families = ["mit", "bsd", "gpl", "lgpl", "agpl", "public-domain"]
    alone = [(f, wrapped_in(L.TEMPLATES[f][0], k)) for f in families for k in (2, 3, 4, 5)]
    story = [L.ORDINARY[i % len(L.ORDINARY)] for i in range(120)]
    cases = [(f, head + tail) for f, head in alone for tail in ("", "\n" + "\n".join(story[:5]), "\n" + "\n".join(story))]
    cases += [(None, "\n".join(story))]
    out = {r.doc_id: r for r in L.scan(docs([t for _, t in cases]), model).collect()}
    assert [i for i, (f, _) in enumerate(cases) if f and f not in out[i].families] == []
    assert out[len(cases) - 1].families == []
    assert out[0].n_units == 1  # one notice is one, though line, block and window may see it


def test_features_are_template_grams(spark):
    assert all(not L.STOP.issuperset(g.split()) for g in L.VOCABULARY)
    row = spark.createDataFrame([("Licensed under the MIT-License!",)], "t string").select(L._features(L.words(L.F.col("t"))).alias("g")).first()
    assert row.g == ["licensed", "under", "the", "mit", "license", "licensed under", "under the", "the mit", "mit license"]


#: Wordings that training hasn't seen; None: a notice of no known family.
HELD_OUT = [
    ("mit", "This module is free; it is distributed under the terms of the MIT licence"), ("mit", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file"),
    ("mit", "Code in this folder: MIT License (c) 2019 the authors"), ("bsd", "This tool may be used and copied under the 2-clause BSD license"), ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "Redistribution and use in source and binary forms are permitted provided that the following conditions are met by the user"), ("apache", "The sources are licenced under Apache-2.0, see below"),
    ("apache", "You may obtain this under the Apache License Version 2.0 from the project page"), ("gpl", "The program is licensed under GPL version 2 or later"), ("gpl", "Released as free software under the GNU General Public Licence"),
    ("gpl", "// SPDX-License-Identifier: GPL-2.0-only"), ("lgpl", "You can link with it under the terms of the GNU LGPL 2.1"), ("lgpl", "covered by the Lesser General Public License of GNU, license text attached"),
    ("agpl", "Server code is licensed under the GNU Affero GPL version 3"), ("agpl", "License: AGPLv3"), ("mpl", "Published under Mozilla Public Licence version 2"), ("mpl", "license = MPL-2.0"),
    ("cc-by", "Pictures are licensed under CC BY 4.0 by the museum"), ("cc-by-sa", "Text is licensed under Creative Commons Attribution-ShareAlike 3.0 unless noted"), ("cc-by-nc", "Lessons licensed CC-BY-NC-4.0, not for sale"),
    ("public-domain", "The author dedicated the work to the public domain under CC0 1.0"), ("proprietary", "Copyright 2021 Example Ltd. All rights reserved."), ("public-domain", "This is unencumbered software released into the public domain, free for all"),
    (None, "SPDX-License-Identifier: ISC"), (None, "Distributed under the Boost Software License, Version 1.0"), (None, "This program and the materials are made available under the Eclipse Public License v2.0"),
    (None, "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"), (None, "zlib license, see header"), (None, "licensed under the Artistic License 2.0"), (None, "Released under the EUPL-1.2"),
]
CLEAN = [
    "The apache tribe lived in the south west", "He asked permission to copy the recipe from the book", "Anyone may walk in the park at any time", "The general reserved a table under the tree",
    "Her driving license was renewed in spring", "The distribution of rain in May was even", "The public library opens at nine", "A new version of the play was released", "The terms of the treaty were harsh",
    "They studied computer science at MIT", "The work is done and the tools are clean", "Human rights are not for sale", "The software crashed twice this week", "Free tickets are available at the gate",
]


def test_wordings_held_out(docs, model):
    texts = [t for _, t in HELD_OUT] + CLEAN
    out = sorted(L.scan(docs(texts), model).collect(), key=lambda r: r.doc_id)
    told = [r.families for r in out]
    right = sum(t == [f] for t, (f, _) in zip(told, HELD_OUT, strict=False) if f)
    known = sum(f is not None for f, _ in HELD_OUT)
    wrong = [(t, x) for t, x, (f, _) in zip(told, texts, HELD_OUT, strict=False) if t and t != [f]] + [(t, x) for t, x in zip(told[len(HELD_OUT) :], CLEAN, strict=True) if t]
    missed = [(t, x) for t, x, (f, _) in zip(told, texts, HELD_OUT, strict=False) if f and t != [f]]
    assert right >= 0.9 * known, missed
    assert len(wrong) <= 0.05 * (right + len(wrong)), wrong
    unknown = [r.n_unknown for r, (f, _) in zip(out, HELD_OUT, strict=False) if f is None]
    assert sum(n > 0 for n in unknown) >= 0.8 * len(unknown), unknown
    assert sum(r.n_unknown > 0 for r in out[len(HELD_OUT) :]) <= 1
