import re

from ledgerloom.llm import license_scan as L
from ledgerloom.llm.queries import op3_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    places = [(i, label) for label, phrase in L.PHRASES for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def scanned(docs, texts):
    rows = L.scan(docs(list(enumerate(texts)))).collect()
    return {r["doc_id"]: r for r in rows}


def base(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


TEXTS = [
    None, "", "...", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "under the\nMIT/license under the mit license", "Apache License, Version 2.0 and apache-license version_2", "under the mit licenses", "under mit license the",
    "Kelvin K under the mit license É", "x " * 30_000 + "CC BY NC " * 3, "cc by cc by nc by nc", "mit", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.",
    "Permission is hereby granted, free of charge, to any person getting hold of a copy of this software and the associated documentation files (the 'Software'), to deal in the Software without restriction",
]


def test_base_is_exact(docs):
    out = scanned(docs, TEXTS)
    for i, text in enumerate(TEXTS):
        assert base(out[i]) == brute(text), text
        assert set(filter(None, out[i]["base_labels"].split(","))) <= set(filter(None, out[i]["labels"].split(",")))
        assert 0 <= out[i]["score"] <= 1


def test_notices_with_changes(docs):
    out = scanned(docs, TEXTS)
    assert out[13]["labels"] == "gpl-3" and out[14]["labels"] == "all-rights-reserved"
    assert out[15]["labels"] == "mit" and 0.6 <= out[15]["score"] < 1
    assert out[2]["labels"] == "" and out[2]["score"] == 0.0


def test_each_notice_has_its_own_label(docs):
    filler = "Some prose, which says nothing at all about it; "
    texts = [filler * 3 + text + ". " + filler * 2 for _, text in L.NOTICES] + [filler + "licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"]
    out = scanned(docs, texts)
    for i, (label, text) in enumerate(L.NOTICES):
        assert set(out[i]["labels"].split(",")) == {label}, text
        assert out[i]["score"] == 1.0
    assert out[len(texts) - 1]["labels"] == "cc-by-nc-sa"


#: Notices as authors publish them, not from the list, and their labels.
PUBLISHED = [
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."),
    ("gpl", "This file is part of Foo. Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("agpl", "This work is licensed under the GNU Affero General Public License version 3."), ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl", "The tool is licensed under the GNU Affero General Public License version 3."), ("lgpl", "Code licensed under the GNU Lesser General Public License version 2.1"),
    ("gpl-2", "The driver is licensed under the GNU General Public License version 2."), ("gpl-3", "The driver is licensed under the GNU General Public License, version 3."),
    ("gpl", "It was released under the terms of the GNU General Public License."), ("bsd", "Released under the BSD license."), ("mit", "Released under the MIT License."),
    ("cc-by", "This article is licensed under the Creative Commons Attribution 3.0 International License."), ("cc-by-nc", "Text is licensed under the Creative Commons Attribution-NonCommercial 3.0 International License"),
    ("cc-by-sa", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"), ("cc-by-nc-nd", "licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License);"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

NO_NOTICE = [
    "The report was released under the new freedom of information law.", "They studied under the MIT faculty for years.", "He was released under the terms of the agreement.", "released under the supervision of the court",
    "She was licensed under the state law of 1990.", "under the terms of the general agreement as published by the free press foundation", "The film was released under the title of the book.", "an apache license plate version",
    "licensed under the creative direction of the studio", "redistribution and use in schools", "permission is hereby granted to leave", "all rights and duties reserved", "The MIT license office closed", "licensed under the Apache License, Version 1.1",
    "This work is licensed under the GNU General Public License version 1", "the public license of the general", "subject to the terms of the lease", "released under a BSD flag", "free software is fun, you can use it", "library of the free software foundation",
]


def test_published_notices_and_near_misses(docs):
    filler = "Some prose that says nothing at all about it; "
    out = scanned(docs, [filler + t + " " + filler for _, t in PUBLISHED] + [filler + t + " " + filler for t in NO_NOTICE])
    wrong = [(t, out[i]["labels"]) for i, (label, t) in enumerate(PUBLISHED) if out[i]["labels"] != label]
    wrong += [(t, out[len(PUBLISHED) + i]["labels"]) for i, t in enumerate(NO_NOTICE) if out[len(PUBLISHED) + i]["labels"]]
    assert not wrong


def test_notices_side_by_side(docs):
    gpl, lgpl = (next(t for label, t in L.NOTICES if label == x) for x in ("gpl", "lgpl"))
    out = scanned(docs, [f"{gpl} and {lgpl}", f"{lgpl} {lgpl}", gpl.replace("redistribute", "copy") + " all rights reserved"])
    assert [out[i]["labels"] for i in range(3)] == ["gpl,lgpl", "lgpl", "all-rights-reserved,gpl"]


def test_repeated_rows_and_empty_table(docs):
    rows = [(1, "under the mit license"), (1, "under the mit license"), (1, "other"), (None, "cc by nc")]
    out = sorted((r["doc_id"] or 0, r["n_words"], r["n_base"]) for r in L.scan(docs(rows)).collect())
    assert out == [(0, 3, 1), (1, 1, 0), (1, 4, 1), (1, 4, 1)]
    assert L.scan(docs([])).collect() == []


def test_query_against_brute_force(spark, tiny):
    got = {r["doc_id"]: r for r in op3_license_scan(spark, tiny).collect()}
    for r in spark.read.parquet(f"{tiny}/documents.parquet").collect():
        assert base(got[r["doc_id"]]) == brute(r["text"])


def test_no_python_in_the_plan(spark, tiny):
    assert "Python" not in op3_license_scan(spark, tiny)._jdf.queryExecution().executedPlan().toString()
