import re

from eventrates.llm import license_clauses as clauses
from eventrates.llm import license_scan as scan
from eventrates.llm import queries
from tests.llm import odd

SF = "/root/testdata/sf0.001"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def slow(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return words, places


def slow_labels(words):
    """Labels after suppression, all rules tried at every anchor and all pairs of detections compared."""
    found = []
    for entries in scan.by_anchor(scan.rules()).values():
        for r in entries:
            if r["base"]:
                continue
            for i, w in enumerate(words):
                if w == r["anchor"]:
                    text = " ".join([*words[max(0, i - 24) : i], ">" + w, *words[i + 1 : i + 25]])
                    if m := re.search(r["pattern"], text):
                        start = i - (len(m[0].split(">")[0].split(" ")) - 1)
                        found.append((start, start + len(m[0].split(" ")), r["priority"], r["label"]))
    kept = set()
    for a in found:
        for b in found:
            wider = b[0] < a[0] or b[1] > a[1]
            if b[0] <= a[0] and b[1] >= a[1] and (b[2] < a[2] or b[2] == a[2] and wider):
                break
        else:
            kept.add(a[3])
    return kept


def check(rows):
    for r in rows:
        words, places = slow(r["text"])
        assert r["n_words"] == len(words)
        assert sorted((p["start"], p["label"]) for p in r["places"]) == sorted(places)
        assert r["base_labels"] == sorted({b for _, b in places})
        assert r["labels"] == sorted({b for _, b in places} | slow_labels(words))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


TEXTS = [
    "Licensed under the GNU General Public License, version 3 or later. CC BY cc-by Cc BY-SA 4.0",
    "MIT License MIT License mit licence. This is under the Apache License, Version 2.0.",
    "SPDX-License-Identifier: Apache-2.0 and BSD 3-Clause, new BSD license; All rights reserved",
    "cc by cc by cc by " * 200,
    "license " * 500 + "mit license",
    "Released under the terms of the Mozilla Public License version 2.0",
    "accc bymit licenseé mit licensé éMIT License ÉCC BY",
    "GNUİ General Public License gnu general\npublic--license",
]


def test_many_rules():
    rules = scan.rules()
    assert len(rules) > 300 and len(scan.by_anchor(rules)) > 12
    assert all(len(r.pattern.split(" ")) <= 2 * scan.REACH for r in rules)


def test_matches_loops(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    check(scan.scan(docs).collect())
    check(scan.scan(spark.read.parquet(f"{SF}/documents.parquet")).collect())


# Openings and notices as they stand in files, with their line breaks and marks.
HEADERS = {
    "MIT": """Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "BSD": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 * 1. Redistributions of source code must retain the above copyright
 *    notice, this list of conditions and the following disclaimer.""",
    "BSD-3-Clause": """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0": """# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#     http://www.apache.org/licenses/LICENSE-2.0
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL": """// This program is distributed in the hope that it will be useful,
// but WITHOUT ANY WARRANTY; without even the implied warranty of
// MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
// GNU General Public License for more details.""",
    "GPL-3.0": "a free, copyleft license. The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "OFL-1.1": "Neither the Font Software nor any of its individual components, in Original or Modified Versions, may be sold by itself.",
    "CC-BY": "You must give appropriate credit, provide a link to the license, and indicate if changes were made.",
}


def sample(pattern):
    """A text that a clause's pattern matches: each choice by its first form."""
    pattern = re.sub(r"\(\?:\[\^ >\]\+ \)\{\d+,\d+\}", "acme works ", pattern)
    while "(?:" in pattern:
        pattern = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", pattern)
    pattern = re.sub(r"\[(\w)\w\]", r"\1", pattern)
    return re.sub(r" +", " ", pattern.replace("?", "").replace(">", ""))


def test_clauses(spark):
    every = clauses.clauses()
    assert len(every) > 200 and len({p for _, p, _, _ in every}) == len(every)
    rows = [(i, label, sample(p)) for i, (label, p, _, _) in enumerate(every)]
    rows += [(1000 + i, label, text) for i, (label, text) in enumerate(HEADERS.items())]
    found = scan.scan(spark.createDataFrame(rows, "doc_id long, label string, text string").repartition(8)).collect()
    missed = [(r["label"], r["text"], r["labels"]) for r in found if r["label"] not in r["labels"]]
    assert not missed
    assert all(clauses.keyword(p) for _, p, _, _ in every)


def test_suppression(spark):
    rows = scan.scan(spark.createDataFrame([(0, TEXTS[0]), (1, TEXTS[1])], "doc_id long, text string")).collect()
    assert "GPL-3.0-or-later" in rows[0]["labels"] and "GPL-3.0" not in rows[0]["labels"]
    assert "CC-BY-SA-4.0" in rows[0]["labels"]
    assert "Apache-2.0" in rows[1]["labels"] and "apache" in rows[1]["base_labels"]


def test_odd_rows(spark):
    docs = odd.documents(spark).withColumnRenamed("row", "labels")
    rows = scan.scan(docs).collect()
    assert len(rows) == len(odd.rows())
    check(rows)
    assert scan.scan(odd.empty(spark)).count() == 0


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_licenses(spark, SF).collect()
    assert len(rows) == 200
    for r in rows:
        words, places = slow(texts[r["doc_id"]])
        starts = [p for p, _ in places]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({b for _, b in places}))
