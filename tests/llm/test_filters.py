"""Quality rules, URL filters, decontamination and licence scans."""

import random

from pyspark.sql import functions as F

from tracemill.llm import decontaminate as dc
from tracemill.llm import licenses, quality
from tracemill.llm import url_filter as uf
from tests.llm.conftest import WORDS


def _slow_stats(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n")]
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text or ""), dup, len(covered)


def test_text_statistics_by_hand():
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(["a", "b ", "é\u2003", "\n", " ", "#", "aa", "\x0b", "%"]) for _ in range(r.randrange(40)))
        assert quality._text_stats(text) == _slow_stats(text)
    assert quality._text_stats(None) == (0, 0, 0, 0, 0)


def test_boilerplate_goes_and_copies_stay(spark, make_docs, prose):
    r = random.Random(1)
    footer = "subscribe now to read more of this"
    rows = [(i, prose(60, r) + "\n" + footer, "en", "s1") for i in range(30)]
    rows += [(100 + i, "\n".join([footer] * 12 + [prose(12, r)] + [footer] * 3), "en", "s1") for i in range(3)]  # little is left of these
    same = prose(70, r)
    rows += [(200 + i, same, "en", "s1") for i in range(40)]  # copies repeat their surroundings
    rows += [(300, prose(60, r) + "\n" + footer, "en", "s2")]  # another host
    docs = make_docs(rows)
    report = {x.doc_id: x for x in quality.quality_report(docs).collect()}
    assert len(report) == len(rows)
    assert all(report[i].kept and report[i].removed_words == 7 for i in range(30))
    assert not any(report[100 + i].kept for i in range(3))
    assert all(report[200 + i].kept and report[200 + i].removed_words == 0 for i in range(40))
    assert report[300].kept and report[300].removed_words == 0
    kept = {x.doc_id: x for x in quality.quality_rules(docs).collect()}
    assert set(kept) == {i for i, x in report.items() if x.kept}
    assert footer not in kept[0].text and kept[0].n_chars == len(kept[0].text) and footer in kept[300].text


def test_boilerplate_of_any_surroundings(spark, make_docs, prose):
    r = random.Random(2)
    banner, footer = ["=====", "home about contact press", "sign in or join now", "====="], "all content of this site is free to read"
    rows = [(i, "\n".join(banner) + "\n\n" + prose(60, r) + "\n\n" + footer + "\n\n" + prose(20, r), "en", "s1") for i in range(25)]  # one surrounding each
    rows += [(100 + i, rows[0][1], "en", "s1") for i in range(60)]  # copies of one of them weigh once
    few = "\n\n" + "a line of twenty texts and their copies"
    rows += [(200 + i, prose(60, random.Random(i % 20)) + few, "en", "s1") for i in range(80)]
    docs = make_docs(rows)
    report = {x.doc_id: x for x in quality.quality_report(docs).collect()}
    assert all(report[i].removed_words == 1 + 4 + 5 + 1 + 9 and report[i].kept for i in [*range(25), *range(100, 160)])
    assert all(report[200 + i].removed_words == 0 for i in range(80))
    kept = {x.doc_id: x.text for x in quality.quality_rules(docs).collect()}
    assert not any(line in kept[0] for line in [*banner, footer]) and few.strip() in kept[200]


def _with_edits(words, n, r):
    """So many substitutions, insertions and deletions."""
    words = list(words)
    for _ in range(n):
        p = r.randrange(len(words))
        kind = r.randrange(3)
        if kind == 0:
            words[p] = r.choice(WORDS)
        elif kind == 1:
            words.insert(p, r.choice(WORDS))
        else:
            del words[p]
    return words


def _all_pairs(docs, items, share):
    found = {}
    for d, text in docs:
        for i, item in items:
            edits, _ = dc.best_window(dc.words_of(item), dc.words_of(text))
            if dc.words_of(item) and edits <= int(share * len(dc.words_of(item))):
                found[d, i] = edits
    return found


def test_search_against_all_pairs(spark):
    r = random.Random(21)
    text = lambda n: [r.choice(WORDS) + str(r.randrange(20)) for _ in range(n)]
    items = [(i, " ".join(text(r.choice([6, 12, 25, 50, 90])))) for i in range(40)] + [(100, "one two"), (101, "yes"), (102, ""), (103, None)]
    docs = []
    for i in range(200):
        item = items[r.randrange(40)][1].split()
        docs.append((f"d{i}", " ".join(text(r.randrange(60)) + _with_edits(item, int(0.2 * len(item)), r) + text(r.randrange(60)))))
    docs += [("short", "say one, two!"), ("none", None), ("blank", " ")]
    want = _all_pairs([(d, t) for d, t in docs if t], [(i, t) for i, t in items if t], 0.2)
    d = spark.createDataFrame(docs, "doc_id string, text string")
    got = {(x.doc_id, x.item_id): x.edits for x in dc.find_items(d, spark.createDataFrame([(str(i), t) for i, t in items], "item_id string, text string")).collect()}
    want = {(a, str(b)): e for (a, b), e in want.items()}
    assert len(want) >= 180 and ("short", "100") in got
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.95 * len(want)
    clean = {x.doc_id for x in dc.without_items(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {"none", "blank", "short"} <= clean  # short items do not reject
    assert len(clean) <= 3 + 0.06 * 200


def test_exact_search_behind_the_walks():
    r = random.Random(22)
    items = [(i, " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))) for i, n in enumerate([300, 320, 400, 30])]
    screen = dc.Screen(items, share=0.4)
    exact = {screen.item_ids[m] for c in screen.classes if c.piece for m in c.members}
    assert len(exact) >= 3
    for i, text in items[: len(exact)]:
        words = text.split()
        for front in (0, 1):
            edited = _with_edits(words, int(0.4 * len(words)), r) if not front else ["x"] * int(0.4 * len(words)) + words[int(0.4 * len(words)):]
            assert i in screen.hits(["before it " + " ".join(edited) + " and behind"])[0]


def test_items_in_a_long_text(spark, prose):
    item = " ".join(f"only{i}" for i in range(30))
    docs = spark.createDataFrame([(1, prose(150_000) + " " + item), (2, prose(100_000))], "doc_id long, text string")
    got = dc.find_items(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(x.doc_id, x.item_id, x.edits) for x in got] == [(1, 7, 0)]


def test_footers_and_repeated_rows(spark, make_docs, prose):
    r = random.Random(3)
    footer = "read more on our site\nall rights belong to us\ncontact the editors"
    rows = [(i, prose(60, r) + "\n" + footer, "en", "s1") for i in range(100)]
    rows += [(200 + i, prose(60, r) + "\nfew have this", "en", "s3") for i in range(11)] * 2  # repeated rows are one document
    docs = make_docs(rows)
    report = {x.doc_id: x.removed_words for x in quality.quality_report(docs).collect()}
    counts = {}
    for text, host in {(t, h) for _, t, _, h in rows}:
        for line in set(text.split("\n")):
            counts[host, line] = counts.get((host, line), 0) + 1
    for i, text, _, host in rows:
        assert report[i] == sum(len(x.split()) for x in text.split("\n") if counts[host, x] > quality.MAX_LINE_DOCS)
    assert report[0] == 13 and report[200] == 0


def test_quality_of_a_long_text(spark, make_docs, prose):
    r = random.Random(4)
    lines = [f"a{i} b{i} c{i}" for i in range(100_000)]
    common = [f"common line number {k} here" for k in range(400)]
    rows = [(i, "\n".join([*common, prose(4000, r)]), "en", "s1") for i in range(30)] + [(99, "\n".join([*lines, *common * 50]), "en", "s1")]
    kept = {x.doc_id: x.text for x in quality.quality_rules(make_docs(rows)).collect()}
    assert kept[99] == "\n".join(lines)


def test_quality_of_odd_rows(spark, odd_docs):
    report = quality.quality_report(odd_docs).collect()
    assert len(report) == odd_docs.count()
    assert all(x.base_failed and not x.kept for x in report if x.doc_id in (2, 3, 4, 5))
    out = quality.quality_rules(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(str(x.doc_id) for x in out.collect()) == ["1", "1", "1", "6", "None"]
    empty = odd_docs.limit(0)
    assert quality.quality_report(empty).count() == 0 and quality.quality_rules(empty).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/de/", "block"), ("a.com", "", "block"), ("", "/x", "allow")]


def _slow_verdict(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p) and (h or host == "")]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_verdicts(spark):
    urls = ["http://EXAMPLE.org/es/1", "https://www.example.org/en/100?x=/es/", "http://example.org/en/2", "http://example.org", "http://badexample.org/es/", "x.org/", None, "", "http://a.com", "ftp://b.a.com/de/#q",
            "http://com/de/", "http://x?y://z.org/", "://org/", "http://org.//", "http:///x1", "http://é.org/é"]
    urls += urls[:3]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES[:5], uf.RULE_COLUMNS)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.url_verdicts(pages, rules).collect()}
    global_rules, RULES[:] = RULES[:], RULES[:5]
    assert got == {i: _slow_verdict(u) for i, u in enumerate(urls)}
    RULES[:] = global_rules
    assert uf.url_verdicts(pages, rules.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0
    assert uf.url_verdicts(pages.limit(0), rules).count() == 0


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_best_window_by_hand():
    r = random.Random(2)
    for _ in range(200):
        item = [r.choice("abc") for _ in range(r.randint(1, 7))]
        text = [r.choice("abc") for _ in range(r.randrange(9))]
        best = min(_edit(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert dc.best_window(item, text)[0] == best


def test_passages_are_found(spark, make_docs, prose):
    r = random.Random(3)
    items = [(i, prose(r.randint(15, 60), r)) for i in range(60)]
    rows, truth, clean = [], set(), set()
    for d in range(240):
        body = prose(r.randint(20, 300), r).split()
        if d % 2:
            i = r.randrange(60)
            words = items[i][1].split()
            for _ in range(r.randint(0, int(0.15 * len(words)))):
                words[r.randrange(len(words))] = r.choice(WORDS) + "x"
            at = r.randrange(len(body) + 1)
            body[at:at] = words
            truth.add((d, i))
        else:
            clean.add(d)
        rows.append((d, " ".join(body), "en", "s"))
    docs, bench = make_docs(rows), spark.createDataFrame(items, "item_id long, text string")
    found = dc.find_items(docs, bench).collect()
    pairs = {(x.doc_id, x.item_id) for x in found}
    assert len(pairs & truth) >= 0.95 * len(truth) and not {d for d, _ in pairs} & clean
    for x in found[:20]:  # each distance is that of some window
        item, text = dc.words_of(items[x.item_id][1]), dc.words_of(rows[x.doc_id][1])
        assert dc.best_window(item, text)[0] <= x.edits <= 0.2 * len(item)
    left = {x.doc_id for x in dc.without_items(docs, bench).collect()}
    assert clean <= left and left == set(range(240)) - {d for d, _ in pairs}


def test_decontamination_of_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "too short"), (2, None), (3, "never seen words stand here in a row")], "item_id long, text string")
    assert dc.find_items(odd_docs, items).count() == 0
    assert dc.without_items(odd_docs, items).count() == odd_docs.count()
    none = items.limit(0)
    assert dc.find_items(odd_docs, none).count() == 0 and dc.without_items(odd_docs, none).count() == odd_docs.count()


def test_licences(spark, make_docs):
    mit = "\n".join(licenses.SENTENCES["mit-grant"]) + "\n\n" + licenses.SENTENCES["mit-condition"][0] + "\n\n" + licenses.SENTENCES["as-is"][0]
    wrapped = mit.replace("software and", "software\nand").replace("KIND, EXPRESS", "KIND,\nEXPRESS")
    rows = [(1, mit, "en", "s"), (2, "Text.\n" + wrapped, "en", "s"), (3, "Hello. Released under the MIT License.\nmore", "en", "s"), (4, "no licence here", "en", "s"), (5, None, "en", "s"), (6, "", "en", "s"),
            (7, "Licensed under CC BY-NC 4.0.\nAll rights reserved.", "en", "s"), (8, licenses.SENTENCES["bsd-source"][0], "en", "s"), (8, licenses.SENTENCES["bsd-source"][0], "en", "s")]
    got = {r.doc_id: r for r in licenses.scan_licences(make_docs(rows)).collect()}
    assert set(got) == {1, 2, 3, 7, 8}
    assert got[1].licence == got[2].licence == got[3].licence == "MIT"
    assert got[1].sentence_ids == got[2].sentence_ids == ["mit-grant", "mit-condition", "as-is"] and got[3].sentence_ids == ["mit-line"]
    assert got[7].licences == ["CC-BY-NC-4.0", "all-rights-reserved"] and got[8].licence is None
    assert licenses.scan_licences(make_docs(rows).limit(0)).count() == 0


def test_tags_and_notices(spark, make_docs):
    gpl = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
           "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.")
    tags = [(1, "// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;"), (2, "SPDX-License-Identifier: (GPL-2.0-or-later AND BSD-2-Clause)"),
            (3, "SPDX-License-Identifier: CC0-1.0"), (4, gpl), (5, "SPDX-License-Identifier: NONE-OF-THESE"),
            (6, "a\nb\n" + "\n".join("All rights reserved.")), (7, "All\nrights\nreserved.")]
    got = {x.doc_id: x.licences for x in licenses.scan_licences(make_docs([(i, t, "en", "s") for i, t in tags])).collect()}
    assert got == {1: ["MIT", "Apache-2.0"], 2: ["BSD-2-Clause", "GPL-2.0-or-later"], 3: ["CC0-1.0"], 4: ["GPL-2.0-or-later"], 7: ["all-rights-reserved"]}


def test_licence_in_a_long_text(spark, make_docs):
    long = "word " * 300_000 + ".\nReleased under the MIT License.\n" + "x\n" * 100_000
    assert licenses.scan_licences(make_docs([(1, long, "en", "s")])).first().licence == "MIT"


def test_licences_of_odd_rows(odd_docs):
    assert licenses.scan_licences(odd_docs.withColumn("text", F.concat("text", F.lit("\nAll rights reserved.")))).count() == 7


_NOTICES = {
    "MIT": """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
_STEPS = {"MIT": ["mit-grant", "mit-condition", "as-is"], "Apache-2.0": ["apache-line", "apache-comply", "apache-basis"], "BSD-3-Clause": ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"],
          "GPL-3.0-or-later": ["gpl-free", "gpl-hope"], "LGPL-2.1-or-later": ["lgpl-terms", "version-2.1-or-later"], "MPL-2.0": ["mpl-line"]}


def _forms(text):
    lines = text.split("\n")
    yield text
    for mark in ("# ", " * ", "// ", "-- ", ";; "):
        yield "\n".join((mark + x).rstrip() for x in lines)
    yield "/*\n" + "\n".join((" * " + x).rstrip() for x in lines) + "\n */\nimport x;"
    yield "\r\n".join(lines)
    yield "\r\n".join(("# " + x).rstrip() for x in lines)
    yield "#!/bin/sh\n" + "\n".join(("# " + x).rstrip() for x in lines) + "\nset -e\n"


def test_notices_in_comments(make_docs):
    rows, want = [], {}
    for name, text in _NOTICES.items():
        for form in _forms(text):
            want[len(rows)] = name
            rows.append((len(rows), form, "en", "s"))
    got = {x.doc_id: x for x in licenses.scan_licences(make_docs(rows)).collect()}
    for i, name in want.items():
        assert i in got and got[i].licence == name, (name, rows[i][1])
        ids = iter(got[i].sentence_ids)
        assert all(step in ids for step in _STEPS[name]), (name, rows[i][1], got[i].sentence_ids)  # the longest rule


def test_rules_take_steps_in_order(spark):
    rules = [("abab", ["a", "b", "a", "b"]), ("aa", ["a", "a"]), ("bac", ["b", "a", "c"]), ("c", ["c"])]
    rows = [(i, 1, r, pos, x) for i, r, text in [(1, 0, "abab"), (2, 0, "ab"), (2, 1, "ba"), (3, 0, "xbxaxc"), (4, 0, "bbaab"), (None, 0, "c")] for pos, x in enumerate(text)]
    found = spark.createDataFrame(rows, "_id long, _text long, reading int, pos int, sentence_id string")
    got = {x._id: [rules[k][0] for k in x.fits] for x in licenses.fitting_rules(found, rules).collect()}
    assert got == {1: ["abab", "aa"], 3: ["bac", "c"], 4: ["aa"], None: ["c"]}
