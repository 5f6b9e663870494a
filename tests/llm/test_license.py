"""The license scan against its SQL, on real wordings and on hard pages."""

import duckdb
import pytest

from arterial.llm import license
from arterial.llm.queries import op5_sql
from arterial.llm.templates import TEMPLATES, WORDINGS, plain_words

PAGES = "page_id long, url string, html string, path string, license string, row long, words string"
APACHE = "<p>Licensed under the Apache License, Version 2.0.</p>"
COLUMNS = ["page_id", "path", "license", "score", "inherited", "inherited_from"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 5, "clash") for r in rows], PAGES).repartition(3)


def text_of(name, key):
    return next(t for n, k, t in WORDINGS if (n, k) == (name, key))


def commented(text, mark, width=60):
    """The text as a source file has it: wrapped, a mark before each line."""
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line += f" {w}"
    return "\n".join(f"{mark}{x}" for x in [*lines, line])


@pytest.fixture(scope="module")
def rows():
    words = "the of and in a work is under version license licensed all rights public alpha beta gamma delta mit cc gnu".split()
    out = [
        (1, "https://h.org/a/b/c.html?x=1", "<p>plain words only</p>"),
        (2, "https://h.org/a/LICENSE", f"<h1>t</h1>{APACHE}"),
        (3, "https://h.org/a/b/d", "All rights reserved.\nmore"),
        (4, "https://h.org/a/b/e/f#top", ""),
        (5, "http://h.org", None),
        (6, None, APACHE),
        (7, "https://k.org/x", "Released under the MIT License."),
        (7, "https://k.org/x", "Released under the MIT License."),
        (7, "https://k.org/x", "another text"),
        (8, "https://k.org/y/z", "no words here " * 20_000 + "&copy; a < b & c <i>All</i> rights\nreserved" + " x" * 5_000),
        (9, "https://k.org/q/", "licensed under the apache license version 2.0 and some words"),
        (None, "https://k.org/n", "Licensed under CC BY-NC 4.0."),
        (10, "https://h.org/a/g", "Released under the MIT License."),
        (11, "https://h.org/a/h", "Released under the MIT License."),
        (12, "https://home.org", APACHE),
        (13, "https://home.org/p/q", "plain"),
        (14, "https://docs.org/d/", APACHE),
        (15, "https://docs.org/d/x", "plain"),
        (16, "https://docs.org/e", "plain"),
        (17, "", "All rights reserved"),
        (18, "https://top.org/LICENSE.txt", "MIT License"),
        (19, "https://top.org/", "plain"),
    ]
    for i in range(40):
        text = " ".join(words[(i * 7 + j * j) % len(words)] for j in range(i % 17))
        out.append((100 + i, f"https://m.org/{i % 5}/{i % 3}/{i}", f"<p>{text}</p>{APACHE if i % 9 == 0 else ''}"))
    return out


def test_scan_equals_sql(spark, rows):
    pages = frame(spark, rows)
    found = license.scan(pages).select(*COLUMNS).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted(str(tuple(r)) for r in found) == sorted(str(r) for r in con.execute(op5_sql()).fetchall())
    by = {r.page_id: r for r in found}
    assert (by[1].inherited, by[1].inherited_from) == ("all-rights-reserved", "h.org/a/b")
    assert by[2].license == "apache-2.0" and by[4].inherited_from == "h.org/a/b" and by[8].license == "all-rights-reserved"
    # index pages give to their own directory and take from it
    assert (by[13].inherited, by[15].inherited, by[16].inherited, by[19].inherited) == ("apache-2.0", "apache-2.0", None, "mit")
    # rows of one id and url are pages of their own
    assert sorted(str(r.license) for r in found if r.page_id == 7) == ["None", "mit", "mit"]


def test_no_pages(spark):
    assert license.scan(frame(spark, []).limit(0)).count() == 0


def test_templates_have_their_key_once():
    assert len({t.license for t in TEMPLATES}) >= 20
    assert all(t.words.count(t.key) == 1 for t in TEMPLATES)


def test_licences_as_they_are_found(spark):
    """Every wording as a wrapped comment, in markup, and as a licence file
    between other words; with some words changed."""
    want, html = [], []
    for n, (name, _, text) in enumerate(WORDINGS):
        links = " ".join(f"<a href='x'>{w}</a>" if i % 3 == 0 else w for i, w in enumerate(text.split()))
        file = f"Copyright (c) 20{n:02} The Authors of This\n\n{text}\n\nSome words follow that no licence has."
        for page in (f"<pre>{commented(text, '// ')}\nint main() {{}}</pre>", f"<p>before it</p><div>{commented(text, ' * ')}</div>", f"<p>{links}</p>", file):
            want.append(name)
            html.append(page)
    for name in dict.fromkeys(t.license for t in TEMPLATES if t.words[0] == "spdx"):
        want.append(name)
        html.append(f"<pre># SPDX-License-Identifier: {name.upper()}\nimport os</pre>")
    changed = [
        ("mit", text_of("mit", "sublicense").replace("obtaining", "receiving").replace("associated ", "")),
        ("bsd-3-clause", text_of("bsd-3-clause", "endorse").replace("the copyright holder", "Example Corp.")),
        ("gpl-3.0", text_of("gpl-3.0", "redistribute").replace("This program", "The Example")),
        ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation"),
        (None, "SPDX-License-Identifier: Something-Else"), (None, "We want you to mention the GNU tools of June."), (None, "Neither the public nor any license was granted."),
    ]
    want += [w for w, _ in changed]
    html += [h for _, h in changed]
    filler = [f"alpha{i} the of and a is to in or this software may be used for any purpose beta{i % 7}" for i in range(200)]
    pages = frame(spark, [(i, f"https://s{i}.org/x", h) for i, h in enumerate(html + filler)])
    found, tables = license.declared(pages)
    got = {r.page_id: r.license for r in found.collect()}
    right = [got[i] == w for i, w in enumerate(want)]
    wrong = [(w, got[i], html[i][:60]) for i, w in enumerate(want) if not right[i]]
    assert sum(right) / len(right) >= 0.97, wrong
    assert not any(got[i] for i in range(len(html), len(html) + len(filler)))
    assert [got[want.index(None) + i] for i in range(3)] == [None] * 3
