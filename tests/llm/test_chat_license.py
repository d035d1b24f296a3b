import random

import duckdb

from tests.llm.helpers import docs
from tidemark.llm import chat, license
from tidemark.llm.license_texts import NOTICES, TEXTS
from tidemark.llm.queries import CHAT_SQL


def conversations(spark, convs):
    rows = [(c, i, r, t, "extra", 1) for c, turns in convs for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string, at long")


def brute(convs):
    norm = {c: [(r or "", t or "") for r, t in turns] for c, turns in convs}
    out = {}
    for c, turns in norm.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in norm.values()):
            continue
        if any(o == turns and d < c for d, o in norm.items()):
            continue
        out[c] = (len(turns), sum(o == turns for o in norm.values()), "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns))
    return out


def test_snapshots_collapse(spark):
    u, a = ("user", "hi"), ("assistant", "hello")
    long = [("user", str(i % 7)) for i in range(900)]
    convs = [(1, [u]), (2, [u, a]), (3, [u, a, u]), (4, [u, a, u]), (5, [u, u]), (6, [(None, None)]), (7, [a]), (8, long), (9, long[:300]), (10, long[:899] + [a]), (11, [u, a, ("user", "")])]
    got = chat.collapse(conversations(spark, convs))
    assert {r.conv_id: (r.n_turns, r.n_logged, r.rendered) for r in got.collect()} == brute(convs)
    assert chat.collapse(conversations(spark, [])).count() == 0


def test_equal_turn_numbers_and_repeated_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "user", "c"), (1, 1, "user", "c"), (2, 0, "user", "a"), (2, 0, "user", "b"), (2, 1, "user", "c"), (3, 0, "user", "a"), (3, 0, "user", "b")]
    for own in (rows, rows[::-1]):
        got = chat.collapse(spark.createDataFrame(own, "conv_id long, turn long, role string, text string")).collect()
        assert [(r.conv_id, r.n_turns, r.n_logged) for r in got] == [(1, 4, 1)]  # the others are prefixes of it
        assert sorted(got[0].rendered.split("<|end|>\n"))[1:] == [f"<|user|>\n{t}\n" for t in "abcc"]


def test_null_conversations(spark):
    """Each row without a conv_id is a conversation of one turn, by the SQL too."""
    rows = [(None, 0, "user", "x"), (None, 1, "user", "x"), (None, None, None, None), (None, 4, "user", "y"), (None, 4, "user", "z"), (1, 0, "user", "y"), (2, 0, "user", "z"), (2, 1, "user", "x"), (3, None, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in chat.collapse(df).collect()), key=str)
    x = [f"<|user|>\n{t}\n<|end|>\n" for t in "xyz"]
    assert got == sorted([(None, 1, 2, x[0]), (None, 1, 1, "<||>\n\n<|end|>\n"), (1, 1, 3, x[1]), (2, 2, 1, x[2] + x[0])], key=str)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(con.sql(CHAT_SQL).fetchall(), key=str) == got


def test_full_blocks_are_cut_again(spark):
    """Turns without a number or with equal ones come to the same prefixes, however they are cut."""
    r = random.Random(5)
    turn = lambda: (r.choice([None, 0, 3, 3, 700]), r.choice(["user", "assistant", None]), f"t{r.randrange(400)}")
    rows = [(c, *turn()) for c in range(3) for _ in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = lambda df: sorted(tuple(x) for x in df.collect())
    whole = key(chat.prefixes(df, full=10**9))
    assert len(whole) == len(rows) and key(chat.prefixes(df, full=20)) == whole == key(chat.prefixes(df, block=7, full=1))
    assert [n for _, n, m, *_ in whole] == [*range(1, 501)] * 3


def test_licenses(spark):
    mit = dict(TEXTS)["MIT"]
    spelt = mit.upper().replace("COPYRIGHT (C) <YEAR> <HOLDERS>", "Copyright 2019 Somebody\nAll rights reserved.").replace("LICENSE", "LICENCE").replace(" ", "  ", 5)
    texts = [mit, spelt, mit + " more", None, "", "text\nReleased under the MIT licence\nx", "released under the MIT License, or not", "Licensed under CC BY-NC 4.0.", "x", f"Words before\n-----\n{mit}\n=====\nand after", "SPDX-License-Identifier: Apache-2.0\ncode", "filler words \n" * 40_000 + "Licensed under CC BY 4.0."]
    rows = license.scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.license_id for r in rows] == ["MIT", "MIT", None, None, None, None, None, "CC-BY-NC-4.0", None, None, None, None]
    assert [r.part_ids for r in rows] == ["", "", "", "", "", "MIT", "", "CC-BY-NC-4.0", "", "MIT", "Apache-2.0", "CC-BY-4.0"]
    twice = docs(spark, [mit, mit, None]).selectExpr("if(doc_id = 1, null, 0L) as doc_id", "text", "text as digest", "text as parts")
    assert sorted(str(r.license_id) for r in license.scan(twice.unionByName(twice)).collect()) == ["MIT"] * 4 + ["None"] * 2
    own = license.known_texts(spark, [("Mine", "Do as\n\nyou like.")], [("Mine", "SPDX: Mine")])
    got = license.scan(docs(spark, ["DO AS you like", "a\nSPDX - mine\nb"]), own).orderBy("doc_id").collect()
    assert [(r.license_id, r.part_ids) for r in got] == [("Mine", "Mine"), (None, "Mine")]
    assert license.scan(docs(spark, [])).count() == 0


def test_licenses_that_name_their_holder(spark):
    bsd = dict(TEXTS)["BSD-3-Clause"]
    regents = bsd.replace("the copyright holder nor the names of its contributors", "the University nor the names of its contributors").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS")
    foo = bsd.replace("the copyright holder nor", "Foo Inc., nor").replace("COPYRIGHT HOLDERS AND", "Foo, Inc. and")
    assert regents.count("REGENTS") == 2 and foo.count("Foo") == 2
    two = dict(TEXTS)["BSD-2-Clause"].replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE AUTHOR AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "THE AUTHOR OR CONTRIBUTORS")
    other = bsd.replace("may be used to endorse", "may not be used to endorse")
    rows = license.scan(docs(spark, [regents, foo, two, other, f"head\n----\n{regents}\n----\ntail"])).orderBy("doc_id").collect()
    assert [(r.license_id, r.part_ids) for r in rows] == [("BSD-3-Clause", ""), ("BSD-3-Clause", ""), ("BSD-2-Clause", ""), (None, ""), (None, "BSD-3-Clause")]


def test_every_known_text_is_itself(spark):
    texts = [t for _, t in TEXTS] + [n for _, n in NOTICES]
    rows = license.scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.license_id for r in rows[: len(TEXTS)]] == [k for k, _ in TEXTS]
    assert [r.part_ids for r in rows[len(TEXTS) :]] == [k for k, _ in NOTICES]


def test_long_licenses(spark):
    from pathlib import Path

    files = {"Apache-2.0": "Apache-2.0", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3"}
    files |= {"MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3"}
    texts = [Path("/usr/share/common-licenses", f).read_text() for f in files.values()]
    rows = license.scan(docs(spark, [*texts, *(t.upper().replace(" ", "  ") for t in texts), texts[0][:-200]])).orderBy("doc_id").collect()
    assert [r.license_id for r in rows] == [*files, *files, None]
