"""Text operators do the whole job, wherever lines break and however long a text is."""

import pathlib
import textwrap

import pytest

from cairn.llm import licenses


SAID = ("Copyright (c) 2020-2024 The Very Long Example Company, Inc. and John Q. Public. All rights reserved.", "© 2019 Example", "Copyright 2001, 2003 by A. Person <a@example.com>", "Copyright Example Authors\nCopyright Other Authors")


def wrapped(text: str, widths) -> list[str]:
    paragraphs = [" ".join(p.split()) for p in text.split("\n\n")]
    return ["\n\n".join(textwrap.fill(p, width) for p in paragraphs) for width in widths]


@pytest.mark.parametrize("name", sorted(licenses.LICENCES))
def test_licences_do_not_depend_on_line_breaks(spark, name):
    """With and without titles and copyright statements of several kinds, wrapped at 12 widths, unwrapped, and on one line."""
    text = licenses.LICENCES[name]
    texts = [text, *("\n\n".join(x for x in (title, said, text) if x) for title in ("", *licenses.TITLES[name]) for said in ("", *SAID))]
    made = []
    for t in texts:
        made += wrapped(t, (*range(50, 105, 5), 10**6))
        made.append(t)
        if "Example Authors" not in t:  # without sign and year, nothing on one line tells where holders end
            made.append(" ".join(t.split()))
    rows = licenses.licences(spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")).collect()
    assert len(rows) == len(made) and [made[r["doc_id"]] for r in rows if r["license_id"] != name] == []
    assert {r["digest"] for r in rows} == {licenses.digest(licenses.canonical_text(t, True)) for t in texts}


@pytest.mark.parametrize("name", sorted(licenses.LICENCES))
def test_licences_with_one_condition_changed_are_others(spark, name):
    text = licenses.LICENCES[name]
    words = text.split(" ")
    made = [" ".join([*words[:i], "not", *words[i:]]) for i in range(0, len(words), 7)] + [" ".join(words[:i] + words[i + 1 :]) for i in range(0, len(words), 7) if words[i].strip('"').isalpha()]
    made += [f"Copyright (c) 2020 Somebody\n\n{text}\n\nEach copy costs ten dollars.", f"You pay ten dollars.\n\n{text}", text.replace("copyright notice", "copyright notice is sold back to us for ten dollars", 1) if "copyright notice" in text else f"{text} no"]
    rows = licenses.licences(spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")).collect()
    assert [made[r["doc_id"]] for r in rows if r["license_id"] is not None] == []


FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


@pytest.mark.parametrize("file", FILES)
def test_long_licences(spark, file):
    """The texts that systems ship, where this one does; wrapped at six widths, without title, and changed."""
    path = pathlib.Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("the system has no copy of the text")
    text = path.read_text(encoding="utf-8").strip()
    whole = "\n\n".join(p for p in text.split("\n\n") if p.strip())
    good = [text, *wrapped(whole, (50, 60, 72, 80, 100, 10**6)), whole.split("\n\n", 1)[1], text.upper(), text.replace(",", " ,")]
    words = whole.split(" ")
    bad = [" ".join([*words[:i], "not", *words[i:]]) for i in range(3, len(words), len(words) // 6)] + [text[: len(text) // 2], text + "\n\nAnd more."]
    rows = licenses.licences(spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r["license_id"] for r in rows] == [FILES[file]] * len(good) + [None] * len(bad)


def test_words_about_copyright_stay(spark):
    texts = ["they keep the\ncopyright notice and more", "AUTHORS OR\nCOPYRIGHT HOLDERS BE LIABLE", "(a) one\n(c) You must keep it", "Copyright (c) 2020 A B\n\nYou must pay.", "Copyright 2020 Ann Bee. You must pay.", "Copyright (c) 2020 A Permission is hereby granted"]
    kept = ["they keep the copyright notice and more", "authors or copyright holders be liable", "a one c you must keep it", "you must pay", "you must pay", "permission is hereby granted"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", licenses.canonical(licenses.F.lower("t"), True).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in rows] == kept == [licenses.canonical_text(t, True) for t in texts]
