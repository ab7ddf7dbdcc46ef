"""Licence phrases and notices against a plain scan."""

import random
import re

from boxloom.llm.license_scan import PHRASES, license_scan


def words_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(text):
    words, places, labels = words_of(text), [], set()
    for label, texts in PHRASES.items():
        for phrase in texts:
            p = phrase.split()
            hits = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_against_plain(spark):
    r = random.Random(8)
    vocabulary = ["cc", "BY", "general", "Public", "license", "all", "rights", "reserved", "été", "of", "-", "x_y", "CC-BY"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40))) for _ in range(200)]
    texts += [None, "", "All rights reserved. " * 3000, "all rights", "general public general public license", "cc", "by"]
    rows = [(i, t, 1, "y") for i, t in enumerate(texts)] + [(None, "cc by", 1, "y"), (3, texts[3], 2, "z"), (3, texts[3], 2, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, votes int, label string")
    got = sorted(((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in license_scan(df).collect()), key=str)
    assert got == sorted(((x[0], *plain(x[1])) for x in rows), key=str)


def test_notices(spark):
    texts = {
        1: "Released under the MIT License.", 2: "It is released here under the MIT license, says the author.", 3: "Released by the MIT press under a license",
        4: "Licensed under the Apache License, Version 2.0 (the License)", 5: "Licensed under CC BY-NC 4.0.", 6: "This work is licensed under the GNU General Public License, version 3.", 7: "nothing here",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x for x in license_scan(df).collect()}
    assert [got[i].labels for i in range(1, 8)] == ["mit", "mit", "", "apache-2.0", "cc-by,cc-by-nc", "gpl,gpl-3.0", ""]
    assert got[1].score == 1.0 and 0.7 < got[2].score <= 1.0 and got[7].score == 0.0


def test_empty(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_templates_of_any_length(spark):
    """A template of more words than a number has bits: whole, cut short, and with a word put in."""
    words = [f"w{i}" for i in range(150)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[:70])), (2, " ".join([*words[:80], "odd", *words[80:]])), (3, " ".join(words[:80]))], "doc_id long, text string")
    got = {x.doc_id: x for x in license_scan(df, phrases={"long": [" ".join(words[:80])]}, notices={"notice": [" ".join(words)]}).collect()}
    assert [got[i].n_base for i in range(4)] == [1, 0, 1, 1]
    assert [got[i].labels for i in range(4)] == ["long,notice", "", "long,notice", "long"]
    assert got[2].score == 1.0
