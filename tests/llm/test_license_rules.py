"""The license scan against its rules run without any prefilter."""

import random
import re._parser as parser
import string

import brute
import regex

from pricelens.llm import licenses
from pricelens.llm.license_rules import rules

NAMES = ["This file is licensed under GPLv2 only", "GPL v3", "AGPLv3", "the Expat\nLicense", "zero clause BSD", "an open rail model", "cc-by-1.0", "one clause license",
         "GNU\nGeneral  Public\n * License, version 2", "Permission is\nhereby granted, free of charge, to any person obtaining a copy", "business\nsource license 1.1",
         "placed into the public\n\tdomain", "end user licence agreement", "sublicensed under the terms", "see myopensource.org/licenses/mit", "xcopyright 2020", "noncommercial", "for noncommercial use only"]


def sample(rng, parsed):
    """A text that the parsed pattern describes; what it says about its surroundings must hold there (negative parts are left out)."""
    out = ""
    for op, a in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(a)
        elif op == "NOT_LITERAL" or op == "ANY":
            out += "q"
        elif op == "IN":
            out += one(rng, a)
        elif op == "MAX_REPEAT":
            out += "".join(sample(rng, a[2]) for _ in range(rng.randint(a[0], min(int(a[1]), a[0] + 2))))
        elif op == "SUBPATTERN":
            out += sample(rng, a[-1])
        elif op == "BRANCH":
            out += sample(rng, rng.choice(a[1]))
        elif op == "ASSERT":
            out += sample(rng, a[1])
    return out


def one(rng, members):
    kinds = {"CATEGORY_SPACE": " \n\t", "CATEGORY_DIGIT": "0123456789", "CATEGORY_NOT_SPACE": "abc*"}
    if str(members[0][0]) == "NEGATE":
        return " "
    op, a = rng.choice(members)
    return chr(a) if str(op) == "LITERAL" else rng.choice(kinds[str(a)]) if str(op) == "CATEGORY" else chr(rng.randint(*a))


def test_no_detection_is_lost_by_a_keyword(spark, monkeypatch):
    rng, texts, made = random.Random(9), list(NAMES), 0
    for label, p, _, pattern in rules():
        for before in ("", "sub", "a\n"):
            t = before + sample(rng, parser.parse(pattern))
            made += regex.search(pattern, t) is not None
            texts.append("".join(c.upper() if c in string.ascii_lowercase and rng.random() < 0.3 else c for c in t))
    assert made > 2 * len(rules())
    monkeypatch.setattr(brute, "RULES", [(label, p, "", x) for label, p, _, x in brute.RULES])
    monkeypatch.setattr(brute, "GATE", regex.compile(""))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.op6_license_scan(d).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute.license_row(t), t
    assert got[0][5:] == ("gpl-2.0", 0.8)


def test_keywords_are_one_word():
    assert not [w for _, _, w, _ in rules() if not w or regex.search(r"\s", w)]


def test_identifiers_of_a_long_expression(spark):
    """Licenses count however far behind the tag they stand, on its line only."""
    ids = ["apache-2.0", "mpl-2.0", "bsd-3-clause", "zlib", "isc", "epl-2.0", "gpl-3.0", "x11"]
    line = "É😀 // SPDX-License-Identifier: (" + " OR ".join(x.upper() for x in ids) + ") AND LicenseRef-" + "z" * 400 + " AND (BSL-1.0 OR Unlicense) spdx-license-identifier: ecl-2.0"
    texts = [line + "\nzlib curl", line + "\r\nSPDX-License-Identifier:MIT", "SPDX-License-Identifier:", "SPDX-License-Identifier:\nMIT", "SPDX-License-Identifier: MITx MIT-1 not-MIT"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.op6_license_scan(d).collect()}
    want = {*ids, "bsl-1.0", "unlicense", "ecl-2.0"}
    assert [set(got[i][5].split(",")) for i in range(5)] == [want, want | {"mit"}, {""}, {""}, {""}]
    assert [got[i][6] for i in range(5)] == [1.0, 1.0, 0.0, 0.0, 0.0]
    assert all(got[i] == brute.license_row(t) for i, t in enumerate(texts))
