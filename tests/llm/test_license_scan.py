import random
import re

import pytest

from attesta.llm import license_scan as ls

SCHEMA = "doc_id long, text string, score string"


def rows(spark, texts):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in ls.licenses(frame).collect()}


def test_places_of_base_phrases(spark):
    got = rows(
        spark,
        [
            "Released under the MIT License.",
            "cc-by-nc CC BY NC, apache license, version 2.0 under the mit license",
            "nothing here",
            None,
            "",
            "cc by nc cc by nc",
            "xcc by nc",
        ],
    )
    base = {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in got.items()}
    assert base == {
        0: (5, 1, 1, 1, "mit"),
        1: (15, 4, 0, 11, "apache-2,cc-by-nc,mit"),
        2: (2, 0, None, None, ""),
        3: (0, 0, None, None, ""),
        4: (0, 0, None, None, ""),
        5: (6, 2, 0, 3, "cc-by-nc"),
        6: (3, 0, None, None, ""),
    }
    assert got[0].score == 1.0 and got[2].score == 0.0


def test_tags_and_notices(spark):
    got = rows(
        spark,
        [
            "# SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0 WITH LLVM-exception",
            "licensed under the GNU General Public License, version 3",
            "SPDX-License-Identifier: AND",
        ],
    )
    assert got[0].labels == "apache-2.0 with llvm-exception,gpl-3.0-only,mit" and got[0].permissive is True and got[0].n_tags == 1
    assert got[1].labels == "gpl-3.0" and got[1].permissive is False and got[1].score == 0.8
    assert got[2].labels == "" and got[2].score == 0.3


@pytest.mark.parametrize(
    "expression,postfix,permissive",
    [
        ("MIT", "mit", True),
        ("mit or gpl-2.0 and bsd", "mit gpl-2.0 bsd and or", True),
        ("(mit or gpl-2.0) and gpl-3.0", "mit gpl-2.0 or gpl-3.0 and", False),
        ("gpl-2.0 with classpath and mit", "gpl-2.0 classpath with mit and", False),
    ],
)
def test_expressions(expression, postfix, permissive):
    assert " ".join(ls.postfix(expression)) == postfix
    assert ls.evaluated(expression).permissive is permissive


def test_names_that_texts_use(spark):
    texts = {
        "ISC License": "isc",
        "released as The Unlicense.": "unlicense",
        "This code is GPLv3": "gpl-3.0",
        "EUPL v1.2": "eupl-1.2",
        "see http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
        "CC BY-NC-SA 4.0": "cc-by-nc,cc-by-nc-sa-4.0",
        "cc by nc": "cc-by-nc",
        "CC-BY-SA 4.0": "cc-by-sa-4.0",
        "SPDX-License-Identifier: (MIT License)": "mit",
        "SPDX-License-Identifier: (MIT License OR Apache-2.0)": "apache-2.0,mit",
        "SPDX-License-Identifier: MIT, Apache-2.0": "apache-2.0,mit",
        "SPDX-License-Identifier: MIT, AND Apache-2.0,": "apache-2.0,mit",
        "SPDX-License-Identifier: MIT, see the file, or ask": "mit",
        "SPDX-License-Identifier: MIT, ISC, see the file": "isc,mit",
        "disco license": "",
        "gplv30": "",
    }
    got = rows(spark, list(texts))
    assert {t: got[i].labels for i, t in enumerate(texts)} == texts
    assert got[5].base_labels == "cc-by-nc" and got[5].permissive is False and got[4].permissive is True


@pytest.mark.parametrize("bad", ["", "and", "mit and", "(mit", "mit)", "mit (bsd)", "or mit"])
def test_bad_expressions(bad):
    with pytest.raises(ls.BadExpression):
        ls.postfix(bad)


def test_empty_table(spark):
    assert rows(spark, []) == {}


def test_tags_with_other_signs_than_hyphens(spark):
    got = rows(spark, ["SPDX License Identifier: MIT", "# spdx_license_identifier = Apache-2.0 OR ISC", "SPDX-License-Identifier MIT", "an SPDX license identifier is short"])
    assert [(got[i].n_tags, got[i].labels, got[i].score) for i in range(4)] == [(1, "mit", 1.0), (1, "apache-2.0,isc", 1.0), (1, "mit", 1.0), (0, "", 0.0)]


def test_what_is_permissive_in_mixed_texts(spark):
    got = rows(
        spark,
        [
            "SPDX-License-Identifier: MIT\nalso cc by nc",
            "SPDX-License-Identifier: MIT\nGNU General Public License version 3",
            "SPDX-License-Identifier: MIT\nunder the MIT license",
            "SPDX-License-Identifier: GPL-3.0-only\nunder the MIT license",
            "under the MIT license",
        ],
    )
    assert [got[i].permissive for i in range(5)] == [False, False, True, False, True]


def test_base_places_are_those_of_a_plain_search(spark):
    r = random.Random(3)
    words = ["under", "the", "MIT", "license", "Apache", "version", "2", "cc", "by", "nc", "x", "é"]
    texts = ["".join(r.choice(words) + r.choice([" ", "-", "\n", ", "]) for _ in range(r.randint(0, 80))) for _ in range(300)]
    texts += ["under the mit license " * 50_000, "x" * 2_000_000]
    for i, row in rows(spark, texts).items():
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[i]))
        starts, labels = [], set()
        for phrase, label in ls.BASE.items():
            p = phrase.split()
            here = [k for k in range(len(own)) if own[k : k + len(p)] == p]
            starts += here
            labels |= {label} if here else set()
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(own), len(starts), min(starts, default=None), max(starts, default=None))
        assert row.base_labels == ",".join(sorted(labels))


def test_null_ids_and_repeated_rows(spark):
    frame = spark.createDataFrame([(None, "cc by nc", "x"), (1, "cc by nc", "x"), (1, "cc by nc", "x")], SCHEMA)
    assert sorted((r.doc_id or 0, r.n_base) for r in ls.licenses(frame).collect()) == [(0, 1), (1, 1), (1, 1)]
