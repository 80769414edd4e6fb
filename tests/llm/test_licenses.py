import textwrap

import pytest
from helpers import DOC_SCHEMA, prose, row

from cohortflow.llm import licenses


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.TEMPLATES)


def found(scanner, text):
    return [(r[0], r[2]) for r in scanner.scan(text)]


def last(name):
    return licenses.TEMPLATES[name].split("\n")[-1]


@pytest.mark.parametrize("text, expected", [
    (last("GPL-2.0"), "GPL-2.0"),
    (last("GPL-3.0"), "GPL-3.0"),
    ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
    ("This work is licensed under a Creative Commons Attribution 3.0 International License.", None),
    ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"),
    ("Licensed under the GNU General Public License.", None),
    ("Licensed under the Eclipse Public License, version 2.0.", None),
    ("This is not licensed under the MIT License.", None),
    (last("BSD-2-Clause"), "BSD-2-Clause"),
    (last("ISC"), "ISC"),
])
def test_identifying_words_decide(scanner, text, expected):
    (got,) = scanner.scan(text)
    assert got[2] == expected and got[3]


def test_a_clause_of_several_licences_names_none(scanner):
    head = last("BSD-3-Clause").split(":")[0].split("reserved. ")[1]
    assert found(scanner, head) == [(0, None)]


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "MPL-2.0"])
@pytest.mark.parametrize("width", [50, 72, 10000])
def test_wrapped_notices_are_one_block(scanner, name, width):
    lines = textwrap.wrap(last(name), width)
    (got,) = scanner.scan("\n".join(["weather report of monday", *lines, "the end of the report"]))
    assert got[:3] == (1, "\n".join(lines), name) and got[7]


def test_lines_without_cue_words(scanner):
    assert found(scanner, "CC0 1.0 Universal") == [(0, "CC0-1.0")]
    assert found(scanner, "Unless required by applicable law or agreed to in writing, software") != []


def test_three_clause_text_with_numbers(scanner):
    text = last("BSD-3-Clause").replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in")
    assert found(scanner, "Copyright (c) 2020, Foo. " + text.replace("Neither", "3. Neither")) == [(0, "BSD-3-Clause")]


def test_a_far_chance_run_does_not_stretch_the_notice(scanner):
    text = prose(1, 3000) + " Licensed under CC BY 4.0. " + prose(2, 3000) + " to view a copy of this " + prose(3, 500)
    (got,) = [r for r in scanner.scan(text) if r[2]]
    assert got[1:3] == ("Licensed under CC BY 4.0", "CC-BY-4.0") and got[5:7] == (5, 0)


def test_neighbouring_notices_stay_apart(scanner):
    assert found(scanner, "Licensed under CC BY-NC 4.0.\nAll rights reserved.\nReleased under the MIT License.") == [
        (0, "CC-BY-NC-4.0"), (1, "proprietary"), (2, "MIT")]


def test_every_text_is_looked_at(spark):
    lines = textwrap.wrap("to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish", 60)
    docs = spark.createDataFrame([row(1, prose(4) + "\n" + "\n".join(lines)), row(2, "CC0 1.0 Universal"), row(3, prose(5)), row(4, None)], DOC_SCHEMA)
    got = {(r.doc_id, r.block): (r.license, r.text) for r in licenses.license_blocks(docs).collect()}
    assert got == {(1, 1): ("MIT", "\n".join(lines)), (2, 0): ("CC0-1.0", "CC0 1.0 Universal")}


def test_a_long_line_is_shown_and_measured_whole(scanner):
    head = "copyright of the town " + prose(3, 1500).replace("\n", " ")
    mit = last("MIT").split()[3:75]
    notice = " ".join(" ".join(mit[k : k + 6]) + " apache" for k in range(0, len(mit), 6))  # no notice, for its marks
    line = f"{head} {notice} {prose(4, 900)}".replace("\n", " ") + " all permissions end here"
    assert len(line) > 3 * licenses.LONG
    (got,) = scanner.scan(line)
    assert got[2] is None and got[1] == line
    assert got[5] >= 50  # the words beyond the first REGION are compared as well


def test_what_follows_a_notice_in_a_long_line_is_a_candidate(scanner):
    end = "Ask the owner for permission to print this."
    line = f"{last('MIT')} {prose(5, 2000)} {end}".replace("\n", " ")
    assert len(line) > licenses.LONG
    got = scanner.scan(line)
    assert [r[2] for r in got] == ["MIT", None]
    assert got[1][1].endswith(end)
