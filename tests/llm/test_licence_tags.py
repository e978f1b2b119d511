"""Identifier tags with text after them: comments, running prose and texts on one line."""

import pytest

from loomdoc.llm import licenses

TAG = "SPDX-License-Identifier: "


@pytest.mark.parametrize(
    ("text", "expressions", "labels", "accepted"),
    [
        (f"<!-- {TAG}Apache-2.0 -->", ["Apache-2.0"], "apache-2.0", [True]),
        (f"/* {TAG}MIT OR GPL-2.0+ */ int x;", ["MIT OR GPL-2.0+"], "gpl-2.0+,mit", [True]),
        (f"{TAG}MIT. The rest of the paragraph", ["MIT"], "mit", [True]),
        (f"{TAG}MIT.", ["MIT"], "mit", [True]),
        (f"{TAG}MIT. And more", ["MIT"], "mit", [True]),
        (f"{TAG}MIT and the rest, in words", ["MIT"], "mit", [True]),
        (f"{TAG}mit or apache-2.0 as you like", ["mit or apache-2.0"], "apache-2.0,mit", [True]),
        (f"{TAG}(GPL-2.0 WITH Classpath-exception-2.0) AND ISC, see there", ["(GPL-2.0 WITH Classpath-exception-2.0) AND ISC"], "gpl-2.0,isc", [True]),
        (f"{TAG}(GPL-2.0 OR MIT.) x", ["(GPL-2.0 OR MIT.) x"], "", [None]),
        (f"a {TAG}GPL-3.0 b {TAG}MIT c", ["GPL-3.0", "MIT"], "gpl-3.0,mit", [False, True]),
        (f"{TAG}--\n{TAG}\n{TAG}MIT\r\nx", ["--", "", "MIT"], "mit", [None, None, True]),
        (f'"{TAG}ISC"', ["ISC"], "isc", [True]),
    ],
)
def test_tags_with_text_after_them(text, expressions, labels, accepted):
    found = licenses.scan(text)
    assert (found["expressions"], found["labels"], found["accepted"]) == (expressions, labels, accepted)
    assert found["score"] == (0.9 if labels else 0)


def test_a_long_line_is_scanned_in_linear_time():
    text = f"{TAG}MIT some words " * 20_000
    assert licenses.scan(text)["expressions"] == ["MIT"] * 20_000
    assert licenses.scan(TAG + "(" * 100_000)["accepted"] == [None]
