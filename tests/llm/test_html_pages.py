"""Blocks of malformed pages: one forward pass whatever stays open, unknown elements inline."""

import re
import time

import pytest

from ledgerline.llm import html_blocks
from ledgerline.llm.html_blocks import Scanner, blocks

MB = 1_000_000
FORMS = {
    "tag without an end": "<a ", "open quote": "<p 'x", "two kinds of quotes": "<p '\"", "quoted end": "<p '>", "mixed": "<p '\">", "closing tags": "</p", "unknown closing": "<div></b></x>", "nested": "<div>a", "comments": "<!--", "declarations": "<!a", "scripts": "<script>",
    "ends of scripts": "<script></script ", "hidden": "<svg>", "half": "<", "attributes": "<p class = ", "references": "&amp", "lists": "<li>a<ul>",
}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("tail", ["", ">", "'>", "</div>"])
def test_a_megabyte_of_each_form_takes_seconds(form, tail):
    page = "<p>first</p>" + FORMS[form] * (MB // len(FORMS[form])) + tail
    began = time.perf_counter()
    found = blocks(page)
    assert time.perf_counter() - began < 8 and found[0].text == "first"


def test_unknown_elements_are_inline():
    assert [b.text for b in blocks("<p>If x<y or y>z then <my-word>so</my-word> it is.</p><custom>one</custom> two")] == ["If xz then so it is.", "one two"]


def test_quotes_hide_the_end_of_a_tag_unless_they_stay_open():
    assert [b.text for b in blocks("<p title='a > b'>one</p><p title=\"it's > that\">two</p>")] == ["one", "two"]
    assert [b.text for b in blocks("<p title='a>one</p><p>two</p>")] == ["one", "two"]


def test_paths_of_deep_pages_are_bounded():
    (block,) = blocks("<div class=outer>" * 1000 + "text")
    assert len(block.path) == 2 * html_blocks.DEEPEST


def test_scanner_equals_a_backtracking_expression_on_random_pages():
    """The tokens are those of one regular expression, which is right but quadratic."""
    token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
    import random

    rng = random.Random(8)
    bits = ["<", ">", "'", '"', "a", "<p ", "</p", "<!--", "-->", "<!", "<![CDATA[", "]]>", "<?x", " ", "=", "<b>", "/"]
    for _ in range(30_000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        want, got, at, scanner = [], [], 0, Scanner(page)
        while m := token.search(page, at):
            want.append((m.start(), m.end(), (m[2] or m[5] or "").lower(), bool(m[1] or m[4]), (m[3] if m[2] else m[6]) or ""))
            at = m.end()
        at = 0
        while t := scanner.next(at):
            got.append((t.start, t.end, t.tag, t.closing, t.attributes))
            at = t.end
        assert got == want, page
