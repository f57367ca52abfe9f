"""Odd pages: markup that never closes takes time in proportion to its length."""

import time

import pytest

from auditjobs.llm import html_extract as H

ODD = {
    "unclosed quotes": ('<a "', 250_000), "unclosed sections": ("<![CDATA[x>", 90_000), "stray end tags": ("<div></x>", 110_000), "nested articles": ("<article>t", 100_000),
    "brackets in quotes": ('<a "x>y"', 120_000), "a paragraph behind a button": ("<p><button><blockquote>", 45_000), "brackets": ("<", 1_000_000),
}


def text_of(source):
    root = H.parse(source)
    H.fingerprint(root)
    return "\n".join(H.blocks(H.main_element(root, frozenset()), frozenset()))


@pytest.mark.parametrize("name", ODD)
def test_a_megabyte_of_odd_markup(name):
    unit, times = ODD[name]
    began = time.process_time()
    text_of(unit * times)
    assert time.process_time() - began < 20


def test_forms_of_tags():
    assert text_of("<body><p>a < b <c") == "a < b <c"
    assert text_of("<body><a title='x>y'>one</a> <a \"b>two</a>") == "one two"
    assert text_of("<body><![CDATA[gone]]>x<![CDATA[y>z") == "xz"
    assert text_of("<body><li>a<li>b</body>") == "a\nb"
    assert text_of('<body><a"b>c') == "c"


def test_ties_between_sibling_articles_go_to_the_last():
    assert text_of("<article>one</article><article>two</article>") == "two"
    assert text_of("<article>one</article><article>three</article>") == "three"
