"""Blocks and units of Markdown: examples in the manner of the CommonMark specification, with what they are by its rules."""

import pytest

from siftline.functions.blocks import top_blocks
from siftline.functions.segment import units

CASES = [
    # containers
    ("- a\n  - b\n    - c\n- d", [("item", 0, 3), ("item", 3, 4)]),
    ("- a\n - b\n  - c\n   - d\n    - e", [("item", 0, 1), ("item", 1, 2), ("item", 2, 3), ("item", 3, 5)]),
    ("1. a\n\n   more of a\n\n2. b", [("item", 0, 3), ("item", 4, 5)]),
    ("1. a\n  - b", [("item", 0, 1), ("item", 1, 2)]),
    ("10) a\n\n       code\n    b", [("item", 0, 4)]),
    ("- a\nlazy\n\nafter", [("item", 0, 2), ("paragraph", 3, 4)]),
    ("- a\n\n b", [("item", 0, 1), ("paragraph", 2, 3)]),
    ("-\n  a\n-\n\n  b", [("item", 0, 2), ("item", 2, 3), ("paragraph", 4, 5)]),
    ("- > q\nlazy in quote in item\n- b", [("item", 0, 2), ("item", 2, 3)]),
    ("- ```\n  - not an item\n\n  ```\n- b", [("item", 0, 4), ("item", 4, 5)]),
    ("- ```\nout", [("item", 0, 1), ("paragraph", 1, 2)]),
    ("> a\nlazy\n> b\n\n> c", [("quote", 0, 3), ("quote", 4, 5)]),
    ("> - a\nlazy\n> - b", [("quote", 0, 3)]),
    ("> a\n---\nb", [("quote", 0, 1), ("rule", 1, 2), ("paragraph", 2, 3)]),
    ("> a\n===", [("quote", 0, 2)]),
    (">     code\nnot lazy", [("quote", 0, 1), ("paragraph", 1, 2)]),
    ("> ```\nout\n> ```", [("quote", 0, 1), ("paragraph", 1, 2), ("quote", 2, 3)]),
    ("> > a\n> b\nc", [("quote", 0, 3)]),
    # lists and paragraphs
    ("a\n- b", [("paragraph", 0, 1), ("item", 1, 2)]),
    ("a\n1. b", [("paragraph", 0, 1), ("item", 1, 2)]),
    ("the year\n1986. was", [("paragraph", 0, 2)]),
    ("a\n-", [("heading", 0, 2)]),
    ("a\n*\nb", [("paragraph", 0, 3)]),
    ("- a\n2. b", [("item", 0, 1), ("item", 1, 2)]),
    ("-a\n1.b\n1234567890. c", [("paragraph", 0, 3)]),
    ("* * *\n- - -\n_ _ _ _", [("rule", 0, 1), ("rule", 1, 2), ("rule", 2, 3)]),
    ("- * * *", [("item", 0, 1)]),
    ("-      a", [("item", 0, 1)]),
    ("\t- code", [("code", 0, 1)]),
    ("-\ta\n\n\tb", [("item", 0, 3)]),
    # leaves
    ("# a\n####### b\n#c\n #  d\n    # e", [("heading", 0, 1), ("paragraph", 1, 3), ("heading", 3, 4), ("code", 4, 5)]),
    ("a\n    b\n\n    c\n\n\n    d\ne", [("paragraph", 0, 2), ("code", 3, 7), ("paragraph", 7, 8)]),
    ("a\nb\n===\nc\n---", [("heading", 0, 3), ("heading", 3, 5)]),
    ("```a`b\nc", [("paragraph", 0, 2)]),
    ("````\n```\n~~~~\n`````\na", [("fence", 0, 4), ("paragraph", 4, 5)]),
    ("~~~ x ` y\n\n    ~~~\n~~~", [("fence", 0, 4)]),
    ("```\nopen\n\n# to the end", [("fence", 0, 4)]),
    ("a\n```\nb\n```", [("paragraph", 0, 1), ("fence", 1, 4)]),
    # tables
    ("| a | b |\n| - | :-: |\n| c |\nd\n\ne", [("table", 0, 4), ("paragraph", 5, 6)]),
    ("a | b\n- | -\nc", [("paragraph", 0, 1), ("item", 1, 3)]),
    ("a | b\n-|-\nc | d\n> q", [("table", 0, 3), ("quote", 3, 4)]),
    ("text\n|a|b|\n|---|---|", [("paragraph", 0, 1), ("table", 1, 3)]),
    ("|a|b|\n|---|", [("paragraph", 0, 2)]),
    ("|a\\|b|\n|---|\n- x", [("table", 0, 2), ("item", 2, 3)]),
    # HTML
    ("<div>\n- a\n# b\n\nc", [("html", 0, 3), ("paragraph", 4, 5)]),
    ("a\n<div>\nb", [("paragraph", 0, 1), ("html", 1, 3)]),
    ("a\n<b>\nc", [("paragraph", 0, 3)]),
    ("<b>\n- c\n\nd", [("html", 0, 2), ("paragraph", 3, 4)]),
    ("<b>c\n- d", [("paragraph", 0, 1), ("item", 1, 2)]),
    ("<!-- a\n\n- b -->\n- c", [("html", 0, 3), ("item", 3, 4)]),
    ("<script>\n\n# a\n</script> x\n# b", [("html", 0, 4), ("heading", 4, 5)]),
    ("<?php a ?>\n# b\n<![CDATA[\n\n]]>\n<!X a>", [("html", 0, 1), ("heading", 1, 2), ("html", 2, 5), ("html", 5, 6)]),
    ('<a href="x\n', [("paragraph", 0, 1)]),
    ("", []), ("\n  \n", []), ("a\r\n\r\nb\r", [("paragraph", 0, 1), ("paragraph", 2, 3)]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_blocks(text, want):
    assert [(b.kind, b.start, b.stop) for b in top_blocks(text.split("\n"))] == want


def test_units():
    assert units("First here. Second follows. Third.") == ["First here.", "Second follows.", "Third."]
    assert units("Before.\n\n```python\ndef f(x):\n    return x\n```\n\nAfter.") == ["Before.", "```python\ndef f(x):\n    return x\n```", "After."]
    assert units("In.\n\n| N | L |\n|---|---|\n| A | [a](http://a.b) |\n| B | [b](http://b.b) |\n\nOut.") == ["In.", "| N | L |\n|---|---|\n| A | [a](http://a.b) |\n| B | [b](http://b.b) |", "Out."]
    assert units("- first\n  - inner\n\n    more\n- second\n* other") == ["- first\n  - inner\n\n    more", "- second", "* other"]
    assert units("> One line. Two\nlazy line.\n> - three") == ["One line.", "Two lazy line.", "- three"]
    assert units("Title\n=====\ntext\n\n---\n\n<p>\nHi there. You.\n</p>") == ["Title\n=====", "text", "<p> Hi there.", "You.", "</p>"]
    assert units('[a]: /url "title"\n[b]: <x y>\n[c]:\n/z\nText [a].\n\n[d]: /only') == ["Text [a]."]
    assert units('[a]: /url "title" more') == ['[a]: /url "title" more']
    assert units("x\n\n    a\n\n    b\n\nc") == ["x", "a\n\n    b", "c"]
    assert units("Tom &amp; Jerry are &lt;friends&gt;.") == ["Tom & Jerry are <friends>."]
    assert units("") == units(None) == units("  \n\n \t") == []
    long_ = "```\n" + "\n".join(f"line_{i} = value({i})" for i in range(300)) + "\n```"
    assert len(units(long_)) > 1 and "\n".join(units(long_)) == long_
    assert all(len(u.split()) <= 250 for u in units("word " * 600)) and len(units("word " * 600)) > 1


def test_deep_and_long_texts():
    """Linear in practice: thousands of lines, deep containers."""
    assert [b.kind for b in top_blocks([">" * 200 + " a", "lazy"])] == ["quote"]
    assert len(top_blocks(("- a\n" * 20_000).split("\n"))) == 20_000
    nested = [" " * 2 * i + "- x" for i in range(200)]
    assert [(b.kind, b.stop) for b in top_blocks(nested)] == [("item", 200)]
    assert len(units("x" * 1_000_000)) == 1
