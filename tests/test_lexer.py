"""Blocks of source texts, line by line."""

from __future__ import annotations

import time

from corpusloom.functions.lexer import python_blocks, script_blocks


def told(blocks):
    return [(a, b, kind.split("_")[0]) for a, b, kind, _ in blocks]


def test_template_strings_over_lines():
    text = "function f() {\n  const t = `a {\n b } \\` }\n`;\n}\nconst g = () => `x\n{`;\nclass A {\n}"
    assert told(script_blocks(text)) == [(1, 5, "function"), (6, 6, "arrow"), (8, 9, "class")]


def test_braces_on_the_next_line():
    text = "class A\n{\n  m(a)\n  // why\n  {\n    if (a)\n    {\n      b(a);\n    }\n  }\n}\nfunction f(a,\n  b)\n{\n}\nconst g = (a) =>\n{\n};\ncall(a);\n{\n}"
    assert told(script_blocks(text)) == [(1, 11, "class"), (3, 10, "method"), (12, 15, "function"), (16, 18, "arrow")]


def test_headers_without_a_body():
    text = "declare function f(a);\nfunction g() { return 1; }\nclass B {}\nabstract class C extends\n  D {\n}\nlet x = y => y + 1"
    assert told(script_blocks(text)) == [(2, 2, "function"), (3, 3, "class"), (4, 6, "class"), (7, 7, "arrow")]


def test_comments_and_strings_hide_braces():
    text = "function f() { /* {\n{ */ // {\n  a = \"{\\\"{\" + '{';\n}\n/* function g() {"
    assert told(script_blocks(text)) == [(1, 4, "function")]


def test_python_strings_brackets_and_continuations():
    text = 'def f(a,\nb):\n    """\nx\n    """\n    y = (1,\n2)\n    z = 1 + \\\n2\n    return y\nclass A:\n  def g(self): pass\n# end\nprint(1)'
    assert told(python_blocks(text)) == [(1, 10, "function"), (11, 12, "class"), (12, 12, "function")]
    assert python_blocks("\n  # only\n") == [] == python_blocks("")
    assert told(python_blocks("x = 1\n\n(y)\n")) == [(1, 3, "module")]


def test_long_lines_and_many_blocks():
    """Time grows with the text: a line of a megabyte, and 20,000 nested and flat blocks."""
    start = time.time()
    long_line = "const s = '" + "{" * 1_000_000 + "';"
    assert told(script_blocks(f"function f() {{\n{long_line}\n}}")) == [(1, 3, "function")]
    assert told(python_blocks("def f():\n    x = '" + "(" * 1_000_000 + "'\n    y = 2")) == [(1, 3, "function")]
    assert len(script_blocks("function f() {\n}\n" * 20_000)) == len(python_blocks("def f():\n  pass\n" * 20_000)) == 20_000
    assert time.time() - start < 20
