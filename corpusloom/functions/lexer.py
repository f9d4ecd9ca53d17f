"""Blocks of one source file in one pass over its lines.

Where a block ends depends on all lines before: open strings, comments, brackets and blocks.
Such a running state is quadratic in column functions and a shuffle of every line in
windows, so it is kept in a loop over the file here; ``operators.code`` maps it over files.
"""

from __future__ import annotations

import re

Block = tuple[int, int, str, str]  # first and last line from 1, type, text

# Strings and comments of Python. Possessive throughout, so that a literal of any length
# costs no stack.
_PYTHON_LITERAL = re.compile(
    r'"""[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""'
    r"|'''[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'''"
    r'|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
    r"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
    r"|#[^\n]*+"
)
# Stands at the start of a line that begins inside a string.
_INSIDE = "\u0001"
_DEFINITION = re.compile(r"[ \t]*(?:(class)|def|async[ \t]+def)[ \t]+\w")
_INDENT = re.compile(r"[ \t]*")
_CLOSER = re.compile(r"[ \t]*[)\]}]")
_NOT_BLANK = re.compile(r"[^ \t\n\x0b\f\r]")


def _text(lines: list[str], first: int, last: int) -> str:
    """The lines of a block; the first one's indent is not part of it."""
    return "\n".join(lines[first : last + 1]).lstrip(" \t")


def _emptied_python(match: re.Match) -> str:
    literal = match[0]
    if literal[0] == "#":
        return ""
    breaks = literal.count("\n")
    return "s" + "\n" * breaks + (_INSIDE if breaks else "")


def python_blocks(text: str) -> list[Block]:
    """Classes and functions at every depth; a file without any is one ``module``, a blank one nothing."""
    lines, bare = text.split("\n"), _PYTHON_LITERAL.sub(_emptied_python, text).split("\n")
    found: list[list] = []  # first line, last line, type
    open_: list[tuple[int, int]] = []  # indent, place in found
    first = last = None
    depth, defined = 0, False
    for at, own in enumerate(bare):
        definition = _DEFINITION.match(own)
        if definition:
            depth = 0  # no definition stands inside brackets, so an unbalanced one reaches no further
        inside = depth > 0
        depth += sum(map(own.count, "([{")) - sum(map(own.count, ")]}"))
        if not _NOT_BLANK.search(own):
            continue
        defined = defined or definition is not None
        # Continuation lines and the insides of strings belong to a statement and end no block.
        inner = inside or (at > 0 and bare[at - 1].endswith("\\")) or own.startswith(_INSIDE) or _CLOSER.match(own)
        if not inner:
            indent = len(_INDENT.match(lines[at])[0])
            while open_ and open_[-1][0] >= indent:
                found[open_.pop()[1]][1] = last
            if definition:
                open_.append((indent, len(found)))
                found.append([at, None, "class_definition" if definition[1] else "function_definition"])
        first, last = at if first is None else first, at
    if last is None:
        return []
    if not defined:
        return [(first + 1, last + 1, "module", _text(lines, first, last))]
    ends = [(begin, last if end is None else end, kind) for begin, end, kind in found]
    return [(begin + 1, end + 1, kind, _text(lines, begin, end)) for begin, end, kind in ends]


# Strings, templates (which may span lines) and comments of brace languages.
_SCRIPT_LITERAL = re.compile(
    r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
    r"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
    r"|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
    r"|//[^\n]*+"
    r"|/\*[\s\S]*?(?:\*/|\Z)"
)
_MODIFIERS = r"\s*(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*[#\w$]+\s*\([^)]*\)\s*"
# Control words that look like a method header when a bracket follows them.
_CONTROL = re.compile(r"\s*(?:if|for|while|switch|catch|return|else|do|function|new|throw|typeof|await)\b")
_CLASS = re.compile(r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+\w")
_FUNCTION = re.compile(r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*\w")
_METHOD = re.compile(_MODIFIERS + r"(?::\s*[^{]+)?\{")
_METHOD_HEAD = re.compile(_MODIFIERS + r"(?::\s*[^{;]+)?\s*\Z")


def _emptied_script(match: re.Match) -> str:
    breaks = "\n" * match[0].count("\n")
    return breaks if match[0][0] == "/" else "''" + breaks


def _kind(line: str) -> str | None:
    if _CLASS.match(line):
        return "class_declaration"
    if _FUNCTION.match(line):
        return "function_declaration"
    if _METHOD.match(line) and not _CONTROL.match(line):
        return "method_definition"
    return "arrow_function" if "=>" in line else None


def _opens_later(bare: list[str], at: int, kind: str | None) -> tuple[str | None, int]:
    """Kind of a header whose brace is not on its own line, and the line it is on; the header's
    own line where it has none."""
    line = bare[at]
    if kind is None and (not _METHOD_HEAD.match(line) or _CONTROL.match(line)):
        return None, at
    after = at + 1
    while after < len(bare) and not _NOT_BLANK.search(bare[after]):
        after += 1
    if after == len(bare):
        return kind, at
    next_line = bare[after].lstrip()
    if kind in ("class_declaration", "function_declaration"):
        while after < len(bare) and _kind(bare[after]) is None and not re.search(r"[{};]", bare[after]):
            after += 1
        brace = after < len(bare) and re.search(r"[{};]", bare[after])
        return kind, after if brace and brace[0] == "{" and ";" not in line else at
    if not next_line.startswith("{"):
        return kind, at
    if kind == "arrow_function":
        return kind, after if line.rstrip().endswith("=>") else at
    return "method_definition", after


def script_blocks(text: str) -> list[Block]:
    """Classes, functions, methods and arrow functions: from the header to the line where the
    brace depth is back at the header's."""
    lines, bare = text.split("\n"), _SCRIPT_LITERAL.sub(_emptied_script, text).split("\n")
    found: list[list] = []
    open_: list[tuple[int, int, int]] = []  # depth before, line that opens, place in found
    depth = 0
    for at, line in enumerate(bare):
        before, depth = depth, depth + line.count("{") - line.count("}")
        while open_ and depth <= open_[-1][0] and at > open_[-1][1]:
            found[open_.pop()[2]][1] = at
        kind, opens = _kind(line), at
        if "{" not in line:
            kind, opens = _opens_later(bare, at, kind)
        if kind is None:
            continue
        waits = depth > before or opens > at
        found.append([at, None if waits else at, kind])
        if waits:
            open_.append((before, opens, len(found) - 1))
    last = len(lines) - 1
    ends = [(begin, last if end is None else end, kind) for begin, end, kind in found]
    return [(begin + 1, end + 1, kind, _text(lines, begin, end)) for begin, end, kind in ends]
