"""HTML to text, markdown and structured columns by regular expressions.

Every pattern avoids look-around, so other engines can check the results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# A pattern and what replaces it, or a function of the text.
Rule = tuple[str, str] | Callable[[Column], Column]

DROP: list[Rule] = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>", ""),
    (r"(?is)<style(?:\s[^>]*)?>.*?</style\s*>", ""),
]
HEAD: list[Rule] = [(r"(?is)<head(?:\s[^>]*)?>.*?</head\s*>", "")]
HEADINGS: list[Rule] = [
    (rf"(?is)<h{n}(?:\s[^>]*)?>(.*?)</h{n}\s*>", "\n" + "#" * n + r" $1" + "\n") for n in range(1, 7)
]
# A link's address in double quotes, single quotes or none.
_LINK = r"""(?is)<a\s(?:[^>]*\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
INLINE: list[Rule] = [
    (_LINK + r"[^>]*>(.*?)</a\s*>", r"[$4]($1$2$3)"),
    (r"(?i)</?(?:b|strong)(?:\s[^>]*)?>", "**"),
]
BLOCKS: list[Rule] = [
    (r"(?i)<li(?:\s[^>]*)?>", "\n- "),
    (r"(?i)<br(?:\s[^>]*)?/?>", "\n"),
    (r"(?i)</?(?:p|div|ul|ol|article|section|nav|table|tr|footer|header)(?:\s[^>]*)?>", "\n"),
]
TAGS: list[Rule] = [(r"<[^>]*>", "")]
BREAKS: list[Rule] = [
    (r"(?i)</?(?:br|p|div|li|ul|ol|article|section|nav|table|tr|td|th|footer|header)(?:\s[^>]*)?/?>", " ")
]

_ENTITY = r"&(#[0-9]{1,8}|#[xX][0-9A-Fa-f]{1,8}|[A-Za-z][A-Za-z0-9]*);"


def _numbered(name: Column) -> Column:
    """The character of a numeric entity (``#39`` or ``#x27``); U+FFFD where there is none."""
    hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
    digits = F.when(hexadecimal, F.substring(name, 3, 8)).otherwise(F.substring(name, 2, 8))
    code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
    bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    point = F.when(bad, F.lit(0xFFFD)).otherwise(code)
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """All named entities of HTML 4, ``&apos;`` and numeric ones, in one pass, so that ``&amp;lt;``
    becomes ``&lt;``. An unknown name stays; a no-break space becomes a plain one."""
    known = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
    common = ("amp", "nbsp", "lt", "gt", "quot", "apos")
    # A map is searched entry by entry, so names lie under their first letter.
    by_letter: dict[str, list[Column]] = {}
    for name, char in known.items():
        by_letter.setdefault(name[0], []).extend([F.lit(name), F.lit(char)])
    names = F.create_map(*[x for letter, pairs in by_letter.items() for x in (F.lit(letter), F.create_map(*pairs))])

    def decoded(name: Column) -> Column:
        found = F.when(name.startswith("#"), _numbered(name))
        for own in common:
            found = found.when(name == own, F.lit(known[own]))
        return found.otherwise(F.coalesce(names[F.substring(name, 1, 1)][name], F.concat(F.lit("&"), name, F.lit(";"))))

    found = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1)), decoded)
    pieces = F.zip_with(F.split(text, _ENTITY, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


ENTITIES: list[Rule] = [decode_entities]
SPACE: list[Rule] = [
    (r"[ \t\r]+", " "),
    (r" ?\n ?", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"^\s+|\s+$", ""),
]

TEXT_RULES = DROP + HEAD + BLOCKS + TAGS + ENTITIES + SPACE
MARKDOWN_RULES = DROP + HEAD + HEADINGS + INLINE + BLOCKS + TAGS + ENTITIES + SPACE


def apply_rules(column: Column, rules: list[Rule]) -> Column:
    return reduce(lambda c, rule: rule(c) if callable(rule) else F.regexp_replace(c, rule[0], rule[1]), rules, column)


def to_text(html: Column) -> Column:
    return apply_rules(html, TEXT_RULES)


def to_markdown(html: Column) -> Column:
    return apply_rules(html, MARKDOWN_RULES)


def plain(fragment: Column) -> Column:
    """Text of a small piece of HTML: breaks as spaces, no tags, entities decoded, trimmed."""
    return F.regexp_replace(apply_rules(fragment, BREAKS + TAGS + ENTITIES), r"^\s+|\s+$", "")


def body(html: Column) -> Column:
    return apply_rules(html, DROP)


def title(html: Column) -> Column:
    return plain(F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1))


def _all(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def headings(html: Column) -> Column:
    return F.transform(_all(html, r"(?is)<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]\s*>"), plain)


def paragraphs(html: Column) -> Column:
    return F.filter(
        F.transform(_all(html, r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"), plain), lambda p: p != ""
    )


def links(html: Column) -> Column:
    whole = _all(html, _LINK, 0)
    return F.transform(whole, lambda tag: F.regexp_replace(tag, _LINK, "$1$2$3"))
