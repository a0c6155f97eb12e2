r"""The patterns in the words of DuckDB, whose own word edges and white space are ASCII.

Two marks are put before and behind every run of letters, digits and underscores of a
text, so that \b is a mark and any other piece of a pattern may have some before it.
There are two since one match may end at the edge where the next begins. Found texts
lose their marks again.
"""

from __future__ import annotations

import re

#: A private-use character that no text holds.
MARK = r"\x{E000}"
_WORD, _SPACE, _DIGIT = r"\p{L}\p{N}_", r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}", r"\p{Nd}"
_PIECE = re.compile(r"\(\?(?:[:=!]|[a-z]+\))|\\b|\[(?:\\.|[^\]])*\]|\\.|[()|^$]|.", re.S)
_QUANTIFIER = re.compile(r"[*+?]|\{\d+(?:,\d*)?\}")


def sql_pattern(pattern: str, marked: bool = True) -> str:
    r"""``pattern`` for marked texts (see :func:`marked`), or without ``marked`` for plain ones.

    A lookahead becomes part of the match, which changes nothing where no match can
    begin with what it holds.
    """
    out, at = [], 0
    while at < len(pattern):
        piece = _PIECE.match(pattern, at).group()
        at += len(piece)
        if piece == r"\b":
            out.append(MARK)
        elif piece in ("(?i)", "(?iu)"):
            out.append("(?i)")
        elif piece == "(?=":
            out.append("(?:")
        elif piece.startswith("(") or piece in ")|^$":
            out.append(piece)
        else:
            inside = piece.startswith("[")
            for short, long in ((r"\w", _WORD), (r"\s", _SPACE), (r"\d", _DIGIT)):
                piece = piece.replace(short, long if inside else f"[{long}]")
            times = _QUANTIFIER.match(pattern, at)
            one = f"{MARK}*{piece}" if marked else piece
            out.append(f"(?:{one})" if times and marked else one)
            if times:
                out.append(times.group())
                at = times.end()
            continue
        times = _QUANTIFIER.match(pattern, at) if piece == ")" else None
        if times:
            out.append(times.group())
            at = times.end()
    return "".join(out).replace("'", "''")


def marked(text: str) -> str:
    """``text`` with marks around its words."""
    return rf"regexp_replace(coalesce({text}, ''), '([{_WORD}]+)', '{2 * chr(0xE000)}\1{2 * chr(0xE000)}', 'g')"


def stripped(text: str) -> str:
    """``text`` without white space of any kind at its ends."""
    space = r"[\s\x{0B}\x{85}\p{Z}]+"
    return f"regexp_replace({text}, '^{space}|{space}$', '', 'g')"


def plain(text: str) -> str:
    """``text`` without marks."""
    return f"replace({text}, '{chr(0xE000)}', '')"


def first(text: str, pattern: str, group: int = 1, with_marks: bool = True) -> str:
    """The first match of a group, or null."""
    found = f"regexp_extract({marked(text) if with_marks else text}, '{sql_pattern(pattern, with_marks)}', {group})"
    return f"nullif({plain(found) if with_marks else found}, '')"


def every(text: str, pattern: str, with_marks: bool = True) -> str:
    """All matches of the first group, in order."""
    found = f"regexp_extract_all({marked(text) if with_marks else text}, '{sql_pattern(pattern, with_marks)}', 1)"
    return f"list_transform({found}, lambda m: {plain('m')})" if with_marks else found
