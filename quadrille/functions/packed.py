"""A parsing expression grammar for several values in one field.

    list      <- space piece (separator piece)* space
    piece     <- quoted / bracketed / bare / nothing      ordered: the first that matches stands
    quoted    <- '"' ('""' / [^"])* '"' &(separator / end)
    bracketed <- '[' list ']' / '{' list '}' / '(' list ')'   &(separator / end)
    bare      <- (!separator any)+
    separator <- ';' / '；' / '|' / ' / ' / ' & ' / '·' / '、' / ',' / '，' / tab / line break / ' and '

A quote or bracket that its alternative does not close is backtracked to bare and flagged. After a quote or a bracket
"/" and "&" need no space. Where every quote and bracket closes is found once for the whole text, and nested lists are
read with a stack, so the time is linear in the text and the depth is not bounded.
"""

from __future__ import annotations

import re

SEPARATOR = re.compile(r"\s*(?:[;；|·、,，\t\n\r]|(?<=\s)(?:[/&]|and)(?=\s))\s*", re.I)
CLOSED_SEPARATOR = re.compile(r"\s*(?:[;；|/&·、,，\t\n\r]|(?<=\s)and(?=\s))\s*", re.I)
BARE = re.compile(r"(?:(?![;；|·、,，\t\n\r]|(?<=\s)(?:[/&]|and)\s)[\s\S])+", re.I)
SPACE = re.compile(r"\s*+")
ENDS = re.compile(r'"+|[\[\]{}()]')
BRACKETS = {"[": "]", "{": "}", "(": ")"}
# Marks for further authors that are not named, and suffixes of a name.
UNNAMED = re.compile(r"(?:(?:and|&)?\s*)(?:et\.?\s*al(?:ii|ia|\.)?|(?:and\s+)?(?:\d+\s+)?(?:more\s+)?others?|u\.?\s*a\.?|etc\.?|\.\.+|…|[-–—?]+|\.)\s*\.?", re.I)
TAIL = re.compile(r"(?:^| )(?:et\.? al(?:ii|ia|\.)?\.?|and others)$", re.I)
SUFFIX = re.compile(r"(?:jr|sr|[jJ]nr|i{1,3}|iv|v|ph\.?\s?d|m\.?\s?d|esq|d\.?\s?sc)\.?", re.I)
INITIALS = re.compile(r"(?:[^\W\d_]\.?-?){1,4}(?:\s+[^\W\d_]\.)*")

Piece = tuple[str, bool, str]  # text, whether it was quoted, the separator after it


def _after(text: str, at: int, hi: int) -> bool:
    """Whether a separator or the end ``hi`` follows."""
    return SPACE.match(text, at, hi).end() == hi or CLOSED_SEPARATOR.match(text, at, hi) is not None


def _quote_ends(text: str) -> dict[int, int]:
    """For each quote, where one that opens there closes: at the first quote that is not doubled. One pass backwards."""
    ends: dict[int, int] = {}
    later = -1  # where a quote closes that no quote of its own run does
    for m in reversed(list(re.finditer('"+', text))):
        last = m.end() - 1
        for i in range(m.start(), m.end()):
            ends[i] = last if (last - i) % 2 else later
        if len(m[0]) % 2:
            later = last
    return ends


def _bracket_ends(text: str, quotes: dict[int, int]) -> dict[int, int]:
    """For each bracket that is closed, where: quoted parts are passed over, closers of another kind too. One pass."""
    ends: dict[int, int] = {}
    wanted: list[tuple[str, int]] = []
    past, n = 0, len(text)
    follows: dict[int, bool] = {}
    for m in ENDS.finditer(text):
        if m.end() <= past:
            continue
        c = m[0][0]
        if c == '"':
            for i in range(max(past, m.start()), m.end()):
                end = quotes[i]
                if end < 0:
                    continue
                if end not in follows:
                    follows[end] = _after(text, end + 1, n)
                if follows[end]:
                    past = end + 1
                    break
        elif c in BRACKETS:
            wanted.append((BRACKETS[c], m.start()))
        elif wanted and c == wanted[-1][0]:
            ends[wanted.pop()[1]] = m.start()
    return ends


def _pieces(text: str) -> tuple[list[Piece], bool]:
    out: list[Piece] = []
    quotes = _quote_ends(text) if '"' in text else {}
    brackets = _bracket_ends(text, quotes)
    flawed, hi = False, len(text)
    i = SPACE.match(text).end()
    open_: list[tuple[int, int, int]] = []  # the lists around: their end, where they go on, pieces before
    while True:
        end = quotes.get(i, -1)
        separator = CLOSED_SEPARATOR
        if i < hi and text[i] == '"' and 0 < end < hi and _after(text, end + 1, hi):
            out.append((text[i + 1 : end].replace('""', '"'), True, ""))
            i = end + 1
        elif i < hi and text[i] in BRACKETS and (end := brackets.get(i, -1)) > 0 and end < hi and _after(text, end + 1, hi):
            open_.append((hi, end + 1, len(out)))
            i, hi = SPACE.match(text, i + 1, end).end(), end
            continue
        else:
            piece, separator = "", SEPARATOR
            if m := BARE.match(text, i, hi):
                piece, i = m[0].strip(), m.end()
                flawed = flawed or '"' in piece or piece[:1] in BRACKETS
                piece = piece.strip('"').strip()
            out.append((piece, False, ""))
        before = len(out) - 1
        while True:  # the separator after the piece, or after each list that ends here
            if sep := separator.match(text, i, hi):
                if before < len(out):
                    out[-1] = (out[-1][0], out[-1][1], sep[0].strip() or sep[0][:1])
                i = sep.end()
                break
            if (rest := SPACE.match(text, i, hi).end()) < hi:
                flawed, i = True, rest
                break
            if not open_:
                return out, flawed
            hi, i, before = open_.pop()
            separator = CLOSED_SEPARATOR


def split_packed(text: str | None) -> tuple[list[str], bool]:
    """(values, flawed): the values of a packed list of names in order. ``flawed`` tells that a
    quote or bracket was not closed properly. Null and blank text give no values.

    A comma stands inside a name where a single word is followed by given names or initials
    (surname first), or where a suffix follows; every other separator ends a value.
    """
    if text is None or not text.strip():
        return [], False
    pieces, flawed = _pieces(text)
    out: list[str] = []
    i = 0
    while i < len(pieces):
        value, quoted, mark = pieces[i]
        i += 1
        value = " ".join(value.split())
        if not quoted:
            value = TAIL.sub("", value)
        if not value or not quoted and UNNAMED.fullmatch(value):
            continue
        if not quoted and mark in (",", "，") and i < len(pieces) and not pieces[i][1]:
            given = TAIL.sub("", " ".join(pieces[i][0].split()))
            short = INITIALS.fullmatch(given) and "." in given
            if given and not UNNAMED.fullmatch(given) and (" " not in value and "." not in value or short and "." not in value):
                value, mark = f"{value}, {given}", pieces[i][2]
                i += 1
        while not quoted and mark in (",", "，") and i < len(pieces) and not pieces[i][1] and SUFFIX.fullmatch(pieces[i][0].strip()):
            value, mark = f"{value}, {pieces[i][0].strip()}", pieces[i][2]
            i += 1
        out.append(value)
    return out, flawed
