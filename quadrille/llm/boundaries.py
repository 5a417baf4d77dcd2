"""Sentence boundaries as a finite transducer over a text's marks.

The lexer turns each mark of a text (line break, end mark, quote, bracket, Thai space) with a
bounded context into a symbol of a finite alphabet. The transducer's states hold what a
boundary depends on beyond that: the open quote and where it was opened, the open bracket,
whether a list is on, and whether the unit has text yet. ``delta`` maps (state, symbol) to the
next state and an action. A chunk of text is therefore a function from states to states, and
chunks compose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

# Abbreviations that do not end a sentence whatever follows, in general use, by language.
NEVER = frozenset("""
al approx apt art asst attn ca cf ch chap chaps caps dr e.g ed eds eq eqs excl fig figs i.e incl max messrs min mr mrs ms mt mx no nos p pp par prof ref refs resp sect sec st tab viz vol vols vs
abb abs abt anh anm aufl bd bde bearb bspw bzgl bzw d.h dgl dipl einschl entspr evtl exkl frl geb gem gest ggf ggü hr hrn hrsg ing inkl insb kap lfd lt mag mio mrd nördl nr östl s.o s.u sog str südl tägl tel u.a vgl westl z.b z.t zzgl zzt
app av chap dir env ex éd fasc hab ibid mgr mlle mlles mm mme mmes ste trad tél
aprox avda cap dra ej gral núm núms pág págs profa sr sra sras sres srs srta tfno ud uds vd vds
arch avv cfr dott dott.ssa pag pagg prof.ssa sig sigg
акад г-жа г-н гл доц им инж корп млн млрд напр просп проф рис см ст стр т.е табл тыс ул
αρ βλ δηλ κ κεφ λ.χ π.χ πρβλ σελ σχ τηλ
डॉ प्रो श्री
أ د م
""".split())
# Titles, written with a capital, that stand before a name.
TITLES = frozenset("adm amb brig capt cdr cmdr col cpl fr gen gov hon insp jr lieut lt maj pfc pres pvt rep rev sen sgt sr supt".split())
# Month names cut short, which do not end a sentence before a digit.
DATED = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec jän mrz okt dez janv févr avr juil déc ene abr ago dic gen mag giu lug ott янв февр апр авг сент окт нояб дек".split())
# Abbreviations that may end a sentence; what follows decides.
MAYBE = frozenset("""
etc usw usf u.s.w a.m p.m inc ltd co corp jr sr u.k u.s u.s.a univ dept ff ph.d
т.д т.п т.к г др κ.λπ κλπ κτλ π.μ μ.μ
""".split())
# German words that an ordinal number stands before.
MONTHS = frozenset("""
Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember
Tag Woche Monat Quartal Halbjahr Jahr Jahrzehnt Jahrhundert Jahrtausend Semester Geburtstag Jahrestag Weltkrieg Mal
Abschnitt Absatz Auflage Ausgabe Band Kapitel Teil Etage Stock Klasse Platz Rang Runde Sitzung Spieltag
""".split())

ENDS = ".!?…。！？।॥؟"
OPEN_QUOTES = {"“": 2, "„": 3, "«": 4, "「": 5, "『": 6}
CLOSE_QUOTES = {"”": (2, 3), "“": (3,), "»": (4,), "」": (5,), "』": (6,)}
BRACKETS_OPEN, BRACKETS_CLOSE = "([（［【", ")]）］】"
OPENERS = "\"'“„«「『([（［【¿¡‘"
THAI = "฀-๿"
UNCASED = re.compile(rf"[{THAI}֐-ࣿऀ-෿ᄀ-ᇿ぀-ヿ㄰-㆏㐀-鿿가-힣]")
THAI_CHAR = re.compile(f"[{THAI}]")
CJK = re.compile(r"[぀-ヿ㐀-鿿]")
MARK = re.compile(
    rf"[ \t\xa0]*(?:\r\n|[\n\r\x0b\x0c\x85  ])\s*"
    rf"|(?<=[{THAI}])[ \t\xa0]+"
    r"|[.!?…。！？।॥؟]+(?:[ \xa0]?[.!?…]+)*"
    r"|[;;](?=\s|$)"
    r'|["“”„«»「」『』()\[\]（）［］【】]'
)
BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
ITEM = re.compile(r"(?:[-*•‣◦▪·–][ \t\xa0]+|\(?(\d{1,3})[.)][ \t\xa0]+|\(?[a-z]\)[ \t\xa0]+)(?=\S)")
#: From some place before it up to a mark: all the words but the last, then that one.
WORD = re.compile(r"(?:[^\s\"“”„«»「」()\[\]（）,;:]*+[\s\"“”„«»「」()\[\]（）,;:])*+([^\s\"“”„«»「」()\[\]（）,;:]*+)")
SPACED_ABBR = re.compile(r"(?:^|[\s(„«\"“])([^\W\d_])\.[\s\xa0]{1,2}([^\W\d_])$")
NEXT_WORD = re.compile(r"\w+")
JOINED = re.compile(r"(?<=[a-zß-öø-ÿ]{2}[.!?])(?=[A-ZÀ-Þ])|(?<=[a-zß-öø-ÿ]{2})\.(?=[A-ZÀ-Þ])")
DAY_BEFORE = re.compile(r"(?:^|[^\d.,:])\d{1,2}$")
#: Characters of context that a symbol may depend on, on either side.
CONTEXT = 80

State = int
#: (quote, opened where) x bracket x list x fresh. Quote 0 is none, 1 straight; opened: 0 inside, 1 at the unit's start, 2 after a colon.
QUOTES = [(0, 0)] + [(q, w) for q in range(1, 7) for w in range(3)]
STATES = [(q, w, b, inlist, fresh) for q, w in QUOTES for b in range(3) for inlist in range(2) for fresh in range(2)]
NUMBER = {s: i for i, s in enumerate(STATES)}
START: State = NUMBER[(0, 0, 0, 0, 1)]
NONE, AFTER, BEFORE = 0, 1, 2  # actions


@lru_cache(maxsize=None)
def delta(state: State, text: int, symbol: tuple) -> tuple[State, int]:
    """The transducer. ``text``: 0 nothing stood before the mark, 1 digits only, 2 other text."""
    q, w, b, inlist, fresh = STATES[state]
    kind = symbol[0]
    fresh_before = fresh
    if text:
        fresh = 0

    def to(action: int = NONE, **new) -> tuple[State, int]:
        v = {"q": q, "w": w, "b": b, "inlist": inlist, "fresh": fresh} | new
        if action and "fresh" not in new:
            v["fresh"] = 1
        if not v["q"]:
            v["w"] = 0
        return NUMBER[(v["q"], v["w"], v["b"], v["inlist"], v["fresh"])], action

    if kind == "blank":
        return NUMBER[(0, 0, 0, 0, 1)], BEFORE
    if kind == "item":
        if symbol[1] or inlist:
            return NUMBER[(0, 0, 0, 1, 1)], BEFORE
        return to()
    if kind == "bullet":  # the item's own mark at a unit's start
        return to(inlist=1, fresh=1) if fresh_before and not q and not b else to()
    if kind == "end":  # symbol[1]: a boundary outside quotes and brackets
        if text == 1 and symbol[2] and fresh_before and not q and not b:
            return to(inlist=1, fresh=1)  # a number and a dot that begin a unit are its mark
        if symbol[1] and not q and not b:
            return to(AFTER)
        return to(fresh=0)
    if kind == "space":
        return to(BEFORE) if not q and not b else to()
    if kind == "quote":
        _, opens, closes, colon, after = symbol
        if q and (q in closes or q == 1 and opens == 1):
            done = after == 1 or after == 2 and w == 2
            return to(AFTER, q=0) if done and not b else to(q=0, fresh=0)
        if not q and opens:
            return to(q=opens, w=2 if colon else 1 if fresh else 0, fresh=0)
        return to(fresh=0)
    if kind == "open":
        return to(b=b or (2 if fresh and not q else 1), fresh=0)
    if kind == "close":
        return to(AFTER, b=0) if b == 2 and symbol[1] and not q else to(b=0, fresh=0)
    raise ValueError(kind)


def _next(text: str, at: int) -> tuple[str, bool, int]:
    """The next character that is no space, or empty, whether space stands before it, and its place."""
    i, n = at, min(len(text), at + CONTEXT)
    while i < n and text[i].isspace():
        i += 1
    return (text[i] if i < n else ""), i > at, i


def _starts(text: str, i: int) -> bool:
    """Whether a sentence of a cased script may start here: upper case, an inner capital, or an opener before one."""
    while i < len(text) and text[i] in OPENERS:
        i += 1
        while i < len(text) and text[i] in " \xa0":
            i += 1
    c = text[i : i + 1]
    return c.isupper() or c.istitle() or c.islower() and text[i + 1 : i + 2].isupper()


def _after_close(text: str, at: int, end_inside: bool) -> int:
    """What follows a closing quote or bracket: 0 no boundary, 1 one, 2 one if the quote followed a colon."""
    if not end_inside:
        return 0
    c, spaced, i = _next(text, at)
    if not c:
        return 1
    if c in ENDS or c in ",;:，、；：)]）」』”»" and not spaced:
        return 0
    if UNCASED.match(c):
        return 2
    if c.isdigit():
        return 1 if spaced else 2
    if c in "-–—":
        return 0
    if _starts(text, i):
        return 1 if spaced or c in OPENERS else 2
    if c in OPENERS and not text[i + 1 : i + 2].islower():
        return 1 if spaced else 2
    return 0


def _full_stop(text: str, at: int, end: int) -> bool:
    """Whether the single dot at ``at`` ends a sentence, by the word before and what follows."""
    word = JOINED.split(WORD.match(text, max(0, at - CONTEXT), at)[1])[-1]
    c, spaced, i = _next(text, end)
    if not c:
        return True
    low = word.lower().lstrip("'’¿¡<")
    if m := SPACED_ABBR.search(text, max(0, at - 8), at):
        low = f"{m[1]}.{m[2]}".lower()
    if not spaced:
        if UNCASED.match(c):
            return bool(word) and not word[-1:].isdigit() or CJK.match(c) is not None and not c.isdigit()
        plain = len(word) > 1 and word[-1].islower() and not re.search(r"[./:@_\\]", word) and low not in NEVER
        if c.isupper() and plain:
            follow = NEXT_WORD.match(text, i)[0]
            return len(follow) == 1 and text[i + 1 : i + 2] in " '’" or follow[1:].islower() or follow[1:2].isupper() is False and len(follow) > 1
        return c in "\"“«„(" and plain and _starts(text, i)
    if low in NEVER or low in TITLES and word[:1].isupper() and c.isupper():
        return False
    if c.isdigit():
        return low not in DATED and (low in MAYBE or bool(word) and not (len(word) == 1 and word.isalpha()))
    if c.islower() and not _starts(text, i):
        return False
    if low not in MAYBE and len(word) == 1 and word.isalpha() and (word.isupper() or not UNCASED.match(word)):
        return False
    if "." in low and low not in MAYBE and re.fullmatch(r"(?:\w\.)+\w", low):
        return False
    if DAY_BEFORE.search(text, max(0, at - 5), at) and (m := NEXT_WORD.match(text, i)) and m[0] in MONTHS:
        return False
    if c in OPENERS:
        return _starts(text, i) or UNCASED.match(text[i + 1 : i + 2]) is not None or text[i + 1 : i + 2].isdigit()
    return _starts(text, i) or UNCASED.match(c) is not None or c in "-–—#*•<" or not (c.isalpha() or c in ",;:)]}%»”=.")


def _ends(text: str, at: int, end: int) -> bool:
    """Whether the run of end marks is a boundary outside quotes and brackets."""
    run = text[at:end]
    if run == ".":
        return _full_stop(text, at, end)
    if run in ";;":
        before = text[at - 1 : at]
        c, _, i = _next(text, end)
        return "Ͱ" <= before <= "Ͽ" or "ἀ" <= before <= "῿" if (not c or _starts(text, i) or UNCASED.match(c) or c.isdigit()) else False
    c, spaced, i = _next(text, end)
    if not c:
        return True
    if c in ",;:，、；：" or c in ")]）」』”»":
        return False
    if run[-1] in "。！？।॥؟":
        return True
    if set(run) <= set(".… \xa0"):
        return spaced and (_starts(text, i) or run[0] not in "…" and UNCASED.match(c) is not None and not CJK.match(c))
    if not spaced:
        return UNCASED.match(c) is not None or c.isupper() and text[i + 1 : i + 2].islower() or c in "«“„¿¡"
    return not c.islower() or _starts(text, i)


def symbols(text: str, begin: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, int, tuple]]:
    """(start, end, text kind before, symbol) of each mark that starts in text[begin:stop].

    Symbols look at most CONTEXT characters beyond the mark, so a chunk with that much of its
    neighbours gives the same symbols as the whole text.
    """
    stop = len(text) if stop is None else stop
    last = begin
    first = len(text) - len(text.lstrip())
    if begin == 0 and (m := ITEM.match(text, first)):
        yield first, m.end(), 0, ("bullet",)
        last = m.end()
    for m in MARK.finditer(text, last, min(len(text), stop + CONTEXT)):
        at, end = m.span()
        if at >= stop:
            break
        if at < last:
            continue
        between = text[last:at].strip()
        kind = 0 if not between else 1 if between.isdigit() else 2
        c = m[0][0]
        if c.isspace():
            breaks = BREAK.findall(m[0])
            item = ITEM.match(text, end)
            if len(breaks) > 1:
                yield at, end, kind, ("blank",)
            elif breaks and item:
                n = item[1]
                dated = n and (w := NEXT_WORD.match(text, item.end())) and w[0] in MONTHS
                before = WORD.match(text, max(0, at - CONTEXT), at)[1].lower()
                held = before.endswith(".") and before[:-1] in NEVER
                if dated or held:
                    item = None
                else:
                    yield at, end, kind, ("item", n is None or int(n) == 1)
            if item and breaks:
                yield end, item.end(), 0, ("bullet",)
                last = item.end()
                continue
            if len(breaks) < 2 and not (breaks and item):
                if at and THAI_CHAR.match(text, at - 1):
                    rest = text[end : end + 24]
                    if THAI_CHAR.match(rest) or _starts(text, end) or re.match(r"\d+\s+[A-Za-z]{2}", rest) or rest[:1] in "\"“":
                        yield at, end, kind, ("space",)
                        last = end
                        continue
                continue
            last = end
            continue
        if c in ENDS or c in ";;":
            yield at, end, kind, ("end", _ends(text, at, end), m[0] == "." and kind == 1)
        elif c in BRACKETS_OPEN:
            yield at, end, kind, ("open",)
        elif c in BRACKETS_CLOSE:
            before = text[max(0, at - 4) : at].rstrip()[-1:]
            yield at, end, kind, ("close", before != "" and before in ENDS and _after_close(text, end, True) > 0)
        else:
            before = text[max(0, at - 4) : at].rstrip()[-1:]
            opens = 1 if c == '"' else OPEN_QUOTES.get(c, 0)
            yield at, end, kind, ("quote", opens, CLOSE_QUOTES.get(c, ()), before in (":", "："), _after_close(text, end, before != "" and before in ENDS))
        last = end


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence of a whole text: one pass from the start state."""
    out: list[tuple[int, int]] = []
    state, begin = START, 0
    for at, end, kind, symbol in symbols(text):
        state, action = delta(state, kind, symbol)
        if action:
            cut = at if action == BEFORE else end
            _add(out, text, begin, cut)
            begin = cut
    _add(out, text, begin, len(text))
    return out


def _add(out: list[tuple[int, int]], text: str, begin: int, end: int) -> None:
    while begin < end and text[begin].isspace():
        begin += 1
    while end > begin and text[end - 1].isspace():
        end -= 1
    if end > begin:
        out.append((begin, end))


# The finite alphabet, and the transducer as tables: a state is a byte, so a function on states is a string of bytes
# and two functions are composed by one ``translate``.
QUOTE_MARKS = sorted({(1, ())} | {(OPEN_QUOTES.get(c, 0), CLOSE_QUOTES.get(c, ())) for c in [*OPEN_QUOTES, *CLOSE_QUOTES]})
ALPHABET = [
    ("blank",), ("item", False), ("item", True), ("bullet",), ("space",), ("open",), ("close", False), ("close", True),
    *[("end", x, y) for x in (False, True) for y in (False, True)],
    *[("quote", o, c, colon, after) for o, c in QUOTE_MARKS for colon in (False, True) for after in range(3)],
]
CODES = {(kind, symbol): 3 * i + kind for i, symbol in enumerate(ALPHABET) for kind in range(3)}
IDENTITY = bytes(range(len(STATES)))


def _table(pick: int) -> list[bytes]:
    """For each code, what each state gives: ``pick`` 0 the next state, 1 the action; filled up to 256 for translate."""
    return [bytes(delta(s, code % 3, ALPHABET[code // 3])[pick] for s in range(len(STATES))).ljust(256, b"\0") for code in range(3 * len(ALPHABET))]


STEPS, ACTIONS = _table(0), _table(1)
#: Symbols at which a unit may end before the mark; all others that end one end it after.
CUT_BEFORE = frozenset(CODES[kind, symbol] for kind, symbol in CODES if symbol[0] in ("blank", "item", "space"))
CUTS = frozenset(c for c, row in enumerate(ACTIONS) if any(row))


def chunk_marks(text: str, begin: int, stop: int) -> tuple[bytes, list[int], list[int]]:
    """(codes, ends, starts) of the marks of text[begin:stop]: where the unit before would end and the one after
    begin, white space left out, if the transducer cuts there. Offsets count from ``begin``."""
    codes, ends, starts = bytearray(), [], []
    for at, end, kind, symbol in symbols(text, begin, stop):
        code = CODES[kind, symbol]
        codes.append(code)
        if code not in CUTS:
            ends.append(0)
            starts.append(0)
            continue
        e = s = at if code in CUT_BEFORE else end
        while e > begin and text[e - 1].isspace():
            e -= 1
        while s < stop and text[s].isspace():
            s += 1
        ends.append(e - begin)
        starts.append(s - begin)
    return bytes(codes), ends, starts


def chunk_function(codes: bytes) -> bytes:
    """The state each start state ends in."""
    out = IDENTITY
    for c in codes:
        out = out.translate(STEPS[c])
    return out


def composed(first: bytes, second: bytes) -> bytes:
    """The function that does ``first``, then ``second``."""
    return first.translate(second.ljust(256, b"\0"))


def chunk_cuts(codes: bytes, ends: list[int], starts: list[int], state: State) -> list[tuple[int, int]]:
    """(end of the unit before, start of the one after) of each cut of a chunk entered in ``state``."""
    out = []
    for c, e, s in zip(codes, ends, starts):
        if ACTIONS[c][state]:
            out.append((e, s))
        state = STEPS[c][state]
    return out
