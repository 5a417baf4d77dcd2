"""Statement lines read strictly: a bulk pattern for blocks, and a diagnosis of single lines."""

from __future__ import annotations

import datetime
import re

# The lexical spaces of the XSD datatypes that are checked (dates also against the calendar).
ZONE = r"(?:Z|[+-](?:0\d|1[0-3]):[0-5]\d|[+-]14:00)?"
DAY = r"-?(?:[1-9]\d{3,}|0\d{3})-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
YEAR = r"-?(?:[1-9]\d{3,}|0\d{3})"
CLOCK = r"T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?"
BASE64 = r"[A-Za-z0-9+/] ?"
NAME_START = r"A-Z_a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02FF\u0370-\u037D\u037F-\u1FFF\u200C-\u200D\u2070-\u218F\u2C00-\u2FEF\u3001-\uD7FF\uF900-\uFDCF\uFDF0-\uFFFD\U00010000-\U000EFFFF"
NAME_CHAR = NAME_START + r"0-9.\u00B7\u0300-\u036F\u203F-\u2040\-"
NC_NAME = f"[{NAME_START}][{NAME_CHAR}]*"
QNAME = f"(?:{NC_NAME}:)?{NC_NAME}"
NMTOKEN = f"[:{NAME_CHAR}]+"
UNSIGNED = r"\+?\d+|-0+"
XSD = {
    "string": r"[\s\S]*",
    "boolean": r"true|false|1|0",
    "integer": r"[+-]?\d+",
    "decimal": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)",
    "double": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|[+-]?INF|NaN",
    "float": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|[+-]?INF|NaN",
    "date": DAY + ZONE,
    "dateTime": DAY + r"T(?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?|24:00:00(?:\.0+)?)" + ZONE,
    "time": r"(?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?|24:00:00(?:\.0+)?)" + ZONE,
    "gYear": r"-?(?:[1-9]\d{3,}|0\d{3})" + ZONE,
    "anyURI": r"[\s\S]*",
    "nonNegativeInteger": r"\+?\d+|-0+",
    "positiveInteger": r"\+?0*[1-9]\d*",
    "long": r"[+-]?\d+",
    "int": r"[+-]?\d+",
    "short": r"[+-]?\d+",
    "byte": r"[+-]?\d+",
    "nonPositiveInteger": r"-\d+|\+?0+",
    "negativeInteger": r"-0*[1-9]\d*",
    "unsignedLong": UNSIGNED,
    "unsignedInt": UNSIGNED,
    "unsignedShort": UNSIGNED,
    "unsignedByte": UNSIGNED,
    "dateTimeStamp": DAY + r"T(?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?|24:00:00(?:\.0+)?)" + ZONE.removesuffix("?"),
    "duration": rf"-?P(?!\Z)(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:{CLOCK})?",
    "yearMonthDuration": r"-?P(?!\Z)(?:\d+Y)?(?:\d+M)?",
    "dayTimeDuration": rf"-?P(?!\Z)(?:\d+D)?(?:{CLOCK})?",
    "gYearMonth": YEAR + r"-(?:0[1-9]|1[0-2])" + ZONE,
    "gMonthDay": r"--(?:(?:0[13578]|1[02])-(?:0[1-9]|[12]\d|3[01])|(?:0[469]|11)-(?:0[1-9]|[12]\d|30)|02-(?:0[1-9]|[12]\d))" + ZONE,
    "gMonth": r"--(?:0[1-9]|1[0-2])" + ZONE,
    "gDay": r"---(?:0[1-9]|[12]\d|3[01])" + ZONE,
    "hexBinary": r"(?:[0-9A-Fa-f]{2})*",
    "base64Binary": rf"(?:(?:{BASE64}){{4}})*(?:(?:{BASE64}){{3}}[A-Za-z0-9+/]|(?:{BASE64}){{2}}[AEIMQUYcgkosw048] ?=|{BASE64}[AQgw] ?= ?=)|",
    "normalizedString": r"[^\t\n\r]*",
    "token": r"(?:[^ \t\n\r]+(?: [^ \t\n\r]+)*)?",
    "language": r"[A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*",
    "Name": f"[:{NAME_START}][:{NAME_CHAR}]*",
    "NMTOKEN": NMTOKEN,
    "NMTOKENS": f"{NMTOKEN}(?: {NMTOKEN})*",
    **dict.fromkeys(("NCName", "ID", "IDREF", "ENTITY"), NC_NAME),
    **dict.fromkeys(("IDREFS", "ENTITIES"), f"{NC_NAME}(?: {NC_NAME})*"),
    **dict.fromkeys(("QName", "NOTATION"), QNAME),
}
#: Least and greatest value of the bounded integers.
BOUNDS = {k: (-(2**n), 2**n - 1) for k, n in {"long": 63, "int": 31, "short": 15, "byte": 7}.items()}
BOUNDS |= {k: (0, 2**n - 1) for k, n in {"unsignedLong": 64, "unsignedInt": 32, "unsignedShort": 16, "unsignedByte": 8}.items()}
XSD_RE = {k: re.compile(v, re.ASCII) for k, v in XSD.items()}
XSD_NAMES = ("xsd:", "http://www.w3.org/2001/XMLSchema#")

IRI_BODY = r"(?:[^\x00-\x20<>\"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*+"
TEXT_BODY = r'(?:[^"\\\n\r]|\\[tbnrf"\'\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*+'
LANG = r"[A-Za-z]+(?:-[A-Za-z0-9]+)*"
NODE = r"_:[^\s<>\"]+"
IRI_RE = re.compile(IRI_BODY)
LANG_RE = re.compile(LANG)
NODE_RE = re.compile(NODE)
TEXT_RE = re.compile(TEXT_BODY)

# What the bulk pattern takes is valid; what it refuses may yet be (rare datatypes, the last days of a month).
SAFE_DAY = r"[1-9]\d{3}-(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])"
SAFE_ZONE = r"(?:Z|[+-](?:0\d|1[0-3]):[0-5]\d)?"
SAFE_TYPED = (
    r'"[+-]?[0-9]+"\^\^<xsd:(?:integer|decimal|double)>'
    r'|"[+-]?[0-9]*\.[0-9]+"\^\^<xsd:(?:decimal|double)>'
    r'|"(?:true|false|1|0)"\^\^<xsd:boolean>'
    rf'|"{SAFE_DAY}{SAFE_ZONE}"\^\^<xsd:date>'
    rf'|"{SAFE_DAY}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d{SAFE_ZONE}"\^\^<xsd:dateTime>'
)
PLAIN_IRI = IRI_BODY.removesuffix("+")  # the columnar matcher has no possessive forms, and needs none
PLAIN_TEXT = TEXT_BODY.removesuffix("+")
SAFE_OBJECT = rf'<{PLAIN_IRI}>|{SAFE_TYPED}|"{PLAIN_TEXT}"(?:@{LANG}|\^\^<xsd:string>)?|_:[^\s<>"]+'
#: A line that is surely valid, for the columnar matcher (linear time).
BULK = rf'^(?P<s><{PLAIN_IRI}>|_:[^\s<>"]+) (?P<p><{PLAIN_IRI}>) (?P<o>{SAFE_OBJECT})(?: (?P<g><{PLAIN_IRI}>))? \.$'

Statement = tuple[str, str, str, str | None]


def valid_text(text: str, datatype: str) -> bool:
    """Whether text is in the lexical space of the datatype; unknown datatypes hold any text."""
    name = next((datatype[len(p):] for p in XSD_NAMES if datatype.startswith(p)), None)
    if name not in XSD_RE:
        return True
    if not XSD_RE[name].fullmatch(text):
        return False
    if name in ("date", "dateTime", "dateTimeStamp"):
        year, month, day = re.match(r"(-?\d+)-(\d\d)-(\d\d)", text).groups()
        if day > "28":
            try:
                datetime.date(2000 + int(year) % 400, int(month), int(day))
            except ValueError:
                return False
    if name not in BOUNDS:
        return True
    low, high = BOUNDS[name]
    digits = text.lstrip("+-").lstrip("0") or "0"
    return len(digits) <= 20 and low <= int(digits) * (-1 if text[0] == "-" else 1) <= high


def unescaped(text: str) -> str:
    """The characters that a literal's escapes stand for."""
    def one(m: re.Match) -> str:
        if m[1][0] not in "uU":
            return {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}.get(m[1], m[1])
        n = int(m[1][1:], 16)
        return chr(n) if n <= 0x10FFFF else m[0]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text) if "\\" in text else text


def diagnose(line: str) -> tuple[str | None, Statement | None]:
    """(reason, None) of a broken line, or (None, statement). The first reason that holds is given:
    quoting, terms, value. The whole line is scanned before one of a later kind is given."""
    terms: list[tuple[str, str]] = []
    cut = wrong = False
    dots, after, i, n = 0, False, 0, len(line)
    while i < n:
        c = line[i]
        if c in " \t\r\n":
            i += 1
            continue
        after = after or dots > 0
        if c == "<":
            end = line.find(">", i + 1)
            body = line[i + 1 : end] if end >= 0 else line[i + 1 :]
            if end < 0 or "<" in body or '"' in body and " " in body:
                cut = True
                step = re.compile(r"[^\s<]*").match(line, i + 1).end()
                terms.append(("iri", line[i:step]))
                i = step
                continue
            wrong = wrong or not IRI_RE.fullmatch(body)
            terms.append(("iri", line[i : end + 1]))
            i = end + 1
        elif c == "_" and line.startswith("_:", i):
            m = NODE_RE.match(line, i)
            if not m:
                cut, i = True, i + 2
                continue
            terms.append(("node", m[0]))
            i = m.end()
        elif c == '"':
            m = TEXT_RE.match(line, i + 1)
            start, i = i, m.end()
            if i >= n or line[i] != '"':
                return "quoting", None
            text = line[start + 1 : i]
            i += 1
            if i < n and line[i] == "@":
                end = re.compile(r"[^\s<\"]*").match(line, i + 1).end()
                wrong = wrong or not LANG_RE.fullmatch(line[i + 1 : end])
                i = end
            elif line.startswith("^^", i):
                i += 2
                end = line.find(">", i)
                if not line.startswith("<", i) or end < 0 or re.search(r"[\s<]", line[i + 1 : end]):
                    cut = True
                    i = re.compile(r"[^\s]*").match(line, i).end()
                else:
                    wrong = wrong or not IRI_RE.fullmatch(line[i + 1 : end]) or not valid_text(unescaped(text), line[i + 1 : end])
                    i = end + 1
            elif i < n and line[i] not in " \t.":
                return "quoting", None
            terms.append(("text", line[start:i]))
            continue
        elif c == "." and (i + 1 == n or line[i + 1] in " \t"):
            dots, i = dots + 1, i + 1
            continue
        elif c == "#" and dots and not cut:
            dots += 1
            break
        else:
            end = re.compile(r"\S+").match(line, i).end()
            word = line[i:end]
            if ">" in word and not re.search(r"['\"‘-‟]|\^\^|@", word) or c == "^" or c == "@":
                cut = True
                i = end
                continue
            return "quoting", None
        if i < n and line[i] not in " \t" and not (line[i] == "." and i + 1 == n):
            cut = True
    if cut or after or dots != 1 or len(terms) not in (3, 4):
        return "terms", None
    kinds = [k for k, _ in terms]
    if kinds[0] == "text" or kinds[3:] == ["text"]:
        return "terms", None
    if wrong or kinds[1] != "iri":
        return "value", None
    return None, (terms[0][1], terms[1][1], terms[2][1], terms[3][1] if len(terms) == 4 else None)
