"""Names of persons and organisations brought to comparable tokens."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# Words of organisation names with their usual forms and translations. Other abbreviations are found by
# a rule (``abbreviates``), acronyms by another (``initial_runs``).
WORDS = {
    "academy": "acad academy akademie academie academia accademia", "administration": "admin administration", "agency": "agency agcy agentur agence agencia agenzia", "agriculture": "agric agriculture agricultural", "applied": "appl applied angewandte",
    "archive": "arch archive archives archiv archivio archivo", "art": "art arts", "association": "assoc assn association", "biology": "biol biology biological", "board": "board", "botanic": "bot botanical botanic botanique botanischer", "bureau": "bureau", "business": "business",
    "center": "ctr cent center centre zentrum centro centrum", "chemistry": "chem chemistry chemical chimie chemie", "children": "children childrens child", "city": "city", "clinic": "clinic klinik clinique clinica", "college": "coll college", "commission": "commission kommission",
    "committee": "committee cttee", "communication": "commun communication communications", "company": "co company", "computing": "comput computing", "conservatory": "conserv conservatory conservatoire konservatorium conservatorio", "corporation": "corp corporation", "council": "council rat conseil consejo",
    "data": "data daten donnees datos", "department": "dept department departement", "development": "dev development", "economics": "econ economics", "education": "educ education", "electrical": "elec electrical", "energy": "energy energie energia", "engineering": "eng engr engineering",
    "environment": "environ environment environmental", "federal": "fed federal bundes", "foundation": "found fdn foundation stiftung fondation fundacion fondazione", "free": "free", "garden": "garden gardens jardin garten", "general": "gen general", "government": "govt government", "graph": "graph",
    "health": "health", "history": "hist history", "hospital": "hosp hospital hopital krankenhaus ospedale", "industry": "ind industry industries industrial", "informatics": "inform informatics informatik informatique", "information": "info information", "institute": "inst institute institut instituto istituto institutes",
    "international": "int intl international", "laboratory": "lab labs laboratory laboratories labor laboratoire laboratorio", "library": "lib libr library bibliothek bibliotheque biblioteca", "linguistics": "ling linguistics", "management": "mgmt management", "materials": "mater materials", "mathematics": "math maths mathematics mathematik mathematiques",
    "mechanical": "mech mechanical", "medicine": "med medical medicine medizin", "ministry": "ministry ministerium ministere ministerio ministero", "museum": "mus museum musee museo", "music": "music musik musique", "national": "nat natl national natural nationale", "naval": "nav naval", "nuclear": "nucl nuclear",
    "observatory": "obs observatory observatoire sternwarte observatorio", "office": "off office", "philosophy": "philos philosophy", "physics": "phys physics physik physique fisica", "policy": "policy", "polytechnic": "poly polytech polytechnic politecnico polytechnique polytechnikum", "psychology": "psych psychology",
    "record": "rec records record", "research": "res research recherche forschung", "royal": "royal", "school": "sch school ecole schule escuela scuola", "science": "sci science sciences wissenschaften scienze", "service": "svc service services", "society": "soc society gesellschaft societe sociedad",
    "state": "state staats", "statistics": "stat stats statistics statistical", "system": "sys system systems", "tech": "tech techn technical technische technology technol technological technique technologies", "telecom": "telecom telecommunications telecommunication",
    "university": "univ uni u universitat universitaet universite universidad universita universidade universities university", "veterinary": "vet veterinary", "web": "web",
}
# A word or usual acronym that stands for several words.
PHRASES = {"hochschule": "university applied science", "fachhochschule": "university applied science", "uas": "university applied science", "tu": "tech university"}
STOP = frozenset("of for f fur the and de di du des der da della la le et und in at".split())
DEPARTMENT = re.compile(r"\s*(?:dept|department|faculty|fac|chair|division|div|section|group|lehrstuhl|institut fur|school of engineering)\b", re.I)
CANON = {w: k for k, words in WORDS.items() for w in words.split()}

# Given names and short forms in general use that no rule of shortening gives, in several languages.
NICKNAMES = {
    "abigail": "gail", "albert": "bert", "alexander": "sasha sandy xander sander", "alexandra": "sasha sandra sandy", "alfred": "fred", "amina": "mina", "andrew": "drew", "ann": "nancy nan", "anna": "anya ania", "anthony": "tony", "antonio": "toni tonio nino", "barbara": "babs", "beatrice": "trixie",
    "beatriz": "trixie betty", "bernard": "barney", "caroline": "carrie lina", "carolina": "carrie lina", "catherine": "kate kathy kitty", "charles": "chuck", "christina": "tina kris", "christine": "tina kris", "christopher": "kit topher kris", "daniela": "ela", "deborah": "debbie", "dmitri": "dima mitya",
    "dorothea": "thea dot dottie", "dorothy": "dot dottie dolly", "edward": "ted teddy ned", "eleanor": "nell nora", "elisabeth": "liz lizzie lisa beth bess betty betsy libby elsa sissi", "elizabeth": "liz lizzie lisa beth bess betty betsy libby elsa", "emmanuel": "manny", "eugene": "gene", "evgeny": "zhenya",
    "fatima": "tima", "federico": "rico", "fernando": "nando", "frances": "fanny", "francis": "frank", "francisco": "paco pancho", "francois": "frank", "frederick": "rick fritz", "friedrich": "fritz", "gabriela": "ela", "georgios": "george yorgos giorgos", "gerald": "jerry", "gertrude": "trudy", "giovanni": "gianni",
    "giuseppe": "beppe pino", "guillermo": "memo", "harold": "harry hal", "helen": "nell", "helena": "lena", "henry": "harry hank hal", "hubert": "bert", "ignacio": "nacho", "isabel": "bella izzy belle", "ivan": "vanya", "jacob": "jake", "james": "jim jimmy jamie", "johannes": "hans hannes", "john": "jack", "jose": "pepe",
    "josef": "sepp", "joseph": "joe jo", "katarina": "kate kathy katja katya rina", "katarzyna": "kasia", "katherine": "kate katie kitty", "lars": "lasse", "lawrence": "larry", "leonardo": "nardo leon", "ludmila": "mila lyuda", "magdalena": "lena", "malgorzata": "gosia", "manuel": "manolo", "margaret": "peggy meg maggie daisy greta",
    "maria": "masha", "mary": "molly polly", "matilda": "tilda", "matthias": "hias matze", "michael": "mike mick mickey", "mikhail": "misha", "natalia": "natasha", "nicholas": "nick nicky", "nikolai": "kolya", "nikolaos": "nick niko nikos klaus", "nikolaus": "klaus", "olga": "olya", "oscar": "ossi", "oskar": "ossi", "patricia": "tricia trish",
    "pavel": "pasha", "petr": "petya", "rebecca": "becky becca", "richard": "dick rick", "robert": "bob bobby bert", "rosalind": "roz linda", "rudolf": "rolf", "sarah": "sally", "sebastian": "bastian", "sergei": "seryozha", "sofia": "sonya sophie", "stephen": "steve", "susan": "sue", "svetlana": "lana", "tatiana": "tanya",
    "theodor": "ted teddy", "theodore": "ted teddy", "thomas": "tom tommy", "ulrich": "uli", "ursula": "uschi ulla", "valentina": "tina", "viktor": "vic vitya", "victoria": "tori", "vladimir": "volodya vova", "william": "bill billy liam", "xavier": "javi", "yusuf": "joe",
}
FULL_OF: dict[str, tuple[str, ...]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        FULL_OF[_s] = (*FULL_OF.get(_s, ()), _full)
# Further common given names in full, which are no short form of another.
GIVEN = frozenset("""
adam adrian alice amelie anders andrea andreas angela anja anne antoine astrid axel benedikt benjamin birgit bjorn boris bruno camille carla carlos carmen charlotte chiara clara claudia daniel david diana diego dieter elena elias emil emilia emma eric erik eva felix florian gabriel georg giulia gustav
hanna hannah hassan heinrich helmut hiroshi hugo ibrahim ida ingrid irene isabella jan jana jean jens jonas jorge jorn juan julia julian jurgen karin karl kenji klara laura lena louis louise luc lucas lucia luis lukas marc marco marie mark marta martin martina matthew max mei mia miguel mohamed monika nadia nina nora
omar otto pablo paul paula pauline peter philip pierre qing rachel rafael ralf ramon ramona roland roman ruth sabine samuel sara simon stefan stefanie steven susanne sven teresa theresa tobias tomasz valentin vera veronica victor walter wei werner wilhelm wolfgang yuki zoe
""".split())
FULL = GIVEN | frozenset(NICKNAMES)
KNOWN = FULL | frozenset(FULL_OF)
# Endings that make a short form of a name's beginning, and those that make another name of it.
PET_ENDINGS = ("ie", "ey", "y", "i", "e", "o", "a", "ek", "ik", "ka", "ko", "chen")
OTHER_ENDINGS = frozenset("a e o i s us ie ia ina ine ette ella etta elle".split())
TITLES = frozenset("dr prof professor mr mrs ms miss sir phd md jr sr ii iii iv dipl ing doc dres herr frau mme".split())
PARTICLES = frozenset("van von der den de la del di da le ter ten zu zur al bin ibn dos das do".split())
LETTERS = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "ı": "i", "đ": "d", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d"})


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.casefold().translate(LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c))


def deletions(word: str) -> set[str]:
    """The word and all forms with one letter less: words one edit or swap apart share one."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def near(a: str, b: str) -> bool:
    """Whether two words are one edit or swap of neighbours apart, or equal."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :]


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for a common prefix of up to four letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    t = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return jaro + p * 0.1 * (1 - jaro)


SOUND = {c: d for d, cs in {"1": "bfpvw", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}


def phonetic(word: str) -> str:
    """First letter and the classes of the consonants that follow, repeats once, vowels dropped."""
    out, last = word[:1], SOUND.get(word[:1], "")
    for c in word[1:]:
        d = SOUND.get(c, "")
        if d and d != last:
            out += d
        if c not in "hw":
            last = d
    return out


@lru_cache(maxsize=1)
def _vocabulary() -> dict[str, set[str]]:
    index: dict[str, set[str]] = {}
    for w in [*CANON, *PHRASES]:
        if len(w) >= 4:
            for d in deletions(w):
                index.setdefault(d, set()).add(w)
    return index


def _words(org: str) -> list[str]:
    """Folded words of an organisation's name in order, without a department before it and without stop words."""
    parts = org.split(",")
    if len(parts) > 1 and DEPARTMENT.match(fold(parts[0])):
        org = ",".join(parts[1:])
    text = re.sub(r"['’`]", "", fold(org))
    text = re.sub(r"\b(?:\w\.){2,}", lambda m: m[0].replace(".", ""), text)
    return [w for w in re.findall(r"\w+", text) if w not in STOP]


def _compound(w: str) -> list[str]:
    """The two known words that a long one is put together from, or nothing."""
    for i in range(4, len(w) - 3):
        first, second = w[:i], w[i:]
        if second in CANON and (first in CANON or first[:-1] in CANON and first[-1] == "s"):
            return [CANON.get(first) or CANON[first[:-1]], CANON[second]]
    return []


def _canonical(w: str) -> list[str]:
    if w in PHRASES:
        return PHRASES[w].split()
    if w in CANON:
        return [CANON[w]]
    if len(w) >= 9 and (both := _compound(w)):
        return both
    if len(w) >= 5:
        close = sorted({v for d in deletions(w) for v in _vocabulary().get(d, ()) if near(w, v)})
        if close:
            return PHRASES[close[0]].split() if close[0] in PHRASES else [CANON[close[0]]]
    return [w]


def org_tokens(org: str) -> list[str]:
    """Sorted canonical words of an organisation's name. A department before it is left out; an
    unknown word one edit from a known one of five letters or more counts as that."""
    return sorted(x for w in _words(org) for x in _canonical(w))


def initial_runs(org: str) -> set[tuple[str, str]]:
    """(initials, other words) of each run of two to six words: what an acronym in place of the run would leave."""
    words = _words(org)
    parts = [_canonical(w) for w in words]
    out = set()
    for i in range(len(words)):
        for j in range(i + 2, min(len(words), i + 6) + 1):
            rest = " ".join(sorted(x for p in parts[:i] + parts[j:] for x in p))
            out |= {("".join(w[0] for w in words[i:j]), rest), ("".join(x[0] for p in parts[i:j] for x in p), rest)}
    return out


def acronyms(org: str) -> set[tuple[str, str]]:
    """(word, other words) of each word of two to six letters that is no known one: it may be an acronym."""
    words = _words(org)
    parts = [_canonical(w) for w in words]
    return {(w, " ".join(sorted(x for p in parts[:i] + parts[i + 1 :] for x in p))) for i, w in enumerate(words) if 2 <= len(w) <= 6 and w.isalpha() and w not in CANON}


def abbreviates(short: str, word: str) -> bool:
    """Whether a word of two letters or more is cut from another: its beginning (three letters or more), or its first and last
    letter with some between, in order (four letters or more)."""
    if len(short) >= len(word) or len(short) < 3 or short[0] != word[0]:
        return False
    rest = iter(word)
    return word.startswith(short) or len(short) >= 4 and short[-1] == word[-1] and 2 * len(short) <= len(word) + 3 and all(c in rest for c in short)


#: Least Jaro-Winkler score of two words that are one slip apart (edit or swap), and of others.
SLIP, FAR = 0.85, 0.94


def same_word(a: str, b: str, slip: float = SLIP) -> bool:
    """Whether two spellings are of one word: equal, or a Jaro-Winkler score of at least ``slip`` where they are one slip apart,
    of FAR where not."""
    return a == b or jaro_winkler(a, b) >= (slip if near(a, b) else FAR)


def same_org(a: list[str], b: list[str]) -> bool:
    """Equal words, but for such as are cut short, and one of five letters or more that may be mistyped and that no
    list of known words explains (Jaro-Winkler, 0.88 where one slip apart)."""
    x, y = list(a), list(b)
    for w in a:
        if w in y:
            x.remove(w)
            y.remove(w)
    if len(x) != len(y):
        return False
    slips = 0
    for w in x:
        cut = next((v for v in y if abbreviates(w, v) or abbreviates(v, w)), None) if len(a) > 1 else None
        if cut is None:
            cut = next((v for v in y if min(len(w), len(v)) >= 5 and w not in WORDS and v not in WORDS and same_word(w, v, 0.88)), None)
            slips += 1
        if cut is None or slips > 1:
            return False
        y.remove(cut)
    return True


def person_parts(name: str) -> Person:
    """The parts of a person's name.

    Titles, digits and particles are left out. Initials keep their order. Before a comma
    stands the surname; so does the last word of a name that begins with initials, and the first
    of one that ends with them.
    """
    text = re.sub(r"\d+", " ", name)
    before, comma, after = text.partition(",")
    if comma and fold(after).replace(".", "").strip() in TITLES:
        text, comma = before, ""
    words: list[tuple[str, bool]] = []
    upper = text.upper() == text
    double: dict[str, str] = {}
    for part, side in ((before, 0), (after, 1)) if comma else ((text, 0),):
        for raw in re.findall(r"[^\s,]+", part):
            for w in [p for p in re.split(r"[.]", raw) if p] if "." in raw else [raw]:
                w = w.strip("'’\"()[]-")
                bare = re.sub(r"['’\"()\[\]]", "", w)
                low = fold(bare)
                packed = len(bare) <= 3 and bare.isupper() and bare.isalpha() and not upper and not words and "." not in raw
                if not low or low in TITLES and not (packed and len(bare) == 2) or low in PARTICLES and not (len(bare) <= 2 and bare.isupper() and not upper):
                    continue
                if len(low) == 1 or len(bare) <= 3 and bare.isupper() and bare.isalpha() and (not upper or len(bare) <= 2):
                    words += [(c, True) for c in low]
                elif re.fullmatch(r"(?:\w-)+\w", low):
                    words += [(c, True) for c in low.split("-")]
                else:
                    words.append((low.replace("-", "") if low.count("-") else low, False))
                    if "-" in low:
                        double[low.replace("-", "")] = "".join(p[0] for p in low.split("-") if p)
    full = [w for w, i in words if not i]
    initials = [w for w, i in words if i]
    surname = None
    if comma and full:
        first = [w for w in re.findall(r"[^\s]+", fold(before)) if w not in PARTICLES]
        surname = first[-1].replace("-", "").strip(".'") if first else None
        surname = re.sub(r"['’]", "", surname) if surname else None
        surname = surname if surname in full else full[0]
    elif len(full) == 1:
        surname = full[0]
    elif initials and words[0][1]:
        surname = full[-1]
    elif initials and words[-1][1]:
        surname = full[0]
    elif initials and len(full) >= 2:
        surname = full[-1]
    return Person(tuple(full), "".join(initials), surname, double)


class Person(NamedTuple):
    """full: words of two letters or more; surname: if the order shows it; double: initials of hyphened words."""

    full: tuple[str, ...]
    initials: str
    surname: str | None
    double: dict[str, str]

    def readings(self) -> list[tuple[str, tuple[str, ...]]]:
        """(surname, given words) in every order the form allows; those with a known given name, if there are any."""
        if self.surname:
            rest = list(self.full)
            rest.remove(self.surname)
            return [(self.surname, tuple(rest))]
        ends = sorted({0, len(self.full) - 1}) if self.full else []
        orders = [(self.full[i], self.full[:i] + self.full[i + 1 :]) for i in ends]
        every = [(s, g) for s, g in orders if g and all(x in KNOWN for x in g) or "".join(g) in KNOWN]
        return every or [(s, g) for s, g in orders if any(x in KNOWN for x in g)] or orders

    def sequences(self, given: tuple[str, ...]) -> set[str]:
        """The initials in order: those of the given words (or of the first alone), then the middle ones."""
        every = "".join(self.double.get(g, g[:1]) for g in given)
        return {every + self.initials, every[:1] + self.initials}


def given_forms(word: str) -> set[str]:
    """A given name and the full names it may be short for."""
    return {word, *FULL_OF.get(word, ())}


def shortens(short: str, full: str) -> bool:
    """Whether a given name is short for another by rule: its beginning, or that with a pet ending (Dan, Danny: Daniel).

    Names that are full ones themselves are not (Daniel: Daniela), and an ending that makes another name neither.
    """
    if short in FULL or len(short) < 3 or short[0] != full[0]:
        return False
    if full.startswith(short):
        return full[len(short) :] not in OTHER_ENDINGS
    for end in PET_ENDINGS:
        if short.endswith(end):
            stem = short[: -len(end)]
            single = stem[:-1] if len(stem) > 2 and stem[-1] == stem[-2] else stem
            if len(single) >= 3 - (single != stem) and full.startswith(single) and len(full) >= len(single) + 2:
                return True
    return False


def same_given(a: str, b: str, common: frozenset[str] = frozenset()) -> int:
    """2 equal or one short for the other, 1 a typing error apart where not both are known or ``common`` names, 0 neither."""
    if a == b or given_forms(a) & given_forms(b) or shortens(a, b) or shortens(b, a):
        return 2
    if (a in KNOWN or a in common) and (b in KNOWN or b in common):
        return 0
    return int(min(len(a), len(b)) >= 3 and same_word(a, b, 0.8))


def same_surname(a: str, b: str, common: frozenset[str] = frozenset()) -> bool:
    """Equal, or a typing error apart where not both are known given names or ``common`` words."""
    return a == b or min(len(a), len(b)) >= 4 and not ((a in KNOWN or a in common) and (b in KNOWN or b in common)) and same_word(a, b)


def _same_givens(a: tuple[str, ...], b: tuple[str, ...], more_a: str, more_b: str, common: frozenset[str]) -> bool:
    """Given names of two full names: alike when joined; or the first alike, and what follows, words or initials, no
    contradiction: each that both have agrees, and one side may have more."""
    x, y = "".join(a), "".join(b)
    if same_given(x, y, common) and (len(a) == len(b) == 1 or near(x, y)):
        return more_a.startswith(more_b) or more_b.startswith(more_a)
    if not a or not b or len(a) == len(b) == 1 or not same_given(a[0], b[0], common):
        return False
    for x, y in zip((*a[1:], *more_a), (*b[1:], *more_b)):
        if not (x[0] == y[0] if min(len(x), len(y)) == 1 else same_given(x, y, common)):
            return False
    return True


def same_person(a: Person, b: Person, common: frozenset[str] = frozenset()) -> bool:
    """Two full names of one person: in some reading the surnames and the given names agree, each but for one
    typing error, and no further given names or middle initials contradict."""
    return any(same_surname(s, t, common) and _same_givens(g, h, a.initials, b.initials, common) for s, g in a.readings() for t, h in b.readings())


def initials_fit(short: str, long: str) -> int:
    """How initials fit a full name's: 2 in order from the first, 1 the first alone where no more are known, 0 not."""
    if not short or not long or short[0] != long[0]:
        return 0
    rest = iter(long[1:])
    if all(c in rest for c in short[1:]):
        return 2
    return 1 if len(long) == 1 else 0
