"""Reading names of businesses and persons typed by hand: distinctive words, trade, titles, legal form."""

from __future__ import annotations

import re
from dataclasses import dataclass

from kinfold.llm.addresses import fold, slips

# Words that occur around the distinctive part of a registered name.
TRADES = (
    "agencies castings ceramics chemicals coatings components electricals engineering enterprises fabricators foods forgings garments "
    "industries manufacturing mills packaging pharmaceuticals polymers printers products services technologies textiles timbers tools traders works"
).split()
SHORT_TRADES = {"ent": "enterprises", "ents": "enterprises", "tex": "textiles", "eng": "engineering", "engg": "engineering", "ind": "industries", "elec": "electricals",
                "pkg": "packaging", "mfg": "manufacturing", "wks": "works", "work": "works", "mill": "mills", "tool": "tools", "food": "foods", "tech": "technologies",
                "agcy": "agencies", "polys": "polymers", "chem": "chemicals", "svcs": "services", "fabs": "fabricators", "comps": "components", "enterprizes": "enterprises",
                "trading": "traders", "gmts": "garments", "pharma": "pharmaceuticals", "inds": "industries", "agency": "agencies", "technology": "technologies", "industry": "industries"}
QUALITIES = {"general": "general", "genl": "general", "new": "new", "nu": "new", "national": "national", "natl": "national", "precision": "precision", "precn": "precision",
             "modern": "modern", "mod": "modern", "allied": "allied", "alld": "allied", "royal": "royal", "ryl": "royal"}
TITLES = frozenset("ms messrs mr mrs smt sri shri shree dr".split())
LEGAL = frozenset("private limited ltd pvt llp co company sons and liability partnership".split())
_CUT = (*TRADES, "private", "pvt", "limited", "ltd", "llp", "sons", "company")
_TAIL = ("private", "limited", "liability", "partnership", "company", "sons")


@dataclass(frozen=True)
class Name:
    """core: distinctive words; trade: '' or a trade; firm: whether anything marks a business;
    initials: single letters that stand beside the distinctive words."""

    core: tuple[str, ...] = ()
    trade: str = ""
    firm: bool = False
    initials: tuple[str, ...] = ()
    quality: str = ""


def _subsequence(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def _near(a: str, b: str) -> bool:
    """At most two edits (one for words below seven letters)."""
    most = 2 if len(b) >= 7 else 1
    return a[0] == b[0] and slips(a, b, most) <= most


def plain_trade(word: str) -> str:
    """The trade a word spells out or abbreviates by its beginning; '' if none."""
    if word in SHORT_TRADES:
        return SHORT_TRADES[word]
    for t in TRADES:
        if word == t or (len(word) >= 4 and t.startswith(word)):
            return t
    return ""


#: Words of each worker already looked up; a plain dict, as cached functions do not travel with a job.
_LOOKED_UP: dict[str, str] = {}


def trade_of(word: str) -> str:
    """The trade a word stands for, typed out, shortened or mistyped; '' if none."""
    hit = _LOOKED_UP.get(word)
    if hit is None:
        if len(_LOOKED_UP) >= 200_000:
            _LOOKED_UP.clear()
        hit = _LOOKED_UP[word] = plain_trade(word) or _loose_trade(word)
    return hit


def _loose_trade(word: str) -> str:
    if len(word) < 4:
        return ""
    for t in TRADES:
        ends = word[-1] in (t[-1], t[-2]) or len(word) >= 5
        if word[0] == t[0] and len(word) < len(t) and ends and _subsequence(word, t):
            vowels = sum(c in "aeiou" for c in word)
            if vowels <= sum(c in "aeiou" for c in t) - 1 or len(word) >= len(t) - 2:
                return t
    for t in TRADES:
        if _near(word, t):
            return t
    return ""


def read(name: str | None) -> Name:
    """Parts of a name; an empty name has no core."""
    t = re.sub(r"\bl\.?\s?l\.?\s?p\b\.?", " llp ", (name or "").lower())
    t = re.sub(r"\bm\s?/\s?s\b\.?|^\s*m s(?= )", " ", t)
    tokens = re.sub(r"[^a-z0-9]+", " ", t.replace("&", " and ")).split()
    tokens = [w for w in tokens if w not in TITLES or len(tokens) == 1]
    firm = False
    quality = trade = ""
    core: list[str] = []
    initials: list[str] = []
    plain = len(tokens) > 1 and any(plain_trade(w) for w in tokens)
    for i, w in enumerate(tokens):
        if w in LEGAL:
            firm = True
        elif i and i >= len(tokens) - 2 and len(w) >= 2 and any(x.startswith(w) for x in _TAIL) and (firm or trade or len(w) >= 3):
            firm = True
        elif core and i == len(tokens) - 1 and 2 <= len(w) <= 3 and w not in SHORT_TRADES and any(x.startswith(w) for x in _CUT):
            firm = True  # cut off at the end of the field
        elif w in QUALITIES and len(tokens) > 1 and (not core or i == len(tokens) - 1):
            quality, firm = QUALITIES[w], True
        elif len(w) == 1:
            initials.append(w)
        else:
            # where one word spells a trade out, no other is taken for a mistyped one
            found = "" if len(tokens) < 2 else plain_trade(w) if plain else trade_of(w)
            if found and not trade:
                trade, firm = found, True
            elif found and trade:
                core.append(w)
            else:
                core.append(w)
    if not core and trade and not initials:
        core, trade = [tokens[0]], ""
    if firm:
        initials = [x for x in initials if x != "p" or not core] if core else initials
    return Name(tuple(core), trade, firm, tuple(initials), quality)


def keys(n: Name) -> list[tuple[str, str]]:
    """Points (kind, text) of the name among others: 'f' firms and 'p' persons by their distinctive
    words, in typed and in sorted order; 'i' firms by one word and an initial, or initials alone."""
    out = set()
    if n.core:
        kind = "f" if n.firm else "p"
        out.add((kind, "".join(n.core)))
        if len(n.core) > 1:
            out.add((kind, "".join(sorted(n.core))))
    if n.firm:
        for x in n.core:
            for y in n.initials:
                out.add(("i", f"{x}{y}"))
        if len(n.core) == 2:
            a, b = n.core
            out |= {("i", a + b[0]), ("i", b + a[0])}
            out.add(("i", "".join(sorted((a[0], b[0])))))
        elif not n.core and len(n.initials) > 1:
            out.add(("i", "".join(sorted(n.initials))))
    return sorted(out)


#: Pairs of words of each worker already compared.
_COMPARED: dict[tuple[str, str], float] = {}


def closeness(a: str, b: str) -> float:
    """1 for words that sound alike down to 0 where half the letters of the shorter one differ."""
    if a == b:
        return 1.0
    best = _COMPARED.get((a, b))
    if best is None:
        if len(_COMPARED) >= 200_000:
            _COMPARED.clear()
        best = 0.0
        for vowels in (True, False):  # oo may be typed for u or be an o typed twice
            x, y = fold(a, vowels), fold(b, vowels)
            half = 0.5 * max(1, min(len(x), len(y)))
            best = max(best, 1.0 - min(1.0, slips(x, y, int(half)) / half))
            if best == 1.0:
                break
        _COMPARED[a, b] = best
    return best


def _joined(core: list[str]) -> list[str]:
    """Single words and neighbours typed apart."""
    return [*core, *("".join(core[i : i + 2]) for i in range(len(core) - 1))]


def firms_alike(a: dict, b: dict) -> float:
    """Likeness of the distinctive parts of two firms' names (core, initials)."""
    ca, cb = a["core"] or [], b["core"] or []
    ia, ib = a["initials"] or [], b["initials"] or []
    best = 0.0
    if ca and cb:
        best = closeness("".join(ca), "".join(cb))
        if best < 1.0 and (len(ca) > 1 or len(cb) > 1):
            best = max(best, closeness("".join(sorted(ca)), "".join(sorted(cb))))
            if len(ca) == len(cb) == 2:
                best = max(best, closeness("".join(ca[::-1]), "".join(cb)))
    # a word cut to its first letter
    for core, initials, other, others in ((ca, ia, cb, ib), (cb, ib, ca, ia)):
        if len(core) == 1 and initials and (len(other) == 2 or len(other) == 1 and others):
            for i, w in enumerate(other):
                rest = [x[0] for j, x in enumerate(other) if j != i] or others
                if fold(rest[0])[:1] in {fold(x)[:1] for x in initials}:
                    best = max(best, 0.9 * closeness(core[0], w))
        if not core and len(initials) > 1 and sorted(initials) == sorted([*(w[0] for w in other), *others]):
            best = max(best, 0.5)
    return best


def person_in_firm(a: dict, b: dict) -> float:
    """How well a word of one name, typed as one or two words, meets a word of the other."""
    return max((closeness(x, y) for x in _joined(a["core"] or []) for y in _joined(b["core"] or []) if len(x) >= 4 and len(y) >= 4), default=0.0)
