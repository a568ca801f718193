"""Reading postal addresses typed by hand: premises number, named building, street, estate, locality.

`Places` resolves the locality against the reference list of places, whatever the spelling, from the
locality's present or old name, its phase, pin code, taluk and district. `read` returns the parts of
one address. Both run inside Arrow batches; the reference list is small (`MAX_PLACES` at most).
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

MAX_PLACES = 50_000

# The forms in which addresses are typed in the registers.
STREETS = ("canal", "granary", "kiln", "market", "mill", "old depot", "quarry", "ring", "station", "tank bund", "temple", "weavers")
ESTATES = {"export park": "export", "craft sheds": "craft", "small units": "small", "sidb": "sidb"}
BUILDINGS = {
    "towers": "tower", "twrs": "tower", "tower": "tower", "mansion": "mansion", "mansn": "mansion", "plaza": "plaza", "plza": "plaza",
    "godowns": "godowns", "gdwns": "godowns", "arcade": "arcade", "arc": "arcade", "nivas": "nivas", "nivasa": "nivas",
    "compound": "compound", "cmpd": "compound", "cmp": "compound", "complex": "complex", "cmplx": "complex",
    "chambers": "chambers", "chmbrs": "chambers", "gardens": "gardens", "gdns": "gardens",
}
PLACE_WORDS = frozenset(
    "industrial indl ind area ia ie estate est layout lyt lo nagar nagara ngr extension extn ext phase ph stage taluk tq district dist dt pin no".split()
)
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12, "xiii": 13, "xiv": 14, "xv": 15}

_R = r"(?:x{0,1}(?:ix|iv|v?i{1,3}|v)|x)"
_ORD = r"(?:st|nd|rd|th)?"
_NUM = r"(?:0*(\d{1,4})(?:\s*[/-]\s*([a-z]\b|\d{1,2}\b)|\s?([a-c])\b)?|([a-c])\s?[-/]\s?0*(\d{1,4}))(?!\d)"
_NO = r"(?:nos?\b\.?|#|number)?\s*"
_PIN = re.compile(r"(?:\bpin\b|[-–])?\s*\b([1-9]\d{2})\s?(\d{3})\b(?=\W*$|\s*(?:,|;|$))")
_NOISE = [
    re.compile(r"\b(?:near|nr|opp|behind|next to|beside)\b\.?\s*(?:water tank|pump house|bus stand|godown|weighbridge)?"),
    re.compile(rf"\b(?:(?:ground|first|second|third|fourth|\d+\s*{_ORD}|{_R})\s+(?:floor|flr|fl)\b\.?|basement\b|rear portion\b)"),
    re.compile(r"\b(?:godown|block|gate|room|unit|shop)\s*(?:no\b\.?)?\s*[#-]?\s*\d{1,3}\b"),
]
_CROSS = re.compile(rf"\b(?:0*(\d+)\s*{_ORD}|({_R}))\s+(?:cross|crs|cr)\b\.?")
_MAIN = re.compile(rf"\b(?:0*(\d+)\s*{_ORD}|({_R}))\s+(?:main|mn)\b\.?(?:\s+(?:road|rd)\b\.?)?")
_ROAD = re.compile(r"([a-z]+(?: [a-z]+)??)\s+(?:main\s+road|main\s+rd|m\s?\.\s?rd|mn\s+rd|road|rd|street|str|st(?!\s*(?:no|#)))\b\.?")
_BOTH = [
    (re.compile(rf"\bold\s*{_NO}{_NUM}\s*/\s*new\s*{_NO}{_NUM}"), True),
    (re.compile(rf"\bnew\s*{_NO}{_NUM}\s*,?\s*old\s*{_NO}{_NUM}"), False),
    (re.compile(rf"(?:\b(?:plot|p|site|st|shed|sh|door|d|survey|sy|s|no)\b\.?\s*)?{_NO}{_NUM}\s*[\[(]\s*old\s*{_NO}{_NUM}\s*[\])]"), False),
]
_OLD = re.compile(rf"\bold\s*(?:nos?\b\.?|#)\s*{_NUM}")
_NUMBER = re.compile(rf"\b(?:plot|p|site|st|shed|sh|door|d|survey|sy|s|new|h|house)\s*[.\s]?\s*(?:nos?\b\.?|#|-)?\s*[.#:-]?\s*{_NUM}|(?:\bnos?\b\.?|#)\s*{_NUM}")
_BARE = re.compile(rf"(?:^|[;,])\s*{_NUM}\s*(?=[;,]|$)|^\s*{_NUM}\s")
_PHASE = [
    re.compile(r"\b(?:phase|ph|stage)\s*[.-]?\s*(\d|i{1,3}|iv)\b"),
    re.compile(r"\b(\d)\s*(?:st|nd|rd|th)\s+(?:phase|ph|stage)\b"),
    re.compile(r"\b(i{1,3}|iv)\s+(?:phase|ph|stage)\b"),
]
#: Texts without which the patterns of `_NOISE` do not match.
_NOISE_MARKS = (("near", "nr", "opp", "behind", "next to", "beside"), ("fl", "basement", "rear portion"), ("godown", "block", "gate", "room", "unit", "shop"))
_ESTATES = {words: re.compile(rf"\b{words}\b(?:\s+(?:compound|cmpd|cmp|estate|est)\b\.?)?") for words in ESTATES}
_NO_LETTER = re.compile(r"[^a-z]")
_SEGMENT = re.compile(r"[;,]|\s-\s")
_ABBR = [(re.compile(r"\bi\.\s?a\.?(?=\W|$)"), " ia "), (re.compile(r"\bi\.\s?e\.?(?=\W|$)"), " ie "), (re.compile(r"\bl/o\b"), " lo ")]


def edit(a: str, b: str, most: int = 99) -> int:
    """Levenshtein distance; any value above `most` once it is exceeded. A column of the table is two integers:
    where it rises and where it falls (Myers)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    if not a:
        return len(b)
    at: dict[str, int] = {}
    bit = 1
    for x in a:
        at[x] = at.get(x, 0) | bit
        bit <<= 1
    every, last, d = bit - 1, bit >> 1, len(a)
    up, down = every, 0
    for y in b:
        eq = at.get(y, 0)
        same = (((eq & up) + up) ^ up) | eq
        rise = down | ~(same | up)
        fall = up & same
        if rise & last:
            d += 1
        elif fall & last:
            d -= 1
        rise = rise << 1 | 1
        eq |= down
        up = (fall << 1 | ~(eq | rise)) & every
        down = rise & eq & every
    return d


#: Letters and groups that typists exchange.
_VOWELS = (("oo", "u"), ("ee", "i"))
_SOUNDS = (("ph", "f"), ("th", "t"), ("dh", "d"), ("w", "v"), ("y", "i"), ("c", "k"), ("q", "k"), ("z", "s"))


#: Words of each worker already folded.
_FOLDED: dict[tuple[str, bool], str] = {}


def fold(word: str, vowels: bool = True) -> str:
    """The word as it sounds: exchanged letters made equal, repeated letters once; `vowels`: oo and ee
    count as u and i."""
    hit = _FOLDED.get((word, vowels))
    if hit is None:
        if len(_FOLDED) >= 200_000:
            _FOLDED.clear()
        hit = word
        for group, to in (*_VOWELS, *_SOUNDS) if vowels else _SOUNDS:
            hit = hit.replace(group, to)
        hit = _FOLDED[word, vowels] = "".join(c for i, c in enumerate(hit) if not i or c != hit[i - 1])
    return hit


def slips(a: str, b: str, most: int = 99) -> int:
    """Edit distance in which two exchanged neighbours are one slip; above `most` any greater value. As `edit`, with
    the letters and differences of the column before for exchanges (Hyyrö)."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a:
        return len(b)
    at: dict[str, int] = {}
    bit = 1
    for x in a:
        at[x] = at.get(x, 0) | bit
        bit <<= 1
    every, last, d = bit - 1, bit >> 1, len(a)
    up, down, same, before = every, 0, 0, 0
    for y in b:
        eq = at.get(y, 0)
        same = ((((eq & up) + up) ^ up) | eq | down | ((~same & eq) << 1 & before)) & every
        rise = down | ~(same | up)
        fall = up & same
        if rise & last:
            d += 1
        elif fall & last:
            d -= 1
        rise = rise << 1 | 1
        up = (fall << 1 | ~(same | rise)) & every
        down = rise & same & every
        before = eq
    return d


def grams(word: str, n: int = 2) -> frozenset[str]:
    w = f"^{word}$"
    return frozenset(w[i : i + n] for i in range(len(w) - n + 1))


@dataclass
class Address:
    """Parts of an address; what is not named is ''. place is '' or the id of the reference place."""

    place: str = ""
    number: str = ""
    old: str = ""
    building: str = ""
    street: str = ""
    pin: str = ""
    phase_known: bool = False
    rest: list[str] = field(default_factory=list)


def _number(groups: tuple[str | None, ...]) -> str:
    """285/2, 219/c: digits without leading zeros, then the sub-number."""
    for i in range(0, len(groups), 5):
        n, sub, letter, before, after = groups[i : i + 5]
        if n:
            return f"{int(n)}/{int(sub) if sub and sub.isdigit() else sub or letter}" if sub or letter else str(int(n))
        if after:
            return f"{int(after)}/{before}"
    return ""


class Words:
    """Approximate look-up among a fixed list of words."""

    def __init__(self, words: list[str]):
        self.known = set(words)
        self.sorted = sorted(self.known)
        at: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(self.sorted):
            for g in grams(w):
                at[g].append(i)
        self.by_gram = {g: np.array(v) for g, v in at.items()}
        self.lengths = np.array([len(w) for w in self.sorted], float)
        self._seen: dict[str, tuple[str, float]] = {}

    def best(self, word: str) -> tuple[str, float]:
        """The most similar known word and how similar it is (1 - edits / length)."""
        if word in self.known:
            return word, 1.0
        if len(word) < 5:
            return "", 0.0
        hit = self._seen.get(word)
        if hit is None:
            mine = grams(word)
            lists = [v for g in mine if (v := self.by_gram.get(g)) is not None]
            top: list[int] = []
            if lists:
                shared = np.bincount(np.concatenate(lists), minlength=len(self.sorted))
                dice = 2 * shared / (len(mine) + self.lengths + 1)
                sixth = np.partition(dice, -6)[-6] if len(dice) > 6 else 0.0
                # in the order of the words, which the sort keeps among equal ones
                some = np.flatnonzero((dice >= sixth) & (shared > 0))
                top = some[np.argsort(-dice[some], kind="stable")[:6]].tolist()
            hit = ("", 0.0)
            for w in (self.sorted[i] for i in top):
                longest = max(len(w), len(word))
                if 1.0 - abs(len(w) - len(word)) / longest <= hit[1]:
                    continue
                s = 1.0 - edit(word, w, longest // 2) / longest
                if s > hit[1]:
                    hit = (w, s)
            if len(self._seen) > 300_000:
                self._seen.clear()
            self._seen[word] = hit
        return hit


class Places:
    """The reference list: rows (id, locality, old_name, taluk, district, pin_code), and further names
    of its localities as pairs (name, id)."""

    def __init__(self, rows: list[tuple], aliases: list[tuple[str, str]] = ()):
        self.rows: dict[str, dict] = {}
        self.by_name: dict[str, list[str]] = defaultdict(list)
        self.by_pin: dict[str, list[str]] = defaultdict(list)
        areas = set()
        for pid, locality, old, taluk, district, pin in rows:
            base, phase = self._base(locality or "")
            area = [w for x in (taluk, district) for w in re.sub(r"[^a-z ]", " ", (x or "").lower()).split() if w not in PLACE_WORDS]
            pid = str(pid)
            self.rows[pid] = {"phase": phase, "areas": set(area), "pin": pin or "", "base": base}
            areas |= set(area)
            for name in (base, self._base(old or "")[0]):
                if name:
                    self.by_name[name].append(pid)
            if pin:
                self.by_pin[pin].append(pid)
        for name, pid in aliases:
            phases = [p for p, row in self.rows.items() if row["base"] == self.rows[pid]["base"]]
            self.by_name[name] += [p for p in phases if p not in self.by_name[name]]
        self.words = Words([*self.by_name, *areas])
        self.areas = areas
        self._found: dict[tuple, tuple[str, bool, list[str]]] = {}

    @staticmethod
    def _base(name: str) -> tuple[str, int]:
        text, phase = _phase(_tidy(name))
        return "".join(w for w in re.sub(r"[^a-z ]", " ", text).split() if w not in PLACE_WORDS), phase

    def find(self, text: str, pin: str, phase: int) -> tuple[str, bool, list[str]]:
        """(place id or '', whether the phase was settled, words that are no place)."""
        tokens = [w for w in _NO_LETTER.sub(" ", text).split() if w not in PLACE_WORDS]
        asked = (*tokens, pin, phase)
        hit = self._found.get(asked)
        if hit is None:
            if len(self._found) >= 100_000:
                self._found.clear()
            hit = self._found[asked] = self._find(tokens, pin, phase)
        return hit

    def _find(self, tokens: list[str], pin: str, phase: int) -> tuple[str, bool, list[str]]:
        names: dict[str, float] = {}
        areas: set[str] = set()
        used = [False] * len(tokens)
        spans = [(i, i + n) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)]
        scored = []
        for a, b in spans:
            w = "".join(tokens[a:b])
            if 5 <= len(w) <= 24:
                hit, s = self.words.best(w)
                if s >= 0.62:
                    scored.append((s - 0.01 * (b - a - 1), a, b, hit))
        for s, a, b, hit in sorted(scored, reverse=True):
            if any(used[a:b]):
                continue
            used[a:b] = [True] * (b - a)
            if hit in self.areas:
                areas.add(hit)
            if hit in self.by_name:
                names[hit] = max(names.get(hit, 0.0), s)
        rest = [t for t, u in zip(tokens, used) if not u]
        options: dict[str, float] = defaultdict(float)
        for name, s in names.items():
            for pid in self.by_name[name]:
                options[pid] = max(options[pid], 2.5 * s)
        swapped = {pin[:i] + pin[i + 1] + pin[i] + pin[i + 2 :] for i in range(len(pin) - 1)} if pin and pin not in self.by_pin else set()
        for p, worth in [(pin, 1.5), *((q, 0.9) for q in swapped)]:
            for pid in self.by_pin.get(p, ()):
                options[pid] += worth
        if not options:
            return "", False, rest
        for pid in options:
            row = self.rows[pid]
            options[pid] += 0.5 * len(row["areas"] & areas)
            if phase and row["phase"]:
                options[pid] += 0.8 if phase == row["phase"] else -0.8
        order = sorted(options.items(), key=lambda x: (-x[1], x[0]))
        best, score = order[0]
        if score < 1.45:
            return "", False, rest
        if len(order) > 1 and order[1][1] > score - 0.05:
            same = [p for p, s in order if s > score - 0.05]
            if {self.rows[p]["base"] for p in same} != {self.rows[best]["base"]}:
                return "", False, rest
            return best, False, rest  # the locality without its phase
        return best, True, rest


#: The worker's places of the last task, with what they have looked up; a plain list, as in `names`.
_OPENED: list[tuple] = []


def opened(rows: list[tuple], aliases: list[tuple[str, str]] = ()) -> Places:
    """`Places` of these rows and names; a worker that held the same ones before goes on with those."""
    if not _OPENED or _OPENED[0][:2] != (rows, aliases):
        _OPENED[:] = [(rows, aliases, Places(rows, aliases))]
    return _OPENED[0][2]


def _tidy(text: str) -> str:
    t = text.lower().replace("|", ";")
    for part, (pattern, to) in zip(("i.", "i.", "l/o"), _ABBR):
        if part in t:
            t = pattern.sub(to, t)
    return " ".join(t.split())


def _phase(text: str) -> tuple[str, int]:
    if "ph" not in text and "stage" not in text:
        return text, 0
    for pattern in _PHASE:
        m = pattern.search(text)
        if m:
            p = m.group(1)
            return text[: m.start()] + " " + text[m.end() :], ROMAN.get(p) or int(p)
    return text, 0


_STREET_WORDS = Words([s.replace(" ", "") for s in STREETS])


def read(address: str | None, places: Places, more: str | None = None, pin: str | None = None) -> Address:
    """The parts of an address; `more` holds locality fields typed apart, `pin` a pin code field."""
    out, named, phase = _apart(address, places, pin)
    out.place, out.phase_known, out.rest = _place(named, phase, places, more, out.pin)
    return out


def places_named(address: str | None, places: Places, more: str | None, pin: str | None) -> list[tuple[str, list[str]]]:
    """Place and further words (`place`, `rest` of `read`) by the address with `more`, by it alone and by `more` alone;
    only the first without `more`, or if it is no place."""
    out, named, phase = _apart(address, places, pin)
    whole = _place(named, phase, places, more, out.pin)
    found = [whole]
    if more and whole[0]:
        bare, none, no_phase = _apart(None, places, pin)
        found += [_place(named, phase, places, None, out.pin), _place(none, no_phase, places, more, bare.pin)]
    return [(place, rest) for place, _, rest in found]


def _place(named: str, phase: int, places: Places, more: str | None, pin: str) -> tuple[str, bool, list[str]]:
    more = _tidy(more or "")
    return places.find(f"{named} {more}", pin, phase or _phase(more)[1])


def _apart(address: str | None, places: Places, pin: str | None) -> tuple[Address, str, int]:
    """The parts but for the place; the words in which it may be named; the phase."""
    out = Address()
    t = _tidy(address or "")
    m = None
    for m in _PIN.finditer(t):
        pass
    if m:
        out.pin = m.group(1) + m.group(2)
        t = t[: m.start()] + " ; " + t[m.end() :]
    given = re.sub(r"\D", "", pin or "")
    out.pin = given if len(given) == 6 and (given in places.by_pin or not out.pin) else out.pin
    for noise, marks in zip(_NOISE, _NOISE_MARKS):
        if any(x in t for x in marks):
            t = noise.sub(" ; ", t)
    cross = main = 0
    m = _CROSS.search(t) if "cr" in t else None
    if m:
        cross = int(m.group(1)) if m.group(1) else ROMAN.get(m.group(2), 0)
        t = t[: m.start()] + " ; " + t[m.end() :]
    m = _MAIN.search(t) if "main" in t or "mn" in t else None
    if m:
        main = int(m.group(1)) if m.group(1) else ROMAN.get(m.group(2), 0)
        t = t[: m.start()] + " ; " + t[m.end() :]
    t, phase = _phase(t)
    for pattern, old_first in _BOTH if "old" in t else ():
        m = pattern.search(t)
        if m:
            g = m.groups()
            out.old, out.number = (_number(g[:5]), _number(g[5:])) if old_first else (_number(g[5:]), _number(g[:5]))
            t = t[: m.start()] + " ; " + t[m.end() :]
            break
    if not out.number and not out.old:
        m = _OLD.search(t) if "old" in t else None
        if m:
            out.old = _number(m.groups())
            t = t[: m.start()] + " ; " + t[m.end() :]
    if not out.number and not out.old:
        m = _NUMBER.search(t) or _BARE.search(t)
        if m:
            out.number = _number(m.groups())
            t = t[: m.start()] + " ; " + t[m.end() :]
    for m in _ROAD.finditer(t):
        parts = m.group(1).split()
        for name in ("".join(parts[-2:]), parts[-1]):
            hit, s = _STREET_WORDS.best(name)
            if s >= 0.7 or (len(name) < 5 and any(edit(name, w, 1) <= 1 for w in ("kiln", "mill", "ring"))):
                if s < 0.7:
                    hit = min(("kiln", "mill", "ring"), key=lambda w: edit(name, w, 2))
                out.street = hit
                at = m.start() + len(m.group(1)) - len(" ".join(parts[-2:] if name != parts[-1] else parts[-1:]))
                t = t[:at] + " ; " + t[m.end() :]
                break
        if out.street:
            break
    if not out.street and (cross or main):
        out.street = f"{cross}x{main}"
    estate = ""
    for words, code in ESTATES.items():
        m = _ESTATES[words].search(t) if words in t else None
        if m:
            estate = code
            t = t[: m.start()] + " ; " + t[m.end() :]
            break
    segments = [_NO_LETTER.sub(" ", s).split() for s in _SEGMENT.split(t)]
    kept: list[str] = []
    for seg in segments:
        if not estate and len(seg) >= 1:
            whole = " ".join(seg)
            code = _LIKE_ESTATES.get(whole)
            if code is None:
                if len(_LIKE_ESTATES) >= 100_000:
                    _LIKE_ESTATES.clear()
                code = _LIKE_ESTATES[whole] = _estate(seg)
            if code:
                estate = code
                continue
        at = next((i for i, w in enumerate(seg) if w in BUILDINGS and i > 0), None)
        if at is not None and not out.building:
            # a segment may also hold the locality when no separator was typed
            before = seg[:at]
            name = before[-1:] if len(before[-1]) >= 5 else before[-2:]
            out.building = "".join(name) + " " + BUILDINGS[seg[at]]
            kept += [*before[: len(before) - len(name)], ";", *seg[at + 1 :]]
            continue
        kept += [*seg, ";"]
    if estate and not out.street:
        out.street = estate
    return out, " ".join(kept), phase


#: Segments of each worker already looked up.
_LIKE_ESTATES: dict[str, str] = {}


def _estate(seg: list[str]) -> str:
    joined = "".join(w for w in seg if w not in ("estate", "est", "compound", "cmpd", "cmp"))
    if not joined or len(joined) > 13:
        return ""
    for words, code in ESTATES.items():
        w = words.replace(" ", "")
        if edit(joined, w, 2) <= (2 if len(w) > 6 else 1):
            return code
    if len(seg) >= 2 and seg[-1] in ("est", "estate") and joined in ("sdib", "sidb", "sibd", "isdb"):
        return "sidb"
    return ""
