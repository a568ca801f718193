"""Canonicalization of names, addresses and identifiers as column expressions.

Everything here stays inside generated code. Functions take a string Column; NULL and '' give NULL
unless said otherwise. Letters beyond ASCII are folded with a fixed table of Latin letters and then
dropped; names in Kannada script go through `transliterate_kannada` first, on the rows that have any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import dictionaries as D

_ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿŠšŽžĀāĒēĪīŌōŪūŚśṢṣṬṭḌḍṆṇḶḷṚṛ"
_PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyySsZzAaEeIiOoUuSsSsTtDdNnLlRr"

PIN = r"\b[1-9][0-9]{5}\b"
DOOR = r"(?i)(?:no[.\s]?|#|plot\s*no[.\s]?|door\s*no[.\s]?|flat\s*no[.\s]?|site\s*no[.\s]?)?\b[0-9]{1,5}(?:[/-][0-9A-Za-z]{1,5})*\b"
STEP = r"(?i)(\d+th|1st|2nd|3rd|\d+|first|second|third|fourth|fifth|i{1,3}|iv|vi{0,3})\s*(?:cross|main|stage|phase|block)\b"


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def ascii_fold(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"[^\x00-\x7F]", "")


def _first(pattern: str, c: Column) -> Column:
    hit = F.regexp_extract(c, pattern, 0)
    return F.when(hit != "", hit)


def _lookup(entries: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])[key]


def name_tokens(c: Column) -> Column:
    """Lower-case ASCII words with known abbreviations written out."""
    plain = F.trim(F.regexp_replace(F.lower(ascii_fold(F.trim(c))), r"[^a-z0-9\s]", " "))
    words = F.split(F.regexp_replace(plain, r"\s+", " "), " ")
    full = F.create_map(*[F.lit(x) for kv in D.ABBREVIATIONS.items() for x in kv])
    return F.when(plain != "", F.transform(words, lambda w: F.coalesce(full[w], w)))


def name_normalized(c: Column) -> Column:
    return F.array_join(name_tokens(c), " ")


def strip_legal_suffix(normalized: Column) -> Column:
    """Takes one legal suffix off the end, the longest that fits."""
    usable = sorted((s for s in D.LEGAL_SUFFIXES if s.replace(" ", "").isalnum()), key=len, reverse=True)
    return F.trim(F.regexp_replace(normalized, f" (?:{'|'.join(usable)})$", ""))


def name_prefix4(stripped: Column) -> Column:
    return F.rpad(F.substring(F.regexp_replace(stripped, r"\s+", ""), 1, 4), 4, "_")


def pin_code(address: Column) -> Column:
    return _first(PIN, address)


def _without_pins(address: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(address), PIN, ""), r"^[ ,;]+|[ ,;]+$", "")


def door_number(address: Column) -> Column:
    return F.trim(_first(DOOR, _without_pins(address)))


def locality_raw(address: Column) -> Column:
    """What follows the door number, or the whole address without pin codes if it has none."""
    rest = _without_pins(address)
    after = F.when(F.regexp_extract(rest, DOOR, 0) != "", F.regexp_replace(rest, r"(?s)^.*?" + DOOR.replace("(?i)", "(?i:") + ")", "")).otherwise(rest)
    text = F.regexp_replace(after, r"^[ ,;]+|[ ,;]+$", "")
    return F.when(text != "", text)


def street_raw(address: Column) -> Column:
    return F.substring(address, 1, 64)


def step_numbers(address: Column) -> Column:
    """Numbers of crosses, mains, stages, phases and blocks, in order."""
    ordinals = {"1st": 1, "2nd": 2, "3rd": 3, "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8}
    table = F.create_map(*[F.lit(x) for k, v in ordinals.items() for x in (k, v)])
    found = F.regexp_extract_all(address, F.lit(STEP), 1)
    number = F.transform(found, lambda w: F.coalesce(table[F.lower(w)], F.regexp_replace(F.lower(w), "th$", "").try_cast("int")))
    return F.filter(number, lambda n: n.isNotNull())


def first_contained(c: Column, entries: tuple[tuple[str, str], ...]) -> Column:
    """The value of the first keyword, in list order, that the lower-case text contains."""
    lower = F.lower(c)
    return F.coalesce(*[F.when(F.contains(lower, F.lit(word)), F.lit(value)) for word, value in entries])


def district(address: Column) -> Column:
    return first_contained(address, D.DISTRICTS)


def taluk(address: Column) -> Column:
    return first_contained(address, D.TALUKS)


def synonyms(extra: tuple[tuple[str, str], ...] = ()) -> list[tuple[str, str]]:
    """(variant, canonical) in order: each canonical name, then its variants; later keys override."""
    out: dict[str, str] = {}
    for canonical, variants in D.LOCALITY_SYNONYMS:
        for v in (canonical, *variants):
            out[v] = canonical
    out.update({v.strip().lower(): c for v, c in extra})
    return list(out.items())


def locality_canonical(locality: Column, extra: tuple[tuple[str, str], ...] = ()) -> Column:
    """The locality by exact synonym, else by the first synonym of which either begins with the
    other; NULL if neither. The approximate step is `similarity.resolve_localities`."""
    text = F.regexp_replace(F.lower(F.trim(locality)), r"[^a-z0-9\s]", " ")
    entries = synonyms(extra)
    exact = F.create_map(*[F.lit(x) for kv in entries for x in kv])[text]
    listed = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(c).alias("canonical")) for v, c in entries])
    begins = F.get(F.filter(listed, lambda e: F.startswith(text, e["variant"]) | F.startswith(e["variant"], text)), 0)["canonical"]
    return F.when(locality != "", F.coalesce(exact, begins))


def clean_pan(c: Column) -> Column:
    text = F.regexp_replace(F.upper(F.trim(c)), "[ -]", "")
    return F.when(text.rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]$"), text)


def pan_entity_type(pan: Column) -> Column:
    return _lookup(D.PAN_HOLDERS, F.substring(pan, 4, 1))


def pan_is_proprietorship(pan: Column) -> Column:
    return F.coalesce(F.substring(pan, 4, 1) == "P", F.lit(False))


def clean_gstin(c: Column) -> Column:
    text = F.replace(F.upper(F.trim(c)), F.lit(" "))
    return F.when(text.rlike(r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"), text)


def pan_of_gstin(gstin: Column) -> Column:
    return clean_pan(F.substring(gstin, 3, 10))


def clean_cin(c: Column) -> Column:
    text = F.replace(F.upper(F.trim(c)), F.lit(" "))
    return F.when(text.rlike(r"^[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$"), text)


def clean_phone(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    local = F.when(digits.rlike("^91[0-9]{10}$"), F.substring(digits, 3, 10)).otherwise(digits)
    return F.when(local.rlike("^[6-9][0-9]{9}$"), local)


def clean_email(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.rlike(r"^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"), text)


def email_domain(email: Column) -> Column:
    return F.split(email, "@", 2)[1]


def clean_connection_id(c: Column) -> Column:
    text = F.regexp_replace(F.upper(F.trim(c)), r"[()\[\]]", "")
    return F.when(text != "", text)


def looks_like_individual(name: Column, words: tuple[str, ...] = D.BUSINESS_WORDS) -> Column:
    """At most two words, none of them a business word, no digit; an empty name is not."""
    tokens = F.split(F.trim(F.lower(name)), r"\s+")
    business = F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    return F.coalesce((F.trim(name) != "") & (F.size(tokens) <= 2) & ~business & ~name.rlike("[0-9]"), F.lit(False))


def parse_date(c: Column) -> Column:
    text = F.trim(c)
    return F.coalesce(*[F.try_to_date(text, p) for p in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd")])


def parse_int(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).try_cast("int"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def geocode(latitude: Column, longitude: Column, locality: Column, pin: Column, district_name: Column) -> Column:
    """struct(latitude, longitude): given ones, else the centroid of locality, pin code or district."""

    def table(entries: dict[str, tuple[float, float]], key: Column) -> Column:
        points = F.create_map(*[x for k, (a, b) in entries.items() for x in (F.lit(k), F.struct(F.lit(a).alias("latitude"), F.lit(b).alias("longitude")))])
        return points[key]

    given = F.when(latitude.isNotNull() & longitude.isNotNull(), F.struct(latitude.alias("latitude"), longitude.alias("longitude")))
    return F.coalesce(given, table(D.LOCALITY_CENTROIDS, locality), table(D.PIN_CENTROIDS, pin), table(D.DISTRICT_CENTROIDS, F.lower(district_name)))


def sector_multiplier(sector: Column) -> Column:
    """How much a sector widens the dormant band: of the first sector with a keyword in the text, else 1."""
    entries = tuple((word, str(m)) for _, m, words in D.SECTORS for word in words)
    return F.coalesce(first_contained(sector, entries).cast("double"), F.lit(1.0))


def block_keys(stripped: Column, pin: Column, door: Column) -> tuple[Column, Column, Column]:
    """name_prefix4, pin|prefix4 and pin|door; '' where a part is missing."""
    prefix = name_prefix4(stripped)
    return (
        prefix,
        F.when(pin.isNotNull(), F.concat_ws("|", pin, prefix)).otherwise(""),
        F.when(pin.isNotNull() & door.isNotNull(), F.concat_ws("|", pin, door)).otherwise(""),
    )


# ITRANS letters of the Kannada block (consonants carry an inherent a).
_CONSONANTS = dict(zip("ಕಖಗಘಙಚಛಜಝಞಟಠಡಢಣತಥದಧನಪಫಬಭಮಯರಲವಶಷಸಹಳ", "k kh g gh ~N ch Ch j jh ~n T Th D Dh N t th d dh n p ph b bh m y r l v sh Sh s h L".split()))
_VOWELS = dict(zip("ಅಆಇಈಉಊಋಎಏಐಒಓಔ", "a A i I u U R^i e E ai o O au".split()))
_SIGNS = dict(zip("ಾಿೀುೂೃೆೇೈೊೋೌ", "A i I u U R^i e E ai o O au".split()))
_OTHER = {"ಂ": "M", "ಃ": "H", **{chr(0x0CE6 + i): str(i) for i in range(10)}}


def itrans(text: str) -> str:
    out, pending = [], False
    for c in text:
        if c in _CONSONANTS:
            out.append(("a" if pending else "") + _CONSONANTS[c])
            pending = True
            continue
        if c in _SIGNS:
            out.append(_SIGNS[c])
        elif c != "್":  # the virama takes the inherent vowel away
            out.append(("a" if pending else "") + _VOWELS.get(c, _OTHER.get(c, c)))
        pending = False
    return "".join(out) + ("a" if pending else "")


def transliterate_kannada(frame: DataFrame, column: str) -> DataFrame:
    """The column with Kannada script in Latin letters; rows without any never leave the JVM."""

    @F.pandas_udf("string")
    def convert(texts):
        return texts.map(itrans)

    has = F.coalesce(F.col(column).rlike(r"[ಀ-೿]"), F.lit(False))
    return frame.where(~has).unionByName(frame.where(has).withColumn(column, convert(F.col(column))))
