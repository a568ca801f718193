"""Which address records denote the same premises.

1. Read. Every address is taken apart (`addresses.read`); the locality is resolved against the
   reference list, completed by names of localities that the list lacks but the registers show beside
   a place (in a second locality field, or under a pin code that only one locality has).
2. Represent. Records that read alike are one form. A form is a vector of weighted character n-grams
   of its number, building and street, each gram taken within its locality. Weights are the
   inverse document frequencies over all forms.
3. Candidates. Grams are ordered rarest first. A prefix-filtered inverted index holds of each form the
   shortest prefix whose remainder has a norm below `COSINE`: two forms that reach that cosine share a
   prefix gram. A join on prefix grams gives the candidates; nothing is capped.
4. Verify. Cosine, and compatibility of house number, street and building. A number without a street
   links to a number with one only if the locality has no other premises of that number.
5. Premises are the components of the verified links; copies and forms are expanded at the end.

A premises or locality that holds a third of all rows collapses into its few forms before any join.

Defined results: re-delivered keys count once. A missing or empty address, one without a resolvable
locality, or one naming neither number nor building is in no pair. Old and new numbers are the same
premises where some record states both. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm import addresses
from kinfold.llm.addresses import MAX_PLACES
from kinfold.llm.consolidate import components
from kinfold.session import Scratch

COSINE = 0.35
#: A word is taken for a further name of a place if seen this often beside it, and this consistently.
ALIAS_SEEN, ALIAS_SHARE = 3, 0.7

SOURCES = {
    "ekarmika_records": ("establishment_registration_no", "address", None, None),
    "fbis_records": ("licence_number", "address", ("village_town", "taluk", "district"), "pin_code"),
    "kspcb_records": ("consent_file_no", "industrial_area", ("taluk", "district"), "pin_code"),
    "bescom_records": ("rr_number", "service_address", None, None),
    "bwssb_records": ("knca_number", "service_address", None, None),
}


def address_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """key, register, address, more, pin of every distinct key of the given registers."""
    out = None
    for name, frame in tables.items():
        key, address, more, pin = SOURCES[name]
        rows = frame.where(F.col(key).isNotNull()).select(
            F.col(key).alias("key"),
            F.struct(
                F.col(address).alias("address"),
                (F.concat_ws(" ; ", *more) if more else F.lit(None).cast("string")).alias("more"),
                (F.col(pin) if pin else F.lit(None).cast("string")).alias("pin"),
            ).alias("a"),
        )
        once = rows.groupBy("key").agg(F.max("a").alias("a")).select("key", F.lit(name).alias("register"), "a.*")
        out = once if out is None else out.unionByName(once)
    return out


def place_rows(localities: DataFrame) -> list[tuple]:
    """The reference list, which is brought to the driver; more than MAX_PLACES rows are refused."""
    rows = (
        localities.where("locality_id IS NOT NULL AND locality IS NOT NULL")
        .select("locality_id", "locality", "old_name", "taluk", "district", "pin_code")
        .orderBy("locality_id", "locality")
        .limit(MAX_PLACES + 1)
        .collect()
    )
    if len(rows) > MAX_PLACES:
        raise ValueError(f"more than {MAX_PLACES} reference places")
    return [tuple(r) for r in rows]


def learn_aliases(rows: DataFrame, places: list[tuple]) -> list[tuple[str, str]]:
    """Names of localities that the reference list lacks: (name, place id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = addresses.opened(places)
        for batch in batches:
            words, ids = [], []

            def note(rest: list[str], place: str) -> None:
                for w in ("".join(rest[i : i + n]) for n in (1, 2) for i in range(len(rest) - n + 1)):
                    if 6 <= len(w) <= 20 and known.words.best(w)[1] < 0.62:
                        words.append(w)
                        ids.append(place)

            for address, more, pin in zip(*(batch.column(i).to_pylist() for i in range(3))):
                (place, rest), *apart = addresses.places_named(address, known, more, pin)
                if apart:
                    a, b = apart
                    for (x, x_rest), (_, y_rest) in ((a, b), (b, a)):
                        if x and x_rest != y_rest:
                            note(y_rest, x)
                elif place:
                    note(rest, place)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ids, pa.string())], ["word", "place"])

    seen = rows.select("address", "more", "pin").mapInArrow(run, "word string, place string").groupBy("word", "place").agg(F.count(F.lit(1)).alias("n"))
    most = Window.partitionBy("word").orderBy(F.desc("n"), "place")
    best = (
        seen.withColumn("all", F.sum("n").over(Window.partitionBy("word")))
        .withColumn("k", F.row_number().over(most))
        .where((F.col("k") == 1) & (F.col("n") >= ALIAS_SEEN) & (F.col("n") >= ALIAS_SHARE * F.col("all")))
    )
    # names of places: as many as there are places, not rows
    found = [(r.word, r.place) for r in best.orderBy(F.desc("n"), "word").limit(MAX_PLACES + 1).collect()]
    if len(found) > MAX_PLACES:
        raise ValueError(f"more than {MAX_PLACES} further names of places")
    return [(w, p) for w, p in found if not any(w != other and w in other and p == at for other, at in found)]


def read_all(rows: DataFrame, places: list[tuple], aliases: list[tuple[str, str]]) -> DataFrame:
    """key, register and the parts of its address: place, number, old, building, street."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = addresses.opened(places, aliases)
        for batch in batches:
            key, register, address, more, pin = (batch.column(i) for i in range(5))
            read = [addresses.read(*x) for x in ((a, known, m, p) for a, m, p in zip(address.to_pylist(), more.to_pylist(), pin.to_pylist()))]
            yield pa.RecordBatch.from_arrays(
                [key, register, *(pa.array([getattr(a, f) for a in read], pa.string()) for f in ("place", "number", "old", "building", "street"))],
                ["key", "register", "place", "number", "old", "building", "street"],
            )

    parts = "key string, register string, place string, number string, old string, building string, street string"
    return rows.select("key", "register", "address", "more", "pin").mapInArrow(run, parts)


FORM = ("place", "number", "old", "building", "street")


def _grams(number: str, old: str, building: str, street: str) -> list[str]:
    """Field grams with '#' for numbers: the whole number weighs as a gram of its own."""
    out = set()
    for mark, text in (("#", number), ("~", old), ("s", street)):
        if text:
            out.add(f"{mark}={text}")
            w = f"^{text}$"
            out |= {mark + w[i : i + 3] for i in range(len(w) - 2)}
    if building:
        w = f"^{building.replace(' ', '$', 1)}"
        out |= {"b" + w[i : i + 3] for i in range(len(w) - 2)}
    return sorted(out)


#: Weights of the parts beside document frequency, such that a number alone and a building alone both
#: keep more than COSINE of an address that names the two.
_PART_WEIGHT = {"#": 1.5, "~": 1.5, "s": 0.5, "b": 1.0}
_WHOLE_WEIGHT = 2.0


def _index(forms: DataFrame, cosine: float) -> DataFrame:
    """form, grams, weights (unit length) and the prefix of grams that the index holds."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, place, *parts = (batch.column(i).to_pylist() for i in range(6))
            f, g = [], []
            for i, p in enumerate(place):
                mine = _grams(*(x[i] for x in parts))
                f += [form[i]] * len(mine)
                g += [f"{p}|{x}" for x in mine]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(g, pa.string())], ["form", "gram"])

    grams = forms.select("form", *FORM).mapInArrow(explode, "form string, gram string")
    frequency = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    lists = grams.join(frequency, "gram").groupBy("form").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    total = forms.count()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams_out, weights_out, prefix_out = [], [], []
            for row in batch.column(1).to_pylist():
                df = np.array([x["df"] for x in row], float)
                names = [x["gram"] for x in row]
                part = np.array([_PART_WEIGHT[n[n.index("|") + 1]] * (_WHOLE_WEIGHT if n[n.index("|") + 2 : n.index("|") + 3] == "=" else 1.0) for n in names])
                w = np.log1p(total / df) * part
                w /= np.sqrt((w * w).sum())
                remains = np.sqrt(np.maximum((w * w)[::-1].cumsum()[::-1], 0.0))  # norm of what begins here
                upto = int((remains >= cosine).sum())
                grams_out.append(names)
                weights_out.append(w.tolist())
                prefix_out.append([n for n, d in zip(names[:upto], df[:upto]) if d > 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(grams_out, pa.list_(pa.string())), pa.array(weights_out, pa.list_(pa.float64())), pa.array(prefix_out, pa.list_(pa.string()))],
                ["form", "grams", "weights", "prefix"],
            )

    return lists.select("form", "g").mapInArrow(weigh, "form string, grams array<string>, weights array<double>, prefix array<string>")


def _agree(a: str, b: str) -> bool | None:
    """Whether two streets agree; None if one is not named. Crosses and mains agree where both are."""
    if not a or not b:
        return None
    if a == b:
        return True
    if a[0].isdigit() and b[0].isdigit():
        (c1, m1), (c2, m2) = a.split("x"), b.split("x")
        return (c1 == c2 or "0" in (c1, c2)) and (m1 == m2 or "0" in (m1, m2))
    return False


def _similar(a: str, b: str) -> bool | None:
    """Whether two buildings are one; None if one is not named."""
    if not a or not b:
        return None
    (na, ta), (nb, tb) = a.rsplit(" ", 1), b.rsplit(" ", 1)
    most = max(1, round(0.3 * min(len(na), len(nb))))
    return ta == tb and addresses.edit(na, nb, most) <= most


def judge(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> int:
    """Two forms (number, old, building, street) of one locality: 0 other or unknown, 1 the same if
    the number is not ambiguous there, 2 the same premises."""
    number = a[0] == b[0] if a[0] and b[0] else None
    old = a[1] == b[1] if a[1] and b[1] else None
    building, street = _similar(a[2], b[2]), _agree(a[3], b[3])
    if number is False or building is False or street is False or (old is False and number is not True):
        return 0
    if building and (number or old):
        return 2
    if number or old:
        return 2 if street else 1
    if building:
        return 2
    return 0


def _open() -> Column:
    """What `judge` asks of any two forms, before they leave the join: numbers and named streets do not differ,
    and the numbers or old numbers agree or both name a building of the same kind."""
    both = {c: (F.col(f"{c}_a") != "") & (F.col(f"{c}_b") != "") for c in ("number", "old", "building", "street")}
    same = {c: both[c] & (F.col(f"{c}_a") == F.col(f"{c}_b")) for c in both}
    crosses = F.col("street_a").rlike("^[0-9]") & F.col("street_b").rlike("^[0-9]")
    kinds = F.substring_index("building_a", " ", -1) == F.substring_index("building_b", " ", -1)
    differ = (both["number"] & ~same["number"]) | (both["street"] & ~same["street"] & ~crosses) | (both["building"] & ~kinds)
    return ~differ & (same["number"] | same["old"] | both["building"])


def _verified(index: DataFrame, forms: DataFrame, cosine: float) -> DataFrame:
    """Candidate pairs of the index that hold: form_a < form_b, strength 1 or 2."""
    parts = ("number", "old", "building", "street")
    whole = index.join(forms.select("form", *parts), "form")
    posting = whole.select("form", *parts, F.explode("prefix").alias("gram"))
    one, other = (posting.select("gram", *(F.col(c).alias(f"{c}_{end}") for c in ("form", *parts))) for end in "ab")
    met = one.join(other, "gram").where(F.col("form_a") < F.col("form_b")).where(_open())
    pairs = met.select("form_a", "form_b").distinct()
    full = whole.drop("prefix")
    side = F.struct(*[F.col(c) for c in full.columns])
    both = pairs.join(full.select(F.col("form").alias("form_a"), side.alias("a")), "form_a").join(
        full.select(F.col("form").alias("form_b"), side.alias("b")), "form_b"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep_a, keep_b, strength = [], [], []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = judge(*((x["number"], x["old"], x["building"], x["street"]) for x in (a, b)))
                if s:
                    mine = dict(zip(a["grams"], a["weights"]))
                    if sum(mine.get(g, 0.0) * w for g, w in zip(b["grams"], b["weights"])) >= cosine:
                        keep_a.append(a["form"])
                        keep_b.append(b["form"])
                        strength.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.string()), pa.array(keep_b, pa.string()), pa.array(strength, pa.int32())], ["form_a", "form_b", "strength"])

    return both.select("a", "b").mapInArrow(check, "form_a string, form_b string, strength int")


def same_premises(parsed: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per record in a class of two or more records: key, premises, and the parts read."""
    scratch = Scratch(parsed.sparkSession, "premises")
    named = parsed.where("place <> '' AND (number <> '' OR old <> '' OR building <> '')")
    named = scratch.write(named.withColumn("form", F.concat_ws("|", *FORM)), "records")
    forms = scratch.write(named.select("form", *FORM).distinct(), "forms")
    index = scratch.write(_index(forms, cosine), "index")
    links = scratch.write(_verified(index, forms, cosine), "links")
    # a number alone is ambiguous where its locality has premises of that number in several streets
    full = forms.where("street <> '' AND number <> ''").groupBy("place", "number").agg(F.count_distinct("street").alias("streets"))
    unclear = full.where("streets > 1").join(forms.where("street = ''"), ["place", "number"]).select("form").distinct()
    weak = links.where("strength = 1")
    for end in ("form_a", "form_b"):
        weak = weak.join(unclear.withColumnRenamed("form", end), end, "left_anti")
    edges = links.where("strength = 2").select(F.col("form_a").alias("u"), F.col("form_b").alias("v")).union(
        weak.select(F.col("form_a").alias("u"), F.col("form_b").alias("v"))
    )
    found = components(edges).withColumnRenamed("node", "form")
    classed = named.join(found, "form", "left").withColumn("premises", F.coalesce("component", "form")).drop("component")
    # an ambiguous number alone is no class of its own; such a form has no edge, as strength 2 takes a building or a street
    bare = unclear.join(forms.where("building = ''"), "form", "left_semi")
    classed = scratch.write(classed.join(bare, "form", "left_anti"), "classes")
    many = classed.groupBy("premises").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("premises")
    return classed.join(many, "premises", "left_semi")


def premises_pairs(classed: DataFrame) -> DataFrame:
    """record_a < record_b of the same premises; records of a class with different numbers are no pair. `classed`
    has a row per key, so no pair comes twice."""
    a = classed.select("premises", F.col("key").alias("record_a"), F.col("number").alias("na"))
    b = classed.select("premises", F.col("key").alias("record_b"), F.col("number").alias("nb"))
    numbers = (F.col("na") == "") | (F.col("nb") == "") | (F.col("na") == F.col("nb"))
    return a.join(b, "premises").where((F.col("record_a") < F.col("record_b")) & numbers).select("record_a", "record_b")


def parsed_addresses(spark: SparkSession, wanted: dict[str, DataFrame], more: dict[str, DataFrame], localities: DataFrame, scratch: Scratch) -> DataFrame:
    """Parts of the addresses of `wanted`; the registers `more`, which have fields for
    the locality, teach further names of places."""
    places = place_rows(localities)
    aliases = learn_aliases(address_rows(more), places)
    return scratch.write(read_all(address_rows(wanted), places, aliases), "parsed")
