"""Variant spellings of names: exact radius joins in a partitioned metric space.

The space. A point is a spelling in a neighbourhood: the distinctive words of a name together with a
locality, with a telephone number, with a tax number, or (firms of two or more words) with their trade or its
absence, in any place. The metric is Levenshtein distance between the words plus
`APART` if the neighbourhoods differ; it is a metric because both parts are. `APART` exceeds the
radius, so every neighbourhood is the cell of a pivot no other cell needs to be searched from.

Large cells are partitioned further by rings around pivots, first of all the empty name, whose
distance to a name is the name's length. A point of distance d lies in ring d // width and is copied
into the next ring if d + radius reaches it; by the triangle inequality no pair within the radius
lacks a common ring. Rings are cut into blocks joined pairwise, so no task holds a whole cell.

Names of firms in any place are joined within `ANYWHERE`, the others within `RADIUS`.

Inside, bag distance (a lower bound of edit distance) leaves few pairs to the exact metric. A name has
points for typed and sorted word order, for persons one without all but the first letters of the given
name (nicknames, initials), and for firms one with an initial in place of a word.

Pairs within the radius are then checked exactly: same trade, edits in proportion to length, and for
abbreviated names the same premises or telephone.

Defined results: names equal as strings are no pair; a missing or empty name, and persons without a
known locality, telephone and tax number, are in no pair. Persons and firms of one word are compared
across localities only if they share a telephone or tax number: such names recur by chance, and most
equal ones belong to different tax numbers. Re-delivered keys count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import names, parties
from kinfold.llm.addresses import edit, fold
from kinfold.session import Scratch

RADIUS = 4
#: Radius for names of firms that share nothing but the trade.
ANYWHERE = 2
APART = 100
#: Points up to which a cell stays whole; above it rings and blocks of about this size are formed.
CELL = 1_500


def pans(r: dict) -> set[str]:
    """Tax numbers of a record: its own and the one inside its GSTIN."""
    return {r["pan"], r["gstin"][2:12] if r["gstin"] else None} - {None}


def points(records: DataFrame) -> DataFrame:
    """cell, kind, text of each record's points: key, cell, kind, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], []]
            for r in parties.dicts(batch):
                key, core, trade, firm, initials, place, phone = (r[c] for c in ("key", "core", "trade", "firm", "initials", "place", "phone"))
                own = [(k, fold(text)) for k, text in names.keys(names.Name(tuple(core), trade, firm, tuple(initials)))]
                if not firm and core:
                    own += [("q", fold(x) + y[:2]) for x in core for y in (*core, *initials) if x is not y and len(x) >= 4]
                if not firm and len(core) == 2:  # perhaps a firm without any mark
                    own += [("f", fold("".join(core))), ("f", fold("".join(sorted(core))))]
                own += [("k", sound) for sound in _consonants(core)]
                whole = f"N{'castings' if trade == 'coatings' else trade}" if firm and len(core) > 1 else ""
                number, street, building = r["number"], r["street"], r["building"]
                door = f"S{number}|{street}" if number and street else ""
                for cell in (f"L{place}" if place else "", f"T{phone}" if phone else "", *(f"P{p}" for p in pans(r)), door, f"B{building}" if building else "", whole):
                    if cell:
                        for kind, text in own if cell[0] != "N" else [("n", text) for text in _orders(core)]:
                            for at, v in enumerate((key, cell, kind, text)):
                                rows[at].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.string()) for r in rows], ["key", "cell", "kind", "text"])

    return records.select("key", "core", "trade", "firm", "initials", "place", "number", "street", "building", "phone", "pan", "gstin").mapInArrow(run, "key string, cell string, kind string, text string").distinct()


def _consonants(core: list[str]) -> set[str]:
    """The consonants of the words, in alphabetical order: no exchange of letters changes them."""
    return {c for c in ("".join(sorted(set(fold("".join(core))) - set("aeiou"))),) if len(c) > 3}


def _codes(texts: list[str]) -> np.ndarray:
    """One row of character codes per text, filled up with zeros."""
    wide = max(1, max(map(len, texts), default=1))
    return np.array(texts, dtype=f"<U{wide}").view(np.uint32).reshape(len(texts), wide)


def edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of many pairs of texts (`_codes`) at once: one cell of the table for all pairs a step."""
    la, lb = (a != 0).sum(1), (b != 0).sum(1)
    high, wide = int(la.max(initial=0)), int(lb.max(initial=0))
    every = np.arange(len(a))
    row = np.repeat(np.arange(wide + 1, dtype=np.int16)[:, None], len(a), axis=1)
    out = lb.copy()  # of empty texts
    for i in range(high):
        now = np.empty_like(row)
        now[0] = i + 1
        differ = (b[:, :wide] != a[:, i : i + 1]).T
        for j in range(wide):
            now[j + 1] = np.minimum(np.minimum(row[j + 1], now[j]) + 1, row[j] + differ[j])
        row = now
        out = np.where(la == i + 1, row[lb, every], out)
    return out


def _within(texts: list[str], radius: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs (i in left, j in right) within the radius, each unordered pair once."""
    letters = np.zeros((len(texts), 27), np.int16)
    for i, t in enumerate(texts):
        for c in t:
            letters[i, ord(c) - 97 if "a" <= c <= "z" else 26] += 1
    codes = _codes(texts)
    out: list[tuple[int, int]] = []
    ones: list[np.ndarray] = []
    others: list[np.ndarray] = []
    side = letters[right]
    same = left is right

    def measure() -> None:
        i, k = (np.concatenate(v) if v else np.zeros(0, int) for v in (ones, others))
        near = edits(codes[i], codes[k]) <= radius
        out.extend(zip(i[near].tolist(), k[near].tolist()))
        ones.clear()
        others.clear()

    waiting = 0
    for n, i in enumerate(left):
        diff = (side[n + 1 :] if same else side) - letters[i]
        more = np.maximum(diff, 0).sum(1)
        bag = np.maximum(more, more - diff.sum(1))
        hits = np.flatnonzero(bag <= radius)
        ones.append(np.full(len(hits), i))
        others.append((right[n + 1 :] if same else right)[hits])
        waiting += len(hits)
        if waiting > 20_000:
            measure()
            waiting = 0
    measure()
    return out


def radius_join(spots: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """All pairs of different texts of one (cell, kind) within the radius: cell, kind, text_a < text_b."""
    size = spots.groupBy("cell", "kind").agg(F.count(F.lit(1)).alias("n"))
    width = radius + 1
    sized = spots.join(size, ["cell", "kind"])
    ring = F.floor(F.length("text") / width).cast("int")
    reach = F.floor((F.length("text") + radius) / width).cast("int")
    ringed = sized.select(
        "cell", "kind", "text", F.explode(F.when(F.col("n") > cell, F.sequence(ring, reach)).otherwise(F.array(F.lit(-1)))).alias("ring")
    )
    held = ringed.groupBy("cell", "kind", "ring").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / cell).cast("int")
    cut = ringed.join(held, ["cell", "kind", "ring"]).withColumn("blocks", blocks)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int"))
    # small cells go to the worker together, each still joined by itself
    small = held.where(F.col("n") <= cell).agg(F.sum("n")).first()[0] or 0
    several = F.concat(F.lit("#"), F.pmod(F.xxhash64("cell", "kind", "ring"), F.lit(1 + small // (4 * cell))))
    cut = cut.withColumn("pack", F.when(F.col("blocks") > 1, F.concat_ws("|", "cell", "kind", "ring")).otherwise(several))
    paired = cut.select("pack", "cell", "kind", "ring", "text", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = paired.select("pack", "cell", "kind", "ring", "text", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def join(group: pa.Table) -> pa.Table:
        whose: dict[tuple, list[int]] = {}
        for at, k in enumerate(zip(*(group.column(c).to_pylist() for c in ("cell", "kind", "ring")))):
            whose.setdefault(k, []).append(at)
        texts, block = np.array(group.column("text").to_pylist()), group.column("block").to_numpy()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        columns: tuple[list, list, list, list] = ([], [], [], [])
        for (name, kind, _), rows in whose.items():
            mine, at = texts[rows].tolist(), block[rows]
            every = np.arange(len(mine))
            left, right = (every, every) if i == j else (np.flatnonzero(at == i), np.flatnonzero(at == j))
            for a, b in _within(mine, radius, left, right):
                for c, v in zip(columns, (name, kind, *sorted((mine[a], mine[b])))):
                    c.append(v)
        return pa.table([pa.array(c, pa.string()) for c in columns], ["cell", "kind", "text_a", "text_b"])

    found = paired.groupBy("pack", "i", "j").applyInArrow(join, "cell string, kind string, text_a string, text_b string")
    return found.distinct()  # a pair may share two rings


def _same_party(a: dict, b: dict, kind: str) -> bool:
    """The exact check of two records whose points are within the radius."""
    here = bool(a["place"]) and a["place"] == b["place"]
    spot = parties.same_spot(a, b)
    call = (bool(a["phone"]) and a["phone"] == b["phone"]) or bool(pans(a) & pans(b))
    near = spot is True or call
    # a locality read amiss, or not at all, still leaves house, street and building
    door = not here and sum((bool(a["number"]) and a["number"] == b["number"], bool(a["street"]) and a["street"] == b["street"], bool(a["building"]) and a["building"] == b["building"])) > 1
    if a["firm"] != b["firm"]:  # a firm without any mark: a person's name would share one word only
        both = len(a["core"]) == len(b["core"]) == 2
        return both and kind in "fk" and here and (near or spot is None) and names.firms_alike(a, b) >= 0.7
    trades = bool(a["trade"] and b["trade"])
    alike = trades and (a["trade"] == b["trade"] or {a["trade"], b["trade"]} == {"castings", "coatings"})
    if not a["firm"]:
        if kind == "q":
            return (near or here or door) and _persons(a, b, near or door)
        d = min(edit(x, y, RADIUS) for x in _orders(a["core"]) for y in _orders(b["core"]))
        length = min(len("".join(a["core"])), len("".join(b["core"])))
        return (d <= max(1, round(0.3 * length)) and (near or d <= 2)) or (here and _persons(a, b, near))
    if trades and not alike:
        return False
    if kind == "i":
        short = any(bool(x["initials"]) and len(x["core"]) < 2 for x in (a, b))
        return short and (near or (((here and spot is None) or door) and alike and names.firms_alike(a, b) >= 0.8))
    if kind == "n":  # two rare words and the trade agree, wherever they are
        d = min(edit(x, y, ANYWHERE) for x in _orders(a["core"]) for y in _orders(b["core"]))
        starts = [[w[:2] for w in sorted(x["core"])] for x in (a, b)]
        sure = starts[0] == starts[1] or min(len("".join(x["core"])) for x in (a, b)) >= 12
        return d <= (ANYWHERE if a["trade"] and sure else 1)
    likeness = names.firms_alike(a, b)
    if door and likeness >= 0.6:
        return True
    if near:
        return likeness >= (0.2 if alike else 0.3)
    if spot is None:
        return likeness >= (0.5 if alike else 0.6)
    return likeness >= 0.6 and (alike or len(a["core"]) > 1)


def _orders(core: list[str]) -> set[str]:
    return {"".join(core), "".join(sorted(core))}


def _persons(a: dict, b: dict, near: bool) -> bool:
    """Two personal names agree: one word is nearly the same, the others begin alike or are initials. Away
    from each other's premises initials do not tell, and shortened names need three letters in common."""
    for x in a["core"]:
        for y in b["core"]:
            if len(x) >= 4 and names.closeness(x, y) >= (0.5 if near else 0.7):
                rest_a = [w for w in a["core"] if w is not x] or a["initials"]
                rest_b = [w for w in b["core"] if w is not y] or b["initials"]
                for u in rest_a:
                    for v in rest_b:
                        if near and u[0] == v[0] and (names.closeness(x, y) >= 0.7 or len(u) == 1 or len(v) == 1 or u[:2] == v[:2] or edit(u, v, 3) <= 3):
                            return True
                        if not near and min(len(u), len(v)) >= 3 and (fold(u)[:3] == fold(v)[:3] or names.closeness(u, v) >= 0.7):
                            return True
    return False


def variants(records: DataFrame, radius: int = RADIUS) -> DataFrame:
    """record_a < record_b whose differing names mean the same party."""
    scratch = Scratch(records.sparkSession, "spellings")
    owned = scratch.write(points(records.where("name IS NOT NULL")), "points")
    spots = owned.select("cell", "kind", "text").distinct()
    anywhere = F.col("kind") == "n"
    # consonants are met by equal ones only
    within = radius_join(spots.where(~F.col("kind").isin("n", "k")), radius).unionByName(radius_join(spots.where(anywhere), min(radius, ANYWHERE)))
    within = scratch.write(within, "within")
    same = spots.select("cell", "kind", F.col("text").alias("text_a"), F.col("text").alias("text_b"))
    # a spelling of one record only has no pair with itself
    many = owned.groupBy("cell", "kind", "text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = same.join(many.select("cell", "kind", F.col("text").alias("text_a")), ["cell", "kind", "text_a"], "left_semi")
    spelled = within.unionByName(same)
    a = owned.select("cell", "kind", F.col("text").alias("text_a"), F.col("key").alias("x"))
    b = owned.select("cell", "kind", F.col("text").alias("text_b"), F.col("key").alias("y"))
    met = spelled.join(a, ["cell", "kind", "text_a"]).join(b, ["cell", "kind", "text_b"]).where("x <> y")
    met = met.select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"), "kind").distinct()
    side = F.struct("name", "core", "trade", "firm", "initials", "place", "number", "old", "building", "street", "phone", "pan", "gstin")
    full = met.join(records.select(F.col("key").alias("record_a"), side.alias("a")), "record_a").join(
        records.select(F.col("key").alias("record_b"), side.alias("b")), "record_b"
    ).where("a.name <> b.name AND (a.firm = b.firm OR (size(a.core) = 2 AND size(b.core) = 2))")
    # what the exact check always asks for, before rows leave the JVM
    trades = F.expr("a.trade = b.trade OR a.trade = '' OR b.trade = '' OR (a.trade IN ('castings', 'coatings') AND b.trade IN ('castings', 'coatings'))")
    spot = F.expr("a.place = b.place AND a.place <> '' AND ((a.number = b.number AND a.number <> '') OR (a.old = b.old AND a.old <> '') OR (a.building <> '' AND b.building <> ''))")
    taxed = F.arrays_overlap(*(F.array_compact(F.array(F.col(f"{s}.pan"), F.substring(f"{s}.gstin", 3, 10))) for s in "ab"))
    close = spot | F.coalesce(F.expr("a.phone = b.phone"), F.lit(False)) | F.coalesce(taxed, F.lit(False))
    here = F.expr("a.place = b.place AND a.place <> ''")
    door = F.expr("(a.number <> '' AND a.number = b.number) OR (a.building <> '' AND a.building = b.building)")
    full = full.where(trades & (close | here | door | ~F.col("kind").isin("q", "i")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ka, kb, kind), (a, b) = map(parties.values, batch.columns[:3]), map(parties.dicts, batch.columns[3:])
            keep = [i for i in range(len(ka)) if _same_party(a[i], b[i], kind[i])]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for i in keep], pa.string()) for k in (ka, kb)], ["record_a", "record_b"])

    held = full.select("record_a", "record_b", "kind", "a", "b").mapInArrow(check, "record_a string, record_b string")
    return held.distinct()
