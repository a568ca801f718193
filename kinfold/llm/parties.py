"""Register records with their names and addresses taken apart, for matching names and businesses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import addresses, names, premises
from kinfold.llm.survivor import usable_phone
from kinfold.session import Scratch

NAMES = {
    "ekarmika_records": "name",
    "fbis_records": "factory_name",
    "kspcb_records": "industry_name",
    "bescom_records": "consumer_name",
    "bwssb_records": "consumer_name",
}
PANS = {"ekarmika_records": "pan", "fbis_records": "occupier_pan", "kspcb_records": "pan"}

#: Registers that file businesses; the others file whoever pays for the connection.
ESTABLISHMENTS = frozenset(("ekarmika_records", "fbis_records", "kspcb_records"))

PARTS = (
    "key string, register string, name string, core array<string>, trade string, firm boolean, initials array<string>, "
    "place string, number string, old string, building string, street string, phone string, pan string, gstin string, email string"
)


def _firm(n: names.Name, register: str) -> bool:
    """Whether the name is a firm's: it is marked as one, or the register lists establishments only, or it
    is a single word, where a person's has a second one or an initial."""
    return n.firm or register in ESTABLISHMENTS or (len(n.core) == 1 and not n.initials)


def _code(raw: Column, pattern: str) -> Column:
    """An identifier in capitals without blanks and hyphens; NULL if it does not have the form."""
    text = F.upper(F.regexp_replace(raw, r"[\s-]", ""))
    return F.when(text.rlike(pattern), text)


def rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Every distinct key with its name, identifiers and untouched address. Of re-delivered rows the
    one with a phone counts."""
    out = None
    none = F.lit(None).cast("string")
    for register, frame in tables.items():
        key, address, more, pin = premises.SOURCES[register]
        pan = F.col(PANS[register]) if register in PANS else none
        gstin = F.col("gstin") if "gstin" in frame.columns and register in PANS else none
        email = F.col("email") if "email" in frame.columns and register in PANS else none
        one = frame.where(F.col(key).isNotNull()).select(
            F.col(key).alias("key"),
            F.struct(
                F.col("phone").isNotNull().alias("has_phone"),
                F.col(NAMES[register]).alias("name"),
                F.col(address).alias("address"),
                (F.concat_ws(" ; ", *more) if more else none).alias("more"),
                (F.col(pin) if pin else none).alias("pin"),
                usable_phone(F.col("phone")).alias("phone"),
                _code(pan, r"^[A-Z]{5}\d{4}[A-Z]$").alias("pan"),
                _code(gstin, r"^\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]{3}$").alias("gstin"),
                F.when(email.contains("@"), F.lower(F.trim(email))).alias("email"),
            ).alias("r"),
        )
        one = one.groupBy("key").agg(F.max("r").alias("r")).select("key", F.lit(register).alias("register"), "r.*").drop("has_phone")
        out = one if out is None else out.unionByName(one)
    return out


def read_all(spark: SparkSession, tables: dict[str, DataFrame], localities: DataFrame, scratch: Scratch, more: dict[str, DataFrame]) -> DataFrame:
    """The parts (`PARTS`) of all records; the registers `more`, which have fields for the
    locality, teach further names of places."""
    places = premises.place_rows(localities)
    aliases = premises.learn_aliases(premises.address_rows(more), places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = addresses.opened(places, aliases)
        for batch in batches:
            c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            who = [names.read(n) for n in c["name"]]
            where = [addresses.read(a, known, m, p) for a, m, p in zip(c["address"], c["more"], c["pin"])]
            text = pa.string()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c["key"], text),
                    pa.array(c["register"], text),
                    pa.array(c["name"], text),
                    pa.array([list(n.core) for n in who], pa.list_(text)),
                    pa.array([n.trade for n in who], text),
                    pa.array([_firm(n, r) for n, r in zip(who, c["register"])], pa.bool_()),
                    pa.array([list(n.initials) for n in who], pa.list_(text)),
                    *(pa.array([getattr(a, f) for a in where], text) for f in ("place", "number", "old", "building", "street")),
                    *(pa.array(c[f], text) for f in ("phone", "pan", "gstin", "email")),
                ],
                [p.split()[0] for p in PARTS.split(", ")],
            )

    return scratch.write(rows(tables).mapInArrow(run, PARTS), "parties")


def values(column: pa.Array | pa.ChunkedArray) -> list:
    """`to_pylist` of a column of texts, numbers, or lists of them, without an object per value in between."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    if pa.types.is_list(kind) and not column.null_count:
        ends, inner = column.offsets.to_pylist(), values(column.values)
        return [inner[i:j] for i, j in zip(ends, ends[1:])]
    if pa.types.is_string(kind) or pa.types.is_boolean(kind) or (pa.types.is_floating(kind) and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def dicts(rows: pa.StructArray | pa.RecordBatch) -> list[dict]:
    """`to_pylist` of rows none of which is null, column by column."""
    if isinstance(rows, pa.RecordBatch):
        names_of, columns = rows.schema.names, rows.columns
    else:
        names_of, columns = [f.name for f in rows.type], rows.flatten()
    return [dict(zip(names_of, row)) for row in zip(*map(values, columns))]


def same_spot(a: dict, b: dict) -> bool | None:
    """Whether two records stand at the same premises; None if their addresses do not tell."""
    if not a["place"] or not b["place"]:
        return None
    if a["place"] != b["place"]:
        return False
    held = premises.judge(*((x["number"], x["old"], x["building"], x["street"]) for x in (a, b)))
    if held:
        return True
    if (a["number"] and b["number"] and a["number"] != b["number"]) or (a["street"] and b["street"] and not premises._agree(a["street"], b["street"])):
        return False
    return None
