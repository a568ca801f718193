"""Source adapters: one projection per register onto the canonical record.

Each adapter is a function DataFrame -> DataFrame in `ADAPTERS`; another register is one more entry.
Re-delivered or malformed values never fail a row: what cannot be read is NULL. Columns a register
does not have are NULL, so all adapters return `COLUMNS` in the same order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import canonical as C
from kinfold.functions import dictionaries as D

COLUMNS = {
    "canonical_id": "string", "source_system": "string", "source_record_id": "string", "source_schema_version": "string", "name_raw": "string", "name_normalized": "string",
    "name_tokens": "array<string>", "name_legal_form_stripped": "string", "address_raw": "string", "pin_code": "string", "door_number": "string", "street_raw": "string",
    "locality_raw": "string", "locality_canonical": "string", "taluk": "string", "district": "string", "latitude": "double", "longitude": "double", "pan": "string",
    "pan_entity_type": "string", "pan_is_proprietorship": "boolean", "gstin": "string", "gstin_state_code": "string", "legal_entity_pan": "string",
    "pan_derived_from_gstin": "boolean", "cin": "string", "phone": "string", "email": "string", "email_domain": "string", "sector_raw": "string", "nic_code": "string",
    "kspcb_category": "string", "tariff_category": "string", "legal_form": "string", "employee_count": "int", "sanctioned_load_kw": "double", "registration_date": "date",
    "rr_number": "string", "account_id": "string", "k_number": "string", "bescom_consumer_name_risk": "boolean", "consent_valid_until": "date", "licence_valid_until": "date",
    "blocking_name_prefix4": "string", "blocking_pin_name": "string", "blocking_pin_door": "string",
}


def _text(frame: DataFrame, *names: str) -> Column:
    """The first of several columns that is there and not blank."""
    have = [C.blank_to_null(F.col(n).cast("string")) for n in names if n in frame.columns]
    return F.coalesce(*have, F.lit(None).cast("string"))


def _date(frame: DataFrame, *names: str) -> Column:
    have = [F.col(n) if dict(frame.dtypes)[n] == "date" else C.parse_date(F.col(n).cast("string")) for n in names if n in frame.columns]
    return F.coalesce(*have, F.lit(None).cast("date"))


def _canonical(frame: DataFrame, source: str, key: Column, name: Column, address: Column, parsed: bool = True, **own: Column) -> DataFrame:
    """The shared part: names, address parts, identifiers and block keys, with the adapter's own columns."""
    nothing = F.lit(None).cast("string")
    base = frame.select(
        key.alias("source_record_id"),
        F.coalesce(name, F.lit("")).alias("name_raw"),
        F.coalesce(address, F.lit("")).alias("address_raw"),
        C.clean_pan(own.get("pan", nothing)).alias("pan"),
        C.clean_gstin(own.get("gstin", nothing)).alias("gstin"),
        C.clean_email(own.get("email", nothing)).alias("email"),
        C.clean_phone(own.get("phone", nothing)).alias("phone"),
        own.get("given_pin", nothing).alias("_pin"),
        own.get("given_taluk", nothing).alias("_taluk"),
        own.get("given_district", nothing).alias("_district"),
        own.get("given_locality", nothing).alias("_locality"),
        *[c.alias(n) for n, c in own.items() if n in COLUMNS and n not in ("pan", "gstin", "email", "phone")],
    ).where(F.col("source_record_id").isNotNull())
    addr = F.col("address_raw")
    if parsed:
        door, locality, street = C.door_number(addr), C.locality_raw(addr), C.street_raw(addr)
        pin = F.coalesce("_pin", C.pin_code(addr))
        taluk, district = F.coalesce("_taluk", C.taluk(addr)), F.coalesce("_district", C.district(addr))
    else:
        door = street = nothing
        locality, pin, taluk, district = F.col("_locality"), F.col("_pin"), F.col("_taluk"), F.col("_district")
    parts = base.select(
        *[c for c in base.columns if not c.startswith("_")],
        F.coalesce(C.name_normalized(F.col("name_raw")), F.lit("")).alias("name_normalized"),
        F.coalesce(C.name_tokens(F.col("name_raw")), F.array().cast("array<string>")).alias("name_tokens"),
        door.alias("door_number"),
        street.alias("street_raw"),
        locality.alias("locality_raw"),
        pin.alias("pin_code"),
        taluk.alias("taluk"),
        district.alias("district"),
    )
    derived = C.pan_of_gstin(F.col("gstin"))
    full = (
        parts.withColumn("name_legal_form_stripped", C.strip_legal_suffix(F.col("name_normalized")))
        .withColumn("locality_canonical", C.locality_canonical(F.col("locality_raw")))
        .withColumns(
            {
                "source_system": F.lit(source),
                "source_schema_version": F.lit("1.0"),
                "canonical_id": F.sha2(F.concat_ws("|", F.lit(source), "source_record_id"), 256),
                "pan_entity_type": C.pan_entity_type(F.col("pan")),
                "pan_is_proprietorship": C.pan_is_proprietorship(F.coalesce("pan", derived)),
                "gstin_state_code": F.substring("gstin", 1, 2),
                "legal_entity_pan": F.coalesce("pan", derived),
                "pan_derived_from_gstin": F.col("pan").isNull() & derived.isNotNull(),
                "email_domain": C.email_domain(F.col("email")),
            }
        )
    )
    prefix, pin_name, pin_door = C.block_keys(F.col("name_legal_form_stripped"), F.col("pin_code"), F.col("door_number"))
    full = full.withColumns({"blocking_name_prefix4": prefix, "blocking_pin_name": pin_name, "blocking_pin_door": pin_door})
    if "bescom_consumer_name_risk" not in own:
        full = full.withColumn("bescom_consumer_name_risk", F.lit(False))
    return full.select(*[(F.col(n) if n in full.columns else F.lit(None)).cast(t).alias(n) for n, t in COLUMNS.items()])


def shops(frame: DataFrame) -> DataFrame:
    t = lambda *n: _text(frame, *n)
    return _canonical(
        frame, "ekarmika", t("establishment_registration_no"), t("name", "establishment_name"), t("address"),
        pan=t("pan"), gstin=t("gstin"), email=t("email"), phone=t("phone"), sector_raw=t("nature_of_business"),
        employee_count=C.parse_int(t("employee_count")), registration_date=_date(frame, "date_of_commencement"),
    )


def factories(frame: DataFrame) -> DataFrame:
    """Taluk, district and pin fields override what the address says; horse power becomes kW."""
    t = lambda *n: _text(frame, *n)
    address = F.concat_ws(", ", t("address"), t("village_town"), t("taluk"), t("district"), t("pin_code"))
    form = t("constitution_type")
    return _canonical(
        frame, "fbis", t("licence_number"), t("factory_name", "name"), F.when(address != "", address),
        pan=t("occupier_pan", "pan"), gstin=t("gstin"), email=t("email"), phone=t("phone"), sector_raw=t("nature_of_manufacturing"), nic_code=t("nic_code"),
        given_pin=t("pin_code"), given_taluk=t("taluk"), given_district=F.lower(t("district")),
        legal_form=F.when(form.isNotNull(), F.coalesce(C.first_contained(form, D.FACTORY_LEGAL_FORMS), F.lit("other"))),
        employee_count=C.parse_int(t("employee_count")),
        sanctioned_load_kw=F.coalesce(t("installed_kw").try_cast("double"), t("installed_hp").try_cast("double") * 0.7457),
        registration_date=_date(frame, "registration_date"), licence_valid_until=_date(frame, "licence_valid_until"),
    )


def pollution_board(frame: DataFrame) -> DataFrame:
    """Place fields are taken as they are; the address is not parsed, so door and street are unknown."""
    t = lambda *n: _text(frame, *n)
    address = F.concat_ws(", ", t("industrial_area"), t("taluk"), F.lower(t("district")), t("pin_code"))
    category = F.lower(t("industry_category"))
    letters = F.create_map(*[F.lit(x) for c in ("red", "orange", "green", "white") for x in (c[0], c)])
    category = F.coalesce(letters[category], category)
    return _canonical(
        frame, "kspcb", t("consent_file_no"), t("industry_name", "name"), F.when(address != "", address), parsed=False,
        pan=t("pan"), gstin=t("gstin"), email=t("email"), phone=t("phone"), sector_raw=t("sector"), nic_code=t("nic_code"), cin=C.clean_cin(t("cin")),
        given_locality=t("industrial_area"), given_pin=t("pin_code"), given_taluk=t("taluk"), given_district=F.lower(t("district")),
        kspcb_category=F.when(category.isin("red", "orange", "green", "white"), category),
        latitude=t("latitude").try_cast("double"), longitude=t("longitude").try_cast("double"),
        registration_date=_date(frame, "date_of_commissioning"), consent_valid_until=_date(frame, "valid_until"),
    )


def electricity(frame: DataFrame) -> DataFrame:
    t = lambda *n: _text(frame, *n)
    rr, k = C.clean_connection_id(t("rr_number")), C.clean_connection_id(t("k_number"))
    return _canonical(
        frame, "bescom", F.coalesce(rr, t("account_id"), k, t("id")), t("consumer_name", "name"), t("service_address", "address"),
        phone=t("phone"), tariff_category=t("tariff_category"), rr_number=rr, account_id=t("account_id"), k_number=k,
        sanctioned_load_kw=t("sanctioned_load_kw").try_cast("double"), bescom_consumer_name_risk=C.looks_like_individual(t("consumer_name", "name")),
    )


def water(frame: DataFrame) -> DataFrame:
    """The pipe size stands in the load column and the ids in the electricity slots."""
    t = lambda *n: _text(frame, *n)
    knca = C.clean_connection_id(t("knca_number", "connection_number"))
    return _canonical(
        frame, "bwssb", F.coalesce(knca, t("account_id"), t("consumer_number")), t("consumer_name", "name"), t("service_address", "address"),
        phone=t("phone"), tariff_category=t("tariff_category"), rr_number=knca, account_id=t("account_id"), k_number=t("consumer_number"),
        sanctioned_load_kw=t("connection_size_mm").try_cast("double"),
        bescom_consumer_name_risk=C.looks_like_individual(t("consumer_name", "name"), (*D.BUSINESS_WORDS, "corp", "corporation")),
    )


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"ekarmika": shops, "fbis": factories, "kspcb": pollution_board, "bescom": electricity, "bwssb": water}


def register(source: str, adapter: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a source; the adapter must return `COLUMNS`."""
    ADAPTERS[source] = adapter


def adapt(frame: DataFrame, source: str) -> DataFrame:
    return ADAPTERS[source](frame)


def adapt_all(tables: dict[str, DataFrame]) -> DataFrame:
    """Canonical records of several registers, each natural key once (the delivery that sorts first)."""
    parts = [adapt(frame, source) for source, frame in tables.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    rest = [n for n in COLUMNS if n not in ("source_system", "source_record_id")]
    once = union.groupBy("source_system", "source_record_id").agg(F.min(F.struct(F.col("phone").isNull().alias("_no_phone"), *rest)).alias("r"))
    return once.select(*[F.col(n) if n in ("source_system", "source_record_id") else F.col(f"r.{n}").alias(n) for n in COLUMNS])
