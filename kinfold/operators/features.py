"""Twenty-five features of a candidate pair, in fixed order. Inside expressions what is missing is
NULL; `vector` writes it as -1.0. Expects the pair's records as structs `a` and `b`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import similarity as S
from kinfold.functions.canonical import haversine_km

NAMES = (
    "name_jaro_winkler", "name_token_set_ratio", "name_jaccard_trigram", "name_lcs_ratio", "name_exact_stripped", "addr_pin_eq", "addr_door_eq", "addr_locality_match",
    "addr_cross_distance", "addr_levenshtein_residual", "addr_geo_distance_km", "id_gstin_eq", "id_phone_eq", "id_email_domain_eq", "id_pan_agreement",
    "struct_sector_compat", "struct_legal_form_compat", "struct_employee_ratio_log", "struct_reg_date_diff_log", "blk_shared_pan", "blk_shared_derived_pan",
    "blk_shared_pin_name", "blk_shared_pin_door", "blk_shared_phone", "blk_n_shared",
)
MISSING = -1.0


def _of(side: str, field: str) -> Column:
    return F.col(f"{side}.{field}")


def _equal(field: str) -> Column:
    x, y = _of("a", field), _of("b", field)
    return F.when((x != "") & (y != ""), (x == y).cast("double"))


def _shared(field: str) -> Column:
    return F.coalesce((_of("a", field) == _of("b", field)) & (_of("a", field) != ""), F.lit(False)).cast("double")


def expressions() -> dict[str, Column]:
    """Feature name -> Column, in order."""
    na, nb = _of("a", "name_normalized"), _of("b", "name_normalized")
    sa, sb = _of("a", "name_legal_form_stripped"), _of("b", "name_legal_form_stripped")
    la, lb = _of("a", "locality_raw"), _of("b", "locality_raw")
    ca, cb = _of("a", "locality_canonical"), _of("b", "locality_canonical")
    xa, xb = F.substring(_of("a", "address_raw"), 1, 128), F.substring(_of("b", "address_raw"), 1, 128)
    coordinates = [_of(s, f) for s in "ab" for f in ("latitude", "longitude")]
    known = [F.coalesce(c, F.lit(0.0)) != 0 for c in coordinates]
    apart = (F.abs(coordinates[0] - coordinates[2]) >= 1e-3) | (F.abs(coordinates[1] - coordinates[3]) >= 1e-3)
    pa, pb = (F.coalesce(_of(s, "pan"), _of(s, "legal_entity_pan")) for s in "ab")
    nic = [F.substring(_of(s, "nic_code"), 1, 2) for s in "ab"]
    cat = [_of(s, "kspcb_category") for s in "ab"]
    form = [_of(s, "legal_form") for s in "ab"]
    staff = [_of(s, "employee_count") for s in "ab"]
    e = {
        "name_jaro_winkler": S.weighted_ratio_udf(na, nb),
        "name_token_set_ratio": S.token_set_ratio_udf(na, nb),
        "name_jaccard_trigram": S.jaccard_trigram(na, nb),
        "name_lcs_ratio": S.lcs_ratio_udf(na, nb),
        "name_exact_stripped": F.coalesce((sa == sb) & (sa != ""), F.lit(False)).cast("double"),
        "addr_pin_eq": _equal("pin_code"),
        "addr_door_eq": _equal("door_number"),
        "addr_locality_match": F.when(ca.isNotNull() & cb.isNotNull() & (ca == cb), F.lit(1.0)).when(la.isNotNull() & lb.isNotNull(), S.token_set_ratio_udf(F.lower(la), F.lower(lb))),
        "addr_cross_distance": F.lit(None).cast("double"),
        "addr_levenshtein_residual": F.when((xa != "") & (xb != ""), 1 - F.levenshtein(xa, xb) / F.greatest(F.length(_of("a", "address_raw")), F.length(_of("b", "address_raw")), F.lit(1))),
        "addr_geo_distance_km": F.when(known[0] & known[1] & known[2] & known[3] & apart, haversine_km(*coordinates)),
        "id_gstin_eq": _equal("gstin"),
        "id_phone_eq": _equal("phone"),
        "id_email_domain_eq": _equal("email_domain"),
        "id_pan_agreement": F.when(pa.isNotNull() & pb.isNotNull(), (pa == pb).cast("double")),
        "struct_sector_compat": F.when((nic[0] != "") & (nic[1] != ""), F.when(nic[0] == nic[1], 1.0).otherwise(0.3)).when(cat[0].isNotNull() & cat[1].isNotNull(), F.when(cat[0] == cat[1], 1.0).otherwise(0.4)),
        "struct_legal_form_compat": F.when(form[0].isNotNull() & form[1].isNotNull(), F.when(form[0] == form[1], 1.0).otherwise(0.2)),
        "struct_employee_ratio_log": F.when((staff[0] > 0) & (staff[1] > 0), F.log1p(F.least(*staff) / F.greatest(*staff))),
        "struct_reg_date_diff_log": F.log1p(F.abs(F.datediff(_of("a", "registration_date"), _of("b", "registration_date"))).cast("double")),
        "blk_shared_pan": _shared("pan"),
        "blk_shared_derived_pan": _shared("legal_entity_pan"),
        "blk_shared_pin_name": _shared("blocking_pin_name"),
        "blk_shared_pin_door": _shared("blocking_pin_door"),
        "blk_shared_phone": _shared("phone"),
    }
    e["blk_n_shared"] = sum((e[n] for n in NAMES[20:24]), e["blk_shared_pan"])
    return e


def paired(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The pairs (canonical_id_a, canonical_id_b, ...) with their records as structs a and b."""
    whole = F.struct(*records.columns)
    a = records.select(F.col("canonical_id").alias("canonical_id_a"), whole.alias("a"))
    b = records.select(F.col("canonical_id").alias("canonical_id_b"), whole.alias("b"))
    return pairs.join(a, "canonical_id_a").join(b, "canonical_id_b")


def pair_features(pairs_with_records: DataFrame) -> DataFrame:
    return pairs_with_records.withColumns({n: c for n, c in expressions().items()})


def vector(columns: tuple[str, ...] = NAMES) -> Column:
    return F.array(*[F.coalesce(F.col(n), F.lit(MISSING)) for n in columns])
