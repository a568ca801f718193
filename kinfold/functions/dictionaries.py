"""Reference lists of canonicalization and activity scoring.

Fixed values: the entries and, where the first hit decides, their order must be as they are.
"""

from __future__ import annotations

ABBREVIATIONS = {
    "trdrs": "traders", "inds": "industries", "ind": "industries", "engg": "engineering", "eng": "engineering", "mfg": "manufacturing",
    "mfrs": "manufacturers", "intl": "international", "intrnl": "international", "natl": "national", "ntnl": "national", "tech": "technologies",
    "techs": "technologies", "technlgs": "technologies", "soln": "solution", "solns": "solutions", "srvcs": "services", "srvc": "service",
    "svcs": "services", "mktg": "marketing", "dist": "distributors", "distbn": "distribution", "suppl": "suppliers", "supl": "suppliers",
    "dev": "developers", "devlp": "developers", "infra": "infrastructure", "const": "construction", "constrn": "construction", "elect": "electrical",
    "elec": "electrical", "electrncs": "electronics", "chem": "chemicals", "pharma": "pharmaceuticals", "agri": "agricultural", "auto": "automobiles",
    "autom": "automobiles", "fabs": "fabricators", "fab": "fabrication", "pkg": "packaging", "pack": "packaging", "food": "food", "htl": "hotel",
    "restr": "restaurant", "medl": "medical", "hlth": "health", "hlthcre": "healthcare",
}

LEGAL_SUFFIXES = (
    "private limited", "pvt limited", "pvt ltd", "private ltd", "public limited", "pub limited", "pub ltd", "limited liability partnership", "llp",
    "limited", "ltd", "& sons", "& co", "& company", "and sons", "and co", "and company", "enterprises", "enterprise", "industries", "industry",
    "traders", "trading", "trade", "m/s", "messrs", "the", "company", "co",
)

FACTORY_LEGAL_FORMS = (
    ("proprietorship", "proprietorship"), ("sole proprietor", "proprietorship"), ("partnership", "partnership"), ("pvt ltd", "pvt_ltd"),
    ("private limited", "pvt_ltd"), ("public limited", "public_ltd"), ("llp", "llp"), ("cooperative", "cooperative"), ("government", "government"), ("huf", "huf"),
)

DISTRICTS = (
    ("bengaluru urban", "bengaluru urban"), ("bangalore urban", "bengaluru urban"), ("bengaluru rural", "bengaluru rural"), ("bangalore rural", "bengaluru rural"),
    ("mysuru", "mysuru"), ("mysore", "mysuru"), ("hubli", "dharwad"), ("dharwad", "dharwad"), ("mangaluru", "dakshina kannada"), ("mangalore", "dakshina kannada"),
    ("belagavi", "belagavi"), ("belgaum", "belagavi"), ("tumakuru", "tumakuru"), ("tumkur", "tumakuru"), ("kolar", "kolar"), ("ramanagara", "ramanagara"),
    ("chikkaballapur", "chikkaballapur"), ("mandya", "mandya"), ("hassan", "hassan"), ("chitradurga", "chitradurga"), ("davanagere", "davanagere"),
    ("davangere", "davanagere"), ("shivamogga", "shivamogga"), ("shimoga", "shivamogga"), ("udupi", "udupi"), ("kodagu", "kodagu"), ("coorg", "kodagu"),
)

TALUKS = (
    ("anekal", "anekal"), ("bangalore north", "bengaluru north"), ("bangalore south", "bengaluru south"), ("bangalore east", "bengaluru east"),
    ("yelahanka", "yelahanka"), ("krishnarajapura", "krishnarajapura"), ("kengeri", "kengeri"), ("nelamangala", "nelamangala"),
    ("devanahalli", "devanahalli"), ("doddaballapur", "doddaballapur"), ("ramanagara", "ramanagara"), ("channapatna", "channapatna"),
)

LOCALITY_SYNONYMS = (
    ("peenya industrial area phase 1", ("peenya 1st stage", "peenya phase i", "peenya phase 1", "peenya i stage", "peenya stage 1")),
    ("peenya industrial area phase 2", ("peenya 2nd stage", "peenya phase ii", "peenya phase 2", "peenya ii stage", "peenya stage 2", "peenya industrial area phase 2")),
    ("peenya industrial area phase 3", ("peenya 3rd stage", "peenya phase iii", "peenya phase 3", "peenya iii stage")),
    ("peenya industrial area phase 4", ("peenya 4th stage", "peenya phase iv", "peenya phase 4")),
    ("bommasandra industrial area", ("bommasandra ind area", "bommasandra indl area", "bommasandra")),
    ("bommasandra industrial area phase 1", ("bommasandra phase i", "bommasandra 1st phase", "bommasandra phase 1")),
    ("bommasandra industrial area phase 4", ("bommasandra phase iv", "bommasandra 4th phase")),
    ("jigani industrial area", ("jigani indl area", "jigani ind area")),
    ("kiadb industrial area", ("kiadb", "karnataka industrial areas development board")),
    ("whitefield", ("whitfield", "white field", "varthur road whitefield")),
    ("electronic city phase 1", ("electronic city phase i", "electronics city phase 1", "ecity phase 1")),
    ("electronic city phase 2", ("electronic city phase ii", "ecity phase 2")),
    ("hsr layout", ("hsr", "h s r layout")),
    ("koramangala", ("koramangla", "korumangala")),
    ("indiranagar", ("indiranagar", "indira nagar", "indranagar")),
    ("banaswadi", ("banasawadi", "banashankari")),
    ("hebbal", ("hebbala", "hebbal kempapura")),
    ("yeshwanthpur", ("yeshwantpur", "yashvantpur", "yshvantpur")),
    ("rajajinagar", ("rajaji nagar", "rajajinagar")),
    ("vijayanagar", ("vijaya nagar", "vijaynagar")),
    ("majestic", ("majestic", "city market", "gandhi nagar")),
    ("shivajinagar", ("shivaji nagar", "shivajinagar")),
    ("ulsoor", ("ulsooru", "ulsoor lake")),
    ("nelamangala industrial area", ("nelamangala ind area", "nelamangala indl")),
    ("nandi industrial corridor", ("nandic", "nandi corridor")),
    ("anekal", ("anekal taluk", "anekal town")),
    ("bidadi industrial area", ("bidadi ind area", "bidadi")),
    ("dobbaspet industrial area", ("dobbaspet ind area", "dobbaspet")),
    ("tumkur road industrial area", ("tumkur road indl", "tumkur rd industrial")),
)

LOCALITY_CENTROIDS = {
    "peenya industrial area": (13.0286, 77.5197), "peenya industrial area phase 1": (13.0290, 77.5197), "peenya industrial area phase 2": (13.0277, 77.5210),
    "peenya industrial area phase 3": (13.0265, 77.5224), "peenya industrial area phase 4": (13.0254, 77.5238), "bommasandra industrial area": (12.8087, 77.6970),
    "bommasandra industrial area phase 1": (12.8112, 77.6932), "bommasandra industrial area phase 4": (12.8033, 77.7045), "jigani industrial area": (12.7858, 77.6364),
    "kiadb industrial area": (13.0286, 77.5197), "kiadb industrial area anekal": (12.7099, 77.6964), "whitefield": (12.9698, 77.7500), "electronic city": (12.8398, 77.6770),
    "electronic city phase 1": (12.8456, 77.6603), "electronic city phase 2": (12.8225, 77.6788), "hsr layout": (12.9082, 77.6476), "koramangala": (12.9352, 77.6245),
    "indiranagar": (12.9784, 77.6408), "banaswadi": (13.0167, 77.6504), "hebbal": (13.0357, 77.5970), "yeshwanthpur": (13.0297, 77.5544), "rajajinagar": (12.9912, 77.5550),
    "vijayanagar": (12.9716, 77.5301), "majestic": (12.9764, 77.5712), "shivajinagar": (12.9852, 77.6025), "ulsoor": (12.9799, 77.6238),
    "nelamangala industrial area": (13.1018, 77.3969), "nelamangala": (13.1018, 77.3969), "nandi industrial corridor": (13.3704, 77.6831), "anekal": (12.7099, 77.6964),
    "bidadi industrial area": (12.7959, 77.3849), "bidadi": (12.7959, 77.3849), "dobbaspet industrial area": (13.2358, 77.4244), "dobbaspet": (13.2358, 77.4244),
    "tumkur road industrial area": (13.0527, 77.5046), "hoskote": (13.0707, 77.7975), "doddaballapur": (13.2949, 77.5374), "attibele": (12.7882, 77.7706),
    "yelahanka": (13.1007, 77.5963), "rajajinagar industrial estate": (12.9988, 77.5450), "kumbalgodu industrial area": (12.8804, 77.4444), "harohalli industrial area": (12.6356, 77.4756),
}

PIN_CENTROIDS = {
    "560001": (12.9716, 77.5946), "560002": (12.9686, 77.5760), "560003": (13.0007, 77.5664), "560008": (12.9716, 77.6196), "560038": (12.9784, 77.6408),
    "560043": (13.0167, 77.6504), "560050": (12.9472, 77.5407), "560058": (13.0286, 77.5197), "560060": (13.0297, 77.5544), "560066": (12.9698, 77.7500),
    "560078": (12.9081, 77.5841), "560085": (12.9263, 77.5614), "560095": (12.9165, 77.6135), "560099": (12.8087, 77.6970), "560100": (12.8456, 77.6603),
    "560102": (12.9082, 77.6476), "560103": (12.9698, 77.7500), "560106": (13.0357, 77.5970), "562106": (12.7099, 77.6964), "562123": (13.1018, 77.3969),
    "562109": (13.0707, 77.7975), "562122": (13.2949, 77.5374), "562125": (13.0527, 77.5046), "562157": (12.7959, 77.3849),
}

DISTRICT_CENTROIDS = {
    "bengaluru urban": (12.9716, 77.5946), "bengaluru rural": (13.2257, 77.5750), "bangalore urban": (12.9716, 77.5946), "bangalore rural": (13.2257, 77.5750),
    "mysuru": (12.2958, 76.6394), "mysore": (12.2958, 76.6394), "tumakuru": (13.3409, 77.1010), "tumkur": (13.3409, 77.1010), "hubli-dharwad": (15.3647, 75.1240),
    "mangaluru": (12.9141, 74.8560), "mangalore": (12.9141, 74.8560), "belagavi": (15.8497, 74.4977), "belgaum": (15.8497, 74.4977), "kalaburagi": (17.3297, 76.8343),
    "gulbarga": (17.3297, 76.8343), "ballari": (15.1394, 76.9214), "bellary": (15.1394, 76.9214), "shivamogga": (13.9299, 75.5681), "shimoga": (13.9299, 75.5681),
}

#: sector -> (dormant multiplier, keywords); only seasonal sectors change a threshold.
SECTORS = (
    ("wedding_hall", 2.0, ("wedding", "kalyana mantapa", "marriage hall", "function hall", "banquet")),
    ("fireworks", 3.0, ("fireworks", "crackers", "diwali", "pyrotechnics")),
    ("agricultural_processing", 2.0, ("rice mill", "flour mill", "oil mill", "sugar", "jaggery", "agro", "groundnut")),
    ("construction", 1.0, ("construction", "builder", "contractor", "civil works", "infrastructure")),
    ("textile", 1.0, ("textile", "garment", "apparel", "fabric", "weaving", "spinning")),
)

#: event type -> (weight, cadence in days or None, sign, closes the business)
SIGNALS = {
    "se_renewal_pre2019": (0.7, 1825, 1, False), "se_selfcert_post2019": (0.3, 365, 1, False), "se_closure": (1.0, None, 1, True), "se_amendment": (0.4, None, 1, False),
    "fac_form20_annual": (0.8, 365, 1, False), "fac_form21_halfyearly": (0.7, 183, 1, False), "fac_license_renewal": (0.9, None, 1, False), "fac_inspection": (0.4, None, 1, False),
    "fac_accident": (0.3, None, 1, False), "fac_delicensed": (1.0, None, 1, True), "kspcb_cfo_renewal": (0.9, None, 1, False), "kspcb_compliance_report": (0.6, 180, 1, False),
    "kspcb_consent_revoked": (1.0, None, 1, True), "kspcb_cca_issued": (0.8, None, 1, False), "bescom_bill_generated": (0.5, 30, 1, False), "bescom_bill_paid": (0.9, 30, 1, False),
    "bescom_zero_consumption": (0.4, 30, -1, False), "bescom_disconnect": (0.9, None, -1, False), "bescom_reconnect": (0.9, None, 1, False), "bescom_tariff_change": (0.3, None, 1, False),
    "bwssb_bill_generated": (0.4, 30, 1, False), "bwssb_bill_paid": (0.7, 30, 1, False), "bwssb_zero_consumption": (0.3, 30, -1, False), "bwssb_disconnect": (0.7, None, -1, False),
    "bwssb_reconnect": (0.7, None, 1, False),
}

PAN_HOLDERS = {"P": "individual", "C": "company", "F": "partnership", "H": "huf", "T": "trust", "A": "aop", "B": "boi", "L": "local_authority", "J": "juridical_person", "G": "government"}

BUSINESS_WORDS = ("pvt", "ltd", "limited", "industries", "traders", "enterprises", "company", "co", "llp", "manufacturing", "solutions", "services", "technologies", "tech", "infra", "construction")

HEURISTIC_WEIGHTS = {
    "name_jaro_winkler": 0.25, "name_token_set_ratio": 0.20, "name_jaccard_trigram": 0.10, "addr_pin_eq": 0.15, "addr_locality_match": 0.10, "id_gstin_eq": 0.30,
    "id_phone_eq": 0.08, "id_pan_agreement": 0.40, "blk_shared_pan": 0.35, "blk_shared_derived_pan": 0.25, "blk_n_shared": 0.05,
}
