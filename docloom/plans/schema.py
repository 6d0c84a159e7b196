"""Labels of all models: (label, field of the record, merge rule), and the tags of emission. Drives every fold and every emitter."""

from __future__ import annotations

#: Merge rules: a separator behind ``join:`` appends all; ``differ:`` appends what differs but for case and spaces, else takes the new
#: spelling; ``shorter:`` appends what differs while the value so far is shorter, else replaces it; first, longest.
SEMI, TAB = "; ", "\t"
_D, _J = f"differ:{SEMI}", f"join:{SEMI}"

FIELDS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "header": (
        ("docnum", "docnum", _D), ("title", "title", _D), ("date", "date", "longest"), ("time", "time", "first"), ("dateline", "dateline", _D), ("medic", "medics", _J), ("patient", "patients", _J), ("affiliation", "affiliation", _D),
        ("address", "address", _D), ("org", "org", _D), ("email", "email", _D), ("phone", "phone", _D), ("fax", "fax", _D), ("web", "web", _D), ("doctype", "doctype", _D), ("note", "note", "join: "),
    ),
    "left_note": tuple((x, x, "join:\n") for x in ("idno", "affiliation", "org", "address", "country", "settlement", "phone", "fax", "email", "web", "medic", "note")),
    "medic": (
        ("idno", "idno", _J), ("rolename", "role", f"join:{TAB}"), ("persname", "pers_name", _J), ("affiliation", "affiliation", _J), ("center", "org_name", _J), ("service", "org_name", _J), ("department", "org_name", _J),
        ("administration", "org_name", _J), ("orgname", "org_name", _J), ("institution", "institution", _J), ("address", "address", _J), ("country", "country", _J), ("settlement", "town", _J), ("email", "email", _J), ("phone", "phone", _J), ("fax", "fax", _J), ("web", "web", _J), ("note", "note", "join: "),
    ),
    "patient": (
        ("idno", "id", _J), ("idtype", "id_type", f"join:{TAB}"), ("persname", "pers_name", "first"), ("sex", "sex", "first"), ("birthdate", "birth", "first"), ("birthplace", "birth_place", "first"), ("age", "age", "first"), ("death", "death", "first"),
        ("address", "address", "first"), ("country", "country", "first"), ("settlement", "town", "first"), ("phone", "phone", f"shorter:{SEMI}"), ("email", "email", f"shorter:{SEMI}"), ("note", "note", "join: "),
    ),
    "organization": tuple((x, y, f"join:{TAB}") for x, y in (("orgname", "org_name"), ("address", "address"), ("country", "country"), ("settlement", "town"), ("email", "email"), ("phone", "phone"), ("fax", "fax"), ("web", "web"), ("note", "note"))),
    "address": tuple(
        (x, y, f"join:{TAB}")
        for x, y in (("streetnumber", "street_number"), ("streetname", "street_name"), ("buildingnumber", "building_number"), ("buildingname", "building_name"), ("city", "city"), ("postcode", "post_code"), ("pobox", "po_box"), ("community", "community"), ("district", "district"), ("departmentnumber", "department_number"), ("departmentname", "department_name"), ("region", "region"), ("country", "country"), ("note", "note"))
    ),
    "person_name": tuple((x, y, f"join:{TAB}") for x, y in (("title", "title"), ("forename", "first_name"), ("middlename", "middle_name"), ("surname", "last_name"), ("suffix", "suffix"))),
    "dateline": (("doctype", "doctype", "join:;\t"), ("place", "place_name", "join:;\t"), ("date", "date", "join:;\t"), ("time", "time_string", "join:;\t"), ("note", "note", "join: ")),
}

ENTITY_TYPES = ("anatomy", "date", "device", "dose", "email", "fax", "idno", "idtype", "living", "location", "measure", "object", "orgname", "pathology", "persname", "perstype", "phone", "physiology", "procedure", "medicament", "rolename", "substance", "symptom", "unit", "time", "value", "web")
FIELDS["entity"] = tuple((x, x, f"join:{TAB}") for x in ENTITY_TYPES)

#: Zone label to tag; ``other`` has none.
ZONE_TAGS = {
    "titlePage": "titlePage", "header": "front", "headnote": 'note place="headnote"', "footnote": 'note place="footnote"', "marginnote": 'note place="marginnote"', "leftnote": 'note place="left"', "rightnote": 'note place="right"',
    "body": "body", "page": "page", "annex": 'div type="annex"', "acknowledgement": 'div type="acknowledgement"',
}

#: Tags of annotated corpora to labels, by alias.
ALIASES = {"anat": "anatomy", "chem": "substance", "devi": "device", "diso": "pathology", "disorder": "pathology", "geog": "location", "livb": "living", "objc": "object", "phen": "phenomenon", "phys": "physiology", "proc": "procedure", "cover": "titlePage", "organization": "org"}


def fields_of(model: str) -> list[str]:
    """Record fields in order, each once."""
    return list(dict.fromkeys(f for _, f, _ in FIELDS[model]))
