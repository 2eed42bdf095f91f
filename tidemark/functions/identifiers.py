"""The corporate identifier: typing, decoding, and disagreement with the record."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import stripped

# Identifier patterns (anchored at both ends).
CIN_PATTERN = "[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}"
LLPIN_PATTERN = "[A-Z]{3}-[0-9]{4}"
FCRN_PATTERN = "F[0-9]{5}"
PAN_PATTERN = "[A-Z]{5}[0-9]{4}[A-Z]"
DIN_PATTERN = "[0-9]{8}"

# Place (from 1) and width of each segment.
SEGMENTS = {"listing_letter": (1, 1), "nic_code": (2, 5), "state_letters": (7, 2), "incorporation_year": (9, 4), "ownership_class": (13, 3), "roc_serial": (16, 6)}

# Registrar letters and the state that the registrar sits in.
STATES = {
    "AN": "andaman and nicobar islands", "AP": "andhra pradesh", "AR": "arunachal pradesh", "AS": "assam", "BR": "bihar", "CH": "chandigarh", "CT": "chattisgarh", "DC": "delhi",
    "DD": "daman and diu", "DL": "delhi", "DN": "dadra & nagar haveli", "GA": "goa", "GJ": "gujarat", "HP": "himachal pradesh", "HR": "haryana", "JH": "jharkhand",
    "JK": "jammu & kashmir", "KA": "karnataka", "KL": "kerala", "LD": "lakshadweep", "LH": "ladakh", "ME": "maharashtra", "MH": "maharashtra", "ML": "meghalaya",
    "MN": "manipur", "MP": "madhya pradesh", "MR": "maharashtra", "MZ": "mizoram", "NL": "nagaland", "OD": "orissa", "OR": "orissa", "PB": "punjab", "PN": "maharashtra",
    "PY": "pondicherry", "RJ": "rajasthan", "SK": "sikkim", "TG": "telangana", "TN": "tamil nadu", "TR": "tripura", "TS": "telangana", "TZ": "tamil nadu",
    "UP": "uttar pradesh", "UR": "uttarakhand", "UT": "uttarakhand", "UW": "uttar pradesh", "WB": "west bengal", "WR": "west bengal",
}
UNKNOWN_STATE = "UNKNOWN"


def matches(c: Column, pattern: str) -> Column:
    """Whole-string match; `$` would allow a final line break."""
    return c.rlike(rf"\A(?:{pattern})\z")


def valid_cin(c: Column) -> Column:
    """The trimmed, upper-cased identifier if it is well formed, else null."""
    n = F.upper(stripped(c.cast("string")))
    return F.when(matches(n, CIN_PATTERN), n)


def identifier_type(c: Column) -> Column:
    n = F.upper(stripped(c.cast("string")))
    return F.when(matches(n, CIN_PATTERN), "CIN").when(matches(n, LLPIN_PATTERN), "LLPIN").when(matches(n, FCRN_PATTERN), "FCRN").otherwise("UNKNOWN")


def _segment(cin: Column, name: str) -> Column:
    return F.substring(cin, *SEGMENTS[name])


def _state(letters: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return F.when(letters.isNotNull(), F.coalesce(F.element_at(pairs, letters), F.lit(UNKNOWN_STATE)))


def decoded(c: Column) -> list[Column]:
    """The ten columns read off an identifier; all null where it isn't well formed."""
    cin = valid_cin(c)
    part = {k: _segment(cin, k) for k in SEGMENTS}
    return [
        part["listing_letter"].alias("cin_listing_letter"),
        (part["listing_letter"] == "L").alias("cin_is_listed"),
        part["nic_code"].alias("cin_nic_code"),
        F.substring(part["nic_code"], 1, 2).alias("cin_nic_division"),
        part["state_letters"].alias("cin_state_letters"),
        _state(part["state_letters"]).alias("cin_state_name"),
        part["incorporation_year"].cast("int").alias("cin_incorporation_year"),
        part["ownership_class"].alias("cin_ownership_class"),
        part["roc_serial"].cast("int").alias("cin_roc_serial"),
        F.concat(part["state_letters"], F.lit(":"), part["incorporation_year"], F.lit(":"), part["ownership_class"]).alias("cin_registrar_year_cohort_key"),
    ]


def disagreements(cin: Column, registered: Column, nic: Column, listing: Column, state: Column) -> list[Column]:
    """Four tri-state flags (null: undecidable) and the count of those that are true."""
    c = valid_cin(cin)
    nic_record = F.substring(stripped(nic.cast("string")), 1, 2)
    listing_record, state_record = F.lower(stripped(listing.cast("string"))), F.lower(stripped(state.cast("string")))
    known_state = F.when(_state(_segment(c, "state_letters")) != UNKNOWN_STATE, _state(_segment(c, "state_letters")))
    pairs = {
        "year": (_segment(c, "incorporation_year").cast("int"), F.year(registered)),
        "nic_division": (F.substring(_segment(c, "nic_code"), 1, 2), F.when(matches(nic_record, "[0-9]{2}"), nic_record)),
        "listing": (_segment(c, "listing_letter") == "L", F.when(listing_record == "listed", True).when(listing_record == "unlisted", False)),
        "state": (known_state, F.when(state_record != "", state_record)),
    }
    flags = {k: F.when(a.isNotNull() & b.isNotNull(), a != b) for k, (a, b) in pairs.items()}
    count = sum((F.coalesce(f, F.lit(False)).cast("int") for f in list(flags.values())[1:]), F.coalesce(flags["year"], F.lit(False)).cast("int"))
    return [*[f.alias(f"cin_{k}_disagrees_with_record") for k, f in flags.items()], count.alias("cin_record_disagreement_count")]


def candidate(c: Column, pattern: str) -> Column:
    """The trimmed, upper-cased value if all of it matches, else null."""
    n = F.upper(stripped(c.cast("string")))
    return F.when(matches(n, pattern), n)


@dataclass(frozen=True)
class Decoded:
    """Scalar form of decoded(), for services on the driver."""

    listing_letter: str
    nic_code: str
    state_letters: str
    state_name: str
    incorporation_year: int
    ownership_class: str
    roc_serial: int

    @property
    def cohort_key(self) -> str:
        return f"{self.state_letters}:{self.incorporation_year:04d}:{self.ownership_class}"


def decode(value: str | None) -> Decoded | None:
    cin = (value or "").strip().upper()
    if not re.fullmatch(CIN_PATTERN, cin):
        return None
    part = {k: cin[at - 1 : at - 1 + width] for k, (at, width) in SEGMENTS.items()}
    return Decoded(part["listing_letter"], part["nic_code"], part["state_letters"], STATES.get(part["state_letters"], UNKNOWN_STATE), int(part["incorporation_year"]), part["ownership_class"], int(part["roc_serial"]))


def year_disagrees(value: str | None, registered: date | None) -> bool | None:
    found = decode(value)
    return None if found is None or registered is None else found.incorporation_year != registered.year
