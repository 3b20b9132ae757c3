"""Vessel identity: validity rules, categories and surrogate ids, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _most_of_a_digit(mmsi: Column) -> Column:
    """How often the most frequent digit occurs."""
    return F.greatest(*[F.length(mmsi) - F.length(F.replace(mmsi, F.lit(str(d)), F.lit(""))) for d in range(10)])


def valid_mid(mmsi: Column) -> Column:
    """Nine digits, country code 201 to 775, no digit six times or more."""
    return F.coalesce(mmsi.rlike(r"^\d{9}$") & F.substring(mmsi, 1, 3).try_cast("int").between(201, 775) & (_most_of_a_digit(mmsi) < 6), F.lit(False))


def vessel_mmsi(mmsi: Column) -> Column:
    """Nine digits that start with 2 to 7, no digit six times or more."""
    return F.coalesce(mmsi.rlike(r"^[2-7]\d{8}$") & (_most_of_a_digit(mmsi) < 6), F.lit(False))


def plausible_mmsi(mmsi: Column) -> Column:
    """Nine digits, not all equal, and not 123456789."""
    return F.coalesce(mmsi.rlike(r"^\d{9}$") & (_most_of_a_digit(mmsi) < 9) & (mmsi != "123456789"), F.lit(False))


def nine_digits(mmsi: Column) -> Column:
    return F.coalesce(mmsi.rlike(r"^[0-9]{9}$"), F.lit(False))


def imo_valid(imo: Column) -> Column:
    """Seven digits whose last is the weighted sum of the others modulo 10."""
    d = F.regexp_replace(imo, r"\D", "")
    total = sum((F.substring(d, k + 1, 1).try_cast("int") * (7 - k) for k in range(6)), F.lit(0))
    return F.coalesce((F.length(d) == 7) & (total % 10 == F.substring(d, 7, 1).try_cast("int")), F.lit(False))


def surrogate_track_id(vessel: Column, date: Column) -> Column:
    """A date's own id for a vessel: the first 16 hex digits of SHA-256 of both."""
    return F.substring(F.sha2(F.concat_ws(":", vessel, date), 256), 1, 16)


def keyed_id(vessel: Column, key: bytes) -> Column:
    """``v_`` and 18 bytes of HMAC-SHA256 in url-safe base64, by two nested hashes over the padded key."""
    key = key.ljust(64, b"\0")
    inner, outer = F.lit(bytes(x ^ 0x36 for x in key)), F.lit(bytes(x ^ 0x5C for x in key))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(vessel, "UTF-8")), 256))
    mac = F.unhex(F.sha2(F.concat(outer, first), 256))
    return F.concat(F.lit("v_"), F.translate(F.base64(F.substring(mac, 1, 18)), "+/", "-_"))


def is_cargo(code: Column) -> Column:
    """Whole ship type codes from 70 to 79."""
    return F.coalesce(code.between(70, 79) & (code == F.floor(code)), F.lit(False))


def ship_category(code: Column) -> Column:
    """Category of a numeric ship type code."""
    return (
        F.when(code == 30, "fishing")
        .when(code.isin(31, 32, 52), "tug")
        .when(code.isin(36, 37), "pleasure")
        .when(code.between(60, 69), "passenger")
        .when(code.between(70, 79), "cargo")
        .when(code.between(80, 89), "tanker")
        .otherwise("other")
    )


#: Names of buoys and net markers, with a battery or signal suffix or a serial number; names of fishing boats.
GEAR_NAME = r"%|^[A-Z]{1,4}\d*-+\d|-{2,}|^(.)\1{5,}$|^[^A-Z0-9]{3,}$|^\W*[0-9 ]{5,}\W*$"
FISHING_NAME = r"[A-Z]{2,}YU\s?\d{2,}|\bFV\b|FISHING|TRAWL|\bYU\s?\d{3,}|NO\.?\s?\d+$"
#: Ship types that sail repeated lines by their trade.
EXEMPT_TYPES = ("fishing", "pleasure", "passenger", "ferry", "tug", "pilot", "sar", "service", "dredger")
#: A feed's vessel classes, and navigational statuses by text.
FEED_CLASSES = {
    "FISHING": "fishing",
    "CARGO": "cargo",
    "PASSENGER": "passenger",
    "CARRIER": "carrier",
    "BUNKER": "bunker",
    "SEISMIC_VESSEL": "seismic",
    "OTHER": "other",
    "NA": "other",
}
NAV_STATUS = {
    "UNDER_WAY_USING_ENGINE": 0,
    "AT_ANCHOR": 1,
    "NOT_UNDER_COMMAND": 2,
    "RESTRICTED_MANEUVERABILITY": 3,
    "CONSTRAINED_BY_DRAUGHT": 4,
    "MOORED": 5,
    "AGROUND": 6,
    "ENGAGED_IN_FISHING": 7,
    "UNDER_WAY_SAILING": 8,
}


def looks_like_gear(name: Column, mmsi: Column) -> Column:
    """Whether a name is that of a buoy or net marker; a name that only repeats the vessel's number says nothing."""
    n = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    return (n != "") & (n != F.coalesce(mmsi, F.lit(""))) & n.rlike(GEAR_NAME)


def is_exempt(ship_type: Column, name: Column) -> Column:
    """Whether a vessel may sail repeated lines: by type, or a fishing boat by name."""
    n = F.replace(F.upper(F.coalesce(name, F.lit(""))), F.lit("-"), F.lit(""))
    return F.coalesce(ship_type.isin(*EXEMPT_TYPES), F.lit(False)) | n.rlike(FISHING_NAME)


def looked_up(text: Column, table: dict) -> Column:
    """The value of a text in a fixed table, null where it has none."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, F.upper(F.trim(text)))


def live_kinematics(kind: Column, sog: Column, cog: Column, heading: Column) -> tuple[Column, Column, Column]:
    """Speed, course and heading of a live message, null where they hold the message type's "not available"."""
    far = kind == 27
    speed = F.when(far, F.when(sog < 63, sog)).otherwise(F.when(sog < 102.3, sog))
    course = F.when(far, F.when(cog < 511, cog)).otherwise(F.when(cog < 360, cog))
    return speed, course, F.when(heading < 511, heading)
