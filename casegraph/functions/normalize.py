"""Normalisers and scalar functions as Column expressions (JVM-side); Arrow functions only where Python's tables decide."""

from __future__ import annotations

import ipaddress
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab

#: What the address function returns.
TRAITS = T.StructType().add("ip", "string").add("version", "integer").add("private", "boolean").add("cgnat", "boolean").add("attributable", "boolean")


def strip(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    plain = lambda at: F.substring(value, at, 1).between("!", "~")  # noqa: E731  most values need no pattern to be searched
    return F.when(plain(1) & plain(-1), value).otherwise(_strip(value))


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def given(value: Column) -> Column:
    """Whether a JSON value, as text, says something: there, not empty, not false, not zero."""
    return F.coalesce(~value.cast("string").isin("", "false", "0", "0.0"), F.lit(False))


def node_id(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit("::"), F.lower(strip(value)))


def edge_id(u: Column, v: Column, relation: Column, method: Column, locator: Column, source: Column) -> Column:
    """Version, confidence and time are no part of it, so decisions outlive rule changes."""
    return F.concat(F.lit("e_"), F.substring(F.sha1(F.concat_ws("|", u, v, relation, method, locator, source)), 1, 16))


@F.pandas_udf(T.StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Canonical decomposition without non-spacing marks."""
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


def alias(value: Column, marks: bool = True) -> Column:
    """Trimmed, without diacritics, lower case, white space folded, only word characters, blanks and ``@._-``.

    marks=False skips the Python step where values are known to be ASCII.
    """
    t = strip(value)
    t = strip_marks(t) if marks else t
    t = F.regexp_replace(F.lower(t), r"(?U)\s+", " ")
    return F.nullif(F.regexp_replace(t, r"(?U)[^\w\s@._-]", ""), F.lit(""))


def alias_key(value: Column, marks: bool = True) -> Column:
    """Separators dropped; null under four characters or without two letters in a row."""
    k = F.regexp_replace(alias(value, marks), r"(?U)[\s._-]+", "")
    return F.when((F.length(k) >= 4) & k.rlike("[a-z]{2}"), k)


def email(value: Column) -> Column:
    t = F.lower(strip(value))
    local, domain = F.substring_index(t, "@", 1), F.substring_index(t, "@", -1)
    google = domain.isin("gmail.com", "googlemail.com")
    folded = F.concat(F.regexp_replace(F.regexp_replace(local, r"\+.*$", ""), r"\.", ""), F.lit("@gmail.com"))
    return F.when(t.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.when(google, folded).otherwise(t))


def phone(value: Column, country: str = "AR") -> Column:
    """E.164 with the national rules of +54; other numbers with a plus stay as they are."""
    raw = strip(value)
    digits = F.regexp_replace(raw, r"\D", "")
    plus, own = raw.startswith("+"), digits.startswith("54")
    national = F.when(own, F.substring(digits, 3, 1000)).otherwise(digits)
    national = F.regexp_replace(national, "^0", "")
    national = F.regexp_replace(national, "^9", "")
    national = F.regexp_replace(national, r"^(11|2\d{2}|3\d{2})15(\d+)$", "$1$2")
    kept = F.when(F.length(national).between(8, 11), F.concat(F.lit("+54"), national))
    foreign = F.concat(F.lit("+"), digits)
    out = F.when(own, kept).when(plus, foreign).otherwise(kept if country == "AR" else foreign)
    return F.when(F.length(digits) > 0, out)


def phone_area(e164: Column) -> Column:
    n = F.substring(e164, 4, 1000)
    return F.when(e164.startswith("+54"), F.when(F.length(n) > 4, F.substring(n, 1, 4)).when(F.length(n) > 3, F.substring(n, 1, 3)).when(F.length(n) > 2, F.substring(n, 1, 2)))


@F.pandas_udf(TRAITS)
def ip(s: pd.Series) -> pd.DataFrame:
    """Canonical v4 or v6 address and traits; nulls if it is none."""
    shared = ipaddress.ip_network("100.64.0.0/10")

    def one(v: str | None) -> tuple:
        try:
            a = ipaddress.ip_address((v or "").strip())
        except ValueError:
            return None, None, None, None, None
        carrier = a.version == 4 and a in shared
        return str(a), a.version, a.is_private, carrier, not (a.is_private or carrier)

    return pd.DataFrame([one(v) for v in s], columns=["ip", "version", "private", "cgnat", "attributable"])


def ipv4_number(value: Column) -> Column:
    """An IPv4 address as a number, null if it is none; built-in only."""
    t = strip(value)
    part = F.split(t, r"\.")
    number = F.lit(0).cast("long")
    for k in range(4):
        number = number * 256 + F.get(part, F.lit(k)).cast("long")
    return F.when(t.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"), number)


def instant(value: Column) -> Column:
    """ISO (Z too), else day-first forms; without a zone it is UTC, whatever the session's."""
    t = strip(value)
    naive = F.coalesce(t.try_cast("timestamp_ntz"), *[F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm")])
    return F.when(has_zone(t), t.try_cast("timestamp")).otherwise(F.convert_timezone(F.lit("UTC"), F.current_timezone(), naive).cast("timestamp"))


def has_zone(value: Column) -> Column:
    """Whether an ISO time names its zone; without one a note belongs to the value."""
    return strip(value).rlike(r"(?i)\d(Z|UTC|[+-]\d{2}:?\d{2})$")


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def hours_between(a: Column, b: Column) -> Column:
    return F.abs(micros(a) - micros(b)) / F.lit(3.6e9)


def within_hours(a: Column, b: Column, hours: Column) -> Column:
    return hours_between(a, b) <= hours


def account_key(service: Column, user: Column) -> Column:
    return F.concat(alias(service), F.lit("/"), strip(user))


def location_key(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *[F.nullif(strip(p), F.lit("")) for p in parts]), F.lit(""))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_blocks(h: Column) -> Column:
    """Nine blocks of a 64-bit hash, the first of eight bits, eight of seven: two hashes within eight bits share one."""
    blocks = [F.struct(F.lit(0).alias("no"), F.shiftrightunsigned(h, 56).alias("bits"))]
    blocks += [F.struct(F.lit(k + 1).alias("no"), F.shiftrightunsigned(h, 49 - 7 * k).bitwiseAND(F.lit(127)).alias("bits")) for k in range(8)]
    return F.array(*blocks)


def block_masks(parts: int, bits: int = 64) -> list[int]:
    """Masks of so many blocks of a hash, from the upper end, the first ones a bit longer if they can't be equal."""
    size, more = divmod(bits, parts)
    out, at = [], bits
    for k in range(parts):
        at -= size + (k < more)
        out.append(((1 << (size + (k < more))) - 1) << at)
    return out


def signed(x: int) -> int:
    """A 64-bit pattern as the number that Spark takes for it."""
    return x - (1 << 64) if x >> 63 else x


def discriminance(df: Column) -> Column:
    """One up to ten reports, then falling with the logarithm, never under 0.15."""
    return F.when(df <= vocab.FULL_DF, 1.0).otherwise(F.greatest(F.lit(vocab.LEAST_DISCRIMINANCE), F.least(F.lit(1.0), F.log(F.lit(float(vocab.FULL_DF + 1))) / F.log1p(df))))


def is_common(df: Column, reports: Column) -> Column:
    return (df >= vocab.HUB_DF) | ((reports >= vocab.CORPUS_MINIMUM) & (df > vocab.CORPUS_SHARE * reports))


def band(confidence: Column) -> Column:
    return F.when(confidence >= vocab.HIGH, "alta").when(confidence >= vocab.PROBABLE, "media").otherwise("baja")


def number_text(value: Column, digits: int = 2) -> Column:
    """Dot for thousands, comma for decimals, a dash for null."""
    return F.coalesce(F.translate(F.format_number(value, digits), ",.", ".,"), F.lit("—"))


def list_text(items: Column) -> Column:
    """``a, b y c``."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" y "), F.element_at(items, -1)))


def date_text(iso: Column) -> Column:
    """``2026-03-14...`` as ``14/03/2026``; other texts stay, null is empty."""
    head = F.substring(iso, 1, 10)
    return F.coalesce(F.when(F.size(F.split(head, "-")) == 3, F.concat_ws("/", F.split_part(head, F.lit("-"), F.lit(3)), F.split_part(head, F.lit("-"), F.lit(2)), F.split_part(head, F.lit("-"), F.lit(1)))).otherwise(iso), F.lit(""))


def title(text: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


#: Words for path fields, as records are shown to people.
PATH_NAMES = {
    "reportedInformation": "Información reportada", "reportedPeople": "Personas reportadas", "reportedPersons": "Persona reportada",
    "childVictims": "Víctima", "intendedRecipients": "Destinatario", "incidentDetails": "Hechos", "chatIncident": "Chat", "notes": "Nota",
    "uploadedFiles": "Archivo", "sourceInformation": "Capturas", "sourceCaptures": "Captura", "emails": "Correo", "phones": "Teléfono",
    "displayNames": "Nombre visible", "screenNames": "Nombre de usuario", "screenName": "Nombre de usuario", "espUserId": "Cuenta",
    "espEstimatedLocations": "Ubicación estimada", "profileBio": "Biografía", "automatedInformation": "Información automática",
    "autoGeneratedNotes": "Notas automáticas", "geoLookups": "Geolocalización", "fileDetails": "Archivo del manifiesto", "details": "Detalle",
}


def path_label(locator: Column) -> Column:
    """A JSON path for people: known names in words, indices from 1, unknown parts as they are; ``value`` says nothing."""
    names = F.create_map(*[F.lit(x) for kv in PATH_NAMES.items() for x in kv])

    def part(p: Column) -> Column:
        name, at = F.regexp_extract(p, r"^([^\[#]*)", 1), F.regexp_extract(p, r"\[(\d+)\]", 1)
        return F.concat(F.coalesce(F.try_element_at(names, name), name), F.when(at != "", F.concat(F.lit(" "), (at.cast("int") + 1).cast("string"))).otherwise(""))

    return F.array_join(F.transform(F.filter(F.split(locator, r"\."), lambda p: p != "value"), part), " › ")


@F.pandas_udf(T.StringType())
def record_hash(s: pd.Series) -> pd.Series:
    """Ledger hash of a record given as JSON: sha256 of its sorted-key form without ``hash``."""
    import hashlib

    def one(t: str) -> str:
        r = json.loads(t)
        r.pop("hash", None)
        return "sha256:" + hashlib.sha256(json.dumps(r, ensure_ascii=False, sort_keys=True).encode()).hexdigest()

    return s.map(lambda t: None if t is None else one(t))
