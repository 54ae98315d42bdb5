"""Identifiers written in free text (T0 to T6): rules in order, each blanks what it read so that no later one rereads it.

Rows that can't hold an identifier are filtered in the JVM. Phrases that introduce an identifier are located once for each
text; a word without a digit is looked at only behind one of them.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters before a hit in which a cue counts (fixed value).
CUE_SPAN = 48
# Patterns of what is masked, taken, and of phrases that introduce an identifier (without diacritics).
MASKS = (
    r"\d{4}-\d{2}-\d{2}([ T]\d{1,2}:\d{2}(:\d{2})?)?(\s*(UTC|Z))?", r"\b\d{1,2}:\d{2}(:\d{2})?\b",
    r"(?i)\(\s*Profile\s+[\w.\-]+\s*\)", r"(?i)\bhttps?://\S+|\bwww\.\S+",
)
EMAIL = r"(?<![\w.+-])[\w.+-]+@[\w-]+\.[\w.-]*[\w](?![\w.-])"
PHONE = r"(?<![\w])(\+?\d[\d\s().\-]{5,18}\d)(?![\w])"
HANDLE = r"(?<![\w@.\-])@([A-Za-z][\w.\-]{2,29})(?![\w.\-])"
TOKEN = r"(?<![\w@.\-])([A-Za-z][A-Za-z0-9]*(?:[._\-][A-Za-z0-9]+)*)(?![\w@])"
STRONG = (
    "busca(?:me|lo|la|nos)?(?: a| en| como| por)", "escribi(?:me|le)?(?: a)", "agenda(?:me|lo|la)?", "agrega(?:me|lo|la)?(?: como)?",
    "anadi(?:me|lo|la)?(?: como)?", "mi (?:usuario|alias|cuenta|perfil|contacto) es", "el (?:usuario|alias) es", "contacto alternativo",
    "alias de pago", "el anticipo sale desde", "sale desde", "transferencias?", "transferi(?:me)?(?: a)?",
)
CONTACT = (
    "busca(?:me|lo|la|nos)?(?: a| en| como| por)?", "escribi(?:me|le)?(?: a)?", "agenda(?:me|lo|la)?", "agrega(?:me|lo|la)?(?: como)?",
    "anadi(?:me|lo|la)?(?: como)?", "suma(?:te|me)(?: a)?", "mi (?:usuario|alias|cuenta|perfil|contacto) es", "el (?:usuario|alias) es",
    "usuario", "alias", "perfil", "contacto(?: alternativo)?", "contactar?(?:me|lo|la)?(?: a| por)?", "habla(?:me|le)?(?: a| por)?",
    "whatsapp", "telegram", "instagram", "telefono", "cel(?:ular)?",
)
PAYMENT = (
    "transferencias?", "transferi(?:me)?(?: a)?", "el anticipo sale desde", "sale desde", "paga(?:me)?(?: a| por)?", "pagos?", "cobros?",
    "cobra(?:me)?(?: a| por)?", "sena", "anticipo", "deposito", "deposita(?:me)?(?: a| en)?", "cvu", "cbu", "alias de pago", "mercado ?pago",
    "credito", "canje", "billetera",
)
NOT_ALIAS = frozenset(
    """como que para por con sin desde hasta donde cuando cuanto ahi alli aca aqui este esta esto estos estas ese esa eso esos
    esas aquel aquella mio mia tuyo tuya suyo suya nuestro nuestra pero porque entonces tambien tampoco siempre nunca ahora luego
    antes despues todo toda todos todas nada nadie alguien algo otro otra otros otras mismo misma mucho mucha poco poca mejor peor
    hola chau gracias favor bueno buena claro dale listo obvio igual usuario alias perfil cuenta cuentas contacto contactos telefono
    celular numero numeros nombre apodo direccion mail correo whatsapp telegram instagram user profile account phone name email
    chat""".split()
)


#: Letters without which no strong phrase stands in a text; any other character may be one of them with a mark.
STEMS = ("busca", "escribi", "agenda", "agrega", "anadi", "usuario", "alias", "cuenta", "perfil", "contacto", "sale", "transfer")


def plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def alias_key(value: str) -> str | None:
    key = re.sub(r"[\s._-]+", "", re.sub(r"[^\w\s@._-]", "", plain(value.strip())))
    return key if len(key) >= 4 and re.search("[a-z]{2}", key) else None


def phone_key(value: str) -> str | None:
    """E.164 with the national rules of +54, as the Column function."""
    digits = re.sub(r"\D", "", value)
    if not digits:
        return None
    if not digits.startswith("54") and value.strip().startswith("+"):
        return "+" + digits
    n = digits[2:] if digits.startswith("54") else digits
    n = n.removeprefix("0").removeprefix("9")
    n = re.sub(r"^(11|2\d{2}|3\d{2})15(\d+)$", r"\1\2", n)
    return "+54" + n if 8 <= len(n) <= 11 else None


def email_key(value: str) -> str | None:
    local, _, domain = value.strip().lower().partition("@")
    if not re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", f"{local}@{domain}"):
        return None
    return f"{local.split('+')[0].replace('.', '')}@gmail.com" if domain in ("gmail.com", "googlemail.com") else f"{local}@{domain}"


def _ending(phrases: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"(?:{'|'.join(phrases)})\s*[:,]?\s*$")


class Phrases:
    """The introducing phrases of one text."""

    FAMILIES = (("pago", _ending(PAYMENT)), ("contacto", _ending(CONTACT)))
    BEHIND = _ending(STRONG)
    ANY = re.compile(f"(?=(?:{'|'.join(STRONG)}))")

    def __init__(self, text: str):
        self.text = text
        if text.isascii():
            self.starts = [m.start() for m in self.ANY.finditer(text.lower())]
        else:
            folded, place = [], []
            for i, c in enumerate(text):
                for d in plain(c):
                    folded.append(d)
                    place.append(i)
            self.starts = sorted({place[m.start()] for m in self.ANY.finditer("".join(folded)) if m.start() < len(place)})

    def near(self, at: int) -> bool:
        """Whether a strong phrase begins in the characters before at that count."""
        k = bisect_left(self.starts, at - CUE_SPAN)
        return k < len(self.starts) and self.starts[k] < at

    def before(self, at: int) -> tuple[str, bool]:
        """The family of the phrase that ends at at (payment before contact), and whether it is a strong one."""
        tail = plain(self.text[max(0, at - CUE_SPAN) : at])
        return next((name for name, ends in self.FAMILIES if ends.search(tail)), ""), bool(self.BEHIND.search(tail))


Hit = tuple[str, str, str, str, float]  # kind, key, written, cue, confidence


def _mail(m: re.Match, phrases: Phrases) -> Hit | None:
    key = email_key(m[0])
    return key and ("EMAIL", key, m[0], phrases.before(m.start())[0], 0.86)


def _number(m: re.Match, phrases: Phrases) -> Hit | None:
    """Digits alone may be a file number: a plus or a separator must be there."""
    if m[1].isdigit() or not (key := phone_key(m[1])):
        return None
    cue = phrases.before(m.start())[0]
    return "TELEFONO", key, m[1].strip(), cue, 0.88 if cue else 0.80


def _handle(m: re.Match, phrases: Phrases) -> Hit | None:
    key, cue = alias_key(m[1]), phrases.before(m.start())[0]
    return key and ("ALIAS_PAGO" if cue == "pago" else "ALIAS", key, m[0], cue, 0.80)


def _word(m: re.Match, phrases: Phrases) -> Hit | None:
    """With a digit anywhere, without one only behind a strong phrase and if it is no ordinary word."""
    digit = any(c.isdigit() for c in m[1])
    if not digit and not phrases.near(m.start()):
        return None
    cue, strong = phrases.before(m.start())
    key = alias_key(m[1]) if digit or strong else None
    if not key or (not digit and key in NOT_ALIAS):
        return None
    return "ALIAS_PAGO" if cue == "pago" else "ALIAS", key, m[1], cue, 0.55 + strong * (0.19 if digit else 0.03)


#: What each step reads; a step's matches are blanked, read or not.
STEPS = tuple((re.compile(p), read) for p, read in (*((m, None) for m in MASKS), (EMAIL, _mail), (PHONE, _number), (HANDLE, _handle), (TOKEN, _word)))


def find(text: str | None) -> list[Hit]:
    """Of equal identifiers the most confident reading, in the place of the first."""
    out: dict[tuple[str, str], Hit] = {}
    rest, phrases = text or "", Phrases(text or "")
    for pattern, read in STEPS:
        spans = []
        for m in pattern.finditer(rest):
            spans.append(m.span())
            hit = read and read(m, phrases)
            if hit and (hit[:2] not in out or out[hit[:2]][4] < hit[4]):
                out[hit[:2]] = (*hit[:4], round(hit[4], 2))
        if spans and read is not _word:
            parts, at = [], 0
            for lo, hi in spans:
                parts += [rest[at:lo], " " * (hi - lo)]
                at = hi
            rest = "".join(parts) + rest[at:]
    return list(out.values())


def mentions(texts: DataFrame) -> DataFrame:
    """kind, key, written, cue, confidence of each identifier in column text, beside the other columns; null texts have none."""
    kept = [f for f in texts.schema if f.name != "text"]
    found = [T.StructField(n, T.DoubleType() if n == "confidence" else T.StringType()) for n in ("kind", "key", "written", "cue", "confidence")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, hit) for i, t in enumerate(b.column("text").to_pylist()) for hit in find(t)]
            at = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name).take(at) for f in kept), *(pa.array([h[k] for _, h in rows], pa.float64() if f.name == "confidence" else pa.string()) for k, f in enumerate(found))], [f.name for f in (*kept, *found)])

    letter = lambda c: f"[{c}\\x{{80}}-\\x{{10FFFF}}]\\p{{M}}*"
    possible = r"[@0-9]|(?i:" + "|".join("".join(map(letter, s)) for s in STEMS) + ")"
    return texts.select(*[f.name for f in kept], F.col("text").cast("string").alias("text")).filter(F.col("text").rlike(possible)).mapInArrow(run, T.StructType([*kept, *found]))
