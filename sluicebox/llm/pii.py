"""Personal information inside free text: found, and replaced by typed placeholders (problem 8).

Mail addresses (in signs or words), phone numbers, id numbers and street addresses are found by grammars of their forms
in several languages, names by a token classifier (`names`), which is fitted on all texts of the corpus and on labelled
sentences of its own (`fit`). Each text is read whole, by one vectorised pass over its Arrow batch; only the fit shuffles.

A number is replaced by a keyed permutation within its own format: a Feistel network moves it one to one to another
number of that format, so that equal values stay equal, and linked, across documents, and only the holder of the key can
turn them back (`permuted(..., back=True)`). What makes a number valid stays so: check digits and letters that hold are
computed anew (Spanish identity numbers, French social security numbers, German tax numbers), numbers that keep the rules
of their kind (areas of US social security and phone numbers, prefixes of British insurance numbers) are moved among
those that do, and others among the others, by walking the permutation until it comes back to the same class. Of a phone
number its national digits are moved: country code, trunk zero and extension stay, so that a number is linked however it
is written. Dates of birth are moved among the days of two centuries where `dates` asks for it; they are no kind of
their own otherwise. Names, mail and street addresses get a keyed tag of 128 bits, equal for equal values (whatever
their case and spacing). The rest of the text stays as it is, sign by sign.

Defined results: null texts stay null and have no spans, empty ones stay empty; offsets count code points from 0, end
exclusive; spans don't overlap; of repeated rows each is treated alike; other columns travel along unchanged.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fitting, names

KINDS = ("email", "phone", "id_number", "address", "name")

# ---------------------------------------------------------------- one-to-one normal form (offsets stay)

_SIGNS = {0x2018: "'", 0x2019: "'", 0x02BC: "'", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2212: "-", 0x3000: " ", 0x00A0: " ", 0x202F: " ", 0x205F: " "}
_SIGNS |= {c: " " for c in range(0x2000, 0x200B)}
_SIGNS |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}



def composed(text: str) -> tuple[str, list[int] | None]:
    """The form of a text that the rules read, and where each of its signs (and its end) stands in the text; None: at the same place."""
    t = text.translate(_SIGNS)
    if unicodedata.is_normalized("NFC", t):
        return t, None
    parts, place, i = [], [], 0
    while i < len(t):
        j = i + 1
        while j < len(t) and unicodedata.combining(t[j]):
            j += 1
        part = unicodedata.normalize("NFC", t[i:j]) if j > i + 1 else t[i]
        parts.append(part)
        place += [min(i + k, j - 1) for k in range(len(part))]
        i = j
    return "".join(parts), [*place, len(t)]


# ---------------------------------------------------------------- pieces of the grammars

S = r"[ \t]+"
#: A break between the lines of an address.
BR = r"(?:[ \t]*,?[ \t]*\n[ \t>]*|,[ \t]{0,3})"

_WORD = r"[\p{L}\p{N}_][\p{L}\p{N}\p{M}_+%'-]*"
_LOCAL = r"[\p{L}\p{N}_][\p{L}\p{N}\p{M}_.+%'-]*"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
_AT_SIGNED = r"[ \t]*[\(\[\{<][ \t]*(?:at|ät|arroba|arobase|@)[ \t]*[\)\]\}>][ \t]*"
_AT_WORD = r"[ \t]+(?:at|arroba|arobase|ät)[ \t]+"
_DOT_WORD = r"(?:[ \t]*[\(\[\{<][ \t]*(?:dot|punkt|punto|point|\.)[ \t]*[\)\]\}>][ \t]*|[ \t]+(?:dot|punkt|punto|point)[ \t]+)"
_SPELT_LOCAL = rf"{_LOCAL}(?:{_DOT_WORD}{_WORD})*"

EMAIL = (
    rf"(?<![\p{{L}}\p{{N}}_.+%'-]){_LOCAL}@{_LABEL}(?:\.{_LABEL})*\.\p{{L}}{{2,}}",
    rf"(?<![\p{{L}}\p{{N}}_.+%'-]){_SPELT_LOCAL}{_AT_SIGNED}{_LABEL}(?:(?:{_DOT_WORD}|\.){_LABEL})*(?:{_DOT_WORD}|\.)\p{{L}}{{2,}}",
    rf"(?<![\p{{L}}\p{{N}}_.+%'-]){_SPELT_LOCAL}{_AT_WORD}{_LABEL}(?:(?:{_DOT_WORD}|\.){_LABEL})*{_DOT_WORD}\p{{L}}{{2,}}",
)

#: Words that make the number after them a ticket, run or shipment, not a person's.
_TICKET = r"(?<!\b(?i:batch|lot|run|shard|job|ticket|case|order|build|host|offset|lag)[ \t]{1,3})(?<!#)"
_EXT = r"(?:[ \t]{0,3}[,;]?[ \t]{0,3}(?:ext(?:ension)?\.?|x|poste|durchwahl|dw\.?)[ \t]{0,3}\d{1,6})?"
_BEFORE = r"(?=[+(\d])(?<![\p{L}\p{N}_#@+/-])(?<!\d[.,: ])" + _TICKET
_AFTER = r"(?![\p{L}\p{N}_@]|[.,:/-]\d)"
_GAP = r"[ \t.\-/]{1,3}"
PHONE = (
    rf"{_BEFORE}\+?1{_GAP}\(?\d{{3}}\)?{_GAP}\d{{3}}{_GAP}\d{{4}}{_EXT}{_AFTER}",
    rf"{_BEFORE}(?:\(\d{{3}}\)[ \t.\-]{{0,3}}|[2-9]\d{{2}}[ \t.\-]{{1,3}})\d{{3}}[ \t.\-]{{1,3}}\d{{4}}{_EXT}{_AFTER}",
    rf"{_BEFORE}(?:\+[1-9]\d{{0,2}}(?:{_GAP})?|00[1-9]\d{{0,2}}{_GAP})(?:\(0\)[ \t]{{0,3}})?\d{{1,5}}(?:(?:{_GAP})?\d{{2,8}}){{1,5}}{_EXT}{_AFTER}",
    rf"{_BEFORE}0\d{{1,4}}[ \t]{{0,2}}/[ \t]{{0,2}}\d{{3,8}}(?:-\d{{1,5}})?{_EXT}{_AFTER}",
    rf"{_BEFORE}0[1-9](?:[. \t-]{{1,3}}\d{{2}}){{4}}{_EXT}{_AFTER}",
    rf"{_BEFORE}\(?0\d{{2,4}}\)?[ \t]{{1,3}}\d{{3,4}}[ \t]{{1,3}}\d{{4}}{_EXT}{_AFTER}",
    rf"{_BEFORE}0\d{{1,3}}-\d{{2,4}}-\d{{4}}{_EXT}{_AFTER}",
)
#: Digits without any sign are a phone number behind a word that says so only.
PHONE_LABELLED = rf"(?i:(?<![\p{{L}}])(?:tel(?:ephone|efon|éfono)?|phone|mobile|cell|fax|fon|handy|móvil|tél(?:éphone)?|call(?:[ \t]+(?:me|us|him|her|them))?|ring|reach[ \t]+(?:me|us)|llam[ae]r?|appele[rz]|anrufen|電話)\.?(?:[ \t]+(?:at|on|under|unter|au|al|number|nummer|is|ist|me|us|no\.?)){{0,3}}[ \t]*[:=]?[ \t]*)(?P<phone>\+?\d{{7,15}}){_AFTER}"

_LABELLED = (
    r"(?:\b(?:id|ids?[ \t]+(?:card|number|no\.?)|user_id|social[ \t]+security[ \t]+number|ssn|tax[ \t]+(?:id|number|form)(?:[ \t]+\p{Ll}+)?|passport|national[ \t]+(?:id|insurance)(?:[ \t]+number)?"
    r"|steuernummer|steuer-?id|ausweis|personalausweis|reisepass|sozialversicherungsnummer|dni|nie|nif|documento|pasaporte|n[uú]mero[ \t]+de[ \t]+identidad|passeport|s[eé]curit[eé][ \t]+sociale|pi[eè]ce[ \t]+d'identit[eé])"
    r"(?:[ \t]+(?:is|ist|es|est|number|no\.?|nr\.?|n[º°]))?[ \t]*[:=(#]?[ \t]{0,3})"
)
_IB, _IA = r"(?=[\dA-Z])(?<![\p{L}\p{N}_@/.+-])", r"(?![\p{L}\p{N}_@]|[-/]\d|\.\d)"
ID_NUMBER = (
    rf"{_IB}{_TICKET}\d{{3}}-\d{{2}}-\d{{4}}{_IA}",
    rf"{_IB}{_TICKET}[A-Z]{{2}}[ \t]{{0,3}}\d{{2}}[ \t]{{0,3}}\d{{2}}[ \t]{{0,3}}\d{{2}}[ \t]{{0,3}}[A-D]{_IA}",
    rf"{_IB}{_TICKET}[12]{S}\d{{2}}{S}\d{{2}}{S}\d{{2}}{S}\d{{3}}{S}\d{{3}}(?:{S}\d{{2}})?{_IA}",
    rf"{_IB}{_TICKET}0\d{S}\d{{3}}{S}\d{{3}}{S}\d{{3}}{_IA}",
    rf"{_IB}{_TICKET}(?:\d{{8}}[A-Z]|[XYZ]\d{{7}}[A-Z]){_IA}",
    rf"{_IB}{_TICKET}[A-Z]{{2}}\d{{7}}{_IA}",
    rf"{_IB}{_TICKET}[A-Z]\d[A-Z\d]\d{{2}}[A-Z]\d{{3}}{_IA}",
)
#: Forms too plain to stand for an id number without its label.
ID_LABELLED = rf"(?i:{_LABELLED})(?P<id>(?:\d{{3}}{S}\d{{2}}{S}\d{{4}}|\d{{2}}{S}\d{{3}}{S}\d{{3}}{S}\d{{3}}|\d{{9}}|\d{{11}}|\d{{13}}|\d{{15}}|(?=[A-Z\d]*\d{{4}}|[A-Z\d]*\d[A-Z\d]*\d[A-Z\d]*\d[A-Z\d]*\d)[A-Z\d]{{8,10}})){_IA}"

# ---------------------------------------------------------------- addresses

_CAP = r"\p{Lu}[\p{L}\p{M}'-]+"
_ANY_TOWN = rf"{_CAP}(?:{S}(?:(?:an|am|im|de|del|la|der|sur|en|ob|bei)(?:{S}(?:der|la|los))?{S})?{_CAP}){{0,2}}"
_STOP = r"(?=[ \t]*(?:[.,;:!?)\n|/]|$))"
_CODE = r"(?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]?[ \t]{0,3}\d[A-Z]{2})(?![\p{L}\p{N}])"
_UNIT = rf"(?:(?:{BR}|{S})(?:(?i:apt|apartment|unit|suite|ste|flat|room)\.?{S}#?[\p{{L}}\p{{N}}-]{{1,5}}|\d{{1,3}}(?i:st|nd|rd|th){S}(?i:floor)|\#[ \t]?\d{{1,5}}[A-Z]?))"
_EN_TYPE = r"(?i:street|st|road|rd|avenue|ave|lane|ln|court|ct|boulevard|blvd|terrace|terr?|close|cl|drive|dr|way|place|pl|square|sq|row|crescent|cres|gardens|gdns|mews|walk|hill|parade|highway|hwy)"
_NO_ROAD = r"(?!(?i:of|the|and|or|in|on|at|for|to|by|from|main|park)(?![\p{L}]))"
_FR_TYPE = r"(?i:rue|avenue|av\.|bd|boulevard|chemin|impasse|place|quai|allée|cours|passage|route|square)"
_ES_TYPE = r"(?i:c/|calle|avda\.|avenida|av\.|plaza|pza\.|paseo|camino|ronda|carrer)"
_LINK = r"(?:(?:d[ue]s?|de[ \t]+las?|de[ \t]+los|del|la|las|los|le|l'|d'|de[ \t]+l'|y|et)[ \t']{0,3})"
_SUFFIX = r"(?i:weg|straße|strasse|str\.|gasse|allee|platz|ring|ufer|damm|steig|markt|hof|graben)"
_NO = r"\d{1,4}(?:[ \t]?[a-zA-Z](?![\p{L}\p{N}]))?"
_AB = r"(?<![\p{L}\p{N}_#@+./:-])"
def addresses(towns: tuple[str, ...] = ()) -> list[str]:
    """The grammars of street addresses. towns: those that are known for such even where nothing else tells it."""
    known = "(?i:" + "|".join(_spaced(t) for t in sorted(towns, key=len, reverse=True)) + ")" if towns else r"(?!)"
    town_tail = rf"(?:{BR}(?:(?:{known}|{_ANY_TOWN}),?{S}{_CODE}|{known}(?![\p{{L}}\p{{M}}])|{_ANY_TOWN}{_STOP}|{_CAP}(?={S}\p{{Ll}})))"
    code_town_tail = rf"(?:{BR}\d{{5}}(?:{S}(?:{known}|{_ANY_TOWN}{_STOP}|{_CAP}))?)"
    return [
        rf"{_AB}\d{{1,5}}[A-Z]?{S}(?:{_NO_ROAD}{_CAP}{S}){{1,3}}{_EN_TYPE}(?![\p{{L}}\p{{M}}])(?:\.(?=[ \t]*(?:[,#\n.]|{S}\p{{Ll}}|{S}\#|$|{S}\p{{Lu}})))?{_UNIT}?{town_tail}?",
        rf"{_AB}(?i:p\.?[ \t]?o\.?[ \t]?box|postfach|apartado(?:[ \t]+de[ \t]+correos)?|apdo\.|b\.?p\.?|boîte[ \t]+postale){S}\d{{1,6}}(?:{town_tail}|{code_town_tail})?",
        rf"{_AB}\d{{1,4}}(?:{S}(?i:bis|ter|quater))?,?{S}{_FR_TYPE}{S}(?:{_LINK}{{0,2}}{_CAP}[ \t]{{0,3}}){{1,3}}(?<=[\p{{L}}\p{{M}}]){code_town_tail}?",
        rf"(?<![\p{{L}}\p{{N}}_]){_ES_TYPE}[ \t]{{0,3}}(?:{_LINK}{{0,2}}{_CAP}[ \t]{{1,3}}){{1,4}}(?:n\.?[º°][ \t]?)?\d{{1,4}}(?:,{S}(?i:bajo|\d{{1,2}}\.?[ºª°](?:{S}(?:[A-Z](?![\p{{L}}])|izq\.?|dcha\.?|der\.?|centro))?))?{code_town_tail}?",
        rf"(?<![\p{{L}}\p{{N}}_-])(?:(?:{_CAP}{S}){{1,2}}{_SUFFIX}|(?:{_CAP}{S}){{0,2}}\p{{Lu}}[\p{{L}}\p{{M}}-]*{_SUFFIX}){S}{_NO}{code_town_tail}?",
        rf"(?<![\p{{L}}\p{{N}}_-])(?:(?i:am|zum|zur|im|in{S}der|an{S}der|auf{S}dem|unter{S}den){S}(?:{_CAP}{S}){{1,2}}|{_CAP}{S}){_NO}{code_town_tail}",
    ]


def _spaced(town: str) -> str:
    import regex

    return r"[ \t]+".join(regex.escape(w) for w in town.split())


#: A town beside a post code, as it ends an address.
_TOWN_OF = (rf"{BR}(?P<t>{_ANY_TOWN}),?{S}{_CODE}$", rf"{BR}\d{{5}}{S}(?P<t>{_ANY_TOWN})$")


# ---------------------------------------------------------------- finding

#: A day of birth, where `dates` asks for it.
DATE = r"(?i:(?:born(?:[ \t]+on)?|date[ \t]+of[ \t]+birth|dob|birth[ \t]*day|geboren(?:[ \t]+am)?|geb\.(?:[ \t]+am)?|geburtsdatum|née?[ \t]+le|date[ \t]+de[ \t]+naissance|nacid[oa][ \t]+el|fecha[ \t]+de[ \t]+nacimiento)[ \t]*[:=]?[ \t]*)(?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}([./-])\d{1,2}\2\d{4})(?!\d)"


class Finder:
    """Compiled rules and a model of names. One per Python worker; `spans` gives (start, end, kind) of a text, ordered,
    without overlaps."""

    def __init__(self, model: names.Model | None = None, dates: bool = False):
        import regex

        self.model = model or names.base_model()
        self.email = [regex.compile(p, regex.I) for p in EMAIL]
        self.phone = [regex.compile(p, regex.I) for p in PHONE]
        self.phone_labelled = regex.compile(PHONE_LABELLED)
        self.ids = [regex.compile(p) for p in ID_NUMBER]
        self.labelled = regex.compile(ID_LABELLED)
        self.digit = regex.compile(r"\d")
        self.code = regex.compile(r"\d{5}")
        self.address = [regex.compile(p) for p in addresses(self.model.towns)]
        self.date = regex.compile(DATE) if dates else None
        self.names = names.NameFinder(self.model)
        self.spelt = [regex.compile(_AT_SIGNED, regex.I), regex.compile(_DOT_WORD, regex.I)]

    def _candidates(self, t: str) -> Iterator[tuple[int, int, str]]:
        """By falling precedence."""
        for p, sign in zip(self.email, (None, *self.spelt), strict=True):
            if "@" in t if sign is None else sign.search(t):
                yield from ((*m.span(), "email") for m in p.finditer(t))
        if self.digit.search(t):
            if self.date:
                yield from ((*m.span("date"), "date") for m in self.date.finditer(t) if _day(m["date"]) is not None)
            for p in self.ids:
                yield from ((*m.span(), "id_number") for m in p.finditer(t))
            yield from ((*m.span("id"), "id_number") for m in self.labelled.finditer(t))
            for p in self.phone:
                yield from ((*m.span(), "phone") for m in p.finditer(t) if sum(c.isdigit() for c in m[0]) >= 9)
            yield from ((*m.span("phone"), "phone") for m in self.phone_labelled.finditer(t))
            yield from self._addresses(t)
        yield from ((a, b, "name") for a, b in self.names.spans(t))

    def _addresses(self, t: str) -> Iterator[tuple[int, int, str]]:
        coded = self.code.search(t) is not None
        for p in self.address if coded else self.address[:-1]:  # the last of them ends in a post code
            yield from ((*m.span(), "address") for m in p.finditer(t))

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        if not text:
            return []
        t, place = composed(text)
        taken: list[tuple[int, int, str]] = []
        for start, end, kind in self._candidates(t):
            if start < end and not any(a < end and start < b for a, b, _ in taken):
                taken.append((start, end, kind))
        if place:
            taken = [(place[a], place[b], k) for a, b, k in taken]
        return sorted(taken)


def _towns():
    """A reader of the towns that stand beside a post code in a text."""
    import regex

    patterns, ends = [regex.compile(p) for p in addresses()], [regex.compile(p) for p in _TOWN_OF]
    either = regex.compile(rf"\p{{Lu}}[\p{{L}}\p{{M}}'-]+,?{S}{_CODE}|[\n,][ \t>]*\d{{5}}{S}\p{{Lu}}")  # one of these stands in each of the ends

    def read(t: str) -> list[str]:
        if not either.search(t):
            return []
        spans = [t[slice(*m.span())] for p in patterns for m in p.finditer(t)]
        return [" ".join(m["t"].split()).lower() for x in spans for p in ends if (m := p.search(x))]

    return read


def _form(text: str) -> str:
    return composed(text)[0]


def fit(documents: DataFrame, text: str = "text") -> names.Model:
    """A model of the corpus: names and towns, from every text of it that isn't empty, each distinct one once."""
    return fitting.fit(documents.select(F.col(f"`{text}`").alias("t")), _form, _towns)


# ---------------------------------------------------------------- pseudonyms


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "/".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def feistel(value: list[int], radix: int, key: bytes, tweak: str = "", rounds: int = 10) -> list[int]:
    """A keyed permutation of all sequences of this length over 0..radix-1: alternating Feistel rounds over two halves."""
    n = len(value)
    if n < 2:
        shift = _prf(key, tweak, n, radix)
        return [(x + shift) % radix for x in value]
    u = n // 2
    to_int = lambda xs: sum(x * radix**i for i, x in enumerate(reversed(xs)))
    a, b = to_int(value[:u]), to_int(value[u:])
    for r in range(rounds):
        m = radix ** (u if r % 2 == 0 else n - u)
        a, b = b, (a + _prf(key, tweak, n, radix, r, b)) % m
    def digits(x: int, k: int) -> list[int]:
        return [x // radix**i % radix for i in reversed(range(k))]
    return digits(a, u) + digits(b, n - u) if rounds % 2 == 0 else digits(a, n - u) + digits(b, u)


def unfeistel(value: list[int], radix: int, key: bytes, tweak: str = "", rounds: int = 10) -> list[int]:
    """The inverse of feistel (for an even number of rounds)."""
    n = len(value)
    if n < 2:
        shift = _prf(key, tweak, n, radix)
        return [(x - shift) % radix for x in value]
    u = n // 2
    to_int = lambda xs: sum(x * radix**i for i, x in enumerate(reversed(xs)))
    a, b = to_int(value[:u]), to_int(value[u:])
    for r in reversed(range(rounds)):
        m = radix ** (u if r % 2 == 0 else n - u)
        a, b = (b - _prf(key, tweak, n, radix, r, a)) % m, a
    def digits(x: int, k: int) -> list[int]:
        return [x // radix**i % radix for i in reversed(range(k))]
    return digits(a, u) + digits(b, n - u)


def _walk(value: list[int], radix: int, key: bytes, tweak: str, back: bool, same) -> list[int]:
    """The permutation walked on to the next value of the same class: one to one within each class. No class may be rare
    (the least here is a fortieth of all values), as the walk takes as many steps as it is rare."""
    move = unfeistel if back else feistel
    want, out = same(value), move(value, radix, key, tweak)
    while same(out) != want:
        out = move(out, radix, key, tweak)
    return out


#: Country codes of one and two digits; all others have three. Fixed values.
_COUNTRY = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _national(shown: str) -> tuple[int, int]:
    """Which of the digits of a phone number are its national ones: from, to."""
    import re

    digits = re.sub(r"\D", "", shown)
    extension = re.search(r"(?:ext(?:ension)?\.?|x|poste|durchwahl|dw\.?)\s*(\d{1,6})$", shown, re.I)
    end = len(digits) - (len(extension[1]) if extension else 0)
    if shown.lstrip().startswith(("+", "00")):
        at = 0 if shown.lstrip()[0] == "+" else 2
        at += next((n for n in (1, 2) if digits[at : at + n] in _COUNTRY), 3)
        if re.search(r"\(0\)", shown):
            at += 1
    elif digits[:1] == "1" and end == 11:
        at = 1
    else:
        at = 1 if digits[:1] == "0" else 0
    return (at, end) if end - at >= 4 else (0, end)


def _phone_class(d: list[int]) -> tuple:
    return d[0] > 0, len(d) == 10 and d[0] > 1 and d[3] > 1


_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def _tax_check(d: list[int]) -> int:
    """The check digit of a German tax number (ISO 7064, mod 11, 10)."""
    p = 10
    for x in d:
        p = ((x + p) % 10 or 10) * 2 % 11
    return (11 - p) % 10


def _social_class(d: list[int]) -> bool:
    area = d[0] * 100 + d[1] * 10 + d[2]
    return area not in (0, 666) and area < 900 and d[3] + d[4] > 0 and sum(d[5:]) > 0


def _moved_id(d: list[int], letters: list[int], form: str, key: bytes, back: bool) -> tuple[list[int], list[int]]:
    """Digits and letters of an id number moved. form: 9 for a digit, A for a letter, in order."""
    number = int("".join(map(str, d)) or "0")
    spanish = form in ("99999999A", "A9999999A") and (form[0] == "9" or letters[0] in (23, 24, 25))
    if spanish:
        lead = (letters[0] - 23) * 10**7 if form[0] == "A" else 0
        if _DNI[(lead + number) % 23] == chr(65 + letters[-1]):
            d = _walk(d, 10, key, "dni" + form[0] + str(lead), back, lambda x: True)
            return d, [*letters[:-1], ord(_DNI[(lead + int("".join(map(str, d)))) % 23]) - 65]
    if form == "9" * 15 and number % 100 == 97 - number // 100 % 97:
        d = _walk(d[:13], 10, key, "nir", back, lambda x: (x[0] in (1, 2), 1 <= x[3] * 10 + x[4] <= 12))
        return [*d, *divmod(97 - int("".join(map(str, d))) % 97, 10)], []
    if form == "9" * 11 and d[0] and _tax_check(d[:10]) == d[10]:
        d = _walk(d[:10], 10, key, "tax", back, lambda x: x[0] > 0)
        return [*d, _tax_check(d)], []
    insurance = form == "AA999999A" and letters[2] < 4
    then = _walk(d, 10, key, "id_number" + form, back, _social_class if form == "9" * 9 else lambda x: True) if d else d
    # Letters are moved by a key that depends on the digits of the pseudonym, which both directions know.
    tweak = "letters" + form + "".join(map(str, d if back else then))
    if insurance:
        bad = lambda x: (x[0] in (3, 5, 8, 16, 20, 21), x[1] in (3, 5, 8, 14, 16, 20, 21))
        return then, [*_walk(letters[:2], 26, key, tweak, back, bad), *_walk(letters[2:], 4, key, tweak, back, lambda x: True)]
    return then, _walk(letters, 26, key, tweak, back, lambda x: True) if letters else []


def permuted(value: str, key: bytes, tweak: str, back: bool = False) -> str:
    """A phone number or id number (tweak: its kind) moved within its format and class; back turns it back.

    Digits of any script and letters of full width count by their value and come back in their own form, so that a
    number moves alike however it is written.
    """
    digits = [(i, ord(c) - unicodedata.decimal(c)) for i, c in enumerate(value) if c.isdecimal()]
    d = [ord(value[i]) - low for i, low in digits]
    letters = [(i, ord(a)) for i, c in enumerate(value) for a in ("A", "\uff21") if a <= c <= chr(ord(a) + 25)] if tweak != "phone" else []
    moved_letters: list[int] = []
    if tweak == "phone":
        shown = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in value.translate(_SIGNS))
        a, b = _national(shown)
        moved = [*d[:a], *_walk(d[a:b], 10, key, "phone", back, _phone_class), *d[b:]] if b > a else d
    else:
        form = "".join("9" if c.isdecimal() else "A" for i, c in enumerate(value) if c.isdecimal() or any(i == at for at, _ in letters))
        moved, moved_letters = _moved_id(d, [ord(value[i]) - low for i, low in letters], form, key, back)
    out = list(value)
    for (i, low), x in [*zip(digits, moved, strict=True), *zip(letters, moved_letters, strict=True)]:
        out[i] = chr(low + x)
    return "".join(out)


#: The days that dates of birth are moved among.
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _day(written: str) -> tuple[int, str] | None:
    """(day, format) of a date that exists; day first where the year stands last."""
    sign = next(c for c in written if not c.isdigit())
    parts = [int(x) for x in written.split(sign)]
    year_first = parts[0] > 31
    try:
        day = datetime.date(*parts if year_first else reversed(parts)).toordinal()
    except ValueError:
        return None
    return (day, f"%Y{sign}%m{sign}%d" if year_first else f"%d{sign}%m{sign}%Y") if _FIRST_DAY <= day <= _LAST_DAY else None


def moved_date(written: str, key: bytes, back: bool = False) -> str:
    """A date moved to another day of the two centuries, in its own format."""
    day, form = _day(written)
    bits = [day - _FIRST_DAY >> i & 1 for i in reversed(range(17))]
    whole = lambda x: sum(b << i for i, b in enumerate(reversed(x))) <= _LAST_DAY - _FIRST_DAY
    moved = _walk(bits, 2, key, "date", back, whole)
    return datetime.date.fromordinal(_FIRST_DAY + sum(b << i for i, b in enumerate(reversed(moved)))).strftime(form)


def placeholder(kind: str, value: str, key: bytes) -> str:
    """[KIND:...]: the permuted number or date, or a tag of 128 bits that is equal for equal values."""
    if kind in ("phone", "id_number"):
        return f"[{kind.upper()}:{permuted(value, key, kind)}]"
    if kind == "date":
        return f"[DATE:{moved_date(value, key)}]"
    same = " ".join(value.translate(_SIGNS).lower().split())
    return f"[{kind.upper()}:{_prf(key, kind, same) >> 128:032x}]"


def turned_back(text_out: str, spans: list, key: bytes, values: list[str] | None = None) -> str:
    """The text that placeholders stand in, turned back: numbers and dates by the key alone, tags by the values that the
    spans held (without them tags stay). spans: kind, start_char, end_char of the text as it was."""
    parts, at, done = [], 0, 0
    for i, (kind, start, end) in enumerate(spans):
        rest = start - done
        head = f"[{kind.upper()}:"
        stop = text_out.index("]", at + rest + len(head))
        parts.append(text_out[at : at + rest])
        body = text_out[at + rest + len(head) : stop]
        if kind in ("phone", "id_number"):
            parts.append(permuted(body, key, kind, back=True))
        elif kind == "date":
            parts.append(moved_date(body, key, back=True))
        else:
            parts.append(text_out[at + rest : stop + 1] if values is None else values[i])
        at, done = stop + 1, end
    return "".join([*parts, text_out[at:]])


SPANS = "array<struct<kind:string,start_char:bigint,end_char:bigint>>"


def pseudonymise(documents: DataFrame, key: str, text: str = "text", model: names.Model | None = None, into: str = "text_out", spans: str = "spans", dates: bool = False) -> DataFrame:
    """The documents with two columns more: the text with typed placeholders, and the spans that they stand for.

    key: the secret of the pseudonyms; there is no default. model: of `fit`; without one, that of the labelled sentences.
    """
    if not key:
        raise ValueError("pseudonyms need a key")

    def run(finder: Finder, texts) -> tuple[list, list]:
        secret, outs, found_ = key.encode(), [], []
        for t in texts:
            here = finder.spans(t)
            found_.append([{"kind": k, "start_char": a, "end_char": b} for a, b, k in here])
            if t is None:
                outs.append(None)
                continue
            parts, at = [], 0
            for a, b, k in here:
                parts += [t[at:a], placeholder(k, t[a:b], secret)]
                at = b
            outs.append("".join([*parts, t[at:]]))
        return outs, found_

    out = _applied(documents, text, f"o string, s {SPANS}", model, dates, lambda f, x: dict(zip("os", run(f, x), strict=True)))
    return out.select(*[F.col(f"`{c}`") for c in documents.columns], F.col("__pii.o").alias(into), F.col("__pii.s").alias(spans))


def _applied(documents: DataFrame, text: str, schema: str, model: names.Model | None, dates: bool, run) -> DataFrame:
    """documents with a struct __pii that run(finder, texts) gives, a list for each field."""
    import pandas as pd

    # A model grows with the vocabulary of its corpus; it is sent to each executor once.
    sent = documents.sparkSession.sparkContext.broadcast(model) if model is not None else None

    def typed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        finder = Finder(sent.value if sent is not None else None, dates)
        for texts in batches:
            yield pd.DataFrame(run(finder, texts))

    typed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # Not deterministic for the optimizer, which else evaluates it a second time in a filter inferred from explode.
    return documents.withColumn("__pii", F.pandas_udf(typed, schema).asNondeterministic()(F.col(f"`{text}`")))


def found(documents: DataFrame, id_column: str = "doc_id", text: str = "text", model: names.Model | None = None, dates: bool = False) -> DataFrame:
    """id, kind, start_char, end_char: one row per span."""
    listed = lambda f, x: {"s": [[{"kind": k, "start_char": a, "end_char": b} for a, b, k in f.spans(t)] for t in x]}
    spans = _applied(documents.select(id_column, text), text, f"s {SPANS}", model, dates, listed).select(id_column, F.explode("__pii.s").alias("s"))
    return spans.select(id_column, "s.kind", "s.start_char", "s.end_char")


def tags(replaced: DataFrame, key: str, text: str = "text", spans: str = "spans") -> DataFrame:
    """tag, kind, value, n: what each tag of names and addresses stands for, in each of its spellings.

    The table that, beside the key, turns pseudonyms back; it is to be kept as the key is.
    """
    import pandas as pd

    def tagged(kinds: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([placeholder(k, v, key.encode())[len(k) + 2 : -1] for k, v in zip(kinds, values, strict=True)])

    tagged.__annotations__ = {"kinds": pd.Series, "values": pd.Series, "return": pd.Series}
    here = replaced.select(text, F.explode(spans).alias("s")).where(F.col("s.kind").isin("email", "address", "name"))
    value = F.substring(F.col(text), (F.col("s.start_char") + 1).cast("int"), (F.col("s.end_char") - F.col("s.start_char")).cast("int"))
    counted = here.select(F.col("s.kind").alias("kind"), value.alias("value")).groupBy("kind", "value").agg(F.count("*").alias("n"))
    return counted.select(F.pandas_udf(tagged, "string")("kind", "value").alias("tag"), "kind", "value", "n")


def restored(replaced: DataFrame, key: str, id_column: str = "doc_id", text: str = "text", text_out: str = "text_out", spans: str = "spans") -> DataFrame:
    """id, text: what pseudonymise gave, turned back from its placeholders, each text's own tags by its own values."""
    import pandas as pd

    def back(outs: pd.Series, found_: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else turned_back(o, [(s["kind"], s["start_char"], s["end_char"]) for s in f], key.encode(), v) for o, f, v in zip(outs, found_, values, strict=True)])

    back.__annotations__ = {"outs": pd.Series, "found_": pd.Series, "values": pd.Series, "return": pd.Series}
    values = F.transform(spans, lambda s: F.substr(F.col(text), (s["start_char"] + 1).cast("int"), (s["end_char"] - s["start_char"]).cast("int")))
    return replaced.select(id_column, F.pandas_udf(back, "string")(F.col(text_out), F.col(spans), values).alias(text))
