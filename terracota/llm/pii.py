"""Personal data: patterns propose spans, checksums confirm them, context words move their scores.

E-mail addresses, IP addresses, card and phone numbers are kept as they match and check (parts at most 255, Luhn, digit counts).
The method's own kinds are IBANs that pass mod 97, national numbers of the form 3-2-4 digits, and national numbers with check digits: Spanish
identity numbers (a letter by mod 23), French social security numbers (mod 97), German tax numbers (mod 11, 10) and Brazilian taxpayer
numbers (two digits by mod 11); they are kept from a
score of KEEP. A whole word of the kind's context, in English, German, French or Spanish (for Brazil Portuguese), within NEAR characters before or after the span
adds to its score, so a 3-2-4 number alone is no finding, and one beside "ssn" is. Spans don't overlap within a kind. Offsets are code
points, ends exclusive.

Cases: null and empty texts have no findings and a score of 0; every pattern is linear in the text, however long, as none can begin
again inside a run that it has read, but for IBANs, of at most 34 characters and blanks between; findings that tie in their start come
in the order of KINDS; rows that repeat are answered row by row; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracota.llm.common import by_text

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by country, of the registry. Fixed values.
LENGTHS = {c: int(g[:2]) for g in "15 NO;16 BE;18 DK FI FK FO GL NL SD;19 MK SI;20 AT BA EE KZ LT LU MN XK;21 CH HR LI LV;22 BG BH CR DE GB GE IE ME RS VA;23 AE GI IL IQ OM SO TL;24 AD CZ ES MD PK RO SA SE SK TN VG;25 LY PT ST;26 IS TR;27 BI DJ FR GR IT MC MR SM;28 AL AZ BY CY DO GT HN HU LB NI PL SV;29 BR EG PS QA UA;30 JO KW MU YE;31 MT SC;32 LC;33 RU".split(";") for c in g[3:].split()}
EXACT = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(LENGTHS.values())}
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IDENTITY = re.compile(r"(?<![A-Za-z0-9])(?:[0-9]{8}|[XYZ][0-9]{7})-?[A-Z](?![A-Za-z0-9])")
SECURITY = re.compile(r"(?<![0-9])[12](?:\x20?[0-9]{2}){3}(?:\x20?[0-9]{3}){2}\x20?[0-9]{2}(?![0-9])")
TAX = re.compile(r"(?<![0-9.,+-])[1-9][0-9](?:\x20?[0-9]{3}){3}(?![0-9]|[.,-][0-9])")
TAXPAYER = re.compile(r"(?<![0-9.-])[0-9]{3}[.][0-9]{3}[.][0-9]{3}-[0-9]{2}(?![0-9-])")
DIGIT, WORD = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]+")
#: Check letters of Spanish identity numbers, in order. Fixed values.
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Score before context, and the context words, of each kind; base kinds in the contract's order. Fixed values.
KINDS = {
    "email": (0.8, "mail email contact write address kontakt schreiben adresse courriel contacter écrire adresse correo contacto escribir dirección"),
    "ip": (0.5, "ip address host server adresse rechner serveur adresse hôte dirección servidor"),
    "card": (0.7, "card visa mastercard credit debit payment karte kreditkarte zahlung carte crédit paiement bancaire tarjeta crédito credito pago"),
    "phone": (0.6, "phone telephone call tel mobile cell fax telefon telefonnummer anrufen handy mobil rufnummer téléphone appeler portable teléfono telefono llamar móvil movil"),
    "iban": (0.8, "iban account bank konto kontonummer bankverbindung compte banque bancaire cuenta banco"),
    "national": (0.3, "ssn social security national"),
    "identity": (0.6, "dni nie nif identity id identidad documento ausweis identité identification"),
    "security": (0.7, "nir insee sécurité securite sociale social security sozialversicherung seguridad"),
    "tax": (0.3, "tax tin steuer steuernummer steuerid idnr identifikationsnummer fiscal fiscale impôts impuestos"),
    "taxpayer": (0.7, "cpf contribuinte taxpayer cadastro"),
}
KINDS = {k: (score, frozenset(ws.split())) for k, (score, ws) in KINDS.items()}
BASE, KEEP, BONUS, NEAR = ("email", "ip", "card", "phone"), 0.5, 0.3, 40


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def mod97(iban: str) -> bool:
    iban = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def identity_letter(number: str) -> bool:
    number = number.replace("-", "")
    return CHECK_LETTERS[int(number[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == number[-1]


def security_key(number: str) -> bool:
    number = number.replace(" ", "")
    return 97 - int(number[:13]) % 97 == int(number[13:])


def mod11_10(digits: str) -> bool:
    """The last digit checks the others, by the hybrid system of modulus 11 and 10."""
    p = 10
    for d in digits[:-1]:
        p = (p + int(d)) % 10 or 10
        p = 2 * p % 11
    return (11 - p) % 10 == int(digits[-1])


def two_digits(number: str) -> bool:
    """The last two digits each check all before them, by mod 11; numbers of one digit are none."""
    d = [int(c) for c in number if c.isdigit()]
    check = lambda n: sum((n + 1 - i) * d[i] for i in range(n)) * 10 % 11 % 10
    return len(set(d)) > 1 and check(9) == d[9] and check(10) == d[10]


def _emails(t: str) -> Iterator[tuple[int, int]]:
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(t, at + 1)):
            done = m.end()
            yield start, done
        at = t.find("@", at + 1)


def _ibans(t: str) -> Iterator[tuple[int, int]]:
    """IBANs of their country's length; of other countries, or if that fails, all that looks like one. After no finding the next character is tried."""
    at = 0
    while m := IBAN.search(t, at):
        options = (EXACT[LENGTHS[m[0][:2]]].match(t, m.start()) if m[0][:2] in LENGTHS else None, m)
        own = next((o for o in options if o and mod97(o[0])), None)
        at = own.end() if own else m.start() + 1
        if own:
            yield own.span()


def _kinds(t: str) -> Iterator[tuple[str, int, int]]:
    for s, e in _emails(t):
        yield "email", s, e
    if not DIGIT.search(t):
        return
    for m in IP.finditer(t):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(t):
        if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield "card", *m.span()
    for m in PHONE.finditer(t) if "+" in t else ():
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield "phone", *m.span()
    for s, e in _ibans(t):
        yield "iban", s, e
    for kind, pattern, valid in (("national", NATIONAL, None), ("identity", IDENTITY, identity_letter), ("security", SECURITY, security_key), ("tax", TAX, lambda n: mod11_10(n.replace(" ", ""))), ("taxpayer", TAXPAYER, two_digits)):
        for m in pattern.finditer(t):
            if valid is None or valid(m[0]):
                yield kind, *m.span()


def beside(t: str, s: int, e: int) -> set[str]:
    """Whole words, in lower case, within NEAR characters before s or after e."""
    a, b = max(0, s - NEAR), min(len(t), e + NEAR)
    before, after = WORD.finditer(t[a:s].lower()), WORD.finditer(t[e:b].lower())
    cut_a, cut_b = a > 0 and t[a - 1].isalnum(), b < len(t) and t[b].isalnum()
    size = b - e
    return {m[0] for m in before if m.start() or not cut_a} | {m[0] for m in after if m.end() < size or not cut_b}


def find(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of each finding, by start, then kind in the order of KINDS."""
    out = []
    for kind, s, e in _kinds(text or ""):
        score, words = KINDS[kind]
        score = min(1.0, score + BONUS * (not words.isdisjoint(beside(text, s, e))))
        if kind in BASE or score >= KEEP:
            out.append((s, e, kind, score))
    order = list(KINDS)
    return sorted(out, key=lambda x: (x[0], order.index(x[2])))


def spans(docs: DataFrame, text_col: str = "text") -> Column:
    """Array of (start, end, kind, score) as a column."""
    schema = "spans array<struct<start:int,end:int,kind:string,score:double>>"
    make = lambda: lambda texts: {"spans": [[{"start": s, "end": e, "kind": k, "score": x} for s, e, k, x in find(t)] for t in texts]}
    return by_text(docs.sparkSession, make, schema)(F.col(text_col))["spans"]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, max_score) for each row."""

    def work(texts):
        found = [find(t) for t in texts]
        digest = lambda own: ",".join(f"{k}:{s}:{e}" for s, e, k, _ in own)
        out = {f"n_{k}": [sum(x[2] == k for x in own) for own in found] for k in BASE}
        out["base_sha256"] = [hashlib.sha256(digest([x for x in own if x[2] in BASE]).encode()).hexdigest() for own in found]
        return out | {"spans": list(map(digest, found)), "max_score": [max((x[3] for x in own), default=0.0) for own in found]}

    run = by_text(docs.sparkSession, lambda: work, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, max_score double")
    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("r")).select("doc_id", "r.*")
