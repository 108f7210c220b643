"""Advert text to typed values, as column expressions. Nothing raises: text that doesn't parse gives null."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters outside ASCII that decompose to one ASCII letter and marks, and those letters.
_FOLDED = {c: a for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) <= 0xDFFF and len(a := unicodedata.normalize("NFD", c).encode("ascii", "ignore").decode()) == 1}
_FROM, _TO = "".join(_FOLDED), "".join(_FOLDED.values())
NOT_FOUND, EXEMPT, NOT_INFORMED = "n/a", "isento", "não informado"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without Unicode blanks at both ends, control characters that part texts among them."""
    return F.regexp_replace(_col(c), r"^[\s\p{Z}\x1C-\x1F\x85]+|[\s\p{Z}\x1C-\x1F\x85]+$", "")


def safe_text(c: Column | str) -> Column:
    """Stripped text; the empty text is null, while blanks alone strip to the empty text."""
    return F.when(_col(c) != "", strip(c))


def safe_list(c: Column | str) -> Column:
    """Stripped texts without blank ones, in order; null gives an empty list."""
    return F.coalesce(F.filter(F.transform(_col(c), strip), lambda x: x != ""), F.array().cast("array<string>"))


def area(c: Column | str) -> Column:
    """"1.200,5 m²" -> 1200.5: a dot before a group of three digits separates thousands, a comma decimals."""
    number = F.regexp_replace(F.replace(strip(c), F.lit("m²"), F.lit("")), r"\.(?=\d{3}(\D|$))", "")
    return strip(F.translate(number, ",", ".")).try_cast("double")


def count(c: Column | str) -> Column:
    return strip(c).try_cast("int")


def money(c: Column | str) -> Column:
    """"R$ 450.000" -> 450000.0; a decimal comma or other words give null."""
    return F.regexp_replace(_col(c), r"[R$.\s\p{Z}]", "").try_cast("double")


def fee_status(c: Column | str) -> Column:
    """informed, exempt, not_informed or absent."""
    text = F.lower(strip(c))
    return F.when(text.isNull() | (text == NOT_FOUND) | (text == ""), "absent").when(text == EXEMPT, "exempt").when(text == NOT_INFORMED, "not_informed").otherwise("informed")


def _fee(c: Column | str) -> Column:
    return money(F.replace(_col(c), F.lit("/mês"), F.lit("")))


def condo_fee(c: Column | str) -> Column:
    """Monthly fee; exempt and absent count as 0, not informed is null."""
    status = fee_status(c)
    return F.when(status.isin("absent", "exempt"), 0.0).when(status == "informed", _fee(c))


def property_tax(c: Column | str) -> Column:
    """Yearly tax, null unless informed."""
    return F.when(fee_status(c) == "informed", _fee(c))


def publish_date(c: Column | str) -> Column:
    """"Anúncio criado em 21 de junho de 2025, atualizado há 12 horas." -> 2025-06-21."""
    core = strip(F.regexp_replace(F.get(F.split(_col(c), ","), F.lit(0)), "Anúncio criado em", ""))
    return F.from_csv(core, "d date", {"dateFormat": "d 'de' MMMM 'de' yyyy", "locale": "pt-BR"})["d"]


def publish_date_text(c: Column | str) -> Column:
    return F.date_format(publish_date(c), "dd/MM/yyyy")


def fold(c: Column | str) -> Column:
    """Letters without accents; what is left outside ASCII is dropped."""
    return F.regexp_replace(F.translate(_col(c), _FROM, _TO), r"[^\x00-\x7F]", "")


def best_photo(srcset: Column) -> Column:
    """Address of a srcset's last candidate, which is the largest."""
    return F.get(F.split(strip(F.element_at(F.split(srcset, ","), -1)), r"\s+"), F.lit(0))


def first_photo(srcset: Column) -> Column:
    return F.get(F.split(strip(srcset), r"[\s,]+"), F.lit(0))


def photos(srcsets: Column | str, pick=best_photo) -> Column:
    """An address for each srcset that isn't empty."""
    return F.transform(F.filter(_col(srcsets), lambda s: strip(s) != ""), pick)


def photo_count(c: Column | str) -> Column:
    return F.size(F.coalesce(_col(c), F.array().cast("array<string>")))
