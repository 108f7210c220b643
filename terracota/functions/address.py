"""Addresses into street, number, district, city and state, as column expressions.

`split_address` is the current rule, `split_address_typed` the older one. They differ where an address has two parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terracota.functions.clean import _col, fold, strip

PARTS = ("rua", "numero", "bairro", "cidade", "estado")
#: Values for what an address lacks. Fixed values.
DEFAULTS = {"rua": "s/r", "numero": "s/n", "bairro": "s/b", "cidade": "s/c", "estado": "s/e"}
#: Street kinds in the order in which they are looked for. Fixed values.
KINDS = ("rua ", "avenida ", "estrada ")


def _piece(c: Column, i: int) -> Column:
    return strip(F.get(c, F.lit(i)))


def split_address(endereco: Column | str) -> Column:
    """Struct of PARTS; text missing from the address has its default. One part is city and state alone."""
    parts = F.split(_col(endereco), ",")
    n = F.size(parts)
    place = F.split(strip(F.element_at(parts, -1)), " - ")
    middle = F.split(strip(F.get(parts, n - 2)), " - ")
    street = F.array_join(F.transform(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), strip), ", ")
    missing = _col(endereco).isNull()
    value = {
        "rua": F.when(n > 2, street),
        "numero": F.when(n > 2, _piece(middle, 0)),
        "bairro": F.when(n == 2, _piece(parts, 0)).when(n > 2, _piece(middle, 1)),
        "cidade": _piece(place, 0),
        "estado": _piece(place, 1),
    }
    return F.struct(*(F.when(missing, DEFAULTS[k]).otherwise(F.coalesce(v, F.lit(DEFAULTS[k]))).alias(k) for k, v in value.items()))


def without_kind(rua: Column | str) -> Column:
    """Lower-case street name after the first kind found, up to a second occurrence of it."""
    low = F.lower(_col(rua))
    out = low
    for kind in reversed(KINDS):
        out = F.when(low.contains(kind), strip(F.get(F.split(low, kind), F.lit(1)))).otherwise(out)
    return out


def split_address_typed(endereco: Column | str) -> Column:
    """Struct (rua, bairro, cidade, estado), folded; a null address gives empty texts."""
    parts = F.split(_col(endereco), ",")
    n, first = F.size(parts), strip(F.get(F.split(_col(endereco), ","), F.lit(0)))
    second = strip(F.get(parts, F.lit(1)))
    last = lambda c: F.when(c.contains(" - "), strip(F.element_at(F.split(c, " - "), -1)))
    rua = F.when(n == 2, _piece(F.split(first, " - "), 0)).otherwise(first)
    bairro = F.when(n == 3, F.coalesce(last(second), second)).when(n == 2, F.coalesce(last(first), F.lit(""))).otherwise("")
    place = F.split(strip(F.element_at(parts, -1)), " - ")
    values = {"rua": fold(without_kind(rua)), "bairro": F.lower(fold(bairro)), "cidade": fold(F.lower(_piece(place, 0))), "estado": fold(F.upper(F.coalesce(_piece(place, 1), F.lit(""))))}
    return F.struct(*(F.coalesce(F.when(_col(endereco).isNotNull(), v), F.lit("")).alias(k) for k, v in values.items()))
