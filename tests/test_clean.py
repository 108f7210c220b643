from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terracota.functions import clean
from terracota.functions.address import split_address, split_address_typed, without_kind


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["v"] for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "f, cases",
    [
        (clean.area, {"62 m²": 62.0, "1.200 m²": 1200.0, "62.5 m²": 62.5, "62,5 m²": 62.5, "50-70 m²": None, None: None}),  # dots of thousands are dropped, unlike in the notebooks
        (clean.money, {"R$ 450.000": 450000.0, "R$ 450.000": 450000.0, "R$ 1.234,56": None, "N/A": None, "a partir de R$ 2": None, None: None}),
        (clean.count, {" 3 ": 3, "3-4": None, "": None, None: None}),
        (clean.condo_fee, {"R$ 1.200/mês": 1200.0, "Isento": 0.0, "Não informado": None, None: 0.0, "N/A": 0.0}),
        (clean.property_tax, {"R$ 1.200": 1200.0, "isento": None, "Não informado": None, None: None}),
        (clean.fee_status, {"R$ 1": "informed", "Isento": "exempt", "não informado": "not_informed", None: "absent", "N/A": "absent"}),
        (clean.publish_date, {"Anúncio criado em 21 de junho de 2025, atualizado há 12 horas.": date(2025, 6, 21), "Anúncio criado em 01 de março de 2024": date(2024, 3, 1), "ontem": None, None: None}),
        (clean.publish_date_text, {"Anúncio criado em 21 de junho de 2025, x": "21/06/2025"}),
        (clean.safe_text, {"": None, "  \n": "", " a ": "a", None: None}),
        (clean.fold, {"Marília São ñ 日": "Marilia Sao n ", None: None}),
        (without_kind, {"Rua da Rua Velha": "da", "Avenida X": "x", "Grua Z": "z", "Travessa Y": "travessa y"}),
    ],
)
def test_scalars(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_addresses(spark):
    cases = {
        "Rua Nova Cruz, 236 - Parque Penha, São Paulo - SP": ("Rua Nova Cruz", "236", "Parque Penha", "São Paulo", "SP"),
        "Anita Garibaldi, Joinville - SC": ("s/r", "s/n", "Anita Garibaldi", "Joinville", "SC"),
        "Rua A, Bloco 2, 10 - Centro, Joinville - SC": ("Rua A, Bloco 2", "10", "Centro", "Joinville", "SC"),
        "Rua A, 10, Joinville": ("Rua A", "10", "s/b", "Joinville", "s/e"),
        "Joinville - SC": ("s/r", "s/n", "s/b", "Joinville", "SC"),
        None: ("s/r", "s/n", "s/b", "s/c", "s/e"),
    }
    assert [tuple(v) for v in values(spark, split_address, list(cases))] == list(cases.values())
    old = {"Rua X, 351 - Boa Vista, Marília - SP": ("x", "boa vista", "marilia", "SP"), "Avenida X - Butantã, São Paulo - sp": ("x", "butanta", "sao paulo", "SP"), "Joinville": ("joinville", "", "joinville", ""), None: ("", "", "", "")}
    assert [tuple(v) for v in values(spark, split_address_typed, list(old))] == list(old.values())


def test_photos(spark):
    df = spark.createDataFrame([(["https://i/a.webp 360w, https://i/b.webp 1080w", "", " "],), ([],), (None,)], "s array<string>")
    assert [r[0] for r in df.select(clean.photos("s")).collect()] == [["https://i/b.webp"], [], None]
    assert [r[0] for r in df.select(clean.photos("s", clean.first_photo)).collect()] == [["https://i/a.webp"], [], None]
    assert [r[0] for r in df.select(clean.photo_count("s")).collect()] == [3, 0, 0]


word = st.text("abcdefgh áéãç", min_size=1, max_size=8).map(str.strip).filter(bool)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(word, st.integers(1, 9999), word, word, st.integers(0, 10**9), st.dates(date(1990, 1, 1), date(2040, 1, 1))), min_size=1, max_size=30))
def test_round_trips(spark, rows):
    texts = [f"Rua {a}, {n} - {b}, {c} - SC" for a, n, b, c, _, _ in rows]
    assert [tuple(v) for v in values(spark, split_address, texts)] == [(f"Rua {a}", str(n), b, c, "SC") for a, n, b, c, _, _ in rows]
    assert values(spark, clean.money, [f"R$ {p:,}".replace(",", ".") for *_, p, _ in rows]) == [float(p) for *_, p, _ in rows]
    months = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()
    assert values(spark, clean.publish_date, [f"Anúncio criado em {d.day} de {months[d.month - 1]} de {d.year}, x" for *_, d in rows]) == [d for *_, d in rows]
