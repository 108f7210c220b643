import json

import pytest
from conftest import SF
from pyspark.sql import functions as F

from terracota import queries
from terracota.functions import clean
from terracota.operators import profile
from terracota.operators.html import CARD_LINKS, FIELDS, OLD_FIELDS, Page, Reader, Rule, characteristics, extract_listings
from terracota.plans import collect
from terracota.schema import RAW, RAW_COLUMNS
from terracota.sources import shared, snapshots
from terracota.streaming.pages import page_stream, write_listings

ADVERT = '<h2 class="text-neutral-130 line-clamp-2"> Casa </h2><div data-testid="condoFee">  <br></div><div class="value-item">IPTU<p class="value-item__value">R$ 1</p></div>'


def listing(**own):
    return dict.fromkeys(RAW_COLUMNS) | {"caracteristicas": [], "fotos": []} | own


def test_old_snapshots(spark, tmp_path):
    for day, n in (("2025-01-02", 1), ("2025-03-01", 2)):
        (tmp_path / f"dados_{day}.json").write_text(json.dumps([listing(url=f"u{i}", titulo="São") for i in range(n)], indent=4, ensure_ascii=False))
    assert snapshots.newest_date(spark, str(tmp_path)) == "2025-03-01"
    newest = snapshots.read_newest(spark, str(tmp_path), arrays=True)
    assert newest.count() == 2 and str(newest.first()["snapshot_date"]) == "2025-03-01" and newest.first()["titulo"] == "São"
    assert snapshots.newest(snapshots.read_snapshots(spark, str(tmp_path), arrays=True)).count() == 2
    assert snapshots.read_snapshots(spark, str(tmp_path), "2025-01-02", arrays=True).count() == 1
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        snapshots.newest_date(spark, str(tmp_path / "none"))


def test_snapshot_round_trip(spark, tmp_path):
    """What is written is read back row for row, with its date; a rerun replaces its own date alone."""
    out = str(tmp_path / "out")
    rows = [listing(url=f"u{i}", titulo="São\n\u2028x" if i % 2 else None, fotos=["a", ""] if i else [], caracteristicas=None) for i in range(10)]
    df = snapshots.listings_from_rows(spark, rows)
    for day, own in (("2025-03-01", df), ("2025-03-02", df.limit(3)), ("2025-03-02", df.where("url >= 'u5'")), ("2024-12-31", df)):
        snapshots.write_snapshot(own.withColumn("other", F.lit(1)), out, day)
    plain = lambda d: sorted(map(str, d.select(*RAW_COLUMNS).collect()))
    assert snapshots.newest_date(spark, out) == "2025-03-02"
    newest = snapshots.read_newest(spark, out)
    assert plain(newest) == plain(df.where("url >= 'u5'")) and {str(r[0]) for r in newest.select("snapshot_date").collect()} == {"2025-03-02"}
    every = snapshots.read_snapshots(spark, out)
    assert {str(r[0]): r[1] for r in every.groupBy("snapshot_date").count().collect()} == {"2025-03-01": 10, "2025-03-02": 5, "2024-12-31": 10}
    assert plain(snapshots.read_snapshots(spark, out, "2025-03-01")) == plain(df)
    joined = snapshots.appended(newest, snapshots.read_snapshots(spark, out, "2024-12-31").drop("titulo"), newest)
    assert joined.count() == 20 and joined.where("titulo is not null").count() == 6
    line = next(p for p in (tmp_path / "out").rglob("part-*.json") if p.read_text()).read_text().split("\n")[0]  # not splitlines: it also parts at U+2028, which titles have
    assert '"metragem":null' in line


def test_html_rules():
    page = Page('<ul class="listings-wrapper"><li><a class="olx-core-surface" href="/a?x=1&amp;y=2">1</a><li><a class="olx-core-surface b" href="/b">2<b>3</a></ul><a class="olx-core-surface" href="/c">')
    assert page.get(Rule(".listings-wrapper a.olx-core-surface", "all", "href")) == ["/a?x=1&y=2", "/b"]
    assert page.get(Rule("a.olx-core-surface", "only", "href")) is None and page.get(Rule("li a.b")) == "23"
    assert Page(ADVERT.replace("IPTU", "x") + '<div data-testid="iptu">2</div>').tax() == "2"
    assert Page(ADVERT + ADVERT + '<div data-testid="iptu">2</div>').tax() == "2" and Page(ADVERT).tax() == "R$ 1"


def test_broken_pages():
    assert Page("<!-- <p> --><p>a<!-- b").text == ["a"] and Page('<a href="x>y</a><p class=z>t').tags == ["a", "p"]
    assert Page("<script>var a='<p>'</SCRIPT><p>q</p>").tags == ["script", "p"] and "".join(Page("a < b <3 & c").text) == "a < b <3 & c"
    assert Page("<P CLASS='a  b' Data-X=1>x</p>").get(Rule("p.b[data-x=1]")) == "x" and Page("<p>&eacute; &amp;amp;</p>").get(Rule("p")) == "é &amp;"
    assert Page("<p>\u2009\u1680 a\u202f\x1f</p>").get(Rule("p")) == "a" and Page("<p>\u2009</p>").get(Rule("p")) == "" and Page("<p></p>").get(Rule("p")) is None
    assert Page("<div/>a<b>c").get(Rule("div")) is None and Page("<div><b>1</div>2").get(Rule("b")) == "1"


def test_old_forms():
    page = Page('<p class="font-bold">0</p><ul class="amenities-scrollbar"><p>Quartos</p></ul><span><p class="font-bold">after</p></span><div><p>Venda</p></div>')
    assert page.get(OLD_FIELDS["quartos"]) == "after" and page.get(OLD_FIELDS["vagas"]) is None and page.get(OLD_FIELDS["valor_venda"]) is None
    assert Page("<p>x").get(OLD_FIELDS["valor_venda"]) == "N/A" == Page("").get(OLD_FIELDS["descricao"])
    cards = Page('<li data-cy="rp-property-cd"><b>1</b><i href="/i"></i><a href="/a"></a></li><li data-cy="rp-property-cd">none</li><li><a href="/b"></a></li><li data-cy=rp-property-cd><a href="/c">')
    assert cards.get(CARD_LINKS) == ["/i", "/c"]


def test_strip_equals_python(spark):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    df = spark.createDataFrame([(f"{b}a{b}b{b}",) for b in blanks], "t string")
    assert [r[0] for r in df.select(clean.strip("t")).collect()] == [f"a{b}b" for b in blanks]


def test_collect_repeated_addresses_and_hot_links(spark):
    """Of pages with one address the least page_id counts; a link that most result pages have is no case of its own."""
    body = lambda *ls: '<div class="listings-wrapper">' + "".join(f'<a class="olx-core-surface" href="{x}">v</a>' for x in ls) + "</div>"
    pages = [(100 + i, f"http://s/?p={i}", body("http://s/hot", f"/own{i}", "/gone")) for i in range(1, 6)] + [(99, "http://s/?p=1", body("/own2")), (98, "http://s/?p=1", None)]
    pages += [(i, u, f'<h2 class="text-neutral-130 line-clamp-2">{t}</h2>') for i, u, t in ((7, "http://s/hot", "late"), (5, "http://s/hot", "first"), (5, "http://s/hot", "first"), (9, "http://s/own2", "two"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = collect.collect_listings(df, collect.searches(spark, ("s", "http://s/?p={pagina}", 6))).collect()
    assert len(out) == 12 and {(r["page"], r["titulo"]) for r in out if r["url"] == "http://s/hot"} == {(i, "first") for i in range(2, 6)}
    assert [r["extract_status"] for r in out if r["url"] == "http://s/gone"] == ["no_page"] * 4 and [r["titulo"] for r in out if r["url"] == "http://s/own2"] == ["two"]


def test_tables_are_cleaned_up(spark):
    from pathlib import Path

    path = Path(shared.new_path(spark, "x")).parent
    assert shared.written(spark.range(3), "x").count() == 3 and path.exists()
    shared.clean_up(spark)
    assert not path.exists()


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u1", ADVERT), (2, "u2", None), (3, "u3", "")], "page_id long, url string, html string")
    rows = {r["url"]: r for r in extract_listings(pages).collect()}
    assert rows["u1"]["titulo"] == "Casa" and rows["u1"]["condominio"] == "" and rows["u1"]["iptu"] == "R$ 1"
    assert rows["u2"]["extract_status"] == "no_page" and rows["u2"]["fotos"] == [] and rows["u3"]["titulo"] is None
    assert extract_listings(pages.limit(0)).count() == 0
    maps = characteristics(spark.createDataFrame([(1, '<li itemprop="a"><span class="amenities-item-text">1</span></li><li itemprop="a"><span class="amenities-item-text">2</span></li>')], "k int, html string"), ["k"])
    assert maps.first()["caracteristicas"] == {"a": "2"}


def test_sparse_and_json(spark):
    rows = spark.createDataFrame([listing(url="u"), listing(url="v", **dict.fromkeys(RAW_COLUMNS[1:8], ""))], RAW)
    dated = rows.selectExpr("*", "'2025-01-01' AS snapshot_date")
    assert [r["url"] for r in profile.drop_sparse(dated).collect()] == ["v"]
    assert '"titulo":null' in rows.select(collect.as_json(rows)).first()[0]
    assert snapshots.frontier(spark, "x{pagina}", 0).count() == 0


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "u1", ADVERT)], "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    write_listings(page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["titulo"] == "Casa"


def test_pages_of_one_shape(spark):
    """Pages that differ in texts and addresses share a shape and what was found in it; others, and pages that can't be cut at each tag, are read as alone."""
    made = lambda n, more="": f'<script>if (a<b) {{}}</script><h2 class="text-neutral-130 line-clamp-2">t{n}</h2><div><p>{"Vagas" if n % 2 else "Quartos"}</p><div><p>{n}</p></div></div><iframe data-testid="map-iframe" src="/{n}">{more}'
    reader = Reader(FIELDS.values())
    for n in range(20):
        page = reader.read(made(n))
        assert [page.get(FIELDS[k]) for k in ("titulo", "vagas", "quartos", "link_maps")] == [f"t{n}", str(n) if n % 2 else None, None if n % 2 else str(n), f"/{n}"]
    assert len(reader.shapes) == 1
    for more in ("<!-- <p>", '<i title="a>b<c">d</i>', "<3", "<p", "<style><p></style><p>x", "<!doctype html><br/>", "<b data-testid='iptu'>1</b>"):
        page, alone = reader.read(made(1, more)), Page(made(1, more))
        assert page.tags == alone.tags and page.text == alone.text and [page.get(r) for r in FIELDS.values()] == [alone.get(r) for r in FIELDS.values()]
    rule = Rule("i[data-x=1]", "all", "data-x")
    assert Reader([rule]).read("<i data-x=1></i><i data-x=2>").get(rule) == ["1"]


def test_rendered_pages_do_not_move(spark):
    plan = queries.listing_extract(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(key" in plan and "RoundRobin" not in plan and plan.index("<iframe") < plan.index("Exchange")
