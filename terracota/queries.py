"""Registered queries over the driver's tables, and the SQL that gives the same rows.

The tables hold no adverts, so text and HTML are rendered from their columns and read back; the SQL returns the original columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terracota.functions import clean
from terracota.functions.address import PARTS, split_address, split_address_typed, without_kind
from terracota.operators import crawl_log, html, profile
from terracota.operators.joins import TASK_ROWS
from terracota.operators.links import absolute, exploded, links
from terracota.plans import collect, resume
from terracota.schema import RAW_COLUMNS
from terracota.sources import page_store, snapshots
from terracota.sources.commits import commit, new_version
from terracota.sources.shared import new_path, written

SITE = "https://imoveis.example"
TEMPLATE = SITE + "/busca/?pagina={pagina}"
MONTHS = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Tasks that pages are dealt to before they are parsed: these tables have a file or two each, whose row groups can't be split. Where pages are rendered
    from a table, its rows are dealt out in their place: a page is some twenty times as long."""
    return 4 * spark.sparkContext.defaultParallelism


# rendering


def dotted(n: Column) -> Column:
    return F.translate(F.format_number(n, 0), ",", ".")


def long_date(d: Column) -> Column:
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d))
    return F.concat(F.lit("Anúncio criado em "), F.dayofmonth(d), F.lit(" de "), month, F.lit(" de "), F.year(d), F.lit(", atualizado há 12 horas."))


def fee_text(amount: Column, key: Column) -> Column:
    return F.when(key % 4 == 0, F.concat(F.lit("R$ "), dotted(amount), F.lit("/mês"))).when(key % 4 == 1, "Isento").when(key % 4 == 2, "Não informado")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of an advert, from orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("key"), F.concat(F.lit(SITE + "/imovel/"), k, F.lit("/")).alias("url"), F.floor("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("created"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("owner"),
        (k % 400 + 20).alias("area"), (k % 5 + 1).alias("rooms"), (F.col("o_custkey") % 4 + 1).alias("baths"), (k % 3).alias("parking"),
    )


def advert_html() -> Column:
    """A page of an advert: broken tags, entities, a strict IPTU element on every third key, two of them on the next, maps likewise."""
    tag = lambda test_id, body: [F.lit(f'<div data-testid="{test_id}"> '), body, F.lit("<br></div>")]
    label = lambda name, n: [F.lit(f"<div><p>{name}</p><div><p class=x>"), n, F.lit("</p></div></div>")]
    k = F.col("key")
    tax = F.concat(F.lit('<div class="value-item big"><span>IPTU</span><p class="value-item__value">R$ '), dotted(F.col("area")), F.lit("</p></div>"))
    frame = F.concat(F.lit('<iframe data-testid="map-iframe" src="https://maps.example/?q='), k, F.lit('&amp;z=1"></iframe>'))
    return F.concat(
        F.lit('<html><head><script>var p="<p>m²</p>";</script></head><body><h2 class="text-neutral-130 line-clamp-2 t">Casa &amp; Jardim '), k, F.lit('</h2><b>bold<p class="font-secondary">sem medida</p><p class="font-secondary"> '), F.col("area"), F.lit(" m²\n</p>"),
        *label("Banheiros", F.col("baths")), *label("Vagas", F.col("parking")), *label("Quartos", F.col("rooms")),
        F.lit('<div class="value-item__value-highlight"><p>Venda</p><p class="value-item__value">R$&nbsp;'), dotted(F.col("price")), F.lit("</p></div>"),
        *tag("condoFee", F.coalesce(fee_text(F.col("area"), k), F.lit(""))), *tag("location-address", F.concat(F.lit("Rua "), F.col("priority"), F.lit(", "), F.col("owner"), F.lit(" - Centro, Joinville - SC"))),
        F.when(k % 3 == 0, tax).when(k % 3 == 1, F.concat(tax, tax)).otherwise(""), *tag("iptu", F.concat(F.lit("R$ "), dotted(F.col("rooms")))),
        *tag("description-content", F.concat(F.lit("Boa &quot;casa&quot; "), k)), *tag("listing-created-date", long_date(F.col("created"))),
        F.lit('<ul data-testid="amenities-list"><li itemprop="floorLevel"><span class="amenities-item-text">'), F.col("rooms"), F.lit(' andar</span></li><li itemprop="PETS_ALLOWED"><span class="amenities-item-text"> </span><li itemprop="owner"><span class="amenities-item-text">Aceita '), F.col("owner"), F.lit("</span></ul>"),
        F.lit('<ul data-testid="carousel-photos"><li class="carousel-photos--item"><source type="image/webp" srcset="https://i.example/'), k, F.lit("/a.webp 360w, https://i.example/"), k, F.lit('/b.webp 1080w"><source type="image/jpeg" srcset="https://i.example/x.jpg"><source type="image/webp" srcset=""></ul>'),
        F.when(k % 2 == 0, frame).otherwise(F.concat(frame, frame)),
    )


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adverts with their page as html."""
    return orders(spark, sf_dir).withColumn("html", advert_html())


def rendered_in_parts(spark: SparkSession, sf_dir: str, page: Column | None = None) -> DataFrame:
    """The same in parts(spark) tasks, which render and read their pages; these don't move."""
    return orders(spark, sf_dir).repartition(parts(spark), "key").withColumn("html", advert_html() if page is None else page)


ADVERT_SQL = "SELECT o_orderkey AS key, o_custkey AS owner, CAST(floor(o_totalprice) AS BIGINT) AS price, CAST(o_orderdate AS DATE) AS created, o_orderpriority AS priority, o_orderkey % 400 + 20 AS area, o_orderkey % 5 + 1 AS rooms, o_custkey % 4 + 1 AS baths, o_orderkey % 3 AS parking FROM orders"


# links and pages (E1-E3, P5, P7, S6)

LINKS_SQL = """SELECT page_id, url, CAST(i - 1 AS BIGINT) AS pos, l[i] AS link FROM (SELECT page_id, url, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS l FROM pages))"""


@query(f"SELECT page_id, pos, link FROM ({LINKS_SQL})")
def page_links(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", links(F.col("html")).alias("links"))
    return exploded(found, "links", ["page_id"]).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT page_id, pos, CASE WHEN link LIKE 'http%' THEN link ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || link END AS link FROM ({LINKS_SQL})")
def links_resolved(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", "url", links(F.col("html")).alias("links"))
    return exploded(found, "links", ["page_id", "url"]).select("page_id", F.col("pos").cast("long").alias("pos"), absolute(F.col("link"), F.col("url")).alias("link"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS BIGINT) AS n_links FROM pages""")
def links_per_page(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(links(F.col("html"))).cast("long").alias("n_links"))


@query("""SELECT CAST(sum(len(regexp_extract_all(html, '<li><a href="([^"]*)"', 1))) AS BIGINT) AS n_links FROM pages""")
def total_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").agg(F.sum(F.size(links(F.col("html")))).alias("n_links"))


@query(f"SELECT i AS page, replace('{TEMPLATE}', '{{pagina}}', CAST(i AS VARCHAR)) AS url FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM pages))) AS i)")
def frontier(spark, sf_dir):
    return snapshots.frontier(spark, TEMPLATE, table(spark, sf_dir, "pages").count())


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_partkey END AS INTEGER) AS total FROM part")
def total_pages(spark, sf_dir):
    last = F.when(F.col("p_partkey") % 10 == 0, "Próxima").otherwise(dotted(F.col("p_partkey")))
    pages = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('<nav><button class="olx-core-pagination__button">1</button><button class="b olx-core-pagination__button"> '), last, F.lit("</button>")).alias("html"))
    return html.select_all(pages, {"t": html.LAST_PAGE}, ["p_partkey"], parts=parts(spark)).select("p_partkey", html.total_pages(F.col("t")).alias("total"))


@query("SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars FROM pages")
def pages_read(spark, sf_dir):
    return snapshots.read_pages(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


# scalars (C1-C12)


@query("SELECT o_orderkey, floor(o_totalprice) AS price FROM orders")
def price(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", clean.money(F.concat(F.lit("R$ "), dotted(F.floor("o_totalprice")))).alias("price"))


@query("SELECT p_partkey, CAST(p_size * 100 AS DOUBLE) + 0.5 AS area FROM part")
def area(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", clean.area(F.concat(dotted(F.col("p_size") * 100), F.lit(",5 m²"))).alias("area"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN p_size END AS rooms FROM part")
def counts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", clean.count(F.concat(F.lit("\n "), F.col("p_size"), F.when(F.col("p_partkey") % 7 == 0, " ou mais").otherwise(" "))).alias("rooms"))


FEE_SQL = "CASE {k} % 4 WHEN 0 THEN 'informed' WHEN 1 THEN 'exempt' WHEN 2 THEN 'not_informed' ELSE 'absent' END AS status"


@query(f"SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN floor(abs(c_acctbal)) WHEN 2 THEN NULL ELSE 0.0 END AS amount, {FEE_SQL.format(k='c_custkey')} FROM customer")
def condo_fee(spark, sf_dir):
    text = fee_text(F.floor(F.abs("c_acctbal")), F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", clean.condo_fee(text).alias("amount"), clean.fee_status(text).alias("status"))


@query(f"SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN floor(abs(s_acctbal)) END AS amount, {FEE_SQL.format(k='s_suppkey')} FROM supplier")
def iptu(spark, sf_dir):
    text = fee_text(F.floor(F.abs("s_acctbal")), F.col("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", clean.property_tax(text).alias("amount"), clean.fee_status(text).alias("status"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS created, strftime(o_orderdate, '%d/%m/%Y') AS created_text FROM orders")
def publish_date(spark, sf_dir):
    text = long_date(F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", clean.publish_date(text).alias("created"), clean.publish_date_text(text).alias("created_text"))


def _addresses(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, place = F.col("c_custkey"), F.concat("n_name", F.lit(" - sc"))
    house = F.concat(k, F.lit(" - Bairro "), F.col("n_name"), F.lit(", "), place)
    text = F.when(k % 5 == 1, place).when(k % 5 == 2, F.concat("c_name", F.lit(", "), place)).when(k % 5 == 3, F.concat(F.lit("Rua "), F.col("c_name"), F.lit(", "), house)).when(k % 5 == 4, F.concat(F.lit("Rua "), F.col("c_name"), F.lit(", Bloco 2, "), house))
    return c.select("c_custkey", text.alias("endereco"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 3 THEN 'Rua ' || c_name WHEN 4 THEN 'Rua ' || c_name || ', Bloco 2' ELSE 's/r' END AS rua,
CASE WHEN c_custkey % 5 IN (3, 4) THEN CAST(c_custkey AS VARCHAR) ELSE 's/n' END AS numero,
CASE c_custkey % 5 WHEN 2 THEN c_name WHEN 3 THEN 'Bairro ' || n_name WHEN 4 THEN 'Bairro ' || n_name ELSE 's/b' END AS bairro,
CASE WHEN c_custkey % 5 = 0 THEN 's/c' ELSE n_name END AS cidade, CASE WHEN c_custkey % 5 = 0 THEN 's/e' ELSE 'sc' END AS estado
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def address_a(spark, sf_dir):
    return profile.with_struct(_addresses(spark, sf_dir), split_address("endereco")).drop("endereco")


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN lower(n_name) || ' - sc' ELSE lower(c_name) END AS rua,
CASE WHEN c_custkey % 5 = 3 THEN 'bairro ' || lower(n_name) ELSE '' END AS bairro,
CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lower(n_name) END AS cidade, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'SC' END AS estado
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def address_b(spark, sf_dir):
    return profile.with_struct(_addresses(spark, sf_dir), split_address_typed("endereco")).drop("endereco")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'travessa ' ELSE '' END || lower(c_name) AS rua FROM customer")
def street_kind(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("Rua ", "Avenida ", "Estrada ", "Travessa "))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", without_kind(F.concat(kind, F.col("c_name"))).alias("rua"))


@query(r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS folded FROM documents")
def accent_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean.fold("text").alias("folded"))


# extraction (E4-E21, P8)


@query(f"""SELECT '{SITE}/imovel/' || key || '/' AS url, 'Casa & Jardim ' || key AS titulo, area || ' m²' AS metragem, CAST(baths AS VARCHAR) AS banheiros, CAST(parking AS VARCHAR) AS vagas, CAST(rooms AS VARCHAR) AS quartos,
'R$' || chr(160) || regexp_replace(regexp_replace(CAST(price AS VARCHAR), '(\\d)(\\d{{3}})$', '\\1.\\2'), '^(\\d+)(\\d{{3}}\\.)', '\\1.\\2') AS valor_venda,
CASE key % 4 WHEN 0 THEN 'R$ ' || area || '/mês' WHEN 1 THEN 'Isento' WHEN 2 THEN 'Não informado' ELSE '' END AS condominio,
'Rua ' || priority || ', ' || owner || ' - Centro, Joinville - SC' AS endereco, 'R$ ' || CASE WHEN key % 3 = 0 THEN area ELSE rooms END AS iptu, 'Boa "casa" ' || key AS descricao,
rooms || ' andar;Aceita ' || owner AS caracteristicas, 'https://i.example/' || key || '/b.webp' AS fotos, CASE WHEN key % 2 = 0 THEN 'https://maps.example/?q=' || key || '&z=1' END AS link_maps, 'ok' AS extract_status,
'Anúncio criado em ' || day(created) || ' de ' || ({MONTHS!r})[month(created)] || ' de ' || year(created) || ', atualizado há 12 horas.' AS data_criacao FROM ({ADVERT_SQL})""")
def listing_extract(spark, sf_dir):
    out = html.extract_listings(rendered_in_parts(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ";") for c in ("caracteristicas", "fotos")})


@query(f"SELECT '{SITE}/imovel/' || key || '/' AS url, CAST(area AS DOUBLE) AS area_m2, CAST(rooms AS INTEGER) AS quartos, CAST(price AS DOUBLE) AS preco, created AS publicado, 'Rua ' || priority AS rua, CAST(owner AS VARCHAR) AS numero, 'Centro' AS bairro, 'Joinville' AS cidade, 'SC' AS estado, CAST(CASE WHEN key % 3 = 0 THEN area ELSE rooms END AS DOUBLE) AS iptu_valor FROM ({ADVERT_SQL})")
def listing_typed(spark, sf_dir):
    return collect.clean_listings(html.extract_listings(rendered_in_parts(spark, sf_dir))).select("url", "area_m2", "quartos", "preco", "publicado", *PARTS, "iptu_valor")


@query(f"SELECT key, 'floorLevel' AS name, rooms || ' andar' AS value FROM ({ADVERT_SQL}) UNION ALL SELECT key, 'PETS_ALLOWED', '' FROM ({ADVERT_SQL}) UNION ALL SELECT key, 'owner', 'Aceita ' || owner FROM ({ADVERT_SQL})")
def characteristics_map(spark, sf_dir):
    return html.characteristics(rendered_in_parts(spark, sf_dir), ["key"]).select("key", F.explode("caracteristicas").alias("name", "value"))


def _srcsets(spark, sf_dir):
    return html.select_all(rendered_in_parts(spark, sf_dir), {"s": html.FIELDS["fotos"]}, ["key"])


@query("SELECT o_orderkey AS key, 'https://i.example/' || o_orderkey || '/b.webp' AS photo FROM orders")
def photos_best(spark, sf_dir):
    return _srcsets(spark, sf_dir).select("key", F.explode(clean.photos("s")).alias("photo"))


@query("SELECT o_orderkey AS key, 'https://i.example/' || o_orderkey || '/a.webp' AS photo FROM orders")
def photos_first(spark, sf_dir):
    cards = html.select_all(rendered_in_parts(spark, sf_dir), {"s": html.OLD_FIELDS["fotos"]}, ["key"])
    return cards.select("key", F.explode(html.first_photos("s")).alias("photo"))


def old_advert_html() -> Column:
    """A page of the older form: labels in a list with values behind them, a price beside "Venda", some of them missing."""
    k = F.col("key")
    item = lambda name, value: [F.lit(f"<li><p>{name}</p><span><p class='x font-bold'> "), value, F.lit(" </p></span></li>")]
    return F.concat(
        F.lit('<h2 class="a text-neutral-130"> Casa <i> '), k, F.lit('</i></h2><p class="font-bold">0</p><ul class="amenities-scrollbar b"><p class="font-bold">1</p>'),
        *item("Metragem", F.concat(F.col("area"), F.lit(" m²"))), *item("Quartos", F.col("rooms")), *item("Banheiros", F.col("baths")), F.when(k % 3 > 0, F.concat(*item("Vagas", F.col("parking")))).otherwise(""), F.lit("</ul>"),
        F.when(k % 5 > 0, F.concat(F.lit("<section><div><div><b>t</b></div><p>Venda</p></div><span>s</span><p>R$ <b> "), dotted(F.col("price")), F.lit("</b></p></section>"))).otherwise(""),
        F.when(k % 2 == 0, F.concat(F.lit('<p data-testid="condoFee">R$ '), dotted(F.col("area")), F.lit("</p>"))).otherwise('<div data-testid="condoFee">no p</div>'),
        F.lit('<ul><li class="carousel-photos--item"><img src="n"><source type="image/jpeg" srcset="https://i.example/'), k, F.lit('/c.jpg 1x, https://i.example/d.jpg 2x"><source type="image/webp" srcset="https://i.example/w.webp"></li><li class="carousel-photos--item"><source src="none"></li></ul>'),
    )


@query(f"""SELECT key, 'Casa' || key AS titulo, area || ' m²' AS metragem, CAST(rooms AS VARCHAR) AS quartos, CAST(baths AS VARCHAR) AS banheiros, CASE WHEN key % 3 > 0 THEN CAST(parking AS VARCHAR) END AS vagas,
CASE WHEN key % 5 > 0 THEN 'R$' || regexp_replace(regexp_replace(CAST(price AS VARCHAR), '(\\d)(\\d{{3}})$', '\\1.\\2'), '^(\\d+)(\\d{{3}}\\.)', '\\1.\\2') ELSE 'N/A' END AS valor_venda,
CASE WHEN key % 2 = 0 THEN 'R$ ' || area ELSE 'N/A' END AS condominio, 'N/A' AS descricao, 'https://i.example/' || key || '/c.jpg' AS fotos FROM ({ADVERT_SQL})""")
def old_listing_extract(spark, sf_dir):
    pages = rendered_in_parts(spark, sf_dir, old_advert_html())
    out = html.extract_listings(pages, ["titulo", "metragem", "quartos", "banheiros", "vagas", "valor_venda", "condominio", "descricao", "fotos"], rules=html.OLD_FIELDS)
    key = F.regexp_extract("url", r"(\d+)/$", 1).cast("long").alias("key")
    return out.select(key, "titulo", "metragem", "quartos", "banheiros", "vagas", "valor_venda", "condominio", "descricao", F.array_join("fotos", ";").alias("fotos"))


@query(f"SELECT o_custkey AS page, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, '{SITE}/imovel/' || o_orderkey || '/' AS link FROM orders WHERE o_orderkey % 9 > 0")
def card_links(spark, sf_dir):
    """Result pages of the card form, one a customer; every ninth card has no link."""
    link = F.when(F.col("key") % 2 == 0, F.col("url")).otherwise(F.replace("url", F.lit(SITE), F.lit("")))
    inner = F.when(F.col("key") % 9 > 0, F.concat(F.lit('<div><span>t<a class="x" href="'), link, F.lit('">a</a><a href="/no">b</a></span>'))).otherwise("<div>nada")
    card = F.concat(F.lit('<li class="c" data-cy="rp-property-cd">'), inner, F.lit("</div></li><li><a href='/menu'>m</a></li>"))
    pages = orders(spark, sf_dir).groupBy(F.col("owner").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", card.alias("c")))), lambda x: x["c"]), "").alias("cards"))
    pages = pages.select("page", F.lit(SITE + "/busca/").alias("url"), F.concat(F.lit("<ul>"), "cards").alias("html"))
    return exploded(collect.result_links(pages, ["page"], html.CARD_LINKS, parts(spark)), "links", ["page"]).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT o_orderkey AS key, 1 AS n_photos FROM orders")
def photo_count(spark, sf_dir):
    return _srcsets(spark, sf_dir).select("key", clean.photo_count(clean.photos("s")).alias("n_photos"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 > 0 THEN floor(o_totalprice) END AS price FROM orders")
def bad_fields(spark, sf_dir):
    pages = rendered_in_parts(spark, sf_dir).withColumn("html", F.when(F.col("key") % 7 == 0, F.regexp_replace("html", "R\\$&nbsp;", "a partir de ")).otherwise(F.col("html")))
    return html.extract_listings(pages, ["valor_venda"]).select(F.regexp_extract("url", r"(\d+)/$", 1).cast("long").alias("key"), clean.money("valor_venda").alias("price"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 11 = 0 THEN 'no_page' ELSE 'ok' END AS extract_status, CASE WHEN o_orderkey % 11 > 0 THEN 'Casa & Jardim ' || o_orderkey END AS titulo FROM orders")
def bad_rows(spark, sf_dir):
    pages = rendered_in_parts(spark, sf_dir).withColumn("html", F.when(F.col("key") % 11 > 0, F.col("html")))
    return html.extract_listings(pages, ["titulo"]).select(F.regexp_extract("url", r"(\d+)/$", 1).cast("long").alias("key"), "extract_status", "titulo")


@query("""SELECT field, count(*) FILTER (WHERE r = 'ok') AS n_ok, count(*) FILTER (WHERE r = 'absent') AS n_absent, count(*) FILTER (WHERE r NOT IN ('ok', 'absent')) AS n_failed, coalesce(max(r) FILTER (WHERE r NOT IN ('ok', 'absent')), '') AS reasons
FROM (SELECT unnest(['titulo', 'banheiros', 'quartos', 'link_maps', 'metragem']) AS field, unnest(['ok', CASE WHEN o_orderkey % 7 = 0 THEN 'a label without its value' ELSE 'ok' END, CASE WHEN o_orderkey % 5 = 0 THEN 'absent' ELSE 'ok' END,
CASE WHEN o_orderkey % 2 > 0 THEN 'several elements for one' WHEN o_orderkey % 6 = 0 THEN 'an element without its attribute' ELSE 'ok' END, 'AttributeError']) AS r FROM orders) GROUP BY field, CASE WHEN field = 'link_maps' THEN '' END""".replace("coalesce(max(r) FILTER (WHERE r NOT IN ('ok', 'absent')), '')", "coalesce(string_agg(DISTINCT r, ';' ORDER BY r) FILTER (WHERE r NOT IN ('ok', 'absent')), '')"))
def field_outcomes(spark, sf_dir):
    """What failed told from what is absent, on pages with labels without values, doubled and bare frames, and by a rule that can't be read."""
    k, page = F.col("key"), F.col("html")
    page = F.when(k % 7 == 0, F.regexp_replace(page, "<p>Banheiros</p><div><p class=x>[0-9]+</p></div>", "<p>Banheiros</p>")).otherwise(page)
    page = F.when(k % 5 == 0, F.regexp_replace(page, "<p>Quartos</p>", "<p>Suites</p>")).otherwise(page)
    page = F.when(k % 6 == 0, F.regexp_replace(page, 'map-iframe" src=', 'map-iframe" href=')).otherwise(page)
    names = ["titulo", "banheiros", "quartos", "link_maps", "metragem"]
    rules = html.FIELDS | {"metragem": html.Rule("p>b")}
    out = html.extract_listings(rendered_in_parts(spark, sf_dir).withColumn("html", page), names, rules=rules, failures=True)
    return html.field_outcomes(out, names).withColumn("reasons", F.array_join(F.array_sort(F.map_keys("reasons")), ";"))


@query(f"""SELECT key, '{{"key":' || key || ',"price":' || price || ',"map":' || CASE WHEN key % 2 = 0 THEN '"m"' ELSE 'null' END || '}}' AS record FROM ({ADVERT_SQL})""")
def record_json(spark, sf_dir):
    rows = orders(spark, sf_dir).select("key", "price", F.when(F.col("key") % 2 == 0, "m").alias("map"))
    return rows.select("key", collect.as_json(rows).alias("record"))


# profile (D1-D11, S2)

GAPS = "SELECT event_id, ts, CASE WHEN user_id % 3 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 11 > 0 THEN event_type END AS event_type, CASE WHEN event_id % 7 > 0 THEN value END AS value, CASE WHEN event_id % 5 > 0 THEN props END AS props FROM events"


def _gaps(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select("event_id", "ts", F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("user_id"), F.when(k % 11 > 0, F.col("event_type")).alias("event_type"), F.when(k % 7 > 0, F.col("value")).alias("value"), F.when(k % 5 > 0, F.col("props")).alias("props"))


@query("SELECT event_id, CAST(ts AS DATE) AS snapshot_date FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def snapshot_newest(spark, sf_dir):
    return snapshots.newest(table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("snapshot_date")))


def _records(spark, sf_dir):
    """Raw listings of the orders, a list and all-null columns among them."""
    o = orders(spark, sf_dir)
    return snapshots.as_listings(o.select("url", F.concat(F.lit("Casa São "), "key").alias("titulo"), F.when(F.col("key") % 3 > 0, F.col("area")).alias("metragem"), F.array(F.col("priority"), F.lit("")).alias("fotos"), F.col("owner").alias("quartos")))


RECORDS_SQL = f"SELECT '{SITE}/imovel/' || key || '/' AS url, 'Casa São ' || key AS titulo, CASE WHEN key % 3 > 0 THEN CAST(area AS VARCHAR) END AS metragem, CAST(NULL AS VARCHAR) AS descricao, CAST(owner AS VARCHAR) AS quartos, priority || ';' AS fotos"
DAYS = ("2025-01-02", "2025-03-01", "2024-12-31")


def _snapshots(spark, sf_dir) -> str:
    """A folder of three snapshots: the even orders, the odd ones, all; that of the second day is written twice."""
    path = new_path(spark, "snapshots")
    rows = _records(spark, sf_dir)
    number = F.regexp_extract("url", r"(\d+)/$", 1).cast("long")
    for day, own in zip((*DAYS, DAYS[1]), (rows.where(number % 2 == 0), rows, rows, rows.where(number % 2 == 1)), strict=True):
        snapshots.write_snapshot(own, path, day, compression="gzip")
    return path


def _shown(listings):
    return listings.select("url", "titulo", "metragem", "descricao", "quartos", F.array_join("fotos", ";").alias("fotos"), "snapshot_date")


@query(" UNION ALL ".join(f"{RECORDS_SQL}, DATE '{d}' AS snapshot_date FROM ({ADVERT_SQL}) WHERE {w}" for d, w in zip(DAYS, ("key % 2 = 0", "key % 2 = 1", "TRUE"), strict=True)))
def snapshots_read(spark, sf_dir):
    return _shown(snapshots.read_snapshots(spark, _snapshots(spark, sf_dir)))


@query(f"{RECORDS_SQL}, DATE '{DAYS[1]}' AS snapshot_date FROM ({ADVERT_SQL}) WHERE key % 2 = 1")
def snapshot_read_newest(spark, sf_dir):
    return _shown(snapshots.read_newest(spark, _snapshots(spark, sf_dir)))


@query(" UNION ALL ".join(f"{RECORDS_SQL}, DATE '{d}' AS snapshot_date FROM ({ADVERT_SQL}) WHERE {w}" for d, w in ((DAYS[0], "key % 2 = 0"), (DAYS[2], "TRUE"), (DAYS[2], "TRUE"))))
def snapshots_appended(spark, sf_dir):
    path = _snapshots(spark, sf_dir)
    one, all_rows = (snapshots.read_snapshots(spark, path, d) for d in (DAYS[0], DAYS[2]))
    return _shown(snapshots.appended(one, all_rows.drop("descricao"), all_rows))


@query(f"{RECORDS_SQL} FROM ({ADVERT_SQL})")
def rows_to_table(spark, sf_dir):
    return _shown(_records(spark, sf_dir).withColumn("snapshot_date", F.lit(None))).drop("snapshot_date")


@query("SELECT 'n' || n_nationkey AS url, 'Nação ' || n_name AS titulo, CAST(count(c_custkey) AS VARCHAR) AS quartos FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def rows_given(spark, sf_dir):
    """A few records, one a nation, that came as rows."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")), "n_nationkey", "left")
    rows = [dict.fromkeys(RAW_COLUMNS) | {"url": f"n{r['n_nationkey']}", "titulo": f"Nação {r['n_name']}", "quartos": str(r["n"] or 0), "fotos": []} for r in n.collect()]
    return snapshots.listings_from_rows(spark, rows).select("url", "titulo", "quartos")


@query(f"SELECT CAST(d AS DATE) AS snapshot_date, CASE d WHEN '{DAYS[0]}' THEN (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) WHEN '{DAYS[1]}' THEN (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 1) WHEN '{DAYS[2]}' THEN (SELECT count(*) FROM orders) ELSE 0 END AS n_records, d = '2025-06-01' AS is_newest FROM (SELECT unnest(['{DAYS[0]}', '{DAYS[1]}', '{DAYS[2]}', '2025-06-01']) AS d)")
def snapshot_days(spark, sf_dir):
    """Days after one that is empty, and after a rerun of the first that ended before its commit: the empty day is the newest, the first as it was."""
    path = _snapshots(spark, sf_dir)
    rows = _records(spark, sf_dir)
    snapshots.write_snapshot(rows.where("url is null"), path, "2025-06-01", compression="gzip")
    rows.write.json(f"{path}/snapshot_date={DAYS[0]}/version={new_version()}", compression="gzip")  # what a rerun leaves that ended before its commit
    found = snapshots.read_snapshots(spark, path).groupBy("snapshot_date").agg(F.count("*").alias("n_read"))
    days = snapshots.days(spark, path).join(found, "snapshot_date", "left").where("n_records = coalesce(n_read, 0)")
    return days.select("snapshot_date", "n_records", (F.col("snapshot_date") == F.lit(snapshots.newest_date(spark, path)).cast("date")).alias("is_newest"))


def _mixed_lines(spark, sf_dir) -> str:
    """A day with broken lines among its records: every tenth order is cut off, every seventh has no url, and blank lines stand in between."""
    path, version = new_path(spark, "mixed"), new_version()
    rows = _records(spark, sf_dir).withColumn("key", F.regexp_extract("url", r"(\d+)/$", 1).cast("long"))
    rows = rows.withColumn("url", F.when((F.col("key") % 7 > 0) | (F.col("key") % 10 == 0), F.col("url")))
    line = collect.as_json(rows, [c for c in rows.columns if c != "key"])
    line = F.when(F.col("key") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line)
    rows.select(F.explode(F.array(line, F.lit("")))).write.text(f"{path}/snapshot_date={DAYS[0]}/version={version}")
    commit(spark, path, DAYS[0], version)
    return path


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 0 THEN 'broken' ELSE 'no url' END AS reason FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 0")
def quarantine(spark, sf_dir):
    bad = snapshots.quarantined(spark, _mixed_lines(spark, sf_dir)).where("line > 0 and file is not null")
    return bad.select(F.regexp_extract("record", r'"Casa São (\d+)"', 1).cast("long").alias("key"), "reason")


@query(f"SELECT '{SITE}/imovel/' || o_orderkey || '/' AS url, o_orderkey % 10 = 0 AS mended FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 > 0")
def quarantine_mended(spark, sf_dir):
    """Listings of the day, and those of the quarantine once the cut-off records have their ends again."""
    path = _mixed_lines(spark, sf_dir)
    bad = snapshots.quarantined(spark, path).withColumn("record", F.when(F.col("reason") == "broken", F.concat("record", F.lit("l}"))).otherwise(F.col("record")))
    found = snapshots.read_snapshots(spark, path)
    return found.select("url", F.lit(False).alias("mended")).unionByName(snapshots.read_again(bad).select("url", F.lit(True).alias("mended")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS run_date FROM events")
def run_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", snapshots.run_date(F.col("ts")).alias("run_date"))


COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM ({GAPS})" for c in COLUMNS))
def null_profile(spark, sf_dir):
    return profile.null_profile(_gaps(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n_not_null, '{t}' AS type FROM ({GAPS})" for c, t in zip(COLUMNS, ("bigint", "TS", "bigint", "string", "double", "string"), strict=True)).replace("'TS'", "'timestamp'"))
def column_info(spark, sf_dir):
    info = profile.column_info(_gaps(spark, sf_dir))
    return info.withColumn("type", F.regexp_replace("type", "timestamp_ntz", "timestamp"))


@query("SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM events")
def shape(spark, sf_dir):
    return profile.shape(_gaps(spark, sf_dir))


@query(f"SELECT event_id FROM ({GAPS}) WHERE CAST(user_id IS NOT NULL AS INTEGER) + CAST(event_type IS NOT NULL AS INTEGER) + CAST(value IS NOT NULL AS INTEGER) + CAST(props IS NOT NULL AS INTEGER) >= 3")
def sparse_rows(spark, sf_dir):
    return profile.drop_sparse(_gaps(spark, sf_dir), 3, ["user_id", "event_type", "value", "props"]).select("event_id")


@query(f"SELECT event_id FROM ({GAPS}) WHERE value IS NULL")
def missing_price_urls(spark, sf_dir):
    return profile.keys_missing(_gaps(spark, sf_dir), "value", "event_id")


@query(f"SELECT event_id, user_id, event_type, value FROM ({GAPS}) WHERE props IS NULL")
def missing_desc(spark, sf_dir):
    return profile.missing(_gaps(spark, sf_dir), "props").drop("ts", "props")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 5 < 3")
def no_street(spark, sf_dir):
    return profile.keys_where(address_a(spark, sf_dir), "rua", "s/r", "c_custkey")


@query("SELECT page_id, url FROM pages ORDER BY page_id LIMIT 5")
def preview(spark, sf_dir):
    return profile.preview(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")


# collection (P1-P10)


def dealt_orders(spark, sf_dir, rows: DataFrame, *keys: str) -> DataFrame:
    """rows of the orders, dealt by keys into tasks of TASK_ROWS or fewer: a split of a table that compresses well has millions of rows, and their pages are some twenty times as long."""
    return rows.repartition(max(parts(spark), -(-table(spark, sf_dir, "orders").count() // TASK_ROWS)), *keys)


def search_pages(spark, sf_dir) -> tuple[DataFrame, int]:
    """Stored pages of a search, result pages and adverts, and the number of result pages; every seventh result page is empty, every thirteenth advert isn't stored."""
    rows = orders(spark, sf_dir)
    ads = dealt_orders(spark, sf_dir, rows.where("key % 13 > 0"), "key").withColumn("html", advert_html())
    total = table(spark, sf_dir, "orders").count() // 50 + 1
    link = lambda k: F.concat(F.lit('<a class="olx-core-surface x" href="'), F.when(k % 2 == 0, SITE).otherwise(""), F.lit("/imovel/"), k, F.lit('/">ver</a>'))
    results = dealt_orders(spark, sf_dir, rows.select("key", (F.col("key") % total + 1).alias("page")), "page").groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("key")), link), "").alias("as"))
    body = F.when(F.col("page") % 7 > 0, F.col("as")).otherwise("nada")
    results = results.select((-F.col("page")).alias("page_id"), F.replace(F.lit(TEMPLATE), F.lit("{pagina}"), F.col("page").cast("string")).alias("url"), F.concat(F.lit('<a class="olx-core-surface" href="/menu">x</a><div class="listings-wrapper">'), body, F.lit("</div>")).alias("html"))
    return written(results, "result-pages").union(ads.select("key", "url", "html")), total


def one_search(spark, total: int | None) -> DataFrame:
    return collect.searches(spark, ("all", TEMPLATE, total))


COLLECT_SQL = "SELECT o_orderkey AS key, o_orderkey % (SELECT count(*) // 50 + 1 FROM orders) + 1 AS page FROM orders"


@query(f"SELECT page, count(*) AS n_records, count(*) FILTER (WHERE key % 13 > 0) AS n_ok FROM ({COLLECT_SQL}) WHERE page % 7 > 0 GROUP BY page")
def collect_counts(spark, sf_dir):
    pages, total = search_pages(spark, sf_dir)
    found = collect.collect_listings(pages, one_search(spark, total), [], parts(spark))
    return found.groupBy("page").agg(F.count("*").alias("n_records"), F.count_if(F.col("extract_status") == "ok").alias("n_ok"))


@query(f"SELECT page, count(*) AS n_records FROM ({COLLECT_SQL}) WHERE page % 7 > 0 AND key % 13 > 0 GROUP BY page")
def valid_records_per_page(spark, sf_dir):
    pages, total = search_pages(spark, sf_dir)
    return collect.records_per_page(profile.drop_sparse(collect.collect_listings(pages, one_search(spark, total), parts=parts(spark))))


@query(f"SELECT count(*) AS n_records FROM ({COLLECT_SQL}) WHERE page % 7 > 0")
def total_records(spark, sf_dir):
    pages, total = search_pages(spark, sf_dir)
    return collect.total_records(collect.collect_listings(pages, one_search(spark, total), [], parts(spark)))


@query("SELECT key, titulo FROM (SELECT o_orderkey AS key, 'Casa & Jardim ' || o_orderkey AS titulo, o_custkey AS c FROM orders) WHERE c IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def given_urls(spark, sf_dir):
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("owner"))
    ads = rendered(spark, sf_dir)
    urls = orders(spark, sf_dir).join(poor, "owner").select("url")
    return collect.listings_of(ads.select("url", "html"), urls, fields=["titulo"], parts=parts(spark)).select(F.regexp_extract("url", r"(\d+)/$", 1).cast("long").alias("key"), "titulo")


SEARCH_SQL = "SELECT o_orderkey AS key, o_orderpriority AS search, (o_orderkey // 8) % (count(*) OVER (PARTITION BY o_orderpriority) // 50 + 1) + 1 AS page FROM orders WHERE o_orderkey % 4 > 0"


def several_searches(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Stored pages of a search for each order priority, and the searches. Their first pages announce how many there are; every thirteenth advert isn't stored.

    Searches without any order in them have a first page without buttons, the search "none" has no stored page.
    """
    rows = orders(spark, sf_dir).where("key % 4 > 0")
    ads = dealt_orders(spark, sf_dir, rows.where("key % 13 > 0"), "key").withColumn("html", advert_html())
    totals = written(rows.groupBy("priority").agg((F.floor(F.count("*") / 50) + 1).alias("total")), "totals")
    placed = rows.select("key", "priority").join(F.broadcast(totals), "priority").withColumn("page", F.floor(F.col("key") / 8) % F.col("total") + 1)
    placed = dealt_orders(spark, sf_dir, placed, "priority", "page", "total")
    link = lambda k: F.concat(F.lit(f'<a class="olx-core-surface" href="{SITE}/imovel/'), k, F.lit('/">ver</a>'))
    cards = placed.groupBy("priority", "page", "total").agg(F.array_join(F.transform(F.array_sort(F.collect_list("key")), link), "").alias("as"))
    every = totals.withColumn("page", F.explode(F.sequence(F.lit(1), "total"))).join(cards.drop("total"), ["priority", "page"], "left")
    slug = F.regexp_replace("priority", "[^0-9]", "")
    template = F.concat(F.lit(f"{SITE}/"), slug, F.lit("/{pagina}"))
    buttons = F.concat(F.lit('<button class="olx-core-pagination__button">1</button><button class="olx-core-pagination__button">'), dotted(F.col("total")), F.lit("</button>"))
    results = every.select((-F.col("page")).alias("page_id"), F.replace(template, F.lit("{pagina}"), F.col("page").cast("string")).alias("url"), F.concat(F.when(F.col("page") == 1, buttons).otherwise(""), F.lit('<div class="listings-wrapper">'), F.coalesce("as", F.lit("")), F.lit("</div>")).alias("html"))
    of = totals.select(F.col("priority").alias("search"), template.alias("template"), F.lit(None).cast("int").alias("total")).unionByName(collect.searches(spark, ("none", f"{SITE}/none/{{pagina}}")))
    return written(results, "result-pages").unionByName(ads.select(F.col("key").alias("page_id"), "url", "html")), of


@query(f"SELECT c_custkey AS search, CAST(p AS BIGINT) AS page, '{SITE}/c/' || c_custkey || '?pagina=' || p AS url FROM (SELECT c_custkey, unnest(range(1, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE c_custkey % 5 END + 1)) AS p FROM customer)")
def search_frontiers(spark, sf_dir):
    """Search pages of a search for each customer: a third has its total given, the others' stored first pages announce it, some of them none."""
    k = F.col("c_custkey")
    of = table(spark, sf_dir, "customer").select(k.cast("string").alias("search"), F.concat(F.lit(f"{SITE}/c/"), k, F.lit("?pagina={pagina}")).alias("template"), F.when(k % 3 == 0, 2).alias("total"))
    last = F.when(k % 5 > 0, F.concat(F.lit('<b class="olx-core-pagination__button">'), k % 5, F.lit("</b>"))).otherwise("<b>nada</b>")
    pages = table(spark, sf_dir, "customer").select(k.cast("long").alias("page_id"), F.concat(F.lit(f"{SITE}/c/"), k, F.lit("?pagina=1")).alias("url"), last.alias("html"))
    found = snapshots.search_frontier(collect.with_totals(pages, of))
    return found.select(F.col("search").cast("long").alias("search"), "page", "url")


@query(f"SELECT search, page, count(*) AS n_records, count(*) FILTER (WHERE key % 13 > 0) AS n_ok FROM ({SEARCH_SQL}) GROUP BY ALL")
def collect_searches(spark, sf_dir):
    """Several searches, none with a total given."""
    pages, of = several_searches(spark, sf_dir)
    found = collect.collect_listings(pages, of, [], parts(spark))
    return found.groupBy("search", "page").agg(F.count("*").alias("n_records"), F.count_if(F.col("extract_status") == "ok").alias("n_ok"))


@query(f"""SELECT unnest(['n_records', 'n_ok', 'n_no_page', 'n_failed', 'n_pages', 'n_valid']) AS name, unnest([count(*), count(*) FILTER (WHERE key % 13 > 0), count(*) FILTER (WHERE key % 13 = 0), 0, count(DISTINCT search || page), count(*) FILTER (WHERE key % 13 > 0)]) AS n FROM ({SEARCH_SQL})""")
def collection_counts(spark, sf_dir):
    """What a whole run, collected and published, counts while it writes."""
    pages, of = several_searches(spark, sf_dir)
    counts = collect.write_collection(pages, of, new_path(spark, "collection"), "2025-05-05", parts(spark))
    return spark.createDataFrame(list(counts.items()), "name string, n long")


@query(f"SELECT '{SITE}/imovel/' || key || '/' AS url, row_number() OVER (ORDER BY search, page, key) AS place FROM ({SEARCH_SQL})")
def ordered_output(spark, sf_dir):
    """The published files, read by name, have the records in the order of searches, pages and links."""
    pages, of = several_searches(spark, sf_dir)
    path = new_path(spark, "collection")
    collect.write_collection(pages, of, path, "2025-05-05", parts(spark), 8)
    lines = spark.read.text(f"{path}/snapshot_date=2025-05-05/*").select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    return snapshots.with_places(lines, lines).select(F.get_json_object("value", "$.url").alias("url"), "place")


@query(f"SELECT search, page, count(*) AS n_records, count(*) FILTER (WHERE key % 13 > 0) AS n_ok FROM ({SEARCH_SQL}) GROUP BY ALL")
def collect_from_store(spark, sf_dir):
    """The same counts from pages that are laid out by address, which no join moves."""
    pages, of = several_searches(spark, sf_dir)
    path = new_path(spark, "pages")
    name = f"pages_{path.rsplit('-', 1)[-1]}"
    page_store.write_pages(pages, name, 8, path)
    found = collect.collect_listings(page_store.stored_pages(spark, name), of, ["titulo"])
    return found.groupBy("search", "page").agg(F.count("*").alias("n_records"), F.count("titulo").alias("n_ok"))


def _two_runs(spark, sf_dir) -> str:
    """A collection in two runs: the first finds the even adverts and result pages of even number stored, the second all; nothing is read twice."""
    pages, of = several_searches(spark, sf_dir)
    pages, of, path = written(pages, "pages"), written(of, "searches"), new_path(spark, "runs")
    even = F.when(F.col("page_id") < -1, F.col("page_id") % 2 == 0).otherwise((F.col("page_id") % 2 == 0) | (F.col("page_id") < 0))
    for stored in (pages.where(even), pages):
        resume.collect_more(stored, of, path, parts(spark))
    return path


RUNS_SQL = f"SELECT key, search, page, page = 1 OR page % 2 = 0 AS early FROM ({SEARCH_SQL})"


@query(f"SELECT search, page, count(*) AS n_records, count(*) FILTER (WHERE key % 13 > 0) AS n_ok FROM ({SEARCH_SQL}) GROUP BY ALL")
def resumed_collection(spark, sf_dir):
    found = resume.collected(spark, _two_runs(spark, sf_dir))
    return found.groupBy("search", "page").agg(F.count("*").alias("n_records"), F.count("titulo").alias("n_ok"))


@query(f"""WITH r AS ({RUNS_SQL}), t AS (SELECT o_orderpriority, count(*) // 50 + 1 AS total FROM orders WHERE o_orderkey % 4 > 0 GROUP BY 1), p AS (SELECT unnest(range(1, total + 1)) AS page FROM t)
SELECT 1 AS run, (SELECT count(*) FROM p WHERE page = 1 OR page % 2 = 0) AS n_result_pages, count(*) FILTER (WHERE early) AS n_links, count(*) FILTER (WHERE early AND key % 13 > 0 AND key % 2 = 0) AS n_adverts FROM r
UNION ALL SELECT 2, (SELECT count(*) FROM p WHERE page > 1 AND page % 2 = 1), count(*) FILTER (WHERE NOT early), count(*) FILTER (WHERE key % 13 > 0 AND NOT (early AND key % 2 = 0)) FROM r""")
def resumed_runs(spark, sf_dir):
    """How many pages each of two runs reads: the second none that the first has read."""
    runs = resume.runs(spark, _two_runs(spark, sf_dir))
    return runs.select((F.row_number().over(Window.orderBy("run"))).alias("run"), "n_result_pages", "n_links", "n_adverts")


# request log (K1-K4)


def _requests(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("unique_key"), F.col("event_type").alias("status"), F.col("value").cast("decimal(18,4)").alias("duration_ms"), (k % 9 > 0).alias("finished"), (k % 4).alias("retry_count"))


@query("""SELECT status, count(*) AS n_total, count(*) FILTER (WHERE f) AS n_finished, count(*) FILTER (WHERE NOT f) AS n_failed, count(*) FILTER (WHERE r > 0) AS n_retried,
CAST(min(d) FILTER (WHERE f) AS DOUBLE) AS min_ms, CAST(max(d) FILTER (WHERE f) AS DOUBLE) AS max_ms, CAST(sum(d) FILTER (WHERE f) AS DOUBLE) AS sum_ms
FROM (SELECT event_type AS status, event_id % 9 > 0 AS f, event_id % 4 AS r, CAST(value AS DECIMAL(18,4)) AS d FROM events) GROUP BY status""")
def crawl_summary(spark, sf_dir):
    found = crawl_log.crawl_summary(_requests(spark, sf_dir), ["status"]).drop("avg_ms")
    return found.withColumns({c: F.col(c).cast("double") for c in ("min_ms", "max_ms", "sum_ms")})


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    return crawl_log.status_counts(_requests(spark, sf_dir))


@query("SELECT event_id % 4 AS retry_count, count(*) AS n FROM events GROUP BY 1")
def retry_hist(spark, sf_dir):
    return crawl_log.retry_histogram(_requests(spark, sf_dir))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS unique_key FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0)")
def pending(spark, sf_dir):
    handled = table(spark, sf_dir, "events").where("event_id % 97 = 0").select(F.col("user_id").cast("string").alias("unique_key"))
    return crawl_log.pending(_requests(spark, sf_dir), handled)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages to clean listings."""
    pages, total = search_pages(spark, sf_dir)
    return collect.clean_listings(collect.collect_listings(pages, one_search(spark, total), parts=parts(spark)))
