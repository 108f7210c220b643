"""Committed days, quarantine, searches without totals, pruned fields, failures, the page store, ordered output and runs that go on."""

import json

import pytest
from pyspark.sql import functions as F
from test_tables import listing

from terracota.operators import joins
from terracota.operators.html import FIELDS, LAST_PAGE, OLD_FIELDS, Page, Rule, extract_listings, field_outcomes, select_all
from terracota.plans import collect, resume
from terracota.schema import RAW_COLUMNS
from terracota.sources import commits, page_store, snapshots
from terracota.sources.shared import written

LINK = '<a class="olx-core-surface" href="{}">v</a>'
BUTTON = '<b class="olx-core-pagination__button">{}</b>'


def result(*links, total=None):
    return (BUTTON.format(total) if total is not None else "") + '<div class="listings-wrapper">' + "".join(map(LINK.format, links)) + "</div>"


def advert(title):
    return f'<h2 class="text-neutral-130 line-clamp-2">{title}</h2>'


def stored(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def test_failed_rerun_leaves_the_day(spark, tmp_path):
    path = str(tmp_path)
    one = snapshots.listings_from_rows(spark, [listing(url="u1", titulo="a")])
    assert snapshots.write_snapshot(one, path, "2025-01-01") == {"n_records": 1}
    broken = one.withColumn("titulo", F.when(F.col("url") == "u1", F.raise_error(F.lit("broken off")).cast("string")))
    with pytest.raises(Exception, match="broken off"):
        snapshots.write_snapshot(broken, path, "2025-01-01")
    assert [r["titulo"] for r in snapshots.read_snapshots(spark, path).collect()] == ["a"]
    snapshots.write_snapshot(one.withColumn("titulo", F.lit("b")), path, "2025-01-01")
    assert [r["titulo"] for r in snapshots.read_newest(spark, path).collect()] == ["b"]
    # the first version and the broken one are gone afterwards, the current one isn't
    assert commits.drop_superseded(spark, path) == 1 and [r["titulo"] for r in snapshots.read_newest(spark, path).collect()] == ["b"]


def test_an_empty_day_is_the_newest(spark, tmp_path):
    path = str(tmp_path)
    one = snapshots.listings_from_rows(spark, [listing(url="u1")])
    snapshots.write_snapshot(one, path, "2025-01-01")
    for none in (one.limit(0), one.where("url > 'z'"), spark.createDataFrame([], one.schema)):
        assert snapshots.write_snapshot(none, path, "2025-02-01", ["url"]) == {"n_records": 0}
    assert snapshots.newest_date(spark, path) == "2025-02-01" and snapshots.read_newest(spark, path).count() == 0
    assert {str(r[0]): r[1] for r in snapshots.days(spark, path).collect()} == {"2025-01-01": 1, "2025-02-01": 0}
    assert snapshots.read_snapshots(spark, path, "2025-07-07").count() == 0 and snapshots.quarantined(spark, path, "2025-07-07").count() == 0


def test_quarantine_of_lines(spark, tmp_path):
    """Every line that is no listing is kept with its file and line, also where files are read in many splits."""
    good = json.dumps(listing(url="u", titulo="São"))
    bad = {3: '{"url": "cut', 5: "[" + good + "]", 7: '{"titulo": "x"}', 8: "null", 11: '{"url": "v", "fotos": "no list"}'}
    folder = tmp_path / "snapshot_date=2025-01-01" / "version=1"
    folder.mkdir(parents=True)
    for f in "ab":
        (folder / f"part-{f}.json").write_text("\n".join(bad.get(i, "" if i == 9 else good) for i in range(1, 61)) + "\n")
    commits.commit(spark, str(tmp_path), "2025-01-01", "1")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = snapshots.quarantined(spark, str(tmp_path)).collect()
            assert sorted((r["file"][-6:-5], r["line"], r["record"]) for r in found) == sorted((f, i, t) for f in "ab" for i, t in bad.items())
            assert {r["line"]: r["reason"] for r in found} == {3: "broken", 5: "broken", 7: "no url", 8: "broken", 11: "broken"}
            assert snapshots.read_snapshots(spark, str(tmp_path)).where("url = 'u'").count() == 2 * (60 - 6) == snapshots.read_snapshots(spark, str(tmp_path)).count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    mended = snapshots.quarantined(spark, str(tmp_path)).withColumn("record", F.when(F.col("line") == 3, '{"url": "cut"}').otherwise(F.col("record")))
    assert [(r["url"], str(r["snapshot_date"])) for r in snapshots.read_again(mended).collect()] == [("cut", "2025-01-01")] * 2


def test_records_are_parsed_once(spark, tmp_path):
    """One parse a record, whatever is read of it and filtered by."""
    snapshots.write_snapshot(spark.createDataFrame([("u1", "a"), ("u2", None)], "url string, titulo string"), str(tmp_path), "2025-01-01")
    found = snapshots.read_snapshots(spark, str(tmp_path)).where("titulo is not null").select("url", "titulo", "fotos")
    assert [r["url"] for r in found.collect()] == ["u1"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_quarantine_of_arrays(spark, tmp_path):
    day = lambda d, t: (tmp_path / f"dados_{d}.json").write_text(t)
    day("2025-01-01", json.dumps([listing(url="u1"), {"titulo": "x"}, None, listing(url="u2", fotos=["a"]), {"url": "v", "fotos": 1}], indent=2))
    day("2025-01-02", "[]")
    day("2025-01-03", '[{"url": "cut"')
    path = str(tmp_path)
    assert sorted(r["url"] for r in snapshots.read_snapshots(spark, path, arrays=True).collect()) == ["u1", "u2"]
    found = sorted((str(r["snapshot_date"]), r["line"], r["reason"]) for r in snapshots.quarantined(spark, path, arrays=True).collect())
    assert found == [("2025-01-01", 2, "no url"), ("2025-01-01", 3, "broken"), ("2025-01-01", 5, "broken"), ("2025-01-03", 1, "broken")]
    assert snapshots.newest_date(spark, path) == "2025-01-03" and snapshots.read_snapshots(spark, path, "2025-01-02", arrays=True).count() == 0


def test_searches_find_their_totals(spark):
    pages = stored(spark, (1, "http://a/1", result("http://x/1", total=3)), (2, "http://a/2", result("http://x/2", "http://x/1")), (3, "http://b/1", result("http://x/9")), (4, "http://c/1", result("http://x/2", total=99)), (9, "http://x/1", advert("one")))
    of = collect.searches(spark, ("a", "http://a/{pagina}"), ("b", "http://b/{pagina}"), ("c", "http://c/{pagina}", 1), ("gone", "http://d/{pagina}"), ("less", "http://e/{pagina}", -1), ("same", "http://a/{pagina}", 2))
    totals = {r["search"]: r["total"] for r in collect.with_totals(pages, of).collect()}
    assert totals == {"a": 3, "b": 0, "c": 1, "gone": None, "less": -1, "same": 2}
    frontier = snapshots.search_frontier(collect.with_totals(pages, of))
    assert sorted(map(tuple, frontier.collect())) == [("a", i, f"http://a/{i}") for i in (1, 2, 3)] + [("c", 1, "http://c/1")] + [("same", i, f"http://a/{i}") for i in (1, 2)]
    out = sorted((r["search"], r["page"], r["pos"], r["url"], r["titulo"], r["extract_status"]) for r in collect.collect_listings(pages, of).fillna("", ["titulo"]).collect())
    two = [(1, 0, "http://x/1", "one", "ok"), (2, 0, "http://x/2", "", "no_page"), (2, 1, "http://x/1", "one", "ok")]
    assert out == [("a", *r) for r in two] + [("c", 1, 0, "http://x/2", "", "no_page")] + [("same", *r) for r in two]
    assert collect.collect_listings(pages, of.limit(0)).count() == 0 and collect.collect_listings(pages.limit(0), of).count() == 0


def test_counts_parse_no_advert(spark):
    """Without fields the adverts' pass isn't in the plan at all; with some, the others are null."""
    pages = stored(spark, (9, "u1", advert("one")), (10, "u2", None))
    none = extract_listings(pages, [], failures=True)
    assert "MapInPandas" not in none._jdf.queryExecution().toString() and {r["url"]: r["extract_status"] for r in none.collect()} == {"u1": "ok", "u2": "no_page"}
    assert none.columns == extract_listings(pages, failures=True).columns and [t for _, t in none.dtypes] == [t for _, t in extract_listings(pages, failures=True).dtypes]


def test_written_counts_are_those_of_the_rows(spark, tmp_path):
    """The counts come from the one write, whatever runs below it for the sample of ranges."""
    pages = stored(spark, (1, "http://a/1", result(*(f"http://x/{i}" for i in range(40)), total=2)), (2, "http://a/2", result("http://x/1")), *((100 + i, f"http://x/{i}", advert(i)) for i in range(0, 40, 2)))
    counts = collect.write_collection(pages, collect.searches(spark, ("a", "http://a/{pagina}")), str(tmp_path), "2025-01-01", files=4)
    assert counts == {"n_records": 41, "n_ok": 20, "n_no_page": 21, "n_failed": 0, "n_pages": 2, "n_valid": 0}
    assert snapshots.days(spark, str(tmp_path)).first()["n_records"] == 41
    # files by name have page and link order, and the large page is in several of them
    files = sorted((tmp_path / "snapshot_date=2025-01-01").rglob("part-*.json"))
    urls = [[json.loads(line)["url"] for line in f.read_text().splitlines()] for f in files]
    assert sum(urls, []) == [f"http://x/{i}" for i in range(40)] + ["http://x/1"] and sum(map(bool, urls)) == 4


def test_failed_is_not_absent(spark):
    pages = stored(spark, (1, "u1", advert("a") + "<div><p>Vagas</p></div>" + '<iframe data-testid="map-iframe" src="m"></iframe>' * 2), (2, "u2", '<iframe data-testid="map-iframe"></iframe><ul data-testid="carousel-photos"></ul>'), (3, "u3", None), (4, "u4", advert("d") + '<iframe data-testid="map-iframe" src="m"></iframe>'))
    out = extract_listings(pages, failures=True, rules=FIELDS | {"metragem": Rule("p > b")})
    rows = {r["url"]: r for r in out.collect()}
    assert rows["u1"]["failed"] == {"vagas": "a label without its value", "link_maps": "several elements for one", "metragem": "AttributeError"} and rows["u1"]["titulo"] == "a"
    assert rows["u2"]["failed"] == {"link_maps": "an element without its attribute", "metragem": "AttributeError"} and rows["u3"]["failed"] == {}
    found = {r["field"]: (r["n_ok"], r["n_absent"], r["n_failed"], r["reasons"]) for r in field_outcomes(out).collect()}
    assert found["titulo"] == (2, 1, 0, {}) and found["fotos"] == (0, 3, 0, {}) and found["vagas"] == (0, 2, 1, {"a label without its value": 1})
    assert found["link_maps"] == (1, 0, 2, {"several elements for one": 1, "an element without its attribute": 1}) and found["metragem"] == (0, 0, 3, {"AttributeError": 3})
    # the listings themselves are the same without the channel
    plain = {r["url"]: r for r in extract_listings(pages, rules=FIELDS | {"metragem": Rule("p > b")}).collect()}
    assert all(plain[u][c] == rows[u][c] for u in rows for c in RAW_COLUMNS)
    assert Page("<p>Quartos</p>").get(Rule("b", default="x")) == "x" and "Venda" in OLD_FIELDS["valor_venda"].label


def test_coded_attributes(spark):
    assert Page('<h2 class="text&#45;neutral-130 line-clamp-2">a</h2>').get(FIELDS["titulo"]) == "a"
    assert Page('<b class="olx&#45;core-pagination__button">7</b>').get(LAST_PAGE) == ["7"] and Page('<p class="a&amp;b">x</p>').get(Rule("p.a")) is None
    odd = spark.createDataFrame([(1, '<b class="olx-core-pagination__button">7</b>')], "html int, text string")
    assert select_all(odd, {"t": LAST_PAGE}, ["html"], "text").collect() == [(1, ["7"])]


def test_pages_of_one_address_and_number(spark):
    """Equal address and number, other pages: the one with the least hash, in whatever order they come."""
    rows = [(5, "u", advert(t)) for t in "abcdef"] + [(5, "u", advert("c"))] + [(7, "u", advert("late")), (1, "v", advert("v"))]
    urls = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    seen = {tuple(sorted((r["url"], r["titulo"]) for r in collect.adverts_of(stored(spark, *own).repartition(n), urls).collect())) for own in (rows, rows[::-1]) for n in (1, 5)}
    assert len(seen) == 1 and len(seen.pop()) == 2


def test_salted_join(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CONCAT('k', id % 7) END AS key")
    table = rows.groupBy("key").agg(F.count("*").alias("n")).where("key <> 'k1'").withColumn("wide", F.concat("key", F.lit("!")))
    for how, n in (("left", 5000), ("inner", rows.where("key <> 'k1'").count())):
        out = joins.salted_join(rows, table, "key", how, 100)
        assert out.count() == n == out.select("id").distinct().count() and sorted(out.columns) == ["id", "key", "wide"]
        assert out.where("wide <> concat(key, '!')").count() == 0
    assert joins.salted_join(rows, table, "key", "left", 100).where("wide is null").select("key").distinct().collect() == [("k1",)]
    # sizes beside the table, with hot keys and without
    sizes, wide = rows.groupBy("key").agg(F.count("*").alias("n")), table.drop("n")
    for per_copy in (100, 10_000):
        out = joins.salted_join(rows, wide, "key", "left", per_copy, sizes)
        assert out.columns == ["key", "id", "wide"] and out.count() == 5000 == out.select("id").distinct().count()
        assert out.where("wide is null").select("key").distinct().collect() == [("k1",)] and out.where("wide <> concat(key, '!')").count() == 0


def test_page_store_moves_no_page(spark, tmp_path, monkeypatch):
    """Beyond the broadcast limit pages are joined by shuffles of keys: over a store laid out by address, no exchange lies above the pages' scan."""
    rows = [(1, "http://a/1", result(*(f"http://x/{i}" for i in range(9)), total=1)), *((100 + i, f"http://x/{i}", advert(i)) for i in range(8)), (3, "http://x/1", advert("first"))]
    page_store.write_pages(stored(spark, *rows[:5]), "kept_pages", 4, str(tmp_path / "kept"))
    page_store.add_pages(stored(spark, *rows[5:]), "kept_pages")
    kept = page_store.stored_pages(spark, "kept_pages")
    assert kept.count() == len(rows)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        urls = spark.createDataFrame([(f"http://x/{i}",) for i in range(9)], "url string")
        plans = {}
        for name, pages in (("store", kept), ("files", spark.read.parquet(str(tmp_path / "kept")))):
            out = collect.adverts_of(pages, urls, ["titulo"])
            plans[name] = out._jdf.queryExecution().executedPlan().toString()
            assert {r["url"]: r["titulo"] for r in out.collect()} == {f"http://x/{i}": "first" if i == 1 else str(i) for i in range(8)}
        above = lambda plan: [line for line in _paths_to_scans(plan, "html") if "Exchange" in line]
        assert "Bucketed: true" in plans["store"] and not above(plans["store"]) and above(plans["files"])
        of = collect.searches(spark, ("a", "http://a/{pagina}"))
        assert collect.collect_listings(kept, of).where("titulo is not null").count() == 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE kept_pages")


def _paths_to_scans(plan: str, column: str) -> list[str]:
    """The plan's lines from the root to each scan that reads the column."""
    lines = plan.split("== Initial Plan ==")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    path = []
    for at, found in enumerate(lines):
        if "Scan" in found and f"{column}:string" in found:
            level = depth(found)
            for line in reversed(lines[:at]):
                if depth(line) < level:
                    path.append(line)
                    level = depth(line)
    return path


def test_two_runs_equal_one(spark, tmp_path):
    rows = [(1, "http://a/1", result("http://x/1", "http://x/2", total=3)), (2, "http://a/2", result("http://x/2", "http://x/3")), (3, "http://a/3", result()), *((10 + i, f"http://x/{i}", advert(i)) for i in range(1, 5))]
    of = collect.searches(spark, ("a", "http://a/{pagina}"))
    first, every = stored(spark, rows[0], rows[3]), stored(spark, *rows)
    path = str(tmp_path / "runs")
    assert resume.collected(spark, path).count() == 0
    assert resume.collect_more(first, of, path) == {"n_result_pages": 1, "n_links": 2, "n_adverts": 1}
    assert sorted((r["url"], r["titulo"]) for r in resume.collected(spark, path).fillna("", ["titulo"]).collect()) == [("http://x/1", "1"), ("http://x/2", "")]
    # a run that ends before its commit isn't there
    every.selectExpr("'a' AS search", "page_id AS page", "1 AS pos", "url AS link").write.parquet(f"{path}/links/version=0")
    assert resume.collect_more(every, of, path) == {"n_result_pages": 2, "n_links": 2, "n_adverts": 2}
    assert resume.collect_more(every, of, path) == {"n_result_pages": 0, "n_links": 0, "n_adverts": 0}
    columns = ["search", "page", "pos", *RAW_COLUMNS, "extract_status"]
    plain = lambda df: sorted(map(str, df.select(columns).collect()))
    assert plain(resume.collected(spark, path)) == plain(collect.collect_listings(every, of))
    assert [r["n_adverts"] for r in resume.runs(spark, path).orderBy("run").collect()] == [1, 2, 0]


def test_many_small_rows_are_not_broadcast(spark):
    """Rows whose columns look small to Spark, as most of the table's are null or left out, still meet by a shuffle."""
    rows = spark.range(300).select(F.col("id").cast("string").alias("url"))
    for side in (joins.bounded_broadcast(rows, limit=299), rows.withColumn("n", F.lit(1))):
        out = rows.join(side, "url") if "n" not in side.columns else joins.salted_join(rows, side, "url", "left", total=joins.BROADCAST_ROWS + 1)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and out.count() == 300
    assert joins.dealt(rows, 10 * joins.TASK_ROWS + 1, 4, "url").rdd.getNumPartitions() == 11 and joins.dealt(rows, 5, 4, "url").rdd.getNumPartitions() == 4


def test_adverts_take_no_part_in_the_search_for_result_pages(spark):
    pages = spark.createDataFrame([("http://a/s?p=1",), ("http://a/imovel/1/",), ("http://b/2",), (None,)], "url string")
    found = lambda *t: sorted(r[0] for r in collect.result_pages(pages, collect.searches(spark, *(("s", x, 1) for x in t))).collect() if r[0])
    assert found("http://a/s?p={pagina}", None) == ["http://a/s?p=1"] and found("http://b/{pagina}", "http://a/s?p=1") == ["http://a/s?p=1", "http://b/2"] and found(None) == []
    assert len(found(*(f"http://{i}/" for i in range(collect.BEGINNINGS + 1)))) == 3


def test_many_given_addresses_sort_no_page(spark, monkeypatch):
    monkeypatch.setattr(collect, "ADDRESSES", 3)
    pages = spark.createDataFrame([(f"http://x/{i}", advert(i)) for i in range(9)], "url string, html string")
    out = collect.listings_of(pages, pages.where("url > 'http://x/3'").select("url"), fields=["titulo"], parts=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan and "RoundRobin" not in plan
    assert sorted(r["titulo"] for r in out.collect()) == [str(i) for i in range(4, 9)]


def test_large_days_have_more_files(spark, tmp_path, monkeypatch):
    """A day of many records is sorted in more tasks than the files asked for, and read by name has the same order; places are counted without moving lines."""
    monkeypatch.setattr(snapshots, "TASK_ROWS", 10)
    pages = stored(spark, (1, "http://a/1", result(*(f"http://x/{i}" for i in range(40)), total=2)), (2, "http://a/2", result("http://x/1")))
    collect.write_collection(pages, collect.searches(spark, ("a", "http://a/{pagina}")), str(tmp_path), "2025-01-01", files=2)
    files = sorted((tmp_path / "snapshot_date=2025-01-01").rglob("part-*.json"))
    urls = [[json.loads(line)["url"] for line in f.read_text().splitlines()] for f in files]
    assert sum(urls, []) == [f"http://x/{i}" for i in range(40)] + ["http://x/1"] and sum(map(bool, urls)) >= 4
    lines = spark.read.text(f"{tmp_path}/snapshot_date=*/*").select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    placed = snapshots.with_places(lines, lines)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert [json.loads(r["value"])["url"] for r in sorted(placed.collect(), key=lambda r: r["place"])] == sum(urls, [])


def test_many_links_are_dealt_before_they_are_counted(spark, monkeypatch):
    """No task counts the addresses of a whole split; the pages of the queries are drawn in tasks of bounded rows."""
    links = spark.range(100).select(F.concat(F.lit("u"), F.col("id") % 7).alias("link"))
    plan = lambda: collect.counted_links(links, 100)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan()
    monkeypatch.setattr(joins, "TASK_ROWS", 5)
    assert "hashpartitioning(url" in plan() and ", 20), REPARTITION_BY_NUM" in plan() and plan().count("Exchange") == 1
    assert {r["url"]: r["n"] for r in collect.counted_links(links, 100).collect()} == {f"u{i}": 15 if i < 2 else 14 for i in range(7)}


def test_compressed_days(spark, tmp_path, monkeypatch):
    """Compressed lines are a part of the plain ones' bytes, in files of bounded length, and read the same."""
    monkeypatch.setattr(snapshots, "FILE_ROWS", 300)
    rows = spark.range(0, 1000, 1, 1).select(F.concat(F.lit("http://x/"), "id").alias("url"), F.lit("São").alias("titulo"))
    size, found = {}, {}
    for kind in (None, "gzip"):
        path = tmp_path / str(kind)
        assert snapshots.write_snapshot(rows, str(path), "2025-01-01", compression=kind) == {"n_records": 1000}
        files = [f for f in (path / "snapshot_date=2025-01-01").rglob("part-*")]
        size[kind], found[kind] = sum(f.stat().st_size for f in files), sorted(map(str, snapshots.read_snapshots(spark, str(path)).collect()))
        assert len(files) == (4 if kind else 1)
    assert found[None] == found["gzip"] and size["gzip"] * 5 < size[None] and snapshots.quarantined(spark, str(tmp_path / "gzip")).count() == 0


def test_keys_meet_in_dealt_tasks(spark, monkeypatch):
    """Of many addresses, keys are dealt before they meet, and repeats among the wanted ones give no second page."""
    monkeypatch.setattr(collect, "ADDRESSES", 3)
    met = []
    monkeypatch.setattr(collect, "written", lambda df, name: met.append((name, df._jdf.queryExecution().executedPlan().toString())) or written(df, name))
    pages = stored(spark, *((i, f"http://x/{i}", advert(i)) for i in range(9)))
    urls = pages.select("url").where("page_id > 2").union(pages.select("url").where("page_id = 5"))
    found = collect.one_page_each(pages.union(pages.limit(0)), urls, 4)
    assert sorted(r["url"] for r in found.collect()) == [f"http://x/{i}" for i in range(3, 9)]
    assert "LeftSemi" not in dict(met)["wanted"] and "REPARTITION_BY_NUM" in dict(met)["wanted"]
