"""Pages, merging, status and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pricelens.operators.merge import compact_table, deciding_rows, fold_by_key, merge_into_table, read_merged
from pricelens.plans import ingest, status
from pricelens.sources import pages as pg
from pricelens.streaming import jobs

ROW = """<tr class="searchResultsItem" data-id="9"><td class="searchResultsLargeThumbnail"><img src="i.jpg"></td>
<td class="searchResultsTagAttributeValue"> BMW </td><td class="searchResultsTagAttributeValue">3</td>
<td class="searchResultsTitleValue"><a class="classifiedTitle" href="/x">2015 model &amp; 120.000 km</a></td>
<td class="searchResultsAttributeValue"></td><td class="searchResultsAttributeValue">0</td>
<td class="searchResultsPriceValue"><div class="classified-price-container"><span>1.250.000 TL</span></div></td>
<td class="searchResultsLocationValue">Ankara<br>/ Çankaya</td></tr>"""


def test_result_rows_are_read(spark):
    other = '<tr class="searchResultsItem"><td class="searchResultsTitleValue"><a class="classifiedTitle">no id</a></td></tr>'
    df = spark.createDataFrame([(1, f"<table>{ROW}{other}</table>"), (2, "nothing"), (3, None)], "page_id int, html string")
    (row,) = pg.parse_results(df, "s", base_url="https://h.test/").collect()
    assert (row.source_listing_id, row.title, row.brand, row.series, row.model) == ("9", "2015 model & 120.000 km", "BMW", "3", None)
    assert (row.year, row.mileage_km, row.price, row.city, row.district, row.listing_url) == (2015, 120000, 1250000, "Ankara", "Çankaya", "https://h.test/x")


def test_page_classes(spark):
    pages = {"a": "x BASILI TUT", "b": "Giriş yapmanız gerekmektedir", "c": "ilan yayından kaldırıldı İlan No", "d": "İlan No: 5", "e": ""}
    df = pg.classify_pages(spark.createDataFrame(list(pages.items()), "k string, html string"))
    got = {r.k: (r.status, r.status_reason) for r in df.collect()}
    assert got["b"] == ("unknown", "login_page") and got["c"] == ("removed", "removed_marker") and got["d"] == ("active", "active_marker")
    # a plain capital I does not fold to the dotless letter of the marker
    assert got["a"] == ("unknown", "unrecognized_page") and got["e"] == ("unknown", "unrecognized_page")


LISTING = "source string, source_listing_id string, price bigint, paint_status string, is_clean_claimed int, seq int, id bigint"


def test_merge_policy(spark):
    rows = [("s", "1", 100, "Boyasız", 1, 1, 10), ("s", "1", None, None, 0, 2, 11), ("s", None, 5, None, 0, 1, 12), ("s", None, 5, None, 0, 1, 12)]
    got = sorted(tuple(r) for r in fold_by_key(spark.createDataFrame(rows, LISTING), ["seq"]).collect() if r.source_listing_id)
    assert got == [("s", "1", None, "Boyasız", 1, 2, 10)]
    assert fold_by_key(spark.createDataFrame(rows, LISTING), ["seq"]).where("source_listing_id is null").count() == 2


def test_table_merge_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "raw")
    first = spark.createDataFrame([("s", str(i), i, None, 0, 1, i) for i in range(20)] + [("s", None, 7, None, 0, 1, 99)], LISTING)
    second = spark.createDataFrame([("s", "3", 333, "Boyasız", 1, 2, 500), ("s", "new", 1, None, 0, 2, 501)], LISTING)
    assert tuple(merge_into_table(spark, path, first, ["seq"], 0).first()) == (21, 21, 21)
    assert tuple(merge_into_table(spark, path, second, ["seq"], 1).first()) == (2, 1, 22)
    assert tuple(merge_into_table(spark, path, second, ["seq"], 1).first()) == (2, 0, 22)
    assert tuple(merge_into_table(spark, path, first, ["seq"], 0).first()) == (21, 0, 22)
    for _ in range(2):
        stored = read_merged(spark, path, ["seq"])
        row = stored.where("source_listing_id = '3'").first()
        assert stored.count() == 22 and (row.price, row.id, row.is_clean_claimed) == (333, 3, 1)
        assert compact_table(spark, path, ["seq"]) in (2, 0)
    assert tuple(merge_into_table(spark, path, first, ["seq"], 0).first()) == (21, 0, 22)
    assert read_merged(spark, str(tmp_path / "none"), ["seq"]) is None


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    path = tmp_path / "raw"
    size = lambda: sum(f.stat().st_size for f in path.rglob("*.parquet"))
    rows = lambda a, b, seq: spark.range(a, b, 1, 2).selectExpr("'s' as source", "cast(id as string) as source_listing_id", "id as price", "cast(null as string) as paint_status", "0 as is_clean_claimed", f"{seq} as seq", "id")
    merge_into_table(spark, str(path), rows(0, 200_000, 1), ["seq"], 0)
    large = size()
    assert merge_into_table(spark, str(path), rows(199_900, 200_100, 2), ["seq"], 1).first().added == 100
    assert size() - large < large / 50
    assert merge_into_table(spark, str(path), rows(199_900, 200_100, 2), ["seq"], 1).first().stored == 200_100
    assert read_merged(spark, str(path), ["seq"]).count() == 200_100


def test_unfinished_batch_is_not_read(spark, tmp_path):
    path = tmp_path / "raw"
    one = spark.createDataFrame([("s", "1", 1, None, 0, 1, 1)], LISTING)
    merge_into_table(spark, str(path), one, ["seq"], 0)
    one.withColumn("merge_batch", F.lit(1).cast("long")).write.parquet(f"{path}/batches/batch=1")
    (path / "batches/batch=1/_SUCCESS").unlink()
    assert read_merged(spark, str(path), ["seq"]).count() == 1
    assert merge_into_table(spark, str(path), one.withColumn("price", F.lit(9).cast("long")).withColumn("seq", F.lit(3)), ["seq"], 1).first().stored == 1
    assert read_merged(spark, str(path), ["seq"]).first().price == 9


def test_compaction_keeps_every_deciding_row(spark):
    import random

    rng = random.Random(3)
    rows = [("s", rng.choice(["1", "2", "3", "4", None]), rng.choice([None, rng.randrange(99)]), rng.choice([None, None, "a", "b"]), rng.choice([0, 0, 1, None]), n, n, n % 5) for n in rng.sample(range(300), 120)]
    whole = spark.createDataFrame(rows, LISTING + ", merge_batch bigint")
    fold = lambda df: sorted(map(tuple, fold_by_key(df, ["seq"], first=("merge_batch",)).drop("merge_batch").collect()), key=repr)
    kept = deciding_rows(whole, ["seq"])
    assert fold(kept) == fold(whole) and kept.where("source_listing_id is not null").count() <= 4 * 5
    for cut in (60, 200):  # compacted in steps, in any split
        again = deciding_rows(kept.where(f"seq < {cut}"), ["seq"]).unionByName(kept.where(f"seq >= {cut}"))
        assert fold(again) == fold(whole)


def test_compaction_stores_only_the_newest_row_whole(spark):
    schema = LISTING + ", title string, merge_batch bigint"
    alone = [("s", "1", 5, "a", 1, 7, 70, "only", 2)]
    assert list(map(tuple, deciding_rows(spark.createDataFrame(alone, schema), ["seq"]).collect())) == alone
    # the earliest arrival and an older row with a paint status are left with what they decide
    late = [("s", "2", 1, None, 1, 3, 30, "first", 0), ("s", "2", 2, "b", 0, 4, 40, "second", 1), ("s", "2", 3, None, None, 9, 90, "third", 2)]
    whole = spark.createDataFrame(late, schema)
    kept = deciding_rows(whole, ["seq"])
    assert {r.seq: tuple(r)[2:] for r in kept.collect()} == {
        9: (3, None, 1, 9, None, "third", 2), 4: (None, "b", None, 4, None, None, 1), 3: (None, None, None, 3, 30, None, 0),
    }
    fold = lambda df: list(map(tuple, fold_by_key(df, ["seq"], first=("merge_batch",)).collect()))
    assert fold(kept) == fold(whole) == [("s", "2", 3, "b", 1, 9, 30, "third", 2)]
    # equal orders and nulls in them: an exact tie is settled as in the fold
    tied = spark.createDataFrame([("s", "3", p, s, f, o, i, t, b) for p, s, f, o, i, t, b in [(9, "x", 0, 1, 1, "a", 0), (8, "z", 1, 1, 2, "b", 0), (9, None, 0, 1, 0, "a", 1), (1, "y", None, None, 5, None, 0)]], schema)
    assert fold(deciding_rows(tied, ["seq"])) == fold(tied) == fold(deciding_rows(deciding_rows(tied, ["seq"]), ["seq"]))


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    batches = [[("s", str(i % 7), 10 * b + i, None, 0, b, 100 * b + i) for i in range(9)] for b in range(3)]
    for batch in batches:
        spark.createDataFrame(batch, LISTING).coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.createDataFrame([], LISTING).schema
    arrivals = jobs.read_arrivals(spark, str(folder), schema, files_per_trigger=1)
    checkpoint = jobs.checkpoint_for(str(tmp_path), "merge", days=30)
    jobs.merge_arrivals(arrivals, str(tmp_path / "table"), ["seq", "id"], checkpoint, compact_every=2).awaitTermination()
    streamed = read_merged(spark, str(tmp_path / "table"), ["seq", "id"]).select("source_listing_id", "price", "seq")
    whole = fold_by_key(spark.createDataFrame(sum(batches, []), LISTING), ["seq", "id"]).select("source_listing_id", "price", "seq")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, whole.collect()))


def test_events_behind_the_watermark_are_left_out(spark, tmp_path):
    """Each delivery is one micro-batch; the watermark is a day before the newest event of the earlier ones."""
    deliveries = [
        [(1, "2024-01-01 10:00:00", 1.0), (2, "2024-01-05 12:00:00", 2.0)],
        # behind 4 January noon: the first; the day of the second has not ended yet
        [(3, "2024-01-02 10:00:00", 4.0), (4, "2024-01-04 09:00:00", 8.0), (5, "2024-01-05 13:00:00", 16.0), (2, "2024-01-05 12:00:00", 2.0)],
        [(6, "2024-02-01 00:00:00", 32.0)],
    ]
    schema = "id long, at string, value double"
    held = []
    for rows in deliveries:
        frame = spark.createDataFrame(rows, schema).withColumn("at", F.col("at").cast("timestamp")).coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "in"))
        arrivals = jobs.read_arrivals(spark, str(tmp_path / "in"), frame.schema)
        windows = jobs.upsert_windows(jobs.window_statistics(arrivals, "at", [], "value"), str(tmp_path / "windows"), [], str(tmp_path / "c1"))
        once = jobs.append_to(jobs.without_repeats(arrivals, ["id"], "at", "1 day"), str(tmp_path / "once"), str(tmp_path / "c2"))
        windows.awaitTermination()
        once.awaitTermination()
        held.append(windows.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {str(r.window_start)[:10]: (r["count"], r.maximum) for r in jobs.read_windows(spark, str(tmp_path / "windows"), []).collect()}
    assert got == {"2024-01-01": (1, 1.0), "2024-01-04": (1, 8.0), "2024-01-05": (3, 16.0), "2024-02-01": (1, 32.0)}
    # of the single events, both of 2 January and 4 January 9:00 lie behind noon of 4 January
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "once")).collect()) == [1, 2, 5, 6]
    assert held == [1, 2, 1]  # windows behind the watermark have left the state


def test_checkpoint_follows_its_settings():
    same = [jobs.checkpoint_for("b", "j", days=30, bands="x") for _ in range(2)]
    assert same[0] == same[1] != jobs.checkpoint_for("b", "j", days=7, bands="x")


def test_status_fold(spark):
    t = lambda n: dt.datetime(2026, 1, n)
    events = [(1, "removed", t(1), "a"), (1, "removed", t(2), "b"), (2, "removed", t(1), "a"), (2, "active", t(2), "b"), (2, "unknown", t(3), "c"), (3, "unknown", t(1), "x"),
              (4, "removed", t(1), "a"), (4, "active", t(2), "b"), (4, "removed", t(5), "c")]
    schema = "id int, status string, checked_at timestamp, status_reason string"
    got = {r.id: (r.is_active, r.removed_at, r.status_checked_at, r.status_reason) for r in status.fold_events(spark.createDataFrame(events, schema)).collect()}
    assert got == {1: (0, t(1), t(2), "b"), 2: (1, None, t(3), "c"), 3: (None, None, t(1), "x"), 4: (0, t(5), t(5), "c")}
    halves = spark.createDataFrame([e for e in events if e[2] <= t(2)], schema), spark.createDataFrame([e for e in events if e[2] > t(2)], schema)
    stepped = {r.id: (r.is_active, r.removed_at, r.status_checked_at, r.status_reason) for r in status.fold_events(halves[1], status.fold_events(halves[0])).collect()}
    assert stepped == got


def test_shift_repair_cases(spark):
    rows = [("BMW", "3", "320", None, "Ankara", None), ("BMW", "320", "M", "x", None, None), ("3", "320", "M", None, "Van", "Y"), ("320", "M", None, None, None, None)]
    df = spark.createDataFrame(rows, "brand string, series string, model string, engine string, city string, district string")
    fixed = ingest.repair_shift(df, ingest.PageFilters(brand="BMW", series="3", city="Van"))
    assert [(r.model, r.engine) for r in fixed.collect()] == [("320", None), ("320", "M"), ("320", "M"), ("320", "M")]
    assert [(r.city, r.district) for r in fixed.collect()] == [("Van", "Ankara"), ("Van", None), ("Van", "Y"), ("Van", None)]


def test_recency_keeps_unknown_dates(spark):
    df = spark.createDataFrame([("Bugün",), ("1 Ocak 2020",), ("???",)], "listing_date string")
    marked = ingest.with_recency(df, "2026-07-01", "2026-07-10")
    assert tuple(ingest.batch_counters(marked).first()) == (3, 2, 1, 1)
    assert ingest.keep_recent(marked).count() == 2


def test_recheck_queue_order(spark):
    t = lambda n: dt.datetime(2026, 1, n)
    rows = [(1, "a", "t", "u", t(3), t(1), 1), (2, "b", "t", "u", None, t(2), None), (3, "c", "t", " ", None, t(1), 1), (4, "d", "t", "u", t(2), t(1), 1), (5, "e", "t", "u", None, t(1), 0)]
    df = spark.createDataFrame(rows, "id int, source_listing_id string, title string, listing_url string, status_checked_at timestamp, scraped_at timestamp, is_active int")
    assert [r.id for r in status.recheck_queue(df).collect()] == [2, 4, 1]
    updated = status.apply_status(df.withColumns({"removed_at": F.lit(None).cast("timestamp"), "status_reason": F.lit(None).cast("string")}),
                                  status.fold_events(spark.createDataFrame([(1, "removed", t(9), "gone")], "id int, status string, checked_at timestamp, status_reason string")))
    assert {r.id: r.is_active for r in updated.collect()} == {1: 0, 2: None, 3: 1, 4: 1, 5: 0}


def test_plain_pages_are_read_as_by_the_parser():
    """The walk over plainly written pages gives the parser's rows, and leaves every other page to the parser."""

    def parsed(html):
        parser = pg._ResultRows()
        parser.feed(html)
        parser.close()
        parser._end_row()
        return parser.rows

    for html in (ROW, ROW.replace("<td", "<TD"), ROW.replace("</td>", "</td >"), ROW[:-5], ROW + "<tr class='searchResultsItem' data-id><td>&#65; x", ROW.replace('src="i.jpg"', "src"), ROW.replace("<br>", "<br/><span />")):
        walker = pg._ResultRows()
        assert pg._walk_plain(walker, html)
        walker._end_row()
        assert walker.rows == parsed(html) and walker.rows
    for html in (ROW + "<!-- <td> -->", ROW.replace('"9"', "9"), ROW.replace("<table>", "") + "<script>a</script>", ROW.replace("1.250", "1 < 2"), ROW.replace('"/x"', '"/x?a&amp;b"'), ROW.replace("</a>", "</a x>")):
        walker = pg._ResultRows()
        assert not pg._walk_plain(walker, html) and walker.rows == []
        walker._end_row()
        assert [c[2] for c in pg._cells_of_page("k", html, "")] == [r["id"] for r in parsed(html)]


def test_tags_seen_before_are_not_matched_again():
    """One pattern match for each written tag, and the same cells as by the parser."""
    page = "<table>" + "".join(ROW.replace("<br>", f"<BR/> > {n} ") for n in range(50)) + "</table>"
    plain, parsed = pg._ResultRows(), pg._ResultRows()
    pg._plain_tag.cache_clear()
    assert pg._walk_plain(plain, page) and pg._plain_tag.cache_info().misses < 25
    parsed.feed(page)
    parsed.close()
    assert plain.rows == parsed.rows and len(plain.rows) == 50
    for written in ("<a b", "< td>", "</td >x</td x>", "<script>", "<Titles>", "<td class=x>"):
        assert not pg._walk_plain(pg._ResultRows(), f"<table>{written}</table>")
