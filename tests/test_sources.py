import time
from pathlib import Path

import pytest

from bazaar.sinks import emit_table, sink_csv_export, sink_json_snapshot, sink_parquet
from bazaar.session import run_folder, settle
from bazaar.operators.clean import parse_date
from bazaar.sources import csv as csv_source
from bazaar.sources.csv import detect_charset, scan_csv
from bazaar.sources.star import LISTING_COLUMNS, load_sales, turns

LINES = [
    'a,b,c',
    '1,"x,y",z',          # a comma inside quotes
    'short,1',            # padded
    'long,1,2,3',         # left out
    'trailing,1,2,',      # one field too many as well
    '"long, quoted",1,"2,3",4',
    'NA,5d,null',
    '名,"say ""hi""",abc',
    '',
]
EXPECTED = sorted([
    ("1", "x,y", "z"), ("short", "1", None), (None, "5d", None), ("名", 'say "hi"', "abc"),
], key=str)


@pytest.mark.parametrize("encoding", ["utf-8", "gb18030", "gbk"])
def test_csv(spark, tmp_path, rows, encoding):
    path = tmp_path / "raw.csv"
    path.write_bytes("\n".join(LINES).encode(encoding))
    assert detect_charset(spark, str(path)) == ("UTF-8" if encoding == "utf-8" else "GB18030")
    assert rows(scan_csv(spark, str(path))) == EXPECTED
    assert rows(scan_csv(spark, str(path)).select("b")) == sorted([(r[1],) for r in EXPECTED], key=str)
    assert scan_csv(spark, str(path)).count() == len(EXPECTED)


def test_given_charset_is_used(spark, tmp_path, rows):
    path = tmp_path / "raw.csv"
    path.write_bytes("\n".join(LINES).encode("gbk"))
    assert rows(scan_csv(spark, str(path), "gbk")) == EXPECTED
    assert detect_charset(spark, str(path), "utf-8") == "GB18030"


def test_preference_that_cannot_decode_is_passed_over(spark, tmp_path, rows):
    path = tmp_path / "raw.csv"
    path.write_text("a,b\n名字很长,1\n价格,2\n四个字的,3\n")
    assert detect_charset(spark, str(path), "ascii") == "UTF-8"
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    assert rows(scan_csv(spark, str(path), "ascii").select("b")) == [("1",), ("2",), ("3",)]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before


def test_data_that_nothing_decodes_is_an_error(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_bytes(b"a,b\n\xff\xff\xff,1\n")
    with pytest.raises(ValueError, match="GB18030"):
        detect_charset(spark, str(path))


def test_long_quoted_field_in_an_overlong_line(spark, tmp_path, rows):
    path = tmp_path / "raw.csv"
    path.write_text('a,b\n"' + "x, " * 40_000 + '",1,2,3\n4,"' + 'y""' * 30_000 + '"\n')
    (row,) = rows(scan_csv(spark, str(path)))
    assert row[0] == "4" and len(row[1]) == 60_000


def test_line_breaks_inside_quotes(spark, tmp_path, rows):
    path = tmp_path / "raw.csv"
    path.write_text('a,b\n"one\ntwo",3\n4,5\n')
    assert rows(scan_csv(spark, str(path), multi_line=True)) == [("4", "5"), ("one\ntwo", "3")]


@pytest.mark.parametrize("encoding", ["utf-8", "gbk"])
def test_line_breaks_are_found_in_any_charset(spark, tmp_path, rows, encoding):
    path = tmp_path / "raw.csv"
    path.write_bytes('a,b\n"名\n字",3\n4,5\n'.encode(encoding))
    assert rows(scan_csv(spark, str(path))) == [("4", "5"), ("名\n字", "3")]


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([('a"b', "x,y", None, 1.5)], "p string, q string, r string, s double")
    sink_csv_export(df.coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == 'p,q,r,s\n"a""b","x,y",,1.5\n'


def test_csv_export_with_a_byte_order_mark(spark, tmp_path, rows):
    df = spark.createDataFrame([("名", 1), (None, 2)], "p string, q int")
    sink_csv_export(df.coalesce(1), str(tmp_path / "out"), bom=True)
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes() == b"\xef\xbb\xbfp,q\n" + "名,1\n,2\n".encode()


def test_what_a_run_stores_on_the_way_is_removed(spark, tmp_path, rows):
    df = spark.range(9).selectExpr("id AS v")
    with pytest.raises(KeyError):
        with run_folder(spark) as outer:
            with run_folder(spark) as folder:
                stored, _ = settle(df)
                assert str(stored.inputFiles()[0]).removeprefix("file://").startswith(folder.removeprefix("file:"))
                sink_parquet(stored, str(tmp_path / "kept"))
            assert not Path(folder.removeprefix("file://")).exists() and Path(outer.removeprefix("file://")).parent.exists()
            raise KeyError
    assert not Path(outer.removeprefix("file://")).exists()
    assert rows(spark.read.parquet(str(tmp_path / "kept"))) == rows(df)
    later, _ = settle(df)
    assert rows(later) == rows(df)


def test_json_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("名", float("nan"), None)], "k string, v double, w int")
    sink_json_snapshot(df.coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == '{"k":"名","v":null,"w":null}\n'


def test_parquet_and_view(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "2025-08"), (2, "2025-09"), (3, "2025-09")], "v int, stats_month string")
    assert sink_parquet(df, str(tmp_path / "p"), "stats_month") == 3
    assert sorted(d.name for d in (tmp_path / "p").glob("stats*")) == ["stats_month=2025-08", "stats_month=2025-09"]
    stored, count = emit_table(df, "some_table", str(tmp_path / "t"))
    assert count == 3 and rows(spark.table("some_table")) == rows(df) == rows(stored)


def test_rows_of_a_month_are_brought_together_before_their_columns_are_derived(spark, tmp_path, rows):
    sf, by = "/root/testdata/sf0.001", "stats_month"
    plain = load_sales(spark, sf, *LISTING_COLUMNS)
    narrow = load_sales(spark, sf, *LISTING_COLUMNS, together=by)
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS city") < plan.index("AS project_name") < plan.index("RebalancePartitions")
    assert rows(narrow, *LISTING_COLUMNS) == rows(plain, *LISTING_COLUMNS)
    assert sink_parquet(narrow, str(tmp_path / "m"), by, together=True) == plain.count()
    months = list((tmp_path / "m").glob("stats_month=*"))
    assert len(months) == plain.select(by).distinct().count()
    assert all(len(list(m.glob("part-*"))) == 1 for m in months)


def test_utf8_without_quotes_is_read_by_spark_alone(spark, tmp_path, monkeypatch):
    def never(*_):
        raise AssertionError("a survey was made")

    (tmp_path / "plain.csv").write_text("a,b\n城,1\n\n2025/1/5,NA\n", encoding="utf-8")
    monkeypatch.setattr(csv_source, "survey", never)
    found = csv_source.scan_csv(spark, str(tmp_path / "plain.csv"))
    assert sorted(map(tuple, found.collect()), key=str) == [("2025/1/5", None), ("城", "1")]
    (tmp_path / "quoted.csv").write_text('a,b\n"x\ny",1\n', encoding="utf-8")
    (tmp_path / "gb.csv").write_bytes("a,b\n城,1\n".encode("gb18030"))
    for odd in ("quoted.csv", "gb.csv"):
        with pytest.raises(AssertionError):
            csv_source.scan_csv(spark, str(tmp_path / odd))


def test_dates_are_cast_as_they_were_parsed(spark):
    texts = ["2025-1-5", " 2025/01/05 ", "2025-02-30", "2025-13-01", "2024-02-29", "2025-01-05\n", "2025-1-5x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plan = rows.select(parse_date("t").alias("d"))
    found = [str(r["d"]) if r["d"] else None for r in plan.collect()]
    assert found == ["2025-01-05", "2025-01-05", None, None, "2024-02-29", None, None, None]
    assert "gettimestamp" not in plan._jdf.queryExecution().toString().lower()


def _shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(held.size()) if (name := held.apply(i).getName()).startswith("shuffle_")}


def test_a_table_written_in_turns_is_whole_and_leaves_no_shuffles(spark, tmp_path, rows):
    sf, by = "/root/testdata/sf0.001", "stats_month"
    plain = load_sales(spark, sf, *LISTING_COLUMNS)
    parts = turns(spark, sf, rows=2_500)
    assert len(parts) == 3 and turns(spark, sf) == [(0, 1)]
    frames = [load_sales(spark, sf, *LISTING_COLUMNS, together=by, turn=turn) for turn in parts]
    n, before = plain.count(), _shuffle_files(spark)
    assert sink_parquet(frames, str(tmp_path / "m"), by, together=True) == n
    until = time.time() + 20
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.5)
    assert not left
    assert rows(spark.read.parquet(str(tmp_path / "m")), *LISTING_COLUMNS) == rows(plain, *LISTING_COLUMNS)


def test_a_compressed_export_in_turns_is_read_back_whole(spark, tmp_path, rows):
    parts = [spark.createDataFrame([(f"{i}", f'a "b",\nc {i}', None), (f"{i}0", "城", "x,y")], "k string, note string, v string")
             for i in range(1, 4)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sink_csv_export(parts, str(tmp_path / "c"), compression="gzip")
    assert rows(scan_csv(spark, str(tmp_path / "c"))) == rows(whole)
    sink_csv_export(whole.where("v is not null").repartition(1), str(tmp_path / "d"), compression="gzip")
    files = list((tmp_path / "d").glob("part-*"))
    assert files and all(f.name.endswith(".csv.gz") for f in files)
    assert rows(scan_csv(spark, str(tmp_path / "d"))) == rows(whole.where("v is not null"))
