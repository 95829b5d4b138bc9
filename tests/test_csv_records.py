"""Records with line breaks in quotes, from files cut into small ranges, against the csv module."""

import csv
import io
import random

import pytest

from bazaar.sources.csv import scan_csv
from bazaar.sources.csv_records import ends_open, scan_records, survey

SIZE = "spark.sql.files.maxPartitionBytes"
COST = "spark.sql.files.openCostInBytes"
PARTS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def ranges(spark):
    """Set the size of splits; put everything back afterwards."""
    before = {n: spark.conf.get(n, None) for n in (SIZE, COST, PARTS)}

    def cut(size):
        spark.conf.set(SIZE, str(size))
        spark.conf.set(COST, "1")
        spark.conf.set(PARTS, "1")

    yield cut
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def plain(text, width):
    """What the csv module reads, rows of the wrong length as the scan treats them."""
    found = [r for r in csv.reader(io.StringIO(text, newline="")) if r and not (len(r) == 1 and not r[0].strip())][1:]
    return sorted((tuple(r + [None] * (width - len(r))) for r in found if len(r) <= width), key=str)


def field(draw):
    kind = draw.random()
    if kind < 0.5:
        return draw.choice(["", "x", "名字", "价格 12", 'a"b', "5\" pipe", " ' "])
    inner = "".join(draw.choices(["a", "名", ",", "\n", "\r\n", "\r", '""', " ", "词"], k=draw.randint(0, 30)))
    return f'"{inner}"' + ("tail" if kind > 0.97 else "")


def document(seed, records, end="\n"):
    draw = random.Random(seed)
    rows = [",".join(field(draw) for _ in range(draw.choice([3, 3, 3, 3, 2, 4]))) for _ in range(records)]
    return end.join(["a,b,c", *rows]) + draw.choice(["", end])


@pytest.mark.parametrize("charset", ["utf-8", "gbk", "gb18030"])
def test_five_thousand_records_in_ranges_of_a_kilobyte(spark, tmp_path, rows, ranges, charset):
    text = document(1, 5_000)
    (tmp_path / "raw.csv").write_bytes(text.encode(charset))
    ranges(1024)
    known = survey(spark, str(tmp_path / "raw.csv"))
    assert known.broken and len(known.opens) > 50 and sum(known.opens.values()) > 5
    assert rows(scan_records(spark, str(tmp_path / "raw.csv"), known)) == plain(text, 3)


@pytest.mark.parametrize("size", [40, 170, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_longer_than_ranges(spark, tmp_path, rows, ranges, size, end):
    for seed in (2, 3):
        (tmp_path / f"{seed}.csv").write_text(document(seed, 60, end) + 'x,"' + "long\n" * 200 + '",y\n', newline="")
    wanted = [r for seed in (2, 3) for r in plain((tmp_path / f"{seed}.csv").open(newline="").read(), 3)]
    ranges(size)
    found = rows(scan_csv(spark, str(tmp_path), na_tokens=["none"]))
    assert found == sorted(wanted, key=str)


def test_last_quote_never_closed(spark, tmp_path, rows, ranges):
    text = 'a,b\n1,2\n3,"open\n4,5\n6,7'
    (tmp_path / "raw.csv").write_text(text)
    ranges(12)
    assert rows(scan_csv(spark, str(tmp_path / "raw.csv"))) == plain(text, 2)


def test_byte_order_mark_and_blank_lines(spark, tmp_path, rows, ranges):
    (tmp_path / "raw.csv").write_bytes(b'\xef\xbb\xbfa,b\n\n1,"x\n\ny"\n  \n2,3\n')
    ranges(8)
    found = scan_csv(spark, str(tmp_path / "raw.csv"))
    assert found.columns == ["a", "b"] and rows(found) == [("1", "x\n\ny"), ("2", "3")]


def test_header_over_two_lines(spark, tmp_path, rows):
    (tmp_path / "raw.csv").write_text('"a\nb",c\n1,2\n')
    found = scan_csv(spark, str(tmp_path / "raw.csv"))
    assert found.columns == ["a\nb", "c"] and rows(found) == [("1", "2")]


def test_header_cut_by_a_split_is_an_error(spark, tmp_path, ranges):
    (tmp_path / "raw.csv").write_text('"a\n' + "b\n" * 50 + '",c\n1,2\n')
    ranges(10)
    with pytest.raises(ValueError, match="header"):
        scan_csv(spark, str(tmp_path / "raw.csv"))


def test_changed_splits_are_noticed(spark, tmp_path, ranges):
    (tmp_path / "raw.csv").write_text(document(5, 200))
    ranges(500)
    known = survey(spark, str(tmp_path / "raw.csv"))
    ranges(300)
    with pytest.raises(Exception, match="surveyed"):
        scan_records(spark, str(tmp_path / "raw.csv"), known).count()


def test_files_without_breaks_keep_the_quick_way(spark, tmp_path):
    (tmp_path / "raw.csv").write_text('a,b\n"x,y",1\n')
    plan = scan_csv(spark, str(tmp_path / "raw.csv"))._jdf.queryExecution().toString()
    assert "FileScan csv" in plan and "MapInArrow" not in plan


@pytest.mark.parametrize("line", [
    b'', b'a,b', b'"a",b', b'a,"b', b'"', b'""', b'"a""', b'b"', b'b",c', b'5" x,"y"', b'"a"b"c,d', b'x","y',
    b'a\r"b', b',', b'",', b'"a,"",b', b'""",', b',"",""",', b'x"\r"y', b'"\r\r"a',
])
def test_state_at_the_end_of_a_line(line):
    for before in (b"", b'"'):
        (*_, last) = csv.reader(io.StringIO((before + line + b"\nNEXT").decode(), newline=""))
        assert ends_open(line, bool(before)) == (last != ["NEXT"])
