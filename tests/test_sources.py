"""CSV parts, samples, and the command line."""

import pytest

from prismcube import cli
from prismcube.errors import WarehouseError
from prismcube.functions.timedims import TimeEncoding, calendar_day, day_of_year, sunday_week, time_dim
from prismcube.model import AD_EVENTS as M
from prismcube.sources import events as sources

HEAD = "ts,type,auction_id,advertiser_id,publisher_id,bid_price,user_id,total_price,country\n"


@pytest.fixture
def parts(tmp_path):
    (tmp_path / "events_part_00000.csv").write_text(HEAD + "1704103500000,impression,a,1,10,10.5,100,,US\n1709164800000,click,b,,11,,101,,NA\n1735689599000,purchase,c,x7,12,oops,102,99.5,\n")
    (tmp_path / "events_part_00001.csv").write_text(HEAD)
    (tmp_path / "events_part_00002.csv").write_text("country,type,ts\nJP,serve,1704067200000\n")
    return tmp_path


def test_csv_fields(spark, parts):
    got = {r.type: r for r in sources.read_csv(spark, str(parts), M).collect()}
    assert len(got) == 4
    assert got["click"].country == "NA" and got["click"].advertiser_id is None and got["click"].bid_price is None
    assert got["purchase"].advertiser_id is None and got["purchase"].bid_price is None and got["purchase"].total_price == 99.5 and got["purchase"].country is None
    assert got["serve"].country == "JP" and got["serve"].bid_price is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sources.read_csv(spark, str(parts), M, strict=True).collect()
    assert sources.read_csv(spark, str(parts), M, infer=True).count() == 4


def test_missing_folders_and_files(spark, tmp_path):
    for folder in (tmp_path, tmp_path / "none"):
        with pytest.raises(WarehouseError):
            sources.read_csv(spark, str(folder), M)


def test_samples_views_and_conversion(spark, parts, tmp_path):
    e = sources.registered(sources.read_csv(spark, str(parts), M), "ad_events")
    assert spark.sql("select count(*) from ad_events").first()[0] == 4
    assert sources.column_sample(e, "type", 2).count() == 2
    some, factor = sources.row_sample(e, 0.5)
    assert factor == 2 and some.count() <= 4
    sources.convert(e, str(tmp_path / "out.parquet"))
    assert sources.read_parquet(spark, str(tmp_path / "out.parquet")).count() == 4


def test_other_calendar_forms(spark):
    row = spark.sql("select timestamp_ntz '2024-06-02 09:05:00' as ts, timestamp_ntz '2024-12-30 00:00:00' as late")
    got = row.select(day_of_year(row.ts), sunday_week(row.ts), calendar_day(day_of_year(row.ts)), time_dim("week", row.late), time_dim("week", row.late, TimeEncoding.TRUNC)).first()
    assert tuple(got) == ("2024-154", "2024-22", "2024-06-02", "2024-W01", "2024-12-30")


def test_command_line(spark, parts, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    house, queries, out = tmp_path / "house", tmp_path / "queries", tmp_path / "out"
    queries.mkdir()
    (queries / "one.json").write_text('{"select": ["country", {"COUNT": "*"}], "group_by": ["country"], "order_by": [{"col": "country"}]}')
    assert cli.main(["prepare", "--data-dir", str(parts), "--warehouse", str(house)]) == 0
    assert cli.main(["validate", "--warehouse", str(house)]) == 0
    assert cli.main(["run", "--warehouse", str(house), "--query-dir", str(queries), "--output-dir", str(out)]) == 0
    assert cli.main(["baseline", "--data-dir", str(parts), "--query-dir", str(queries), "--output-dir", str(out)]) == 0
    assert (out / "one.csv").read_text().split() == (out / "one_result.csv").read_text().split() == ["country,COUNT(*)", "JP,1", "NA,1", "US,1", ",1"]
    assert cli.main(["profile", "--data-dir", str(parts), "--query-dir", str(queries)]) == 0
    (queries / "two.json").write_text('{"select": ["nope"]}')
    assert cli.main(["run", "--warehouse", str(house), "--query-dir", str(queries), "--output-dir", str(out)]) == 1
    assert cli.main(["prepare", "--data-dir", str(tmp_path / "none"), "--warehouse", str(house)]) == 2
