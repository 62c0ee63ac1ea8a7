import datetime as dt
import json

import pytest

from daymark.sources import files, sinks

D = dt.date


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_price_csv_ignores_vendor_columns(spark, tmp_path):
    path = write(tmp_path, "p.csv", "Date,Open,Close,Volume\n2024-01-03,1,12.5,x\n2024-01-02,1,,y\n")
    rows = {r.date: r.price for r in files.read_price_csv(spark, path).collect()}
    assert rows == {D(2024, 1, 3): 12.5, D(2024, 1, 2): None}


def test_fx_csv_folds_header_case(spark, tmp_path):
    path = write(tmp_path, "f.csv", "DATE;Open;Close\n2024-01-02;1;83.25\n")
    frame = files.read_fx_csv(spark, path)
    assert frame.columns == ["date", "fx"]
    assert frame.first().fx == 83.25


def test_nan_text_becomes_null(spark, tmp_path):
    path = write(tmp_path, "p.csv", "Date,Close\n2024-01-02,NaN\n")
    assert files.read_price_csv(spark, path).first().price is None


def test_empty_source_is_an_error(spark, tmp_path):
    path = write(tmp_path, "p.csv", "Date,Close\n")
    with pytest.raises(ValueError, match="no rows"):
        files.require_rows(files.read_price_csv(spark, path), "price series")


@pytest.mark.parametrize("multi_line", [True, False])
def test_observations_keep_gaps_as_null(spark, tmp_path, multi_line):
    document = {"count": 2, "observations": [{"date": "2024-01-01", "value": "."}, {"date": "2024-01-02", "value": "5.33"}]}
    path = write(tmp_path, "o.json", json.dumps(document, indent=2 if multi_line else None))
    frame = files.read_observations_json(spark, path, multi_line=multi_line)
    assert {r.date: r.rate for r in frame.collect()} == {D(2024, 1, 1): None, D(2024, 1, 2): 5.33}


def test_timeline_is_positional_and_utc(spark, tmp_path):
    point = {"timestamp": "1704067200", "values": [{"query": "a", "extracted_value": 7}, {"extracted_value": 9}]}
    path = write(tmp_path, "t.json", json.dumps({"interest_over_time": {"timeline_data": [point]}}))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = files.read_timeline_json(spark, path).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (row.date, row.trend_a, row.trend_b) == (dt.datetime(2024, 1, 1), 7, 9)


@pytest.mark.parametrize("document", [{}, {"interest_over_time": {}}, {"search": 1}])
def test_absent_timeline_gives_no_rows(spark, tmp_path, document):
    path = write(tmp_path, "t.json", json.dumps(document))
    assert files.read_timeline_json(spark, path).count() == 0


def test_first_record_or_message(spark, tmp_path):
    schema = "model string, accuracy double"
    assert "nothing" in sinks.first_record(spark, str(tmp_path), "nothing", schema)["message"]
    frame = spark.createDataFrame([("m", 0.5)], schema)
    sinks.write_csv(frame, str(tmp_path), "summary")
    sinks.write_csv(frame, str(tmp_path), "summary")
    assert sinks.first_record(spark, str(tmp_path), "summary", schema) == {"model": "m", "accuracy": 0.5}


def test_parquet_sink_partitions_by_year(spark, tmp_path):
    frame = spark.createDataFrame([(D(2020, 5, 1), 1.0), (D(2021, 5, 1), 2.0)], "date date, price double")
    path = sinks.write_parquet(frame, str(tmp_path), "t")
    plan = spark.read.parquet(path).filter("year = 2021")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_csv_columns_by_name_in_each_folder(spark, tmp_path):
    for folder, text in (("a", "Date,Open,Close\n2024-01-02,1,2\n"), ("b", "Close,Date\n3,2024-01-03\n")):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder, "p.csv", text)
    frame = files.read_price_csv(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert {r.date: r.price for r in frame.collect()} == {D(2024, 1, 2): 2.0, D(2024, 1, 3): 3.0}


def test_differing_header_inside_a_folder_is_an_error(spark, tmp_path):
    write(tmp_path, "a.csv", "Date,Open,Close\n2024-01-02,1,2\n")
    write(tmp_path, "b.csv", "Date,Close,Open\n2024-01-03,3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_price_csv(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("token", ["N/A", "NA", "null", "", " NaN "])
def test_missing_tokens_are_null(spark, tmp_path, token):
    path = write(tmp_path, "p.csv", f"Date,Close\n2024-01-02,{token}\n2024-01-03,1\n")
    assert {r.price for r in files.read_price_csv(spark, path).collect()} == {None, 1.0}


def test_other_text_is_an_error(spark, tmp_path):
    path = write(tmp_path, "p.csv", "Date,Close\n2024-01-02,abc\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_price_csv(spark, path).collect()


@pytest.mark.parametrize("text", ['{"observations": [{"date": "2024-01-01", "val', '{"error": "no key"}'])
def test_bad_observation_documents_stop_the_run(spark, tmp_path, text):
    path = write(tmp_path, "o.json", text)
    with pytest.raises(Exception, match="(?i)malformed|observations"):
        files.read_observations_json(spark, path).collect()


def test_cut_off_timeline_stops_the_run_and_fractions_stay(spark, tmp_path):
    bad = write(tmp_path, "t.json", '{"interest_over_time": {"timeline_data": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_timeline_json(spark, bad).collect()
    point = {"timestamp": "1704067200", "values": [{"extracted_value": 7.5}, {"extracted_value": 9}]}
    good = write(tmp_path, "g.json", json.dumps({"interest_over_time": {"timeline_data": [point]}}))
    assert files.read_timeline_json(spark, good).first().trend_a == 7.5


def landed_years(tmp_path, years, suffix, text):
    for year in years:
        folder = tmp_path / f"year={year}"
        folder.mkdir()
        (folder / f"part{suffix}").write_text(text(year))
    return str(tmp_path)


def test_documents_outside_the_range_are_not_opened(spark, tmp_path):
    def text(year):
        if year in (1990, 2003):
            return '{"observations": [{"date": '  # cut off: opening it is an error
        return json.dumps({"observations": [{"date": f"{year}-0{m}-15", "value": str(m)} for m in (1, 5, 9)]})

    path = landed_years(tmp_path, (1990, 2000, 2001, 2002, 2003), ".json", text)
    found = files.read_observations_json(spark, path, multi_line=False, dates=(D(2000, 5, 15), D(2002, 5, 14)))
    assert sorted(r.date for r in found.collect()) == [
        D(2000, 5, 15), D(2000, 9, 15), D(2001, 1, 15), D(2001, 5, 15), D(2001, 9, 15), D(2002, 1, 15),
    ]
    with pytest.raises(Exception):
        files.read_observations_json(spark, path, multi_line=False, dates=(None, D(2002, 5, 14))).collect()
    one = tmp_path / "one.json"
    one.write_text(text(2001))
    assert files.read_observations_json(spark, str(one), dates=(D(2001, 5, 15), None)).count() == 2


def test_timeline_range_counts_the_last_day_to_its_end(spark, tmp_path):
    points = [{"timestamp": str(1704067200 + 3600 * h), "values": [{"extracted_value": h}, {"extracted_value": 0}]} for h in range(0, 72, 6)]
    path = write(tmp_path, "t.json", json.dumps({"interest_over_time": {"timeline_data": points}}))
    found = files.read_timeline_json(spark, path, dates=(D(2024, 1, 1), D(2024, 1, 2)))
    assert sorted(r.trend_a for r in found.collect()) == list(range(0, 48, 6))


def test_csv_folders_of_other_years_are_not_opened(spark, tmp_path):
    def text(year):
        return "Date;Close\n" if year == 1990 else f"Date,Close\n{year}-03-01,{year}.5\n"

    path = landed_years(tmp_path, (1990, 2000, 2001), ".csv", text)
    found = files.read_price_csv(spark, path, dates=(D(2000, 1, 1), None))
    assert sorted((r.date, r.price) for r in found.collect()) == [(D(2000, 3, 1), 2000.5), (D(2001, 3, 1), 2001.5)]


def test_folders_with_one_header_are_one_branch(spark, tmp_path):
    for i in range(12):
        folder = tmp_path / f"day{i:02}"
        folder.mkdir()
        head, row = ("Date,Close", f"2024-01-{i + 1:02},{i}.5") if i % 3 else ("Close,Date", f"{i}.5,2024-01-{i + 1:02}")
        (folder / "a.csv").write_text(f"{head}\n{row}\n")
        (folder / "b.csv").write_text(f"{head}\n")
    frame = files.read_price_csv(spark, str(tmp_path / "*"))
    assert {(r.date.day, r.price) for r in frame.collect()} == {(i + 1, i + 0.5) for i in range(12)}
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
