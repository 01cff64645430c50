"""CSV/Parquet scans, missing-value spellings, fills, row limit, export."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from curbscope.operators.clean import clean_violations
from curbscope.sources.sinks import export_hotspots_csv, read_hotspots_csv
from curbscope.sources.violations import (MissingColumnsError, read_violations,
                                          read_violations_csv)

HEADER = ("id,latitude,longitude,location,vehicle_type,violation_type,offence_code,"
          "created_datetime,police_station,junction_name,extra")
LINES = [
    'V1,12.97,77.59,loc,CAR,"[""WRONG PARKING"",""NO PARKING""]",112,2024-01-01 10:00:00+00,PS-1,BTP1,x',
    'V2,12.97,77.59,,NA,"[""NO PARKING""]",,2024-01-01 11:00:00+00,None,,x',
    'V3,,77.59,,CAR,"[""NO PARKING""]",,2024-01-01 11:00:00+00,PS-1,BTP1,x',
    'V4,12.97,77.59,,CAR,RIDER NOT WEARING HELMET,,2024-01-01 11:00:00+00,PS-1,BTP1,x',
    'V5,12.97,77.59,,CAR,"[""DOUBLE PARKING""]",,garbage,PS-1,BTP1,x',
    'V6,12.97,77.59,,,WRONG PARKING,,2024-01-01 12:00:00+00,,  NO JUNCTION ,x',
    'V7,abc,77.59,,CAR,"[""NO PARKING""]",,2024-01-01 11:00:00+00,PS-2,BTP1,x',
    'V8,NaN,77.59,,CAR,"[""NO PARKING""]",,2024-01-01 11:00:00+00,PS-2,BTP1,x',
]


@pytest.fixture(scope="module")
def csv_path():
    d = tempfile.mkdtemp(prefix="curbscope-csv-")
    p = os.path.join(d, "v.csv")
    with open(p, "w") as f:
        f.write(HEADER + "\n" + "\n".join(LINES) + "\n")
    return p


def test_csv_scan_and_clean(spark, csv_path):
    raw = read_violations_csv(spark, csv_path)
    assert raw.columns[:10] == ["id", "latitude", "longitude", "location", "vehicle_type",
                                "violation_type", "offence_code", "created_datetime",
                                "police_station", "junction_name"]
    assert "extra" not in raw.columns
    r = {x.id: x for x in raw.collect()}
    assert r["V2"].vehicle_type is None and r["V2"].police_station is None
    assert r["V2"].junction_name is None and r["V2"].location is None
    assert r["V7"].latitude is None          # unparseable number -> NULL
    clean = {x.id: x for x in clean_violations(raw).collect()}
    # V3/V7/V8 no latitude, V4 no parking tag, V5 unparseable time
    assert sorted(clean) == ["V1", "V2", "V6"]
    assert clean["V1"].tags == ["WRONG PARKING", "NO PARKING"] and clean["V1"].severity == 2.0
    assert clean["V1"].hour == 15 and clean["V1"].at_junction is True
    assert clean["V2"].vehicle_type == "Unknown" and clean["V2"].police_station == "Unknown"
    assert clean["V2"].junction_name == "No Junction" and clean["V2"].at_junction is False
    assert clean["V6"].tags == ["WRONG PARKING"] and clean["V6"].at_junction is False


def test_missing_column_is_an_error(spark):
    d = tempfile.mkdtemp(prefix="curbscope-csv-")
    p = os.path.join(d, "bad.csv")
    with open(p, "w") as f:
        f.write("id,latitude\nV1,1.0\n")
    with pytest.raises(MissingColumnsError):
        read_violations_csv(spark, p)


def test_row_limit_before_cleaning(spark, csv_path):
    first = read_violations(spark, csv_path, nrows=3, order_by="id")
    assert [r.id for r in first.collect()] == ["V1", "V2", "V3"]
    assert sorted(r.id for r in clean_violations(first).collect()) == ["V1", "V2"]


def test_parquet_scan(spark, csv_path):
    d = tempfile.mkdtemp(prefix="curbscope-pq-")
    read_violations_csv(spark, csv_path).write.mode("overwrite").parquet(d + "/v")
    raw = read_violations(spark, d + "/v", fmt="parquet")
    assert raw.count() == len(LINES)


def test_export_roundtrip(spark):
    df = spark.createDataFrame([("9:0:0", 3, 1.5, {"A": 2})],
                               "hex_id string, violation_count long, cis double, "
                               "tag_breakdown map<string,bigint>")
    d = tempfile.mkdtemp(prefix="curbscope-exp-") + "/out"
    export_hotspots_csv(df, d)
    back = read_hotspots_csv(spark, d, df)
    assert back.columns == ["hex_id", "violation_count", "cis"]
    assert back.collect()[0].asDict() == {"hex_id": "9:0:0", "violation_count": 3, "cis": 1.5}


def test_cached_build_reuses_tables(spark, csv_path):
    from curbscope.plans import cache

    a = cache.cached_build(spark, csv_path, resolution=9, k_tiers=2)
    b = cache.cached_build(spark, csv_path, resolution=9, k_tiers=2)
    c = cache.cached_build(spark, csv_path, resolution=8, k_tiers=2)
    assert a is b and a is not c
    assert a.hotspots.count() >= 1
    cache.clear()
    assert cache.cached_build(spark, csv_path, resolution=9, k_tiers=2) is not a
    cache.clear()


RAW = ["id", "latitude", "longitude", "location", "vehicle_type", "violation_type",
          "offence_code", "created_datetime", "police_station", "junction_name"]


def _write(path, header, ids):
    row = {"latitude": "12.9", "longitude": "77.5", "location": "", "vehicle_type": "CAR", "violation_type": "[]",
           "offence_code": "", "created_datetime": "2024-01-01 10:00:00+00", "police_station": "PS", "junction_name": "J"}
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for i in ids:
            f.write(",".join(({"id": f"V{i:05d}", "extra": "x"} | row)[c] for c in header) + "\n")


def test_first_rows_in_file_order(spark, tmp_path):
    _write(tmp_path / "b.csv", RAW, range(1000, 3000))
    _write(tmp_path / "a.csv", list(reversed(RAW)), range(0, 1000))
    _write(tmp_path / "c.csv", ["extra", *RAW], range(3000, 3010))
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        for n in (10, 1500, 3005, 9999):
            got = sorted(r.id for r in read_violations(spark, str(tmp_path), nrows=n).collect())
            assert got == [f"V{i:05d}" for i in range(min(n, 3010))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)


def test_columns_are_bound_by_name_in_every_file(spark, tmp_path):
    _write(tmp_path / "a.csv", RAW, range(3))
    _write(tmp_path / "b.csv", ["extra", *reversed(RAW)], range(3, 6))
    rows = read_violations_csv(spark, str(tmp_path)).collect()
    assert sorted(r.id for r in rows) == [f"V{i:05d}" for i in range(6)]
    assert {(r.latitude, r.longitude, r.police_station) for r in rows} == {(12.9, 77.5, "PS")}
    with pytest.raises(Exception, match="(?i)header"):
        read_violations_csv(spark, str(tmp_path), same_header=True).collect()


def test_stream_binds_by_header_or_fails(spark, tmp_path):
    from curbscope.streaming.ingest import violation_stream

    def run(folder, name):
        q = violation_stream(spark, str(folder)).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    one = tmp_path / "one"
    one.mkdir()
    _write(one / "a.csv", ["extra", *RAW], range(4))
    assert sorted((r.id, r.latitude) for r in run(one, "s_one")) == [(f"V{i:05d}", 12.9) for i in range(4)]
    two = tmp_path / "two"
    two.mkdir()
    _write(two / "a.csv", RAW, range(4))
    _write(two / "b.csv", list(reversed(RAW)), range(4))
    with pytest.raises(Exception, match="(?i)header"):
        run(two, "s_two")


def test_export_keeps_blanks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([("9:0:0", ' PS "1" ,x ', 50.0), ("9:0:1", "", 60.0)],
                               "hex_id string, dominant_station string, congestion_impact_score double")
    export_hotspots_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert '" PS ""1"" ,x "' in text and text.index("9:0:1") < text.index("9:0:0")
    back = read_hotspots_csv(spark, str(tmp_path / "out"), df)
    assert ' PS "1" ,x ' in {r.dominant_station for r in back.collect()}


def _jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_headers_of_many_files_are_one_query(spark, tmp_path):
    counts = {}
    for n in (3, 240):
        folder = tmp_path / f"of{n}"
        folder.mkdir()
        for k in range(n):
            _write(folder / f"{k:04d}.csv", RAW if k % 3 else ["extra", *reversed(RAW)], [k])
        (folder / "none.csv").write_text("")
        df, counts[n] = _jobs(spark, f"headers{n}", lambda folder=folder: read_violations_csv(spark, str(folder)))
        rows = df.collect()
        assert sorted(r.id for r in rows) == [f"V{k:05d}" for k in range(n)]
        assert {(r.latitude, r.police_station) for r in rows} == {(12.9, "PS")}
    # Beyond 32 paths Spark lists the files of a scan in a job of its own.
    assert counts[240] <= counts[3] + 2


def test_headers_by_file(spark, tmp_path):
    from curbscope.sources.violations import headers

    _write(tmp_path / "b c.csv", RAW, range(2))
    _write(tmp_path / "a.csv", ["extra", *RAW], range(2))
    (tmp_path / "d.csv").write_text('id,"x, ""y"""\n1,2\n')
    (tmp_path / "e.csv").write_text("")
    found = {h: [f.rsplit("/", 1)[1] for f in files] for h, files in headers(spark, [str(tmp_path)]).items()}
    assert found == {("extra", *RAW): ["a.csv"], tuple(RAW): ["b c.csv"], ("id", 'x, "y"'): ["d.csv"]}


def test_no_header_at_all_is_an_error(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text("")
    with pytest.raises(MissingColumnsError):
        read_violations_csv(spark, str(tmp_path))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_first_rows_read_the_first_files_only(spark, tmp_path, fmt):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(100):
        _write(folder / f"{k:03d}.csv", RAW if k != 1 else list(reversed(RAW)), range(k * 50, k * 50 + 50))
    path = str(folder)
    if fmt == "parquet":
        path = str(tmp_path / "pq")
        whole = read_violations_csv(spark, str(folder))
        whole.repartitionByRange(100, "id").sortWithinPartitions("id").write.parquet(path)
    for n, most in ((1, 1), (50, 1), (60, 3), (120, 4), (9999, 100)):
        df, jobs = _jobs(spark, f"first{fmt}{n}", lambda n=n: read_violations(spark, path, fmt=fmt, nrows=n))
        assert len(df.inputFiles()) <= most and jobs <= 24
        assert sorted(r.id for r in df.collect()) == [f"V{k:05d}" for k in range(min(n, 5000))]

