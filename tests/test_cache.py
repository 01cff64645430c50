"""The cached build notices new, changed and deleted files."""

import os

import pytest

from curbscope.operators.clean import add_hex_id, clean_violations
from curbscope.plans import cache
from curbscope.plans.build import build_hotspot_table
from curbscope.sources import violations as V
from tests.test_sources import RAW, _write

TAG = '"[""NO PARKING""]"'


def write(path, ids, lat="12.9", day="2024-01-01"):
    with open(path, "w") as f:
        f.write(",".join(RAW) + "\n")
        for i in ids:
            f.write(f"V{i},{lat},77.5,,CAR,{TAG},,{day} 1{i % 10}:00:00+00,PS,J\n")


@pytest.fixture
def opened(monkeypatch):
    """Files whose records are read, request by request."""
    seen = []
    plain = cache.read_violations

    def spy(spark, path, **more):
        seen.append(sorted(f.rsplit("/", 1)[1] for f in path))
        return plain(spark, path, **more)

    monkeypatch.setattr(cache, "read_violations", spy)
    yield seen
    cache.clear()


def table(build):
    return sorted(tuple(r) for r in build.hotspots.drop("tag_breakdown").collect())


def fresh(spark, folder):
    records = add_hex_id(clean_violations(V.read_violations(spark, str(folder))))
    return sorted(tuple(r) for r in build_hotspot_table(records, hexed=True).hotspots.drop("tag_breakdown").collect())


def test_only_new_and_changed_files_are_read(spark, tmp_path, opened):
    for k in range(3):
        write(tmp_path / f"{k}.csv", range(k * 20, k * 20 + 20), lat=f"12.{90 + k}", day=f"2024-01-0{k + 1}")
    first = cache.cached_build(spark, str(tmp_path))
    assert cache.cached_build(spark, str(tmp_path)) is first and opened == [["0.csv", "1.csv", "2.csv"]]
    assert table(first) == fresh(spark, tmp_path)

    write(tmp_path / "3.csv", range(100, 140), lat="12.99", day="2024-02-01")
    second = cache.cached_build(spark, str(tmp_path))
    assert second is not first and opened[1:] == [["3.csv"]]
    assert table(second) == fresh(spark, tmp_path)

    write(tmp_path / "1.csv", range(200, 205), lat="12.95")
    os.utime(tmp_path / "1.csv", (1, 1))
    third = cache.cached_build(spark, str(tmp_path))
    assert opened[2:] == [["1.csv"]] and table(third) == fresh(spark, tmp_path)

    (tmp_path / "0.csv").write_text((tmp_path / "3.csv").read_text())
    (tmp_path / "2.csv").write_text(",".join(RAW) + "\n")
    fourth = cache.cached_build(spark, str(tmp_path))
    assert opened[3:] == [["0.csv", "2.csv"]] and table(fourth) == fresh(spark, tmp_path)


def test_a_deleted_file_is_taken_out_without_reading(spark, tmp_path, opened):
    for k in range(3):
        write(tmp_path / f"{k}.csv", range(k * 20, k * 20 + 20), lat=f"12.{90 + k}")
    cache.cached_build(spark, str(tmp_path))
    kept = tmp_path / "kept"
    kept.mkdir()
    os.replace(tmp_path / "1.csv", kept / "1.txt")   # no longer among the folder's files
    again = cache.cached_build(spark, str(tmp_path))
    assert len(opened) == 1 and table(again) == fresh(spark, tmp_path)


def test_many_additions_are_written_as_one_table(spark, tmp_path, opened, monkeypatch):
    monkeypatch.setattr(cache, "COMPACT", 1)
    for k in range(3):
        write(tmp_path / f"{k}.csv", range(k * 20, k * 20 + 20), lat=f"12.{90 + k}")
        own = cache.source(spark, str(tmp_path))
    assert own.pieces == 1 and len(opened) == 3
    assert {r.file.rsplit("/", 1)[1] for r in own.parts.select("file").distinct().collect()} == {"0.csv", "1.csv", "2.csv"}


def test_builds_of_one_folder_share_its_rollup(spark, tmp_path, opened):
    _write(tmp_path / "none.csv", RAW, [])
    write(tmp_path / "a.csv", range(30))
    a, b = cache.cached_build(spark, str(tmp_path), k_tiers=2), cache.cached_build(spark, str(tmp_path), k_tiers=3)
    assert a is not b and a.rollup is b.rollup and len(opened) == 1


def test_a_folder_without_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        cache.cached_build(spark, str(tmp_path))
