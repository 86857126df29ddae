"""Reading folders in which some files hold nothing."""

import json

import pytest

from sensorloom.sources import files


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b c").mkdir()
    (tmp_path / "a" / "good_NO2.csv").write_text("t,v\n2024-01-01 00:00:00,1.5\nnever,2\n2024-01-01 00:05:00,x\n")
    (tmp_path / "a" / "empty_NO2.csv").write_text("")
    (tmp_path / "a" / "header_NO2.CSV").write_text("t,v\n")
    (tmp_path / "a" / "junk_NO2.csv").write_text("t,v\nnever,1\n")
    (tmp_path / "a" / "notes").write_text("x")
    (tmp_path / "b c" / "good é_NO2.json").write_text(json.dumps({"rows": [[1704067200000, 2.5], [1704070800000, None]], "cols": ["t", "v"]}, indent=2))
    (tmp_path / "b c" / "broken_NO2.json").write_text('{"rows": [[17')
    (tmp_path / "b c" / "empty_NO2.json").write_text("")
    (tmp_path / "b c" / "book.xlsx").write_text("PK")
    return tmp_path


def last(path):
    from urllib.parse import unquote

    return unquote(path).rsplit("/", 1)[1]


@pytest.mark.parametrize("globs", [["{0}"], ["{0}/*"], ["{0}/*/*"], ["{0}/a", "{0}/b c/*"]])
def test_every_file_is_read_or_reported(spark, folder, globs):
    good, left_out = files.read_tolerant(spark, [g.format(folder) for g in globs])
    assert sorted(((last(r.path), r.ts.hour, r.ts.minute, r.value) for r in good.collect()), key=str) == [
        ("good é_NO2.json", 0, 0, 2.5), ("good é_NO2.json", 1, 0, None), ("good_NO2.csv", 0, 0, 1.5), ("good_NO2.csv", 0, 5, None),
    ]
    assert {last(r.path): r.reason for r in left_out.collect()} == {
        "empty_NO2.csv": "no row with a timestamp", "header_NO2.CSV": "no row with a timestamp",
        "junk_NO2.csv": "no row with a timestamp", "broken_NO2.json": "no row with a timestamp",
        "empty_NO2.json": "no row with a timestamp", "notes": "unsupported kind: ", "book.xlsx": "unsupported kind: xlsx",
    }


def test_a_folder_without_a_known_kind_gives_no_rows(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    good, left_out = files.read_tolerant(spark, [str(tmp_path)])
    assert good.count() == 0 and [r.reason for r in left_out.collect()] == ["unsupported kind: txt"]
