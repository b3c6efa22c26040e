"""One JSON array per file, cut anywhere."""

import json
import random

import pytest

from weblens.sources.json_arrays import read_json_arrays, walk
from weblens.sources.seeds import read_certificates

SCHEMA = "name_value string, id long, more struct<a: array<long>>"


def records(n, seed=3):
    draw = random.Random(seed)
    parts = ["a.example.org", "}", "{", "},{", '"', "\\", "[", "]", "é", "\n", " ", '"}, {"name_value": "', "x" * 40]
    out = []
    for i in range(n):
        out.append({"name_value": "".join(draw.choice(parts) for _ in range(draw.randint(0, 8))), "id": i, "more": {"a": list(range(i % 4))}})
    return out


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_every_record_once_wherever_the_cuts_are(spark, tmp_path, small_ranges):
    want = []
    for n, layout in enumerate([{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}]):
        rows = records(300, n)
        rows[150]["name_value"] = "}" * 3000 + '"{' * 900  # a record over several ranges
        (tmp_path / f"{n}.json").write_text(json.dumps(rows, **layout) + "\n" * (n % 2))
        want += [(r["name_value"], r["id"], r["more"]["a"]) for r in rows]
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "blank.json").write_text(" [ \n ] ")
    (tmp_path / "nothing.json").write_text("")
    read = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert read.rdd.getNumPartitions() > 50
    got = [(r.name_value, r.id, r.more.a) for r in read_json_arrays(spark, str(tmp_path), SCHEMA).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("text", ['[{"id": 1}, {"id": 2', '[{"id": 1}', '{"id": 1}\n{"id": 2}', '[{"id": "x]'])
def test_broken_files_fail(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="not one whole JSON array"):
        read_json_arrays(spark, str(tmp_path), SCHEMA).collect()


def test_certificates_are_read_by_many_tasks(spark, tmp_path, small_ranges):
    rows = [{"issuer": "{x}", "name_value": f"h{i}.example.org\n*.h{i}.example.org"} for i in range(400)]
    (tmp_path / "dump.json").write_text(json.dumps(rows))
    got = read_certificates(spark, str(tmp_path))
    assert got.columns == ["name_value"]
    assert sorted(r.name_value for r in got.collect()) == sorted(r["name_value"] for r in rows)


def test_walk_is_linear():
    assert walk('"' + "\\\\" * 200_000 + "}" * 200_000, False, 0) == (True, 0)
    assert walk("{" * 100_000 + "]" * 100_000, False, 3) == (False, 3)
