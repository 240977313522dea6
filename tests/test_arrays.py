"""JSON arrays in splits of any size against the whole text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import lines as src
from millrace.sources.arrays import array_elements, first_character


def odd_records(n):
    rng = random.Random(n)
    bits = ["{", "}", "[", "]", '"', "\\", "\n", "é", "𝄞", ", ", ":", "a", " ", '\\"', "}{", "\r\n", " ", "]}"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
    return [{"instruction": text(), "n": {"deep": [{"x": text()}, [], {}]}, "output": text()} if rng.random() < 0.9 else {} for _ in range(n)]


@pytest.mark.parametrize("size, style", [(7, {"indent": 2}), (64, {"separators": (",", ":")}), (1 << 20, {"ensure_ascii": False})])
def test_equals_the_whole_text(spark, tmp_path, monkeypatch, size, style):
    from millrace.sources import arrays

    monkeypatch.setattr(arrays, "SPAN", 50)
    records = {"a.json": odd_records(60), "b.json": odd_records(3), "c.json": []}
    for name, rows in records.items():
        (tmp_path / name).write_bytes(("\n " + json.dumps(rows, **style) + "\n").encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size * 40)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = array_elements(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, rows in records.items():
        own = sorted((r for r in got if r[src.FILE].endswith(name)), key=lambda r: r[src.LINE])
        assert [json.loads(r["value"]) for r in own] == rows and [r[src.LINE] for r in own] == list(range(1, len(rows) + 1))


def test_other_elements_and_bad_files(spark, tmp_path):
    (tmp_path / "mixed.json").write_text('[1, "a {b} \\" c", null, {"instruction": "x"}, true, {"instruction": "y", "more": 1}, 2]')
    (tmp_path / "bad.json").write_text('[{"instruction": "x"}, {"instruction": }, {"instruction": "z"}]')
    (tmp_path / "open.json").write_text('[{"instruction": "x"}, {"instruction": "y"')
    read = lambda name: [r["instruction"] for r in src.json_array(spark, str(tmp_path / name), "instruction string").orderBy(src.LINE).collect()]
    assert read("mixed.json") == ["x", "y"] and read("bad.json") == ["x", "z"] and read("open.json") == ["x"]
    (tmp_path / "nested.json").write_text('[[{"instruction": "x"}], {"instruction": "y"}]')
    with pytest.raises(Exception, match="an array is an element"):
        read("nested.json")


def test_sniffing_reads_the_head(spark, tmp_path):
    (tmp_path / "blank.txt").write_text(" \n" * 5000 + "[1]")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "bom.txt").write_bytes(b"\xef\xbb\xbf{}")
    assert [first_character(spark, str(tmp_path / f"{n}.txt")) for n in ("blank", "empty", "bom")] == ["[", "", "{"]
    folder = tmp_path / "folder"
    spark.range(2).select(F.lit('{"a": 1}').alias("value")).write.text(str(folder))
    assert first_character(spark, str(folder)) == "{" and not src.is_array_file(spark, str(folder))
