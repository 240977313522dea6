"""Readers of text sources."""

import json

from millrace.sources import lines as src


def write(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_line_numbers_are_dense_across_splits(spark, tmp_path):
    a = write(tmp_path / "a.txt", *(f"row {k}" for k in range(2000)))
    write(tmp_path / "b.txt", "x", "", "y")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = src.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    own = {r["_line"]: r["value"] for r in rows if r["_file"].endswith(a.rsplit("/", 1)[1])}
    assert own == {k + 1: f"row {k}" for k in range(2000)}
    assert sorted(r["_line"] for r in rows if r["_file"].endswith("b.txt")) == [1, 2, 3]


def test_reasoning_and_chat(spark, tmp_path):
    path = write(tmp_path / "r.jsonl", {"instruction": " a ", "input": None, "output": "o"}, "", "not json", {"instruction": "b"})
    rows = src.reasoning_records(spark, path).orderBy("id").collect()
    assert [(r["id"], r["system"], r["user"], r["assistant_raw"]) for r in rows] == [("chem-0", "a", "", "o"), ("chem-1", "b", "", "")]
    (tmp_path / "c").mkdir()
    write(tmp_path / "c" / "x.jsonl", {"messages": [{"role": "assistant", "content": "x"}, {"role": "user", "content": ""}, {"role": "user", "content": "q"}]}, {"prompt": "p", "output": "o"}, {"prompt": ""})
    rows = src.chat_records(spark, str(tmp_path / "c")).orderBy("id").collect()
    assert [(r["user"], r["assistant_raw"]) for r in rows] == [("q", "x"), ("p", "o")]


def test_other_records(spark, tmp_path):
    lines = write(tmp_path / "q.jsonl", {"instruction": "Q?", "input": " ctx ", "output": "a"}, {"instruction": "no output"})
    array = write(tmp_path / "q.json", [{"instruction": "Z"}, {"instruction": "Y"}])
    users = sorted(r["user"] for r in src.qa_records(spark, [lines], [array], per_file=1).collect())
    assert users == ["Q?ctx", "Z"]
    assert src.sniffed(spark, array, "instruction string").count() == 2
    assert src.sniffed(spark, lines, "instruction string").count() == 2
    m = write(tmp_path / "m.jsonl", {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}], "dataset": "d"}, {"messages": []})
    assert [(r["user"], r["assistant_raw"], r["dataset"]) for r in src.message_records(spark, m, 10).collect()] == [("u", "a", "d")]
    t = write(tmp_path / "t.jsonl", {"text": " x "}, {"text": " "}, {"text": "y", "channel": "c"})
    assert [(r["assistant_raw"], r["channel"]) for r in src.plain_records(spark, t, 10).orderBy("_line").collect()] == [("x", "unknown"), ("y", "c")]
    (tmp_path / "i").mkdir()
    write(tmp_path / "i" / "d.jsonl", {"data": ["System: s", "User: u", "Assistant: a"]}, {"data": ["x"]}, {"instruction": "i", "output": "o"})
    got = sorted((r["system"], r["user"], r["assistant_raw"]) for r in src.instruction_records(spark, [str(tmp_path / "i")]).collect())
    assert got == [("i", "", "o"), ("s", "u", "Assistant: a")]


def test_sections_and_molecules(spark, tmp_path):
    s = write(tmp_path / "s.txt", "=== Line 2 ===", "old", "=== Line 2 ===", "new", "=== Line 5 ===", "five")
    assert {r["line_no"]: r["text"] for r in src.sections(spark, s).collect()} == {2: "new", 5: "five"}
    p = write(tmp_path / "p.txt", "", "a", "", "b")
    assert {r["line_no"]: r["text"] for r in src.sections(spark, p).collect()} == {1: "a", 3: "b"}
    smi = write(tmp_path / "m.smi", "CCO x", "", "CCN")
    assert [(r["id"], r["smiles"]) for r in src.molecules(spark, smi).orderBy("id").collect()] == [("mol_1", "CCO"), ("mol_3", "CCN")]
    assert [r["smiles"] for r in src.smiles_list(spark, smi).orderBy("_index").collect()] == ["CCO x", "CCN"]
    csv = write(tmp_path / "m.csv", "id,smiles", "a,CCO")
    assert src.molecules(spark, csv).first()["smiles"] == "CCO"


def test_sinks(spark, tmp_path):
    report = spark.createDataFrame([(1, None)], "a int, b string")
    src.write_report(report, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first()[0] == '{"a":1,"b":null}'
    src.append_log(report, str(tmp_path / "log"))
    src.append_log(report, str(tmp_path / "log"))
    assert spark.read.schema("a int, b string").json(str(tmp_path / "log")).count() == 2
