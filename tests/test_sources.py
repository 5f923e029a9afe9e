import json
import random

import pytest

from headwater import lineage_from_files, run_folder
from headwater.operators.numbering import global_row_number
from headwater.operators.prepare import prepare_scripts
from headwater.operators.staging import Stages
from headwater.sources import scripts, sinks


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


def script_folder(tmp_path):
    write(tmp_path, "input.conf", "two.sql\none.sql\nmissing.sql\n")
    write(tmp_path, "sql/one.sql", "#@ title ;\r\nDROP TABLE x.t;\r\nCREATE TABLE x.t AS -- why\r\nSELECT a, b.* FROM ${RAW}.s b;\r\n")
    write(tmp_path, "sql/two.sql", "select c, d from raw.s;\n\n")
    write(tmp_path, "sql/unlisted.sql", "select nope from raw.s;")
    return tmp_path


def test_scan_keeps_line_numbers(spark, tmp_path):
    folder = script_folder(tmp_path)
    lines = scripts.scan_script_lines(spark, str(folder / "sql"), str(folder / "sql"))
    got = [(r.line_no, r.line) for r in lines.where("file = 'one.sql'").orderBy("line_no").collect()]
    assert got == [(0, "#@ title ;"), (1, "DROP TABLE x.t;"), (2, "CREATE TABLE x.t AS -- why"), (3, "SELECT a, b.* FROM ${RAW}.s b;")]
    assert [r.line for r in lines.where("file = 'two.sql'").orderBy("line_no").collect()] == ["select c, d from raw.s;", ""]


def test_byte_ranges_give_the_lines_of_whole_files(spark, tmp_path):
    rng = random.Random(6)
    root = tmp_path / "s"
    for n in range(12):
        body = "".join(rng.choice(["select a", "", "é" * rng.randrange(40), "x;y -- z", "\t "]) + rng.choice(["\n", "\n", "\r\n", "\r"]) for _ in range(rng.choice([0, 1, 3, 400])))
        write(root, f"d{n % 3}/{n}.sql", body + rng.choice(["", "tail"]))
    write(root, "empty.sql", "")
    write(root, "long.sql", "w" * 5000 + "\n" + "v" * 3000)
    whole = spark.read.option("recursiveFileLookup", True).text(str(root), wholetext=True)
    want = scripts.split_script_text(whole.select(scripts._below(scripts.F.col("_metadata.file_path"), str(root)).alias("file"), scripts.F.col("value").alias("body")))
    rows = lambda df: sorted(map(tuple, df.collect()))
    small = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "64"}
    for conf, bound in (({}, scripts.BROADCAST_RANGES), (small, scripts.BROADCAST_RANGES), (small, 0)):
        for k, v in conf.items():
            spark.conf.set(k, v)
        try:
            scripts.BROADCAST_RANGES, kept = bound, scripts.BROADCAST_RANGES
            lines = scripts.scan_script_lines(spark, str(root), str(root))
            assert lines.columns == ["file", "line_no", "line"] and rows(lines) == rows(want)
            assert not conf or lines.where("file = 'long.sql'").count() == 2 and spark.read.text(str(root / "d0")).rdd.getNumPartitions() > 4
        finally:
            scripts.BROADCAST_RANGES = kept
            for k in conf:
                spark.conf.unset(k)


def test_manifest_and_summary(spark, tmp_path):
    folder = script_folder(tmp_path)
    lines = scripts.scan_script_lines(spark, str(folder / "sql"), str(folder / "sql"))
    manifest = scripts.read_manifest(spark, str(folder / "input.conf"))
    assert [(r.file, r.ord) for r in scripts.missing_scripts(lines, manifest).collect()] == [("missing.sql", 2)]
    listed = scripts.manifest_scripts(lines, manifest)
    counts = {r.file: r.n_statements for r in scripts.run_summary(prepare_scripts(listed)).collect()}
    assert counts == {"one.sql": 2, "two.sql": 1, None: 3}


def test_folder_to_viewer_script(spark, tmp_path):
    folder = script_folder(tmp_path)
    out = tmp_path / "data.js"
    result = run_folder(spark, str(folder), str(out))
    body = "".join(p.read_text() for p in sorted(out.glob("part-*")))
    assert body.startswith("var data=")
    data = json.loads(body[len("var data=") :])
    assert len(data["nodes"]) == result.vertices.count() and len(data["edges"]) == result.edges.count()
    assert sorted(n["id"] for n in data["nodes"]) == list(range(1, len(data["nodes"]) + 1))
    label = {n["id"]: n["label"] for n in data["nodes"]}
    assert {n["group"] for n in data["nodes"]} == {"NFDatabase", "NFTable", "NFColumn"}
    links = [(label[e["from"]], label[e["to"]]) for e in data["edges"]]
    assert ("x", "t") in links and links.count(("d", "d")) == 2
    assert "nope" not in label.values()
    run_folder(spark, str(folder), str(out), str(tmp_path / "reports"))
    assert [r.file for r in spark.read.json(str(tmp_path / "reports/missing")).collect()] == ["missing.sql"]


def test_names_are_paths(spark, tmp_path):
    root = tmp_path / "my scripts+100%"
    write(root, "a/job.sql", "create table x.t as\nselect a from r.q;")
    write(root, "b/job.sql", "create table y.u as\nselect b from r.q;")
    write(root, "b/my job.sql", "select c from r.q;")
    write(root, "empty.sql", "")
    lines = scripts.scan_script_lines(spark, str(root), str(root))
    assert {r.file for r in lines.select("file").distinct().collect()} == {"a/job.sql", "b/job.sql", "b/my job.sql"}
    assert {r.file for r in scripts.script_files(spark, str(root), str(root)).collect()} == {"a/job.sql", "b/job.sql", "b/my job.sql", "empty.sql"}
    manifest = spark.createDataFrame([("b/my job.sql", 0), ("a/job.sql", 1), ("empty.sql", 2), ("c.sql", 3)], "file string, ord long")
    result = lineage_from_files(spark, str(root), manifest, str(root))
    names = {r.full_name for r in result.vertices.collect()}
    assert {"r.q.c", "x.t.a"} <= names and "y.u.b" not in names
    assert [r.file for r in result.missing.collect()] == ["c.sql"]


def test_files_without_manifest(spark, tmp_path):
    folder = script_folder(tmp_path)
    names = {r.full_name for r in lineage_from_files(spark, str(folder / "sql")).vertices.collect()}
    assert {"raw.s.nope", "x.t.a", "x.t.d"} <= names


def test_tables_out(spark, tmp_path):
    vertices = spark.createDataFrame([("d:a", "a", "database")], "id string, name string, kind string")
    edges = spark.createDataFrame([("d:a", "d:a", "contains")], "src string, dst string, relation string")
    for _ in range(2):
        sinks.write_graph_tables(vertices, edges, str(tmp_path / "g"))
    assert [r.value for r in spark.read.text(str(tmp_path / "g/nodes")).collect()] == ['{"id":"d:a","label":"a","group":"NFDatabase"}']
    assert spark.read.json(str(tmp_path / "g/edges")).columns == ["from", "to"]


def test_a_failed_write_keeps_the_old_output(spark, tmp_path):
    out = str(tmp_path / "deep/graph")
    good = lambda text: lambda folder: spark.createDataFrame([(text,)], "value string").write.text(folder)
    read = lambda: [r.value for r in spark.read.text(out).collect()]

    def breaks(folder):
        good("half")(folder)
        raise ValueError("stopped")

    with pytest.raises(ValueError):
        sinks.replace_folder(spark, out, breaks)
    assert not (tmp_path / "deep/graph").exists()
    sinks.replace_folder(spark, out, good("one"))
    with pytest.raises(ValueError):
        sinks.replace_folder(spark, out, breaks)
    assert read() == ["one"]
    # Killed between the two renames: the old folder stands aside, and the next run puts it back first.
    (tmp_path / "deep/graph").rename(tmp_path / "deep/graph.replaced")
    with pytest.raises(ValueError):
        sinks.replace_folder(spark, out, breaks)
    assert read() == ["one"]
    sinks.replace_folder(spark, out, good("two"))
    assert read() == ["two"] and sorted(p.name for p in (tmp_path / "deep").iterdir()) == ["graph"]


def test_numbers_whatever_the_columns_are_called(spark):
    names = ["place", "range_no", "in_range", "offset", "row", "n", "k.v"]
    rows = [tuple(range(i, i + len(names))) for i in range(50)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` long" for n in names))
    for name in ("row_number", *names[1:6]):
        out = global_row_number(df, ["place"], name)
        assert sorted(out.columns) == sorted({*names, name})
        assert [r[name] for r in out.orderBy("place").collect()] == list(range(1, 51))
    assert [r.place for r in global_row_number(df, ["n"], "place").orderBy("n").collect()] == list(range(1, 51))


def test_stages_replace_and_append(spark, tmp_path):
    stages = Stages(spark, str(tmp_path / "s"))
    stages.create("t", spark.range(3).toDF("a"))
    assert stages.create("t", spark.range(2).toDF("a")).count() == 2
    assert stages.insert("t", spark.range(5).selectExpr("'x' AS b", "id AS a")).count() == 7
