"""Whole runs: sources on disk, recipes, phases, artefacts, streams and the command line."""

import csv
import io
import json
import sqlite3
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import yaml

from matchloom import cli
from matchloom.operators import joins, profile, resolve
from matchloom.plans import pipeline, recipe as recipes
from matchloom.sinks import frames, profile_report, summary, xlsx
from matchloom.sources import files
from matchloom.streaming import matching as streaming

VENDORS = """vendor id,Entity.Name,addr,group id
V1,"Acme, Inc.",1 main st,G1
V2,ACME INC,9 oak ave,G1
V3,"Beta ""B"" Ltd",2 elm rd,G2
V4,Gamma,,G3
V5,,4 x st,
"""
TRUSTED = """dest_id,dest_name,supplier_id,addr
D1,acme inc,S1000,1 main st
D2,Acme Inc,S500,9 oak ave
D3,"beta ""b"" ltd",UNKNOWN,2 elm road
"""
RECIPE = {
    "name": "Run me", "description": "a test", "sources": {"v": {"file": "vendors.csv"}, "t": {"file": "trusted.csv"}},
    "populations": {"all": {"source": "v", "record_key": "vendor id", "filter": [{"field": "vendor id", "op": "starts_with", "value": "V"}]}},
    "steps": [
        {"name": "exact", "source": "all", "destination": "t", "match_fields": [{"source": "Entity.Name", "destination": "dest_name", "method": "exact", "tiers": ["raw", "clean"]}], "inherit": [{"source": "supplier_id", "as": "derived"}]},
        {"name": "fuzzy", "source": "all", "destination": "t", "match_fields": [{"source": "Entity.Name", "destination": "dest_name", "method": "fuzzy", "threshold": 90, "tiers": ["clean"]}], "inherit": [{"source": "supplier_id", "as": "derived"}]},
    ],
    "output": {
        "format": ["csv", "parquet"], "summary": ["md"], "matched_unmatched": ["separate", "merged"], "tie_breaker": {"column": "supplier_id", "strip_prefix": "alpha"},
        "final_rollup": [{"group_key": "group id", "target": "derived", "strip_prefix": "alpha", "write_to": "rolled"}],
        "decision_record": {"candidates": ["derived", "group id"], "write_to": "decided"},
        "columns": {"matched": [{"field": "vendor id", "header": "Vendor"}, {"field": "Entity.Name", "header": "Name"}, {"field": "derived"}, {"field": "rolled"}, {"field": "decided"}, {"field": "match_step"}]},
    },
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "vendors.csv").write_text(VENDORS)
    (tmp_path / "trusted.csv").write_text(TRUSTED)
    (tmp_path / "r.yaml").write_text(yaml.safe_dump(RECIPE, sort_keys=False))
    return tmp_path


def read_csv(path):
    return list(csv.reader(io.StringIO(path.read_text())))


def test_all_artefacts(spark, folder):
    made = cli.run_recipe(spark, folder / "r.yaml", str(folder), str(folder / "out" / "res.csv"))
    names = sorted(p.name for p in made)
    assert names == sorted(["res.csv", "res_merged.csv", "res_unmatched.csv", "res.parquet", "res_merged.parquet", "res_unmatched.parquet", "res_summary.md"])
    rows = read_csv(folder / "out" / "res.csv")
    assert rows[0] == ["Vendor", "Name", "derived", "rolled", "decided", "match_step"]
    assert rows[1:] == [["V1", "Acme, Inc.", "S500", "S500", "S500", "exact"], ["V2", "ACME INC", "S500", "S500", "S500", "exact"], ["V3", 'Beta "B" Ltd', "UNKNOWN", "UNKNOWN", "UNKNOWN", "exact"]]
    merged = read_csv(folder / "out" / "res_merged.csv")
    assert merged[4:] == [["V4", "Gamma", "", "", "G3", "unmatched", "true"], ["V5", "", "", "", "", "unmatched", "true"]]
    missed = read_csv(folder / "out" / "res_unmatched.csv")
    assert [r[0] for r in missed[1:]] == ["V4", "V5"] and missed[1][missed[0].index("reason_code")] == "no_name_match"
    text = (folder / "out" / "res_summary.md").read_text()
    assert "**Matched:** 3 of 5 (60.0%)" in text and "```mermaid" in text
    assert summary.read_echo(text.split("```yaml\n")[1].split("```")[0]) == RECIPE
    again = folder / "again.csv"
    cli.run_recipe(spark, folder / "r.yaml", str(folder), str(again))
    assert again.read_bytes() == (folder / "out" / "res.csv").read_bytes(), "runs are byte-identical"


def test_workbook(spark, folder):
    over = {"format": "xlsx", "summary": ["xlsx"], "matched_unmatched": "separate", "compare_columns": [{"left": "derived", "right": "group id", "output": "cmp"}]}
    r = RECIPE | {"output": {**RECIPE["output"], **over, "columns": {"matched": [*RECIPE["output"]["columns"]["matched"], {"field": "cmp"}]}}, "normalization": {"stopwords": "stop.json"}}
    (folder / "stop.json").write_text('{"name": ["x"]}')
    (folder / "x.yaml").write_text(yaml.safe_dump(r, sort_keys=False))
    made = cli.run_recipe(spark, folder / "x.yaml", str(folder), str(folder / "res.xlsx"))
    book = xlsx.read(made[0])
    assert list(book) == ["Summary", "Matched", "Analysis", "Recipe", "Stopwords"]
    assert book["Matched"][1][:2] == ["V1", "Acme, Inc."] and book["Matched"][1][-1] == "higher"
    assert summary.read_echo("\n".join(x[0] or "" for x in book["Recipe"])) == r
    assert [x[0] for x in book["Stopwords"]] == ['{"name": ["x"]}']


def test_zero_rows_have_headers(spark, folder):
    (folder / "trusted.csv").write_text(TRUSTED.splitlines()[0] + "\n")
    result = pipeline.run(spark, RECIPE, str(folder))
    frames.write(result.matched, folder / "m.csv", "csv")
    assert read_csv(folder / "m.csv")[0][0] == "vendor id" and len(read_csv(folder / "m.csv")) == 1
    assert result.stats()["matched_count"] == 0 and result.stats()["unmatched_count"] == 5


PHASES = {
    "name": "chain", "sources": {"v": {"file": "v.csv"}, "l": {"file": "l.csv"}, "r": {"file": "r.csv"}},
    "phases": [
        {"name": "Entity", "populations": {"p": {"source": "v", "record_key": "id"}}, "steps": [{"name": "to lei", "source": "p", "destination": "l", "match_fields": [{"source": "name", "destination": "legal", "tiers": ["clean"]}]}]},
        {"name": "Parent", "populations": {"q": {"source": "_previous_matched", "record_key": "id"}}, "steps": [{"name": "to parent", "source": "q", "destination": "r", "match_fields": [{"source": "lei", "destination": "child", "tiers": ["raw"]}]}]},
        {"name": "Name", "populations": {"s": {"source": "_previous_matched", "record_key": "id"}}, "steps": [{"name": "to name", "source": "s", "destination": "l", "match_fields": [{"source": "parent", "destination": "lei", "tiers": ["raw"]}], "inherit": [{"source": "legal", "as": "parent_name"}]}], "output": {"format": "csv"}},
    ],
}


def test_phases_chain_and_recover(spark, tmp_path):
    (tmp_path / "v.csv").write_text("id,name\n1,Alpha\n2,Beta\n3,Nobody\n4,Delta\n")
    (tmp_path / "l.csv").write_text("lei,legal\nL1,ALPHA\nL2,Beta\nL4,delta\nP1,Parent One\n")
    (tmp_path / "r.csv").write_text("child,parent\nL1,P1\nL4,P9\n")
    result = pipeline.run(spark, PHASES, str(tmp_path))
    got = {r["id"]: (r["match_step"], r["parent"], r["parent_name"]) for r in result.matched.collect()}
    assert got == {"1": ("to name", "P1", "Parent One"), "2": ("to lei", None, None), "4": ("to lei", None, None)}
    assert [r["id"] for r in result.unmatched.collect()] == ["3"]
    s = result.stats()
    assert [(p["input_count"], p["matched_count"]) for p in s["phases"]] == [(4, 3), (3, 2), (2, 1)]
    assert "lei_dst" in result.matched.columns and "subgraph" in summary.mermaid(PHASES, s)
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(PHASES, sort_keys=False))
    made = cli.run_recipe(spark, tmp_path / "p.yaml", str(tmp_path), str(tmp_path / "o.csv"))
    assert len(read_csv(made[0])) == 4


def test_a_phase_without_input_is_skipped(spark, tmp_path):
    (tmp_path / "v.csv").write_text("id,name\n3,Nobody\n")
    (tmp_path / "l.csv").write_text("lei,legal\nL1,ALPHA\n")
    (tmp_path / "r.csv").write_text("child,parent\nL1,P1\n")
    result = pipeline.run(spark, PHASES, str(tmp_path))
    assert result.matched.count() == 0 and result.unmatched.count() == 1 and len(result.phases) == 3


def test_enriched_output(spark, folder):
    r = RECIPE | {"output": {"format": "csv", "mode": "enriched", "enrich_source": "v", "enrich_key": "vendor id"}}
    (folder / "e.yaml").write_text(yaml.safe_dump(r, sort_keys=False))
    rows = read_csv(cli.run_recipe(spark, folder / "e.yaml", str(folder), str(folder / "e.csv"))[0])
    assert [x[0] for x in rows[1:]] == ["V1", "V2", "V3", "V4", "V5"] and "dest_id" in rows[0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\t\n\"\"\tz\n")
    rows = [tuple(r) for r in files.load(spark, {"file": "a.tsv"}, tmp_path).collect()]
    assert rows == [("1", None), ("", "z")], "quoted empty stays empty, unquoted empty is null"
    (tmp_path / "b.jsonl").write_text('{"x": 1, "y": true}\n{"x": 2}\n')
    assert sorted(tuple(r) for r in files.load(spark, {"file": "b.jsonl"}, tmp_path).collect()) == [("1", "true"), ("2", None)]
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("create table t (a int, b text)")
        db.execute("insert into t values (1, null), (2, 'x')")
    spec = {"loader": "sql", "driver": "sqlite", "connection": {"database": "d.db"}, "query": "select * from t", "cache_ttl": "off"}
    assert sorted(tuple(r) for r in files.load(spark, spec, tmp_path).collect()) == [("1", None), ("2", "x")]
    assert files.load(spark, spec | {"query": "select * from t where a > 5", "columns": ["b"]}, tmp_path).columns == ["b"]
    with pytest.raises(ValueError, match="unknown loader"):
        files.load(spark, {"loader": "ftp"})


def test_source_cache(spark, tmp_path):
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("create table t (a int)")
        db.execute("insert into t values (1)")
    spec = {"loader": "sql", "driver": "sqlite", "connection": {"database": "d.db", "password": "p"}, "query": "select * from t", "cache_ttl": "1h"}
    assert files.load(spark, spec, tmp_path).count() == 1
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("insert into t values (2)")
    assert files.load(spark, spec, tmp_path).count() == 1
    assert files.load(spark, spec | {"cache_ttl": "0.000001s"}, tmp_path).count() == 2
    assert files.cache_key(spec) == files.cache_key(spec | {"connection": {"database": "d.db", "password": "q"}}) != files.cache_key(spec | {"query": "x"})


def test_http(spark, tmp_path):
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("__MACOSX/big.csv", "x" * 9999)
        z.writestr("small.csv", "a\n9\n")
        z.writestr("large.csv", "a,b\n1,2\n3,4\n")
    pages = {"http://m": (b'{"data": [{"url": "http://f/x.zip"}]}', "application/json"), "http://f/x.zip": (archive.getvalue(), ""), "http://j": (b'[{"a": 1}]', "application/json; charset=utf-8")}
    get = lambda url, *_: pages[url]
    spec = {"loader": "http", "url_from": {"endpoint": "http://m", "json_path": "data[0].url"}, "cache_ttl": "off"}
    assert sorted(tuple(r) for r in files.load(spark, spec, tmp_path, get=get).collect()) == [("1", "2"), ("3", "4")]
    assert [tuple(r) for r in files.load(spark, spec | {"zip_entry": "small.csv"}, tmp_path, get=get).collect()] == [("9",)]
    assert [tuple(r) for r in files.load(spark, {"loader": "http", "url": "http://j", "cache_ttl": "off"}, tmp_path, get=get).collect()] == [("1",)]
    with pytest.raises(ValueError, match="nothing at"):
        files.json_path({"a": []}, "a[0]")


def test_small_source_helpers(monkeypatch):
    monkeypatch.setenv("ML_X", "v")
    assert files.interpolate({"a": ["${ML_X}", "${ML_NONE}"]}) == {"a": ["v", "${ML_NONE}"]}
    assert [files.parse_ttl(x) for x in ("30s", "5m", "2h", "1d", "off", None)] == [30, 300, 7200, 86400, None, 86400]
    assert [files.detect_format(*x) for x in (("http://a/b.tsv?x=1", ""), ("http://a", "application/json"), ("http://a", None))] == ["tsv", "json", "csv"]
    o = files.jdbc_options({"driver": "trino", "query": "q", "connection": {"host": "h", "catalog": "c", "schema": "s", "http_scheme": "https", "verify": False, "password": "p"}})
    assert o["url"] == "jdbc:trino://h:8080/c/s?SSL=true&SSLVerification=NONE&sessionProperties=spooling_enabled:true"
    monkeypatch.setenv("TRINO_SPOOLING_ENABLED", "false")
    o = files.jdbc_options({"driver": "trino", "query": "q", "connection": {"host": "h", "session_properties": {"a": "b"}}})
    assert o["url"].endswith("?sessionProperties=spooling_enabled:false;a:b")
    o = files.jdbc_options({"driver": "postgres", "query": "SELECT 1", "connection": {"host": "h", "database": "d"}, "partition": {"column": "id", "lower": 0, "upper": 100, "count": 8}})
    assert (o["dbtable"], o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("(SELECT 1) q", "id", "0", "100", "8") and "query" not in o
    assert files.jdbc_options({"driver": "postgres", "query": "q", "connection": {"host": "h", "database": "d"}})["url"] == "jdbc:postgresql://h:5432/d"
    with pytest.raises(ValueError, match="environment variables"):
        files.jdbc_options({"driver": "trino", "query": "q", "connection": {"host": "${ML_NONE}"}})


def test_a_filter_on_a_missing_column_stops_the_run(spark, folder):
    bad = RECIPE | {"populations": {"all": {"source": "v", "record_key": "vendor id", "filter": [{"field": "gone", "op": "is_null"}]}}}
    with pytest.raises(recipes.RecipeError, match="no column 'gone'"):
        pipeline.run(spark, bad, str(folder))


def test_dry_run(spark, folder):
    text, ok = cli.dry_run(spark, folder / "r.yaml", str(folder))
    assert ok and text.endswith("valid")
    (folder / "vendors.csv").write_text("other\n1\n")
    text, ok = cli.dry_run(spark, folder / "r.yaml", str(folder))
    assert not ok and "there is no column 'Entity.Name'" in text


def test_profile_reports(spark, folder):
    df = files.load(spark, {"file": "vendors.csv"}, folder)
    assert profile.pick_columns(df, "auto") and profile.pick_columns(df, "addr, group id") == ["addr", "group id"]
    with pytest.raises(ValueError, match="no such columns"):
        profile.pick_columns(df, "zz")
    results = profile.analyze(df, ["Entity.Name", "addr"])
    assert results["data_quality"][0]["null_count"] == 1
    assert {"tok": "inc", "count": 2} in results["columns"]["Entity.Name"]["top_tokens_clean"]
    text = profile_report.markdown(results, "f", ["quality", "tokens"])
    assert "## Data quality" in text and "Bigrams" not in text
    profile_report.workbook(results, folder / "p.xlsx")
    assert list(xlsx.read(folder / "p.xlsx")) == ["Summary", "Top Tokens", "Aliases", "Near Duplicates", "Token Profile", "Unicode"]
    profile_report.sidecars(results, folder / "s")
    assert "inc" in json.loads((folder / "s" / "stopwords.json").read_text())[results["columns"]["Entity.Name"]["detected_type"]]
    json.dumps(results)


def test_streams(spark, folder, tmp_path_factory):
    spool = tmp_path_factory.mktemp("spool")
    batch = files.load(spark, {"file": "vendors.csv"}, folder)
    batch.write.mode("overwrite").parquet(str(spool / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(spool / "in"))
    trusted = files.load(spark, {"file": "trusted.csv"}, folder)
    q = streaming.exact_stream(stream, trusted, "Entity.Name", "dest_name").writeStream.format("memory").queryName("ml_stream").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["vendor id"], r["dest_id"]) for r in spark.table("ml_stream").collect()) == [("V1", "D1"), ("V1", "D2"), ("V2", "D1"), ("V2", "D2"), ("V3", "D3")]
    seen = []
    sink = lambda m, u, n: seen.append((m.count(), u.count(), n))
    q = streaming.run_recipe(stream, recipes.with_defaults(RECIPE), "v", {"t": trusted}, sink).option("checkpointLocation", str(spool / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [(3, 2, 0)]


def test_public_frames_hide_inner_columns(spark, folder):
    result = pipeline.run(spark, RECIPE, str(folder))
    assert not [c for c in resolve.public(result.matched).columns if c.startswith("_")]


@pytest.mark.parametrize("fmt", ["csv", "jsonl", "parquet"])
def test_rows_of_many_files_know_their_positions(spark, tmp_path, fmt):
    """200 files, short ones before long ones, the long ones of several splits: positions follow names and rows, not sizes."""
    folder, want = tmp_path / "in", []
    folder.mkdir()
    for k in range(200):
        rows = [f"{k:03}-{i:05}" for i in range(1 + (k * 7919) % 40 + (3000 if k % 50 == 3 else 0))]
        want += rows
        if fmt == "csv":
            (folder / f"{k:03}.csv").write_text("id,name\n" + "".join(f"{x},same\n" for x in rows))
        elif fmt == "jsonl":
            (folder / f"{k:03}.jsonl").write_text("".join(json.dumps({"id": x, "name": "same"}) + "\n" for x in rows))
        else:
            pq.write_table(pa.table({"id": rows, "name": ["same"] * len(rows)}), folder / f"{k:03}.parquet", row_group_size=500)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = files.load(spark, {"file": "in", "format": fmt, "multiline": False, "columns": ["name", "id"]}, str(tmp_path), positions=True)
        assert df.columns == ["name", "id", joins.POS]
        got = df.collect()
        assert len(got) == len(want) and all(want[r[joins.POS]] == r["id"] for r in got)
        one = spark.createDataFrame([("x", "same")], "k string, name string")
        assert joins.exact(one, df, "name", "name", key="k").first()["id"] == "000-00000"
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
        if fmt == "parquet":
            assert all(want[r[joins.POS]] == r["id"] for r in df.select("id", joins.POS).collect())  # rows are numbered in the file itself
        else:
            with pytest.raises(Exception, match="splits have changed"):
                df.select("id", joins.POS).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert joins.POS not in files.load(spark, {"file": "in", "format": fmt}, str(tmp_path)).columns


def test_a_cache_that_was_not_finished_is_not_read(spark, tmp_path):
    spec = {"loader": "http", "url": "http://here/n.csv", "cache_ttl": "1h"}
    path = files.cache_path(spec, str(tmp_path), "r", "s")
    path.mkdir(parents=True)
    pq.write_table(pa.table({"id": ["half"]}), path / "part-00000.parquet")
    load = lambda body: [r["id"] for r in files.load(spark, spec, str(tmp_path), "r", "s", get=lambda *_: (body, "text/csv")).collect()]
    assert load(b"id\n1\n2\n") == ["1", "2"]
    assert load(b"id\nother\n") == ["1", "2"]
    assert [p.name for p in path.parent.iterdir()] == [path.name]


def test_long_cells_go_on_in_a_sheet_of_their_own(tmp_path):
    texts = ["&" * 40_000, "a" * 32_765 + "&&&", "😀" * 20_000, "short", float("nan"), "<" * 32_700, "x\x00" * 40_000]
    with xlsx.Workbook(tmp_path / "b.xlsx") as book:
        book.sheet("Data", [["text"], *[[t] for t in texts]])
    sheets = xlsx.read(tmp_path / "b.xlsx")
    cells = [r[0] for r in sheets["Data"][1:]]
    for sheet, cell, _, text in sheets[xlsx.LONG][1:]:
        assert sheet == "Data" and len(text.encode("utf-16-le")) <= 2 * 32_767
        cells[int(cell[1:]) - 2] += text
    mark = xlsx.MORE.format(xlsx.LONG)
    assert [str(c).replace(mark, "") for c in cells] == [str(t).replace("\x00", "") for t in texts]
    assert all(len(str(r[0]).encode("utf-16-le")) <= 2 * 32_767 for r in sheets["Data"])


def test_large_csv_files_are_split_unless_fields_go_over_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "WHOLE_BYTES", 10)
    (tmp_path / "plain.csv").write_text('id,name\n1,"a ""b"" c"\n2,\n')
    (tmp_path / "lines.csv").write_text('id,name\n1,"a\nb"\n2,""\n')
    assert not files.has_quoted_lines(spark, str(tmp_path / "plain.csv")) and files.has_quoted_lines(spark, str(tmp_path / "lines.csv"))
    assert [tuple(r) for r in files.load(spark, {"file": "plain.csv"}, str(tmp_path)).collect()] == [("1", 'a "b" c'), ("2", None)]
    assert [tuple(r) for r in files.load(spark, {"file": "lines.csv"}, str(tmp_path)).collect()] == [("1", "a\nb"), ("2", "")]


def test_sidecar_files_stream_into_the_workbook(tmp_path):
    (tmp_path / "x.csv").write_text('id,why\nV1,"a, b"\nV2,\n', encoding="utf-8-sig")
    (tmp_path / "y.json").write_text("{\n}\n")
    lines = summary.sidecar_rows({"exclusions": {"file": "x.csv"}}, ("exclusions",), str(tmp_path))
    assert iter(lines) is lines and list(lines) == [["id", "why"], ["V1", "a, b"], ["V2", ""]]
    assert list(summary.sidecar_rows({"exclusions": "y.json"}, ("exclusions",), str(tmp_path))) == [["{"], ["}"]]
    assert summary.sidecar_rows({"exclusions": "z.csv"}, ("exclusions",), str(tmp_path)) is None


def test_score_bands():
    assert [summary.band(x) for x in (100, 80, 79.9, 60, 59, None, "x")] == [xlsx.HIGH, xlsx.HIGH, xlsx.MIDDLE, xlsx.MIDDLE, xlsx.LOW, None, None]


def test_one_csv_file_of_parts_equals_that_of_one_task(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "concat('a \"b\", ', id) AS `quoted, name`", "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN '' ELSE 'l\n2' END AS x").repartition(9).orderBy("id")
    frames._write(df.coalesce(1), str(tmp_path / "one"), "csv")
    frames.write(df, tmp_path / "file.csv", "csv")
    assert (tmp_path / "file.csv").read_bytes() == next((tmp_path / "one").glob("part-*")).read_bytes()
    frames.write(df, tmp_path / "file.csv", "csv")  # over itself
    frames.write(df.limit(0), tmp_path / "empty.csv", "csv")
    assert (tmp_path / "empty.csv").read_text() == 'id,"quoted, name",x\n'
    assert sorted(p.name for p in tmp_path.iterdir()) == ["empty.csv", "file.csv", "one"]


@pytest.fixture
def derby(spark, tmp_path):
    """A table in the database that Spark itself brings."""
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    jvm = spark._jvm
    jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    db = jvm.java.sql.DriverManager.getConnection(url)
    s = db.createStatement()
    s.execute("CREATE TABLE t (k INT, name VARCHAR(40))")
    # Three quarters of the rows in a hundredth of the range, and some without a key.
    for at in range(0, 2000, 500):
        s.execute("INSERT INTO t VALUES " + ", ".join(f"({'NULL' if i % 50 == 0 else i % 100 if i % 4 else i * 5}, 'n{i}')" for i in range(at, at + 500)))
    s.close()
    db.close()
    return {"loader": "sql", "driver": "jdbc", "connection": {"url": url, "driver_class": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, "query": "SELECT k, name FROM t", "cache_ttl": "off"}


@pytest.mark.parametrize("split", [None, {"column": "k", "count": 8}, {"column": "k", "count": 8, "sample": "SELECT k FROM t WHERE name LIKE '%7'"}, {"column": "k", "lower": 0, "upper": 10000, "count": 4}, {"column": "k", "count": 1}])
def test_queries_by_jdbc(spark, derby, split):
    df = files.load(spark, derby | ({"partition": split} if split else {}))
    rows = sorted((r["NAME"], r["K"]) for r in df.collect())
    assert rows == sorted((f"n{i}", None if i % 50 == 0 else str(i % 100 if i % 4 else i * 5)) for i in range(2000))
    if split and split["count"] == 8:
        sizes = df.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
        assert len(sizes) > 6 and max(sizes) < (700 if "sample" in split else 500) and 40 in sizes  # the null keys are a query of their own


def test_jdbc_splits_need_numbers(spark, derby):
    with pytest.raises(ValueError, match="isn't a number"):
        files.load(spark, derby | {"partition": {"column": "name", "count": 3}})
    assert files.quantile_splits("k", [3, 3, 9]) == ["k < 3", "k >= 3 AND k < 9", "k >= 9", "k IS NULL"]


def test_sqlite_is_read_side_by_side(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE t (k INTEGER, v TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(None if i % 10 == 0 else i - 50, f"v{i}") for i in range(500)])
    spec = {"loader": "sql", "driver": "sqlite", "connection": {"database": "x.db"}, "query": "SELECT k, v FROM t;", "cache_ttl": "off"}
    for split in ({}, {"partition": {"column": "k", "count": 5}}):
        rows = sorted((r["v"], r["k"]) for r in files.load(spark, spec | split, str(tmp_path)).collect())
        assert rows == sorted((f"v{i}", None if i % 10 == 0 else str(i - 50)) for i in range(500))


def test_distinct_values_are_counted_in_long_form(spark):
    df = spark.createDataFrame([(0.0, "a", None), (-0.0, "a", 1), (float("nan"), None, 1), (None, "", 2)], "x double, y string, z long")
    out = profile.quality(df, ["x", "y", "z"])
    assert {r["column"]: (r["unique_count"], r["null_count"]) for r in out.collect()} == {"x": (3, 1), "y": (3, 1), "z": (3, 1)}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["column"]: (r["unique_count"], r["total_rows"]) for r in profile.quality(df.limit(0), ["x"]).collect()} == {"x": (0, 0)}


def test_tables_of_workbooks_are_written_and_read_by_tasks_in_order_over_several_sheets(spark, tmp_path, monkeypatch):
    """More rows than a sheet holds go on in the next; none comes by way of the driver."""
    monkeypatch.setattr(xlsx, "MAX_ROWS", 8)
    monkeypatch.setattr(frames, "PIECE_ROWS", 3)
    rows = [(f"n {i:02d}", None if i % 4 == 0 else i / 3, i % 2 == 0, ["a", f"{i}"], "x" * (33_000 if i == 17 else 2), "higher" if i == 9 else None) for i in range(25)]
    df = spark.createDataFrame(rows[::-1], "`a.b` string, s double, f boolean, l array<string>, t string, `m n` string").repartition(5).orderBy("`a.b`")
    monkeypatch.setattr(type(df), "toLocalIterator", lambda *_: pytest.fail("rows in the driver"))
    with xlsx.Workbook(tmp_path / "b.xlsx") as book:
        frames.table(book, "Data", df, [20] * 6, {5: {"higher": xlsx.BAD}.get})
        frames.table(book, "Empty", df.limit(0))
    assert xlsx.sheets(tmp_path / "b.xlsx") == ["Data", "Data 2", "Data 3", "Data 4", "Empty", xlsx.LONG]
    book = xlsx.read(tmp_path / "b.xlsx")
    assert [len(book[n]) - 1 for n in xlsx.parts_of(tmp_path / "b.xlsx", "Data")] == [7, 7, 7, 4] and book["Empty"] == [df.columns]
    assert book["Data 2"][0] == df.columns and book["Data 2"][1][:4] == ["n 07", round(7 / 3, 2), False, "a;7"]
    assert [r[:2] for r in book[xlsx.LONG][1:]] == [["Data 3", "E5"]]
    back = frames.read_table(spark, tmp_path / "b.xlsx", "Data")
    assert back.columns == df.columns and [r["a.b"] for r in back.collect()] == [r[0] for r in rows]
    assert frames.read_table(spark, tmp_path / "b.xlsx", "Empty").count() == 0
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        assert f'r="F4" s="{xlsx.BAD}"' in z.read("xl/worksheets/sheet2.xml").decode()


def test_ngrams_are_joined_in_generated_code(spark):
    texts = ["a b  c a b c", "a b", "a", "", None, "a b c", " b c a "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = {}
    for t in texts:
        w = [x for x in (t or "").split(" ") if x]
        for i in range(len(w) - 2):
            want[" ".join(w[i : i + 3])] = want.get(" ".join(w[i : i + 3]), 0) + 1
    got = profile.ngrams(df, "t", 3)
    assert [tuple(r) for r in got.collect()] == sorted(want.items(), key=lambda x: (-x[1], x[0]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "transform(" not in plan


def test_a_profile_of_a_small_file_is_every_task_s_work(spark, tmp_path, monkeypatch):
    """Its rows keep their positions when they are dealt out."""
    from matchloom.sources import files as sources

    texts = ["\u0436\u03bb" if i in (3, 40, 77) else f"name {i} ltd" for i in range(90)]
    spark.createDataFrame([(t,) for t in texts], "name string").coalesce(1).write.parquet(str(tmp_path / "c.parquet"))
    monkeypatch.setattr(sources, "TASK_BYTES", 100)
    df, seen = files.load(spark, {"file": str(tmp_path / "c.parquet")}), []
    made = profile.token_table
    monkeypatch.setattr(profile, "token_table", lambda d, c: seen.append(d.rdd.getNumPartitions()) or made(d, c))
    found = profile.analyze(df, ["name"])
    assert seen == [spark.sparkContext.defaultParallelism]
    assert found["columns"]["name"]["unicode_profile"]["flagged_rows"] == [3, 40, 77]
    assert found["data_quality"][0]["total_rows"] == 90
