"""A run from the command line executes each join once, and counts what it writes as it writes it."""

import json
import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

from matchloom.plans import pipeline

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
from pyspark.sql import SparkSession
from matchloom import cli
folder = sys.argv[1]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false").config("spark.eventLog.dir", "file://" + folder + "/events").getOrCreate()
print([str(x) for x in cli.run_recipe(spark, folder + "/recipe.yaml", folder, folder + "/out.csv")])
spark.stop()
"""
RECIPE = """
name: gated
sources: {old: {file: old.csv}, new: {file: new.csv}}
populations: {all: {source: old, record_key: id, filter: []}}
steps:
  - {name: near, source: all, destination: new, match_fields: [{source: name, destination: title, method: fuzzy, scorer: ratio, threshold: 80, tiers: [clean]}], address_support: {source: [street], destination: [road], threshold: 70}}
  - {name: same, source: all, destination: new, match_fields: [{source: name, destination: title, method: exact, tiers: [raw]}]}
output: {format: [csv, xlsx], matched_unmatched: [separate, merged], summary: [md, xlsx]}
"""


def plans(folder: Path):
    """Of each execution the plan that ran in the end, as nodes' texts."""
    last = {}
    for line in "".join(p.read_text() for p in sorted(folder.rglob("*")) if p.is_file() and not p.name.startswith(".")).splitlines():
        try:
            e = json.loads(line)
        except ValueError:
            continue
        if "sparkPlanInfo" in e:
            todo, nodes = [e["sparkPlanInfo"]], []
            while todo:
                x = todo.pop()
                nodes.append(x["simpleString"])
                todo += x["children"]
            last[e["executionId"]] = nodes
    return last


def test_each_join_once(tmp_path):
    rows = [(f"k{i}", f"company number {i}", f"{i} main street") for i in range(60)]
    (tmp_path / "events").mkdir()
    (tmp_path / "old.csv").write_text("id,name,street\n" + "".join(f"{k},{n},{a}\n" for k, n, a in rows))
    (tmp_path / "new.csv").write_text("no,title,road\n" + "".join(f"{i},{n}{'x' if i % 2 else ''},{a if i % 3 else 'elsewhere 9 road'}\n" for i, (_, n, a) in enumerate(rows) if i % 5))
    (tmp_path / "recipe.yaml").write_text(RECIPE)
    out = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=600)
    assert "out.csv" in out.stdout, out.stderr[-3000:]
    ran = plans(tmp_path / "events")
    scored = [k for k, nodes in ran.items() if any(re.search(r"MapInArrow run\(.*\[a#\d+, b#\d+, score#\d+\]", n) for n in nodes)]
    assert len(scored) == 1, scored
    # The exact step's join is on the keys of both sides.
    exact = [k for k, nodes in ran.items() if any(re.search(r"Join \[__tier#\d+, __k#\d+\], \[__tier_d#\d+, __k_d#\d+\], Inner", n) for n in nodes)]
    assert len(exact) == 1, exact
    text = (tmp_path / "out_summary.md").read_text()
    matched = (tmp_path / "out.csv").read_text().splitlines()[1:]
    missed = (tmp_path / "out_unmatched.csv").read_text().splitlines()[1:]
    assert f"**Matched:** {len(matched)} of 60" in text and f"**Unmatched:** {len(missed)}" in text and len(matched) + len(missed) == 60 and missed


@pytest.mark.parametrize("phases", [False, True])
def test_observed_counts_are_the_counted_ones(spark, phases):
    a = spark.createDataFrame([(f"k{i}", str(i % 7), str(i)) for i in range(50)] + [(None, "3", "x")], "id string, x string, y string").repartition(3)
    b = spark.createDataFrame([(str(i), f"n{i}") for i in range(5)], "z string, w string")
    step = lambda name, to="z", src="all": {"name": name, "source": src, "destination": "b", "match_fields": [{"source": "x", "destination": to, "method": "exact", "tiers": ["raw"]}]}
    all_ = {"all": {"source": "a", "record_key": "id", "filter": []}}
    recipe = {"name": "r", "sources": {"a": {"file": "a"}, "b": {"file": "b"}}}
    if phases:
        low = {"p": {"source": "_previous_matched", "record_key": "id", "filter": [{"field": "x", "op": "eq", "value": "1"}]}}
        recipe["phases"] = [{"name": "one", "populations": all_, "steps": [step("s1"), step("never", "w")]}, {"name": "two", "populations": low, "steps": [step("s2", src="p")], "output": {"format": "csv"}}]
    else:
        recipe |= {"populations": all_, "steps": [step("s1"), step("never", "w")], "output": {"format": "csv"}}
    made = [pipeline.run(spark, recipe, sources={"a": a, "b": b}, write=w) for w in (False, True)]
    lazy, written = (r.stats() for r in made)
    assert lazy == written and lazy["matched_count"] and lazy["unmatched_count"]
    for f in ("matched", "unmatched"):
        rows = [sorted(map(str, getattr(r, f).drop("__pos", "__dst_pos").collect())) for r in made]
        assert rows[0] == rows[1]
    empty = pipeline.run(spark, recipe | {}, sources={"a": a, "b": b.limit(0)}, write=True)
    assert empty.stats()["matched_count"] == 0 and empty.stats()["unmatched_count"] == 50
