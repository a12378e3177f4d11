"""Recipes as a user's first ones: 45 records against 60, by exact names, by similar ones, and with step defaults and normalisation.

What each record should be matched with is known from how its name was made, and every output file is held against it.
"""

import csv

import pytest
import yaml

from matchloom import cli

NOUNS = "harbour orchard lantern granite meadow falcon cobalt summit willow copper juniper beacon prairie anchor thistle".split()
KINDS = "holdings", "capital", "partners"
NAMES = [f"{n.capitalize()} {k.capitalize()} Group" for k in KINDS for n in NOUNS]  # 45


def source(i: int) -> tuple[str, str | None]:
    """A record's name, and the step that should match it (None: none does)."""
    name = NAMES[i]
    if i < 18:
        return name, "exact"  # as it is
    if i < 31:
        return (name.upper() + "." if i % 2 else "  " + name.replace(" ", "  ") + ","), "exact"  # cleaned
    if i < 36:
        return name[:3] + name[4:-1], "similar"  # two letters lost
    if i < 38:
        return f"The {name.split()[0]} {name.split()[1]} Grp Incorporated", "normalised"
    return f"nobody {i * 7919} knows", None


def expected(*steps: str) -> dict[str, tuple[str, str]]:
    return {f"V{i:02}": (f"S{1000 + i}", s) for i in range(45) if (s := source(i)[1]) in steps}


def step(name, **match):
    return {"name": name, "source": "vendors", "destination": "trusted", "match_fields": [{"source": "name", "destination": "legal name"} | match]}


BASE = {
    "description": "vendors against trusted names",
    "sources": {"v": {"file": "vendors.csv"}, "trusted": {"file": "trusted.csv"}},
    "populations": {"vendors": {"source": "v", "record_key": "vendor id", "filter": [{"field": "status", "op": "eq", "value": "active"}]}},
    "output": {
        "format": "csv", "summary": ["md"], "matched_unmatched": ["separate", "merged"],
        "columns": {"matched": [{"field": "vendor id", "header": "Vendor"}, {"field": "name", "header": "Name"}, {"field": "supplier", "header": "Supplier"}, {"field": "match_step", "header": "Step"}], "analysis": [{"field": "vendor id", "header": "Vendor"}, {"field": "reason_code", "header": "Reason"}]},
    },
}
EXACT = step("exact", method="exact", tiers=["raw", "clean"])
SIMILAR = step("similar", method="fuzzy", scorer="ratio", threshold=90, tiers=["clean"])
RECIPES = {
    31: BASE | {"name": "exact names", "steps": [EXACT]},
    36: BASE | {"name": "similar names", "steps": [EXACT, SIMILAR]},
    38: BASE
    | {
        "name": "with defaults", "normalization": {"aliases": {"name": {"grp": "group"}}, "stopwords": ["the", "incorporated"]},
        "step_defaults": {"source": "vendors", "destination": "trusted"},
        "steps": [{k: v for k, v in s.items() if k not in ("source", "destination")} for s in (EXACT, SIMILAR, step("normalised", method="exact", tiers=["normalized"]))],
    },
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    to = tmp_path_factory.mktemp("rates")
    with open(to / "vendors.csv", "w", newline="") as f:
        csv.writer(f).writerows([["vendor id", "name", "status"], *([f"V{i:02}", source(i)[0], "active"] for i in range(45)), ["V98", NAMES[0], "closed"], ["V99", NAMES[1], ""]])
    with open(to / "trusted.csv", "w", newline="") as f:
        rows = [[n, f"S{1000 + i}"] for i, n in enumerate(NAMES)] + [[f"Distant {n} Trading", f"S{2000 + i}"] for i, n in enumerate(NOUNS)]
        csv.writer(f).writerows([["legal name", "supplier"], *reversed(rows)])
    return to


@pytest.mark.parametrize("rate", RECIPES)
def test_rate(spark, folder, rate):
    recipe = RECIPES[rate]
    file = folder / f"{rate}.yaml"
    file.write_text(yaml.safe_dump(recipe, sort_keys=False))
    made = cli.run_recipe(spark, file, str(folder), str(folder / f"out{rate}.csv"))
    assert [p.name for p in made] == [f"out{rate}.csv", f"out{rate}_merged.csv", f"out{rate}_unmatched.csv", f"out{rate}_summary.md"]
    want = expected(*{31: ["exact"], 36: ["exact", "similar"], 38: ["exact", "similar", "normalised"]}[rate])
    assert len(want) == rate
    rows = {p.name.removesuffix(".csv"): list(csv.reader(open(p, newline=""))) for p in made[:3]}
    names = {f"V{i:02}": source(i)[0] for i in range(45)}
    assert rows[f"out{rate}"] == [["Vendor", "Name", "Supplier", "Step"], *([k, names[k], *want[k]] for k in sorted(want))]
    missed = [k for k in sorted(names) if k not in want]
    assert rows[f"out{rate}_unmatched"] == [["Vendor", "Reason"], *([k, "no_name_match"] for k in missed)]
    head, *merged = rows[f"out{rate}_merged"]
    assert head[:4] == ["Vendor", "Name", "Supplier", "Step"] and sorted(r[0] for r in merged) == sorted(names)
    assert {r[0]: (r[2], r[3]) for r in merged if r[0] in want} == want
    text = made[3].read_text()
    assert f"**Matched:** {rate} of 45 ({round(rate / 45 * 100, 1)}%)" in text and f"**Unmatched:** {45 - rate}" in text
