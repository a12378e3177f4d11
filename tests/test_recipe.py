import copy
import json

import pytest

from matchloom.plans import recipe as r

BASE = {
    "name": "n", "sources": {"src": {"file": "x.csv"}}, "populations": {"pop1": {"source": "src", "record_key": "id"}},
    "steps": [{"name": "s1", "source": "pop1", "destination": "src", "match_fields": [{"source": "name", "destination": "name", "method": "exact", "tiers": ["raw"]}]}],
    "output": {"format": "csv"},
}


def made(**over):
    return r.merge(copy.deepcopy(BASE), over)


def put(recipe, path, value):
    at = recipe
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return recipe


def test_a_plain_recipe_is_clean():
    assert r.validate(BASE) == []


@pytest.mark.parametrize("path", [("debugg",), ("sources", "src", "encoding"), ("populations", "pop1", "dedup"), ("steps", 0, "filter"), ("steps", 0, "match_fields", 0, "case"), ("output", "sheet")])
def test_unknown_keys_are_warnings(path):
    assert any(repr(path[-1]) in w for w in r.validate(put(made(), path, 1)))


@pytest.mark.parametrize(
    ("path", "value", "message"),
    [
        (("output", "format"), "pdf", "not one of"), (("steps", 0, "match_fields", 0, "method"), "magic", "not one of"), (("name",), 5, "wrong type"), (("steps",), {}, "not a list"),
        (("sources", "src"), {}, "neither file nor loader"), (("steps", 0, "name"), "unmatched", "reserved"), (("steps", 0, "match_fields", 0, "threshold"), "80", "wrong type"),
        (("populations", "pop1", "action"), "exclude", "excluded"), (("output", "columns"), {"matched": [{"field": "is_unmatched"}]}, "reserved"), (("output", "groups"), {"mode": "all_match"}, "file is required"),
        (("output", "decision_record"), {"candidates": ["a"], "write_to": "w"}, "two at least"), (("output", "decision_record"), {"candidates": ["a", "b"]}, "write_to is required"),
        (("output", "decision_record"), {"candidates": ["a", "b"], "write_to": "match_step"}, "collides"), (("output", "decision_record"), {"candidates": ["a", "b"], "write_to": "w", "select": "mode"}, "first, min, max"),
        (("output", "compare_columns"), [{"left": "v", "right": "b", "output": "v"}], "can be read"), (("output", "compare_columns"), [{"left": "a", "right": "b", "output": "v"}] * 2, "collides"),
        (("output", "final_rollup"), [{"steps": ["no"], "group_key": "g", "target": "t"}], "there is no step"), (("output", "final_rollup"), [{"group_key": "g", "target": "t"}] * 2, "too"),
        (("output", "mode"), "enriched", "enrich_source"),
    ],
)
def test_errors(path, value, message):
    with pytest.raises(r.RecipeError, match=message):
        r.validate(put(made(), path, value))


def test_all_errors_come_at_once():
    bad = made()
    bad["steps"].append(dict(bad["steps"][0]))
    bad["sources"]["y"] = {}
    with pytest.raises(r.RecipeError) as e:
        r.validate(bad)
    assert "neither file" in str(e.value) and "both named" in str(e.value)


def test_phases():
    phases = {"name": "n", "sources": BASE["sources"], "phases": [{"name": "p", "populations": BASE["populations"], "steps": BASE["steps"]}]}
    with pytest.raises(r.RecipeError, match="no phase has an output"):
        r.validate(phases)
    phases["phases"].append({"name": "q", "populations": {"x": {"source": "_previous_matched", "record_key": "id"}}, "steps": [{**BASE["steps"][0], "name": "s2", "source": "x"}], "output": {"format": "csv"}})
    assert any("aren't written" in w for w in r.validate(phases))
    with pytest.raises(r.RecipeError, match="not at the top"):
        r.validate(phases | {"output": {"format": "csv"}})
    phases["phases"][1]["output"]["final_rollup"] = [{"group_key": "g", "target": "t"}]
    with pytest.raises(r.RecipeError, match="without phases only"):
        r.validate(phases)


def test_advice():
    w = r.validate(made(output={"format": "xlsx", "tabs": [], "emit_unmatched": True, "matched_unmatched": "merged"}, populations={"pop1": {"source": "src"}}))
    assert w == []or len([x for x in w if any(k in x for k in ("tabs", "summary", "emit_unmatched"))]) == 3


def test_defaults_merge_and_go():
    got = r.with_defaults({"step_defaults": {"address_support": {"threshold": 70, "tiers": ["raw"]}}, "steps": [{"name": "a"}, {"name": "b", "address_support": {"tiers": ["clean"]}}]})
    assert got == {"steps": [{"address_support": {"threshold": 70, "tiers": ["raw"]}, "name": "a"}, {"address_support": {"threshold": 70, "tiers": ["clean"]}, "name": "b"}]}
    phased = r.with_defaults({"step_defaults": {"x": 1, "y": 1}, "phases": [{"step_defaults": {"y": 2}, "steps": [{"name": "a"}]}]})
    assert phased["phases"][0]["steps"] == [{"x": 1, "y": 2, "name": "a"}]


def test_reading(tmp_path):
    (tmp_path / "a.yaml").write_text("name: x\nsteps: []\n")
    (tmp_path / "b.json").write_text('{"name": "x"}')
    (tmp_path / "c.yaml").write_text("name: [x\nother: y\n")
    (tmp_path / "d.json").write_text('{"name": }')
    assert r.load(tmp_path / "a.yaml") == {"name": "x", "steps": []} and r.load(tmp_path / "b.json") == {"name": "x"}
    with pytest.raises(r.RecipeError, match="line 2"):
        r.load(tmp_path / "c.yaml")
    with pytest.raises(r.RecipeError, match="line 1, column 10"):
        r.load(tmp_path / "d.json")


def test_fields_against_data(spark):
    src = spark.createDataFrame([("1", "a")], "id string, name string")
    assert r.validate_fields(BASE, {"src": src}) == ([], [])
    bad = made()
    bad["steps"][0]["match_fields"][0]["source"] = "nmae"
    bad["populations"]["pop1"]["filter"] = [{"field": "gone", "op": "is_null"}]
    bad["output"]["columns"] = {"matched": [{"field": "nowhere"}, {"fields": ["name", "gone"]}, {"header": "x"}]}
    errors, warnings = r.validate_fields(bad, {"src": src})
    assert len(errors) == 3 and len(warnings) == 2 and "nmae" in errors[0]


@pytest.mark.parametrize(("pattern", "ok"), [("^a|b$", True), (r"\p{Lu}x", True), ("(?=a)", False), ("(?<!a)b", False), (r"(a)\1", False), ("(", False)])
def test_regex_dialect(pattern, ok):
    assert (r.regex_fault(pattern) is None) == ok


def test_groups_file(tmp_path):
    good = {"groups": [{"group_name": "g", "regex": "x", "match_columns": ["a"], "notes": 1}]}
    (tmp_path / "g.json").write_text(json.dumps(good))
    groups, warnings, errors = r.read_groups({"groups": {"file": "g.json"}}, tmp_path)
    assert len(groups) == 1 and "notes" in warnings[0] and not errors
    for bad, message in (({"groups": []}, "no list"), ({"groups": [{"group_name": "g"}]}, "neither regex"), ({"groups": good["groups"] * 2}, "both named"), ({"groups": [{"regex": "(", "match_columns": ["a"]}]}, "no group_name")):
        (tmp_path / "g.json").write_text(json.dumps(bad))
        assert any(message in e for e in r.read_groups({"groups": {"file": "g.json"}}, tmp_path)[2])
    assert "no file" in r.read_groups({"groups": {"file": "absent.json"}}, tmp_path)[2][0]


def test_normalization(tmp_path):
    (tmp_path / "s.json").write_text('{"name": ["inc"], "address": ["suite"], "freetext": ["x"]}')
    got, warnings = r.normalization({"stopwords": "s.json", "aliases": {"st": "street"}}, tmp_path)
    assert got == {"name_aliases": {}, "addr_aliases": {"st": "street"}, "name_stopwords": ["inc", "x"], "addr_stopwords": ["suite", "x"]} and len(warnings) == 1
    assert r.normalization({"stopwords": ["a"], "aliases": {"name": {"b": "c"}}})[0]["name_aliases"] == {"b": "c"}


def test_exclusions_are_routed():
    got = r.route_exclusions(BASE, {"s1": ["7"]})
    assert got["steps"][0]["exclude"] == {"values": ["7"]} and "exclude" not in BASE["steps"][0]
    with pytest.raises(r.RecipeError, match="don't exist"):
        r.route_exclusions(BASE, {"zz": ["7"]})


def test_address_words_of_a_recipe_are_used(spark, tmp_path):
    (tmp_path / "words.json").write_text('{"street_suffixes": ["weg"], "unit_keywords": [], "directionals": [], "state_codes": [], "zip_patterns": []}')
    values, warnings = r.normalization({"address_patterns": "words.json", "unicode": {"mode": "x"}}, str(tmp_path))
    assert values["addr_patterns"].suffixes == {"weg"} and any("unicode" in w for w in warnings)
    with pytest.raises(r.RecipeError, match="no file"):
        r.normalization({"address_patterns": "gone.json"}, str(tmp_path))
    from matchloom.operators import resolve
    from matchloom.operators.joins import Norm

    src = spark.createDataFrame([("k", "12 alter weg 5")], "k string, addr string")
    dst = spark.createDataFrame([("k", "99 alter weg 7")], "k2 string, addr2 string")
    step = {"name": "s", "match_fields": [{"source": "k", "destination": "k2", "method": "exact", "tiers": ["raw"]}], "address_support": {"source": ["addr"], "destination": ["addr2"], "tiers": ["raw"]}}
    street = lambda norm: resolve.step(src, dst, step, norm, key="k").matched.first()["addr_score"]
    assert street(Norm(**values)) != street(Norm())
