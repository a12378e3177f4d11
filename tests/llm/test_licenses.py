import functools
import re
import time

import pytest

from matchloom.llm import licenses

from .conftest import ascii_lower, terms


ALL = licenses.all_templates()


@functools.cache
def brute_regex(markup):
    """A template as a regular expression over space-joined words, each followed by a blank, and by # where a sentence ends."""
    out = ""
    for part in re.split(r"(<<.*?>>)", markup):
        if part == "<<beginOptional>>":
            out += "(?:"
        elif part == "<<endOptional>>":
            out += ")?"
        elif m := re.fullmatch(r"<<var;name=\w+;match=(.+)>>", part):
            out += "(?:" + "|".join("".join(re.escape(w) + " #?" for w in terms(c)) for c in m[1].split("|")) + ")"
        elif part.startswith("<<var"):
            out += r"(?:(?:[^\s#]+ )+?#?)??" if "within" in part else r"(?:[^\s#]+ #?)*?"
        else:
            out += "".join(re.escape(w) + " #?" for w in terms(part))
    return re.compile(r"(?<![^\s#])" + out)


def sentences(text):
    """Words, and whether a sentence ends behind each."""
    found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text))
    for m, after in zip(found, [*(x.start() for x in found[1:]), len(text)]):
        gap = text[m.end() : after]
        lines = gap.replace("\t", "").replace(" ", "").replace("\r", "")
        stop = re.match(r"[^.]*\.[\"')]*\s", gap) and set(gap[: gap.index(".")]) <= set("\"')") and len(m[0]) > 3 and m[0][-4:].isalnum()
        yield m[0], bool("\n\n" in lines or re.search(r"[!?][\s\"')]", gap) or stop)


def brute(text):
    w = terms(text)
    places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    base = {label for _, label in places}
    line = "".join(x + " " + "#" * ends for x, ends in sentences(ascii_lower(text)))
    assert line.replace("#", "").split() == w
    more = {label for label, t in ALL.items() if brute_regex(t).search(line)}
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more))


CASES = [
    None, "", " .", "MIT License", "mit-license MIT, LICENSE! mit license", "permit license", "The GNU Lesser General Public License", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under the terms of the GNU general public license as published by the free software foundation version 2",
    "licensed under cc by nc 4.0", "Licensed under CC BY-NC 4.0.", "licensed under a cc by sa", "Copyright (c) 2020 Some Holder. All rights reserved", "copyright " + "x " * 13 + "all rights reserved",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "permission is hereby granted, free of charge, to any persons obtaining", "dedicated to the public domain by me", "Ünï mit license É",
]


def plain(label):
    """A text of the license: optional regions kept, replaceable ones filled."""
    t = re.sub(r"<<var;name=\w+;match=([^|>]+)[^>]*>>", r"\1", ALL[label])
    return re.sub(r"<<(?:begin|end)Optional>>", "", re.sub(r"<<var;name=\w+[^>]*>>", "Some Holder, of a Long Name & Sons, Inc.", t))


def bare(label):
    """The same without optional regions."""
    t = ALL[label]
    while "<<beginOptional>>" in t:
        t = re.sub(r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>", "", t)
    t = re.sub(r"<<var;name=\w+;match=([^|>]+)[^>]*>>", r"\1", t)
    return re.sub(r"<<var;name=\w+[^>]*>>", "Some Holder", t)


LONG = [k for k in ALL if k.endswith(("-text", "-header"))]
CASES += [f"Some words before. {plain(k)} And after." for k in LONG]
# The same with contrary wording at the end, in the middle, and cut off.
CASES += [" ".join(plain(k).split()[:-1] + ["never"]) for k in LONG] + [" ".join(plain(k).split()[: len(plain(k).split()) // 2]) for k in LONG]
CASES += ["copyright a copyright b all rights reserved c copyright " + "x " * 500 + "all rights reserved"]


def test_whole_licenses_are_accepted_and_others_arent():
    scanner = licenses.Scanner()
    for k in LONG:
        text, words = plain(k), bare(k).split()
        assert k in scanner.scan(bare(k))[5].split(","), k
        assert k in scanner.scan(f"First. {text.upper()} Then.")[5].split(","), k
        for broken in (words[:-1] + ["never"], words[: len(words) // 2], words[: len(words) // 2] + ["not"] + words[len(words) // 2 :] if k == "mit-text" else words[1:]):
            assert k not in scanner.scan(" ".join(broken))[5].split(","), k
    first = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    assert scanner.scan(first + ", but never for money, and only on Mondays.")[5] == ""


def test_a_region_stays_within_a_sentence():
    scan = licenses.Scanner().scan
    story = " ".join(f"This is sentence number {i} of a long text." for i in range(600))
    assert scan(f"Copyright law is old. {story} All rights reserved")[5] == ""
    assert scan(f"Copyright law is older than that\n\n{story.replace('.', '')}\n\nAll rights reserved")[5] == ""
    assert scan("Copyright (c) 2020 by J. R. Smith, Foo Inc., and\nthe Bar Corp. All rights reserved.")[5] == "all-rights-reserved"
    label, start, end = scan(f"Dedicated to the public domain by John Doe. {story}")[7][0]
    assert (label, start) == ("public-domain", 0) and end <= 8
    label, start, end = scan("dedicated to the public domain by " + "word " * 3000)[7][0]
    assert end <= 8


def test_whole_texts_in_files():
    texts = [k for k in ALL if k not in licenses.TEMPLATES]
    assert sorted(texts) == ["apache-2.0-text", "cc0-1.0-text", "gpl-2.0-text", "gpl-3.0-text", "lgpl-2.1-text", "lgpl-3.0-text", "mpl-2.0-text"]
    scan = licenses.default_scanner().scan
    for k in texts:
        words = plain(k).split()
        assert len(words) > 900
        assert scan(plain(k))[5].split(",") == sorted({*scan(plain(k))[4].split(","), k} - {""} | {x for x in scan(plain(k))[5].split(",") if not x.endswith("-text")})
        for at in (3, len(words) // 3, len(words) - 1):
            assert k not in scan(" ".join(words[:at] + ["mutated"] + words[at:]))[5].split(","), (k, at)


def test_regions_have_no_bound_and_time_grows_with_the_words():
    text = "copyright " + "holder " * 5000 + "all rights reserved"
    assert licenses.Scanner().scan(text)[5] == "all-rights-reserved"
    began = time.process_time()
    got = licenses.Scanner().scan("reserved rights all " + "copyright holder " * 200_000)
    assert got[5] == "" and time.process_time() - began < 10


@pytest.mark.parametrize("text", CASES)
def test_equals_brute_force(text):
    assert licenses.Scanner().scan(text)[:6] == brute(text)


def test_documents(docs, texts):
    got = {r["id"]: r for r in licenses.scan(docs).collect()}
    for k, t in texts.items():
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == brute(t)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_edge_cases(edge, empty):
    rows = {(r["id"], r["n_words"]): (r["base_labels"], r["labels"], r["score"]) for r in licenses.scan(edge).collect()}
    assert set(rows.values()) == {("", "", 0.0)} and rows.keys() == {(r["doc_id"], len(terms(r["text"]))) for r in edge.collect()}
    assert licenses.scan(empty).count() == 0


def test_defined_values(spark):
    rows = [(1, None, "a"), (None, "MIT License", "b"), (4, "MIT License", "c"), (4, "MIT License", "d"), (4, "Apache License", "e"), (9, "x " * 600_000 + "mit license", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = sorted((str(r["id"]), r["n_words"], r["n_base"], r["first_word"], r["labels"], round(r["score"], 6)) for r in licenses.scan(df).collect())
    want = [("1", 0, 0, None, "", 0.0), ("4", 2, 1, 0, "apache", 1.0), ("4", 2, 1, 0, "mit", 1.0), ("4", 2, 1, 0, "mit", 1.0), ("9", 600_002, 1, 600_000, "mit", round(2 / 600_002, 6)), ("None", 2, 1, 0, "mit", 1.0)]
    assert got == want


def test_markup_errors():
    with pytest.raises(ValueError, match="closed"):
        licenses.compile_template("x", "a <<beginOptional>> b")
    with pytest.raises(ValueError, match="mandatory"):
        licenses.compile_template("x", "<<beginOptional>> b <<endOptional>>")
    with pytest.raises(ValueError, match="markup"):
        licenses.compile_template("x", "a <<other>>")
