"""Profiler reports: markdown, a workbook of six sheets, suggested sidecars."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any

from .xlsx import Workbook

SECTIONS = ("quality", "tokens", "ngrams", "positions", "lengths", "near_duplicates", "singletons", "stopwords", "aliases", "unicode")


def _table(rows: Sequence[Mapping[str, Any]], names: Sequence[str]) -> list[str]:
    if not rows:
        return ["*none*"]
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    return ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(cell(r.get(n)) for n in names) + " |" for r in rows)]


def _variants(a: Mapping[str, Any]) -> str:
    return ", ".join(f"{v['raw']} ({v['count']})" for v in a["variants"])


def markdown(results: Mapping[str, Any], file: str = "", sections: Sequence[str] | None = None, n: int = 15) -> str:
    chosen = SECTIONS if not sections else [s for s in SECTIONS if s in sections]
    out = ["# Signal analysis" + (f": {file}" if file else ""), ""]
    if "quality" in chosen:
        out += ["## Data quality", "", *_table(results["data_quality"], ["column", "total_rows", "null_count", "null_pct", "unique_count", "unique_pct", "duplicate_count", "min_length", "max_length", "mean_length"]), ""]
    for name, a in results["columns"].items():
        out += [f"## {name} ({a['detected_type']})", ""]
        blocks: dict[str, list[tuple[str, list[str]]]] = {
            "tokens": [(f"Top tokens, {t}", _table(a[f"top_tokens_{t}"][:n], ["tok", "count"])) for t in ("raw", "clean")],
            "ngrams": [(f"{k.capitalize()}, {t}", _table(a[f"{k}_{t}"][:n], ["ngram", "count"])) for k in ("bigrams", "trigrams") for t in ("raw", "clean")],
            "positions": [("Token positions", _table([r for p in ("first", "middle", "last") for r in [x for x in a["token_positions"] if x["place"] == p][:n]], ["place", "tok", "count"]))],
            "lengths": [
                ("Token lengths", _table([a["token_lengths"]], ["min", "max", "mean", "median"])),
                ("Numbers among tokens", _table([a["numeric_ratio"]], ["total_tokens", "numeric", "alpha", "mixed", "numeric_pct"])),
            ],
            "near_duplicates": [("Near-duplicate tokens", _table(a["near_duplicates"][:n], ["token1", "token2", "similarity", "count1", "count2"]))],
            "singletons": [("Singletons", [", ".join(a["singletons"][:n]) or "*none*"])],
            "stopwords": [("Suggested stop words", _table(a["suggested_stopwords"][:n], ["tok", "frequency", "count", "known"]))],
            "aliases": [("Suggested aliases", _table([{**x, "variants": _variants(x)} for x in a["suggested_aliases"][:n]], ["canonical", "variants", "total"]))],
            "unicode": [("Characters", _table([{"class": k, "count": v} for k, v in a["unicode_profile"].items() if k != "flagged_rows"], ["class", "count"]))],
        }
        for s in chosen:
            for title, lines in blocks.get(s, []):
                out += [f"### {title}", "", *lines, ""]
    return "\n".join(out)


def workbook(results: Mapping[str, Any], path: str | Path, n: int | None = None) -> None:
    cols = results["columns"]

    def rows(header: Sequence[str], key: str, names: Sequence[str]) -> Iterator[Sequence[Any]]:
        yield header
        for c, a in cols.items():
            for r in a[key][:n]:
                yield [c, *(r.get(k) for k in names)]

    def tokens() -> Iterator[Sequence[Any]]:
        yield ["Column", "Kind", "Tier", "Text", "Count"]
        for c, a in cols.items():
            for kind, key in (("token", "tok"), ("bigram", "ngram"), ("trigram", "ngram")):
                for t in ("raw", "clean"):
                    for r in a[f"top_tokens_{t}" if kind == "token" else f"{kind}s_{t}"][:n]:
                        yield [c, kind, t, r[key], r["count"]]

    def aliases() -> Iterator[Sequence[Any]]:
        yield ["Column", "Canonical", "Variants", "Total"]
        for c, a in cols.items():
            for x in a["suggested_aliases"][:n]:
                yield [c, x["canonical"], _variants(x), x["total"]]

    def summary() -> Iterator[Sequence[Any]]:
        names = list(results["data_quality"][0]) if results["data_quality"] else ["column"]
        yield [*names, "type"]
        for q in results["data_quality"]:
            yield [*(q[k] for k in names), cols.get(q["column"], {}).get("detected_type")]

    def profile() -> Iterator[Sequence[Any]]:
        yield ["Column", "Measure", "Value", "Count"]
        for c, a in cols.items():
            for k in ("min", "max", "mean", "median"):
                yield [c, f"token length {k}", a["token_lengths"][k], None]
            for h in a["token_lengths"]["histogram"]:
                yield [c, "tokens of length", h["length"], h["count"]]
            for k, v in a["numeric_ratio"].items():
                yield [c, k, v, None]
            for r in a["token_positions"][:n]:
                yield [c, f"{r['place']} token", r["tok"], r["count"]]
            for s in a["suggested_stopwords"]:
                yield [c, "stop word", s["tok"], s["count"]]
            for t in a["singletons"][:n]:
                yield [c, "singleton", t, 1]

    def characters() -> Iterator[Sequence[Any]]:
        yield ["Column", "Class", "Count"]
        for c, a in cols.items():
            yield from ([c, k, v] for k, v in a["unicode_profile"].items() if k != "flagged_rows")

    with Workbook(path) as book:
        book.sheet("Summary", summary(), band=True)
        book.sheet("Top Tokens", tokens(), band=True)
        book.sheet("Aliases", aliases(), band=True)
        book.sheet("Near Duplicates", rows(["Column", "Token 1", "Token 2", "Similarity", "Count 1", "Count 2"], "near_duplicates", ["token1", "token2", "similarity", "count1", "count2"]), band=True)
        book.sheet("Token Profile", profile(), band=True)
        book.sheet("Unicode", characters(), band=True)


def sidecars(results: Mapping[str, Any], folder: str | Path) -> None:
    """stopwords.json and aliases.json as the analysis suggests them."""
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    (to / "stopwords.json").write_text(json.dumps(results["aggregated_stopwords"], indent=2))
    (to / "aliases.json").write_text(json.dumps(results["aggregated_aliases"], indent=2, ensure_ascii=False))
