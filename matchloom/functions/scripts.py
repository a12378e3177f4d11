"""Character classes of texts by code point ranges."""

from __future__ import annotations

import bisect
import json
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class -> inclusive code point ranges. Every class but the first three and "unknown" is a script.
RANGES: dict[str, list[list[int]]] = {
    "ascii_alnum": [[48, 57], [65, 90], [97, 122]],
    "ascii_punct_space": [[9, 13], [32, 47], [58, 64], [91, 96], [123, 126]],
    "common_unicode": [
        [160, 191], [688, 767], [768, 879], [6832, 6911], [7232, 7359], [8400, 8447], [65056, 65071], [8192, 8303], [8304, 8351],
        [8352, 8399], [8448, 8527], [9312, 9471], [65281, 65295], [65306, 65312], [65339, 65344], [65371, 65381],
    ],
    "latin": [
        [192, 255], [256, 383], [384, 591], [592, 687], [7680, 7935], [11360, 11391], [42784, 43007], [43824, 43887], [64256, 64262],
        [65313, 65338], [65345, 65370], [65296, 65305],
    ],
    "greek": [[880, 1023], [7936, 8191]],
    "cyrillic": [[1024, 1279], [1280, 1327], [7296, 7311], [11744, 11775], [42560, 42655], [122912, 122927]],
    "cjk": [
        [12288, 12351], [65072, 65103], [12352, 12447], [12448, 12543], [12784, 12799], [110896, 110911], [110592, 110847],
        [110848, 110895], [110896, 110959], [65382, 65437], [11904, 11935], [12032, 12255], [12736, 12783], [12272, 12287],
        [12544, 12591], [12704, 12735], [13312, 19903], [19968, 40959], [63744, 64255], [131072, 173791], [173824, 177983],
        [177984, 178207], [178208, 183983], [183984, 191471], [191472, 192095], [196608, 201551], [201552, 205743], [194560, 195103],
        [4352, 4607], [43360, 43391], [55216, 55295], [12592, 12687], [44032, 55203], [65440, 65500],
    ],
}
COMMON = ("ascii_alnum", "ascii_punct_space", "common_unicode", "unknown")
#: A cell with a larger share of unknown characters is flagged.
UNKNOWN_PERCENT = 20.0


def load(path: str | Path) -> dict[str, list[list[int]]]:
    return {k: v for k, v in json.loads(Path(path).read_text()).items() if isinstance(v, list)}


def classify(code: int, ranges: dict[str, list[list[int]]] = RANGES) -> str:
    flat = sorted((s, e, k) for k, spans in ranges.items() for s, e in spans)
    i = bisect.bisect_right(flat, code, key=lambda x: x[0]) - 1
    return flat[i][2] if i >= 0 and code <= flat[i][1] else "unknown"


def _class_of(spans: list[list[int]]) -> str:
    return "[" + "".join(rf"\x{{{s:X}}}-\x{{{e:X}}}" for s, e in spans) + "]"


def bare(text: Column) -> Column:
    """What isn't ASCII. Most texts are nearly all ASCII, and the many ranges of the other classes are slow to test."""
    return F.regexp_replace(text, r"[\x00-\x7F]+", "")


def counts(text: Column, other: Column, ranges: dict[str, list[list[int]]] = RANGES) -> dict[str, Column]:
    """The number of a text's characters in each class, natively. other is bare(text), as a column of its own, so that it is
    made once."""
    ascii_only = {k for k, v in ranges.items() if all(e < 128 for _, e in v)}
    mixed = {k for k, v in ranges.items() if k not in ascii_only and any(s < 128 for s, _ in v)}
    found = {k: F.regexp_count(text if k in ascii_only | mixed else other, F.lit(_class_of(v))).cast("long") for k, v in ranges.items()}
    found["unknown"] = F.length(text).cast("long") - sum(found.values(), F.lit(0).cast("long"))
    return found
