import re

import pytest

SF = "/root/testdata/sf0.001"

EDGE = [
    # doc_id, text, source, n_words and kept clash with result columns
    (1, None, "a", 7, True),
    (2, "", "a", 7, True),
    (3, "   \n\t ", None, 7, True),
    (None, "a document without an id but with a good many words to keep it here", "b", 1, None),
    (4, "same text twice under one id with enough words to be kept by the rules", "b", 1, None),
    (4, "same text twice under one id with enough words to be kept by the rules", "b", 1, None),
    (5, "tie on the id but another text with enough words to be kept by the rules", "c", 1, None),
    (5, "tie on the id and yet another text with enough words to be kept by rules", "c", 1, None),
    (6, "long " + " ".join(f"word{i}" for i in range(30_000)), "c", 1, None),
    (7, "again and again and again and again and again and again and again and again", "c", 1, None),
    (8, "Ünïcode ÉÀ ſ K text “quoted” 中文 … and some more plain words to reach ten", "ü", 1, None),
    (9, "x\x00y \x1c z \x85 nbsp here <|endoftext|> <|ENDOFTEXT|> it's THE end, ok. a,b. 'tis ... ,. ,", "d", 1, None),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, source string, n_words int, kept boolean")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def ascii_lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def terms(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(s))
