import hashlib
import random
import zlib

import pytest

from matchloom.llm import conversation_trie, registry

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """rows: (conv, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), order, (role, text)))
    own = {c: [x[2] for x in sorted(xs)] for c, xs in convs.items()}
    made = {}
    for c, xs in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = tuple(own.get(base, [])[:h] + xs[h:])
    members = {}
    for c, xs in made.items():
        for d in range(len(xs) + 1):
            members.setdefault(xs[:d], []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        mine = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in mine) if mine else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in mine)
    out = []
    for k, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if made[c] == k)))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def query(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.op12_conversation_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    return sorted(str(tuple(r)) for r in got.collect())


def random_rows(seed, convs, longest, texts):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(("user", "assistant")), f"é{rng.randrange(texts)}" * rng.randrange(3)) for c in convs for t in range(rng.randint(1, longest))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("longest,texts", [(8, 2), (16, 1), (17, 1), (40, 2)])
def test_equals_brute_force(spark, tmp_path, longest, texts):
    rows = random_rows(longest, [*range(-12, 40), 1000, 1003, 7], longest, texts)
    assert query(spark, spark.createDataFrame(rows, SCHEMA), tmp_path) == brute(rows)


@pytest.mark.parametrize("fan", [2, 3])
def test_blocks_of_blocks(spark, tmp_path, monkeypatch, fan):
    """Several levels of blocks; conversations that are each other's beginnings, and branches at all depths."""
    monkeypatch.setattr(conversation_trie, "FAN", fan)
    rng = random.Random(fan)
    line = [("user", f"t{k}") for k in range(37)]
    rows = [(5 * c, t, *(line[t] if t < c else ("other", str(rng.randrange(2))))) for c in range(40) for t in range(min(37, c + rng.randrange(4)))]
    assert query(spark, spark.createDataFrame(rows, SCHEMA), tmp_path) == brute(rows)


def test_a_long_conversation_goes_over_ranges(spark, tmp_path):
    rows = [(5, t, "user", f"turn {t % 3}") for t in range(700)] + [(10, t, "user", f"turn {t % 3}") for t in range(650)] + [(11, 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert query(spark, df, tmp_path) == brute(rows)


def test_defined_cases(spark, tmp_path):
    rows = [
        (None, 0, "user", "no conversation"), (0, None, "user", "first"), (0, 3, None, None), (0, 3, "user", ""), (0, 3, "user", ""), (0, -1, "a", "bc"), (0, -1, "ab", "c"),
        (1, 5, "user", "own"), (2, 0, "user", "x" * 300_000), (6, 0, "user", "base absent"), (3, 0, "u", None), (3, 0, None, "u"), (7, 1, "user", "one"), (25, 0, "user", "own"),
    ]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA + ", conv int, item string, place int, n int")
    assert query(spark, df, tmp_path / "a") == brute(rows)
    assert query(spark, df.limit(0), tmp_path / "b") == []
    assert query(spark, df.where("conv_id is null"), tmp_path / "c") == []


def test_many_members_of_one_node(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 8)
    rows = [(c, t, "system", "the same") for c in range(0, 1500, 5) for t in range(2)] + [(c, 0, "system", "the same") for c in range(-600, 0, 5)]
    assert query(spark, spark.createDataFrame(rows, SCHEMA), tmp_path) == brute(rows)
