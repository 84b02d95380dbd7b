"""The conversation trie against a plain trie built from lists of turns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lodestrata.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, rep long, digest string, p_pos int, node long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def sequences(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), digest(role, text), text))
    return {c: [(d, t) for _, d, t in sorted(v)] for c, v in own.items()}


def rebuilt(own):
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        src = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(src, [])[:h] + mine[h:]
    return out


def plain_trie(convs):
    members, last = defaultdict(list), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            key = tuple(t[0] for t in turns[:d])
            members[key].append(c)
            last[key] = turns[d - 1][1] if d else ""
    out = []
    for key, who in members.items():
        below = [k for k in members if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in below)]
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", last[k])) for k in below)
        ends = sorted(c for c in who if len(convs[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        out.append((min(who), len(key), parent, len(who), len(kids), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows(seed):
    rng, rows = random.Random(seed), []
    texts = ["", None, "a", "a b  c", "é\u0085é x", "word " * 40]
    for c in [*range(0, 60), -3, -20, 2**40 + 1]:
        rows += [(c, turn, rng.choice(["user", "assistant", None, "", "a"]), rng.choice(texts)) for turn in range(rng.choice([1, 2, 3, 4, 6]))]
    for c in range(100, 140):  # copies from end to end
        rows += [(c, turn, "user", f"same {turn}") for turn in range(5)]
    rows += [(7, None, "user", "first"), (7, None, "user", "also first"), (8, 1, "x", "tie"), (8, 1, "x", "tie"), (None, 0, "user", "nobody"), (9, 50, "user", "long " * 100000)]
    rows += [(300, turn, "u", str(turn)) for turn in range(11)] + [(301, turn, "u", str(turn % 10)) for turn in range(11)]
    return rows


def written(spark, rows, path):
    spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).write.parquet(f"{path}/conversations.parquet")


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("piece", [2, 512])
def test_the_query_equals_a_plain_trie(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(T, "PIECE", piece)
    rows = odd_rows(piece)
    written(spark, rows, tmp_path)
    assert got(T.query(spark, str(tmp_path))) == plain_trie(rebuilt(sequences(rows)))


def test_conversations_as_they_are(spark):
    rows = [r for r in odd_rows(3) if r[0] is None or r[0] < 20 or 100 <= r[0] < 110]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(T.prefix_trie(docs)) == plain_trie(sequences(rows))


def test_a_single_conversation_one_without_turns_and_none(spark, tmp_path):
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 1)
    written(spark, [(lone, 0, "user", "borrowed away")], tmp_path / "a")
    assert got(T.query(spark, str(tmp_path / "a"))) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    written(spark, [(20, 0, "user", "x y"), (20, 1, "user", "z")], tmp_path / "b")
    assert [r[:7] for r in got(T.query(spark, str(tmp_path / "b")))] == [(20, 0, None, 1, 1, 1, 0), (20, 1, 20, 1, 1, 1, 0), (20, 2, 20, 1, 0, 1, 0)]
    written(spark, [], tmp_path / "c")
    assert got(T.query(spark, str(tmp_path / "c"))) == []
