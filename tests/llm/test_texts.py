"""Token counts, byte-level BPE and SimHash against plain versions of the same thing."""

import hashlib
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lodestrata.llm import byte_bpe, simhash_dedup, token_counts

TEXTS = [
    "The quick brown fox can't jump. 12345 !!!", "", None, " ", "\n\n\n", "a", "a  b   c\t\td \n e\r\n", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>z <|endoftext",
    "Éöß œuvre 中文字 العربية  \u0085  x​y", "🙂🙃 ok", "word " * 3000, "a" * 5000, "ab1 " * 10 + "\n" * 50 + "end", "I'll we've they're 'sx 'S", "".join(map(chr, range(0, 256))), "".join(chr(c) + "a " for c in range(0, 0x250)),
]


def frame(spark, texts):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, size string, ids string")


def test_token_counts_match_the_library(spark):
    data = byte_bpe.file_bytes(P.path("byte_bpe_50k.json"))
    lib = Tokenizer.from_str(data.decode())
    texts = TEXTS + ["The quick"] * 2
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, texts), data, P.PATTERN, 10).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want, len((t or "").encode()), want > 10), t
    assert token_counts.count_tokens(frame(spark, []), data, P.PATTERN).count() == 0


@pytest.mark.parametrize("most", [1 << 19, 40, 1])
def test_a_full_table_of_pieces_changes_no_count(most, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_PIECES", most)
    data = byte_bpe.file_bytes(P.path("byte_bpe_50k.json"))
    lib, counter = Tokenizer.from_str(data.decode()), token_counts.PieceCounter(data, P.PATTERN)
    rng = np.random.default_rng(6)
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(list("ab1 \n\t.'é\x1c\x85\xa0²ª"), 200)) for _ in range(60)]
    for at in range(0, len(texts), 7):
        assert counter.totals(texts[at : at + 7]) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts[at : at + 7]]
    assert counter.totals([]) == [] and len(counter.young) + len(counter.old) <= 2 * max(most, 3000)


def test_the_faster_module_finds_the_same_pre_tokens():
    import regex

    rng = np.random.default_rng(7)
    chars = [chr(c) for c in range(256) if chr(c) not in token_counts._SEPARATORS] + list("aaabbb   ''stlvmdr") * 8
    for _ in range(400):
        t = "".join(rng.choice(chars, 60))
        assert token_counts.latin_finder(P.PATTERN)(t) == regex.findall(P.PATTERN, t)
    assert token_counts.latin_finder(r"\p{Lu}+| ") is None


def test_bpe_round_trip_and_ids(spark):
    ranks = byte_bpe.file_bytes(P.path("byte_bpe_50k.tiktoken"))
    enc = byte_bpe.encoding_of(ranks, P.PATTERN)
    got = {r.doc_id: r for r in byte_bpe.encode_documents(frame(spark, TEXTS), ranks, P.PATTERN, with_ids=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = np.array(enc.encode_ordinary(t or ""), dtype="<u4")
        assert got[i].n_tokens == len(ids) and bytes(got[i].ids) == ids.tobytes()
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(frame(spark, []), ranks, P.PATTERN).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64])
def test_safe_boundaries_change_no_id(size):
    ranks = byte_bpe.file_bytes(P.path("byte_bpe_50k.tiktoken"))
    enc = byte_bpe.encoding_of(ranks, P.PATTERN)
    rng = np.random.default_rng(5)
    for t in [t for t in TEXTS if t] + ["".join(rng.choice(list("ab1 \n\t.'é"), 400)) for _ in range(30)]:
        assert "".join(byte_bpe.blocks(t, size)) == t
        assert byte_bpe.encode(enc, t, size).tolist() == enc.encode_ordinary(t)


def brute_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            parent[find(j)] = find(i)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    return {i: min((ids[j] for j in g if ids[j] is not None), default=None) for g in groups.values() for i in g}


def test_golay_keys_meet_within_three_bits():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    stored = simhash_dedup.stored_keys(base)
    for trial in range(6):
        other = base.copy()
        for i in range(len(base)):
            for b in rng.choice(64, trial % 4, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        for s, p in zip(stored, simhash_dedup.probe_keys(other), strict=True):
            assert set(s) & set(p)
    near, there = simhash_dedup.near_codewords(np.arange(1 << 12) * 1999 % (1 << 23))
    assert set(there.sum(1)) <= {1, 6}


def test_simhash_components(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(50)]
    texts = [None, "", "  ", "One two", "one TWO", "a b c", "ÀB cd ef"] + [" ".join(rng.choice(words, 60)) for _ in range(60)]
    for t in list(texts[7:40]):
        parts = t.split()
        parts[int(rng.integers(60))] = "changed"
        texts += [" ".join(parts), t]
    texts.append("long " * 70000 + "end")
    ids = [i * 3 for i in range(len(texts))]
    prints = [brute_fingerprint(t) for t in texts]
    want = brute_components(ids, prints)
    docs = spark.createDataFrame([(i, t, "q") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(docs).collect()}
    for k, i in enumerate(ids):
        assert got[i].fingerprint == f"{prints[k]:016x}" and got[i].component_id == want[k]
    kept = sorted(r.doc_id for r in simhash_dedup.keep_one(docs).collect())
    assert kept == sorted(set(want.values()))


def test_simhash_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 40, dtype=np.int64)
    found = set(base.tolist())
    for b in base.tolist():
        for k in range(1, 6):
            x = b
            for bit in rng.choice(64, k, replace=False):
                x ^= -(1 << 63) if bit == 63 else 1 << int(bit)
            found.add(x)
    want = {(min(a, b), max(a, b)) for a, b in combinations(found, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = simhash_dedup.links(spark.createDataFrame([(x,) for x in found], "fp long"))
    assert {(r.a, r.b) for r in got.collect()} == want


def test_simhash_probes_are_not_broadcast(spark, tmp_path):
    spark.range(100).selectExpr("xxhash64(id) AS fp").write.parquet(f"{tmp_path}/fps")
    plan = simhash_dedup.links(spark.read.parquet(f"{tmp_path}/fps"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_simhash_repeated_rows_nulls_and_nothing(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "x y z"), (None, "x y z"), (7, "a b c d"), (7, "k l m n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash_dedup.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, -1), (1, 1), (1, 1), (7, 1), (7, 7)]
    kept = sorted((r.doc_id or -1, r.text) for r in simhash_dedup.keep_one(docs).collect())
    assert kept == [(-1, "x y z"), (1, "a b c d"), (7, "k l m n")]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_dedup.near_duplicates(none).count() == 0 and simhash_dedup.keep_one(none).count() == 0
