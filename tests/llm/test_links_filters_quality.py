"""Tool links, URL filters, the line field, embedding near-dedup and the pipeline."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import embedding_dedup, quality_crf, tool_links, url_filter


def test_tool_calls_are_linked_ordered_and_validated(spark):
    call = lambda *cs: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in cs]})
    rows = [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", call(("a", "add", {"y": 2, "x": 1}), ("b", "add", {"x": {"$ref": "a"}, "y": 1}))),
        (1, 2, "tool", '{"content": {"z": 1, "a": [1, 2]}, "tool_call_id": "a"}'),
        (1, 3, "assistant", call(("c", "add", '{"x": 1, "y": {"$ref": "b"}, "w": 0}'), ("d", "nope", {}), ("e", "add", "not json"))),
        (1, 4, "tool", '{"tool_call_id": "zz", "content": "x\\n\\"q\\""}'),
        (1, 5, "tool", "broken"),
        (2, 0, "assistant", call(("p", "add", {"x": {"$ref": "q"}, "y": 1}), ("q", "add", {"x": {"$ref": "p"}, "y": 1}), ("r", "add", {"x": {"$ref": "r0"}, "y": 1}))),
        (2, 1, "assistant", call(("a", "add", {"x": 1, "y": "no"}), ("a", "add", {"x": 1, "y": 3}))),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schema = {"add": {"x": {"type": "integer", "required": True}, "y": {"type": "integer", "required": True}}}
    got = {(r.conv_id, r.call_id): r for r in tool_links.link(*tool_links.tool_events(df), schema).collect()}
    a = got[1, "a"]
    assert (a.status, a.valid, a.level) == ("linked", True, 0)
    assert a.json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":{"a":[1,2],"z":1},"status":"linked"}'
    assert (got[1, "b"].level, got[1, "b"].status, got[1, "b"].errors) == (1, "unanswered", ["x: not a integer"])
    assert got[1, "c"].level == 2 and got[1, "c"].errors == ["y: not a integer", "w: not known"]
    assert got[1, "d"].errors == ["name: not a known tool"] and got[1, "e"].errors == ["arguments: not JSON"]
    assert got[1, "zz"].status == "orphan" and got[1, "zz"].valid is None and '"result":"x\\n\\"q\\""' in got[1, "zz"].json
    assert got[2, "p"].level is None and got[2, "q"].level is None and got[2, "r"].level == 0
    assert got[2, "a"].n_calls == 2 and got[2, "a"].errors == ["y: not a integer"]  # of a turn's two calls the arguments that sort first
    assert got[1, None].status == "orphan"
    for r in got.values():
        json.loads(r.json)
    none = df.limit(0)
    assert tool_links.link(*tool_links.tool_events(none), schema).count() == 0
    assert tool_links.link(*tool_links.dialogue_events(none)).count() == 0


def test_dialogues(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q\u0001é"), (1, 2, "assistant", None), (1, 4, "assistant", "late"), (1, 2, "assistant", "again"), (1, 1, "user", "q\u0001é"), (2, 0, "user", None), (2, 1, "assistant", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, status string")
    got = {(r.conv_id, r.call_id): r for r in tool_links.link(*tool_links.dialogue_events(df)).collect()}
    assert got[1, "0"].status == "unanswered" and got[1, "3"].status == "orphan"
    assert (got[1, "1"].n_calls, got[1, "1"].n_results, got[1, "1"].status) == (2, 2, "linked")
    assert got[2, "0"].errors == ["text: missing"] and json.loads(got[2, "0"].json)["result"] == ""


def levels_of(spark, refs):
    """Levels by plain recursion and by the operator, for (call, [calls it refers to])."""
    known = dict(refs)

    def plain(x, seen=()):
        if x in seen:
            return None
        below = [plain(p, (*seen, x)) for p in known[x] if p in known]
        return None if None in below else max(below, default=-1) + 1

    rows = [(1, i, json.dumps({"x": [{"$ref": p} for p in parents], "n": 1})) for i, parents in refs]
    got = tool_links.levels(spark.createDataFrame(rows, "conv_id long, call_id string, arguments string"))
    names = {r.k: r.call_id for r in spark.createDataFrame([(1, i) for i, _ in refs], "conv_id long, call_id string").select("call_id", tool_links.node("conv_id", "call_id").alias("k")).collect()}
    found = {names[r.node]: r.level for r in got.collect()}
    return {i: plain(i) for i, _ in refs}, {i: found.get(i, 0) for i, _ in refs}


def test_levels_equal_plain_recursion(spark):
    rng = random.Random(4)
    refs = [(str(i), [str(rng.randrange(max(0, i - 9), i)) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] if i else []) for i in range(60)]
    refs += [("p", ["q"]), ("q", ["r"]), ("r", ["p"]), ("s", ["r"]), ("t", ["s", "0"]), ("u", ["t"]), ("v", ["v"]), ("w", ["nowhere"]), ("y", ["y", "1"]), ("z", ["59", "u"])]
    want, got = levels_of(spark, refs)
    assert got == want and max(x for x in want.values() if x) > 6 and want["u"] is None


def test_a_chain_of_a_thousand_calls(spark):
    start = time.time()
    refs = [(f"c{i}", [f"c{i - 1}"] if i else []) for i in range(1000)]
    rows = [(1, i, json.dumps({"x": {"$ref": p[0]}} if p else {})) for i, p in refs]
    got = tool_links.levels(spark.createDataFrame(rows, "conv_id long, call_id string, arguments string"))
    assert sorted(r.level for r in got.collect()) == list(range(1, 1000)) and time.time() - start < 60


def test_references_and_numbers_have_one_reading(spark):
    call = lambda i, a: {"id": i, "name": "t", "arguments": a}
    wide = '{"tool_calls":[{"id":"d","name":"t","arguments":{"x":{"$ref":"\\u0062"}}},{"id":"e","name":"t","arguments":{"\\u0024ref":"d"}}]}'
    told = {"x": 'no {"$ref":"b"} here, "$ref":"b"', "$ref ": "b", "y": ["$ref", "b"], "z": {"$ref": 5}}
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": [call('a"x', {}), call("b", {}), call("c", {"x": {"$ref": 'a"x'}, "$ref": "b"})]})),
        (1, 1, "assistant", wide),
        (1, 2, "assistant", json.dumps({"tool_calls": [call("f", told), call("g", {"a\\": {"$ref": "c"}})]})),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r.level for r in tool_links.link(*tool_links.tool_events(df)).collect()}
    assert got == {'a"x': 0, "b": 0, "c": 1, "d": 1, "e": 2, "f": 0, "g": 2}
    numbers = ["100", "100.0", "1e2", "1E+2", "0.1e3", "1.50", "15e-1", "-0.0", "0", "1e25", "10000000000000000000000000.0", "123456789012345678901234567890", "0.000001", "1e-6", "1e-25", "0.0000000000000000000000001", "1e60", "1E+60"]
    texts = [f'{{"b":[{n},"x 1.0, 1e2 \\\\","\\"2.0"],"a":{n}}}' for n in numbers] + ["[1.0", '{"a":1,"a":2}', None, "1.0", '"1.0"', "[true,null]"]
    out = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tool_links.canonical(F.col("t")).alias("c")).collect()]
    form = lambda n: f'{{"a":{n},"b":[{n},"x 1.0, 1e2 \\\\","\\"2.0"]}}'
    assert out[:9] == [form(100)] * 5 + [form(1.5)] * 2 + [form(0)] * 2
    assert out[9] == out[10] and out[11] == form(numbers[11]) and out[12] == out[13] == form("0.000001") and out[14] == out[15] and out[16] == out[17] == form("1.0E60")
    assert out[18:] == ['"[1.0"', '"{\\"a\\":1,\\"a\\":2}"', "null", "1", '"1.0"', "[true,null]"]


def test_long_arguments_are_read_whole(spark):
    text = 'say "x" \\ \n' * 30000
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "user", "b"), (1, 4, "system", "c"), (1, 5, "assistant", "1.0")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, arguments string")
    got = {r.call_id: r for r in tool_links.link(*tool_links.dialogue_events(df)).collect()}
    assert json.loads(got["0"].json)["arguments"]["text"] == text and got["0"].errors == ["text: too long"]
    assert (got["2"].level, got["4"].level, got["4"].errors) == (1, 2, ["turn: too large"])


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = sorted((-len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p))
    return host, path, fits[0][1] if fits else None, fits[0][2] if fits else "allow"


def test_urls_equal_plain(spark):
    rng = random.Random(5)
    hosts = ["example.com", "EXAMPLE.net", "a.example.com", "com", "net", "x.org", "notcom", "xexample.net", "a..com", ".com", "com.", "é.Net", ""]
    paths = ["/en/7", "/en/70", "/de/8/9", "/de/", "/es/", "/", "", "/en", "//en/", "/EN/"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?a=/en/", "#x?y", "/" * 300)]
    urls += [None, "", "nothing", "com/en/", "://", "a://b://com/en/", "http://com:80/en/", "http://x\ny.com/en/\nz", "http://" + "a." * 5000 + "com/en/"]
    df = spark.createDataFrame([(i, u, "clash", "c") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, host string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert len(got) == len(urls) + 3
    for i, u in enumerate(urls):
        assert got[i] == plain_verdict(u), u
    assert url_filter.judge(df.limit(0)).count() == 0


def test_a_cascade_is_exact_with_many_false_positives(spark):
    listed = [f"k{i}" for i in range(0, 9000, 3)]
    universe = spark.range(9000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    cascade = url_filter.Cascade.build(listed, universe)
    assert len(cascade.levels) > 2 and cascade.bits < 12 * len(listed)
    wrong = universe.where(cascade.has(F.col("key")) != (F.substring("key", 2, 9).cast("int") % 3 == 0)).count()
    assert wrong == 0
    assert universe.where(url_filter.Cascade.build([], universe).has(F.col("key"))).count() == 0


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(7)
    e, step = rng.normal(size=(3, 4)), rng.normal(size=(2, 2))
    lengths = [4, 2, 1]
    there = np.arange(4)[None] < np.array(lengths)[:, None]
    ahead, behind, z = quality_crf.forward_backward(np.where(there, e, 0), there, step)
    for c, n in enumerate(lengths):
        paths = {p: np.exp(sum(e[c, t] * p[t] for t in range(n)) + sum(step[a, b] for a, b in zip(p, p[1:]))) for p in product((0, 1), repeat=n)}
        total = sum(paths.values())
        assert np.isclose(np.log(total), z[c])
        for t in range(n):
            want = sum(v for p, v in paths.items() if p[t]) / total
            assert np.isclose(np.exp(ahead[c, t, 1] + behind[c, t, 1] - z[c]), want)


def test_the_gradient_equals_differences():
    rng = np.random.default_rng(3)
    sizes = np.array([4, 3, 1])
    row, col = np.repeat(np.arange(3), sizes), np.concatenate([np.arange(n) for n in sizes])
    there = np.zeros((3, 4), dtype=bool)
    there[row, col] = True
    x, y, theta = rng.normal(size=(8, 5)), np.array([1, 0, 1]), rng.normal(size=9) * 0.5
    rest = (x, row, col, there, y[row], np.bincount(y, weights=sizes - 1, minlength=2))
    _, g = quality_crf.likelihood(theta, *rest)
    for k in range(9):
        step = np.eye(9)[k] * 1e-6
        slope = (quality_crf.likelihood(theta + step, *rest)[0] - quality_crf.likelihood(theta - step, *rest)[0]) / 2e-6
        assert np.isclose(g[k], slope, atol=1e-6)


@pytest.mark.parametrize("cells", [1 << 18, 7])
def test_scores_equal_chains_one_by_one(cells, monkeypatch):
    """Texts scored together, whatever their lengths, against a plain walk over each one's lines."""
    monkeypatch.setattr(quality_crf, "CELLS", cells)
    rng = np.random.default_rng(4)
    width = 3 + 3 * quality_crf.N_OWN
    field = quality_crf.LineField(rng.normal(size=width) * 0.1, rng.uniform(0.5, 2, width), rng.normal(size=width) * 0.3, rng.normal(size=(2, 2)), 0.4)
    texts = ["One line.", None, "", "a\nb b b\n\nC!! 12", "\n", "x y z.\n" * 9, "é " * 50 + "\nend"]

    def plain(text):
        lines = (text or "").split("\n")
        if not "".join(lines):
            return 0.4
        e = ((quality_crf.chain_features(lines) - field.mean) / field.scale) @ field.weights
        n, step = len(lines), np.exp(field.step)
        unary = np.exp(np.stack([np.zeros(n), e], axis=1))
        ahead, behind = [unary[0]], [np.ones(2)]
        for t in range(1, n):
            ahead.append(ahead[-1] @ step * unary[t])
        for t in range(n - 1, 0, -1):
            behind.insert(0, step @ (unary[t] * behind[0]))
        good = [(a * b)[1] / (a @ b) for a, b in zip(ahead, behind, strict=True)]
        weights = [len(x) for x in lines]
        return sum(g * w for g, w in zip(good, weights, strict=True)) / sum(weights)

    assert np.allclose(field.scores(texts), [plain(t) for t in texts])


def test_a_long_document_teaches_by_a_stretch_of_its_lines():
    features = np.arange(1000)[:, None]
    starts = {int(quality_crf.stretch(features, i, 64)[0, 0]) for i in range(200)}
    assert len(starts) > 100 and all(len(quality_crf.stretch(features, i, 64)) == 64 for i in range(9)) and len(quality_crf.stretch(features[:5], 3, 64)) == 5


def test_quality_on_held_out_documents(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8)))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = "\n".join(" ".join(word().upper() + "!!" if bad else word() for _ in range(12)) + "." for _ in range(rng.randrange(1, 9)))
        rows.append((i, text, "en", "clash", 5, 6, "k"))
        labels.append((i, int(not bad)))
    rows += [(1000, None, "en", "c"), (1001, "", "en", "c"), (1002, "\n\n", "en", "c"), (None, "abc def.", "en", "c"), (1003, "abc de. " * 40000, "en", "c"), (5, rows[5][1], "en", "c"), (1004, "x\n" * 20000, "en", "c")]
    rows = [(*r, 5, 6, "k")[:7] for r in rows]
    labels += [(5, 1), (6, 0), (7, None), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, y int, id int, _ls_id string")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_crf.classify(docs, labelled).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [i for i in range(400) if by[i].held_out]
    assert 40 < len(held) < 130
    assert np.mean([by[i].predicted == int(i % 4 != 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert by[1000].score == by[1001].score == by[1002].score and by[None].held_out is False
    assert quality_crf.classify(docs.limit(0), labelled).count() == 0
    assert {round(r.score, 6) for r in quality_crf.classify(docs, labelled.limit(0)).collect()} == {0.5}


def plain_vectors(rows):
    n = len(rows)
    fine = [r[0] is not None and r[1] is not None and r[2] is not None and len(r[2]) > 0 and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2]) for r in rows]
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                a, b = np.array(rows[i][2]) / np.abs(rows[i][2]).max(), np.array(rows[j][2]) / np.abs(rows[j][2]).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                    links[i].add(j), links[j].add(i)
    own = list(range(n))
    for _ in range(n):
        own = [min([own[i]] + [own[j] for j in links[i]], key=lambda k: rows[k][0] if rows[k][0] is not None else 1e18) for i in range(n)]
    return {rows[i][0]: (len(links[i]), rows[own[i]][0]) for i in range(n)}


@pytest.mark.parametrize("block", [1024, 8])
def test_embedding_links_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(9)
    rows = []
    for c in range(25):
        centre = rng.normal(size=32)
        for _ in range(8):
            rows.append((len(rows) * 2, c % 3, (centre * rng.uniform(0.5, 2) + rng.normal(size=32) * rng.choice([0.02, 0.1, 0.2])).tolist(), "clash"))
    hot = rng.normal(size=32)
    rows += [(1000 + i, 1, (hot + rng.normal(size=32) * 0.01).tolist(), "c") for i in range(60)]
    rows += [(2000 + i, 2, hot.tolist(), "c") for i in range(30)]
    rows += [(3000, 1, None, "c"), (3001, None, hot.tolist(), "c"), (3002, 1, [0.0] * 32, "c"), (3003, 1, [float("nan")] * 32, "c"), (3004, 1, [], "c"), (3005, 1, [1e-300] + [0.0] * 31, "c"), (3006, 1, [1e300] + [0.0] * 31, "c"), (3007, 1, [1.0, 0.0], "c"), (None, 1, hot.tolist(), "c")]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, links string").repartition(5)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    want = plain_vectors(rows)
    assert len(got) == len(rows)
    for k, (n, own) in want.items():
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (n, own, k is not None and own == k), k
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_tables_grow_slowly_and_miss_little():
    shapes = [embedding_dedup.shape(n, 0.98) for n in (0, 200, 10**4, 10**6, 10**9)]
    assert [k for k, _ in shapes] == sorted(k for k, _ in shapes) and shapes[-1][1] < shapes[2][1] * (10**5) ** 0.16
    rng = np.random.default_rng(2)
    for d in (0.2, 1.0, 2**0.5):
        x, b = rng.normal(size=200000) * d, rng.uniform(size=200000)
        assert abs((np.floor(x + b) == np.floor(b)).mean() - embedding_dedup.agreement(d)) < 0.005
    near = embedding_dedup.agreement(0.2)
    assert all((1 - near**k) ** t <= embedding_dedup.MISSED for k, t in shapes)


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src1", 0), (None, "only here once, truly. ", "en", None, 9)], docs.schema)
    now = docs.unionByName(odd).withColumn("size", F.lit("clash")).withColumn("_ls_size", F.lit("clash"))
    before, names = now.count(), now.columns
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == names and [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in now.schema]
        now = pipeline.cut(out, name)
        if name != "mixing":
            assert 0 < now.count() <= before
            before = now.count()
    got = pipeline.STAGES[-1][1](spark, now, sf)
    assert got.count() == now.count() > 0
    first, second = (sorted((str(r.doc_id), r.ids_sha256) for r in pipeline.run(spark, sf).collect()) for _ in range(2))
    assert first == second and len(first) > 50
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
