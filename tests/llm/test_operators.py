"""Training-data operators against brute force on small fixtures with awkward rows."""

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat_format as chat
from lodestone.llm import common, decontaminate, embed_dedup, jaccard_join, line_dedup, mixing, quality, token_counts, tokens_out, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = ["alpha", "bravo", "carbon", "delta", "echo", "forest", "golf", "hotel"]


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) + str(r.randrange(60)) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    base = words(120, 1)
    near = base[:60] + ["changed"] + base[61:]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, None), (5, ""), (6, "one two"), (7, "one two"), (8, " \n\t "), (9, " ".join(words(3000, 2))), (10, "Ünï 'cödé' <|endoftext|> x  y\n z"), (11, " ".join(words(40, 3) + base[:40]))]
    rows += [(20 + i, " ".join(words(80, 50)[:70] + words(10, 100 + i))) for i in range(20)]  # a group of near copies
    rows += [(60 + i, " ".join(words(30, 7) + words(40, 200 + i))) for i in range(30)]  # a shared passage
    rows.append((6, "one two"))
    return spark.createDataFrame([(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (7, 8), (5, 5), (None, 4)], "u bigint, v bigint")
    assert {tuple(r) for r in common.connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (7, 7), (8, 7)}
    assert common.connected_components(e.limit(0)).count() == 0


def test_components_few_and_many(spark):
    """Small forests take few jobs, whatever the number of steps; both ways find the same components."""
    r = random.Random(4)
    chain = r.sample(range(10**12, 10**12 + 10**6), 300)  # a path of ids in no order
    pairs = [*itertools.pairwise(chain), *((2**62, i) for i in range(200, 400)), *((r.randrange(-900, 0), r.randrange(-900, 0)) for _ in range(400))]
    e = spark.createDataFrame([(int(u), int(v)) for u, v in pairs], "u bigint, v bigint").repartition(7)
    root = {}

    def find(x):
        while (p := root.setdefault(x, x)) != x:
            x = p
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    expected = {(x, find(x)) for x in root if any(x in p and p[0] != p[1] for p in pairs)}
    spark.sparkContext.setJobGroup("few", "components")
    got = common.connected_components(e)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == expected and len(rows) == len(expected)
    assert len(jobs) <= 6
    rows = [tuple(x) for x in common.connected_components(e, few=0).collect()]
    assert set(rows) == expected and len(rows) == len(expected)


def test_line_dedup(spark, empty):
    long = [" ".join(words(20, i)) for i in range(6)]
    rows = [(1, "\n".join(["head", *long[:4], "tail"])), (2, "\n".join(["other", *long[:3], "mine"])), (3, "\n".join(long[1:4]) + "\ntail"), (4, "head\ntail"), (5, None), (6, ""), (7, "\n".join([long[5], "a", long[5], "b"])), (8, "\n".join(long[:3])), (8, "\n".join(long[:3]))]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n_cut int")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: rows[0][1], 2: "other\nmine", 3: "", 4: "head\ntail", 5: None, 6: "", 7: rows[6][1], 8: ""}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_awkward(spark):
    """Clashing columns, null ids, ties, repeated lines in one text, and far fewer fingerprints than lines."""
    line = [" ".join(words(12, i)) for i in range(40)]
    rows = [(1, "\n".join(line)), (2, "\n".join(line[3:30])), (None, "\n".join(line)), (3, "\n".join([line[0]] * 12)), (4, "x" * 100_000 + "\n" + "\n\n".join(line[5:12]))]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], "doc_id bigint, text string, cuts int, th int, h int, s int, _th int")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1]["text"] == rows[0][1] and got[None]["text"] == rows[2][1] and got[2]["text"] == "" and got[2]["n_cut"] == 27
    assert got[3]["n_cut"] == 11 and got[4]["text"] == "x" * 100_000 and got[1]["cuts"] == 1 and got[1]["_th"] == 5
    marks = line_dedup.fingerprints(df.where("doc_id = 1"))
    assert marks.count() == 36 and 1 <= marks.where("picked").count() <= 25
    assert {r["fp"] for r in marks.collect()} == {r["fp"] for r in marks.where("picked").collect()}


def brute_count(model, text):
    best = {0: (0.0, 0)}
    for i in range(1, len(text) + 1):
        n = len(text[i - 1].encode())
        options = [(best[i - 1][0] + n * model.byte_score, best[i - 1][1] - n)]
        options += [(best[j][0] + model.score[text[j:i]], best[j][1] - 1) for j in range(i) if text[j:i] in model.score]
        best[i] = max(options)
    return -best[len(text)][1]


def test_line_dedup_against_all_runs(spark):
    """Every line inside any run of enough words that occurs earlier is deleted, not just along the earliest place."""
    r = np.random.default_rng(2)
    texts = ["a b c d e", "a b c d e\nx", "a b c d e\nx\nz"]  # the review's case: x of the third stands in the second
    texts += ["\n".join(" ".join([c] * (1 + ord(c) % 3)) for c in r.choice(list("klmno"), 12)) for _ in range(40)]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 5).collect()
    words, seen, want = lambda run: sum(x.count(" ") + 1 for x in run), set(), {}
    for i, t in enumerate(texts):
        lines, cut = t.split("\n"), set()
        for s in range(len(lines)):
            runs = [tuple(lines[s:e]) for e in range(s + 1, len(lines) + 1) if words(lines[s:e]) >= 5]
            cut |= {p for run in runs if run in seen for p in range(s, s + len(run))}
            seen |= set(runs)
        want[i] = "\n".join(x for p, x in enumerate(lines) if p not in cut)
    assert want[2] == "z" and {x["doc_id"]: x["text"] for x in got} == want


def test_token_counts(spark, docs, empty):
    path = token_counts.vocabulary_file()
    model = token_counts.Unigram.from_file(path)
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs, path).collect())
    want = sorted((r.doc_id, len((r.text or "").split()), sum(brute_count(model, "▁" + w) for w in (r.text or "").split())) for r in docs.collect() if r.doc_id != 9)
    assert [g for g in got if g[0] != 9] == want
    trie = token_counts.Trie(model)
    assert trie.count("x" * 500) == brute_count(model, "▁" + "x" * 500)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_factorisation_identity():
    fm = quality.FactorisationMachine(0.3, np.random.default_rng(0).normal(size=quality.N_FEATURES), np.random.default_rng(1).normal(size=(quality.N_FEATURES, 4)))
    idx, val = quality.features(["Some words, some WORDS 12 %%%", "", None], [10, None, 3])
    for i, x, got in zip(idx, val, fm.margins(idx, val), strict=True):
        pairs = sum(fm.v[a] @ fm.v[b] * xa * xb for (a, xa), (b, xb) in itertools.combinations(zip(i, x.astype(float), strict=True), 2))
        assert got == pytest.approx(0.3 + fm.w[i] @ x.astype(float) + pairs, rel=1e-9)


def test_quality_held_out(spark, empty):
    rows = [(i, " ".join(words(60, i)) if i % 4 else " ".join(w.upper() + "!!%%" for w in words(60, i))) for i in range(400)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    out = quality.score_documents(df, quality.train(df, labels)).collect()
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 > 0) for r in held]) > 0.95
    kept = quality.score_documents(df.withColumnRenamed("lang", "score"), quality.train(df, labels), keep_text=True)
    assert kept.count() == 400 and set(empty.columns) - {"lang"} <= set(kept.columns)
    assert quality.score_documents(empty, quality.train(empty, labels)).count() == 0
    # of an id with several texts one is learned from, and null ids, null labels and repeated labels do no harm
    many = df.union(spark.createDataFrame([(5, f"text {i}", "en", "s", None) for i in range(50)] + [(None, "x", None, None, None), (None, None, None, None, None)], SCHEMA))
    seen = []
    fit = quality.fit
    quality.fit = lambda idx, val, y: seen.append(len(y)) or fit(idx, val, y)
    try:
        model = quality.train(many, labels.union(labels).union(spark.createDataFrame([(5, 9), (7, None)], "doc_id bigint, quality int")), max_rows=10)
    finally:
        quality.fit = fit
    assert 0 < seen[0] <= 10 and quality.score_documents(many, model).count() == many.count()


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "\\", "\\\\<|", "", "a\nb", "<<SYS>> [\\INST]", "ü😀"]
    df = spark.createDataFrame([([{"role": "we ird\n%", "text": t}, {"role": "assistant", "text": t}],) for t in texts] + [([],), (None,)], "turns array<struct<role:string,text:string>>")
    for r in chat.read_chat(chat.format_chat(df)).collect():
        assert r["turns_read"] == r["turns"]
        if r["turns"]:
            assert r["formatted"].count("<|im_end|>") == len(r["turns"]) and "[INST]" not in r["formatted"]


def test_chat_layouts(spark):
    rows = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"instruction":"q","output":"a"}', '{"instruction":"q","input":"","output":"a"}', '{"prompt":"q","response":"a"}', '{"completion":"a","prompt":"q"}', '{"odd":1}', "broken", None]
    got = chat.canonical_turns(spark.createDataFrame([(r,) for r in rows], "record string")).collect()
    assert [r["layout"] for r in got] == ["messages", "conversations", "instruction", "instruction_input", "prompt_response", "prompt_completion", None, None, None]
    assert all([tuple(t) for t in r["turns"]] == [("user", "q"), ("assistant", "a")] for r in got[:6])
    assert all(r["turns"] is None for r in got[6:])


def test_chat_layouts_of_real_records(spark, monkeypatch):
    """Further keys, empty arrays and keys that only later elements have do not hide a layout; the rest is visible."""
    q, a = '{"role":"user","content":"q"}', '{"role":"assistant","content":"a"}'
    rows = ['{"messages":[%s,%s],"id":7}' % (q, a), '{"prompt":"p","source":"s","messages":[{"name":"n","role":"user","content":"q"},%s]}' % a, '{"messages":[{"role":"user"},%s]}' % a]
    rows += ['{"messages":[]}', '{"system":"s","conversations":[{"from":"human","value":"q","w":1},{"from":"gpt","value":"a"}]}', '{"instruction":"q","output":"a","id":1}']
    rows += ['{"odd":1}', '{"messages":["q"]}', '{"messages":[null]}', "broken", None]
    done = chat.canonical_turns(spark.createDataFrame([(r,) for r in rows], "record string"))
    got = done.collect()
    assert [r["layout"] for r in got] == ["messages"] * 4 + ["conversations", "instruction"] + [None] * 5
    assert [[tuple(t) for t in r["turns"]] for r in got[:6]] == [[("user", t), ("assistant", "a")] if t != "" else [] for t in ("q", "q", None, "", "q", "q")]
    assert [r["record"] for r in chat.unmatched(done).collect()] == rows[6:]
    # tables with a row per turn go through the same lookup
    table = spark.createDataFrame([(1, "x", "user", 0, "q")], "conv_id bigint, more string, role string, turn bigint, text string")
    calls = []
    monkeypatch.setattr(chat, "fingerprint", lambda paths, f=chat.fingerprint: calls.append(1) or f(paths))
    assert [tuple(t) for t in chat.turns_from_table(table).first()["turns"]] == [("user", "q")] and calls
    # ties, nulls, repeated rows, null ids, a long text, clashing columns, other layouts, an empty table
    long = "x" * 300_000
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, None, None, "first"), (1, 1, "user", "a"), (None, 0, "user", None), (2, 0, "assistant", long)]
    table2 = spark.createDataFrame([(*r, "no", "no") for r in rows], "conv_id bigint, turn bigint, role string, text string, record string, turns string")
    want = {1: [("", "first"), ("user", "a"), ("user", "a"), ("user", "b")], None: [("user", "")], 2: [("assistant", long)]}
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.turns_from_table(table2).collect()} == want
    renamed = table2.select(F.col("conv_id").alias("dialog"), F.col("turn").alias("position"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("from"), F.col("text").alias("value"))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.turns_from_table(renamed).collect()} == want
    assert chat.turns_from_table(table2.limit(0)).count() == 0
    # a later message of another shape: no mapping reads the record, and it is visible
    mixed = spark.createDataFrame([('{"messages":[{"role":"user","content":"q"},{"from":"gpt","value":"a"}]}', 1)], "record string, layout int")
    assert chat.canonical_turns(mixed).first()["layout"] is None and chat.unmatched(chat.canonical_turns(mixed)).count() == 1
    with pytest.raises(ValueError, match="no mapping"):
        chat.turns_from_table(table.drop("role"))


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = tokens_out.tokenizer_file()
    t = Tokenizer.from_file(path)
    tokens_out.write_tokens(docs, str(tmp_path / "t"), path)
    got = sorted(tuple(r) for r in tokens_out.digest_tokens(tokens_out.read_tokens(spark, str(tmp_path / "t"))).collect())
    start, want = 0, []
    for i, text in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    tokens_out.write_tokens(empty, str(tmp_path / "e"), path)
    assert tokens_out.read_tokens(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "\n a b", "a \n b", "it's 5.5 x", "<|endoftext|> a", "a <|endoftext|>b c", "  a  b", "a  b", "tab\tb c", "   ", "é ǘ z"])
def test_encoder_equals_library(text):
    enc = tokens_out.encoder(tokens_out.tokenizer_file())
    assert enc([text, text])[1] == np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()


def test_encoder_at_every_cut(monkeypatch):
    """Punctuation, line feeds, odd white space and marks in every neighbourhood, with a cache that forgets."""
    from tokenizers import Tokenizer

    path = tokens_out.tokenizer_file()
    library, encoder, r = Tokenizer.from_file(path), tokens_out.CachedEncoder(path), random.Random(5)
    assert encoder.fine
    plain = [*"abzAZé×÷ñÀ", *"  \n\n\t\r", *".,;!?'-_()1290", "\u2003", "\u00a0", "\u0085", "\u3000", "日本", "😀", "\u0301", "'s", "'ll", "\x1c", "«", "word ", "the ", ".\n", "\n\n"]
    for k in range(120):
        pieces = plain if k % 2 else [*plain, "<|endoftext|>", "<", "|"]
        texts = ["".join(r.choices(pieces, k=r.randrange(30))) for _ in range(r.randrange(1, 40))]
        if k == 20:
            monkeypatch.setattr(tokens_out, "CACHE", 200)
        for text, got in zip(texts, encoder(texts), strict=True):
            assert np.frombuffer(got, np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_mixing(spark, docs, empty):
    tokens = {"a": 900, "b": 90, "c": 10}
    alpha = mixing.solve_alpha(tokens, max_repeat=2.0)
    assert mixing.repetitions(tokens, alpha) == pytest.approx(2.0)
    target = mixing.entropy(tokens, 0.5)
    assert mixing.solve_alpha(tokens, target_entropy=target) == pytest.approx(0.5, abs=1e-6)
    rows = mixing.mix_sources(docs, block_tokens=256).collect()
    assert len(rows) == docs.count() and all(r["mix_copies"] in (1, 2) for r in rows)
    half = mixing.mix_sources(docs, budget=2000, block_tokens=256).collect()
    assert sum(r["mix_copies"] * r["mix_tokens"] for r in half) <= 2000
    assert mixing.realise(mixing.mix_sources(empty)).count() == 0
    shares = spark.createDataFrame([(t / 1000,) for t in tokens.values()], "p double")
    assert mixing.entropy_alpha(shares, target) == pytest.approx(0.5, abs=1e-6)
    assert mixing.mix_sources(docs, None, 0.9, block_tokens=256).where("mix_copies < 1").count() == 0
    # columns with the names used inside, and with those added
    odd = docs.withColumns({c: F.lit(7) for c in ("state", "epochs", "fits", "nb", "left", "t", "quota", "tokens", "cell", "mix_block", "_key", "_h")})
    again = mixing.realise(mixing.mix_sources(odd, block_tokens=256))
    assert again.where("state = 7 and nb = 7 and _key = 7").count() == sum(r["mix_copies"] for r in rows)
    # in each epoch the blocks of a source stand in a permutation
    places = again.select("source", "mix_epoch", "mix_block", "mix_order").distinct().collect()
    assert len({(p["source"], p["mix_epoch"], p["mix_order"]) for p in places}) == len(places)


def brute_hits(text, items):
    w = [x.decode() for x in decontaminate.words(text)]
    hit, found = set(), set()
    for item, t in items:
        q = [x.decode() for x in decontaminate.words(t)]
        n = min(13, len(q))
        for a in range(len(q) - n + 1 if n else 0):
            for s in range(len(w) - n + 1):
                if w[s : s + n] == q[a : a + n]:
                    hit |= set(range(s, s + n))
                    found.add(str(item))
    items = sorted(found)
    return len(w), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, docs, empty, monkeypatch):
    base = words(120, 1)
    items = [(1, " ".join(base[10:40])), (2, " ".join(base[10:40])), (3, "one, TWO"), (4, None), (5, ""), (10, "cödé"), (30, " ".join(words(30, 7)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(tuple(r)[:5] + (r["contaminated"],) for r in decontaminate.match_benchmark(docs, bench).drop("items").collect())
    assert got == sorted((r.doc_id, *brute_hits(r.text, items)) for r in docs.collect())
    assert decontaminate.match_benchmark(empty, bench).count() == 0
    assert decontaminate.match_benchmark(docs, bench.limit(0)).where("contaminated").count() == 0
    # a proximity match lies in one document, however its neighbours begin and end
    split = spark.createDataFrame([(1, " ".join(base[:6])), (2, " ".join(base[6:13])), (3, None), (4, " ".join(base[:13]))], "doc_id bigint, text string").coalesce(1)
    one = spark.createDataFrame([(7, " ".join(base[:13]))], "item_id bigint, text string")
    assert {r["doc_id"]: r["n_items"] for r in decontaminate.match_benchmark(split, one, slop=1).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    # several blocks of items, an index of all terms, null and repeated ids, and clashing columns give the same
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(decontaminate, "MAX_TERMS", 5)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 700)
    odd = docs.unionByName(docs.where("doc_id in (1, 5)").withColumn("doc_id", F.lit(None).cast("bigint"))).withColumns({c: F.lit(1) for c in ("n_hit", "shard", "terms", "items")})
    again = sorted((tuple(r)[:5] + (r["contaminated"],) for r in decontaminate.match_benchmark(odd, bench).drop("items").collect()), key=str)
    assert again == sorted([*got, *[(None, *g[1:]) for g in got if g[0] in (1, 5)]], key=str)
    near = spark.createDataFrame([(1, " ".join(base[:5] + ["gap"] + base[5:13]), "", "", 1)], SCHEMA)
    phrase = spark.createDataFrame([(1, " ".join(base[:13]))], "item_id bigint, text string")
    assert [decontaminate.match_benchmark(near, phrase, slop=s).first()["n_items"] for s in (None, 1)] == [0, 1]


def test_embeddings(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(120, 16))
    v[40:80] = v[:40] + 0.03 * r.normal(size=(40, 16)) * np.linalg.norm(v[:40], axis=1, keepdims=True) / 4
    v[80:90] = v[0]
    rows = [(i, [float(np.float32(x)) for x in v[i]], i % 2 if i < 80 else 0) for i in range(120)]
    rows = [(i, e, lab if i < 40 else (rows[i - 40][2] if i < 80 else 0)) for i, e, lab in rows]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, rows[0][1], None), (204, [], 0), (205, [None] * 16, 0), (206, [1.0, 2.0], 0)]
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embed_dedup.dedup_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    ok = [(i, np.array(e), lab) for i, e, lab in rows if lab is not None and e and len(e) == 16 and None not in e and np.isfinite(e).all() and np.any(e)]
    links = {i: set() for i, *_ in rows}
    for (i, a, x), (j, b, y) in itertools.combinations(ok, 2):
        if x == y and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
            links[i].add(j), links[j].add(i)
    want = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        want[i] = (len(links[i]), min(seen), min(seen) == i)
    assert got == want
    assert embed_dedup.dedup_embeddings(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_embeddings_crowded_group(spark):
    """A third of all vectors are jittered copies of one, over several pivots and blocks: no link is lost."""
    r = np.random.default_rng(5)
    v = r.normal(size=(3600, 64))
    v[:1200] = v[0] / np.linalg.norm(v[0]) + r.normal(size=(1200, 64)) * 0.0177
    v[1200:1300] = v[1300:1400] + 0.15 * r.normal(size=(100, 64))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    got = {x["vec_id"]: x["n_links"] for x in embed_dedup.dedup_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    x = v.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.98
    np.fill_diagonal(links, False)
    assert 200_000 < links.sum() < 1200 * 1199
    assert [got[i] for i in range(len(rows))] == links.sum(axis=1).tolist()


@pytest.mark.parametrize("crowd", [300, 600])
def test_embeddings_dense_group(spark, monkeypatch, crowd):
    """Of 1000 vectors many lie close to one, some linked and some not: recall 1, with many pivots and blocks."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 64)
    r = np.random.default_rng(crowd)
    v = r.normal(size=(1000, 64))
    v[:crowd] = v[0] / np.linalg.norm(v[0]) + r.normal(size=(crowd, 64)) * r.uniform(0.005, 0.03, (crowd, 1))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, x.tolist(), 1, 0, 0) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, rep int, links int")
    got = {x["vec_id"]: x["n_links"] for x in embed_dedup.dedup_embeddings(df).collect()}
    x = v.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.98
    np.fill_diagonal(links, False)
    assert links.sum() > 10_000 and [got[i] for i in range(1000)] == links.sum(axis=1).tolist()


def test_embeddings_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.0], 0), (3, [1.0, 0.0], 1), (3, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = sorted(((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in embed_dedup.dedup_embeddings(df).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, None), (3, 0, 3, True), (3, 0, 3, True)], key=str)


def test_extra_columns_and_long_texts(spark):
    """Columns named like those inside, nulls in any column and very long texts do no harm to the plain operators."""
    long = " ".join(words(30_000, 77))
    rows = [(1, long), (2, long + " more"), (None, "a b"), (None, None), (3, ""), (3, "a b"), (3, "a b"), (4, "z" * 100_000)]
    df = spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, "x", 4, 5) for i, t in rows], SCHEMA + ", n int, key int, th int, part string, ids int, start int")
    path = token_counts.vocabulary_file()
    model = token_counts.Unigram.from_file(path)
    want = sorted(((i, len((t or "").split()), sum(model.count("▁" + w) for w in (t or "").split())) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in token_counts.count_tokens(df, path).collect()), key=str) == want
    groups = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_documents(df).collect()), key=str)
    size = len({tuple(long.split()[k : k + 5]) for k in range(29_996)})
    assert groups == sorted([(1, size, 1), (2, size + 1, 1), (None, 1, None), (None, 0, None), (3, 0, 3), (3, 1, 3), (3, 1, 3), (4, 1, 4)], key=str)
    folder = common.scratch_dir(spark, "token-extras")
    tokens_out.write_tokens(df, folder, tokens_out.tokenizer_file())
    got = tokens_out.digest_tokens(tokens_out.read_tokens(spark, folder)).collect()
    lib = tokens_out.encoder(tokens_out.tokenizer_file()).tokenizer
    assert sorted(r["n_tokens"] for r in got) == sorted(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert quality.score_documents(df, quality.train(df, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))).count() == len(rows)


def brute_components(rows):
    sets, ids = {}, sorted({i for i, _ in rows})
    for i, t in rows:
        w = [x for x in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (t or "").translate({k: k + 32 for k in range(65, 91)})).split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in ids}
    for _ in ids:
        for a, b in itertools.combinations(ids, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    return sorted((i, len(sets[i]), comp[i]) for i, _ in rows)


@pytest.mark.parametrize(("small", "popular"), [(12, 64), (2, 3)])
def test_jaccard(spark, docs, empty, monkeypatch, small, popular):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "POPULAR", popular)
    monkeypatch.setattr(jaccard_join, "HOT", small + 1)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)  # long lists are cut into several blocks
    got = sorted(tuple(r) for r in jaccard_join.similar_documents(docs).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard_join.similar_documents(empty).count() == 0


def test_jaccard_beyond_bounds(spark, docs, monkeypatch):
    """Beyond the bounds of what is broadcast or finished on the driver, results are the same."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "connected_components", lambda e: common.connected_components(e, few=0))
    assert sorted(tuple(r) for r in jaccard_join.similar_documents(docs).collect()) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_jaccard_hot_signatures(spark, monkeypatch, most):
    """Lists of signatures that many documents share are not gathered, and no link is lost; some beyond the bound are."""
    monkeypatch.setattr(jaccard_join, "HOT_LIST", 9)
    monkeypatch.setattr(jaccard_join, "MAX_HOT", most)
    monkeypatch.setattr(jaccard_join, "LOCAL", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "GROUP", 64)
    split, seen = jaccard_join._split_hot, []
    monkeypatch.setattr(jaccard_join, "_split_hot", lambda *a: seen.append(split(*a)) or seen[-1])
    base, r = words(80, 50), random.Random(6)
    rows = [(i, " ".join(base[:70] + words(10, 100 + i))) for i in range(40)]  # near copies, also changed in two places
    rows += [(100 + i, " ".join([f"z{i}" if k == r.randrange(80) else w for k, w in enumerate(base)])) for i in range(40)]
    rows += [(200 + i, " ".join(base[:30] + words(50, 400 + i))) for i in range(30)]  # share signatures without links
    rows += [(300, None), (301, ""), (None, " ".join(base)), (5, " ".join(base)), (5, " ".join(base[:72] + words(8, 7)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(tuple(x) for x in jaccard_join.similar_documents(docs).where("doc_id is not null").collect())
    assert got == brute_components([x for x in rows if x[0] is not None])
    lists = seen[0][1]
    assert lists.select("sig").distinct().count() > 1 or most == 5
    assert lists.select("sig").distinct().count() <= most


def test_open_lists_are_not_multiplied(spark, monkeypatch):
    """Lists meet their members as they are: the long ones alone are broadcast, and no table of list keys is blown up for it."""
    monkeypatch.setattr(jaccard_join, "LONG", 50, raising=False)
    rows = [(i, i * 10 + j, i * 10 + j // 2) for i in range(400) for j in range(3)] + [(1000, j, j // 60) for j in range(100)]
    members = common.materialise(spark.createDataFrame(rows, "list bigint, doc_id bigint, comp bigint"), "members-test")
    lists = common.materialise(jaccard_join._open_lists(members), "lists-test")
    got = jaccard_join._of_lists(members, lists.drop("rows"))
    assert sorted((r["list"], r["doc_id"], r["comp"], r["main"]) for r in got.collect()) == sorted((a, b, c, 0 if a == 1000 else a * 10) for a, b, c in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Generate explode" not in plan


def test_hash_of_long_words(spark):
    """Words that a polynomial modulo a power of two cannot tell apart, and very long ones, have hashes of their own."""
    parity = ["".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n)) for n in (256, 1024, 4096) for flip in (0, 1)]
    long = parity + ["x" * 5000, "x" * 4999 + "y", "y" + "x" * 4999] + [w[:9] for w in parity]
    rows = spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string")
    want = {w: min(i for i, x in enumerate(long) if x == w) for w in long}
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_documents(rows).collect()} == {i: want[w] for i, w in enumerate(long)}


def test_sketches_lose_no_link():
    r = np.random.default_rng(4)
    for n in (1, 5, 30, 31, 33, 300, 5000):
        pool = common.mix(r.integers(0, 1 << 62, 3 * n + 3).astype(np.uint64))
        for share in (0, 1, 2, 3):
            x, y = pool[:n], np.r_[pool[n * share // 20 : n], pool[n : n + n * share // 15]]
            both = len(np.intersect1d(x, y))
            a, b = (np.frombuffer(jaccard_join._sketch(z), np.uint8)[None] for z in (x, y))
            if 4 * both >= 3 * (len(x) + len(y) - both):
                assert jaccard_join._near(a, b, np.array([len(x) + len(y)])).all()
        assert n < 30 or not jaccard_join._near(a, np.frombuffer(jaccard_join._sketch(pool[n : 2 * n]), np.uint8)[None], np.array([2 * n])).any()


def test_signatures_lose_no_pair():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 7, 12, 40, 90, 300, 900):
        for _ in range(30):
            pool = np.unique(r.integers(0, 1 << 63, 2 * n + 2, dtype=np.int64).astype(np.uint64))
            x = pool[: n]
            drop = r.integers(0, n // 7 + 1)
            y = np.unique(np.r_[x[drop:], pool[n : n + r.integers(0, n // 8 + 1)]])
            if 4 * len(np.intersect1d(x, y)) >= 3 * len(np.union1d(x, y)):
                for share in (0.0, 0.5, 0.9, 1.0):  # of popular shingles
                    level = lambda s, q=share: np.where((s % np.uint64(1000)).astype(float) < 1000 * q, 6, 0).astype(np.int64)
                    assert len(np.intersect1d(jaccard_join.signatures(x, level(x)), jaccard_join.signatures(y, level(y))))


def test_warc(spark, monkeypatch):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 40_000
    rows = [(1, "http://a\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", "same"), (6, "u", "same"), (7, "u", big + "x"), (None, "u", "z"), (None, "u", "z"), (None, "v", "same"), (8, "u", "abc"), (8, "u", "other"), (8, "v", "abc")]
    pages = spark.createDataFrame([(*r, 0, "") for r in rows], "page_id bigint, url string, html string, times int, sha1 string")
    folder = common.scratch_dir(spark, "warc-test")
    warc.write_warc(pages, folder).write.parquet(f"{folder}-index")
    chunks = warc.read_warc(spark, spark.read.parquet(f"{folder}-index")).orderBy("record_id", "chunk_no").collect()
    for page, html in {1: "same", 3: "", 5: big, 7: big + "x"}.items():
        mine = [c for c in chunks if c["record_id"] == page]
        data = b"".join(c["chunk"] for c in mine)
        assert data == html.encode() and mine[-1]["digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode() == mine[-1]["payload_digest"]
    got = sorted(((c["record_id"], c["record_type"], c["refers_to"], c["payload_bytes"]) for c in chunks if c["last"]), key=str)
    n = len(big.encode())
    want = [(1, "response", None, 4), (2, "revisit", 1, 4), (3, "response", None, 0), (4, "revisit", 3, 0), (5, "response", None, n), (6, "revisit", 1, 4), (6, "revisit", 1, 4), (7, "response", None, n + 1), (None, "response", None, 1), (None, "revisit", None, 1), (None, "revisit", 1, 4), (8, "response", None, 3), (8, "response", None, 5), (8, "revisit", 8, 3)]
    assert got == sorted(want, key=str)
    assert warc.write_warc(pages.limit(0), common.scratch_dir(spark, "warc-none")).count() == 0
