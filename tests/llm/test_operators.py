"""Edge cases and brute-force comparisons of the corpus operators on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import bpe, chat, components, context_tree, fingerprint, mixing, ngram_join, quality, token_file, url_filter, vectors, words

ROOT = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, extra=False):
    """Rows (doc_id, text[, source]); with clashing columns if asked for."""
    full = [(i, t, None, (s[0] if s else "a"), None if t is None else len(t)) for i, t, *s in rows]
    df = spark.createDataFrame(full, DOCS).repartition(3)
    if extra:
        for c in ("n", "size", "sid", "score", "component", "bucket", "taken", "seat", "name", "key_range"):
            df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, base), (2, base), (2, base), (3, base + " more"), (4, None), (5, ""), (6, "  \n\t "), (None, base), (7, "one"), (8, "ONE"), (9, "two words"),
        (10, LONG), (11, LONG + " tail"), (12, "é ß 日本 🙂 \u00a0x"), (13, "<|im_end|> <|endoftext|> it's  2  spaces \n\n"), (5, "another text with that id"),
    ]
    return rows, documents(spark, rows, extra=True).persist()


def text_rows(spark, root=ROOT):
    return spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()


# ---- words and n-gram join -------------------------------------------------

def shingles(text):
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    near = defaultdict(set)
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and (a or b) and 100 * len(a & b) >= 80 * len(a | b):
                near[i].add(j)
                near[j].add(i)
    label = {}
    for i in sorted({i for i, _ in rows if i is not None}):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in label:
                label[k] = i
                todo += near[k]
    return sorted(((i, len(s), label.get(i)) for i, s in sets), key=str)


def test_word_names_follow_ascii_rules():
    texts = ["The the\u00a0x THE", "", "\x0b the\x1c\n", "the"]
    names, counts = words.word_names(texts)
    assert counts.tolist() == [len(t.encode().split()) for t in texts]
    assert names[0] == names[2] == names[-1] and len(set(names.tolist())) == 3
    assert words.word_names([""])[0].tolist() == []


def test_ngram_join_edges(spark, odd):
    rows, df = odd
    found = sorted((tuple(r) for r in ngram_join.ngram_components(df).collect()), key=str)
    assert found == brute_components(rows)


def test_ngram_join_thresholds_chains_and_hot_groups(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(104)]  # 100 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:-20])), (3, " ".join(base[:-21])), (4, " ".join(base[:84]) + " q w e r t")]
    at = 10
    for family in range(6):  # families of edited copies, chained so that not all of a family link directly
        text = [f"f{family}w{i}" for i in range(rng.randint(30, 90))]
        for _ in range(25):
            text = list(text)
            text[rng.randrange(len(text))] = f"n{at}"
            rows.append((at, " ".join(text)))
            at += 1
    passage = [f"p{i}" for i in range(40)]
    for _ in range(40):  # one passage in many otherwise different documents
        rows.append((at, " ".join(passage + [f"o{at}_{i}" for i in range(rng.randint(3, 60))])))
        at += 1
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    found = sorted((tuple(r) for r in ngram_join.ngram_components(documents(spark, rows)).collect()), key=str)
    assert found == brute_components(rows)


def test_ngram_join_keeps_one_row_each(spark, odd):
    rows, df = odd
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    heads = {(i if c is None else c) for i, _, c in brute_components(rows)}
    assert set(ids) == heads and len(ids) == len(set(ids))


def test_bitmaps_never_part_linked_sets():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 300, 700):
        common = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        for d in range(0, n // 5 + 1, max(1, n // 20)):
            a = np.unique(np.concatenate([common, rng.integers(0, 1 << 62, d, dtype=np.uint64)]))
            if ngram_join.linked(np.unique(common), a):
                assert ngram_join.may_link(len(np.unique(common)), len(a), ngram_join.parity_bitmap(np.unique(common)).tobytes(), ngram_join.parity_bitmap(a).tobytes())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (500, 499)]
    found = dict(map(tuple, components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert found == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 140)} | {499: 499, 500: 499}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- mixing ----------------------------------------------------------------

def test_mixing_budgets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice("aaaaabcd")) for i in range(400)] + [(900, None, None), (901, "x y z", None), (None, "n n", "a"), (3, "r r r", "a")]
    df = documents(spark, rows, extra=True)
    out = mixing.mix(df, ranges=8).collect()
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    by = defaultdict(int)
    for r in out:
        by[(r["target"], r["source_size"])] += r["taken"]
    assert all(total == int(target) and target <= 2 * size for (target, size), total in by.items())
    assert sorted(map(str, mixing.mix(df, ranges=8).collect())) == sorted(map(str, out))
    mixed = mixing.mixed_documents(df, ranges=8)
    assert mixed.columns == df.columns
    assert sum(len(r["text"].split()) for r in mixed.collect()) == sum(r["taken"] for r in out)
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: -(-r["taken"] // r["size"]) for r in out if r["taken"] and r["doc_id"] != 3}) + Counter(
        {3: sum(-(-r["taken"] // r["size"]) for r in out if r["doc_id"] == 3 and r["taken"])}
    )


@pytest.mark.parametrize("sizes", [[("a", 100)], [("a", 10), ("b", 1000), ("c", 10)], [("a", 5), ("b", 5), (None, 5), ("d", 0)]])
def test_mixing_targets_by_filling(spark, sizes):
    out = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, (s, _) in enumerate(order)}
    left, budget, want = dict(sizes), 1.5 * sum(n for _, n in sizes), {}
    while left:
        each = {s: budget * weight[s] / sum(weight[k] for k in left) for s in left}
        over = [s for s in left if each[s] >= 2 * left[s]]
        if not over:
            want |= each
            break
        for s in over:
            want[s] = 2.0 * left.pop(s)
            budget -= want[s]
    assert out == pytest.approx(want)


# ---- language model --------------------------------------------------------

def test_context_tree_probabilities_add_up():
    texts = [b"abracadabra", b"banana bandana", b""] * 3
    pairs, counts = np.unique(context_tree.grams(texts)[0], return_counts=True)
    levels = context_tree.subtree(pairs, counts)
    import pyarrow as pa

    found = context_tree.read_off(levels, context_tree.ROOT)
    roots = pa.table({"key": levels[0].key.view(np.int64), "n": levels[0].zeros + levels[0].ones, "ones": levels[0].ones, "weighted": levels[0].weighted})
    depth = np.concatenate([np.full(len(v.key), context_tree.ROOT + k) for k, v in enumerate(levels)])
    nodes = pa.table({"depth": depth, "key": np.concatenate([v.key for v in levels]).view(np.int64), "p": np.concatenate(found)})
    model = context_tree.Model(*context_tree._finished(roots, nodes), None, None, 1, 1, 1)
    for context in (0xFFFFFFFFFF, int.from_bytes(b"abrac", "big"), int.from_bytes(b"zzzzz", "big")):
        every = np.array([(context << 8) | b for b in range(256)], np.uint64)
        assert (10 ** model.log10_costs(every)).sum() == pytest.approx(1, abs=1e-4)
    assert model.log10_costs(context_tree.grams([b"banana"])[0]).sum() > model.log10_costs(context_tree.grams([b"nabana"])[0]).sum()


def test_root_weight_is_the_mixture_of_all_prunings():
    """Depth-1 trees by hand: weighted = (KT(root) + product of KT(children)) / 2."""
    zeros, ones = np.array([3.0, 1.0]), np.array([0.0, 4.0])
    below = context_tree.weigh(np.array([(1 << 8) | 1, (2 << 8) | 1], np.uint64), zeros, ones, None, 1)
    root = context_tree.weigh(np.array([1], np.uint64), np.array([4.0]), np.array([4.0]), below, 0)

    def kt(a, b):
        p, z, o = 1.0, 0, 0
        for bit in [0] * a + [1] * b:
            p *= ((o if bit else z) + 0.5) / (z + o + 1)
            o, z = o + bit, z + 1 - bit
        return p

    assert np.exp(root.weighted[0]) == pytest.approx(0.5 * kt(4, 4) + 0.5 * kt(3, 0) * kt(1, 4))


def test_context_tree_query(spark, odd, monkeypatch):
    monkeypatch.setattr(context_tree, "FREQUENT", 50)
    rows, df = odd
    for table in (df, spark.read.parquet(f"{ROOT}/documents.parquet")):
        data = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        out = context_tree.score(table, *context_tree.learn(table, frequent=50)).collect()
        train = [(t or "").encode().lower().split() for i, t in data if context_tree._training(i)]
        count = Counter(w for t in train for w in t)
        total, kinds = sum(count.values()) + len(train), len(count) + 1
        want = defaultdict(list)
        for i, t in data:
            mine = (t or "").encode().lower().split()
            c = [count[w] for w in mine] + [len(train)]
            want[i].append((not context_tree._training(i), len(c), sum(x > 0 for x in c), total, sum(np.log10((x + 0.1) / (total + 0.1 * (kinds + 1))) for x in c)))
        got = defaultdict(list)
        for r in out:
            got[r["doc_id"]].append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]))
            assert r["score"] < 0
        assert set(got) == set(want)
        for i in want:
            assert [x[:4] for x in sorted(got[i])] == [x[:4] for x in sorted(want[i])]
            assert [x[4] for x in sorted(got[i])] == pytest.approx([x[4] for x in sorted(want[i])])
    empty = documents(spark, [])
    assert context_tree.score(empty, *context_tree.learn(empty)).count() == 0


def test_context_tree_scores_by_the_whole_tree(spark):
    """More than 2 ** 21 nodes, most of them seen three times, in texts that repeat: every one counts."""
    import pyarrow as pa

    rng = random.Random(3)
    data = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 \u00e9", k=8000)) * 3 if i % 7 else None) for i in range(40)]
    df = context_tree.stored(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3, "doc_id"), "documents")
    pairs, counts = np.unique(context_tree.grams([(t or "").encode() for i, t in data if context_tree._training(i)])[0], return_counts=True)
    levels = context_tree.subtree(pairs, counts)
    roots = pa.table({"key": levels[0].key.view(np.int64), "n": levels[0].zeros + levels[0].ones, "ones": levels[0].ones, "weighted": levels[0].weighted})
    depth = np.concatenate([np.full(len(v.key), context_tree.ROOT + k) for k, v in enumerate(levels)])
    assert len(depth) > 1 << 21
    p = np.concatenate(context_tree.read_off(levels, context_tree.ROOT))
    nodes = pa.table({"depth": depth, "key": np.concatenate([v.key for v in levels]).view(np.int64), "p": p})
    whole = context_tree.Model(*context_tree._finished(roots, nodes), None, None, 1, 1, 1)
    got = {r["doc_id"]: r["score"] for r in context_tree.score(df, *context_tree.learn(df)).collect()}
    assert got == pytest.approx({i: whole.log10_costs(context_tree.grams([(t or "").encode()])[0]).sum() for i, t in data}, rel=1e-6)


def test_context_tree_sums_a_hot_part_as_it_comes(monkeypatch):
    """One part from many tasks: what is merged at once stays near the number of distinct pairs, the nodes are the same."""
    import pyarrow as pa

    pairs, counts = np.unique(context_tree.grams([b"e e e e" * 9, b"see me be e"])[0], return_counts=True)
    mine = (pairs >> np.uint64(8)) & np.uint64(0xFFFF) == (ord("e") << 8 | ord(" "))
    pairs, counts = pairs[mine], counts[mine]
    batch = pa.record_batch({"part": pa.array(np.full(len(pairs), 7, np.int32)), "name": pa.array(pairs.view(np.int64)), "n": pa.array(counts)})
    monkeypatch.setattr(context_tree, "COUNTED", 4)
    most, merged = [], context_tree._merged
    monkeypatch.setattr(context_tree, "_merged", lambda held: (most.append(sum(len(k) for k, _ in held)), merged(held))[1])
    rows = pa.Table.from_batches(context_tree._tree_batches(iter([batch] * 500)))
    assert max(most) <= 4 * len(pairs)
    want = context_tree.subtree(pairs, counts * 500)
    for k, level in enumerate(want):
        assert rows.column("keys")[k].as_py() == level.key.tobytes()
        assert np.allclose(np.frombuffer(rows.column("p")[k].as_py()), context_tree.read_off(want, context_tree.ROOT)[k])


def test_context_tree_questions_in_several_goes(monkeypatch):
    import pyarrow as pa

    texts = ["abracadabra", "banana bandana", "", None, "a" * 99]
    batch = pa.record_batch({"run": pa.array([1, 1, 1, 2, 2]), "text": pa.array(texts)})
    for monkey in (1 << 20, 3):
        monkeypatch.setattr(context_tree, "COUNTED", monkey)
        asked = defaultdict(set)
        for out in context_tree._question_batches(iter([batch])):
            for run, part, names in zip(*(c.to_pylist() for c in out.columns)):
                asked[run] |= set(context_tree.unsplit(part, np.frombuffer(names, np.uint32)).tolist())
        for run, mine in ((1, texts[:3]), (2, texts[3:])):
            assert asked[run] == set(context_tree.grams([(t or "").encode() for t in mine])[0].tolist())


# ---- quality ---------------------------------------------------------------

def test_quality_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.classify(docs, quality.fit(docs, labels)).join(labels, "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert held["n"] > 50 and held["a"] > 0.95


def test_quality_edges(spark, odd):
    rows, df = odd
    labels = spark.createDataFrame([(1, 1), (3, 1), (7, 0), (None, 1), (9, None), (99, 0), (2, 1)], "doc_id bigint, quality int")
    model = quality.fit(df, labels)
    out = quality.classify(df, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    kept = quality.accepted(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in out)
    assert quality.classify(documents(spark, []), quality.fit(documents(spark, []), labels.limit(0))).count() == 0


def test_sum_of_squares_is_all_pairs():
    rng = np.random.default_rng(0)
    width = quality.BUCKETS + len(quality.STATS)
    m = quality.FactorisationMachine(0.3, rng.normal(size=width), rng.normal(size=(width, quality.FACTORS)), np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    columns, values, starts = m.rows([quality.inputs("a small text, twice a small text", 3), quality.inputs("", None)])
    for r in range(2):
        c, v = columns[starts[r] : starts[r + 1]], values[starts[r] : starts[r + 1]]
        pairs = sum((m.factors[c[i]] @ m.factors[c[j]]) * v[i] * v[j] for i in range(len(c)) for j in range(i))
        assert m.margin(columns, values, starts)[0][r] == pytest.approx(0.3 + m.linear[c] @ v + pairs)


# ---- URLs ------------------------------------------------------------------

def test_url_edges(spark):
    urls = [
        None, "", "no scheme", "https://A.Example.NET/en/x?y=/z", "http://net/", "http://x.net", "http://notnet/", "https://spam-farm.example.org/fr/1",
        "https://www.cheap-pills.io", "ftp://example.com/de/", "http://example.com/de", "x://org/fr/://net/", "https://casino.io/casino-night#a", "http://a.net/?q",
    ]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls + urls[:4])], "page_id bigint, url string, host string, rule string")
    out = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(df, url_filter.rule_table(spark)).collect()}
    assert len(out) == len(urls) + 4 and out[0] == out[1] == out[2] == ("", "", None, "allow", None)
    assert out[3] == out[len(urls) + 3] == ("a.example.net", "/en/x", "example.net/en/", "allow", None)
    assert [out[i][2] for i in (4, 5, 6, 9, 10, 13)] == ["net/", None, None, "example.com/de/", None, "net/"]
    assert out[7][2:] == ("org/fr/", "allow", "spam-farm") and out[8][3] == "block" and out[12][3] == "block"
    assert out[11][0] == "org" and out[11][1] == "/fr/://net/"
    assert url_filter.filter_urls(df.limit(0), url_filter.rule_table(spark)).count() == 0


def test_url_verdicts_do_not_depend_on_other_rows(spark):
    """The index finds what all expressions find, run on all URLs; no row holds the singular 'download'."""
    urls = [
        "http://a.io/free-downloads/x", "http://a.io/x/free-downloads", "http://a.io/Free-Downloads/x", "http://a.io/CASINO/", "http://CASINO.io/",
        "http://a.io/free-downloader", "http://b.io/xxx.", "http://cheap-pills.io", "http://x.spam-farm.io/a", "http://b.io/free", "http://b.io/free/",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    for table in (df, df.union(spark.createDataFrame([(99, "http://c.io/free-download/")], df.schema))):
        for r in url_filter.filter_urls(table, url_filter.rule_table(spark)).collect():
            want = min((n for n, _, p in url_filter.PATTERN_RULES if re.search(p, r["host"] + r["path"])), default=None)
            assert (r["pattern_rule"], r["verdict"]) == (want, "block" if want else "allow"), r
            assert r["page_id"] not in (0, 1, 99) or want == "free-download"


# ---- token file ------------------------------------------------------------

@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(2)
    for ids in (np.empty(0, "<u4"), np.zeros(5, "<u4"), rng.integers(0, 1 << 32, 70_001, dtype=np.uint64).astype("<u4"), rng.integers(0, 50257, 1000).astype("<u4")):
        assert (token_file.unpack(*token_file.pack(ids, kind), kind) == ids).all()


def test_token_file_edges(spark, odd, monkeypatch):
    from tokenizers import Tokenizer

    from tidepanel.llm.common import shared_path

    tok = Tokenizer.from_file(bpe.vocabulary_path())
    monkeypatch.setattr(token_file, "SEGMENT_IDS", 1000)
    rows, df = odd
    path = shared_path(spark, "token-test")
    token_file.write_ids(df, path)
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(map(tuple, token_file.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    ids = token_file.read_ids(spark, path).where("doc_id = 12").first()["ids"]
    assert ids == tok.encode(rows[13][1], add_special_tokens=False).ids + [0]
    empty = shared_path(spark, "token-test")
    token_file.write_ids(documents(spark, []), empty)
    assert token_file.read_documents(spark, empty).count() == 0


# ---- chat ------------------------------------------------------------------

def test_chat_round_trip(spark):
    rows = [
        (1, 2, "assistant", "b <|turn|> <\\|x"), (1, 1, "user", None), (1, 3, "assistant", "c"), (1, 3, "assistant", "c"), (1, None, None, "first"), (2, 0, "a\nssistant", "x\ny"),
        (None, 0, "assistant", chat.PROBE), (3, 0, "assistant", ""), (4, 0, "user", "<|im_end|>\n<|im_start|>assistant\nno"), (5, 1, "<|lf|>", "<<||"),
    ] + [(6, i, "assistant" if i % 3 else "user", f"t{i}") for i in range(900)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, turns string")
    formatted = chat.format_chats(df)
    parsed = {r["conv_id"]: r for r in chat.parse_chats(formatted).collect()}
    groups = defaultdict(list)
    for c, n, r, t in rows:
        groups[c].append(((n is not None, n or 0), r or "", t or ""))
    for c, mine in groups.items():
        mine.sort()
        assert [(t["role"], t["text"]) for t in parsed[c]["turns"]] == [(r, t) for _, r, t in mine]
        assert parsed[c]["loss_text"] == "".join(t for _, r, t in mine if r == "assistant")
    assert chat.format_chats(df.limit(0)).count() == 0


# ---- vectors ---------------------------------------------------------------

def test_vectors_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for family in range(40):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 30)):
            rows.append((at, (centre + rng.normal(size=16) * rng.uniform(0, 0.35)).astype(np.float32).tolist()))
            at += 1
    rows += [(1000, rows[0][1]), (1001, None), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0, None] * 8), (1005, [float("inf")] + [1.0] * 15), (1006, []), (None, rows[0][1]),
             (1007, [1e-30] * 16), (1008, [1e30] * 16), (1009, [1.0] * 8), (1007, [1e-30] * 16)]
    df = spark.createDataFrame([(i, v, "l", 1) for i, v in rows], "vec_id bigint, embedding array<float>, label string, rep int")
    monkeypatch.setattr(vectors, "BLOCK", 8)
    out = vectors.near_vectors(df).collect()
    assert len(out) == len(rows)
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    true = Counter()
    for x, (i, a) in enumerate(good):
        for j, b in good[:x]:
            if len(a) == len(b):
                a1, b1 = a / np.abs(a).max(), b / np.abs(b).max()
                if a1 @ b1 / np.sqrt((a1 @ a1) * (b1 @ b1)) >= 0.95:
                    true[i] += 1
                    true[j] += 1
    got = Counter()
    for r in out:
        if r["vec_id"] != 1007:
            assert r["n_links"] <= true[r["vec_id"]]
            got[r["vec_id"]] = r["n_links"]
        assert r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"])
        if r["vec_id"] in (1001, 1002, 1003, 1004, 1005, 1006, None):
            assert r["n_links"] == 0 and r["component_id"] == r["vec_id"]
    assert sum(got.values()) >= 0.9 * (sum(true.values()) - true[1007])
    assert next(r for r in out if r["vec_id"] == 1000)["component_id"] == 0
    assert vectors.near_vectors(df.limit(0)).count() == 0


# ---- BPE -------------------------------------------------------------------

def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    tok, mine = Tokenizer.from_file(bpe.vocabulary_path()), bpe.SpeculativeBpe(bpe.vocabulary_path())
    rng = random.Random(9)
    parts = ["a", "the", " ", "  ", "\n", " \n", "\t", "é", "ß", "1", "'s", "!", "<|endoftext|>", "日", "\u00a0", "\x1c", "🙂", "ing", "tion", "x" * 40, ".\n", "\n\n", "don't", "\u0558"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD7FF), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [LONG]
    cut = [bpe.units(t) for t in texts]
    mine.prepare(cut)
    for t, c, want in zip(texts, cut, tok.encode_batch(texts, add_special_tokens=False)):
        ids = mine.encode(c).tolist()
        assert ids == want.ids and mine.decode(ids) == tok.decode(want.ids, skip_special_tokens=False)
    assert 0 < mine.merged < mine.proposed
    library = token_file.LibraryEncoder(bpe.vocabulary_path())
    ids, sizes = library.encode(texts)
    assert ids.tolist() == [i for c in cut for i in mine.encode(c).tolist()] and sizes.tolist() == [len(mine.encode(c)) for c in cut]
    assert library.encode(["", ""])[1].tolist() == [0, 0]


def test_bpe_query_edges(spark, odd):
    rows, df = odd
    out = sorted((tuple(r) for r in bpe.encode_digests(df).collect()), key=str)
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(out) == len(rows) and [r for r in out if r[0] == 4] == [(4, 0, nothing, nothing)]
    texts = Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert Counter(r[3] for r in out) == texts
    back = bpe.decode(bpe.encode(df)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i, t or "") for i, t in rows)


# ---- fingerprints ----------------------------------------------------------

def test_fingerprints_are_local():
    rng = random.Random(6)
    words_ = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = " ".join(rng.choice(words_) for _ in range(300))
    other = " ".join(rng.choice("ijklmnop") * 3 + rng.choice(words_)[::-1] for _ in range(300))
    a, shifted, b, empty = fingerprint.rendered(fingerprint.sketches([text, "zz " + text, other, ""]))
    assert fingerprint.likeness(a, shifted) > 0.9 and fingerprint.likeness(a, b) < 0.2
    assert fingerprint.likeness(empty, empty) == 1.0 and fingerprint.likeness(a, empty) == 0.0
    assert fingerprint.rendered(fingerprint.sketches([other, text, "aaaaaaa", text]))[1] == a == fingerprint.rendered(fingerprint.sketches([text]))[0]
    assert fingerprint.sketches(["a", "ab", "aaaa", "\U0001f642"]).shape == (4, sum(fingerprint.SLOTS))


def test_fingerprint_query(spark, odd):
    rows, df = odd
    df.createOrReplaceTempView("odd")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in order]
    follow = texts[1:] + texts[:1]
    found = Counter((r["doc_id"], r["text"], r["next_text"]) for r in fingerprint.with_next(df).collect())
    assert found == Counter((i, t, n) for (i, _), t, n in zip(order, texts, follow))
    assert fingerprint.with_next(documents(spark, [])).count() == 0
    assert [tuple(r) for r in fingerprint.with_next(documents(spark, [(5, "x")])).collect()] == [(5, "x", "x")]


def test_fingerprint_query_on_documents(spark):
    rows = text_rows(spark)
    texts = [r["text"] for r in rows]
    follow = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, follow)]
    out = {r["doc_id"]: r for r in fingerprint.op10_fingerprints(spark, ROOT).collect()}
    marks, near = fingerprint.rendered(fingerprint.sketches(texts)), fingerprint.rendered(fingerprint.sketches(edited))
    for k, row in enumerate(rows):
        r = out[row["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(texts[k]), hashlib.sha256(edited[k].encode()).hexdigest(), marks[k], near[k])
        assert r["near_edited"] == pytest.approx(fingerprint.likeness(marks[k], near[k]))
        assert r["near_next"] == pytest.approx(fingerprint.likeness(marks[k], marks[(k + 1) % len(rows)]))
