"""Chunk dedup, prefix trie and ranked search against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import chunk_dedup, lexical, prefix_trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


# ---- exact dedup -------------------------------------------------------------

def plain_dedup(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[(text or "").translate(LOWER)].append((doc is not None, doc or 0, -i, doc))
    out = []
    for doc, text in rows:
        same = (text or "").translate(LOWER)
        out.append((doc, max(groups[same])[3], len(groups[same]), hashlib.sha256(same.encode()).hexdigest()))
    return Counter(out), len(groups)


def dedup_rows(rng):
    long = words(rng, 40_000)
    texts = [None, "", "A b", "a B", "É a", "é A", "İx", "ix", "i̇x", "ǅ", "ǆ", "𐕰", long, long.upper(), long + " ", "x" * 9000, "x" * 9001, "日本語" * 3000]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    return rows + [(7, "twice"), (7, "twice"), (None, "twice"), (None, "alone"), (None, "alone"), (3, " ")]


def test_dedup_against_plain(spark):
    rows = dedup_rows(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = chunk_dedup.decisions(docs).collect()
    want, n_groups = plain_dedup(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
    kept = [r for r in found if r["kept"]]
    assert len(kept) == n_groups == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_dedup_with_names_that_clash(spark):
    """Names of few bits: a seed with clashes is left for the next one, and the result stays the same."""
    bits = 2
    for start in range(20):
        rows = [(i, words(random.Random(start * 10 + i % 4), 4)) for i in range(9)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        free = [chunk_dedup.clashes(docs, seed, bits).isEmpty() for seed in range(3)]
        if not free[0] and any(free):
            break
    assert chunk_dedup.verified_seed(docs, bits) > 0
    found = chunk_dedup.decisions(docs, bits).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == plain_dedup(rows)[0]
    with pytest.raises(RuntimeError):
        chunk_dedup.decisions(spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string"), 1)


def test_chunks_follow_content(spark):
    rng = random.Random(3)
    text = words(rng, 8000) + "日本語テキスト" * 300
    df = spark.createDataFrame([(text,), ("Some words in front. " + text,)], "text string")
    a, b = (r[0] for r in df.select(chunk_dedup.chunks(chunk_dedup.normalised(F.col("text")))).collect())
    assert "".join(a).encode("latin-1").decode() == text
    assert max(map(len, a)) <= chunk_dedup.LONGEST and len(set(a) & set(b)) > 0.9 * len(a)


def test_dedup_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", 5), (2, "A", "y", 6), (3, "b", "z", 7)], "doc_id long, text string, recipe string, uid long")
    assert chunk_dedup.decisions(docs.limit(0)).count() == 0
    clash = docs.withColumns({n: F.lit(0) for n in ("mark", "keep", "row", "sha256", "id", "kept_id", "kept_sha256", "group_size", "kept")})
    kept = chunk_dedup.one_of_each(clash)
    assert kept.dtypes == clash.dtypes and {r["doc_id"] for r in kept.collect()} == {2, 3}
    twice = chunk_dedup.one_of_each(docs.union(docs))
    assert sorted(r["doc_id"] for r in twice.collect()) == [2, 3]


# ---- prefix trie -------------------------------------------------------------

def plain_turns(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        by[conv].append((turn is not None, turn or 0, digest, role, text))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}


def plain_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        base = [] if c is None else convs.get(c - int(math.fmod(c, 20)), [])
        out[c] = base[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    saved, leaves, kids = defaultdict(int), defaultdict(int), Counter(p[:-1] for p in members if p)
    for path, cs in members.items():
        own = (len(cs) - 1) * len(re.findall("[^\x20\x09-\x0d]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own
            leaves[path[:d]] += path not in kids
    name = {p: min((c for c in cs if c is not None), default=None) for p, cs in members.items()}
    out = Counter()
    for path, cs in members.items():
        ends = sorted(c for c in cs if c is not None and len(convs[c]) == len(path))
        out[(name[path], len(path), name[path[:-1]] if path else None, len(cs), kids[path], leaves[path], saved[path], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())] += 1
    return out


def as_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return Counter(tuple(r) for r in df.collect())


def trie_rows(rng):
    rows = []
    for c in [*range(-45, 90), 10**12, None]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8, 9, 16, 17, 40])):
            # few different turns, so that long prefixes are shared
            text = rng.choice(["a b", "a b", "a b", "c", None]) if rng.random() < 0.3 else f"turn {t} of all"
            rows.append((c, None if rng.random() < 0.02 else t, rng.choice(["user", "user", None]) if rng.random() < 0.2 else "user", text))
    rows += [(7, 0, "user", "same"), (7, 0, "user", "same"), (8, None, "x", "tie"), (8, None, "tie", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("span", [prefix_trie.SPAN, 2])
def test_trie_against_plain(spark, span, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN", span)  # 2: running sums pass through many ranges
    rows = trie_rows(random.Random(11))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit("?") for n in ("digest", "pos", "depth", "k1", "b")})
    convs = plain_turns(rows)
    assert as_rows(prefix_trie.prefix_trie(turns)) == plain_trie(convs)
    numbered = prefix_trie.numbered_turns(turns)
    assert as_rows(prefix_trie.trie(prefix_trie.rebuilt(numbered))) == plain_trie(plain_rebuilt(convs))


def test_trie_of_turnless_conversations_and_of_nothing(spark):
    """Conversations whose only turns are replaced by the beginning of one that is not there."""
    rows = [(c, 0, "user", "hi") for c in range(101, 120) if zlib.crc32(str(c).encode()) % 4]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.numbered_turns(turns)))
    assert as_rows(found) == plain_trie({r[0]: [] for r in rows})
    assert prefix_trie.prefix_trie(turns.limit(0)).count() == 0


# ---- ranked search -----------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, best=20):
    counts = [Counter(terms_of(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        asked = Counter(terms_of(text))
        for (doc, _), c, n in zip(docs, counts, sizes):
            score = 0
            for t, times in asked.items():
                if c[t]:
                    m = 75 + (25 * n * n_docs) // n_terms
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scores)[:best], 1):
            out[(item, rank, doc, -score)] += 1
    return out


def search_rows(rng, n):
    common, rare = words(rng, 6).split(), words(rng, 300).split()
    docs = []
    for i in range(n):
        text = " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.randint(1, 60)))
        docs.append((i, text.title() if i % 5 == 0 else text))
    docs += [(n + i, docs[3][1]) for i in range(40)] + [(None, docs[3][1]), (5, docs[3][1]), (n + 90, None), (n + 91, " ,.!"), (n + 92, "ÉTÉ été x-y_z")]
    items = [(i, " ".join(rng.choice(rare + common) for _ in range(rng.randint(1, 30)))) for i in range(25)]
    items += [(100, docs[3][1]), (100, common[0]), (None, rare[0]), (101, None), (102, "?"), (103, "nowhere"), (104, "x y z Été"), (105, f"{rare[1]} {rare[1]}")]
    return docs, items


@pytest.mark.parametrize("n", [30, 600])
def test_search_against_plain(spark, n):
    docs, items = search_rows(random.Random(n), n)
    found = lexical.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({c: F.lit(1) for c in ("id", "uid", "n", "score", "rank")}),
        spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("?")),
    )
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()) == plain_search(docs, items)


def test_search_in_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("doc_id = 2"), items).count() == 0


def test_long_texts_are_counted_piece_by_piece(monkeypatch):
    rng = random.Random(1)
    texts = [words(rng, 500), None, "y" * 700 + " " + words(rng, 3), "é" * 300]
    whole = lexical.count_terms(pa.array(texts, pa.string()), None)
    monkeypatch.setattr(lexical, "PIECE", 50)
    pieces = lexical.count_terms(pa.array(texts, pa.string()), None)
    assert whole[0].tolist() == pieces[0].tolist() == [len(terms_of(t)) for t in texts]
    assert all((a == b).all() for a, b in zip(whole[1], pieces[1]))
