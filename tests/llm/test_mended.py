"""Rules, ties, names and bounds that once went wrong."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidepanel.llm import bpe, chat, mixing, ngram_join, quality, token_file, url_filter

ROOT = "/root/testdata/sf0.001"


# ---- URL rules ---------------------------------------------------------------

def judged(spark, urls, sites, patterns):
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r["page_id"]: r for r in url_filter.filter_urls(table, url_filter.rule_table(spark, sites, patterns)).collect()}


def plain_verdict(url, sites, patterns):
    host, path = re.search("://([^/?#]*)([^?#]*)", url, re.S).groups() if "://" in url else ("", "")
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(len(r), r, v) for r, v in sites for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    hit = min((n for n, _, p in patterns if re.search(p, host + path)), default=None)
    best = max(fits, default=(0, None, "block" if hit else "allow"))
    return best[1], best[2], hit


def test_rules_without_tokens_are_kept(spark):
    sites = [("日本/", "block"), ("例.みんな/頁/", "block"), ("-.-/", "block"), ("net/", "allow")]
    patterns = [("six", None, "[0-9]{6}"), ("bare", (), "%7e"), ("mixed", None, "/(foo/)?bar/")]
    urls = ["https://日本/x", "http://www.例.みんな/頁/1", "http://a.-.-/", "http://a.net/123456", "http://b.org/123456", "http://c.org/12345", "http://d.org/%7ex",
            "http://e.org/foo/bar/", "http://e.org/Bar/", "http://e.org/bar/", "http://e.org/xbar/", "no url", ""]
    found = judged(spark, urls, sites, patterns)
    for i, url in enumerate(urls):
        assert (found[i]["rule"], found[i]["verdict"], found[i]["pattern_rule"]) == plain_verdict(url, sites, patterns), url


def test_thousands_of_rules(spark):
    rng = random.Random(8)
    names = ["".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    site = lambda: f"{'.'.join(rng.sample(names, rng.randint(1, 2)))}/{rng.choice(['', '', rng.choice(names) + '/', rng.choice(names)])}"
    sites = sorted({site(): rng.choice(["block", "allow"]) for _ in range(4000)}.items())
    shapes = ["/{}-{}/", "^{}\\.", "(^|[./-]){}([./-]|$)", "{}[0-9]+", "/({}|{})/x"]
    patterns = [(f"p{i:04d}", None, rng.choice(shapes).format(rng.choice(names), rng.choice(names))) for i in range(1000)]
    urls = [f"http://{'.'.join(rng.sample(names, rng.randint(1, 3)))}/{'/'.join(rng.choice(names) + rng.choice(['', '', '-' + rng.choice(names), '7']) for _ in range(rng.randint(0, 3)))}" for _ in range(300)]
    found = judged(spark, urls, sites, patterns)
    hits = 0
    for i, url in enumerate(urls):
        want = plain_verdict(url, sites, patterns)
        # Rules of one length are ordered by their text; code units and code points agree here.
        assert (found[i]["rule"], found[i]["verdict"], found[i]["pattern_rule"]) == want, url
        hits += want[0] is not None or want[2] is not None
    assert hits > 100


@pytest.mark.parametrize("pattern", [p for _, _, p in url_filter.PATTERN_RULES] + ["/x-(foo|bar)/", "/(foo/)?bar/", "^foo\\.", "/foo$", "/ab(cd)?/", "(foo)?bar/", "a|b", "/foo+/"])
def test_every_match_holds_the_tokens(pattern):
    rng, tokens = random.Random(pattern), url_filter.literal_tokens(pattern)
    parts = ["foo", "bar", "ab", "cd", "x", "-", "/", ".", "spam", "farm", "cheap", "pills", "casino", "free", "download", "s", "xxx", "/bar/", "/x-foo/", "/free-download", "spam-farm.", "cheap-pills.", "foo."]
    seen = 0
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))
        if re.search(pattern, text):
            seen += 1
            assert set(tokens) <= set(re.findall(url_filter.TOKEN, text)), text
    assert seen


# ---- ties and names ----------------------------------------------------------

def test_chat_ties_are_ordered_by_the_texts_as_they_are(spark):
    texts = ["<|a", "<\\|a", "<b", "<", "<|", "<\\\\|", "<}"]
    rows = [(1, 0, "user", t) for t in texts]
    out = chat.parse_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [t["text"] for t in out["turns"]] == sorted(texts)


def test_mix_of_rows_with_one_id_does_not_depend_on_their_order(spark):
    rows = [(None, f"w{i} " * 50, "a") for i in range(6)] + [(4, f"v{i} " * 50, "b") for i in range(6)]
    schema = "doc_id long, text string, source string"
    mixes = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        mixes.add(tuple(sorted(r["text"] for r in mixing.mixed_documents(spark.createDataFrame(rows, schema).repartition(1 + seed)).collect())))
    assert len(mixes) == 1


def test_one_of_each_with_columns_of_working_names(spark):
    base = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, base, 5, 6), (2, base, 7, 8), (3, "x", 9, 10), (3, "y", 9, 10)], "doc_id long, text string, gone_id long, often_id long")
    kept = ngram_join.one_of_each(docs)
    assert kept.dtypes == docs.dtypes and sorted((r["doc_id"], r["gone_id"]) for r in kept.collect()) == [(1, 5), (3, 9)]


def test_one_row_of_an_id_is_learned_from(spark):
    rows = [(i, f"good words number {i} here", None) if i % 2 else (i, "buy now !!! " * 5, None) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    again = docs.union(spark.range(100_000).select(F.lit(4).alias("doc_id"), F.lit(rows[4][1]).alias("text"), F.lit(None).cast("long").alias("n_chars")))
    once, many = quality.fit(docs, labels), quality.fit(again, labels)
    assert (once.linear == many.linear).all() and once.bias == many.bias


# ---- digests of the two tokenizing queries ------------------------------------

def test_tokenizing_queries_give_the_digests_of_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    rng = random.Random(2)
    odd = ["".join(rng.choice(" \n\tabcXYZ'é日0123<|>._-　 ") for _ in range(rng.randint(0, 80))) + rng.choice(["", "<|endoftext|>"]) for _ in range(300)]
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(10**6 + i, t) for i, t in enumerate(odd)] + [(2 * 10**6, "z" * 5000 + "ab" * 3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want_ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    for r in bpe.encode_digests(table).collect():
        ids = want_ids[r["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    path = token_file.shared_path(spark, "digests")
    token_file.write_ids(table, path)
    start = 0
    for r in sorted(token_file.read_documents(spark, path).collect(), key=lambda r: r["doc_id"]):
        ids = [*want_ids[r["doc_id"]], token_file.END_ID]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        start += len(ids)


def test_small_caches_change_nothing(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdeé.,") for _ in range(rng.randint(1, 9))) for _ in range(200)) for _ in range(30)]
    whole = bpe.SpeculativeBpe(bpe.vocabulary_path())
    whole.prepare([bpe.units(t) for t in texts])
    want = [whole.encode(bpe.units(t)).tolist() for t in texts]
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 50)
    monkeypatch.setattr(token_file, "LIBRARY_UNITS", 100)
    small, library = bpe.SpeculativeBpe(bpe.vocabulary_path()), token_file.LibraryEncoder(bpe.vocabulary_path())
    for _ in range(2):
        for t, ids in zip(texts, want):
            cut = bpe.units(t)
            small.prepare([cut])
            assert small.encode(cut).tolist() == ids
            assert library.encode([t])[0].tolist() == ids
    assert len(small.units) < 1000 and len(library.known) < 1000
    assert Counter(map(len, want))
