"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, one operator after the other."""

import collections
import math
import os
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, html_extract, mixing, ngram_join, packing, pivot_search, quality_crf, quality_rules, suffix_tree_lm, url_filter, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, part string, kept string, score string, component_id string"


def prose(n, seed=1):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every oddity: null id, null and empty texts, white space, one word, a very long text, copies, repeats."""
    long_text = prose(200_000, 5)
    texts = [(1, prose(300, 2)), (2, prose(300, 2)), (2, prose(300, 2)), (3, None), (4, ""), (5, " \t\n "), (6, "word"), (6, "word"), (None, prose(60, 3)), (7, long_text), (8, long_text + " more"), (9, "x" * 300_000)]
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "b", None, k, "p", "k", "s", "c") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_do_not_depend_on_segments(monkeypatch):
    texts = pa.array([prose(500, k) for k in range(20)] + ["", None, " a\tb ", "z" * 500])
    whole = words.split_words(texts, fold=True, classes=(b"ae",))
    monkeypatch.setattr(words, "SEGMENT", 64)
    cut = words.split_words(texts, fold=True, classes=(b"ae",))
    assert (whole.hashes == cut.hashes).all() and (whole.counts == cut.counts).all() and (whole.marks == cut.marks).all() and (whole.chars == cut.chars).all()


def test_words_fold_ascii_only():
    a, b = (words.split_words(pa.array([x]), fold=True).hashes[0] for x in ("ABC", "abc"))
    c, d = (words.split_words(pa.array([x]), fold=True).hashes[0] for x in ("Ä", "ä"))
    assert a == b and c != d


# ---- chat format ----


def test_chat_layouts_and_escapes(spark):
    nasty = "<|im_end|>\n<|im_start|>user\n<\\|x <\\\\| <| %0A \\ <"
    message = "array<struct<role:string,content:string>>"
    shared = "array<struct<from:string,value:string>>"
    schema = f"key long, record struct<messages:{message},conversations:{shared},prompt:string,completion:string,instruction:string,input:string,output:string>, turns string, layout string"
    rows = [
        (1, ([("user", nasty), ("assistant", nasty)], None, None, None, None, None, None), "t", "l"),
        (2, (None, [("human", nasty), ("gpt", "")], None, None, None, None, None), "t", "l"),
        (3, (None, None, "p", nasty, None, None, None), "t", "l"),
        (4, (None, None, None, None, "do", "this", "done"), "t", "l"),
        (5, (None, None, None, None, "do", None, "done"), "t", "l"),
        (6, (None, None, None, "only", None, None, None), "t", "l"),
        (7, ([("assistant\nx%", nasty), ("user", "")], None, None, None, None, None, None), "t", "l"),
        (7, None, "t", "l"),
    ]
    df = chat_format.canonical(spark.createDataFrame(rows, schema))
    out = chat_format.digest(chat_format.render(df)).withColumn("back", F.transform(chat_format.stretches(F.col("formatted")), chat_format.parse)).orderBy("key").collect()
    assert [r.layout for r in out[:6]] == ["messages", "conversations", "prompt", "instruction-input", "instruction", None]
    for r in out:
        assert [tuple(t) for t in r.back] == [tuple(t) for t in r.turns or []] and r.n_turns == len(r.turns or [])
        assert r.loss_chars == sum(len(t.text) for t in r.turns or [] if t.role == "assistant")
    assert chat_format.digest(chat_format.render(chat_format.canonical(spark.createDataFrame([], schema)))).count() == 0


def test_chat_rows_by_turn(spark):
    rows = [(1, 2, "assistant", None, 0), (1, 1, "user", "hi", 0), (1, 1, "user", "hi", 0), (1, None, None, "first", 0), (None, 1, "user", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    out = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.canonical(chat_format.records_of_turns(df)).collect()}
    assert out == {1: [("", "first"), ("user", "hi"), ("user", "hi"), ("assistant", "")], None: [("user", "x")]}


# ---- URL filter ----


ENTRIES = "host string, path string, verdict string"


def test_url_filter(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("", "/q", "block"), (None, "/", "block")], ENTRIES)
    listed = spark.createDataFrame([("s.bad.org", "/xyz", "block"), ("bad.org", None, "block"), ("bad.org", "", "block"), ("a.net", "/q", "allow")], ENTRIES)
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET/q?x", "http://b.example.net/en/1#t", "http://xexample.net/en/", "http://net", "http://net/", "https://s.bad.org/xyz", "https://bad.org/", "http://u:1@h.net/a://b", "http://net/", "ftp://" + "a." * 500 + "net/" + "p" * 5000, "https://bad.org?q", "http://t.s.bad.org/xyz"]
    df = spark.createDataFrame([(k, u, "r", "v") for k, u in enumerate(urls)], "page_id long, url string, rule string, by_rule string")
    out = sorted(url_filter.judge(df, rules, listed).collect())
    assert [r.rule for r in out] == [None, None, None, None, "net/", "example.net/en/", "net/", None, "net/", None, None, "net/", "net/", "net/", None, None]
    assert [r.verdict for r in out] == ["allow"] * 4 + ["block", "allow", "block", "allow", "block", "block", "allow", "block", "block", "block", "block", "allow"]
    assert [k for k, r in enumerate(out) if r.listed] == [4, 9, 14] and (out[4].host, out[4].path) == ("a.net", "/q") and (out[0].host, out[0].path) == ("", "")
    assert url_filter.judge(df.limit(0), rules, listed).count() == 0
    assert {r.verdict for r in url_filter.judge(df, rules.limit(0), listed.limit(0)).collect()} == {"allow"}
    assert {r.rule for r in url_filter.judge(df, rules.limit(0), listed).collect()} == {None}


def test_url_filter_with_a_long_list_of_many_lengths(spark):
    rng = random.Random(4)
    hosts = [f"h{k}.example.org" for k in range(40)]
    word = lambda n: "".join(rng.choices("abc", k=n))
    rules = {(rng.choice(hosts), "/" + word(rng.randint(0, 300)) * (rng.random() < 0.9), rng.choice(["allow", "block"])) for _ in range(20_000)}
    long = [r for r in rules if r[1]]
    urls = [f"http://www.{rng.choice(long)[0]}{rng.choice(long)[1]}x" for _ in range(2500)] + [f"http://{h}{path}tail?q" for h, path, _ in rng.sample(long, 2500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    empty = spark.createDataFrame([], ENTRIES)
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, spark.createDataFrame(sorted(rules), ENTRIES), empty).collect()}
    for k in rng.sample(range(5000), 150):
        rest = urls[k].partition("://")[2].partition("?")[0]
        host, slash, tail = rest.partition("/")
        fits = [(len(h + path), v == "allow", h + path, v) for h, path, v in rules if (host == h or host.endswith("." + h)) and (slash + tail).startswith(path)]
        best = max(fits, default=None, key=lambda x: x[:2])
        assert out[k] == ((best[2], best[3]) if best else (None, "allow"))


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("host"), "id", F.lit("/")).alias("key"))
    bits = url_filter.bloom(listed, 128)
    assert listed.filter(url_filter.may_contain(bits, F.col("key"), 128)).count() == 3000
    other = spark.range(3000).select(F.concat(F.lit("other"), "id", F.lit("/")).alias("key"))
    assert other.filter(url_filter.may_contain(url_filter.bloom(listed, 128), F.col("key"), 128)).count() < 300


# ---- packing ----


def test_packing_plan_is_best_fit_decreasing():
    import bisect

    rng = np.random.default_rng(3)
    for capacity in (1, 7, 64, 2048):
        for _ in range(20):
            lengths = rng.integers(1, capacity + 1, rng.integers(1, 300))
            counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
            placement = packing.Placement(packing.plan(counts, capacity))
            filled = {}
            for length, n in counts.items():
                for rank in range(n):
                    sequence, offset = placement.of(length, rank)
                    filled.setdefault(sequence, []).append((offset, length))
            for spans in filled.values():
                spans.sort()
                assert [s[0] for s in spans] == list(np.cumsum([0, *[s[1] for s in spans[:-1]]])) and sum(s[1] for s in spans) <= capacity
            remainders, opened = [], 0
            for length in sorted(lengths.tolist(), reverse=True):
                k = bisect.bisect_left(remainders, length)
                left = remainders.pop(k) if k < len(remainders) else capacity
                opened += left == capacity and k >= len(remainders)
                bisect.insort(remainders, left - length)
            assert len(filled) <= opened + 1


def test_token_ids_equal_the_json_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.token_ids()
    for text in ("", " ", "a  b\n\n c\t", "<|endoftext|> x", "ein Ümläut", "\u3000\u00a0x", "don't I'LL", "😀👩‍👩‍👧", "x" * 5000, "1234567 89", "\r\n \x00\x1f", "a\u0301", "Ⅷ½²"):
        assert fast.encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_packing_odd_rows(odd, none):
    out = packing.pack(odd.withColumnRenamed("size", "length")).collect()
    assert sum(r.piece == 0 for r in out) == 12 and all(r.length <= 2048 for r in out)
    assert [r.length for r in out if r.doc_id in (3, 4)] == [1, 1]
    assert packing.pack(none).count() == 0


def test_packing_spreads_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    docs = spark.createDataFrame([(None, "same text")] * 900 + [(1, prose(9000, 4))], "doc_id long, text string")
    parts = packing.pieces(docs).select(F.pmod(F.xxhash64("part", "piece"), F.lit(18)).alias("g"), "length").groupBy("length", "g").count()
    assert parts.agg(F.max("count")).first()[0] < 100
    out = packing.pack(docs).collect()
    spans = {}
    for r in out:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([a for a, _ in sorted(s)] == list(np.cumsum([0, *[n for _, n in sorted(s)][:-1]])) and sum(n for _, n in s) <= 2048 for s in spans.values())


# ---- pivot search ----


def test_pivot_search(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(size=8)], 0) for k in range(300)]
    rows += [(k, [0.5] * 8, 0) for k in range(300, 400)] + [(400, None, 0), (401, [None] + [1.0] * 7, 0), (402, [float("nan")] * 8, 0), (403, [float("inf")] * 8, 0), (None, [9.0] * 8, 0), (404, [], 0), (405, [7.0], 0), (7, [0.1] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    held = [(i, np.pad(np.floor(1024 * np.array(v, float)), (0, 8 - len(v))).astype(int)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    want = set()
    for i, q in held:
        if i % 50 == 0:
            best = sorted((-int(q @ x), j) for j, x in held if j != i)[:10]
            want |= {(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)}
    got = pivot_search.search(df, F.col("id") % 50 == 0).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert pivot_search.search(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert pivot_search.search(df.filter("vec_id = 0"), F.col("id") % 50 == 0).count() == 0
    few = pivot_search.search(df.filter("vec_id in (0, 1, 2)"), F.col("id") % 50 == 0).collect()
    assert len(few) == 2


@pytest.mark.parametrize("size", [3e6, 1e12, 1e120])
def test_pivot_search_of_large_components(spark, size):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=4) * size * 10.0 ** -(k % 4)]) for k in range(120)] + [(200, [size, 1.0, 0.0, 0.0]), (201, [1.0, 0.0, 0.0, 0.0]), (202, [1e306] * 4)]
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i != 202}
    long = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = {(i, rank, j, -s) for i in whole if i % 50 == 0 for rank, (s, j) in enumerate(sorted((-long(sum(a * b for a, b in zip(whole[i], x, strict=True))), j) for j, x in whole.items() if j != i)[:10], 1)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in pivot_search.search(df, F.col("id") % 50 == 0).collect()} == want
    if size == 3e6:
        assert 3145728000000 in {r.score for r in pivot_search.search(df, F.col("id") == 200, k=130).collect() if r.vec_id == 201}


def test_pivot_search_in_several_groups(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=6) + 5 * (k % 3)]) for k in range(400)], "vec_id long, embedding array<double>")
    want = sorted(pivot_search.search(df, F.col("id") % 2 == 0).collect())
    for name, value in (("QUERIES_PER_GROUP", 30), ("QUERY_ROWS", 10), ("BLOCK_ROWS", 40)):
        monkeypatch.setattr(pivot_search, name, value)
    assert sorted(pivot_search.search(df, F.col("id") % 2 == 0).collect()) == want


# ---- language model ----


def test_language_model_odd_rows(odd, none):
    out = suffix_tree_lm.score(odd).collect()
    assert len(out) == 12 and sorted(r.n_tokens for r in out if r.doc_id in (3, 4, 5)) == [1, 1, 1]
    assert all(np.isfinite(r.score) and r.score <= 0 for r in out)
    assert suffix_tree_lm.score(none).count() == 0


class PlainTree:
    """The model from its definition, with dictionaries."""

    def __init__(self, texts):
        lm = suffix_tree_lm
        self.n, self.counts = sum(map(len, texts)), collections.Counter(w for t in texts for w in t)
        self.levels = []
        totals = {(w,): c for w, c in self.counts.items() if c >= lm.LEAST and w is not None}
        allowed = {(): {w for w, c in self.counts.items() if c >= lm.LEAST}}
        for depth in range(1, lm.MAX_DEPTH + 1):
            after = collections.defaultdict(collections.Counter)
            for t in texts:
                for k in range(depth, len(t)):
                    context = tuple(t[k - depth : k])
                    if context in totals and t[k] in allowed.get(context[1:], ()):
                        after[context][t[k]] += 1
            listed = {c: {w: m for w, m in seen.items() if m >= lm.LEAST} for c, seen in after.items()}
            kept = {}
            for context, found in listed.items():
                total, held = totals[context], sum(found.values())
                rest = max(1 - (held - lm.DISCOUNT * len(found)) / total, 1e-12)
                below = {w: 2.0 ** (-round(-lm.STEPS * math.log2(self.probability(context[1:], w, depth - 1))) / lm.STEPS) for w in found}
                gain = sum(m * math.log((m - lm.DISCOUNT) / total / below[w]) for w, m in found.items())
                if found and gain + (total - held) * math.log(rest) >= lm.COST * len(found):
                    kept[context] = (found, total, rest)
            self.levels.append(kept)
            allowed = {c: set(found) for c, found in listed.items()}
            totals = {(*c, w): m for c, found in listed.items() for w, m in found.items() if w is not None}

    def probability(self, before, word, depth=None):
        lm = suffix_tree_lm
        c = self.counts.get(word, 0)
        p = (c - lm.DISCOUNT) / self.n if c else lm.DISCOUNT * len(self.counts) / self.n
        for d, kept in enumerate(self.levels[: len(self.levels) if depth is None else depth], 1):
            context = tuple(before[-d:])
            if len(before) >= d and context in kept:
                found, total, rest = kept[context]
                p = max(found.get(word, 0) - lm.DISCOUNT, 0) / total + rest * p
        return p

    def score(self, text):
        return sum(math.log10(self.probability(text[max(0, k - suffix_tree_lm.MAX_DEPTH) : k], w)) for k, w in enumerate(text))


@pytest.mark.parametrize("group", [1 << 19, 40])
def test_language_model_against_its_definition(spark, group, monkeypatch):
    """Scores equal those of the plain tree, also where contexts are split over groups and texts over slices; its distributions sum to one."""
    monkeypatch.setattr(suffix_tree_lm, "GROUP_PAIRS", group)
    monkeypatch.setattr(suffix_tree_lm, "SLICE_BYTES", 4000)
    rng = random.Random(8)
    words_ = [prose(1, k)[:-1] for k in range(60)]
    phrase = lambda: " ".join(rng.choices(words_, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(1, 25)))
    some = [phrase() for _ in range(40)]
    rows = [(k, " ".join(rng.choice(some) if rng.random() < 0.6 else phrase() for _ in range(3)) + (f" new{k}" if k % 9 == 0 else "")) for k in range(250)] + [(k, None) for k in range(250, 255)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = {k: [*(t or "").lower().split(), None] for k, t in rows}
    tree = PlainTree([t for k, t in texts.items() if zlib.crc32(str(k).encode()) % 10])
    assert all(tree.levels)
    got = {r.doc_id: r.score for r in suffix_tree_lm.score(docs).collect()}
    assert got == pytest.approx({k: tree.score(t) for k, t in texts.items()}, rel=1e-9)
    for context in [(), *(c for kept in tree.levels for c in list(kept)[:30])]:
        assert sum(tree.probability(context, w) for w in [*tree.counts, "stranger"]) == pytest.approx(1, abs=1e-9)


def test_language_model_lists_what_occurs_twice_at_any_size(spark):
    phrase = "alpha beta gamma"
    ids = [k for k in range(1, 200) if zlib.crc32(str(k).encode()) % 10]
    out_id = next(k for k in range(200, 400) if not zlib.crc32(str(k).encode()) % 10)
    scores = []
    for filler in (1_000, 1_500_000):
        rows = [(ids[0], "x " * filler), (ids[1], phrase), (ids[2], phrase), (out_id, phrase)]
        out = {r.doc_id: r for r in suffix_tree_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        n = filler + 9
        root = math.log10((2 - suffix_tree_lm.DISCOUNT) / n)
        after = 3 * math.log10(0.75)  # beta, gamma and the end: 1.5 of 2, the rest's share of the root left out
        assert out[out_id].held_out and out[out_id].train_tokens == n and out[out_id].score == pytest.approx(root + after, abs=0.01)
        scores.append(out[out_id].score - root)
    assert scores[0] == pytest.approx(scores[1], abs=0.01)


def test_language_model_leaves_only_what_its_result_reads(spark, monkeypatch):
    """Exchanges, word lists and answers by group go as soon as they have been read, and groups are as many as the tokens ask for."""
    monkeypatch.setattr(suffix_tree_lm, "GROUP_PAIRS", 100)
    seen, meet = {}, suffix_tree_lm.level_counts
    monkeypatch.setattr(suffix_tree_lm, "level_counts", lambda *a: seen.update(groups=a[4]) or meet(*a))
    written, table = [], suffix_tree_lm.table_path
    monkeypatch.setattr(suffix_tree_lm, "table_path", lambda *a: written.append(table(*a)) or written[-1])
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {str(f) for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = shuffles()
    docs = spark.createDataFrame([(k, "one two three four " * 5) for k in range(43)], "doc_id long, text string")
    out = suffix_tree_lm.score(docs)
    assert seen["groups"] == -(-43 * 21 // 100) == 10
    kept = [p.removeprefix("file:") for p in written]
    assert sorted(os.path.basename(p).split("-")[0] + ("-groups" if "-groups-" in p else "") for p in kept if os.path.exists(p)) == ["slices"]
    assert [d for d in os.listdir(next(p for p in kept if "slices" in p)) if d.startswith("kind=")] == ["kind=tokens"]
    for _ in range(50):  # files go in the background
        if not (left := shuffles() - before):
            break
        time.sleep(0.2)
    assert not left
    assert out.count() == 43


def test_word_counts_come_back_in_less_than_their_counts_take():
    rng = np.random.default_rng(3)
    counts = (1 / rng.random(5000)).astype(np.int64)
    number = np.empty(5000, np.uint32)
    number[np.argsort(-counts, kind="stable")] = np.arange(5000, dtype=np.uint32)
    for at in (np.arange(5000), np.flatnonzero(counts < 2), np.zeros(0, np.int64), np.flatnonzero(counts >= 2)[:1]):
        numbers = number[at[counts[at] >= 2]]
        packed = suffix_tree_lm.pack_counts(counts[at], numbers)
        got = suffix_tree_lm.unpack_counts(packed)
        assert got[0].tolist() == counts[at].tolist() and got[1].tolist() == numbers.tolist()
    plain = suffix_tree_lm.pack(counts, number[counts >= 2])
    assert len(suffix_tree_lm.pack_counts(counts, number[counts >= 2])) < 0.9 * len(plain)


# ---- n-gram join ----


def test_ngram_join_odd_rows(odd, none):
    out = ngram_join.link_components(odd).collect()
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)
    ids = {r.doc_id: r.component_id for r in out}
    assert len(found) == 12 and ids[2] == 1 and ids[8] == 7 and ids[3] == 3 and ids[6] == 6 and ids[None] is None and ids[9] == 9
    assert {r.doc_id: r.n_shingles for r in out}[6] == 1 and {r.n_shingles for r in out if r.doc_id in (3, 4, 5)} == {0}
    assert ngram_join.link_components(none).count() == 0
    assert ngram_join.link_components(odd.filter("doc_id in (3, 4)")).count() == 2
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "9", "None"]


def test_ngram_join_of_texts_that_share_an_id(spark):
    """Links of every text count, whatever its id; of each component one row stays."""
    a, b, c = prose(80, 1), prose(80, 2), prose(80, 3)
    rows = [(5, a), (5, b), (7, a + " x"), (8, b + " y"), (9, b + " y z"), (10, c), (5, c + " w"), (11, None), (11, c + " v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles > 0, r.component_id) for r in ngram_join.link_components(docs).collect())
    assert got == [(5, True, 5)] * 3 + [(7, True, 5), (8, True, 5), (9, True, 5), (10, True, 5), (11, False, 11), (11, True, 5)]
    kept = {(r.doc_id, r.text) for r in ngram_join.one_of_each(docs).collect()}
    assert kept == {(5, a), (5, b), (5, c + " w"), (11, None)}
    near = spark.createDataFrame([(5, a), (5, a + " x"), (5, a), (6, a + " y")], "doc_id long, text string")
    assert [r.doc_id for r in ngram_join.one_of_each(near).collect()] == [5]


def test_ngram_join_of_large_parts(spark, small_dir, monkeypatch):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    want = sorted(ngram_join.link_components(docs).collect())
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 3)
    monkeypatch.setattr(ngram_join, "CENTERS", 1)
    assert sorted(ngram_join.link_components(docs).collect()) == want


def test_links_within_a_block():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(12):
        base = rng.choice(10_000, rng.integers(5, 60), replace=False)
        for _ in range(6):
            kept = base[rng.random(len(base)) > 0.07]
            sets.append(np.unique(np.concatenate([kept, rng.choice(10_000, rng.integers(0, 4))])).astype(np.uint64))

    def components(pairs, n):
        label = list(range(n))
        for x, y in pairs:
            a, b = label[x], label[y]
            label = [min(a, b) if v in (a, b) else v for v in label]
        return label

    linked = [(x, y) for x in range(len(sets)) for y in range(x) if 100 * (o := len(np.intersect1d(sets[x], sets[y]))) >= 80 * (len(sets[x]) + len(sets[y]) - o)]
    got = ngram_join.links_within(np.array([len(s) for s in sets]), np.concatenate(sets), rng.random(len(sets)))
    assert set(map(frozenset, got)) <= set(map(frozenset, linked))
    assert components(got, len(sets)) == components(linked, len(sets))


# ---- HTML ----


def test_html_odd_pages(spark):
    cases = {
        None: "", "": "", "   ": "", "plain text only": "plain text only", "a < b": "a < b", "<!-- never closed <p>x</p>": "", "<script>var x='<p>y</p>'": "",
        "<article><h1>T</h1><p>One&nbsp;two &amp;\n three<p>four <a href='x'>five</a></article><div class='comments'><article><p>reader talks here</p></article></div>": "T\n\nOne two & three\n\nfour five",
        "<div class='cookie-notice'>We use cookies here</div><main><header><h1>Head</h1></header><p>Body text of it all.</p><div class='advertisement'>Buy this now</div><p>And more text.</p></main><footer>(c)</footer>": "Head\n\nBody text of it all.\n\nAnd more text.",
    }
    rows = [(k, None, page, "old") for k, page in enumerate([*cases, "<p>" + "word " * 200_000])]
    out = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).orderBy("page_id").collect()
    assert [r.text for r in out[:-1]] == list(cases.values()) and len(out[-1].text.split()) == 200_000
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_head_without_end_tag():
    weights, article = html_extract.learn(), "<article><h1>T</h1><p>One two three four five six seven.</p></article>"
    for page in (f"<html><head><title>x</title><meta charset=utf-8><body>{article}", f"<head><link rel=x><style>p{{}}</style>{article}", f"<head><title>x</title></head><body>{article}</body>"):
        assert html_extract.extract(page, weights) == "T\n\nOne two three four five six seven."
    assert html_extract.extract("<head><title>x</title>plain words of a page without tags", weights) == "plain words of a page without tags"


ARTICLE = "<h1>T</h1><p>One two three four five six seven.</p><p>And eight nine ten eleven twelve.</p>"
ARTICLE_TEXT = "T\n\nOne two three four five six seven.\n\nAnd eight nine ten eleven twelve."


@pytest.mark.parametrize(
    "page",
    [
        "<body class='page-template single post-template comment-open sidebar-right has-header-image'>{}<div class='comments'><p>reader talks here</p></div></body>",
        "<body class='archive no-sidebar'><div id='page' class='hfeed site sidebar-left'><div class='content-area'>{}</div><div class='sidebar'><p>other things to read</p></div></div></body>",
        "<article class='share-more'>{}</article><footer>(c) some one</footer>",
        "<main class='has-newsletter-popup'>{}</main><div class='cookie-notice'><p>we use cookies</p></div>",
        "<button class=menu>Menu<article>{}</article>",
        "<nav><button>Menu</nav><article>{}</article>",
        "<select><option>a<option>b<article>{}</article>",
        "<svg><path d='x'/><article>{}</article>",
        "<html><head><title>x</title><body><ul class=nav><li><a href=x>home</a><li><a href=y>about</a></ul><article>{}",
    ],
)
def test_html_of_real_sites(page):
    assert html_extract.extract(page.format(ARTICLE), html_extract.learn()) == ARTICLE_TEXT


def test_html_references_end_with_their_run():
    assert html_extract.extract("<article><p>one &am<b>p;</b> two &lt;b&gt; three four five</p></article>", html_extract.learn()) == "one &amp; two <b> three four five"


def test_html_deep_nesting_is_linear():
    import time

    weights, began = html_extract.learn(), time.perf_counter()
    for opened in ("<div class='x'>", "<b>", "<p><table><tr><td>", "<ul><li>", "<p>a<div>", "<span><a href=x>"):
        page = opened * 50_000 + "<article><p>" + "main words here " * 10 + "</p></article>" + "</div>" * 50_000
        assert "main words here" in html_extract.extract(page, weights)
    assert time.perf_counter() - began < 60


def test_html_on_labelled_pages_not_learnt_from():
    import re

    weights, same, pages = html_extract.learn(), 0, html_extract.labelled_pages(200, seed=99)
    for page in pages:
        want = " ".join(re.sub("<[^>]*>", " ", f) for f, main in page if main).split()
        same += html_extract.extract("".join(f for f, _ in page), weights).split() == want
    assert same / len(pages) >= 0.9


def test_region_is_the_largest_sum():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores = rng.normal(size=rng.integers(1, 15)).tolist()
        a, b = html_extract.region(scores)
        assert sum(scores[a:b]) == pytest.approx(max(0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))))


# ---- mixing ----


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.targets([10, 990], [3, 1]) == [30, 970]
    assert mixing.targets([0, 5], [1, 2]) == [0, 5]
    assert mixing.targets([], []) == [] and mixing.targets([0], [1]) == [0]
    rng = np.random.default_rng(2)
    for _ in range(100):
        sizes, weights = rng.integers(0, 1000, 9).tolist(), [1, 2, 3] * 3
        goal = [sum(sizes) * w / 18 for w in weights]
        capped: set[int] = set()
        while over := {k for k in range(9) if k not in capped and goal[k] > 3 * sizes[k] + 1e-9}:
            capped |= over
            rest = sum(sizes) - sum(3 * sizes[k] for k in capped)
            free = sum(weights[k] for k in range(9) if k not in capped)
            goal = [3 * sizes[k] if k in capped else rest * weights[k] / free for k in range(9)]
        assert mixing.targets(sizes, weights) == pytest.approx(goal)


def test_mixing_odd_rows(odd, none):
    sized = mixing.sizes(odd.drop("size").withColumn("target", F.lit("x")))
    out = mixing.Mix(sized).taken().collect()
    assert len(out) == 12 and all(0 <= r.taken <= 3 * r.size for r in out)
    assert mixing.Mix(mixing.sizes(none.drop("size"))).taken().count() == 0
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    assert mixed.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(r.taken for r in out)


def test_schedule_follows_the_shares(spark):
    rows = [(k, "abc"[k % 3], 40) for k in range(600)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), block=16)
    slots = sorted(mix.schedule().collect())
    assert len({s.slot for s in slots}) == len(slots)
    for k in range(3):
        assert [s.rank for s in slots if s.k == k] == list(range(sum(s.k == k for s in slots)))
    half = slots[: len(slots) // 2]
    for k, share in enumerate((1 / 6, 2 / 6, 3 / 6)):
        assert abs(sum(s.k == k for s in half) / len(half) - share) < 0.02


def test_mix_is_in_the_order_of_the_schedule(spark):
    rows = [(k, prose(60, k), None, "abc"[k % 3], None) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = [(r.source, len(r.text.split()), r.doc_id) for r in mixing.mix_documents(docs).collect()]
    assert [x for x in mixed if x[0] == "a"] and sum(n for _, n, _ in mixed) == sum(r.taken for r in mixing.Mix(mixing.sizes(docs)).taken().collect())
    for share in (0.25, 0.5, 1.0):
        words = {s: sum(n for source, n, _ in mixed[: int(share * len(mixed))] if source == s) for s in "abc"}
        for s, want in zip("abc", (1 / 6, 2 / 6, 3 / 6), strict=True):
            assert words[s] / sum(words.values()) == pytest.approx(want, abs=0.01 / share)
    slots = {r.doc_id: r.slots for r in mixing.Mix(mixing.sizes(docs)).taken().collect()}
    copies = {}
    for _, _, doc in mixed:
        copies[doc] = copies.get(doc, 0) + 1
    assert {d: len(s) for d, s in slots.items() if s} == copies
    order = [slots[d][sum(x[2] == d for x in mixed[:at])] for at, (_, _, d) in enumerate(mixed)]
    assert order == sorted(order)


# ---- quality ----


def test_classifier_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1), (9, 0), (None, 1), (3, None), (99, 1)], "doc_id long, quality int")
    field = quality_crf.fit(odd, labels)
    out = quality_crf.score(odd, field)
    assert out.count() == 12 and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality_crf.score(none, field).count() == 0
    assert quality_crf.keep_good(odd, labels).columns == odd.columns
    for few in (labels.limit(0), labels.filter("quality = 1")):
        assert quality_crf.score(odd, quality_crf.fit(odd, few)).count() == 12


def test_a_junk_line_amid_good_ones(spark):
    """Learnt from documents that are good or bad as wholes, the field tells lines apart within one."""
    rng = random.Random(11)
    junk = lambda: " ".join(rng.choice(["BUY", "NOW!!!", "$$$", "###", "CLICK", "@@@", "FREE!!!"]) for _ in range(rng.randint(6, 14)))
    line = lambda k: prose(rng.randint(8, 14), k)
    rows = [(k, "\n".join(line(100 * k + j) if k % 2 else junk() for j in range(rng.randint(4, 12)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = quality_crf.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int"))
    mixed = [line(9000 + j) for j in range(5)] + [junk()] + [line(9100 + j) for j in range(5)]
    found, _, per_doc = quality_crf.line_features(pa.array(["\n".join(mixed)]))
    good = field.marginals(found, per_doc)
    assert good[5] < 0.5 and np.delete(good, 5).min() > 0.5
    assert field.quality(pa.array(["\n".join(mixed), "\n".join(line(9200 + j) for j in range(9)), "\n".join(junk() for _ in range(9))])).round() .tolist() == [1, 1, 0]
    again = quality_crf.fit(docs.repartition(7), spark.createDataFrame([(k, k % 2) for k in reversed(range(200))], "doc_id long, quality int"))
    assert np.allclose(again.weights, field.weights) and np.allclose(again.transition, field.transition)


def test_latent_lines_keep_their_share():
    rng = np.random.default_rng(5)
    per_doc = np.array([6, 9, 4])
    labels, stretches = np.repeat([0, 1, 0], per_doc), np.repeat([0, 1, 2], per_doc)
    weights, score = rng.uniform(1, 5, 19), rng.normal(size=19) + 2
    good, pair = quality_crf.latent(score, np.array([[0.5, -0.5], [-0.5, 0.5]]), per_doc, labels, stretches, weights)
    assert (good[labels == 1] > 1 - 1e-9).all() and pair.shape == (19, 2, 2)
    for s in (0, 2):
        at = stretches == s
        share = (weights * (1 - good))[at].sum() / weights[at].sum()
        assert share == pytest.approx(quality_crf.BAD_SHARE, abs=0.01)
    assert quality_crf.latent(score - 9, np.zeros((2, 2)), per_doc, labels, stretches, weights)[0][labels == 0].max() < 0.1


def test_ids_labelled_both_ways_are_not_used(spark, odd):
    labels = spark.createDataFrame([(1, 1), (7, 1), (9, 0), (2, 0), (2, 1)], "doc_id long, quality int")
    a, b = (quality_crf.fit(odd, x) for x in (labels, labels.filter("doc_id <> 2")))
    assert np.allclose(a.weights, b.weights)


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(4)
    lengths = np.array([3, 1, 4])
    unary, move = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    marginal, _, norm = quality_crf.forward_backward(unary, move, lengths)
    at = 0
    for n in lengths:
        part = unary[at : at + n]
        paths = list(itertools.product((0, 1), repeat=int(n)))
        score = np.exp([sum(part[t, y] for t, y in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
        for t in range(n):
            assert marginal[at + t, 1] == pytest.approx(sum(s for s, p in zip(score, paths, strict=True) if p[t]) / score.sum())
        assert norm[at : at + n].sum() == pytest.approx(np.log(score.sum()))
        at += n


def test_rules_odd_rows(odd, none):
    out = quality_rules.judge(odd).collect()
    assert len(out) == 12 and all(r.base_failed for r in out if r.doc_id in (3, 4, 5, 6, 9)) and [r.kept for r in out if r.doc_id == 1] == [True]
    assert quality_rules.judge(none).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(6)
    good = rng.random(20_000) < 0.8
    digits = np.where(good[:, None], rng.choice(3, (20_000, len(quality_rules.RULES)), p=[0.02, 0.28, 0.7]), rng.choice(3, (20_000, len(quality_rules.RULES)), p=[0.6, 0.25, 0.15]))
    patterns, place, counts = np.unique((digits * 3 ** np.arange(digits.shape[1])).sum(axis=1), return_inverse=True, return_counts=True)
    posterior = quality_rules.fit(patterns, counts)
    assert np.mean((posterior[place] >= 0.5) == good) > 0.98
    assert quality_rules.fit(np.zeros(0, int), np.zeros(0, int)).size == 0


def test_ngram_join_drops_chance_ties(spark, monkeypatch):
    """Texts that share some shingles with the next one each are compared with nothing, however coarse the sketch; two that link are."""
    passages = [[f"p{k}x{j}" for j in range(12)] for k in range(41)]
    texts = [" ".join([*passages[k], *[f"own{k}x{j}" for j in range(40)], *passages[k + 1]]) for k in range(40)]
    texts += ["one " * 3 + " ".join(f"near{j}" for j in range(60)), "two " * 3 + " ".join(f"near{j}" for j in range(60))]
    compared = []
    held = ngram_join.link_parts
    monkeypatch.setattr(ngram_join, "MIN_SLOTS", 1)
    monkeypatch.setattr(ngram_join, "MAX_SLOTS", 1)
    monkeypatch.setattr(ngram_join, "link_parts", lambda sets: compared.append(sets.count()) or held(sets))
    rows = ngram_join.link_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {k: min(k, 40) for k in range(42)}
    assert compared == [2]
