"""The registered queries against their SQL, or against brute force where SQL cannot express them."""

import bisect
import collections
import math
import re
import zlib

import numpy as np
import pytest

from tessera.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(Q.QUERIES[name], Q.ORACLE_SQL[name])


def rows(spark, path, table, *columns):
    return spark.read.parquet(f"{path}/{table}.parquet").select(*columns).collect()


def test_packing_round_trip(spark, small_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Q.QUERIES["op3_packing"](spark, small_dir).collect()
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in rows(spark, small_dir, "documents", "doc_id", "text")}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 2048 and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces[:-1]]]))
        assert sum(r.length for r in pieces) == len(ids[doc]) and all(r.length == 2048 for r in pieces[1:])
        assert len(pieces) == 1 or len(ids[doc]) > 2048
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces[:-1]]]))
        assert sum(r.length for r in pieces) <= 2048
    remainders, opened = [], 0
    for length in sorted((r.length for r in got), reverse=True):
        k = bisect.bisect_left(remainders, length)
        if k == len(remainders):
            opened, left = opened + 1, 2048
        else:
            left = remainders.pop(k)
        bisect.insort(remainders, left - length)
    assert len(by_sequence) == opened


def test_language_model(spark, small_dir):
    got = {r.doc_id: r for r in Q.QUERIES["op5_suffix_tree_lm"](spark, small_dir).collect()}
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in rows(spark, small_dir, "documents", "doc_id", "text")}
    assert set(got) == set(tokens)
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    counts = collections.Counter(t for d, ts in tokens.items() if not held[d] for t in ts)
    total, below = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    for d, ts in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ts), sum(t in counts for t in ts), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.1) / below) for t in ts), rel=1e-9)
        assert r.score <= 0
    new = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)


def test_html(spark, small_dir):
    import html

    want = {}
    for r in rows(spark, small_dir, "pages", "page_id", "html"):
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    got = Q.QUERIES["op7_html_extract"](spark, small_dir).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_classifier_held_out_accuracy(spark, small_dir):
    got = {r.doc_id: r for r in Q.QUERIES["op9_quality_crf"](spark, small_dir).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    labels = {r.doc_id: r.quality for r in rows(spark, small_dir, "labels", "doc_id", "quality") if r.doc_id in got and got[r.doc_id].held_out}
    assert np.mean([got[d].predicted == q for d, q in labels.items()]) >= 0.95


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_words(words):
    """Flags of the words in windows of three that occur twice."""
    windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    flags = [False] * len(words)
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            flags[k : k + 3] = [True] * 3
    return flags


def plain_lines(text):
    """(features, weight) of the lines with words, from their definition."""
    out, seen, at = [], set(), 0
    flags = repeated_words(WORD.findall(text))
    pieces = text.split("\n")
    for k, line in enumerate(pieces):
        words = WORD.findall(line)
        n = len(words)
        if not n:
            continue
        chars, size = sum(map(len, words)), len(line.encode()) + (k < len(pieces) - 1)
        count = lambda marks, line=line: sum(c in marks for c in line)
        symbol, bang, upper = count("#*$%&|<>") / n, count("!") / n, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size
        high = sum(b >= 0x80 for b in line.encode())
        repeat = sum(flags[at : at + n])
        at += n
        out.append(([1, math.log1p(n) / 4, abs(chars / n - 5) / 2, chars / n > 7.5, min(symbol, 2), symbol > 0.1, min(bang, 2), bang > 0.2, upper, upper > 0.3, count("0123456789") / size, 4 * count(".,;:") / size, high / size, tuple(words) in seen, 1 - len(set(words)) / n if n >= 8 else 0.3, repeat / n], chars))
        seen.add(tuple(words))
    return out or [([1] + [0] * 15, 1)]


def plain_quality(text, field):
    """Length-weighted mean of the lines' marginals, by sums over paths."""
    lines = plain_lines(text)
    x = [np.array(f, float) for f, _ in lines]
    none = np.zeros(16)
    scores = [np.concatenate([x[k], x[k - 1] if k else none, x[k + 1] if k + 1 < len(x) else none]) @ field.weights for k in range(len(x))]
    unary = [np.array([0.0, s]) for s in scores]
    both = lambda a: np.logaddexp.reduce(a, axis=0)
    ahead, behind = [unary[0]], [np.zeros(2)]
    for u in unary[1:]:
        ahead.append(both(ahead[-1][:, None] + field.transition) + u)
    for u in unary[:0:-1]:
        behind.insert(0, np.logaddexp.reduce(field.transition + (u + behind[0])[None], axis=1))
    good = [1 / (1 + math.exp(min(700, (a + b)[0] - (a + b)[1]))) for a, b in zip(ahead, behind, strict=True)]
    weights = [w for _, w in lines]
    return float(np.dot(weights, good) / sum(weights))


def test_classifier_scores_against_the_definition(spark, small_dir):
    from tessera.llm import quality_crf

    docs = {r.doc_id: r.text or "" for r in rows(spark, small_dir, "documents", "doc_id", "text")} | {-1: "", -2: " \n\t", -3: "one line\n\none line\nDAS IST ÄRGER!!!\n" * 4}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    field = quality_crf.fit(df, spark.read.parquet(f"{small_dir}/labels.parquet").select("doc_id", "quality"))
    got = {r.doc_id: r.score for r in quality_crf.score(df, field, keep=["doc_id"]).collect()}
    assert got == pytest.approx({d: plain_quality(t, field) for d, t in docs.items()}, abs=1e-6)


def base_features(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(repeated_words(words))


def plain_votes(text):
    """The votes of all rules on a text, from their definitions."""
    from tessera.llm import quality_rules as rules

    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    marks = lambda some: sum(c in some for c in text)
    shares = {
        "symbol_share": marks("#*$%&|<>") / max(n, 1), "dup_line_share": (len(lines) - len(set(lines))) / max(len(lines), rules.FEW_LINES), "repeat_share": sum(repeated_words(words)) / max(n, 1),
        "upper_share": marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / max(chars, 1), "bang_share": marks("!") / max(n, 1), "top_word_share": max(collections.Counter(words).values()) / n if n >= 50 else 0.0,
        "word_length_off": abs(chars / max(n, 1) - rules.USUAL_WORD_LENGTH),
    }
    return tuple("bad" if shares[name] >= bad else "good" if shares[name] <= good else None for name, good, bad in rules.RULES)


def plain_posteriors(votes):
    """Expectation-maximisation over documents' votes, rule by rule."""
    count = collections.Counter(votes)
    good = {v: 0.1 if "bad" in v else 0.9 for v in count}
    for _ in range(500):
        prior = (sum(count[v] * good[v] for v in count) + 1) / (sum(count.values()) + 2)
        odds = {v: math.log(prior / (1 - prior)) for v in count}
        for k in range(len(next(iter(count)))):
            held = {(side, x): 0.1 + sum(count[v] * (good[v] if side else 1 - good[v]) for v in count if v[k] == x) for side in (0, 1) for x in ("bad", "good", None)}
            whole = [sum(held[side, x] for x in ("bad", "good", None)) for side in (0, 1)]
            for v in count:
                odds[v] += math.log(held[1, v[k]] / whole[1]) - math.log(held[0, v[k]] / whole[0])
        new = {v: 1 / (1 + math.exp(max(-700, min(700, -odds[v])))) for v in count}
        moved, good = max(abs(new[v] - good[v]) for v in count), new
        if moved < 1e-10:
            break
    return good


def test_rule_posteriors_against_the_definition(spark, small_dir):
    from tessera.llm import quality_rules

    docs = {r.doc_id: r.text or "" for r in rows(spark, small_dir, "documents", "doc_id", "text")}
    votes = {d: plain_votes(t) for d, t in docs.items()}
    want = plain_posteriors(votes.values())
    got = {r.doc_id: r for r in quality_rules.judge(spark.read.parquet(f"{small_dir}/documents.parquet"), keep=["doc_id"]).collect()}
    assert {d: r.posterior for d, r in got.items()} == pytest.approx({d: want[v] for d, v in votes.items()}, abs=1e-6)
    assert all(r.kept == (not r.base_failed and r.posterior >= 0.5) for r in got.values())


def test_quality_rules(spark, small_dir):
    got = {r.doc_id: r for r in Q.QUERIES["op10_quality_rules"](spark, small_dir).collect()}
    for doc, text in rows(spark, small_dir, "documents", "doc_id", "text"):
        r = got[doc]
        want = base_features(text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    labels = [(got[r.doc_id], r.quality) for r in rows(spark, small_dir, "labels", "doc_id", "quality") if r.doc_id in got]
    clean = [r.kept for r, q in labels if q == 1 and not r.base_failed]
    junk = [r.kept for r, q in labels if q == 0 and not r.base_failed]
    assert np.mean(clean) >= 0.98 and np.mean(junk) <= 0.1


def test_mixing_is_near_its_targets(spark, small_dir):
    first = sorted(Q.QUERIES["op8_mixing"](spark, small_dir).collect())
    assert first == sorted(Q.QUERIES["op8_mixing"](spark, small_dir).collect())
    source = {r.doc_id: r.source for r in rows(spark, small_dir, "documents", "doc_id", "source")}
    taken, target = collections.Counter(), {}
    for r in first:
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
