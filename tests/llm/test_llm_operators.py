"""The training-data operators against brute force, and on nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import functools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tamarack.llm import chat, covertree, katz, langid, linededup, mixing, pieces, quality, rules, simhash

WS = " \t\n\v\f\r"


def docs_of(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def prose(rng, n, words="the of and to a in that is it was for on are as with his they at be this".split()):
    return " ".join(rng.choice(words) + (str(rng.randrange(40)) if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randint(1, 120)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", None]), 0) for k in range(60)]
    rows += [(60, rows[3][1], "en", "a", 0), (61, rows[3][1] + " extra", "en", "a", 0), (62, None, "en", "a", None), (63, "", None, None, 0), (64, WS, "fr", "c", 0), (65, "Ünï ❤ \x00 ▁ word\n\n ünï", "fr", "b", 0)]
    rows += [(66, prose(rng, 20_000), "en", "b", 0), rows[5], rows[5], (None, "some null id text", "en", "a", 0)]
    return rows


def union(n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    return parent, find


# 1


def test_mixing_matches_the_rule(spark, corpus):
    got = mixing.mix(docs_of(spark, corpus)).collect()
    assert len(got) == len(corpus)
    size = Counter()
    for _, t, _, s, _ in corpus:
        size[s] += len((t or "").encode().split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, open_, target = 1.5 * sum(size.values()), set(names), {}
    while True:
        left = total - sum(target.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
        open_ -= set(over)
    left = total - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(target[s]) for s in names if size[s])
    again = mixing.mix(docs_of(spark, corpus[::-1]).repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixed_documents_keep_columns_and_whole_texts(spark, corpus):
    d = docs_of(spark, corpus).selectExpr("*", "1 AS size", "2 AS k", "3 AS target", "4 AS mix_epoch2")
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    texts = {t for _, t, *_ in corpus}
    assert all(r.text in texts for r in out.collect())


def test_mixing_empty(spark):
    assert mixing.mix(docs_of(spark, [])).collect() == []
    assert mixing.mixed_documents(docs_of(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix(docs_of(spark, [(1, None, None, None, None)])).collect()] == [0]


# 2


def test_chat_digests_and_escapes(spark):
    rows = [(7, 2, "assistant", "b\n"), (7, 1, "user", "<|im_end|>"), (7, None, None, None), (8, 0, "assistant", "\\<|\\"), (8, 0, "assistant", "a"), (None, 1, "us\ner", "x"), (9, 0, "system", "")]
    out = chat.read_back(chat.format_conversations(chat.text_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    turns = {7: [("", ""), ("user", "<|im_end|>"), ("assistant", "b\n")], 8: [("assistant", "\\<|\\"), ("assistant", "a")], None: [("us\ner", "x")], 9: [("system", "")]}
    assert {r.conv_id for r in out} == set(turns)
    for r in out:
        t = turns[r.conv_id] if r.conv_id != 8 else sorted(turns[8], key=lambda x: x[1])
        assert r.n_turns == len(t)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        loss = "".join(b for a, b in t if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(chat.text_messages(empty))).collect() == []


def test_chat_parts(spark):
    part = lambda **k: {f: k.get(f) for f in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    content = [part(type="text", text="see <|image_1|>"), part(type="image", ref="s3/a.png", width=57, height=28), part(type="audio", ref="b.wav", seconds=1.01), part(type="document", ref="c.pdf", pages=3), part(type="odd"), part(text="end")]
    m = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", [part(type="image", width=1, height=1)]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = chat.format_conversations(m).orderBy("turn_no").collect()
    assert [(a.number, a.type, a.ref, a.tokens) for a in got[0].attachments] == [(1, "image", "s3/a.png", 3), (2, "audio", "b.wav", 26), (3, "document", "c.pdf", 768), (4, "file", None, 0)]
    assert got[0].tokens == 797 and got[1].attachments[0].number == 5 and got[2].chunk == "<|im_start|>user\n<|im_end|>\n"
    whole = "".join(r.chunk for r in got)
    assert [r.offset for r in got] == [0, len(got[0].chunk), len(got[0].chunk) + len(got[1].chunk)]
    assert chat.parse(whole)[0] == ("user", [("text", "see <|image_1|>"), ("image", "1"), ("audio", "2"), ("document", "3"), ("file", "4"), ("text", "end")])
    assert all(whole[r.offset + a.at :].startswith(f"<|{a.type}_{a.number}|>") for r in got for a in r.attachments)


# 3


@pytest.mark.parametrize("block", [16, 2048])
def test_embeddings_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(30):
        c = rng.normal(size=6)
        rows += [(len(rows) + k, (c + rng.normal(size=6) * rng.choice([0, 0.05, 0.3])).tolist()) for k in range(rng.integers(1, 10))]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 6), (1003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1004, [math.nan] * 6), (1007, [math.inf] * 6), (None, [1.0] * 6)]
    odd = [(1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1008, [1e-300] * 6), (1009, [1e300] * 6)]
    d = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad + odd], "vec_id long, embedding array<double>, label string, n long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(d).collect()}
    good = rows + odd
    unit = [np.array(v) / max(map(abs, v)) for _, v in good]
    n, (parent, find) = [0] * len(good), union(len(good))
    for a in range(len(good)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / math.sqrt(unit[a] @ unit[a]) / math.sqrt(unit[b] @ unit[b]) >= 0.9:
                n[a] += 1
                n[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {i: (n[k], good[find(k)][0], find(k) == k) for k, (i, _) in enumerate(good)} | {i: (0, i, i is not None) for i, _ in bad}
    assert got == want


def test_embeddings_empty_and_repeated(spark):
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    out = covertree.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


# 4


def test_quality_learns_order(spark):
    rng = random.Random(2)
    make = lambda g: prose(rng, 60) + " " + {0: "!!! *** XXX", 1: "scum idiot", 2: ""}[g]
    rows = [(k, make(k % 3), "en", "a", 0) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 3 == 1)) for k in range(200)] + [(None, 1, 0), (3, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    d = docs_of(spark, [*rows, (900, None, None, None, None), (901, " \n", None, None, None)]).selectExpr("*", "'x' AS kept", "1 AS id", "2 AS grade")
    model = quality.train(d, quality.grades(labels), 3)
    assert (np.diff(model.thresholds) > 0).all()
    out = {r.doc_id: r for r in quality.score_documents(d, model, 3).collect()}
    assert len(out) == 302
    right = sum(out[k].kept == (k % 3 == 2) for k in range(200, 300))
    assert right >= 97
    mean = [np.mean([out[k].expected_grade for k in range(200, 300) if k % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert all(o.tails[0] >= o.tails[1] for o in out.values())
    assert (out[900].expected_grade, out[900].kept, out[901].kept) == (0.0, False, False)


def test_quality_fits_on_more_than_8000_rows(spark, monkeypatch):
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, *a: seen.append(len(rows)) or fit(rows, *a))
    d = spark.range(9_000).selectExpr("id AS doc_id", "concat('word', id % 50) AS text")
    quality.train(d, spark.range(9_000).selectExpr("id AS doc_id", "int(id % 3) AS grade"), 3)
    assert seen == [9_000]


def test_quality_fit_holds_only_used_features():
    import tracemalloc

    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 1 << quality.BITS, 1000)).astype(np.int32), None) for _ in range(1000)]
    rows = [(s, np.ones(len(s), np.float32)) for s, _ in rows]
    tracemalloc.start()
    quality.fit(rows, np.arange(1000) % 3, 3, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6


def test_quality_without_labels(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, grade int")
    d = docs_of(spark, corpus)
    assert quality.train(d, none, 3) is None
    assert all(r.kept and r.expected_grade is None for r in quality.score_documents(d, None, 3).collect())
    assert quality.score_documents(docs_of(spark, []), None, 3).collect() == []


# 5


def test_rules_match_brute_force(spark, corpus):
    trusted = spark.createDataFrame([(k,) for k in range(0, 40, 2)] + [(0,), (None,)], "doc_id long")
    d = docs_of(spark, corpus).selectExpr("*", "1 AS kept", "2 AS bucket", "3 AS trusted_id")
    got = rules.apply_rules(d, trusted).collect()
    assert len(got) == len(corpus)

    def grams(t):
        w = (t or "").encode().lower().split()
        h = np.array([xxhash.xxh3_64_intdigest(x) for x in w], np.uint64)
        return rules.buckets(h) if len(h) else np.zeros(0, int)

    ids = set(range(0, 40, 2))
    total = np.ones((2, 1 << rules.BITS))
    for i, t, *_ in corpus:
        np.add.at(total[0], grams(t), 1)
        if i in ids:
            np.add.at(total[1], grams(t), 1)
    llr = np.log(total[1] / total[1].sum()) - np.log(total[0] / total[0].sum())
    by_text = {}
    for _, t, *_ in corpus:
        words = [w.decode() for w in (t or "").encode().split()]
        tri = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        count = Counter(tri)
        cover = {k + j for k, x in enumerate(tri) if count[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
        score = llr[grams(t)].mean() if words else None
        by_text[t] = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover), failed, not failed and (score is None or score >= rules.THRESHOLD))
        assert score is None or abs(score) < 20
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == by_text[r.text]
        assert (r.log_ratio is None) == (r.n_words == 0)


def test_rules_empty(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert rules.apply_rules(docs_of(spark, []), none).collect() == []
    out = rules.apply_rules(docs_of(spark, [(1, "a b c a b c " * 20, None, None, None), (2, prose(random.Random(1), 80), None, None, None)]), none).collect()
    assert [(r.kept, r.log_ratio) for r in sorted(out, key=lambda r: r.doc_id)] == [(False, None), (True, None)]


# 6


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = []
    for k in range(80):
        lines = [rng.choice([rng.choice(pool), " ".join(rng.choice("aB") for _ in range(rng.randint(4, 8))), "", "x  y"]) for _ in range(rng.randint(0, 6))]
        rows.append((k, "\n".join(lines), 1, "q"))
    rows += [(90, None, 1, "q"), (91, "", 1, "q"), (None, "a b c d e f\nnew one", 1, None), rows[7]]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_near int, half string")
    got = sorted(repr((r.doc_id, r.text, r.n_lines, r.n_copies, r.n_near)) for r in linededup.dedup_lines(d).collect())

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    seen, want, done = [], [], {}
    for d_, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if (d_, t) not in done:
            keep, copies, nears = [], 0, 0
            for line in (t or "").split("\n") if t is not None else []:
                w = line.lower().split()
                if not w:
                    keep.append(line)
                elif w in seen:
                    copies += 1
                else:
                    if len(w) >= linededup.MIN_WORDS and any(len(x) >= linededup.MIN_WORDS and near(w, x) for x in seen):
                        nears += 1
                    else:
                        keep.append(line)
                    seen.append(w)
            done[d_, t] = (d_, None if t is None else "\n".join(keep), 0 if t is None else t.count("\n") + 1, copies, nears)
        want.append(repr(done[d_, t]))
    assert got == sorted(want)
    exact = linededup.dedup_lines(d, max_edits=0).collect()
    assert len(exact) == len(rows) and not any(r.n_near for r in exact)
    empty = linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "n_lines", "n_copies", "n_near"]


def test_near_words():
    a = lambda s: np.array(s.split())
    assert linededup.near_words(a("x y z"), a("x y z")) and linededup.near_words(a("x y z"), a("x q z"))
    assert linededup.near_words(a("x y z"), a("x z")) and linededup.near_words(a("y z"), a("x y z")) and linededup.near_words(a("x y"), a("x y z"))
    assert not linededup.near_words(a("x y z"), a("q y w")) and not linededup.near_words(a("x y z"), a("x"))


# 7


@pytest.mark.parametrize(("heavy", "chunk"), [(3, 200), (1000, 10_000)])
def test_katz_matches_brute_force(spark, monkeypatch, corpus, heavy, chunk):
    monkeypatch.setattr(katz, "HEAVY", heavy)
    monkeypatch.setattr(katz, "CHUNK", chunk)
    monkeypatch.setattr(katz, "PAIRS", 500)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(i, t, held(i)) for i, t, *_ in corpus]
    out = katz.score_documents(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()
    docs = [(i, [*(t or "").encode().lower().split(), b"\n"], h) for i, t, h in rows]
    one, two = Counter(w for _, t, h in docs if not h for w in t), Counter()
    for _, t, h in docs:
        if not h:
            two.update(zip([b"\n", *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    disc = lambda c: katz.discounts([Counter(c.values())[r] for r in range(1, katz.K + 2)])
    d1, d2, top = disc(one), disc(two), katz.K + 1
    low = {w: d1[min(c, top)] * c / n for w, c in one.items()}
    unk = 1 - sum(low.values())
    if unk <= 1e-12:
        low, unk = {w: c / (n + 1) for w, c in one.items()}, 1 / (n + 1)
    seen, under = defaultdict(float), defaultdict(float)
    for (h, w), c in two.items():
        seen[h] += d2[min(c, top)] * c / one[h]
        under[h] += low[w]

    def prob(h, w):
        if h not in one:
            return low.get(w, unk)
        scale = one[h] / (one[h] + 1) if seen[h] >= 1 - 1e-12 else 1
        if (h, w) in two:
            return scale * d2[min(two[h, w], top)] * two[h, w] / one[h]
        return (1 - seen[h] * scale) / (1 - under[h]) * low.get(w, unk)

    want = Counter()
    for i, t, h in docs:
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10(prob(a, b)) for a, b in zip([b"\n", *t], t, strict=False))
        want[i, h, len(t), sum(w in one for w in t), n, round(base, 5), round(score, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in out) == want
    # Probabilities after a history sum to 1.
    for h in list(one)[:5]:
        assert sum(prob(h, w) for w in one) + prob(h, b"?unknown?") == pytest.approx(1)


@pytest.mark.parametrize("order", [1, 3, 4])
def test_katz_of_other_orders_matches_brute_force(spark, corpus, order):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(i, t, held(i)) for i, t, *_ in corpus][:120] + [(-1, "", False), (-2, None, True), (-1, "a b a b a b", False), (-1, "a b a b a b", False)]
    out = katz.score_documents(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), order).collect()
    docs = [(i, [b"\n"] * (order - 1) + [*(t or "").encode().lower().split(), b"\n"], h) for i, t, h in rows]
    grams = {k: Counter(tuple(t[j - k + 1 : j + 1]) for _, t, h in docs if not h for j in range(order - 1, len(t))) for k in range(1, order + 1)}
    n, v, top = sum(grams[1].values()), len(grams[1]), katz.K + 1
    disc = {k: katz.discounts([Counter(g.values())[r] for r in range(1, katz.K + 2)]) for k, g in grams.items()}
    one = {g: disc[1][min(c, top)] * c / n for g, c in grams[1].items()}
    unknown = 1 - sum(one.values())
    if unknown <= 1e-12:
        one, unknown = {g: c / (n + 1) for g, c in grams[1].items()}, 1 / (n + 1)
    after = {k: defaultdict(list) for k in grams}
    for k, g in grams.items():
        for x in g:
            after[k][x[:-1]].append(x)

    @functools.cache
    def history(h):
        every = after[len(h) + 1][h]
        total = sum(grams[len(h) + 1][x] for x in every)
        mass = sum(disc[len(h) + 1][min(grams[len(h) + 1][x], top)] * grams[len(h) + 1][x] for x in every) / total
        scale = total / (total + 1) if mass >= 1 - 1e-12 else 1
        return total, scale, (1 - mass * scale) / (1 - sum(prob(x[1:]) for x in every))

    def prob(x):
        if len(x) == 1:
            return one.get(x, unknown)
        if not after[len(x)][x[:-1]]:
            return prob(x[1:])
        total, scale, alpha = history(x[:-1])
        c = grams[len(x)][x]
        return scale * disc[len(x)][min(c, top)] * c / total if c else alpha * prob(x[1:])

    want = Counter()
    for i, t, h in docs:
        own = t[order - 1 :]
        base = sum(math.log10((grams[1][(w,)] + 1) / (n + v + 1)) for w in own)
        score = sum(math.log10(prob(tuple(t[j - order + 1 : j + 1]))) for j in range(order - 1, len(t)))
        want[i, h, len(own), sum((w,) in grams[1] for w in own), n, round(base, 5), round(score, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in out) == want
    for h in list(after[order])[:5]:
        assert sum(prob((*h, *w)) for w in grams[1]) + prob((*h, b"?unknown?")) == pytest.approx(1)


def test_katz_by_tables_of_order_two_is_the_packed_one(spark, corpus):
    d = spark.createDataFrame([(i, t, (i or 0) % 3 == 0) for i, t, *_ in corpus], "doc_id long, text string, held_out boolean")
    key = lambda rows_: Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in rows_)
    assert key(katz._by_tables(d, 2).collect()) == key(katz.score_documents(d).collect())


def test_katz_of_other_orders_without_training(spark):
    assert katz.score_documents(spark.createDataFrame([], "doc_id long, text string, held_out boolean"), 3).collect() == []
    out = katz.score_documents(spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean"), 3).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out] == [(3, 0, 0, 0.0, 0.0)]
    with pytest.raises(ValueError):
        katz.score_documents(spark.createDataFrame([], "doc_id long, text string, held_out boolean"), 0)


def test_katz_without_training(spark):
    assert katz.score_documents(spark.createDataFrame([], "doc_id long, text string, held_out boolean")).collect() == []
    out = katz.score_documents(spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out] == [(3, 0, 0, 0.0, 0.0)]


# 8


def test_language_identification(spark):
    rng = random.Random(4)
    stems = {"aa": ["thing", "other", "wheth", "should"], "bb": ["étre", "queux", "pouril", "avecé"], "cc": ["schund", "gewürz", "nichtig", "überall"]}
    rows = [(k, " ".join(rng.choice(stems[lang]) + rng.choice(["", "er", "xa", "on"]) for _ in range(rng.randint(2, 40))), lang) for k in range(200) for lang in [rng.choice(sorted(stems))]]
    d = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 --- !!", "bb"), (902, "shoulden whethering", None)], "doc_id long, text string, lang string")
    d = d.withColumn("held_out", langid.held_out(d["doc_id"])).selectExpr("*", "1 AS score", "2 AS picked")
    model = langid.train(d.where("not held_out"))
    assert model.langs == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in langid.identify(d.drop("lang"), model).collect()}
    assert len(got) == 203 and all(0 <= r.score <= 1 for r in got.values())
    left = [(k, lang) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(got[k].lang_pred == lang for k, lang in left) >= 0.97 * len(left)
    assert [(got[k].lang_pred, got[k].score) for k in (900, 901)] == [("und", 0.0)] * 2 and got[902].lang_pred == "aa"
    assert {k for k, r in got.items() if r.held_out} == {k for k in got if zlib.crc32(str(k).encode()) % 4 == 2}


def test_language_training_takes_the_least_hashes_and_repeats_once(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(k, prose(rng, 9), ("en", "fr")[k % 2], "a", 0) for k in range(300)]
    want = {(lang, t) for lang in ("en", "fr") for _, t in sorted((xxhash.xxh3_64_intdigest(str(k).encode()) >> 1, t) for k, t, x, _, _ in rows if x == lang)[:20]}
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts: seen.append(texts))
    langid.train(docs_of(spark, [*rows, *[rows[7]] * 90, (None, "null id", "en", "a", 0)]).repartition(5), 20)
    got = Counter(seen[0])
    assert len(got) == 40 and set(got.values()) == {1}
    assert len(set(got) - want) <= 1  # the row without an id may be among them


def test_language_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.train(none) is None
    assert langid.identify(none, None).collect() == []


# 9


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark, corpus):
    d = docs_of(spark, corpus).selectExpr("*", "1 AS fp", "2 AS rep", "3 AS label")
    got = simhash.near_duplicates(d).collect()
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in corpus]
    parent, find = union(len(prints))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = Counter((i, f, least.get(find(k))) for k, (i, f) in enumerate(prints))
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    kept = simhash.one_of_each(docs_of(spark, corpus))
    assert kept.columns == docs_of(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {c for *_, c in want}
    assert simhash.near_duplicates(docs_of(spark, [])).collect() == []


def test_anchors_meet_every_near_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**63), 2**63 - 1, 100)
    flips = np.zeros(100, np.uint64)
    for _ in range(2):
        flips ^= np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)
    other = (base.view(np.uint64) ^ flips).view(np.int64)
    tables = simhash._patterns()
    row, anchor, home = simhash._anchors(base, tables)
    row2, anchor2, _ = simhash._anchors(other, tables)
    at = {(int(r), int(a)) for r, a in zip(row2, anchor2, strict=True)}
    assert home.sum() == 100
    assert all((int(r), int(a)) in at for r, a, h in zip(row, anchor, home, strict=True) if h)


def test_large_anchor_is_linear_and_equal(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    fp = np.unique(np.concatenate([base, *[(base.view(np.uint64) ^ np.uint64(1 << b)).view(np.int64) for b in (0, 17, 63)]]))
    row, anchor, home = simhash._anchors(fp, simhash._patterns())
    o = np.argsort(anchor, kind="stable")
    one = simhash._links(anchor[o], fp[row][o], home[o])
    monkeypatch.setattr(simhash, "LARGE", 1)
    two = simhash._links(anchor[o], fp[row][o], home[o])
    assert sorted(zip(*map(np.ndarray.tolist, one), strict=True)) == sorted(zip(*map(np.ndarray.tolist, two), strict=True))


# 10


def test_pieces_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    bits = ["the", "in", "er", " ", "  ", "\n", "q", "é", "e", "t", "ing", "日", "\0", "🎉", "http://", "=", "\t"]
    texts = ["", " ", "a", "  a  b   c\n\n d\t\te", "日本語 🎉🎉 x", "a" * 300, " " * 100 + "x" + " " * 37, "the" * 60] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 150))) for _ in range(200)]
    d = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(texts)] + [(900, None, None), (901, "▁x ▁▁ y", None), (1, " ", None)], "doc_id long, text string, ids array<int>")
    enc = pieces.encode_documents(d, path)
    got = {r.doc_id: r for r in enc.collect()}
    for k, t in enumerate(texts):
        assert got[k].ids == sp.encode(t), t
        assert got[k].round_trip and got[k].n_tokens == len(got[k].ids)
    assert (got[900].ids, got[900].n_tokens, got[900].round_trip) == (None, 0, None) and got[901].round_trip
    back = {r.doc_id: r.text for r in pieces.decode_documents(enc, path).collect()}
    assert back == {k: t for k, t in enumerate(texts)} | {900: None, 901: "▁x ▁▁ y"}
    assert pieces.encode_documents(docs_of(spark, []), path).collect() == []


def test_suffix_ranges_find_every_occurrence():
    tokenizers = pytest.importorskip("public_tokenizers")
    with open(tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        v = pieces.Vocabulary(f.read())
    text = " the thing in the theme\0 ththe"
    codes = np.frombuffer(text.encode("utf-32-le"), np.int32)
    e = pieces.edges(codes, v)
    named = {"".join(map(chr, v.codes_of(k))): k for k in range(len(v.ids))}
    for a in range(len(text)):
        for n in range(2, v.longest + 1):
            assert e[a, n] == named.get(text[a : a + n] if a + n <= len(text) else "", -1)


# Near-dedup by shingles


def brute_shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute_near(rows, least=0.8):
    sets = [brute_shingles(t) for _, t, *_ in rows]
    _, find = (parts := union(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if not sets[a] | sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parts[0][y] = x
    least_id = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least_id[find(k)] = min(i, least_id.get(find(k), i))
    return Counter((i, least_id.get(find(k))) for k, (i, *_) in enumerate(rows))


def near_copies(rng, base, n, edits):
    words = base.split()
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("few", [False, True])
def test_similar_duplicates_match_brute_force(spark, monkeypatch, corpus, few):
    rng = random.Random(4)
    if few:
        monkeypatch.setattr(simhash, "PAIRS", 7)
    rows = list(corpus)
    for k in range(12):
        base = prose(rng, rng.randint(40, 200), [f"v{j}" for j in range(500)])
        rows += [(1000 + 100 * k + j, t, "en", "a", 0) for j, t in enumerate(near_copies(rng, base, 15, 6))]
    d = docs_of(spark, rows).selectExpr("*", "1 AS node", "2 AS rep", "3 AS label", "4 AS f0", "5 AS d", "6 AS size")
    assert Counter((r.doc_id, r.component_id) for r in simhash.similar_duplicates(d).collect()) == brute_near(rows)
    kept = simhash.one_of_each(docs_of(spark, rows), simhash.similar_duplicates)
    assert kept.columns == docs_of(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in brute_near(rows)}
    assert simhash.similar_duplicates(docs_of(spark, [])).collect() == []


@pytest.mark.parametrize("pairs", [7, 1 << 20])
def test_pairs_apart_are_all_pairs_with_other_labels_and_fitting_sizes(monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = np.random.default_rng(1)
    n = 300
    key, node, label, size = np.zeros(n, int), rng.permutation(n), rng.integers(0, 60, n), rng.integers(5, 30, n)
    fp = [np.zeros(n, np.int64)] * simhash.WORDS
    monkeypatch.setattr(simhash, "homes", lambda f, lead: np.repeat(np.arange(9)[None], len(f), 0))  # none shares an earlier anchor
    monkeypatch.setattr(simhash, "BLOCK", 0)
    monkeypatch.setattr(simhash, "_patterns", lambda: (np.zeros(2), 0, np.arange(2)))
    want = {(min(node[a], node[b]), max(node[a], node[b])) for a in range(n) for b in range(a) if key[a] == key[b] and label[a] != label[b] and min(size[a], size[b]) >= 0.8 * max(size[a], size[b])}
    got = [(u, v) for b in simhash._apart(0.8)(key, node, label, size, *fp) for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_wide_fingerprints_at_21_bits_share_an_anchor_and_similar_sets_mostly_do():
    rng = np.random.default_rng(2)
    e, _, starts = simhash._patterns()
    lead = e[starts[:-1]]

    def share(a, b):
        return (simhash.homes(a[None], lead) == simhash.homes(b[None], lead)).any()

    met = 0
    for k in range(300):
        fp = rng.integers(-(1 << 63), 1 << 63, simhash.WORDS)
        bits = np.unpackbits(fp.view(np.uint8))
        bits[rng.choice(64 * simhash.WORDS, 21, replace=False)] ^= 1
        assert share(fp, np.packbits(bits).view(np.int64))
        both, own = rng.integers(0, 1 << 63, 160, np.uint64), rng.integers(0, 1 << 63, 40, np.uint64)
        a, b = np.unique(np.append(both, own[:20])), np.unique(np.append(both, own[20:]))
        assert simhash.similar(a, b, 0.8)
        x, y = simhash.wide_fingerprint(a), simhash.wide_fingerprint(b)
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= simhash.most_bits(64 * simhash.WORDS, 0.8) or k
        met += share(x, y)
    assert met >= 295


# Pipeline


def test_pipeline_drops_near_copies_with_changed_words(spark):
    import corpus_pipeline

    rng = random.Random(3)
    words = prose(rng, 200, [f"w{k}" for k in range(300)]).split()
    near = list(words)
    near[20] = near[100] = near[180] = "changed"
    far = [f"y{k}" if k % 10 == 0 else w for k, w in enumerate(words)]
    rows = [(1, " ".join(words), "en", "a", 0), (2, " ".join(near), "en", "a", 0), (3, " ".join(far), "en", "a", 0)]
    assert (simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(rows[1][1].encode())) & (1 << 64) - 1
    assert {r.doc_id for r in simhash.one_of_each(docs_of(spark, rows)).collect()} == {1, 2, 3}
    assert {r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs_of(spark, rows), None).collect()} == {1, 3}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    clean = [(k, prose(rng, 80, words), "en", f"s{k % 3}", 0) for k in range(40)]
    rows = [*clean, (50, clean[4][1], "en", "s1", 0), (51, "!!! *** XXX " * 30, "en", "s0", 0), (52, None, None, None, None), (53, "", "en", None, 0)]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(51, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "mixing sources", "sentencepiece"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in out)
    ids = {r.doc_id for r in out}
    assert ids <= set(range(40)) and len(ids) > 25 and 50 not in ids
