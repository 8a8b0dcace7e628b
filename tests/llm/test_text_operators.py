import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from oracle import same

from strandloom.llm import context_tree, html_extraction, language_id, lm_score, packing, quality_rules, queries, source_mixing, token_counts, word_tokens


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, data, name):
    same(spark, data, queries.QUERIES[name], queries.ORACLES[name])


def base(text):
    words = (text or "").encode().decode().replace("\x1c", "\x1c")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [l for l in (text or "").split("\n") if __import__("re").search("[^\x20\x09-\x0d]", l)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_base_columns(small, nothing):
    rows, frame = small
    got = {r.doc_id: r for r in quality_rules.judged(frame).collect()}
    for doc, text, *_ in rows:
        r, want = got[doc], base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    out = quality_rules.passing(frame)
    assert out.columns == frame.columns and out.count() == sum(r.kept for r in got.values())
    assert quality_rules.judged(nothing).count() == 0


def test_quality_keeps_clean_and_rejects_junk(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in quality_rules.judged(spark.read.parquet(f"{d}/documents.parquet")).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id] == 1]
    bad = [r.kept for r in rows if labels[r.doc_id] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.3 * len(bad)


def numpy_rake(cells, shares):
    """Tokens of cells {(source, lang, topic): t} raked by plain proportional fitting on a dense cube."""
    axes = [sorted({k[i] for k in cells}) for i in range(3)]
    x = np.zeros([len(a) for a in axes])
    for k, t in cells.items():
        x[tuple(a.index(v) for a, v in zip(axes, k))] = t
    total = x.sum()
    for _ in range(source_mixing.ROUNDS):
        for i in range(3):
            s = x.sum(tuple(j for j in range(3) if j != i))
            want = np.array([shares[i].get(v, 0.0) for v in axes[i]]) * total
            x = x * np.divide(want, s, out=np.zeros_like(s), where=s > 0).reshape([-1 if j == i else 1 for j in range(3)])
    return {k: x[tuple(a.index(v) for a, v in zip(axes, k))] for k in cells}


def cells_of(rows):
    cells = collections.Counter()
    for r in rows:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    return cells


def test_mixing(spark, small, nothing):
    _, frame = small
    rows = source_mixing.weighted(frame).collect()
    by_joins = source_mixing.weighted(frame, few_cells=0).collect()
    plain = lambda some: sorted((r.doc_id, r.topic, round(r.probability, 5), r.selected) for r in some)
    assert plain(rows) == plain(by_joins)
    cells = cells_of(rows)
    total = sum(cells.values())
    power = source_mixing.TEMPER
    own = [collections.Counter() for _ in range(3)]
    for k, t in cells.items():
        for i in range(3):
            own[i][k[i]] += t
    z = [sum(t**power for t in o.values()) for o in own]
    shares = [{k: t**power / z[i] for k, t in own[i].items()} for i in (0, 1)]
    lang_of = {k[2]: k[1] for k in cells}
    within = collections.Counter()
    for topic, t in own[2].items():
        within[lang_of[topic]] += t**power
    shares.append({k: shares[1][lang_of[k]] * t**power / max(within[lang_of[k]], 1e-300) for k, t in own[2].items()})
    want = numpy_rake(cells, shares)
    for r in rows:
        k = r.source, r.lang, r.topic
        assert r.weight == pytest.approx(want[k] / cells[k] if cells[k] else 0.0, abs=2e-5, rel=1e-4)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(source_mixing.BUDGET * total, rel=1e-3)
    assert max(r.probability for r in rows) <= 1.0
    out = source_mixing.mixed(frame)
    assert out.columns == frame.columns and out.count() == sum(r.selected for r in rows)
    assert source_mixing.weighted(nothing).count() == 0


def test_mixing_with_given_targets(spark):
    rnd = random.Random(5)
    rows = [(i, words(rnd, rnd.randint(1, 90)), "en" if i % 3 else "de", "abc"[i % 3 if i < 580 else 2]) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    given = {"=a": 0.2, "=b": 0.3, "=c": 0.3, "=none": 0.2}
    source = spark.createDataFrame(list(given.items()), "source string, share double")
    topic = "CASE WHEN n_tokens < 40 THEN 'short' ELSE 'long' END"
    for few in (0, 1000):
        got = source_mixing.weighted(frame, topic=topic, targets={"source": source}, few_cells=few, rounds=100).collect()
        assert len(got) == 600
        raked = collections.Counter()
        for r in got:
            raked[r.source] += r.n_tokens * r.weight
        total = sum(r.n_tokens for r in got)
        # the target without documents leaves its part to the others
        assert all(raked[k] / total == pytest.approx(given[k] / 0.8, abs=1e-5) for k in ("=a", "=b", "=c"))
    with pytest.raises(ValueError, match="no target"):
        source_mixing.weighted(frame, topic=topic, targets={"source": source.where("source != '=a'")})


def test_a_rare_cell_does_not_thin_out_the_rest(spark):
    rnd = random.Random(6)
    rows = [(i, words(rnd, 60), "en", "big") for i in range(400)] + [(1000, words(rnd, 20), "en", "tiny")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    source = spark.createDataFrame([("=big", 0.9), ("=tiny", 0.1)], "source string, share double")
    got = source_mixing.weighted(frame, topic="'all'", targets={"source": source}).collect()
    tiny = next(r for r in got if r.doc_id == 1000)
    assert tiny.selected and tiny.probability == 1.0 and tiny.shortfall > 10
    assert 0.4 < sum(r.selected for r in got) / len(got) < 0.6


def test_targets_that_cannot_hold_are_told(spark):
    frame = spark.createDataFrame([(1, "a b c", "en", "s"), (2, "a b c", "de", "t")], "doc_id long, text string, lang string, source string")
    off = {"source": spark.createDataFrame([("=s", 0.9), ("=t", 0.1)], "source string, share double"), "lang": spark.createDataFrame([("=en", 0.1), ("=de", 0.9)], "lang string, share double")}
    with pytest.warns(UserWarning, match="do not all hold"):
        assert source_mixing.weighted(frame, targets=off).count() == 2


def test_long_texts_cross_every_slice(spark, small, monkeypatch):
    from strandloom.llm import simhash_dedup

    rnd = random.Random(12)
    text = " ".join(rnd.choice(["alpha", "beta", "gamma", "the", "of"]) + str(rnd.randint(0, 99)) for _ in range(60_000))
    whole = simhash_dedup.fingerprint(text.encode())
    monkeypatch.setattr(simhash_dedup, "SLICE", 1000)
    assert simhash_dedup.fingerprint(text.encode()) == whole
    frame = spark.createDataFrame([(1, text, "en", 7), (1, text, None, 8), (2, None, "en", 9)], "doc_id long, text string, lang string, length long")
    pieces = [p for p in packing.packed(frame).collect() if p.doc_id == 1]
    total = pieces[0].doc_tokens
    assert sum(p.length for p in pieces) == 2 * total and total > 30 * packing.LENGTH
    counts = token_counts.token_counts(frame).collect()
    model, _ = token_counts.load(token_counts.public_tokenizers.path(token_counts.MODEL))
    assert sorted(r.n_tokens for r in counts) == [0] + [len(model.encode(text))] * 2
    # document 1 is learned from, so its language is the only one known
    assert {(r.doc_id, r.lang_pred) for r in language_id.predicted(frame).collect()} == {(1, "en"), (2, "und")}
    scores = [r.score for r in lm_score.scored(frame).collect() if r.doc_id == 1]
    assert len(scores) == 2 and scores[0] == pytest.approx(scores[1]) and scores[0] > -len(text)


def test_packing_round_trip(small, nothing):
    rows, frame = small
    pieces = packing.packed(frame, pool_tokens=20_000).collect()
    ids = word_tokens.load()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == {r[0] for r in rows}
    for doc, text, *_ in rows:
        want = ids.whole.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(want[p.start : at], np.uint32).tobytes())
        assert at == len(want)
    padding = 0
    for some in by_seq.values():
        at = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.LENGTH
        padding += packing.LENGTH - at
    assert padding <= 0.15 * sum(p.length for p in pieces)
    assert packing.packed(nothing).count() == 0


def test_balance_spreads_cost():
    rnd = random.Random(1)
    lengths = sorted((rnd.randint(1, 900) for _ in range(500)), reverse=True)
    n, pieces = packing.balance(lengths, 2048)
    assert n == -(-sum(lengths) // 2048)
    cost = collections.Counter()
    for _, _, length, s, _ in pieces:
        cost[s] += length + length * length / 2048
    assert max(cost.values()) < 1.5 * min(cost.values())


def test_word_memo_equals_the_library(small):
    rows, _ = small
    ids = word_tokens.load()
    texts = [r[1] or "" for r in rows] + ["don't we'll I'M", "² ½ __ a_b", "ΣΑΣ", "é", "日本 語", "'S it's", "x­y ſ K", "</w> a</w>b", "İst ǅ"]
    want = [np.array(e.ids, np.uint32).tobytes() for e in ids.whole.encode_batch(texts, add_special_tokens=False)]
    assert ids.encode(texts) == want


@pytest.mark.parametrize("chunk, overlap", [(300, 16), (97, 3)])
def test_token_counts_resynchronise(chunk, overlap, small):
    rows, _ = small
    model, safe = token_counts.load(token_counts.public_tokenizers.path(token_counts.MODEL))
    assert safe
    texts = [r[1] or "" for r in rows[:60]] + ["ab" * 900, "x  y   z" * 200, " " * 900, "日本語" * 200, "▁a ▁b" * 200, "é  " * 200]
    assert [token_counts.count_long(model, t, chunk, overlap) for t in texts] == [len(model.encode(t)) for t in texts]


def test_token_counts_query(small, nothing):
    rows, frame = small
    model, _ = token_counts.load(token_counts.public_tokenizers.path(token_counts.MODEL))
    got = {r.doc_id: r for r in token_counts.token_counts(frame, chunk=500).collect()}
    for doc, text, *_ in rows:
        n = len(model.encode(text or ""))
        assert (got[doc].n_bytes, got[doc].n_tokens, got[doc].over_limit) == (len((text or "").encode()), n, n > 4096)
    assert token_counts.token_counts(nothing).count() == 0


def test_unigram_base(small):
    rows, frame = small
    got = {r.doc_id: r for r in lm_score.scored(frame, frequent=200).collect()}
    words = {r[0]: (r[1] or "").encode().lower().split() for r in rows}
    train = [d for d in words if zlib.crc32(str(d).encode()) % 10]
    c = collections.Counter(w for d in train for w in words[d])
    n, v = sum(c.values()) + len(train), len(c) + 1
    log = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    for d, own in words.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d not in set(train), len(own) + 1, sum(c[w] > 0 for w in own) + 1, n)
        assert r.base_score == pytest.approx(sum(log(c[w]) for w in own) + log(len(train)))
        assert r.score < 0


TEXTS = ["abab abba", "the cat", "Ab\nab", None, "é é x", "cat the the", "unseen q", "日本 語日本", "жук жуки \x00 x"] * 2


def gathered(rows, depth):
    counts = collections.defaultdict(lambda: [0] * 256)
    coded = {i: context_tree.coded((t or "").encode().lower().split()) for i, t in rows}
    for i, b in coded.items():
        if not lm_score.held_out(i):
            for j in range(len(b)):
                past = (b"\xff" * depth + b[:j])[::-1]
                for d in range(depth + 1):
                    counts[past[:d]][b[j]] += 1
    return coded, dict(counts)


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_context_tree_by_the_textbook(spark, monkeypatch, depth):
    for name, value in {"CHUNK": 20, "SLICE": 16, "KEYS_HELD": 30, "WORDS_HELD": 3}.items():
        monkeypatch.setattr(lm_score, name, value)
    rows = list(enumerate(TEXTS))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm_score.scored(frame, depth=depth, buckets=7).collect()}
    coded, counts = gathered(rows, depth)
    for i, b in coded.items():
        assert got[i] == pytest.approx(context_tree.plain_score(b, counts, depth), abs=1e-5)


def test_keys_stop_at_the_closing_byte():
    data = np.frombuffer(b"ab\xffcd ef\xff\xffg\xff", np.uint8)
    own = [np.frombuffer(t + b"\xff", np.uint8) for t in (b"ab", b"cd ef", b"", b"g")]
    for depth in (2, 5, 6):
        assert (context_tree.grams(data, depth) == np.concatenate([context_tree.grams(t, depth) for t in own])).all()


def test_longer_contexts_tell_more(spark):
    """Letters that follow from five before: a model of shorter contexts cannot know them."""
    rnd = random.Random(3)
    follows = {}
    text = list("abcde")
    for _ in range(40_000):
        text.append(follows.setdefault(tuple(text[-5:]), rnd.choice("abcdef")) if rnd.random() < 0.98 else rnd.choice("abcdef"))
    rows = [(i, "".join(text[i * 2000 : i * 2000 + 2000])) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    deep, flat = ({r.doc_id: r.score for r in lm_score.scored(frame, depth=d).collect()} for d in (5, 2))
    assert all(deep[i] > 0.8 * flat[i] for i, _ in rows)


def test_nothing_to_learn(spark, nothing):
    assert lm_score.scored(nothing).count() == 0
    only = spark.createDataFrame([(10, "a b"), (11, None)], "doc_id long, text string").where("crc32(cast(cast(doc_id as string) as binary)) % 10 = 0")
    assert lm_score.scored(only).count() == only.count()


def test_language_id_held_out(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in language_id.predicted(docs).collect()]
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert language_id.predicted(nothing).count() == 0


def test_language_id_odd_texts(small):
    rows, frame = small
    got = {r.doc_id: r for r in language_id.predicted(frame).collect()}
    for doc, text, *_ in rows:
        assert (got[doc].lang_pred == "und") == (not any(ch.isalpha() for ch in text or ""))
    one = language_id.predicted(frame.where("lang = 'en' or lang is null"))
    assert {r.lang_pred for r in one.collect()} == {"en", "und"}


def plain_codes(rows):
    """Weights and trust by loops over dictionaries of counted n-grams."""
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        raw = language_id.letters(text or "")
        for o, n in enumerate(language_id.ORDERS):
            for i in range(len(raw or b"") - n + 1):
                gram = int.from_bytes(raw[i : i + n], "big")
                counts[lang][o, (gram * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - language_id.WIDTH] += 1
    names = sorted(counts)
    words = language_id.code_words(len(names))
    size = 1 << language_id.WIDTH
    total = {(l, o): sum(c for (p, _), c in counts[l].items() if p == o) + 0.5 * size for l in names for o in range(4)}
    rate = lambda l, f: (counts[l][f] + 0.5) / total[l, f[0]]
    weight = {}
    for f in itertools.product(range(4), range(size)):
        r = [rate(l, f) for l in names]
        weight[f] = [
            math.log(sum(x for x, w in zip(r, words[:, j]) if w > 0) / (words[:, j] > 0).sum()) - math.log(sum(x for x, w in zip(r, words[:, j]) if w < 0) / (words[:, j] < 0).sum())
            for j in range(words.shape[1])
        ]
    trust = [max(1e-3, min(sum(rate(l, f) / 4 * w[j] for f, w in weight.items()) * words[i, j] for i, l in enumerate(names))) for j in range(words.shape[1])]
    return names, words, weight, [t / (sum(trust) / len(trust)) for t in trust]


def test_language_codes_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_id, "HELD", 2)
    texts = {"en": "the cat and the dog", "de": "der Hund und die Katze", "fr": "le chien et le chat", "ru": "кошка и собака", "es": "el perro y el gato", "pl": "pies i kot są tu", "x": "zzz qqq"}
    rows = [(i, f"{t} {i % 5} {t[: i % 11]}", l) for i, (l, t) in enumerate(list(texts.items()) * 6)] + [(900, "!!", "never"), (901, None, "en"), (902, "the gato", None), (902, "the gato", None)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    names, words, weight, trust = plain_codes([(t, l) for i, t, l in rows if l and not held(i)])
    assert names == sorted(texts)
    got = language_id.predicted(spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text, _ in rows:
        raw = language_id.letters(text or "")
        if not raw:
            assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
            continue
        margin = [0.0] * words.shape[1]
        for o, n in enumerate(language_id.ORDERS):
            for k in range(len(raw) - n + 1):
                f = o, (int.from_bytes(raw[k : k + n], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - language_id.WIDTH
                margin = [m + w for m, w in zip(margin, weight[f])]
        total = sum(len(raw) - n + 1 for n in language_id.ORDERS) / 4
        loss = [sum(t * math.log1p(math.exp(-m / math.sqrt(total) * w)) for t, m, w in zip(trust, margin, word)) for word in words.tolist()]
        p = [math.exp(min(loss) - x) for x in loss]
        assert by_id[i].lang_pred == names[loss.index(min(loss))] and by_id[i].score == pytest.approx(max(p) / sum(p), abs=1e-4)


def test_more_languages_than_a_short_code(spark):
    rnd = random.Random(1)
    alphabets = ["".join(rnd.sample("abcdefghijklmnopqrstuvwxyz", 6)) for _ in range(150)]
    write = lambda a: " ".join("".join(rnd.choice(a) for _ in range(rnd.randint(2, 8))) for _ in range(60))
    rows = [(i, write(alphabets[i % 150]), f"l{i % 150:03}") for i in range(900)]
    got = language_id.predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: l for i, _, l in rows}
    held = [r for r in got if r.held_out]
    assert len({r.lang_pred for r in got}) > 140 and sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.9 * len(held)


def test_code_words_are_apart():
    for n in (2, 3, 4, 5, 9, 20, 700):
        w = language_id.code_words(n)
        assert len(w) == n and min((w[a] != w[b]).sum() for a, b in itertools.combinations(range(n), 2)) >= max(1, w.shape[1] // 4)


def test_minimum_cut_by_enumeration():
    rnd = random.Random(1)
    for _ in range(150):
        n = rnd.randint(1, 8)
        c, b = [rnd.random() * 3 for _ in range(n)], [rnd.random() * 3 for _ in range(n)]
        ties = [(i, j, rnd.random()) for i in range(n) for j in range(i) if rnd.random() < 0.5]
        cost = lambda l: sum(c[i] if l[i] else b[i] for i in range(n)) + sum(w for i, j, w in ties if l[i] != l[j])
        assert cost(html_extraction.minimum_cut(c, b, ties)) == pytest.approx(min(map(cost, itertools.product([0, 1], repeat=n))))


PAGE = """<html><body class="with-sidebar"><header class="site-header"><h1>Site name</h1><ul><li><a href=/>Home</a></li></ul></header>
<div class="cookie-notice">We use cookies to make this site better. Please accept them all.</div><div id="wrapper"><div class="sidebar"><p>Some long text in
the sidebar that goes on and on, with sentences. And more.</p></div><main><article><header><h1>Title</h1></header><p>First   para with <a href="x">a link</a>,
and text &amp; more.</p><div class="ad">Buy our things now, they are great. Really great.</div><ul><li>short one</li></ul><p>Ok.<form>Subscribe now: <input></form>
<section class="comments"><p>I think this is a wonderful article, thanks a lot for writing this.</p></section></article></main></div>
<script>var x = "<p>no</p>"</script><footer>Footer text that is long enough to be a sentence.</footer>"""


def test_html(spark):
    assert html_extraction.main_text(PAGE) == "Title\nFirst para with a link, and text & more.\nshort one\nOk."
    odd = [None, "", "<p>", "<a href='", "<!-- x", "no markup but a full sentence of words here.", "&lt;p&gt;", "<div" * 2000]
    frame = spark.createDataFrame([(i, None, h, "x") for i, h in enumerate(odd)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extraction.extracted(frame).collect()}
    assert got[0].text == "" and got[0].n_chars == 0 and got[5].text == odd[5] and len(got) == len(odd)
    assert html_extraction.extracted(frame.limit(0)).count() == 0


LONG = "This is a long paragraph of an article, with many words in it, and it goes on for a while. " * 6
ART = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
WANT = "\n".join(["Title", LONG.strip(), LONG.strip()])
WRAPPERS = ["layout no-sidebar", "row search-results", "page with-sidebar", "grid has-comments", "wrap ad-free", "container social", "modal-open", "sidebar", "newsletter-page"]


@pytest.mark.parametrize("name", WRAPPERS)
def test_no_article_is_lost_under_a_name(name):
    for inner in (ART, f"<article>{ART}</article>", f"<main>{ART}</main>"):
        page = f'<body><nav><a href=/>Home</a></nav><div class="{name}">{inner}</div><footer>Copyright, all rights reserved.</footer></body>'
        assert html_extraction.main_text(page) == WANT


def test_no_article_is_lost_in_a_form():
    page = f'<body><form id="all" action="/"><div class="header"><a href="/">Home</a></div>{ART}<div class="comments"><p>{LONG}</p></div></form></body>'
    assert html_extraction.main_text(page) == WANT


GERMAN = """<!doctype html><html lang=de><body class="home mit-seitenleiste"><div id=topbar class="top-nav"><ul><li><a href=/>Start</a><li><a href=/k>Kontakt</a></ul></div>
<div class="content-area"><h1>Der Fluß und die Stadt</h1><p class=lead>Seit Jahrhunderten fließt der Strom durch das Tal, und die Menschen leben mit ihm.</p>
<div class="werbung"><p>Jetzt kaufen! Nur heute alles um die Hälfte billiger, solange der Vorrat reicht.</p></div><h2>Hochwasser</h2><p>Im Frühjahr steigt das Wasser &ndash; manchmal
bis an die Türen der Häuser.</p><table><tr><td>Pegel</td><td>3,2 m</td></tr></table></div><div class="kommentare"><h3>2 Kommentare</h3><p>Sehr schöner Artikel, vielen Dank dafür, weiter so!</p></div>
<div class=footer>Impressum und Datenschutz. Alle Rechte vorbehalten.</div></body></html>"""
SPANISH = """<html><body><div class="cookie-banner">Usamos cookies para mejorar la experiencia de todos los lectores. Acepte, por favor.</div><header><a href="/">Diario</a></header>
<section><h1>La ciudad que no duerme</h1><p>Cada noche, cuando las tiendas cierran, empieza otra vida en las calles del centro.</p><ul><li>Bares que abren tarde</li><li>Mercados de madrugada</li></ul>
<p>Los vecinos se quejan del ruido, pero tambi&eacute;n lo echan de menos.</p></section><aside><h2>M&aacute;s le&iacute;das</h2><p><a href=1>Otra noticia del d&iacute;a que interesa</a></p></aside>
<form action=/s><label>Suscr&iacute;base a nuestro bolet&iacute;n de noticias.</label><input></form><script>var a = 1;</script></body></html>"""


def test_pages_labelled_by_hand():
    assert html_extraction.main_text(GERMAN).split("\n") == [
        "Der Fluß und die Stadt",
        "Seit Jahrhunderten fließt der Strom durch das Tal, und die Menschen leben mit ihm.",
        "Hochwasser",
        "Im Frühjahr steigt das Wasser – manchmal bis an die Türen der Häuser.",
        "Pegel 3,2 m",
    ]
    assert html_extraction.main_text(SPANISH).split("\n") == [
        "La ciudad que no duerme",
        "Cada noche, cuando las tiendas cierran, empieza otra vida en las calles del centro.",
        "Bares que abren tarde",
        "Mercados de madrugada",
        "Los vecinos se quejan del ruido, pero también lo echan de menos.",
    ]


def test_remarks_and_bars_stay_out():
    short = "The article itself is short, but it is the article and has its own sentences."
    remarks = f'<section id="comments"><h2>12 comments</h2>{f"<p>{LONG}</p>" * 12}</section>'
    assert html_extraction.main_text(f"<body><article><h1>Short</h1><p>{short}</p></article>{remarks}</body>") == f"Short\n{short}"
    assert html_extraction.main_text('<body><nav><a href=/>Home</a></nav><div class="ad">Buy our things now, they are great.</div></body>') == ""
    cards = "".join(f'<article><h3>Card {i}</h3><p>{LONG}</p></article>' for i in range(3))
    assert html_extraction.main_text(f"<body><article>{ART}</article><aside>{cards}</aside></body>") == WANT


@pytest.mark.parametrize("page", ["<div></b>", "<div class=sidebar>x ", "</p><p>", "<li><ul>", "<a href=x><div></div>", "<span></i>"])
def test_broken_nesting_takes_linear_time(page):
    import time

    took = []
    for n in (3_000, 24_000):
        began = time.perf_counter()
        html_extraction.main_text("<b>" + page * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_extraction_of_repeated_and_clashing_rows(spark):
    rows = [(1, "u", PAGE, "t", 5), (1, "u", PAGE, None, 6), (None, None, None, "t", 7)]
    got = html_extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert sorted(r.n_chars for r in got) == [0, 60, 60] and got[0].text.startswith("Title")


def test_pages_of_the_table(spark, data):
    for r in html_extraction.extracted(spark.read.parquet(f"{data}/pages.parquet")).collect():
        assert r.n_chars == len(r.text) and r.n_chars > 0


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def junk(rnd, n):
    return " ".join(rnd.choice(["$$$|||", "###%%%", "&&&***"]) + str(rnd.randint(0, 10**6)) for _ in range(n))


def test_small_sources_borrow_from_their_whole_language(spark):
    rnd = random.Random(4)
    rows = [(i, words(rnd, 120), "en", "A") for i in range(400)] + [(1000 + i, junk(rnd, 120), "en", "J") for i in range(20)]
    rows += [(2000 + i, words(rnd, 120), "en", "K") for i in range(3)] + [(3000 + i, words(rnd, 120), "xx", "L") for i in range(2)] + [(4000, junk(rnd, 90), "yy", "M")]
    got = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i] for i in got if 1000 <= i < 2000 or i == 4000)
    assert sum(got[i] for i in range(400)) >= 398 and all(got[i] for i in got if 2000 <= i < 4000)


def mcd(y, starts, share, floors):
    """The least determinant over many starts by exact concentration steps on the nearest rows."""
    h = math.ceil(share * len(y))
    best = None
    for m, s in starts:
        for _ in range(50):
            d = np.einsum("ij,jk,ik->i", y - m, np.linalg.inv(s), y - m)
            near = y[np.argsort(d, kind="stable")[:h]]
            m, s = near.mean(0), quality_rules.CONSISTENCY * np.cov(near.T, bias=True) + np.diag(floors)
        det = np.linalg.slogdet(s)[1]
        if best is None or det < best[0]:
            best = det, m, s
    return best


def test_minimum_covariance_determinant_in_numpy(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(600):
        text = words(rnd, rnd.randint(60, 200))
        if i % 4 == 0:
            text = junk(rnd, rnd.randint(1, 30)) + " " + text
        if i % 7 == 0:
            text += "\n" + "\n".join(["one line that repeats itself"] * rnd.randint(2, 9))
        rows.append((i, text, "en", "s"))
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    good = [r for r in got.values() if not r.base_failed]
    lines = {i: len([l for l in t.split("\n") if l.strip()]) for i, t, *_ in rows}
    y = np.array([[math.log(r.word_chars / r.n_words + 0.01), math.log(1 + 10 * r.n_symbols / r.n_words), math.sqrt(r.n_dup_lines / lines[r.doc_id]), math.sqrt(r.n_repeat_words / r.n_words)] for r in good])
    floors = np.square(quality_rules.FLOORS)
    rng = np.random.default_rng(0)
    starts = [(np.median(y, 0), np.diag(floors)), (y.mean(0), np.cov(y.T) + np.diag(floors))]
    for _ in range(200):
        some = y[rng.choice(len(y), 12, replace=False)]
        starts.append((some.mean(0), np.cov(some.T) + np.diag(floors)))
    _, m, s = mcd(y, starts, quality_rules.SHARE, floors)
    d = np.einsum("ij,jk,ik->i", y - m, np.linalg.inv(s), y - m)
    want = d <= quality_rules.CUTOFF
    clear = np.abs(np.log(d / quality_rules.CUTOFF)) > 0.15
    kept = np.array([r.kept for r in good])
    assert (kept == want)[clear].all() and clear.mean() > 0.9 and 0.02 < (~want).mean()


def test_a_very_long_text_is_counted_whole(spark):
    rnd = random.Random(2)
    own = [str(rnd.randint(0, 10**9)) for _ in range(300_000)]
    own[250_000:250_005] = own[10:15]
    frame = spark.createDataFrame([(1, " ".join(own), "en", "s"), (1, " ".join(own), None, None)], "doc_id long, text string, lang string, source string")
    assert {(r.n_words, r.n_repeat_words) for r in quality_rules.judged(frame).collect()} == {(300_000, 10)}
