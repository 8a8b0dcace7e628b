import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strandloom.llm import anchors, buckets, cap_filters, components, simhash_dedup, suffix_dedup

WIDTH = 200


def repeated(rows):
    seen = collections.Counter()
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        seen.update(b[i : i + WIDTH] for i in range(len(b) - WIDTH + 1))
    out = {}
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - WIDTH + 1):
            if seen[b[i : i + WIDTH]] > 1:
                gone[i : i + WIDTH] = b"\1" * WIDTH
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_windows_by_brute_force(small, hot):
    rows, frame = small
    want = repeated([r[:2] for r in rows])
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.digests(frame, hot_runs=hot).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 10_000


def test_suffix_windows_of_few_different_bytes(spark):
    """Runs that repeat inside a text are one row each, whatever the text: blanks, short periods, periods with a flaw."""
    rnd = random.Random(3)
    rows = [(1, "\0" * 3000), (2, " " * 900 + "x" + " " * 900), (3, "abc" * 700), (4, "abc" * 300 + "abd" + "abc" * 300), (5, "".join(rnd.choice("ab") for _ in range(3000)))]
    rows += [(6, "x" + "\0" * 199), (7, "y" + "\0" * 200 + "z"), (8, ("0123456789" * 13 + "q") * 9), (9, "0123456789" * 20)]
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == repeated(rows)
    for text in ("\0" * 100_000, " " * 100_000, "abc" * 33_000):
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": [text]})
        assert sum(b.num_rows for b in suffix_dedup._runs(200, 64)(iter([batch]))) < len(text) / 50


def test_suffix_windows_across_chunks(small, monkeypatch):
    from strandloom.llm import suffix_bytes

    rows, _ = small
    text = " ".join(t for _, t, *_ in rows if t)[:60_000].encode()
    whole = suffix_bytes.window_runs(text, 200, 64)
    monkeypatch.setattr(suffix_bytes, "CHUNK", 1000)
    parts = suffix_bytes.window_runs(text, 200, 64)
    spread = lambda runs: np.repeat(runs[2], runs[1])
    assert len(parts[0]) > len(whole[0]) and (spread(parts) == spread(whole)).all()


def test_suffix_rows_with_one_id(spark):
    """Rows with one id and different texts are documents of their own; repeated rows are copies."""
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    a, b, c = text(900), text(700), text(300)
    rows = [(1, a), (1, b), (1, a[:400]), (2, c), (2, c), (3, b[100:500]), (None, a[300:800]), (None, None), (1, None)]
    got = collections.Counter(tuple(r) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    want = repeated(list(enumerate(t for _, t in rows)))
    assert got == collections.Counter((rows[i][0], *v) for i, v in want.items())


def test_suffix_texts_keep_columns_and_characters(small, nothing):
    rows, frame = small
    out = suffix_dedup.deduplicated(frame)
    assert out.columns == frame.columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and got[10_000].text is None and all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)
    whole = {r[0]: r[1] for r in rows}
    same = [d for d, v in repeated([r[:2] for r in rows]).items() if not v[1]]
    assert all(got[d].text == whole[d] for d in same)
    assert suffix_dedup.digests(nothing).count() == 0 and suffix_dedup.deduplicated(nothing).count() == 0


def test_characters_go_whole():
    raw = "aéb".encode()
    assert suffix_dedup.kept_text(raw, [(2, 3)]) == "aéb" and suffix_dedup.kept_text(raw, [(1, 3)]) == "ab" and suffix_dedup.kept_text(raw, [(0, 2)]) == "éb"


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("layout, bucket", [(None, 1 << 14), (anchors.WIDE, 9), (anchors.MIDDLE, 1 << 14), (anchors.MIDDLE, 9), (anchors.DEEP, 1 << 14)])
def test_simhash_by_brute_force(small, layout, bucket):
    rows, frame = small
    fp = {r[0]: fingerprint(r[1]) for r in rows}
    ids = sorted(fp)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fp[a] ^ fp[b]).bit_count() <= 4]
    label = smallest(links, ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(frame, layout=layout, bucket=bucket).collect()}
    assert got == {d: (f"{fp[d]:016x}", label[d]) for d in ids}


def test_simhash_edges(small, nothing):
    rows, frame = small
    out = simhash_dedup.deduplicated(frame)
    assert out.columns == frame.columns and out.count() < len(rows)
    assert simhash_dedup.near_duplicates(nothing).count() == 0
    with pytest.raises(ValueError):
        simhash_dedup.near_duplicates(frame, layout=((0, 0, 0, 64, 1),))


def test_golay_covers_everything():
    words = np.random.default_rng(0).integers(0, 1 << 23, 5000, dtype=np.uint64)
    home = anchors.golay_anchor(words)
    assert (np.bitwise_count(words ^ home) <= 3).all() and (anchors.golay_anchor(home) == home).all()


def test_hamming_covers_everything():
    words = np.arange(1 << 15, dtype=np.uint64)
    home = anchors.hamming_anchor(words)
    assert (np.bitwise_count(words ^ home) <= 1).all() and (anchors.hamming_anchor(home) == home).all() and len(np.unique(home)) == 1 << 11


def test_comparisons_grow_about_as_the_fingerprints_do():
    """Homes met by replicas, over fingerprints at random: a hundred times the fingerprints cost no more than some hundred times as much."""
    rng = np.random.default_rng(3)
    cost = {}
    for n in (10_000, 1_000_000):
        fp = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        layout = anchors.layout_for(n)
        asked = fp[rng.choice(n, 400)]
        met = 0
        for (_, home, _), (_, _, around) in zip(anchors.replicas(fp, tuple((*b[:4], 0) for b in layout)), anchors.replicas(asked, layout)):
            found, count = np.unique(home, return_counts=True)
            around = np.sort(around, 1)
            fresh = np.concatenate((np.ones((len(around), 1), bool), around[:, 1:] != around[:, :-1]), 1)
            wanted = around[fresh]
            at = np.minimum(np.searchsorted(found, wanted), len(found) - 1)
            met += int(count[at][found[at] == wanted].sum()) + len(wanted)
        cost[n] = met / 400
    print(cost)
    assert cost[1_000_000] < 4 * cost[10_000]


def test_anchors_meet_for_every_close_pair():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for k in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)
    for layout in (anchors.WIDE, anchors.MIDDLE, anchors.DEEP):
        met = np.zeros(400, bool)
        for (_, home, _), (_, _, around) in zip(anchors.replicas(a, layout), anchors.replicas(b, layout)):
            met |= (around == home[:, None]).any(1)
        assert met.all()


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    want = smallest(links, {x for p in links for x in p})
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components.components(frame).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert components.components(frame.limit(0)).count() == 0


def test_dealt_buckets_meet_each_pair_once(spark):
    frame = spark.createDataFrame([(k, i) for k, n in ((1, 40), (2, 3)) for i in range(n)], "k long, i long")
    groups = collections.defaultdict(list)
    for r in buckets.dealt(frame, "k", "i", 10).collect():
        groups[r.k, r.pair].append((r.i, r.part))
    pairs = collections.Counter()
    for (k, _), members in groups.items():
        parts = {p for _, p in members}
        pairs.update((k, *sorted((a, b))) for n, (a, p) in enumerate(members) for b, q in members[:n] if p != q or len(parts) == 1)
    assert len(pairs) == 40 * 39 // 2 + 3 and set(pairs.values()) == {1}


def vectors(rng):
    base = rng.normal(size=(600, 64))
    out = [x.tolist() for x in base]
    for j in range(300):
        x = base[j % 20] / np.linalg.norm(base[j % 20])
        g = rng.normal(size=64)
        g -= g @ x * x
        c = rng.uniform(0.85, 0.99)
        out.append((c * x + np.sqrt(1 - c * c) * g / np.linalg.norm(g)).tolist())
    return out + [out[3], out[3], (2 * np.array(out[5])).tolist()]


@pytest.mark.parametrize("n", [10_000, 51_282, 1_000_000, 20_000_000])
def test_cap_filters_find_threshold_pairs_at_every_size(n):
    rng = np.random.default_rng(5)
    x = cap_filters.units(rng.normal(size=(600, 64)))
    g = rng.normal(size=(600, 64))
    g = cap_filters.units(g - (g * x).sum(1, keepdims=True) * x)
    one, two = (r << 40 | f for r, f in (cap_filters.list_decode(v, n) for v in (x, 0.9 * x + np.sqrt(0.19) * g)))
    found = len(np.unique(np.intersect1d(one, two) >> 40)) / 600
    print(n, found)
    assert found >= 0.92


@pytest.mark.parametrize("dim", [16, 20, 33])
def test_cap_filters_of_few_dimensions(dim):
    rng = np.random.default_rng(5)
    x = cap_filters.units(rng.normal(size=(400, dim)))
    g = rng.normal(size=(400, dim))
    g = cap_filters.units(g - (g * x).sum(1, keepdims=True) * x)
    one, two = (r << 40 | f for r, f in (cap_filters.list_decode(v, 5000) for v in (x, 0.9 * x + np.sqrt(0.19) * g)))
    assert len(np.unique(np.intersect1d(one, two) >> 40)) / 400 >= 0.92


@pytest.mark.parametrize("bucket", [cap_filters.BUCKET, 20])
def test_cap_filters_against_all_pairs(spark, bucket):
    good = vectors(np.random.default_rng(0))
    bad = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0]]
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(good + bad)], "vec_id long, embedding array<float>, rep string").repartition(4)
    got = {r.vec_id: r for r in cap_filters.near_duplicates(frame, bucket=bucket).collect()}
    unit = cap_filters.units(np.array(good, np.float32).astype(float))
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(1)
    assert len(got) == len(good) + len(bad)
    assert all(got[i].n_links <= want[i] for i in range(len(good)))
    assert sum(got[i].n_links for i in range(len(good))) >= 0.97 * want.sum()
    assert all(got[len(good) + k].n_links == 0 and got[len(good) + k].kept for k in range(len(bad)))
    assert got[3].component_id == got[len(good) - 2].component_id == got[len(good) - 3].component_id
    assert cap_filters.near_duplicates(frame.limit(0)).count() == 0
