import re

import numpy as np
import pyarrow.parquet as pq
import xxhash

from parallax.llm import common, queries, simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, ids, most):
    """Smallest id reachable from each row, by brute force."""
    fps = np.array(fps, dtype=np.uint64)
    near = np.array([np.bitwise_count(fps ^ f) <= most for f in fps])
    label = np.array(ids)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label.tolist()
        label = new


def clumps(seed, size, centres):
    """Fingerprints around few centres, with chains of small steps."""
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 1 << 63, centres, dtype=np.uint64)]
    while len(out) < size:
        out.append(out[rng.integers(len(out))] ^ 1 << int(rng.integers(64)) ^ (1 << int(rng.integers(64)) if rng.random() < 0.7 else 0))
    return out


def test_fingerprints_equal_brute_force(sf):
    texts = [*pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist(), None, "", "one", "Two WORDS", "ÄÖ a b\x0bc\x85d"]
    for text in texts:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_index_finds_all_links():
    for seed, size in ((1, 5), (2, 90), (3, 1500)):
        fps = np.unique(np.array(clumps(seed, size, 3), dtype=np.uint64))
        fps = fps[np.argsort(simhash.gray_rank(fps))]
        for most in (0, 2, 4):
            found = {(int(a), int(b)) for x, y in simhash.GrayIndex(fps).links(most) for a, b in zip(x, y, strict=True)}
            assert found == {(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= most).tolist() if i < j}


def test_components_equal_brute_force_also_when_patterns_are_refined(spark):
    fps = clumps(11, 700, 4) + [0, 0, (1 << 64) - 1]
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fps)], "fp long")
    for limit in (simhash.MAX_GROUP, 20):
        roots = {r.node: r.root for r in simhash.components(simhash.edges(frame, 2, limit)).collect()}
        names = [f - (1 << 64) if f >> 63 else f for f in fps]
        assert [roots.get(x, x) for x in names] == slow_components(fps, names, 2)


def test_any_number_of_spare_parts_finds_the_same(spark):
    fps = clumps(12, 400, 3)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fps)], "fp long")
    names = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = slow_components(fps, names, 5)
    for spare in (1, 2):
        roots = {r.node: r.root for r in simhash.components(simhash.edges(frame, 5, spare=spare)).collect()}
        assert [roots.get(x, x) for x in names] == want
    assert [simhash.spare_parts(n, 5) for n in (0, 10**6, 10**7, 10**9)] == [1, 1, 2, 3]


def test_long_chain(spark):
    chain = [(i + 1, i) for i in range(300)]
    for few in (simhash.FEW_EDGES, 10):
        roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "u long, v long"), few).collect()}
        assert roots == {i: 0 for i in range(1, 301)}


def test_query(spark, sf):
    table = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    fps = [slow_fingerprint(t) for t in table["text"]]
    want = dict(zip(table["doc_id"], zip(map("{:016x}".format, fps), slow_components(fps, table["doc_id"], 2), strict=True), strict=True))
    rows = queries.op9_simhash_near_dups(spark, sf).collect()
    assert len(rows) == len(want) and {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want
    assert any(r.doc_id != r.component_id for r in rows)


def test_edges(docs, empty):
    rows = simhash.near_dups(docs).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert len(rows) == docs.count()
    assert found[1] == found[2] and {c for _, c in found[2]} == {1}
    assert found[3] == found[4] == found[5] == {(0, 3)}
    assert simhash.near_dups(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 6, 7]
    assert simhash.keep_one(empty).count() == 0


def jaccard(a, b, k=5):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def copies(seed, n, edits):
    """A text and near copies of it with so many words replaced, and as many other texts."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choice(words, 400).tolist()
    out = [" ".join(base)]
    for k in range(n):
        own = list(base)
        for at in rng.integers(0, 400, edits):
            own[at] = f"x{k}"
        out.append(" ".join(own))
    return out + [" ".join(rng.choice(words, 400)) for _ in range(n)]


def test_masks_cover_all_differences():
    import random

    rng = random.Random(1)
    for most, spare in ((2, 1), (5, 2)):
        cover = simhash.masks(most, spare)
        for _ in range(300):
            gap = sum(1 << b for b in rng.sample(range(64), most))
            assert any(gap & m == 0 for m in cover)


def test_similar_docs(spark):
    texts = copies(5, 40, 3)
    ids = list(range(len(texts)))
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    for limit in (simhash.MAX_GROUP, 10):
        found = {r.doc_id: r.component_id for r in simhash.similar_docs(frame, max_group=limit, max_bucket=limit).collect()}
        assert all(found[i] == 0 for i in ids[:41] if jaccard(texts[0], texts[i]) >= 0.8)
        assert all(found[i] == i for i in ids[41:])
    kept = {r.doc_id for r in simhash.keep_one(frame).collect()}
    assert kept == {i for i, c in found.items() if i == c}


def test_similarity():
    texts = [*copies(6, 4, 2), "a b c", "A b  c", "", None, "a b c d e f g h i j", "a b c d e f g h i k"]
    for a in texts:
        for b in texts:
            assert simhash.similarity(simhash.shingle_set(a), simhash.shingle_set(b)) == (jaccard(a, b) if (a or "").split() or (b or "").split() else 1.0) or not ((a or "").split() and (b or "").split())
    assert simhash.similarity(simhash.shingle_set(""), simhash.shingle_set("a")) == 0.0


def test_replaced_links_are_a_forest():
    rng = np.random.default_rng(9)
    for _ in range(20):
        n = 30
        a, b = rng.integers(0, n, 80), rng.integers(0, n, 80)
        chosen = simhash._forest_of(n, a, b)
        want, found = (simhash._forest(n, iter([(x, y)])) for x, y in ((a, b), (a[chosen], b[chosen])))
        assert (want == found).all() and len(chosen) == n - len(set(want.tolist()))


def brute_components(texts, least=0.8):
    """Smallest position reachable over pairs that are similar enough, by brute force."""
    near = [[j for j, y in enumerate(texts) if jaccard(x, y) >= least] for x in texts]
    label = list(range(len(texts)))
    while True:
        new = [min(label[j] for j in own) for own in near]
        if new == label:
            return label
        label = new


def orders(seed, n, words=200, moved=10):
    """n orders of the same words, and a near copy of each."""
    rng = np.random.default_rng(seed)
    first = [rng.permutation([f"w{i}" for i in range(words)]).tolist() for _ in range(n)]
    return [" ".join(x) for x in [*first, *(x[moved:] + x[:moved] for x in first)]]


def templates(seed, n, shared=300, own=100, words=3000):
    """n texts that share most words but are not similar, and a near copy of every third."""
    rng = np.random.default_rng(seed)
    frame = rng.integers(0, words, shared).tolist()
    first = [[f"w{i}" for i in frame] + [f"d{k}_{i}" for i in range(own)] for k in range(n)]
    return [" ".join(x) for x in [*first, *(x[5:] + [f"e{k}"] for k, x in enumerate(first) if k % 3 == 0)]]


def test_links_do_not_depend_on_how_many_share_a_bucket_or_a_batch(spark, monkeypatch):
    for texts in (orders(7, 30), templates(8, 45)):
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        want = brute_components(texts)
        assert 0 < sum(i != c for i, c in enumerate(want)) < len(texts) - 1
        for limit, rows in ((simhash.MAX_GROUP, 1024), (5, 3)):
            monkeypatch.setattr(common, "BATCH_ROWS", rows)
            spark.conf.unset(common.BATCH_SETTING)
            assert [r.component_id for r in simhash.similar_docs(frame, max_group=limit, max_bucket=limit).orderBy("doc_id").collect()] == want
    spark.conf.unset(common.BATCH_SETTING)


def blocks(seed, n, words, likeness):
    """Pairs of a text and the same with a block of new words added, or cut off, whose similarity is just above `likeness`."""
    rng = np.random.default_rng(seed)
    for k in range(n):
        whole = [f"w{x}" for x in rng.integers(0, 1 << 40, words)]
        keep = int(np.ceil(likeness * (words - 4))) + 4
        at = [0, keep // 2, keep][k % 3]
        block = [f"n{x}" for x in rng.integers(0, 1 << 40, words - keep)]
        yield (" ".join(whole[:keep]), " ".join(whole)) if k % 2 else (" ".join(whole[:keep]), " ".join(whole[:at] + block + whole[at:keep]))


def test_recall_of_added_and_cut_blocks():
    for likeness in (0.8, 0.83, 0.87, 0.9):
        pairs = [(a, b) for words in (100, 400) for a, b in blocks(3, 150, words, likeness)]
        alike = [(a, b) for a, b in pairs if jaccard(a, b) >= 0.8]
        found = sum(any(x == y for x, y in zip(*(simhash.sketch(simhash.shingle_set(t)) for t in pair), strict=True)) for pair in alike)
        assert len(alike) >= 140 and found >= 0.98 * len(alike)


def test_added_and_cut_blocks_are_linked(spark):
    texts = [t for likeness in (0.82, 0.9) for pair in blocks(4, 30, 100, likeness) for t in pair]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components(texts)
    found = [r.component_id for r in simhash.similar_docs(frame).orderBy("doc_id").collect()]
    assert sum(a == b for a, b in zip(found, want, strict=True)) >= 0.98 * len(want) and sum(i != c for i, c in enumerate(want)) >= 40


def test_class_counts_never_rule_out_a_link():
    texts = [*copies(10, 20, 6), *orders(11, 6), "", "a b", " ".join(f"w{i}" for i in range(90_000))]
    sets = [simhash.shingle_set(t) for t in texts]
    counts = np.array([simhash.class_counts(s) for s in sets])
    for i, x in enumerate(sets):
        bound = simhash.most_shared(np.repeat(counts[i : i + 1], len(sets), axis=0), counts)
        assert all(len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"))) <= b for y, b in zip(sets, bound, strict=True))
