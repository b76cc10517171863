import numpy as np
import pyarrow as pa

from plainword.llm import decontam


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def bench(spark, items):
    return spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def leak(item, text, weight):
    """The rule by its definition: every region that begins at a word of the item."""
    n, half = len(item), (len(item) + 1) // 2
    region, tail = n + n // 2 + 16, item[-min(8, max(1, n // 3)) :]
    total = sum(weight(w) for w in item)
    for i, w in enumerate(text):
        if w not in item:
            continue
        part = text[i : i + region]
        if sum(min(part.count(x), item.count(x)) * weight(x) for x in {*item}) < 0.5 * total - 1e-9:
            continue
        share = (lcs(item[:half], part) + lcs(item[half:], part)) / n
        if share >= 0.8 or share >= 0.5 and lcs(tail, part) / len(tail) >= 0.37:
            return True
    return False


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    chance = 1 / np.arange(3, len(vocabulary) + 3)
    w = lambda n: rng.choice(vocabulary, n, p=chance / chance.sum()).tolist()
    items = [w(int(rng.integers(8, 64))) for _ in range(400)]
    texts = []
    for k in range(100):
        held = [x if rng.random() < (0.45, 0.55, 0.65, 0.8)[k % 4] else y for x, y in zip(items[k], w(len(items[k])))]
        if k % 3 == 0:
            held = held[len(held) // 2 :] + held[: len(held) // 2]
        texts.append(w(int(rng.integers(0, 90))) + held + w(int(rng.integers(0, 90))))
    ((r, last),) = decontam.retrievers(rows(spark, [" ".join(t) for t in texts]), bench(spark, [" ".join(t) for t in items]))
    assert last
    weight = {x: float(np.log((1 + len(texts)) / (1 + sum(decontam.term(x) in {decontam.term(y) for y in t} for t in texts)))) + 0.05 for t in items for x in t}
    found = [{x[0] for x in some} for some in r.find(pa.array([" ".join(t) for t in texts]))]
    want = [{k for k in range(0, 400, 7) if leak(items[k], t, weight.get)} | ({j} if leak(items[j], t, weight.get) else set()) for j, t in enumerate(texts)]
    assert 40 < sum(j in x for j, x in enumerate(want)) < 95
    assert [{k for k in f if k % 7 == 0 or k == j} for j, f in enumerate(found)] == want


def test_paraphrases_are_found(spark):
    rng = np.random.default_rng(6)
    w = lambda n: ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n)]
    items = [w(int(rng.integers(20, 60))) for _ in range(60)]
    changed = {
        "exact": lambda t: t,
        "a third replaced": lambda t: [x if rng.random() > 0.35 else "zzzz" for x in t],
        "a quarter left out": lambda t: [x for x in t if rng.random() > 0.25],
        "halves swapped": lambda t: t[len(t) // 2 :] + t[: len(t) // 2],
    }
    for name, change in changed.items():
        texts = [" ".join(w(40) + change(t) + w(30)) for t in items] + [" ".join(w(100)) for _ in items]
        found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(rows(spark, texts), bench(spark, [" ".join(t) for t in items])).collect()}
        assert all(d == i for d, i in found) and len(found) >= 0.9 * len(items), name


def test_short_and_long_items_and_blocks(spark):
    rng = np.random.default_rng(7)
    w = lambda n: " ".join("".join(rng.choice(list("klmnopqrst"), 5)) for _ in range(n))
    long = w(150)
    end, middle = " ".join(long.split()[-64:]), " ".join(long.split()[64:128])
    items = ["one small item", "word", long, w(12), None, "", "one small item"]
    texts = [f"{w(9)} One small, item! {w(4)}", "one small other item", f"{w(5)} (word) {w(3)}", f"{w(30)} {end}", f"{middle} {w(30)}", w(50), None, "", f"{w(30000)} {items[3]} {w(100)}"]
    want = {(0, 0), (0, 6), (2, 1), (3, 2), (4, 2), (8, 3)}
    for items_a_block in (2000, 2):
        found = decontam.find_leaks(rows(spark, texts), bench(spark, items), items=items_a_block)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want
        kept = decontam.without_leaks(rows(spark, texts), bench(spark, items), items=items_a_block)
        assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 7]


def test_odd_rows(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = spark.createDataFrame([(1, text, "a", 1), (1, text, "b", 2), (None, text, "c", 3), (2, None, None, None)], "doc_id long, text string, item_id string, cosine long")
    b = spark.createDataFrame([("x", text, 1), (None, text.upper(), 2), ("n", None, 3)], "item_id string, text string, doc_id int")
    assert sorted((str(r.doc_id), str(r.item_id)) for r in decontam.find_leaks(df, b).collect()) == [("1", "None"), ("1", "x"), ("None", "None"), ("None", "x")]
    kept = decontam.without_leaks(df, b)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(2, None, None, None)]
    for x, y in ((df.limit(0), b), (df, b.limit(0))):
        assert decontam.find_leaks(x, y).count() == 0
        assert decontam.without_leaks(x, y).count() == x.count()


def test_every_document_shapes_the_basis(spark):
    rng = np.random.default_rng(3)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(50)]
    leaks = [[topics[40 + k][j] if j in (2, 5, 7) else x for j, x in enumerate(topics[k])] for k in range(8)]
    texts = [rng.permutation(topics[i % 40]).tolist() for i in range(6960)] + topics[40:] + leaks  # fewer than DIMENSIONS unlike rows, some of them once
    docs, items = rows(spark, [" ".join(t) for t in texts]), bench(spark, [" ".join(t) for t in topics[:40]])
    ((r, _),) = decontam.retrievers(docs, items)
    idf = np.sqrt(r.padded_energy[:-1])
    basis = r.padded[:-1] / idf[:, None]

    def vector(t):
        v = np.zeros(decontam.TERMS)
        for x in t:
            v[decontam.term(x)] += idf[decontam.term(x)]
        return v / np.linalg.norm(v)

    assert min(np.linalg.norm(vector(t) @ basis) for t in topics + leaks) > 0.99
    found = {r.doc_id: r for r in decontam.find_leaks(docs, items).collect() if r.doc_id >= 6970}
    for k, t in enumerate(leaks):  # the space holds all rows, so the cosine is that of the whole vectors
        assert found[6970 + k].item_id == k and abs(found[6970 + k].cosine - vector(t) @ vector(topics[k])) < 0.01


def test_every_word_shapes_the_basis(spark):
    ends = [[f"e{k}w{j}" for j in range(8)] for k in range(20)]
    texts = [[f"t{k}w{j}" for j in range(32)] + end for k, end in enumerate(ends)]
    ((r, _),) = decontam.retrievers(rows(spark, [" ".join(t) for t in texts]), bench(spark, [" ".join(texts[0][:12])]))
    assert min(np.linalg.norm(r.padded[decontam.term(x)]) for end in ends for x in end) > 0.1


def test_products_equal_dense_ones(spark):
    rng = np.random.default_rng(4)
    chance = 1 / np.arange(1, 401)
    texts = [rng.choice(400, int(n), p=chance / chance.sum()) for n in (*rng.integers(0, 400, 300), 0, 1, 32, 33, 64, 65)] + [np.full(70, 5)]
    passages, many = decontam._passages(np.concatenate(texts).astype(np.uint16), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    assert many.tolist() == [-(-len(t) // 32) for t in texts]
    first = np.concatenate(([0], np.cumsum(many)))
    for t, a, b in zip(texts, first, first[1:]):
        own = passages[a:b]
        assert sorted(own[own < decontam.TERMS].tolist()) == sorted(t.tolist())
    idf = rng.random(decontam.TERMS).astype(np.float32) + 0.5
    x = rng.standard_normal((decontam.TERMS, 5)).astype(np.float32)
    dense = np.array([np.bincount(p, minlength=decontam.TERMS + 1)[:400] * idf[:400] for p in passages])
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    total = np.zeros((decontam.TERMS + 1, 5), np.float32)
    decontam._gram_passages(passages, np.append(x * idf[:, None], np.zeros_like(x[:1]), 0), np.append(idf**2, np.float32(0)), total)
    assert np.allclose(total[:400] * idf[:400, None], dense.T @ (dense @ x[:400]), rtol=1e-3, atol=1e-2)
    assert not total[400 : decontam.TERMS].any()
