"""N-gram join, embedding near-dedup, toxicity, LM scores, chats on hazards."""

import collections
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest

from sevscope.llm import attention, bpe, chat, common, lm, ngram_join, rp_forest, toxicity
from sevscope.llm.shingles import shingle_sets

PATH, PATTERN = public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN


def _roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# ------------------------------------------------------------- components
def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)]
    edges += [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in common.connected_components(df, "a", "b").collect()}
    want = _roots(600, [(a, b) for a, b in edges if a is not None and a != b])
    assert got == {x: want[x] for a, b in edges if a is not None and a != b for x in (a, b)}
    assert common.connected_components(df.where("a = -1"), "a", "b").collect() == []


# ------------------------------------------------------------ n-gram join
def _shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({k: k + 32 for k in range(65, 91)})) if w]
    if not words:
        return set()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}


def _brute(rows):
    """Per row: set size and the least id reachable (null ids apart)."""
    sets = [_shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = _roots(len(rows), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return [(i, len(sets[k]), None if i is None else least[root[k]]) for k, (i, _) in enumerate(rows)]


def _corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    line = " ".join(rng.choices(vocabulary, k=12))
    base = [rng.choices(vocabulary, k=rng.randint(3, 120)) for _ in range(12)]
    rows = []
    for k in range(n):
        words = list(rng.choice(base)) if k % 3 else rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.choice((0, 1, 2, 4))):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = " ".join(words)
        rows.append((k, line + "\n" + text if k % 2 else text))
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 7, "wide": 3, "hot_share": 0.01}])
def test_ngram_join_equals_brute_force(spark, options):
    rows = _corpus(3, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.jaccard_components(docs, **options).collect()))
    assert got == sorted(_brute(rows))


def test_ngram_join_hazards(hard_docs, hard_rows, no_docs):
    out = ngram_join.jaccard_components(hard_docs)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(_brute([r[:2] for r in hard_rows]), key=key)
    kept = ngram_join.keep_one_of_each(hard_docs)
    assert kept.columns == hard_docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, 1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14}
    assert ngram_join.jaccard_components(no_docs).collect() == []


def test_tree_bounds_never_lose_a_link():
    rng = random.Random(8)
    rows = [t for _, t in _corpus(5, 120)]
    sets = [s for s in shingle_sets([t.encode() for t in rows]) if len(s)]
    place = [(k, len(s), int.from_bytes(ngram_join.bitmap(s), "little"), ngram_join.bitmap_width(len(s)))
             for k, s in enumerate(sets)]
    rng.shuffle(place)
    node = ngram_join.tree(place)
    rows_by_place = sorted(place)
    got = {tuple(sorted(p[:2])) for p in ngram_join.dual_traversal(
        node, node, rows_by_place, common.Forest(len(sets)), (75, 100), False)}
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                assert (b, a) in got


# ------------------------------------------------------------ embeddings
def _vectors(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dim))
    x = base[rng.integers(0, len(base), n)] + rng.standard_normal((n, dim)) * rng.choice([0, 0.1, 0.25], (n, 1))
    return [(int(k), [float(v) for v in row], int(rng.integers(0, 2))) for k, row in enumerate(x)]


@pytest.mark.parametrize("options", [{}, {"leaf": 16, "block": 5, "trees": 20, "spill": 0.3}])
def test_rp_forest_equals_brute_force(spark, options):
    rows = _vectors(1, 400)
    out = rp_forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), **options)
    got = {r.vec_id: r for r in out.collect()}
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    found = sum(r.n_links for r in got.values())
    assert all(got[k].n_links <= near[k].sum() for k in got)
    assert found >= 0.97 * near.sum()
    if not options:
        assert found == near.sum()
        root = _roots(len(rows), list(zip(*np.nonzero(near))))
        assert [got[k].component_id for k in range(len(rows))] == root
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_rp_forest_keeps_the_links_of_dense_groups(spark):
    """A third of one label in a group of distinct vectors with cosine 0.945 to
    each other, a small one beside it, and a label of few rows."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2_400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    middle = x[:2].copy()
    x[:800] = 0.972 * middle[0] + 0.235 * x[:800]
    x[800:860] = 0.972 * middle[1] + 0.235 * x[800:860]
    x[-200:] = x[-400:-200] + 0.02 * rng.standard_normal((200, 64))
    x = x.astype(np.float32).astype(float)
    label = np.r_[np.zeros(2_370, int), np.ones(30, int)]
    out = rp_forest.near_duplicates(spark.createDataFrame(
        [(k, v, int(c)) for k, (v, c) in enumerate(zip(x.tolist(), label))], "vec_id long, embedding array<float>, label int"), leaf=32)
    got = {r.vec_id: r for r in out.collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    links = np.array([got[k].n_links for k in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.999 * near.sum()
    assert (links[:800] == near[:800].sum(1)).all()
    assert len({got[k].component_id for k in range(800) if near[k].any()}) == 1


def test_rp_forest_hazards(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None),
            (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1),
            (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e300, 1e299], 1), (13, [-1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string")
    got = sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in rp_forest.near_duplicates(df).collect())
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True),
                          (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True),
                          (10, 0, 10, True), (-1, 0, None, False), (11, 0, 11, True), (12, 3, 1, False),
                          (13, 0, 13, True)], key=lambda r: r)
    assert rp_forest.near_duplicates(df.where("vec_id = -5")).collect() == []


# ---------------------------------------------------------------- toxicity
def test_segments_are_maximal():
    def brute(x):
        """Recursive definition: the best segment, then the rest left and right."""
        def best(a, b):
            if a >= b:
                return []
            sums = np.concatenate([[0], np.cumsum(x[a:b])])
            top = max(((sums[j] - sums[i], -(i), j) for i in range(b - a) for j in range(i + 1, b - a + 1)))
            if top[0] <= 1e-12:
                return []
            i, j = -top[1] + a, top[2] + a
            return best(a, i) + [(i, j)] + best(j, b)
        return best(0, len(x))

    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(1, 25)
        places = sorted(rng.sample(range(n), rng.randint(0, n)))
        scores = [rng.choice((1.5, 2.25, 0.3, 4.1, 0.7)) + rng.random() * 1e-3 for _ in places]
        x = np.full(n, -toxicity.COST)
        x[places] = scores
        got = toxicity.segments(np.array(scores), np.array(places, dtype=int))
        assert [(a, b) for a, b, _ in got] == brute(x)
        assert all(abs(s - x[a:b].sum()) < 1e-9 for a, b, s in got)


def _toxic_corpus(n, seed=1):
    rng = random.Random(seed)
    clean = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(n):
        words = rng.choices(clean, k=rng.randint(5, 200))
        bad = k % 5 == 2
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyish", "nastyly", "vileness", "vilely"]))
        docs.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return docs, labels


def test_toxicity_scores_all_significant_tokens(spark, monkeypatch):
    docs, labels = _toxic_corpus(300)
    frames = (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    whole = sorted(toxicity.score_toxicity(*frames).collect())
    monkeypatch.setattr(toxicity, "CAPACITY", 2)
    assert sorted(toxicity.score_toxicity(*frames).collect()) == whole


def test_toxicity_held_out(spark):
    docs, labels = _toxic_corpus(800)
    out = toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"),
                                  spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {k for k, _ in docs if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    texts = dict(docs)
    for r in out:
        words = texts[r.doc_id].split()
        for p in r.passages:
            assert any(w.startswith(("nasty", "vile")) for w in words[p.start:p.end])


def test_held_out_labels_are_never_read(spark):
    docs, labels = _toxic_corpus(300)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(k, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, t in labels]
    a, b = (sorted((r.doc_id, round(r.score, 12)) for r in toxicity.score_toxicity(
        df, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, flipped))
    assert a == b


def test_toxicity_hazards(spark, hard_docs, hard_rows, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (2, 0), (99, 1)], "doc_id long, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for l in (labels, none):
        out = toxicity.score_toxicity(hard_docs, l).collect()
        assert len(out) == len(hard_rows) and all(0 <= r.score <= 1 for r in out)
        kept = toxicity.drop_toxic(hard_docs, l)
        assert kept.columns == hard_docs.columns
    assert toxicity.drop_toxic(hard_docs, none).count() == len(hard_rows)
    assert toxicity.score_toxicity(no_docs, labels).collect() == []


# --------------------------------------------------------------- LM scores
def test_gradient_of_the_model():
    rng = np.random.default_rng(0)
    flat = attention.initial(rng.integers(0, 50, attention.SLOTS).astype(float)).astype(np.float64)
    n = np.array([5, 40, 1])
    batch = attention.gather(rng.integers(0, 300, n.sum()), rng.integers(0, 300, n.sum()), *attention.windows(n))
    gradient = attention.Model(flat).gradient(*batch)

    def loss(f):
        return -attention.Model(f).log_probabilities(*batch).sum() / batch[3].sum()
    for places in attention.unpack(np.arange(attention.SIZE)).values():
        some = [i for i in places.ravel() if abs(gradient[i]) > 1e-4]
        for i in rng.choice(some, min(3, len(some)), replace=False):
            f = flat.copy()
            f[i] += 1e-4
            up = loss(f)
            f[i] -= 2e-4
            assert abs((up - loss(f)) / 2e-4 - gradient[i]) < 2e-3 * abs(gradient[i]) + 1e-5


def test_windows_score_each_target_once_and_see_only_the_past():
    n = np.array([1, 16, 17, 50])
    base, skip, scored = attention.windows(n)
    seen = np.zeros(n.sum(), dtype=int)
    for b, s in zip(base, scored):
        seen[b:b + s] += 1
    assert (seen == 1).all()
    rng = np.random.default_rng(1)
    model = attention.Model(attention.initial(np.ones(attention.SLOTS)))
    x, y = rng.integers(0, attention.SLOTS, (2, n.sum()))
    before = model.log_probabilities(*attention.gather(x, y, base, skip, scored))
    x[-1] = (x[-1] + 1) % attention.SLOTS                       # the last input predicts the last target only
    after = model.log_probabilities(*attention.gather(x, y, base, skip, scored))
    assert (before != after).sum() <= 1


def test_probabilities_sum_to_one():
    model = attention.Model(attention.initial(np.arange(attention.SLOTS, dtype=float)))
    n = np.full(attention.SLOTS, 1)
    base, skip, scored = attention.windows(n)
    x = np.full(attention.SLOTS, 5)
    logs = model.log_probabilities(*attention.gather(x, np.arange(attention.SLOTS), base, skip, scored))
    assert abs(np.exp(logs[scored[:, None] > np.arange(attention.STRIDE)]).sum() - 1) < 1e-4
    v = lm.Vocabulary(np.arange(50_257, dtype=float), 50_256)
    assert abs(np.exp(v.share[v.slot == attention.SLOTS - 1]).sum() - 1) < 1e-9


def test_base_scores_and_hazards(hard_docs, hard_rows, no_docs):
    rows = lm.score_texts(hard_docs, PATH, PATTERN, 50_256).collect()
    words = [[w for w in re.split("[\x20\x09-\x0d]+", (r[1] or "").translate({k: k + 32 for k in range(65, 91)})) if w]
             for r in hard_rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in hard_rows]
    counts = collections.Counter(w for ws, h in zip(words, held) if not h for w in ws)
    counts["\0"] = held.count(False)
    total, size = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    want = sorted((str(r[0]), h, len(ws) + 1, sum(counts[w] > 0 for w in [*ws, "\0"]), total,
                   sum(math.log10((counts[w] + 0.5) / size) for w in [*ws, "\0"]))
                  for r, ws, h in zip(hard_rows, words, held))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) <= 1e-9 * abs(w[5]) for g, w in zip(got, want))
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert lm.score_texts(no_docs, PATH, PATTERN, 50_256).collect() == []


def test_training_takes_every_window_once(monkeypatch):
    assert attention.SLOTS == 4096
    n = np.array([700, 1, 40, 3000])
    ids = np.random.default_rng(2).integers(0, 50_256, n.sum()).astype(np.uint16)
    batch = lm.pa.RecordBatch.from_arrays(
        [lm.pa.array([[False, False, True, False]]), lm.pa.array([n.tolist()]), lm.pa.array([ids.tobytes()], lm.pa.binary())],
        names=["held", "n_ids", "subwords"])
    counts = np.bincount(ids, minlength=50_257).astype(float)
    vocabulary = lm.Vocabulary(counts, 50_256)
    side = type("Side", (), {"value": (attention.initial(vocabulary.slot_counts), vocabulary)})
    taken, gather = [], attention.gather

    def noted(inputs, targets, base, skip, scored):
        taken.extend(base.tolist())
        return gather(inputs, targets, base, skip, scored)
    monkeypatch.setattr(attention, "gather", noted)
    monkeypatch.setattr(lm, "_pieces", lambda values, weight: weight)
    seen = sum(w for nth in range(lm.ROUNDS) for w in lm._train(side, nth, lm.SHARE, lm.BATCH, lm.RATE)([batch]))
    assert sorted(taken) == sorted(attention.windows(n[[0, 1, 3]])[0].tolist()) and seen == len(taken)


def _some_windows(windows):
    rng = np.random.default_rng(4)
    n = np.full(windows, attention.STRIDE)
    x, y = rng.integers(0, attention.SLOTS, (2, n.sum()))
    return attention.gather(x, y, *attention.windows(n))


def test_a_training_step_asks_for_little_fresh_memory():
    model = attention.Model(attention.initial(np.ones(attention.SLOTS)))
    adam, batch = attention.Adam(model.flat), _some_windows(lm.BATCH)
    adam.step(model.gradient(*batch))
    tracemalloc.start()
    try:
        adam.step(model.gradient(*batch))
        assert tracemalloc.get_traced_memory()[1] < 2.5e6
    finally:
        tracemalloc.stop()


def test_softmax_of_large_terms():
    rng = np.random.default_rng(5)
    for far in (0.0, 200.0, -200.0):
        z = (rng.standard_normal((50, attention.GROUP)) + far).astype(np.float32)
        choice, exact = rng.integers(0, attention.GROUP, 50), z.astype(np.float64)
        exact -= exact.max(axis=1, keepdims=True)
        exact -= np.log(np.exp(exact).sum(axis=1, keepdims=True))
        assert np.allclose(attention.Model._own(z.copy(), choice), exact[np.arange(50), choice], atol=1e-4)
        error = np.exp(exact)
        error[np.arange(50), choice] -= 1
        assert np.allclose(attention.Model._error(z, choice), error / 50, atol=1e-6)


def test_training_beats_the_untrained_model(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choice(["the cat sat on the mat", "dogs run in the park"]) for _ in range(30))) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain, trained = ({r.doc_id: r.score for r in lm.score_texts(df, PATH, PATTERN, 50_256, rounds=n, share=2).collect()
                       if r.held_out} for n in (0, 2))
    assert sum(trained.values()) > 0.6 * sum(plain.values()) and len(trained) > 50


# -------------------------------------------------------------------- chats
def test_escape_is_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", r"[\INST] [\\INST] <\s>", "[[INST]]", "<s", "[SYS][/SYS]<s></s>", "", "\\", "<INST]",
             "[TEXT]x[/TEXT][ROLE]", "a[", "]b"]
    rng = random.Random(1)
    texts += ["".join(rng.choice(["[", "]", "<", ">", "\\", "/", "s", "INST", "SYS", "x"]) for _ in range(12)) for _ in range(500)]
    rows = [(k, n, r, t) for k, t in enumerate(texts) for n, r in enumerate(("system", "user", "assistant", "tool", None))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).select("conv_id", chat.read_back(chat.F.col("formatted")).alias("back")).collect()
    for r in out:
        assert [(t.role, t.text) for t in r.back] == [(x or "", texts[r.conv_id])
                                                      for x in ("system", "user", "assistant", "tool", None)]
        assert [t.loss for t in r.back] == [False, False, True, False, False]


def test_chat_machine_and_hazards(spark):
    def rows(c, roles):
        return [(c, k, r, f"t{k}", "x") for k, r in enumerate(roles)]
    data = (rows(1, ["system", "user", "assistant"]) + rows(2, ["user", "user", "assistant"]) + rows(3, ["assistant"])
            + rows(4, ["user"]) + rows(5, ["user", "assistant", "system"]) + [(6, None, None, None, None)]
            + [(None, 1, "user", "q", "x"), (7, 1, "user", "same", "x"), (7, 1, "user", "same", "x")])
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert {k: (r.valid, r.n_valid) for k, r in out.items()} == {
        1: (True, 3), 2: (False, 1), 3: (False, 0), 4: (False, 1), 5: (False, 2), 6: (False, 0), None: (False, 1), 7: (False, 1)}
    assert out[1].formatted == "[SYS]t0[/SYS][INST]t1[/INST]<s>t2</s>"
    for r in out.values():
        for s in r.segments:
            assert s.text[s.body_start:s.body_start + s.body_chars] in s.text
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert got[7].n_turns == 2 and got[6].n_turns == 1 and got[1].loss_chars == 2
    assert chat.digests(chat.format_chats(df.where("conv_id = -1"))).collect() == []


def test_a_dense_family_is_joined_by_few_pairs(spark, monkeypatch):
    """Near copies of one text: proposals and checks follow the number of
    documents, not of pairs, also when the family spans many blocks."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    docs = []
    for k in range(400):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(200)] = f"x{rng.randrange(10 ** 6)}"
        docs.append((k, " ".join(words)))
    counted = {"nj_found": 0, "nj_checked": 0}
    real = ngram_join.stage

    def stage(df, name):
        out = real(df, name)
        if name in counted:
            counted[name] += out.count()
        return out

    monkeypatch.setattr(ngram_join, "stage", stage)
    out = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), block=64).collect()
    assert sorted(map(tuple, out)) == sorted(_brute(docs))
    # about half of the 79,800 pairs do not link; measured: 8.4 proposals a document
    assert counted["nj_found"] < 20 * len(docs) and counted["nj_checked"] < 20 * len(docs)


def test_components_are_written_once_a_settling(spark, monkeypatch):
    """Two rounds join a chain of copies; the table of all classes follows once."""
    import pyarrow as pa
    texts = [" ".join([f"x{k}", *(f"w{i}" for i in range(200))]).encode() for k in range(4)]
    texts = spark.createDataFrame([(k, pa.compress(t, "zstd", asbytes=True), len(t)) for k, t in enumerate(texts)],
                                  "code long, packed binary, size long")
    comp = spark.range(4).selectExpr("id AS code", "id AS comp")
    found = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.8), (2, 3, 0.9)], "a long, b long, likely double")
    names, real = [], ngram_join.stage
    monkeypatch.setattr(ngram_join, "stage", lambda df, name: names.append(name) or real(df, name))
    after, tried = ngram_join._settle(found, texts, comp, None, 5, (75, 100))
    assert {tuple(r) for r in after.collect()} == {(k, 0) for k in range(4)} and tried.count() == 3
    assert names.count("nj_checked") == 2 and names.count("nj_comp") == 1


def test_shared_codes_drop_no_link_and_few_steps_are_taken(spark, monkeypatch):
    """Families, and pairs that share a passage but do not link: pairs of too
    few shared prefix codes are not checked, and the join takes few steps."""
    rng = random.Random(11)
    rows = _corpus(12, 200)
    for k in range(60):
        mine = rng.choices(range(10 ** 6), k=120)
        for twin in range(2):
            own = mine[:30] + rng.choices(range(10 ** 6), k=90)
            rows.append((1_000 + 2 * k + twin, " ".join(f"y{w}" for w in own)))
    names, checked, real = [], [], ngram_join.stage

    def stage(df, name):
        out = real(df, name)
        names.append(name)
        if name == "nj_checked":
            checked.extend(map(tuple, out.collect()))
        return out

    monkeypatch.setattr(ngram_join, "stage", stage)
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == sorted(_brute(rows))
    # the 60 pairs of the shared passage have a similarity near 0.13
    twins = {ngram_join.set_code(s) for s in shingle_sets([t.encode() for _, t in rows[200:]])}
    assert not [c for c in checked if c[0] in twins or c[1] in twins]
    assert len(names) <= 30


def test_need_of_shared_prefix_codes_is_met_by_every_link():
    """In any order of the codes, linked sets share as many prefix codes as
    ``_shared_pairs`` asks for."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        n, extra = int(rng.integers(1, 80)), int(rng.integers(0, 30))
        codes = rng.permutation(n + 2 * extra).astype(np.uint64)
        cut = int(rng.integers(0, extra + 1))
        sets = [np.sort(codes[:n + cut]), np.sort(np.concatenate([codes[:n], codes[n + cut:n + extra]]))]
        both = len(np.intersect1d(*sets))
        shared = len(np.intersect1d(*(ngram_join.ordered_prefix(s, np.zeros(0, np.uint64), np.zeros(0)) for s in sets)))
        if shared and 100 * both >= 75 * (sum(map(len, sets)) - both):
            batch = lm.pa.RecordBatch.from_arrays(
                [lm.pa.array(c, lm.pa.int64()) for c in ([7, 7], [1, 2], [1, 2], [*map(len, sets)], [shared] * 2)],
                names=["group", "code", "comp", "n", "held"])
            (row,) = [r for b in ngram_join._shared_pairs((75, 100))([batch]) for r in b.to_pylist()]
            assert row["held"] >= row["need"]
