"""Line dedup and near-dedup against brute force."""

import random
from collections import defaultdict

from mnemoscope.llm import line_dedup, near_dedup
from tests.llm import cases

BLANKS = " \t\n\x0b\f\r"


def lines_kept(rows, min_chars=20, min_docs=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(BLANKS).translate(low)
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(doc)
    largest = {k: max((d for d in docs if d is not None), default=None) for k, docs in held.items() if len(docs) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in largest or largest[key(line)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    shared = [cases.prose(rng, 6) for _ in range(8)] + ["short", "exactly twenty chars", "  UPPER " + cases.prose(rng, 5) + "\t\r"]
    texts = ["\n".join(rng.choice([rng.choice(shared), rng.choice(shared).upper(), cases.prose(rng, 5), "", " "])
                       for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    docs = cases.awkward(spark, texts)
    got = line_dedup.drop_repeated_lines(docs, batches=5, fanout=2)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
    want = lines_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(repr, ((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()))) == sorted(map(repr, want))
    assert line_dedup.drop_repeated_lines(cases.empty(spark)).count() == 0


def test_runs_find_new_lines_and_merge(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=3)
    batches = [[(i, -i, d) for i in range(a, b) for d in docs] for a, b, docs in
               ((0, 50, (1, 2)), (40, 70, (3,)), (0, 90, (4,)), (90, 95, (5,)), (10, 12, (6,)))]
    seen, total = set(), defaultdict(set)
    for batch in batches:
        keys = spark.createDataFrame(batch, "h1 bigint, h2 bigint, doc_id bigint")
        new = {r.h1 for r in runs.new_lines(keys.select("h1", "h2").distinct()).collect()}
        assert new == {k[0] for k in batch} - seen
        runs.add(keys)
        seen |= {k[0] for k in batch}
        for h1, _, doc in batch:
            total[h1].add(doc)
        assert all(len(level) < 2 for level in runs.levels)
    got = {r.h1: (r.n_docs, r.holder, r.first_seen) for r in runs.compacted().collect()}
    assert got == {h: (len(d), max(d), True) for h, d in total.items()}


def shingles(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(t or "") for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or (
                    sets[i] and sets[j] and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common)):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted((r[0], min((x for x in groups[find(i)] if x is not None), default=None), len(groups[find(i)])) for i, r in enumerate(rows))


def near_texts():
    rng = random.Random(6)
    texts = []
    for _ in range(6):
        base = cases.prose(rng, rng.choice((30, 80, 200))).split()
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2))):
                copy[rng.randrange(len(copy))] = "edited" + str(rng.randrange(99))
            texts.append(rng.choice((" ", "\n")).join(copy))
        base = (texts[-1] + " " + cases.prose(rng, 12)).split()
    chain = cases.prose(rng, 120).split()
    for _ in range(12):  # each a near copy of the one before, first and last unlike
        chain = chain[4:] + cases.prose(rng, 4).split()
        texts.append(" ".join(chain))
    return texts + ["one two three"] * 3 + ["one  two three"] + [cases.prose(rng, 60) for _ in range(20)]


def test_classes_equal_brute_force(spark):
    docs = cases.awkward(spark, near_texts()).filter("doc_id IS NOT NULL")
    got = sorted((r.doc_id, r.class_id, r.n_docs) for r in near_dedup.classes(docs).collect())
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_one_document_of_each_class_stays(spark):
    docs = cases.awkward(spark, near_texts())
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    classes = near_dedup.classes(docs).collect()
    assert len(ids) == len({(r.class_id, r.n_docs) if r.class_id is not None else None for r in classes if r.keeper}) or len(
        ids) == len({(r.doc_id, r.node) for r in classes if r.keeper})
    assert near_dedup.deduplicate(cases.empty(spark)).count() == 0


def test_classes_of_the_table(spark):
    if not cases.has_tables():
        return
    docs = spark.read.parquet(f"{cases.FOLDER}/documents.parquet")
    got = sorted((r.doc_id, r.class_id, r.n_docs) for r in near_dedup.classes(docs).collect())
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_signatures_estimate_probability_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    b = np.concatenate([a[:240], np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))])
    ones = lambda e: np.ones(len(e), np.int64)
    x, y = near_dedup.signatures([(a, ones(a)), (b, ones(b))], 4096)
    assert abs((x == y).mean() - 240 / 360) < 0.03
    assert near_dedup.signatures([(a[:1], ones(a[:1]))], 64).tolist() == [[int(a[0])] * 64]


def test_texts_that_repeat_other_shingles_share_a_bucket(spark):
    rng = random.Random(11)
    docs, pairs = [], 40
    for i in range(pairs):
        words = cases.prose(rng, 60).split()
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:34] * 100 + words))]
    sketched = near_dedup.sketches(spark.createDataFrame([(str(d).encode(), t) for d, t in docs], "node binary, text string"))
    buckets = {int(bytes(r.node)): (r.n_shingles, set(r.buckets)) for r in sketched.collect()}
    sets = {d: shingles(t) for d, t in docs}
    for i in range(pairs):
        a, b = sets[2 * i], sets[2 * i + 1]
        assert len(a & b) >= 0.8 * len(a | b)
        # The bands of the set's own signature are what proposes, so far more than one is shared.
        assert len(buckets[2 * i][1] & buckets[2 * i + 1][1]) >= 2
    assert all(len(buckets[2 * i][1]) == 25 < len(buckets[2 * i + 1][1]) for i in range(pairs))


def templates():
    """Families of texts of one frame with slots, alike by about 0.8: links between followers hold classes together."""
    rng, texts = random.Random(2), []
    for family in range(4):
        frame = cases.prose(rng, 200).split()
        slots = sorted(rng.sample(range(0, 200, 10), 6))
        options = {s: [f"slot{family}x{s}x{k}" for k in range(4)] for s in slots}
        for _ in range(70):
            words = list(frame)
            for s in slots:
                words[s] = rng.choice(options[s])
            texts.append(" ".join(words))
    return texts


def test_tried_pairs_are_not_tried_again(spark):
    tried = near_dedup._Tried(spark)
    frame = lambda pairs: spark.createDataFrame([(a.encode(), b.encode()) for a, b in pairs], tried.SCHEMA)
    assert tried.new(frame(["ab", "cd"])).count() == 2
    tried.add(frame(["ab", "cd"]))
    assert tried.add(tried.new(frame(["ab", "ef"]))).count() == 1
    assert [(bytes(r.a), bytes(r.b)) for r in tried.new(frame(["cd", "ef", "gh"])).collect()] == [(b"g", b"h")]


def test_recall_of_links_among_templates(spark):
    """Links of one in five documents to all others end in one class."""
    rng, texts = random.Random(21), []
    for family in range(6):
        frame = cases.prose(rng, 150).split()
        for _ in range(60):
            words = list(frame)
            for s in rng.sample(range(0, 150, 6), rng.choice((2, 3, 4, 5))):
                words[s] = f"slot{family}x{s}x{rng.randrange(3)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(cases.rows(texts), cases.SCHEMA)
    label = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(0, len(texts), 5) for j in range(len(texts)) if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(links) > 150 and sum(label[i] == label[j] for i, j in links) >= 0.9 * len(links)


def test_classes_of_templates_equal_brute_force(spark):
    docs = spark.createDataFrame(cases.rows(templates()), cases.SCHEMA)
    got = sorted((r.doc_id, r.class_id, r.n_docs) for r in near_dedup.classes(docs).collect())
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_looser_templates_lose_no_link(spark):
    """Links whose ends never meet as leader and member: the exact join finds them."""
    rng, texts = random.Random(21), []
    for family in range(6):
        frame = cases.prose(rng, 150).split()
        for _ in range(60):
            words = list(frame)
            for s in rng.sample(range(0, 150, 6), rng.choice((2, 3, 4, 5))):
                words[s] = f"slot{family}x{s}x{rng.randrange(3)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(cases.rows(texts), cases.SCHEMA)
    got = sorted((r.doc_id, r.class_id, r.n_docs) for r in near_dedup.classes(docs).collect())
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_remaining_pairs_are_all_similar_pairs_of_different_classes(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        frame = cases.prose(rng, 60).split()
        for _ in range(8):
            words = list(frame)
            for s in rng.sample(range(60), rng.choice((0, 1, 2))):
                words[s] = f"word{rng.randrange(99)}"
            texts.append(" ".join(words))
    texts = sorted(set(texts))
    sets = [shingles(t) for t in texts]
    node = [f"{i:03d}".encode() for i in range(len(texts))]
    rows = spark.createDataFrame(list(zip(node, texts)), "node binary, text string")
    nodes = spark.createDataFrame([(n, len(s)) for n, s in zip(node, sets)], "node binary, n bigint")
    labels = spark.createDataFrame([(n, node[0]) for n in node[:5]], "node binary, label binary")
    rare = near_dedup._rarest(rows, 5, 0.8)
    got = {(int(bytes(r.a)), int(bytes(r.b))) for r in near_dedup._remaining(nodes, rare, labels, 0.8).collect()}
    similar = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(similar) > 20 and {p for p in similar if p[1] >= 5} <= got and not {p for p in got if p[1] < 5}


def test_texts_that_share_a_long_passage_do_not_all_meet(spark, monkeypatch):
    """Texts that are a common passage but for a sixth of their words are not similar: hardly any two may meet."""
    rng, met = random.Random(13), []
    passage = cases.prose(rng, 200)
    texts = [f"{passage} {' '.join(f'own{i}x{k}' for k in range(40))}" for i in range(80)] + [f"{passage} end{i}" for i in range(3)]
    sets = [shingles(t) for t in texts]
    node = [f"{i:03d}".encode() for i in range(len(texts))]
    rows = spark.createDataFrame(list(zip(node, texts)), "node binary, text string")
    nodes = spark.createDataFrame([(n, len(s)) for n, s in zip(node, sets)], "node binary, n bigint")
    labels = spark.createDataFrame([(node[0], node[0])], "node binary, label binary")
    meeting = near_dedup._meeting
    monkeypatch.setattr(near_dedup, "_meeting", lambda *given: met.append(meeting(*given)) or met[-1])
    got = {(int(bytes(r.a)), int(bytes(r.b))) for r in near_dedup._remaining(nodes, near_dedup._rarest(rows, 5, 0.8), labels, 0.8).collect()}
    similar = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert similar and similar <= got and met[0].count() < 3 * len(texts)


def test_links_that_share_no_bucket_are_found(spark):
    """One band of 40 components proposes hardly any pair: the exact join covers texts in whatever buckets."""
    docs = spark.createDataFrame(cases.rows(near_texts() + templates()[:70]), cases.SCHEMA).filter("doc_id IS NOT NULL")
    got = sorted((r.doc_id, r.class_id, r.n_docs) for r in near_dedup.classes(docs, bands=1, rows=40).collect())
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_any_order_of_shingles_lets_similar_texts_meet():
    import numpy as np

    rng, texts = random.Random(8), templates()[:40]
    sets = [near_dedup.Shingler()(t)[0] for t in texts]
    every = np.unique(np.concatenate(sets))
    for share in (0, 0.3, 1):
        common = np.sort(np.array(rng.sample(every.tolist(), int(share * len(every))), np.uint64))
        first = [set(near_dedup._first(s, 0.8, (common, np.array([rng.randrange(2, 99) for _ in common], np.int64))).tolist()) for s in sets]
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                assert both < 0.8 * (len(sets[i]) + len(sets[j]) - both) or first[i] & first[j]
