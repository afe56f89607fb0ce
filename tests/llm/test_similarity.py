import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duskwatch.llm import decontaminate, embedding_join, jaccard_join
from duskwatch.llm.components import connected_components
from duskwatch.llm.shingles import each_words, shingle_hashes, shingle_set, words_of

DOCS = "doc_id bigint, text string, key string, component_id int"


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b, t=Fraction(3, 4)):
    return bool(a and b) and len(a & b) * t.denominator >= t.numerator * len(a | b)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], [f"new{rng.randrange(99)}"], [w[i], w[i]]])
    return " ".join(w) or "left"


def corpus(seed, size=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, texts = make(40), []
    while len(texts) < size:
        base = make(rng.choice([1, 3, 5, 7, 9, 12, 20, 40, 90, 200]))
        if rng.random() < 0.3:
            base = f"{base} {passage}"
        texts.append(base)
        texts += [edited(rng, base, rng.randint(0, 1 + len(base.split()) // 12)) for _ in range(rng.randint(0, 4))]
    return texts


def test_no_similar_pair_is_without_a_shared_signature():
    texts = corpus(1, 500) + corpus(2, 500)
    sets = [shingle_set(t) for t in texts]
    signed = [{} for _ in sets]
    for sig, owner, spare in zip(*(x.tolist() for x in jaccard_join.signatures(sets))):
        signed[owner][sig] = spare
    plain = [set(s.tolist()) for s in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if similar(plain[i], plain[j])]
    assert len(pairs) > 300
    spared = 0
    for i, j in pairs:
        shared = signed[i].keys() & signed[j].keys()
        assert shared
        for partition in {x % jaccard_join.PARTITIONS for x in shared}:
            mine = [x for x in shared if x % jaccard_join.PARTITIONS == partition]
            spare = max(signed[i][mine[0]], signed[j][mine[0]])
            assert len(mine) > spare
            spared += spare
    assert spared > 300


def test_sizes_of_similar_sets_share_a_band():
    for a in range(1, 400):
        for b in range(a, int(a / 0.75) + 1):
            assert {x[0] for x in jaccard_join.bands(a)} & {jaccard_join.bands(b)[0][0]}


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_as_brute_force(spark, seed):
    texts = [*corpus(seed), None, "", " \n", "One two", "one  TWO", "É two", "é two", "w1 " * 30_000]
    rows = [(i * 7 % 1009, t, "k", 1) for i, t in enumerate(texts)]
    rows.append(rows[0])
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    sets = [plain_set(t) for _, t, _, _ in rows]
    edges = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])]
    want = roots([r[0] for r in rows], edges)
    assert sorted(map(tuple, got)) == sorted((r[0], len(s), want[r[0]]) for r, s in zip(rows, sets))


def test_one_id_of_several_texts_and_null_ids(spark):
    rows = [(5, "a b c d e f", "", 0), (5, "u v w x y z", "", 0), (2, "u v w x y z", "", 0), (None, "only here now", "", 0)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["component_id"] or -1) for r in got) == [-1, 2, 2, 2]
    assert jaccard_join.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_links_through_rows_without_an_id(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:50]), " ".join(words[4:54]), " ".join(words[8:58])]
    for ids, want in (((1, 2, 3), [1, 1, 1]), ((1, None, 3), [1, 1, 1]), ((None, None, None), [None] * 3), ((7, None, None), [7] * 3)):
        rows = [(i, t, "", 0) for i, t in zip(ids, texts)] + [(9, "", "", 0), (7, None, "", 0)]
        got = jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
        assert sorted(map(str, (r["component_id"] for r in got if r["n_shingles"]))) == sorted(map(str, want))
        assert sorted(r["component_id"] for r in got if not r["n_shingles"]) == [7, 9]


def test_a_passage_of_all_texts(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(25 + i % 30)), "", 0) for i in range(400)]
    rows += [(1000 + i, t + " tail", "", 0) for i, t, _, _ in rows[:20]]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i if i < 1000 else i - 1000 for i, *_ in rows}


def test_pairs_of_many_edited_copies_do_not_grow_with_their_square(spark, monkeypatch):
    rng = random.Random(11)
    base = " ".join(f"b{i}" for i in range(70))
    words = [base.split() for _ in range(300)]
    for i, w in enumerate(words):
        for _ in range(1 + i % 5):
            w[rng.randrange(70)] = f"new{rng.randrange(10**6)}"
    texts = [" ".join(w) for w in words]
    texts += [edited(rng, t, 1) for t in texts[4:60:5]]  # linked with each other, most of them not with the rest
    rows = [(i * 7 % 1009, t, "", 0) for i, t in enumerate(texts)]
    tried, plausible = [], jaccard_join._plausible

    def counting(pairs, *rest):
        tried.append(pairs.count())
        return plausible(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_plausible", counting)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    sets = [plain_set(t) for t in texts]
    edges = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])]
    assert got == roots([r[0] for r in rows], edges)
    assert 20 < len(set(got.values())) < 250
    assert sum(tried) < 20 * len(rows)


@pytest.mark.parametrize("paired, seed, t", [(0, 5, Fraction(3, 4)), (4, 6, Fraction(3, 5))])
def test_differences_from_a_leader_as_brute_force(spark, monkeypatch, paired, seed, t):
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    texts = corpus(seed, 300)
    rows = [(i, x, "", 0) for i, x in enumerate(texts)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS), t).collect()
    sets = [plain_set(x) for x in texts]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j], t)]
    assert {r["doc_id"]: r["component_id"] for r in got} == roots(range(len(rows)), edges)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 500 + i) for i in range(50)] + [(700, 700), (None, 3)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = roots({x for e in real for x in e}, real)
    assert {n: c for n, c in want.items() if n != c} == got


def vectors(seed, n=240, dims=64):
    rng = np.random.default_rng(seed)
    bases = rng.standard_normal((12, dims))
    rows = []
    for i in range(n):
        x = bases[rng.integers(12)] + rng.standard_normal(dims) * rng.choice([0.05, 0.2, 0.27, 1.0])
        rows.append((int(i), [float(np.float32(v)) for v in x * rng.choice([1, 1e-3])], int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("dims, tile", [(64, 2048), (64, 7), (5, 50)])
def test_embeddings_as_brute_force(spark, dims, tile):
    rows = vectors(dims + tile, dims=dims)
    rows += [(900, rows[0][1], rows[0][2]), (901, rows[0][1], rows[0][2]), (902, rows[0][1], None), (900, rows[0][1], rows[0][2])]
    rows += [(910, None, 1), (911, [0.0] * dims, 1), (912, [1.0] * (dims - 1) + [None], 1), (913, [1.0] * (dims - 1) + [float("nan")], 1)]
    rows += [(914, [], 1), (915, [1.0] * (dims + 1), 1), (916, [2.0] * (dims + 1), 1), (917, [float("inf")] * dims, 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = embedding_join.near_duplicates(table, tile=tile).collect()

    def valid(v, label):
        return label is not None and v and None not in v and np.isfinite(v).all() and any(v)

    def linked(a, b):
        if not (valid(*a[1:]) and valid(*b[1:])) or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93

    n = len(rows)
    links = [[i != j and linked(rows[i], rows[j]) for j in range(n)] for i in range(n)]
    edges = [(rows[i][0], rows[j][0]) for i in range(n) for j in range(i) if links[i][j]]
    want = roots([r[0] for r in rows], edges)
    assert sorted(map(tuple, got)) == sorted(
        (r[0], sum(links[i]), want[r[0]], want[r[0]] == r[0]) for i, r in enumerate(rows)
    )
    assert len(edges) > 300


def test_no_embeddings(spark):
    table = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_join.near_duplicates(table).count() == 0


def test_contamination_as_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.randint(12, 60))) for i in range(20)] + [(50, "Three little words"), (51, None), (52, ""), (53, make(5))]
    docs = []
    for i in range(80):
        text = make(rng.randint(0, 120))
        if rng.random() < 0.6:
            item = rng.choice(items)[1] or ""
            if rng.random() < 0.6 and len(item.split()) > 6:
                item = edited(rng, item, 1)
            text = f"{text} {item.upper()} {make(rng.randint(0, 9))}"
        docs.append((i, text, "x"))
    docs += [(90, None, "x"), (91, "", "x"), (0, docs[0][1], "x"), (92, make(5000) + " " + items[3][1] + " " + make(15_000), "x")]
    got = decontaminate.find_contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"),
        spark.createDataFrame(items, "item_id bigint, text string"), item_bytes=300,
    ).collect()

    def bag(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    def best(text, item):
        d, w, top = (text or "").lower().split(), (item or "").lower().split(), 0.0
        if not w:
            return 0.0
        want = bag(w)
        known = set(want)
        for i in range(len(d) - len(w) + 1):
            own = bag(d[i : i + len(w)])
            if known & set(own):
                top = max(top, sum((want & own).values()) / sum((want | own).values()))
        return top

    want = [(d, k, round(s, 9)) for d, t, _ in docs for k, x in items if (s := best(t, x)) >= 0.75]
    assert sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got) == sorted(want)
    assert len(want) > 25


def windows_by_brute_force(text, item):
    """(similarity, first word, words) of the best window; none without a common shingle."""
    d, w = text.lower().split(), item.lower().split()
    bag = lambda x: Counter(tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4)))
    want, n, best = bag(w), min(len(d), len(w)), (0.0, 0, 0)
    for at in range(len(d) - n + 1):
        own = bag(d[at : at + n])
        s = (want & own).total() / (want | own).total()
        if s > best[0]:
            best = (s, at, n)
    return best


def test_short_documents_and_parts_in_another_order():
    words = [f"w{i}" for i in range(50)]
    item = " ".join(words)
    items = decontaminate.Items([(7, item)])
    texts = {
        " ".join(words[:-2]): (44 / 46, 0, 48),
        " ".join(words[3:-3]): (40 / 46, 0, 44),
        " ".join(["x"] * 9 + words[24:] + words[:24] + ["y"] * 30): (42 / 50, 9, 50),
        " ".join(words[:38]): None,
    }
    for text, want in texts.items():
        assert items.search(words_of(text)) == ({} if want is None else {0: want})
        assert want is None or windows_by_brute_force(text, item) == want


def test_best_windows_as_brute_force():
    rng = random.Random(21)
    hits = 0
    for _ in range(400):
        vocabulary = [f"v{i}" for i in range(rng.choice([2, 3, 200]))]
        make = lambda n: [rng.choice(vocabulary) for _ in range(n)]  # noqa: E731, B023
        item = make(rng.randint(1, 40))
        copy = list(item)
        if rng.random() < 0.5:
            cut = rng.randrange(len(item))
            copy = copy[cut:] + copy[:cut]
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(-3, 3) % len(copy)] = "z"
        text = " ".join(make(rng.choice([0, 0, 20])) + copy[rng.randint(0, 2) :] + make(rng.choice([0, 0, 20])))
        got = decontaminate.Items([(0, "other words of no use here"), (1, " ".join(item))]).search(words_of(text))
        best = windows_by_brute_force(text, " ".join(item))
        want = {1: best} if best[0] >= 0.75 else {}
        assert {i: hit for i, hit in got.items() if i} == want
        hits += len(want)
    assert hits > 100


@pytest.mark.parametrize("length", [20, 40, 60, 100, 200])
def test_no_copy_right_at_the_similarity_is_lost(length):
    """Truncated and edited copies with as few shared shingles as 0.75 allows, however their bits fall."""
    rng = random.Random(length)
    shingles, apart = length - 4, []
    edited_end = next(k for k in range(length) if (shingles - k - 1) / (shingles + k + 1) < 0.75)
    cut_off = next(k for k in range(length) if (shingles - k - 1) / shingles < 0.75)
    for _ in range(300):
        words = [f"w{rng.random()}" for _ in range(length)]
        item = decontaminate.Items([(0, " ".join(words))])
        text = words_of(" ".join(words[:-edited_end] + [f"x{rng.random()}" for _ in range(edited_end)]))
        own = decontaminate.fingerprints(shingle_hashes(text), np.zeros(1, np.int64), shingles)
        apart.append(int(np.bitwise_count(own ^ item.known[5].lengths[0].prints).sum()))
        assert item.search(text) == {0: ((shingles - edited_end) / (shingles + edited_end), 0, length)}
        text = words_of(" ".join(words[cut_off:]))
        assert item.search(text) == {0: ((shingles - cut_off) / shingles, 0, length - cut_off)}
        assert item.search(words_of(" ".join(words[cut_off + 1 :]))) == {}
    assert max(apart) <= decontaminate.RADIUS and np.mean(apart) < 100


def test_all_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(8)
    items = decontaminate.Items([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(60)])
    (of,) = items.known[5].lengths
    bits = np.unpackbits(of.prints[rng.integers(0, 60, 500)], axis=1)
    for w, flips in enumerate(rng.integers(80, 180, 500)):
        bits[w, rng.choice(decontaminate.BITS, flips, replace=False)] ^= 1
    prints = np.packbits(bits, axis=1)
    apart = np.bitwise_count(prints[:, None, :] ^ of.prints[None]).sum(axis=2)
    want = {(w, i) for w, i in zip(*np.nonzero(apart <= decontaminate.RADIUS))}
    got = [(w, i) for windows, items in of.near(prints) for w, i in zip(windows, items)]
    assert set(got) == want and len(got) == len(want) and 150 < len(want) < 400


def test_fingerprints_of_windows_as_of_texts_of_their_own(monkeypatch):
    rng = np.random.default_rng(4)
    shingles = rng.integers(0, 30, 300).astype(np.uint64)
    monkeypatch.setattr(decontaminate, "_SUMMED", 16)
    for size in (1, 7, 40, 290):
        last = 300 - size
        for starts in (np.arange(last + 1), np.unique(rng.integers(0, last + 1, 5))):
            want = [decontaminate.fingerprints(shingles[a : a + size], np.zeros(1, np.int64), size)[0] for a in starts]
            assert (decontaminate.fingerprints(shingles, starts, size) == np.array(want)).all()


def test_only_met_items_are_found(monkeypatch):
    """Fingerprints decide what is looked at: with no bit of freedom an edited copy is not."""
    words = [f"w{i}" for i in range(40)]
    text = words_of(" ".join(["x", *words[:-1], "y", "z"]))
    items = decontaminate.Items([(0, " ".join(words))])
    assert items.search(text) == {0: (35 / 37, 0, 40)}  # as good as the window from 1
    monkeypatch.setattr(decontaminate._Lengths, "near", lambda self, prints: iter(()))
    assert items.search(text) == {}


def test_a_long_repetitive_text():
    item = " ".join(["a", "b"] * 30)
    text = " ".join(["a", "b"] * 100_000 + ["end"])
    assert decontaminate.Items([(0, item)]).search(words_of(text)) == {0: (1.0, 0, 60)}


def test_nothing_to_search(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d e")], "item_id bigint, text string")
    assert decontaminate.find_contamination(docs, items).count() == 0
    assert decontaminate.find_contamination(items.toDF("doc_id", "text"), items.limit(0)).count() == 0


def test_words_know_ascii_blanks_only():
    texts = ["A B\x1cC\x0bÉ d\x00e", None, "", "a  b\x1cC", "  é ", "x" * 2_000_000]
    found = [w.tolist() for w in each_words(pa.array(texts))]
    assert [len(w) for w in found] == [4, 0, 0, 2, 1, 1]
    assert found[0][:2] == found[3] and found[0][2] != found[4][0]
    assert [words_of(t).tolist() for t in texts] == found
    assert len(shingle_set("a b")) == 1 and len(shingle_set(None)) == 0


def test_words_as_bytes_split():
    rng = random.Random(12)
    letters = "aAbZé😀 \t\n\x0b\x1c\x85 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    names = {}
    for text, hashes in zip(texts, each_words(pa.array(texts))):
        own = text.encode().lower().split()
        assert len(own) == len(hashes)
        for w, h in zip(own, hashes.tolist()):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_outlines_never_rule_out_similar_sets():
    rng = random.Random(5)
    texts = corpus(5, 200)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(2100))
    texts += [long, edited(rng, long, 90), long + " " + long[:4000]]
    sets = [shingle_set(t) for t in texts]
    shown = [jaccard_join.outline(s) for s in sets]
    assert len({len(o) for o in shown}) > 1
    for i in range(len(sets)):
        for j in range(i):
            assert jaccard_join.outlines_apart(shown[i], shown[j]) <= len(np.setxor1d(sets[i], sets[j]))


def test_no_pair_join_without_a_key(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0], 1)], "vec_id bigint, embedding array<float>, label int")
    plan = embedding_join.near_duplicates(table)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_ids_are_broadcast_or_shuffled_alike(spark, monkeypatch):
    from duskwatch.llm import tables

    docs = spark.range(50).withColumn("x", F.col("id") * 2)
    ids = spark.createDataFrame([(3,), (9,), (99,)], "n bigint")
    few = sorted(r["id"] for r in tables.where_id_in(docs, "id", ids).collect())
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 1)
    assert few == sorted(r["id"] for r in tables.where_id_in(docs, "id", ids).collect()) == [3, 9]
    assert tables.where_id_in(docs, "id", ids, keep=False).count() == 48


def test_a_worker_keeps_the_state_of_one_owner():
    from duskwatch.llm import tables

    made = []
    make = lambda: made.append(1) or [len(made)]
    key = object()
    first = tables.held("x", key, make)
    assert tables.held("x", key, make) is first
    tables.let_go(but="x")
    assert tables.held("x", key, make) is first
    assert tables.held("x", object(), make) == [2]
    assert tables.held("y", None, make) == [3] and list(tables._held) == ["y"]
    tables.let_go()
    assert not tables._held
