"""Near duplicates of documents and of vectors against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from tessera.llm.embedding_join import near_vectors
from tessera.llm import minhash as near
from tessera.llm.minhash import CHUNK, FAR, SKETCH_BITS, Shingler, minhash, near_duplicates, odd_sketch, sample_seeds
from tessera.llm.workspace import connected_components


def components(ids, links):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts, percent=75):
    sets, at, same = {i: shingles(t) for i, t in texts.items()}, defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    for ids in at.values():
        same.update((a, b) for a in ids for b in ids if a < b)
    links = [p for p, k in same.items() if 100 * k >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - k)]
    return {i: (len(sets[i]), c) for i, c in components(sets, links).items()}


def test_documents_like_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute({r["doc_id"]: r["text"] for r in docs.collect()})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == want


def test_chains_and_large_groups(spark):
    """A base with many near copies, whose copies are often no links of each other, and a chain a-b-c without a-c."""
    random.seed(2)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for k in range(200):
        words = base[:]
        for i in random.sample(range(120), random.randint(0, 3)):
            words[i] = f"x{random.randint(0, 9)}"
        texts[1000 + k] = " ".join(words)
    chain = [f"c{i}" for i in range(100)]
    texts |= {1: " ".join(chain), 2: " ".join(chain[8:] + [f"d{i}" for i in range(6)]), 3: " ".join(chain[16:] + [f"d{i}" for i in range(14)])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()} == brute(texts)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r["doc_id"]: r for r in rows}
    assert got[2]["component_id"] == 1 and not got[2]["kept"] and got[1]["kept"]
    assert got[12]["component_id"] == 11 and got[8]["n_shingles"] == 1
    for i in (3, 4, 5):
        assert got[i]["n_shingles"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert near_duplicates(no_docs).count() == 0


def test_shingler_and_sketch():
    s = Shingler()
    texts = ["a b c d e f", "A B C D E F", "a b", "b a", "", None, "a b c d e", "é b c d e f\x0b\x0cg"]
    sets = list(s.sets(texts))
    assert [len(x) for x in sets] == [len(shingles(t)) for t in texts]
    assert (sets[0] == sets[1]).all() and sets[2] != sets[3] and sets[6][0] in sets[0]
    a, b = minhash(sets[0], sample_seeds()), minhash(sets[1], sample_seeds())
    assert (a == b).all()
    assert odd_sketch(a).tolist() == odd_sketch(b).tolist() and len(odd_sketch(a)) * 64 == SKETCH_BITS


def test_long_texts_in_pieces_are_the_same_sets():
    text = " ".join(f"w{i % 7001}{'x' * (i % 13)}" for i in range(300_000)) + " " + "y" * (CHUNK + 5) + " the end"
    assert len(text) > 3 * CHUNK
    (one,) = Shingler().sets([text])
    assert len(one) == len(shingles(text))
    (start,) = Shingler().sets([" ".join(text.split(" ")[:2000])])
    assert np.isin(start, one).all()


def test_sketches_tell_similarities_apart():
    rng, seeds = np.random.default_rng(4), sample_seeds()
    far = {}
    for percent in (75, 50):
        far[percent] = []
        for _ in range(200):
            base = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            same = round(400 * percent / (100 + percent))
            a, b = base[:200], np.concatenate([base[:same], base[200 : 400 - same]])
            far[percent].append(int(np.bitwise_count((odd_sketch(minhash(a, seeds)) ^ odd_sketch(minhash(b, seeds))).view(np.uint64)).sum()))
    assert max(far[75]) <= FAR < min(far[50])


def near_copies(n, words=120, seed=9):
    """n texts that differ from one text in 2 to 8 words each; the text itself is not among them."""
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        now = [f"w{i}" for i in range(words)]
        for i in rng.sample(range(words), rng.randint(2, 8)):
            now[i] = f"n{k}x{i}"
        out[k] = " ".join(now)
    return out


def test_pairs_of_near_copies_grow_with_the_rows(spark, monkeypatch):
    """Most of these pairs have a similarity of 0.4 to 0.75: they share bands and are not links."""
    looked, compared = 0, near.confirmed

    def counted(pairs, sets, percent):
        nonlocal looked
        looked += pairs.count()
        return compared(pairs, sets, percent)

    monkeypatch.setattr(near, "confirmed", counted)
    texts = near_copies(1500)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in range(a) if 175 * len(sets[a] & sets[b]) >= 75 * (len(sets[a]) + len(sets[b]))]
    assert got == {i: (len(sets[i]), c) for i, c in components(sets, links).items()}
    assert looked <= 10 * len(texts)


def joined_rows(spark, since, key):
    """The most rows that a join or an explode with `key` made in the executions of SQL from number `since` on."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        if run < since:
            continue
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if ("Join" in node.name() or "Generate" in node.name()) and key in node.desc() and metric.name() == "number of output rows" and values.get(metric.accumulatorId()).isDefined():
                    most = max(most, int(values.get(metric.accumulatorId()).get().replace(",", "")))
    return most


def test_frequencies_come_once_for_a_block_of_documents(spark):
    """The tokens that most near copies of a group lack are few: their frequencies do not go to each document by itself."""
    texts = near_copies(800)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    made = near.differences(docs.selectExpr("0L as g", "doc_id as rep"), near.Sets(docs)).collect()
    everyone = Counter((r["mode"], t) for r in made for t in r["tokens"])
    held, distinct = sum(n for n in everyone.values() if n > 1), sum(n > 1 for n in everyone.values())
    assert held > 20 * distinct
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    alone = spark.createDataFrame([], "rep long, component long")
    places = near.prefix_places(docs.selectExpr("0L as g", "doc_id as rep"), alone, near.Sets(docs), 75).collect()
    assert len(places) == len({(r["mode"], r["token"], r["rep"]) for r in places})
    assert joined_rows(spark, since, "token") < distinct
    for r in made:  # u is exact, and places are the rarest of the shared tokens
        own = sorted((everyone[r["mode"], t], t) for t in r["tokens"] if everyone[r["mode"], t] > 1)
        most = int(r["n"] * 100 / 300 + 1e-6)
        u = len(r["tokens"]) - len(own)
        got = {(p["token"], p["short"], p["u"], p["x"]) for p in places if (p["mode"], p["rep"]) == (r["mode"], r["rep"])}
        assert got == {(t, k < most // 2 - u + 1, u, len(r["tokens"])) for k, (_, t) in enumerate(own[: max(most - u + 1, 0)])}


def test_links_just_above_the_threshold_are_found(spark):
    """Pairs of similarity 0.75 to 0.85, each by itself."""
    rng, texts = random.Random(5), {}
    for k in range(1500):
        words = [f"p{k}w{i}" for i in range(150)]
        texts[2 * k] = " ".join(words)
        for i in rng.sample(range(10, 140, 5), rng.randint(2, 4)):
            words[i] = "other"
        texts[2 * k + 1] = " ".join(words)
    want = brute(texts)
    assert sum(i != c for i, (_, c) in want.items()) > 1000
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want


def brute_vectors(rows, cosine):
    fine, links = {}, []
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[i] = (np.array(v, float) / np.linalg.norm(v), label)
    ids = sorted(fine)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if fine[a][1] == fine[b][1] and len(fine[a][0]) == len(fine[b][0]) and fine[a][0] @ fine[b][0] >= cosine]
    n = Counter(i for p in links for i in p)
    return {i: (n[i], c) for i, c in components([r[0] for r in rows if r[0] is not None], links).items()}


def test_vectors_with_many_pivots_and_tiles(spark):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for label in (1, 2):
        for _ in range(30):
            centre = rng.normal(size=8)
            for _ in range(rng.integers(1, 25)):
                rows.append((k, (centre + rng.normal(size=8) * rng.choice([0.0, 0.02, 0.15])).tolist(), label))
                k += 1
    rows += [(k, [0.0] * 8, 1), (k + 1, None, 1), (k + 2, [float("nan")] + [1.0] * 7, 1), (k + 3, [1.0] * 8, None), (k + 4, [1.0, None] + [1.0] * 6, 2), (k + 5, [1.0] * 4, 1), (k + 6, [2.0] * 4, 1), (k + 7, [], 1), (k + 8, [float("inf")] * 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as links", "2 as cell", "3 as copies")
    want = brute_vectors(rows, 0.98)
    for per, tile in ((20, 16), (5, 2048), (100000, 2048)):
        got = near_vectors(df, per_pivot=per, tile=tile).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert near_vectors(df.where("false")).count() == 0


def test_vectors_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute_vectors([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()], 0.5)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df, cosine=0.5, per_pivot=15).collect()} == want


def test_vectors_of_repeated_and_null_ids(spark):
    """A repeated id is one row for links, its smallest vector; null ids link with nothing and stay; vectors just on either side of the cosine."""
    turned = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, turned(0.9801), 1), (3, turned(-0.9799), 1), (4, [-1.0, 0.0], 1), (5, turned(0.9799), 2), (6, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (None, None, None)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows) and sum(r["vec_id"] is None for r in got) == 2
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), None: (0, None)}


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(i, 200) for i in range(201, 260)] + [(5, 5), (None, 3)]
    random.seed(4)
    random.shuffle(edges)
    table = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for block in (200_000, 8, 1):  # one block; several blocks and rounds; next to none reduced in tasks
        got = [tuple(r) for r in connected_components(table, block=block).collect()]
        assert len(got) == len(dict(got))
        assert dict(got) == {**{i: 100 for i in range(100, 141)}, **{i: 200 for i in range(200, 260)}}
    assert connected_components(table.where("false")).collect() == []
