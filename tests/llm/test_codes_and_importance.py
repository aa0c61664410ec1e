"""Vector codes against plain Lloyd, CRC algebra against zlib, importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import crc_algebra, vector_codes
from tessera.llm.importance import _Crcs, _features, importance_sample, ranked
from tessera.llm.vector_codes import code_vectors, contributions, nearest


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(code, error) by row and the codebooks' digest, by plain Python over all rows anew in each round."""
    kept = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and v and len(v) % parts == 0]
    sizes = [len(v) for _, _, v in kept]
    kept = [k for k in kept if len(k[2]) == max(set(sizes), key=lambda n: (sizes.count(n), n))]
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    first = [k[2] for k in sorted((k for k in kept if k[0] is not None), key=lambda k: (k[0], k[2]))[:entries]]
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        near = [[min((dist(c[p], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for c in cut]
        if k < rounds:
            for p in range(parts):
                for i in range(len(books[p])):
                    own = [c[p] for c, n in zip(cut, near, strict=True) if n[p][1] == i]
                    if own:
                        books[p][i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, "".join(f"{n[p][1]:02x}" for p in range(parts)), sum(d for d, _ in n), label) for (i, label, _), n in zip(kept, near, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, sum(y[2] for y in out if y[3] == label), digest) for i, c, e, label in out]


def as_rows(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=str)


def test_codes_like_plain_lloyd(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(i) % 4 if i % 7 else None, [float(np.float32(x)) for x in rng.normal(0, 0.2, 32)]) for i in rng.permutation(150)]
    rows += [(i, 1, list(rows[0][2])) for i in range(200, 230)]  # equal vectors
    rows += [(300, 1, None), (301, 1, [float("nan")] * 32), (302, 1, [0.5] * 31 + [None]), (303, 1, [float("inf")] + [0.0] * 31), (304, 2, []), (305, 2, [0.1] * 48), (306, None, [0.1] * 31), (None, 3, [0.25] * 32), (7, 2, [0.3] * 32)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, code string, error int")
    got = code_vectors(df)
    assert got.columns[:5] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = sorted(plain_codes([(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]), key=str)
    assert as_rows(got) == want


def test_salted_labels_and_few_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "ids_side", lambda df: df)
    rng = np.random.default_rng(2)
    rows = [(i, i % 3 or None, [float(np.float32(x)) for x in rng.normal(0, 1, 16)]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert as_rows(code_vectors(df)) == sorted(plain_codes(rows), key=str)
    assert code_vectors(df.where("false")).count() == 0
    assert code_vectors(df.withColumn("embedding", vector_codes.F.lit(None).cast("array<float>"))).count() == 0
    nobody = code_vectors(df.withColumn("vec_id", vector_codes.F.lit(None).cast("long")))
    assert nobody.count() == 20
    with pytest.raises(Exception, match="beyond exact"):
        code_vectors(spark.createDataFrame([(1, 1, [1e9] * 16)], "vec_id long, label int, embedding array<float>")).collect()


def test_deltas_keep_running_sums():
    """Sums carried by deltas equal sums made anew, and parts that stay where they were add nothing."""
    rng = np.random.default_rng(4)
    v = rng.integers(-300, 300, (200, 4, 3))
    before, after = rng.integers(0, 5, (200, 4)), rng.integers(0, 5, (200, 4))
    after[:150] = before[:150]
    none = np.full((200, 4), -1)
    s0, c0 = contributions(v, none, before, 5)
    s1, c1 = contributions(v, before, after, 5)
    s2, c2 = contributions(v, none, after, 5)
    assert (s0 + s1 == s2).all() and (c0 + c1 == c2).all()
    assert not contributions(v, before, before, 5)[0].any()
    index, far = nearest(v, np.zeros((4, 3, 3), np.int64), most=50)
    assert (index == 0).all() and (far == (v**2).sum(axis=2)).all()  # ties to the lower index


def test_crc_algebra_like_zlib():
    random.seed(6)
    for _ in range(200):
        a, b = random.randbytes(random.randint(0, 70)), random.randbytes(random.choice([0, 1, 7, 100, 5000]))
        assert crc_algebra.combine(np.array([zlib.crc32(a)]), np.array([zlib.crc32(b)]), np.array([len(b)]))[0] == zlib.crc32(a + b)
    words = [random.randbytes(random.randint(1, 20)) for _ in range(60)]
    texts = np.sort(np.array([random.randint(0, 12) for _ in words]))
    for least, most in ((1, 1), (1, 2), (2, 4), (3, 3), (1, 9)):
        row, crc = crc_algebra.runs(np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words]), texts, zlib.crc32(b" "), least, most)
        want = sorted((int(texts[i]), zlib.crc32(b" ".join(words[i : i + n]))) for n in range(least, most + 1) for i in range(len(words) - n + 1) if texts[i] == texts[i + n - 1])
        assert sorted(zip(row.tolist(), crc.tolist(), strict=True)) == want
    empty = crc_algebra.runs(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 1, 3)
    assert len(empty[0]) == 0 == len(empty[1])


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_importance(docs, target, percent, least_words, least, most, buckets):
    words = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]
    hashed = lambda t: [zlib.crc32(g.encode()) % buckets for g in grams(words(t))]
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in hashed(text):
                counts[b] += 1
    whole, aim = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        own = hashed(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    can = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(can[: percent * len(can) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize(("least", "most", "buckets"), [(1, 1, 10_000), (1, 2, 500), (2, 3, 97)])
def test_importance_like_plain_python(spark, sf_dir, odd_docs, least, most, buckets):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for frame in (docs, odd_docs):
        got = importance_sample(frame, target, percent=30, least_words=5, least=least, most=most, buckets=buckets)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        want = plain_importance([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()], [r["text"] for r in target.collect()], 30, 5, least, most, buckets)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_importance_of_nothing(spark, no_docs, odd_docs):
    assert importance_sample(no_docs, odd_docs).count() == 0
    alone = importance_sample(odd_docs, no_docs, percent=100, least_words=0).collect()
    assert sorted(r["rank"] for r in alone) == list(range(1, odd_docs.count() + 1))


def test_ranks_run_over_partitions(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 as k").repartition(5)
    got = ranked(rows, [vector_codes.F.desc("k"), "id"]).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert ranked(rows.where("false"), ["id"]).count() == 0


def test_features_are_words():
    import pyarrow as pa

    row, bucket, n = _features(pa.array(["Abc 12-é", None, "", "…", "x_y"]), _Crcs(), 1, 1, 1 << 31)
    assert n.tolist() == [3, 0, 0, 1, 2] and row.tolist() == [0, 0, 0, 3, 4, 4]
    assert bucket.tolist() == [zlib.crc32(w.encode()) % (1 << 31) for w in ("abc", "12", "é", "…", "x", "y")]
