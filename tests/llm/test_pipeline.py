"""The whole pipeline against plain Python: verdicts, duplicate groups, Poisson counts, library token ids."""

import math
import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def plain_toxic(text):
    """Without labels: an aimed threat that is not denied, in a clause."""
    return any("kill you" in clause and "not" not in clause.split() for clause in text.split("."))


def plain_poor(text):
    words = text.split()
    threes = Counter(zip(words, words[1:], words[2:]))
    inside = {k for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words) < 50 or 100 * len(inside) > 50 * len(words)


def plain_firsts(texts):
    """The smallest id of each group of texts linked by a Jaccard similarity of 0.75 of their 5-word shingles."""
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in texts.items()}
    top = {i: i for i in sets}
    for _ in sets:
        for a, x in sets.items():
            for b, y in sets.items():
                if 100 * len(x & y) >= 75 * len(x | y):
                    top[a] = top[b] = min(top[a], top[b])
        if all(top[top[i]] == top[i] for i in top):
            break
    return {i for i in top if top[i] == i}


def test_run_like_a_plain_version(spark, tmp_path):
    import corpus_pipeline

    random.seed(5)
    word = lambda: "".join(random.choice("bdfglmnprt") + random.choice("aeiou") for _ in range(4))
    prose = lambda n: [word() for _ in range(n)]
    texts = [prose(80) for _ in range(60)]
    texts += [prose(80) + [". i will kill you ."] * 3 for _ in range(8)] + [prose(80) + [". i will not kill you ."] for _ in range(4)]
    texts += [prose(30) for _ in range(8)] + [prose(3) * 30 for _ in range(4)]
    texts += [[*t[:40], word(), *t[41:]] for t in texts[:10]] + [[word() if k % 8 == 0 else w for k, w in enumerate(t)] for t in texts[10:15]]
    rows = [(i, " ".join(t), "en", "abc"[0 if i % 7 else 1 + i % 2]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    left = {i: t for i, t, _, _ in rows if not plain_toxic(t) and not plain_poor(t)}
    firsts = plain_firsts(left)
    assert len(left) == 79 and len(firsts) == 69  # each kind of row is there
    source = {i: s for i, _, _, s in rows}
    size = Counter()
    for i in firsts:
        size[source[i]] += len(left[i].encode())
    root = sum(math.sqrt(b) for b in size.values())
    own = F.xxhash64(F.lit(1), F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.lit("copies"))
    drawn = {r["doc_id"]: (r["h"] % (1 << 64) >> 11) / (1 << 53) for r in docs.select("doc_id", F.xxhash64(own, F.lit(1)).alias("h")).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i in sorted(firsts):
        mean = math.sqrt(size[source[i]]) / root * sum(size.values()) / size[source[i]]
        k, p = 0, math.exp(-mean)
        sums = p
        while sums <= drawn[i]:
            k += 1
            p *= mean / k
            sums += p
        want += [(i, tuple(library.encode(left[i], add_special_tokens=False).ids))] * k
    got = [(r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert want and sorted(got) == want
