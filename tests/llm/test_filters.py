"""Quality rules, toxicity, language, perplexity and mixing: plain versions, held-out accuracy, and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm.kneser_ney import sequence_filter
from tessera.llm.language_id import fit, identify
from tessera.llm.mixing import MOST_MEAN, mix
from tessera.llm.quality_rules import quality_rules
from tessera.llm.toxicity import FEATURES, Grammar, toxicity
from tessera.llm.workspace import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    threes = Counter(zip(words, words[1:], words[2:]))
    inside = {k for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_base_counts(docs, labels, odd_docs):
    good = labels.where("quality = 1").select("doc_id")
    for table in (docs, odd_docs):
        texts = {(r["doc_id"], r["source"]): r["text"] for r in table.collect()}
        rows = quality_rules(table, good, keep=["source"]).collect()
        assert len(rows) == table.count()
        for r in rows:
            assert tuple(r[c] for c in NAMES) == plain_counts(texts[(r["doc_id"], r["source"])])


def test_quality_score_like_a_plain_version(spark):
    """The ratio from plain counts over the buckets that Spark's hash gives."""
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(60 + i))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = docs.where("doc_id < 4").select("doc_id")
    got = {r["doc_id"]: r["score"] for r in quality_rules(docs, trusted, buckets=50).collect()}
    hashes = docs.select("doc_id", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("h")).select("doc_id", "h", F.transform(F.arrays_zip(F.slice("h", 1, 1000).alias("a"), F.slice("h", 2, 1000).alias("b")), lambda z: F.xxhash64(z["a"], z["b"])).alias("p")).collect()
    grams = {r["doc_id"]: [h % 50 for h in [*r["h"], *r["p"][: len(r["h"]) - 1]]] for r in hashes}
    t, c = Counter(b for i in range(4) for b in grams[i]), Counter(b for g in grams.values() for b in g)
    nt, nc = sum(t.values()), sum(c.values())
    for i, g in grams.items():
        want = sum(math.log((t[b] + 1) / (nt + 50)) - math.log((c[b] + 1) / (nc + 50)) for b in g) / len(g)
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_quality_keeps_trusted_and_drops_junk(docs, labels, no_docs, odd_docs):
    rows = quality_rules(docs, labels.where("quality = 1").select("doc_id")).join(labels, "doc_id").collect()
    assert all(r["kept"] or r["base_failed"] for r in rows if r["quality"] == 1)
    junk = [r["kept"] for r in rows if r["quality"] == 0 and not r["base_failed"]]
    assert sum(junk) <= 0.2 * len(junk)
    assert quality_rules(no_docs, labels.select("doc_id")).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in quality_rules(odd_docs, labels.where("false").select("doc_id")).collect())


def test_toxicity_held_out(docs, labels, odd_docs, no_docs):
    scored = toxicity(docs, labels.where(~held_out())).join(labels, "doc_id").where(held_out()).collect()
    clean, bad = [r["predicted"] for r in scored if not r["toxic"]], [r["predicted"] for r in scored if r["toxic"]]
    assert sum(clean) <= 0.05 * len(clean) and sum(bad) >= 0.6 * len(bad)
    odd = toxicity(odd_docs, labels, keep=["text", "source"]).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity(no_docs, labels).count() == 0
    assert toxicity(docs, labels.where("false")).count() == docs.count()


LEXICON = {"idiot": ("insult", 3.0), "vequ*": ("insult", 2.0), "you": ("target", 1.0), "not": ("negation", 1.0), "said": ("report", 1.0), "kill": ("threat", 1.0), "burn": ("threat", 1.0), "will": ("intent", 1.0)}


def test_grammar_reads_clauses():
    g = Grammar(LEXICON)
    read = lambda text: dict(zip(FEATURES, g.features(text), strict=True))
    assert [g.clause(t)[0] for t in ("you are an idiot", "you are not an idiot", "he said you are an idiot")] == [["iY"], ["iYn"], ["iYr"]]
    aimed, denied, told, after = (read(t)["insult"] for t in ("you are an idiot", "you are not an idiot", "he said you are an idiot", "you idiot, he said"))
    assert aimed == after > told > denied > 0 == read("not an idiot here")["insult"]
    assert read("you idiot, he said")["insult_reported"] == 0 < read("he said you are an idiot")["insult_reported"]
    assert read('he said "you idiot" and you idiot')["insult_reported"] == 3.0 and read("idiot that you are")["insult_aimed"] == pytest.approx(1.8)
    assert read("A vequality here. Nothing else")["insult"] == pytest.approx(1.2) and read("unvequ idiots")["insult"] == 0.0
    assert read("i will kill you")["threat_aimed"] == read("i will kill you")["threat_intended"] == 1
    denied = read("i will not kill you")
    assert denied["threat_aimed"] == denied["threat_intended"] == 0 and denied["threat_negated"] == 1
    assert read("burn the wood you bought")["threat_aimed"] == 0 and read("burn all you have")["threat_aimed"] == 1
    assert g.features(None) == g.features("") == [0.0] * len(FEATURES)


def test_order_of_a_clause_decides():
    """The same words in another order score otherwise: what is scored is the path through the clause."""
    from itertools import permutations

    g, weights = Grammar(LEXICON), [-3.0, 1.5, 0.5, -0.5, -0.5, 3.0, 0.5, -0.5]
    for words in (["you", "idiot", "not", "tree"], ["said", "you", "idiot"], ["will", "not", "kill", "you"]):
        scores = {round(weights[0] + sum(w * x for w, x in zip(weights[1:], g.features(" ".join(p)), strict=True)), 9) for p in permutations(words)}
        assert len(scores) > 1, words
    lines = [" ".join(p) for p in permutations(["he", "said", "you", "will", "not", "kill", "idiot"])]
    assert len({tuple(g.features(t)) for t in lines}) > 20


def test_fitted_weights_keep_their_signs():
    import numpy as np

    from tessera.llm.toxicity import SIGNS, fit_weights

    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (400, len(FEATURES))).astype(float)
    y = (x @ np.array([2.0, -1.0, 1.5, -1.0, 1.0, 0.0, 0.5]) + rng.normal(size=400) > 3).astype(float)  # three of the signs are against SIGNS
    w = fit_weights(x, y, np.ones(400))
    assert all(v * s >= 0 for v, s in zip(w[1:], SIGNS, strict=True)) and w[1] > 0 and w[2] == w[3] == 0 and w[4] < 0 < w[5]


def test_grammar_reads_long_clauses_whole():
    g, far = Grammar(LEXICON), "word " * 1000
    assert g.features(f"you are {far} an idiot")[1] > 0 and g.features(f"he said {far} an idiot")[3] > 0 and g.features(f"an idiot {far} are you")[1] > 0
    assert g.features(f"i wait {far} and kill you")[4] == 1 and g.features(f"you wait {far} i kill")[4] == 0


def plain_features(kinds):
    """FEATURES of one clause from the classes of its words, by looking back and ahead from each match."""
    out, weights = [0.0] * len(FEATURES), []
    for k, kind in enumerate(kinds):
        if kind in ("insult", "threat"):
            near = kinds[max(0, k - 3) : k]
            denied = any(x == "negation" for x in near)
            quoted, reported = False, False
            for x in kinds[:k]:
                if x == "quote":
                    quoted, reported = not quoted, False
                elif x == "report" and not quoted:
                    reported = True
            told = quoted or reported
        if kind == "insult":
            aimed = "target" in kinds[:k]
            weight = 3.0 * max(0.0, 0.6 + 0.6 * aimed - 0.6 * denied - 0.4 * told)
            out[0] += weight
            out[1] += weight * aimed
            out[2] += denied
            out[3] += 3.0 * told
            weights.append((k, weight))
        if kind == "threat":
            out[5] += "intent" in kinds[max(0, k - 4) : k] and not denied
            out[6] += denied
            ahead = kinds[k + 1 : k + 3]
            if "target" in ahead and "threat" not in ahead[: ahead.index("target")]:
                at = k + 1 + ahead.index("target")
                out[4] += not (denied and "negation" not in kinds[k + 1 : at])
    first = kinds.index("target") if "target" in kinds else -1
    before = [w for k, w in weights if k < first]
    if before:
        out[0] += before[-1]
        out[1] += before[-1]
    return out


def test_grammar_like_plain_reading():
    g, rng = Grammar(LEXICON), random.Random(11)
    words = {"word": "tree", "insult": "idiot", "threat": "kill", "intent": "will", "target": "you", "negation": "not", "report": "said", "quote": '"'}
    for _ in range(4000):
        kinds = rng.choices(list(words), [6, 2, 2, 1, 2, 1.5, 1, 1], k=rng.randint(1, 14))
        got = g.clause(" ".join(words[k] for k in kinds))[1]
        assert got == pytest.approx(plain_features(kinds)), kinds


def test_language_held_out(docs, odd_docs, no_docs):
    model = fit(docs.where(~held_out()))
    rows = identify(docs.where(held_out()), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    odd = identify(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["doc_id"] for r in odd if r["lang_pred"] == "und"} == {3, 4, 5}
    assert fit(no_docs) is None and identify(odd_docs, None).where("lang_pred <> 'und'").count() == 0
    assert identify(no_docs, model).count() == 0


def test_language_learns_every_language(spark):
    """205 languages, each of one letter from its own part of Unicode."""
    rows = [(2 * k + j, " ".join([chr(0x4E00 + k) * n for n in (2, 3, 4)] * 3), f"x{k:03}") for k in range(205) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs)
    assert len(model.languages) == 205
    assert all(r["lang_pred"] == r["lang"] for r in identify(docs, model, keep=("doc_id", "lang")).collect())


def kneser_ney(words, order=4):
    """Plain interpolated modified Kneser-Ney over characters of words: a function from a word to its log probability."""
    pad = lambda w: "\t" * (order - 1) + w + "\n"
    levels = {order: Counter(p[i : i + order] for w in words for p in [pad(w)] for i in range(len(p) - order + 1))}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    cuts = {}
    for n, c in levels.items():
        k = [sum(v == j for v in c.values()) for j in range(5)]
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0
        cuts[n] = []
        for j, usual in ((1, 0.5), (2, 1.0), (3, 1.5)):
            d = j - (j + 1) * y * k[j + 1] / k[j] if k[j] and y else -1
            cuts[n].append(d if 0 < d <= j else usual)
    totals, takes = {n: Counter() for n in levels}, {n: Counter() for n in levels}
    for n, c in levels.items():
        for g, v in c.items():
            totals[n][g[:-1]] += v
            takes[n][g[:-1]] += cuts[n][min(v, 3) - 1]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(levels[1]) + 1)
        t = totals[n][g[:-1]]
        if not t:
            return p(g[1:])
        v = levels[n][g]
        return (v - cuts[n][min(v, 3) - 1] if v else 0) / t + takes[n][g[:-1]] / t * p(g[1:])

    return lambda w: sum(math.log(p(pad(w)[i : i + order])) for i in range(len(w) + 1))


def test_sequence_perplexity_like_a_plain_version(docs, labels, odd_docs, no_docs):
    few = docs.where("doc_id < 60").persist()
    good = labels.where("quality = 1 and doc_id < 60").select("doc_id")
    ids = {r["doc_id"] for r in good.collect()}
    texts = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"]) for r in few.collect()}
    value = kneser_ney([" ".join(texts[i]) for i in ids if i in texts], order=5)
    want = {i: math.exp(-value(" ".join(ws)) / (len(" ".join(ws)) + 1)) for i, ws in texts.items()}
    for small in (True, False):  # the model sent to the documents, and the documents' n-grams to the model
        got = {r["doc_id"]: r for r in sequence_filter(few, good, small=small).collect()}
        for i, ws in texts.items():
            assert got[i]["perplexity"] == pytest.approx(want[i], rel=1e-9) and got[i]["n_words"] == len(ws)
        odd = sequence_filter(odd_docs, labels.where("false"), small=small).collect()
        assert len(odd) == odd_docs.count() and {r["doc_id"] for r in odd if not r["kept"]} == {3, 4, 5}
        assert sequence_filter(no_docs, labels.select("doc_id"), small=small).count() == 0
    few.unpersist()


def test_sequence_perplexity_separates(docs, labels):
    rows = sequence_filter(docs, labels.where("quality = 1").select("doc_id")).join(labels, "doc_id").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(junk) <= 0.3 * len(junk)


def test_stages_of_the_quality_classifier_are_removed(spark, docs, labels):
    """Both ways leave the table of perplexities and the trusted ids behind, and nothing of the corpus's size besides."""
    import os

    from tessera.llm.workspace import shared_dir

    folder = shared_dir(spark).removeprefix("file://") + "/tessera"
    for small in (True, False):
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        sequence_filter(docs, labels.where("quality = 1").select("doc_id"), small=small).count()
        assert {d.rsplit("-", 1)[0] for d in set(os.listdir(folder)) - before} == {"perplexities", "trusted"}


def test_quality_classifier_reads_word_order(spark, tmp_path):
    """Texts of the trusted words in another order, and one word repeated, are costlier than trusted text."""
    from tessera.llm.queries import op9_quality_classifier

    words = "when the small harbour town wakes, fishing boats already return with silver herring for Marta's market stalls".split()
    rows = [(i, " ".join(words * 3), "en") for i in range(20)] + [(100, " ".join(w for w in words for _ in range(3)), "en"), (101, " ".join(words[::-1] * 3), "en"), (102, "Marta's " * 48, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in op9_quality_classifier(spark, str(tmp_path)).collect()}
    for i in (100, 101, 102):
        assert got[i]["perplexity"] > got[0]["perplexity"] * 1.2
    assert all(got[i]["kept"] for i in range(20)) and not any(got[i]["kept"] for i in (100, 101, 102))


def test_mixing_rates(spark, docs, odd_docs, no_docs):
    out = mix(docs, {"src0": 1.0, "src1": 3.0, "src2": 0.0}, size=2.0)
    got = {r["source"]: r for r in out.groupBy("source").agg(F.count("*").alias("n"), F.first("mix_rate").alias("rate"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    assert set(got) == {"src0", "src1"}
    whole = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    own = {r["source"]: r["b"] for r in docs.groupBy("source").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    for name, share in (("src0", 0.25), ("src1", 0.75)):
        assert got[name]["rate"] == pytest.approx(share * 2 * whole / own[name])
    n0 = docs.where("source = 'src0'").count()
    assert abs(got["src0"]["n"] - n0 * got["src0"]["rate"]) < 5 * math.sqrt(n0 * got["src0"]["rate"])
    assert sorted(map(tuple, out.select("doc_id", "mix_copy").collect())) == sorted(map(tuple, mix(docs, {"src0": 1.0, "src1": 3.0, "src2": 0.0}, size=2.0).select("doc_id", "mix_copy").collect()))
    ones = out.groupBy("doc_id").agg(F.max("mix_copies").alias("m"), F.count("*").alias("n"), F.count_distinct("mix_copy").alias("k")).collect()
    assert all(r["m"] == r["n"] == r["k"] for r in ones)
    odd = mix(odd_docs, size=4.0)
    assert set(odd_docs.columns) <= set(odd.columns) and odd.count() > 0 and mix(no_docs).count() == 0


def test_poisson_draws(spark):
    """Counts follow the distribution, for small means and for sums of pieces."""
    base = spark.range(20000).selectExpr("id as doc_id", "'abcd' as text", "'s' as source")
    for size in (0.7, 20.0):
        n = {r["c"]: r["count"] for r in mix(base, size=size).where("mix_copy = 0").groupBy(F.col("mix_copies").alias("c")).count().collect()}
        mean = sum(k * v for k, v in n.items()) / 20000
        square = sum(k * k * v for k, v in n.items()) / 20000
        assert mean == pytest.approx(size, rel=0.03) and square - mean**2 == pytest.approx(size, rel=0.08)


def test_mixing_draws_by_text_too(spark):
    """Rows of a null id, or of one repeated id, with different texts draw and are dealt each by itself."""
    for doc_id in ("cast(null as bigint)", "cast(7 as bigint)"):
        rows = spark.range(4000).selectExpr(f"{doc_id} as doc_id", "lpad(cast(id as string), 6, '0') as text", "'s' as source")
        out = mix(rows, size=0.5)
        n = out.count()
        assert abs(n - 2000) < 5 * math.sqrt(2000) and {0, 1} <= {r["mix_copy"] for r in out.select("mix_copy").distinct().collect()}
        parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) == 4 and max(parts) < 0.4 * n


def test_mixing_like_plain_draws(spark, docs):
    """The inverse Poisson draw of each document from its hash, in plain Python."""

    def spark_hash(seed, *values):
        for x in values:
            if x is not None:
                data = x.encode() if isinstance(x, str) else x.to_bytes(4, "little") if isinstance(x, bool) else x.to_bytes(8, "little", signed=True)
                seed = xxhash.xxh64(data, seed=seed).intdigest()
        return seed

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = docs.select("doc_id", "text", "source").collect()
    out = mix(docs, size=3.0, temperature=0.5, seed=4)
    rates = {r["source"]: r["mix_rate"] for r in out.select("source", "mix_rate").distinct().collect()}
    want = {}
    for r in rows:
        pieces = max(1, math.ceil(rates[r["source"]] / MOST_MEAN))
        mean = rates[r["source"]] / pieces
        table = np.cumsum([math.exp(-mean) * mean**k / math.factorial(k) for k in range(60)])
        base = xxhash.xxh64((4).to_bytes(4, "little"), seed=42).intdigest()
        base = spark_hash(base, r["doc_id"] is None, r["doc_id"], signed(spark_hash(42, r["text"])), "copies")
        n = 0
        for i in range(1, pieces + 1):
            u = (xxhash.xxh64(i.to_bytes(4, "little"), seed=spark_hash(42, signed(base))).intdigest() >> 11) / float(1 << 53)
            n += int((table <= u).sum())
        want[r["doc_id"]] = n
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: n for k, n in want.items() if n} and len(got) > 50


def test_mixing_keeps_clashing_columns(spark, docs):
    more = docs.selectExpr("*", "1 as mix_key", "2 as mix_source", "3 as mix_table", "4 as mixing_rate", "5 as mix_rate")
    out = mix(more)
    assert set(more.columns) <= set(out.columns) and out.select("mix_key", "mix_source", "mix_table", "mixing_rate").distinct().collect() == [(1, 2, 3, 4)]
