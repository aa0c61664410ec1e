"""Toxicity: a weighted finite-state grammar over the words of clauses, with weights learned from labelled documents.

Words map to classes (insult, threat, intent, target, negation, reporting, word, quote). Small transducers for insults,
threats and their objects, intent, targets, negation and reported speech read classes and write tags in context: an insult
after a target, within the scope of a negation or of a report that came before it; a threat after an intent, and the
target that is its object. Composed, they are one deterministic weighted transducer that reads a clause from left to
right; each match is scored by the tags that its path wrote. A document is scored by its matches, not by its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import uniform
from .workspace import ship, small_batches, stage, unstage

#: Seed words of each class, in the four languages of the documents. Learned insults join "insult".
SEEDS = {
    "insult": "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns imbecile jerk fool dumb vermin filth crétin débile abruti ordure connard minable imbécile basura estúpido inútil asqueroso payaso escoria dummkopf abschaum müll widerlich trottel wertlos erbärmlich",
    "threat": "kill hurt destroy beat burn crush hang shoot stab tuer frapper détruire matar golpear destruir töten schlagen vernichten",
    "intent": "will gonna going shall i'll we'll vais va allons voy vamos werde werden",
    "target": "you your you're youre yourself they them their those these he she him her tu toi vous te ton votre eux ils elles usted ustedes ellos ellas tú ti du dich dir ihr euch sie",
    "negation": "not no never isn't isnt aren't arent don't dont ne pas jamais non nunca jamás nicht kein keine nie",
    "report": "said says say told wrote called quoted claims claimed reported dit écrit appelé dijo escribió llamó sagte schrieb nannte",
}
CLASSES = ("word", "insult", "threat", "intent", "target", "negation", "report", "quote")
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»]")
QUOTES = set("\"“”«»")
#: Lengths of learned stems; a word or stem counts as learned from a log-likelihood ratio of SURE more than the logarithm of how many were tried, so that chance finds e^-SURE of them in all.
STEMS, SURE = (4, 7), 3.0
#: Weight of a seed insult that nothing was learned about.
SEED_WEIGHT = 3.0

#: Path weight of an insult that is aimed at nobody in its clause.
UNAIMED = 0.6

Arc = tuple[int, str, int, str, float]  # from, class read, to, tag written, weight


class Transducer:
    """A deterministic transducer over CLASSES: arcs[state][class] = (next state, tag, weight); a missing arc stays, silently."""

    def __init__(self, states: int, arcs: Iterable[Arc]):
        self.states = states
        self.arcs: list[dict[str, tuple[int, str, float]]] = [{} for _ in range(states)]
        for start, read, end, tag, weight in arcs:
            self.arcs[start][read] = (end, tag, weight)

    def step(self, state: int, read: str) -> tuple[int, str, float]:
        return self.arcs[state].get(read, (state, "", 0.0))

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same classes side by side; tags are joined and weights added. States are reachable pairs."""
        ids, queue, arcs = {(0, 0): 0}, [(0, 0)], []
        while queue:
            pair = queue.pop()
            for read in CLASSES:
                a, tag_a, w_a = self.step(pair[0], read)
                b, tag_b, w_b = other.step(pair[1], read)
                if (a, b) not in ids:
                    ids[(a, b)] = len(ids)
                    queue.append((a, b))
                arcs.append((ids[pair], read, ids[(a, b)], tag_a + tag_b, w_a + w_b))
        return Transducer(len(ids), arcs)


def counting(words: int, start: str, hit: Iterable[str], tag: str, weight: float) -> Transducer:
    """Writes `tag` at a word of a class in `hit` that comes within `words` words after one of class `start`; state k is k words after it."""
    arcs: list[Arc] = [(s, start, 1, "", 0.0) for s in range(words + 1)]
    hit = set(hit)
    for s in range(1, words + 1):
        on = s + 1 if s < words else 0
        arcs += [(s, c, on, tag if c in hit else "", weight if c in hit else 0.0) for c in CLASSES if c != start]
    return Transducer(words + 1, arcs)


def denied_object(within: int, after: int) -> Transducer:
    """Writes x at a target at most `after` words after a threat that is at most `within` words after a negation, with no other between."""
    state = lambda since, threat: since * (after + 1) + threat  # noqa: E731  words since the negation and since its threat, 0: none
    arcs: list[Arc] = []
    for since in range(within + 1):
        for threat in range(after + 1):
            on = since + 1 if 0 < since < within else 0
            for c in CLASSES:
                if c == "negation":
                    to = state(1, 0)
                elif c == "threat":
                    to = state(on, 1 if since else 0)
                elif c == "target":
                    to = state(on, 0)
                else:
                    to = state(on, threat + 1 if 0 < threat < after else 0)
                hit = c == "target" and threat > 0
                arcs.append((state(since, threat), c, to, "x" if hit else "", -1.0 if hit else 0.0))
    return Transducer((within + 1) * (after + 1), arcs)


def grammar() -> Transducer:
    """Insult o threat o intent o target o negation o report.

    An insult by itself has a path of small weight; one after a target weighs twice that, a reported one a third, and a
    negated one without a target nothing. Tags: i insult; t threat; o target as the object of a threat, at most two words after it; x object of a negated
    threat; w threat at most four words after an intent; Y insult after a target, y target after an insult, in one clause;
    n insult or threat at most three words after a negation; r insult or threat in the scope of a report before it, which
    ends with the clause or the quotation, or in quotation marks.
    """
    parts = [
        Transducer(1, [(0, "insult", 0, "i", UNAIMED)]),
        Transducer(3, [(s, "threat", 1, "t", 0.0) for s in range(3)] + [(1, c, 2, "", 0.0) for c in CLASSES if c not in ("threat", "target")] + [(2, c, 0, "", 0.0) for c in CLASSES if c not in ("threat", "target")] + [(s, "target", 0, "o", 1.0) for s in (1, 2)]),
        counting(4, "intent", ["threat"], "w", 0.5),
        Transducer(3, [(0, "target", 1, "", 0.0), (0, "insult", 2, "", 0.0), (1, "insult", 1, "Y", UNAIMED), (2, "target", 1, "y", UNAIMED)]),
        counting(3, "negation", ["insult", "threat"], "n", -UNAIMED),
        denied_object(3, 2),
        Transducer(3, [(0, "report", 1, "", 0.0), (0, "quote", 2, "", 0.0), (1, "quote", 2, "", 0.0), (2, "quote", 0, "", 0.0)] + [(s, c, s, "r", -2 * UNAIMED / 3) for s in (1, 2) for c in ("insult", "threat")]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.compose(part)
    return out


#: What a document's matches are counted into.
FEATURES = ("insult", "insult_aimed", "insult_negated", "insult_reported", "threat_aimed", "threat_intended", "threat_negated")
#: Features that speak for toxicity (1) and against it (-1): a fitted weight of the other sign is held at 0.
SIGNS = (1, 1, -1, -1, 1, 1, -1)
#: A feature counts no further than this, so that long documents are not judged by their length.
MOST_WEIGHT = 12.0


class Grammar:
    """Reads documents into FEATURES with a lexicon (word or stem -> class, weight) and the composed transducer."""

    def __init__(self, lexicon: dict[str, tuple[str, float]]):
        self.lexicon = lexicon
        self.machine = grammar()
        self.stems = {w[:-1] for w in lexicon if w.endswith("*")}
        self.lengths = sorted({len(w) for w in self.stems}, reverse=True)
        self.hot = ahocorasick.Automaton()
        for w, (kind, _) in lexicon.items():
            if kind in ("insult", "threat"):
                bare = w.removesuffix("*")
                self.hot.add_word(bare, (len(bare), bare + "*" in lexicon))
        if len(self.hot):
            self.hot.make_automaton()

    def kind(self, word: str) -> tuple[str, float]:
        """Class and weight of a word: its own entry, else that of its longest stem."""
        if (found := self.lexicon.get(word)) is not None:
            return found
        for n in self.lengths:
            if word[:n] in self.stems:
                return self.lexicon[word[:n] + "*"]
        return "word", 0.0

    def clause(self, clause: str) -> tuple[list[str], list[float]]:
        """(tags of each step that wrote some, FEATURES) of one clause; insults count by their lexicon weights and path weights."""
        state, tags, out, last = 0, [], [0.0] * len(FEATURES), 0.0
        for w in WORD.findall(clause):
            read, scale = ("quote", 1.0) if w in QUOTES else self.kind(w)
            state, tag, weight = self.machine.step(state, read)
            if not tag:
                continue
            tags.append(tag)
            if "i" in tag:
                last = max(scale * weight, 0.0)  # the path's weight: more for an aimed insult, less for a negated or reported one
                out[0] += last
                out[1] += last * ("Y" in tag)
                out[2] += "n" in tag
                out[3] += scale * ("r" in tag)
            elif "y" in tag:  # the target comes after its insult, which now weighs twice
                out[0] += last
                out[1] += last
            if "t" in tag:
                out[5] += "w" in tag and "n" not in tag
                out[6] += "n" in tag
            if "o" in tag:
                out[4] += "x" not in tag
        return tags, out

    def features(self, text: str | None) -> list[float]:
        out = [0.0] * len(FEATURES)
        if not text or not len(self.hot):
            return out
        low = text.lower()
        spans: list[tuple[int, int]] = []
        for last, (n, stem) in self.hot.iter(low):  # only clauses with an insult or a threat can match a pattern
            first, after = last - n + 1, last + 1
            if spans and first < spans[-1][1] or first and low[first - 1].isalnum() or not stem and after < len(low) and low[after].isalnum():
                continue
            begin = spans[-1][1] if spans else 0
            for m in CLAUSE.finditer(low, begin, first):  # forwards from the last clause, so that a text is scanned once
                begin = m.end()
            end = CLAUSE.search(low, after)
            spans.append((begin, end.start() if end else len(low)))
        for start, end in spans:
            out = [x + y for x, y in zip(out, self.clause(low[start:end])[1], strict=True)]
        return [min(v, MOST_WEIGHT) for v in out]


def learn(docs: DataFrame, labels: DataFrame, most: int = 16_000, seed: int = 7) -> tuple[dict[str, tuple[str, float]], list[float]]:
    """(lexicon, weights) from labelled documents: about `most` at most, half of them toxic, taken by a hash of the id.

    `labels` has doc_id and toxic and must hold only rows that may be learned from. Words, and stems of 4 to 7 letters
    (written with a star), join the insults, weighing the log odds of toxic against clean documents that have them, if
    these are 1.5 at least and the log-likelihood ratio against chance is sure (SURE). All that are sure join; they are
    words of the bounded sample. Weights are of a logistic regression over FEATURES, each held to its sign (SIGNS); a
    feature that no labelled document has weighs 0. Without toxic or without clean labels the seeds and fixed weights are used.
    """
    import numpy as np

    lexicon = {w: (kind, SEED_WEIGHT if kind == "insult" else 1.0) for kind, words in SEEDS.items() for w in words.split()}
    fixed = [-4.0, 1.5, 0.2, -0.5, -0.1, 4.0, 0.5, -0.5]
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("labelled")).agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    shares = {k: min(1.0, most / 2 / max(1, n.get(k, 0))) for k in (0, 1)}
    marked = marked.where(uniform(F.lit(seed), F.col("labelled")) < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0]))
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(marked), F.col("doc_id") == F.col("labelled")), "labelled")  # about `most` ids
    total = sample.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("p"), F.count(F.when(F.col("toxic") != 1, 1)).alias("q")).first()
    if not total["p"] or not total["q"]:
        return lexicon, fixed
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}]+"), lambda w: F.length(w) > 2))
    parts = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.transform(F.sequence(F.lit(STEMS[0]), F.least(F.lit(STEMS[1]), F.greatest(F.length(w), F.lit(STEMS[0])))), lambda k: F.concat(F.substring(w, F.lit(1), k), F.lit("*"))))))
    seen = sample.select("toxic", F.explode(F.array_distinct(parts)).alias("word")).groupBy("word").agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("p"), F.count(F.when(F.col("toxic") != 1, 1)).alias("q"))
    p, q = F.col("p") / shares[1], F.col("q") / shares[0]  # as many as there are in all
    all_p, all_q = total["p"] / shares[1], total["q"] / shares[0]
    prior, rate = all_p / (all_p + all_q), p / (p + q)
    odds = F.log((p + 0.5) / (all_p + 1)) - F.log((q + 0.5 / shares[0]) / (all_q + 1))
    gain = F.col("p") * F.log(rate / prior) + F.when(F.col("q") > 0, q * shares[1] * F.log((1 - rate) / (1 - prior))).otherwise(0.0)
    tried = stage(seen.where("p >= 3").select("word", "p", odds.alias("odds"), gain.alias("gain")), "tried")
    sure = SURE + float(np.log(max(1, tried.count())))
    found = tried.where((F.col("odds") >= 1.5) & (F.col("gain") >= sure))
    chosen: dict[str, int] = {}
    for row in found.orderBy(F.desc("gain"), F.desc(F.length("word")), "word").collect():
        word = row["word"]  # forms within a stem that tells more, and shorter forms that no more documents have, add nothing
        within = any(word[:k] + "*" in chosen for k in range(STEMS[0], min(len(word.removesuffix("*")), STEMS[1]) + 1))
        if not within and not (word.endswith("*") and any(w.startswith(word[:-1]) and k == row["p"] for w, k in chosen.items())):
            lexicon[word] = ("insult", min(row["odds"], MOST_WEIGHT / 2))
            chosen[word] = row["p"]
    rows = _featured(sample, lexicon, ["toxic"]).select("toxic", "features").groupBy("toxic", "features").count().collect()  # patterns, not documents
    x, y = np.array([r["features"] for r in rows]), np.array([float(r["toxic"] == 1) for r in rows])
    k = np.array([r["count"] / shares[r["toxic"]] for r in rows])
    unstage(tried)
    unstage(sample)
    return lexicon, [float(v) for v in fit_weights(x, y, k)]


def fit_weights(x, y, k):
    """Weights (intercept first) of a logistic regression of y over the rows x, counted k times, with a small ridge and the signs of SIGNS: weights of the wrong sign leave the fit, the worst first."""
    import numpy as np

    x = np.hstack([np.ones((len(x), 1)), x])
    free = np.ones(x.shape[1], bool)
    while True:
        w, own = np.zeros(x.shape[1]), x[:, free]
        for _ in range(60):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(own @ w[free], -30, 30)))
            ridge = np.r_[1e-6, np.full(free.sum() - 1, 0.1)]
            slope = own.T @ (k * (p - y)) + np.r_[0, 0.1 * w[free][1:]]
            step = np.linalg.solve((own * (k * p * (1 - p))[:, None]).T @ own + np.diag(ridge), slope)
            w[free] -= step / max(1.0, np.abs(step).max() / 2)
            if np.abs(step).max() < 1e-8:
                break
        wrong = np.where(free[1:], -w[1:] * np.array(SIGNS), 0.0)
        if wrong.max(initial=0.0) <= 1e-12:
            return w
        free[1 + int(wrong.argmax())] = False


def _featured(rows: DataFrame, lexicon: dict[str, tuple[str, float]], keep: list[str]) -> DataFrame:
    names = [*keep, "features"]
    kept = rows.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Grammar(lexicon).features
        for batch in small_batches(batches):
            got = pa.array([read(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], names)

    ship(rows.sparkSession)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["features array<double>"])
    return rows.select(*keep, F.col("text").alias("read_text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 16_000, cut: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns named by `keep`, score double (0 to 1) and predicted int (1 if score >= cut), one for each row of `docs`.

    `labels` (doc_id, toxic) holds the rows that may be learned from; `most` bounds how many are used. Null and empty
    texts match no clause and get the lowest score; repeated rows are scored each; whole texts are read. The lexicon
    (seeds and learned words) and the weights are the only things sent to the workers.
    """
    keep = [c for c in keep or [] if c not in ("doc_id", "features", "score", "predicted")]
    lexicon, weights = learn(docs, labels, most)
    scored = _featured(docs, lexicon, ["doc_id", *keep])
    line = F.lit(weights[0])
    for i, w in enumerate(weights[1:]):
        line = line + F.lit(w) * F.col("features")[i]
    score = 1 / (1 + F.exp(-F.least(F.greatest(line, F.lit(-30.0)), F.lit(30.0))))
    return scored.select("doc_id", *keep, score.alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))
