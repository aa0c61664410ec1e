"""Language identification with blended-spectrum presence kernels, Nystroem landmarks and one-versus-rest kernel ridge regression.

k(x, y) = |S(x) & S(y)| / sqrt(|S(x)| |S(y)|), where S(x) is the set of character n-grams of x for n = 1 .. N (the blended
spectrum) that some landmark has; restricting the sets to those keeps k a kernel and bounds the model. Regression runs on
the kernel values against the landmarks; its solution is linear in the presence vector of a text, so a batch of texts is
scored by one product of its presence matrix with an (n-grams x languages) matrix.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import uniform
from .workspace import ship, small_batches

#: Code points after which a batch of texts is cut; presence matrices hold at most this many cells.
CUT_CHARS, CUT_CELLS = 1_500_000, 16_000_000
_letters = None


def letter_table():
    """For each code point, whether it is a letter."""
    import numpy as np

    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def letters_of(texts: list[str]):
    """(codes, doc, has_letter): lower-case letters of all texts, each run of other characters one space, texts parted by 0."""
    import numpy as np

    flat = "\x00".join(t.lower().replace("\x00", " ") for t in texts) + "\x00"
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = codes == 0
    letter = letter_table()[codes]
    codes = np.where(letter, codes, np.where(ends, 0, 32))
    doc = np.cumsum(ends) - ends
    has = np.zeros(len(texts), bool)
    has[doc[letter]] = True
    keep = np.ones(len(codes), bool)
    keep[1:] = ~((codes[1:] == 32) & (codes[:-1] == 32))
    return codes[keep], doc[keep], has


class Spectrum:
    """The n-grams of the landmarks, numbered, over their alphabet."""

    def __init__(self, texts: list[str], most: int = 3):
        import numpy as np

        codes, _, _ = letters_of(texts)
        self.most = most
        self.alphabet = np.unique(codes[codes > 0])
        self.grams = [np.unique(self._keys(codes, n)[0]) for n in range(1, most + 1)]
        self.starts = np.cumsum([0, *map(len, self.grams)])
        self.size = int(self.starts[-1])

    def _keys(self, codes, n: int):
        """Keys of the n-grams of letters known to the alphabet, and where they begin."""
        import numpy as np

        if not len(self.alphabet):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.alphabet, codes) if len(self.alphabet) > 60_000 else self._table()[np.minimum(codes, len(self._table()) - 1)]
        if len(self.alphabet) > 60_000:
            at = np.where((at < len(self.alphabet)) & (self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == codes), at + 1, 0)
        base = len(self.alphabet) + 1
        m = max(len(at) - n + 1, 0)
        key, ok = at[:m].astype(np.int64), at[:m] > 0
        for i in range(1, n):
            key = key * base + at[i : i + m]
            ok &= at[i : i + m] > 0
        where = np.flatnonzero(ok)
        return key[where], where

    def _table(self):
        import numpy as np

        if not hasattr(self, "_codes"):
            self._codes = np.zeros(int(self.alphabet.max()) + 2, np.int32)
            self._codes[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return self._codes

    def _find(self, n: int, keys):
        """(numbers, found) of n-gram keys."""
        import numpy as np

        grams, base = self.grams[n - 1], len(self.alphabet) + 1
        if base**n <= 20_000_000:
            if not hasattr(self, "_dense"):
                self._dense: dict[int, object] = {}
            if n not in self._dense:
                self._dense[n] = np.full(base**n, -1, np.int32)
                self._dense[n][grams] = np.arange(len(grams)) + self.starts[n - 1]
            got = self._dense[n][keys]
            return got, got >= 0
        at = np.minimum(np.searchsorted(grams, keys), max(len(grams) - 1, 0))
        return at + self.starts[n - 1], grams[at] == keys if len(grams) else np.zeros(len(keys), bool)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_codes", "_dense")}

    def presence(self, texts: list[str]):
        """(presence matrix float32, whether a text has a letter)."""
        import numpy as np

        codes, doc, has = letters_of(texts)
        out = np.zeros((len(texts), self.size), np.float32)
        for n in range(1, self.most + 1):
            keys, where = self._keys(codes, n)
            numbers, found = self._find(n, keys)
            out[doc[where[found]], numbers[found]] = 1.0
        return out, has

    def batches(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
        """Row numbers and texts, cut so that letters and presence cells stay bounded."""
        rows, part, chars = [], [], 0
        most = max(1, CUT_CELLS // max(1, self.size))
        for i, t in enumerate(texts):
            rows.append(i)
            part.append(t or "")
            chars += len(t or "")
            if chars >= CUT_CHARS or len(rows) >= most:
                yield rows, part
                rows, part, chars = [], [], 0
        if rows:
            yield rows, part


class Model:
    def __init__(self, languages: list[str], spectrum: Spectrum, weights):
        self.languages, self.spectrum, self.weights = languages, spectrum, weights


def fit(rows: DataFrame, per_language: int = 1500, landmarks: int = 128, ridge: float = 1e-3, seed: int = 3) -> Model | None:
    """A model from (doc_id, text, lang) rows that may be learned from; None if none has a language and a text.

    Every language is learned. Bounded: about `per_language` rows of each by a hash of the id, and `landmarks` texts in
    all (two a language, if that is more) of at most 20,000 characters. Kernel values of the sample come to the driver, no texts but
    the landmarks.
    """
    import numpy as np

    spark = rows.sparkSession
    ship(spark)
    rows = rows.where("lang is not null and text is not null and text <> ''").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    u = uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    def sampled(n: float) -> DataFrame:
        shares = spark.createDataFrame([(k, min(1.0, n / v)) for k, v in counts.items()], "lang string, share double")
        return rows.withColumn("u", u).join(F.broadcast(shares), "lang").where(F.col("u") < F.col("share"))

    each = max(2, landmarks // len(languages))
    near = sampled(3.0 * each).where("length(text) <= 20000").select("lang", "text", "u").orderBy("u").limit(4 * each * len(languages)).collect()
    marks, had = [], dict.fromkeys(languages, 0)
    for r in sorted(near, key=lambda r: (len(r["text"]) < 200, r["u"])):
        if had[r["lang"]] < each:
            had[r["lang"]] += 1
            marks.append(r["text"])
    if not marks:
        return None
    spectrum = Spectrum(marks)
    if not spectrum.size:
        return None
    marked, _ = spectrum.presence(marks)
    scaled = marked / np.sqrt(np.maximum(marked.sum(1, keepdims=True), 1))  # one row for each landmark
    sent = spark.sparkContext.broadcast((spectrum, scaled))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, scaled = sent.value
        for batch in small_batches(batches, 1024):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows_, part in spectrum.batches(texts):
                f, _ = spectrum.presence(part)
                k = (f @ scaled.T) / np.sqrt(np.maximum(f.sum(1, keepdims=True), 1))
                yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in rows_], pa.string()), pa.array([x.astype("<f4").tobytes() for x in k], pa.binary())], ["lang", "k"])

    got = sampled(float(per_language)).select("lang", "text").mapInArrow(kernel, "lang string, k binary").collect()
    if not got:
        return None
    k = np.array([np.frombuffer(r["k"], "<f4") for r in got], float)
    at = {x: i for i, x in enumerate(languages)}
    y = np.full((len(got), len(languages)), -1.0)
    y[np.arange(len(got)), [at[r["lang"]] for r in got]] = 1.0
    n = Counter(r["lang"] for r in got)
    own = np.array([1.0 / max(1, n[x]) for x in languages])[[at[r["lang"]] for r in got]][:, None]  # languages weigh alike
    own *= len(got) / len(languages)
    among = (scaled @ scaled.T).astype(float)
    beta = np.linalg.solve((k * own).T @ k + ridge * len(got) * (among + 1e-6 * np.eye(len(among))), (k * own).T @ y)
    return Model(languages, spectrum, (scaled.T.astype(float) @ beta).astype(np.float32))


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred string and score double (0 to 1), one row for each row of `docs`.

    Only `text` is read for a prediction, in whole. Null texts and texts without a letter are `und` with score 0, and so
    is all if there is no model; a text that shares no n-gram with a landmark gets the first language with score 0.
    Ties go to the first language in sorted order. The model (languages x landmark n-grams) is bounded and broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    names = [*keep, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = sent.value
        for batch in small_batches(batches, 1024):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            if model is not None:
                for rows, part in model.spectrum.batches(texts):
                    f, has = model.spectrum.presence(part)
                    n = f.sum(1, keepdims=True)
                    g = (f @ model.weights) / np.sqrt(np.maximum(n, 1))
                    e = np.exp(4 * (g - g.max(1, keepdims=True)).astype(float))
                    p, best = e.max(1) / e.sum(1), g.argmax(1)
                    for j, i in enumerate(rows):
                        if has[j]:
                            langs[i], scores[i] = model.languages[best[j]], float(p[j]) if n[j, 0] else 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    rows = docs.select(*keep, "text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + ["lang_pred string", "score double"])
    return rows.mapInArrow(run, schema)
