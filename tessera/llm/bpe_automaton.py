"""BPE encoding and decoding with a deterministic tokenization automaton compiled from the merge list.

Compilation starts from the one-state automaton whose arcs are the base symbols and applies one merge gadget for each
rule (u, v), in order: the state that u leads to loses its v-arc, and a new arc `uv` runs from every state that has a
u-arc to a copy of the state that v leads to. States are named by the token last read. A new state *inherits* its
out-arcs from the state of `v` and its in-arcs from the arcs of `u` as they are at that moment; storing the inheritance
(copy on write) instead of the copied arcs keeps the automaton linear in the merge list, where explicit copies would
need tens of thousands squared.

The compiled form is a handful of integer arrays, made once on the driver and broadcast: the byte transitions that spell
the arcs' labels, and the gadgets' rank, sources and cuts. From them a worker makes the automaton deterministic as far as
its words take it: the first time that an arc is tried from a state, whether it is there is worked out through the
copies, and goes into the transition table; from then on it is read from the table. The automaton accepts just the
token sequences that the merges produce, and every prefix of an accepted path is accepted, so exactly one token ends at
each byte of a word: encoding goes over the bytes once, enters that token, and reads the path off backwards. There is
no search, no replay of merges and no way around the automaton. Decoding emits the labels of the arcs taken.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .presplit import PreSplitter
from .workspace import ship, small_batches

END = "</w>"
#: Words and transitions that a worker keeps from task to task; beyond it the older half is forgotten, which costs time and changes nothing.
WORD_LIMIT, ARC_LIMIT = 400_000, 600_000


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: printable Latin-1 stays itself, the others follow from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """States are the tokens last read; state -1 is the start, which has an arc for each token.

    A step from a state reads the bytes of a label: `go` has the byte transitions (node * 256 + byte -> node, from node
    0), `mid` and `end` the arc that a node completes, inside a word and at its end.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values(), default=-1) + 1
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.size = size
        self.made = array("i", [-1]) * size  # the merge that created the state; -1: a base symbol
        self.out_of, self.into = array("i", range(size)), array("i", range(size))  # whose arcs a state copied
        self.length = array("i", [0]) * size
        self.keys, self.nodes, self.mid, self.end = array("q"), array("i"), array("i", [-1]), array("i", [-1])
        self.cut_keys, self.cut_ranks = array("q"), array("i")
        go: dict[int, int] = {}
        for token, i in vocab.items():
            spelled = token.removesuffix(END)
            if not spelled or any(c not in byte_of for c in spelled):
                continue  # not made of bytes: no word can hold it
            node = 0
            for c in spelled:
                key = node << 8 | byte_of[c]
                if key not in go:
                    go[key] = len(self.mid)
                    self.keys.append(key)
                    self.nodes.append(go[key])
                    self.mid.append(-1)
                    self.end.append(-1)
                node = go[key]
            (self.end if token.endswith(END) else self.mid)[node] = i
            self.length[i] = len(spelled)
        cut: dict[int, int] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(cut, rank, vocab[u], vocab[v], vocab[u + v])
        self.cut_keys.extend(cut)
        self.cut_ranks.extend(cut.values())
        self._open()

    def _gadget(self, cut: dict[int, int], rank: int, u: int, v: int, uv: int) -> None:
        if self.made[uv] >= 0:
            raise ValueError(f"two merges make token {uv}")
        cut.setdefault(u * self.size + v, rank)
        self.made[uv], self.out_of[uv], self.into[uv] = rank, v, u

    def _open(self) -> None:
        self.go, self.cut = dict(zip(self.keys, self.nodes, strict=True)), dict(zip(self.cut_keys, self.cut_ranks, strict=True))
        self.arcs: dict[int, bool] = {}  # the transition table as far as it is made: state * size + arc -> whether the arc leaves the state

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("go", "cut", "arcs")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self._open()

    def step(self, state: int, arc: int) -> bool:
        """Whether `arc` leaves `state` (it then leads to the state named `arc`)."""
        if state < 0:
            return True
        at = self.size + 1  # the moment, in merges, at which the arc is looked up
        made, cut, size = self.made, self.cut, self.size
        while True:
            if cut.get(state * size + arc, at) < at:
                return False
            s, t = made[state], made[arc]
            if s < 0 and t < 0:
                return True
            if t >= s:  # in-arcs were copied after the gadget's cut
                arc, at = self.into[arc], t + 1
            else:  # out-arcs were copied before it
                state, at = self.out_of[state], s

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token. Time is the bytes times the longest label, memory a number for each byte."""
        n = len(word)
        if not n:
            return []
        go, mid, arcs, size = self.go, self.mid, self.arcs, self.size
        if len(arcs) > ARC_LIMIT:
            forget_half(arcs)
        last = array("i", [-1]) * (n + 1)  # the one token that ends an accepted path here
        for start in range(n):
            state, node = last[start], 0
            if start and state < 0:
                continue
            for i in range(start, n):
                node = go.get(node << 8 | word[i])
                if node is None:
                    break
                arc = mid[node] if i + 1 < n else self.end[node]
                if arc >= 0 and last[i + 1] < 0:
                    if not start:  # the start has an arc for each token
                        last[i + 1] = arc
                        continue
                    key = state * size + arc
                    leaves = arcs.get(key)
                    if leaves is None:
                        leaves = arcs[key] = self.step(state, arc)
                    if leaves:
                        last[i + 1] = arc
        if last[n] < 0:
            raise ValueError("a byte is not in the vocabulary")
        path = []
        while n:
            path.append(last[n])
            n -= self.length[last[n]]
        return path[::-1]


def forget_half(kept: dict) -> None:
    """Drops the half of a dictionary that was entered first."""
    for old in list(islice(kept, len(kept) // 2)):
        del kept[old]


class Compiled:
    """What a tokenizer file is compiled to: the automaton, the labels of its arcs, and the file's splitting rules."""

    def __init__(self, spec: bytes):
        self.digest = zlib.crc32(spec)
        made = json.loads(spec)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in made["model"]["merges"]]
        vocab = made["model"]["vocab"]
        self.automaton = MergeAutomaton(vocab, merges)
        self.rules = json.dumps({**made, "model": {**made["model"], "vocab": {}, "merges": []}}).encode("utf-8")
        named = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in made["added_tokens"]}
        self.labels = [named.get(i, "") for i in range(max(named, default=-1) + 1)]


class _Words(dict):
    """Ids by pre-token, entered when first asked for. Very long pre-tokens are not kept."""

    def __init__(self, automaton: MergeAutomaton, specials: dict[str, int]):
        super().__init__()
        self.automaton, self.specials = automaton, specials

    def __missing__(self, word: str) -> tuple[int, ...]:
        special = self.specials.get(word)
        ids = (special,) if special is not None else tuple(self.automaton.encode(word.encode("utf-8")))
        if len(word) <= 64:
            self[word] = ids
        return ids


class WordCodec:
    """Whole texts to ids and back, with the library's normalizer, splitter and special strings."""

    def __init__(self, compiled: Compiled):
        self.automaton, self.labels = compiled.automaton, compiled.labels
        self.splitter = PreSplitter(compiled.rules)
        self.words = _Words(self.automaton, self.splitter.specials)

    def encode(self, text: str | None) -> list[int]:
        if len(self.words) > WORD_LIMIT:
            forget_half(self.words)
        return list(chain.from_iterable(map(self.words.__getitem__, self.splitter.split(text))))

    def decode(self, ids: list[int]) -> str:
        """The library joins the tokens of a file without a decoder by single spaces."""
        return " ".join(map(self.labels.__getitem__, ids))


#: Of each worker process: codecs by their file's checksum, kept from task to task.
_codecs: dict[int, WordCodec] = {}


def _codec(compiled: Compiled) -> WordCodec:
    if compiled.digest not in _codecs:
        _codecs.clear()
        _codecs[compiled.digest] = WordCodec(compiled)
    return _codecs[compiled.digest]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, decoded: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of `docs`: id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids and the decoded text.

    Null and empty texts have no tokens (digests of nothing); repeated rows are encoded each; `keep` names further
    columns to carry. Rows are independent: no shuffle, memory bounded by one Arrow batch and the worker's tables.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:
        compiled = spark.sparkContext.broadcast(Compiled(f.read()))  # as large as one tokenizer file, about 4 MB
    keep = [c for c in keep or [] if c not in (id_col, text_col)]
    rows = docs.select(id_col, *keep, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec = _codec(compiled.value)
        for batch in small_batches(batches):
            n_tokens, sha_ids, sha_text, all_ids, texts = [], [], [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                out = codec.encode(text)
                back = codec.decode(out)
                n_tokens.append(len(out))
                sha_ids.append(hashlib.sha256(np.array(out, "<u4").tobytes()).hexdigest())
                sha_text.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if ids:
                    all_ids.append(out)
                if decoded:
                    texts.append(back)
            columns = [*batch.columns[:-1], pa.array(n_tokens, pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_text, pa.string())]
            columns += [pa.array(all_ids, pa.list_(pa.int32()))] * ids + [pa.array(texts, pa.string())] * decoded
            yield pa.RecordBatch.from_arrays(columns, names)

    kept = rows.select(id_col, *keep).schema
    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [extra])
    names = [f.name for f in kept] + [x.split()[0] for x in extra.split(", ")]
    return rows.mapInArrow(run, schema)
