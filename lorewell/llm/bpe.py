"""Byte-level BPE by a tokenisation automaton.

The automaton reads tokens and accepts exactly the token sequences that BPE gives.  It starts with
the bytes alone, in one state with a loop for each; then each merge (u, v) -> w, in order, applies a
gadget: where u leads to a state that v leaves, that state is split so that v no longer follows this
u, and an arc w is added to where v led.  After all merges a state is told by the token last read,
and an arc v is missing exactly where some gadget removed it: where a merge (x, y) could join the
end x of the token before, while x is still there, with the start y of v, while y is still there.
So a gadget's removals are the product of the tokens that end in x until a later merge and those
that begin with y until then, and an arc is looked up in the two tokens' chains of ends and of
starts (`spines`) and then kept in the transition table.

Encoding a pre-split word is deterministic in its bytes: one token only can end the tokenisation of
what has been read, so the automaton over bytes has as its state the trie places of the tokens that
may be under way, each with the token before it, and the token that ends here.  Its transitions stand
in a table that is filled as states are first reached and starts anew when it is full; encoding looks
up one entry a byte and then follows the ending tokens back; words are read in order, each from where
it parts from the one before.  Decoding emits the arcs' labels, the
tokens' bytes.

Defined cases: null text counts as empty and has no ids; a special token's string gets its id;
repeated rows are encoded alike; an empty table gives an empty result; other columns pass through,
except one named like `out`; null ids decode to an empty text, ids out of range fail.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columnar import pieces, texts
from .presplit import WordIds
from .support import numbered

_LAST = 1 << 40  # later than any merge
#: States of the byte automaton, and arcs between tokens, that are kept in their tables at once.
MOST_STATES, MOST_ARCS = 100_000, 100_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, and that byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _taken(chain: tuple[int, ...], r: int) -> tuple[int, ...]:
    """A chain of which every token is taken in by merge r at the latest."""
    return tuple(x if i % 2 == 0 else min(x, r) for i, x in enumerate(chain))


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], specials: dict[str, int]):
        letters = byte_letters()
        special = set(specials.values())
        plain = {t: i for t, i in vocab.items() if i not in special}
        self.label: list[bytes] = [b""] * (max([*vocab.values(), *special], default=-1) + 1)
        for t, i in plain.items():
            self.label[i] = bytes(letters[ch] for ch in t)
        for t, i in specials.items():
            self.label[i] = t.encode()
        self.specials = {t.encode(): i for t, i in specials.items()}
        self.rank: dict[int, int] = {}  # of a pair u << 24 | v
        # by token: its chain as ends, and as starts, of pairs (token, merge that takes it in)
        self.ends: dict[int, tuple[int, ...]] = {}
        self.starts: dict[int, tuple[int, ...]] = {}
        self.state: dict[bytes, int] = {}
        for i in plain.values():
            if len(self.label[i]) == 1:
                self.state[self.label[i]] = i
                self.ends[i] = self.starts[i] = (i, _LAST)
        for r, (a, b) in enumerate(merges):
            self._gadget(r, vocab[a], vocab[b], vocab[a + b])
        self.child: dict[int, int] = {}  # the trie of the states' labels: node << 8 | byte to node
        self.token = [-1]
        for t, i in self.state.items():
            node = 0
            for byte in t:
                after = self.child.get(node << 8 | byte)
                if after is None:
                    after = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                node = after
            self.token[node] = i
        self.size = [len(x) for x in self.label]
        self.arcs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a place is a trie node << 24 | the token before it + 1
        self.places: list[tuple[int, ...]] = [(0,)]
        self.known: dict[tuple[int, ...], int] = {self.places[0]: 0}
        self.ending = [-1]
        self.step: dict[int, int] = {}

    def _gadget(self, r: int, u: int, v: int, w: int) -> None:
        """Adds arc w for u v, with its chains; w is a state only if BPE can give it, that is if no
        earlier gadget has removed v after u."""
        self.rank.setdefault(u << 24 | v, r)
        if u not in self.ends or v not in self.starts or w in self.ends or not self._arc(u, v, r):
            return
        self.ends[w] = (w, _LAST, *_taken(self.ends[v], r))
        self.starts[w] = (w, _LAST, *_taken(self.starts[u], r))
        self.state[self.label[w]] = w

    def _arc(self, t: int, v: int, before: int = _LAST) -> bool:
        starts = self.starts[v]
        for i in range(0, len(ends := self.ends[t]), 2):
            x, dx = ends[i] << 24, ends[i + 1]
            for k in range(0, len(starts), 2):
                m = self.rank.get(x | starts[k])
                if m is not None and m < before and m < dx and m <= starts[k + 1]:
                    return False
        return True

    def arc(self, t: int, v: int) -> bool:
        """Whether v may follow t."""
        key = t << 24 | v
        ok = self.arcs.get(key)
        if ok is None:
            if len(self.arcs) >= MOST_ARCS:
                self.arcs.clear()
            ok = self.arcs[key] = self._arc(t, v)
        return ok

    def _next(self, state: int, byte: int) -> int:
        """The state after byte, entered into the table."""
        places, ends = [], -1
        for place in self.places[state]:
            after = self.child.get(place >> 24 << 8 | byte)
            if after is not None:
                before = (place & 0xFFFFFF) - 1
                places.append(after << 24 | before + 1)
                t = self.token[after]
                if t >= 0 and ends < 0 and (before < 0 or self.arc(before, t)):
                    ends = t
        if ends < 0:
            raise ValueError(f"no tokens for byte {byte}")
        places.append(ends + 1)
        key = tuple(places)
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = len(self.places)
            self.places.append(key)
            self.ending.append(ends)
        self.step[state << 8 | byte] = got
        return got

    def encode(self, word: bytes) -> list[int]:
        return self._encode([word])[0]

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word.  Words are read in order, each from where it parts from the one before."""
        out: list[list[int]] = [[]] * len(words)
        size, ending = self.size, self.ending
        before, states, last = b"", [0], []
        for i in sorted(range(len(words)), key=words.__getitem__):
            word = words[i]
            if word in self.specials:
                out[i] = [self.specials[word]]
                continue
            if len(self.places) > MOST_STATES:
                self._reset()
                ending, before, states, last = self.ending, b"", [0], []
            k, most = 0, min(len(word), len(before))
            while k < most and word[k] == before[k]:
                k += 1
            del states[k + 1 :], last[k:]
            state, step = states[k], self.step
            for byte in word[k:]:
                after = step.get(state << 8 | byte)
                state = self._next(state, byte) if after is None else after
                states.append(state)
                last.append(ending[state])
            path, p = [], len(last)
            while p:
                t = last[p - 1]
                path.append(t)
                p -= size[t]
            path.reverse()
            out[i], before = path, word
        return out

    def encode_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and their number for each word."""
        ids = self._encode(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes


def spec(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """Vocabulary, merges and special tokens of a byte-level BPE tokenizer file."""
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in read["model"]["merges"]]
    return read["model"]["vocab"], merges, {t["content"]: t["id"] for t in read["added_tokens"]}


@lru_cache(maxsize=4)
def load(path: str) -> Automaton:
    """The automaton of a byte-level BPE tokenizer file, once a process."""
    return Automaton(*spec(path))


def public_path(name: str = "byte_bpe_50k.json") -> str:
    """Where an installed public vocabulary file is; each executor asks for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _encoder(name: str) -> WordIds:
    automaton = load(public_path(name))
    return WordIds(automaton.encode_all, tuple(t.decode() for t in automaton.specials), most=150_000)


@lru_cache(maxsize=4)
def labels(name: str) -> list[bytes]:
    """The bytes of each id, which are all that decoding needs."""
    letters = byte_letters()
    vocab, _, specials = spec(public_path(name))
    special = {i: t for t, i in specials.items()}
    out = [b""] * (max([*vocab.values(), *special], default=-1) + 1)
    for t, i in vocab.items():
        if i not in special:
            out[i] = bytes(letters[ch] for ch in t)
    for i, t in special.items():
        out[i] = t.encode()
    return out


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes from one buffer."""
    if offsets[-1] >= 1 << 31:
        return pa.array([data[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class Labels:
    """Decoding: the labels of the arcs that ids name, one after another."""

    def __init__(self, vocabulary: str):
        label = labels(vocabulary)
        self.flat = np.frombuffer(b"".join(label), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in label])])

    def texts(self, tokens: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """A text for each run of tokens."""
        tokens = tokens.astype(np.int64)
        size = self.at[tokens + 1] - self.at[tokens]
        total = np.concatenate([[0], np.cumsum(size)])
        raw = self.flat[np.arange(total[-1]) + np.repeat(self.at[tokens] - total[:-1], size)].tobytes()
        cut = total[offsets].tolist()
        return pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(cut, cut[1:], strict=False)], pa.string())


def bpe_encode(docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.json", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with `out`, the ids of the text as little-endian unsigned 32-bit integers, and, if a name is
    given, `decoded`, the text that those ids decode to."""
    plain, names = numbered(docs.drop(out, *[decoded] * bool(decoded)))
    t, passed = f"c{names.index(text)}", plain.columns
    added = [T.StructField("x", T.BinaryType()), *[T.StructField("y", T.StringType())] * bool(decoded)]

    def encoded(batches):
        ids_of, emit = _encoder(vocabulary), Labels(vocabulary) if decoded else None
        for b in batches:
            for i, j in pieces(b, t):
                part = b.slice(i, j - i)
                ids, offsets = ids_of(*texts(part.column(t)))
                new = [_binary(ids.astype("<u4").view(np.uint8), 4 * offsets), *([emit.texts(ids, offsets)] if emit else [])]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*passed, *"xy"[: len(new)]])

    return plain.mapInArrow(encoded, T.StructType([*plain.schema.fields, *added])).toDF(*names, out, *[decoded] * bool(decoded))


def bpe_decode(rows: DataFrame, ids: str = "ids", vocabulary: str = "byte_bpe_50k.json", out: str = "decoded") -> DataFrame:
    """rows with `out`, the text of the ids; bytes that aren't UTF-8 become U+FFFD."""
    plain, names = numbered(rows.drop(out))
    t, passed = f"c{names.index(ids)}", plain.columns
    schema = T.StructType([*plain.schema.fields, T.StructField("x", T.StringType())])

    def decode(batches):
        emit = Labels(vocabulary)
        for b in batches:
            for i, j in pieces(b, t):
                part = b.slice(i, j - i)
                buf, offsets = texts(part.column(t))
                yield pa.RecordBatch.from_arrays([*part.columns, emit.texts(np.frombuffer(buf.tobytes(), "<u4"), offsets // 4)], names=[*passed, "x"])

    return plain.mapInArrow(decode, schema).toDF(*names, out)


def op7_query(spark, sf_dir):
    from .support import table

    done = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
