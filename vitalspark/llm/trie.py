"""Byte-level BPE over a trie of distinct words: every prefix keeps its last token and its ids.

A sequence of tokens is what the merges make of its bytes exactly when every two neighbours are
what the merges make of the two alone. So each prefix of a text has one last token: the only
token that ends there and agrees with the last token of what comes before it. Going down a trie,
that token follows from the states above, and words with a common prefix share them.
"""

from __future__ import annotations

import json
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitalspark.llm.common import blocks, body, map_arrow, utf8
from vitalspark.llm.words import LONG_WORD, REMEMBERED, WordEncoder, byte_letters

NEVER = 1 << 40
#: Ids of prefixes are kept down to this depth; below it a word's tokens are read off backwards.
DEEP = 256
#: Pairs of tokens that a worker remembers.
PAIRS = 2_000_000
#: Punctuation that is one piece after letters; an apostrophe may begin a contraction.
MARKS = string.punctuation.replace("'", "")


def read_spec(path: str) -> str:
    """The tokenizer file; one of another kind than plain byte-level BPE is refused."""
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    told = json.loads(spec)
    model, before = told["model"], told["pre_tokenizer"] or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
           if model.get(k)]
    odd += [k for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t[k]]
    plain = (model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
             and not before["add_prefix_space"] and told["normalizer"] is None)
    if odd or not plain:
        raise ValueError(f"not a plain byte-level BPE file: {odd}")
    return spec


class Vocabulary:
    """Bytes of every id, and the merges."""

    def __init__(self, spec: str):
        told = json.loads(spec)
        value = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        ids = told["model"]["vocab"]
        self.pieces = {i: bytes(value[c] for c in t) for t, i in ids.items() if t not in self.special}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.text_of = self.pieces | {i: t.encode() for t, i in self.special.items()}


class Trie:
    """Ids of distinct words by a depth-first walk over their prefixes.

    Tokens that end at a prefix come from an automaton over all tokens, whose steps are
    remembered, as are answers for pairs of tokens.
    """

    def __init__(self, words: Vocabulary):
        self.rank = {pair: rank for pair, (rank, _) in words.merges.items()}
        self.single = {p[0]: i for i, p in words.pieces.items() if len(p) == 1}
        # the tokens at a token's left and right edge as it grows, and the rank that takes each up
        self.left = {i: ((i,), (NEVER,)) for i in self.single.values()}
        self.right = dict(self.left)
        self.length = {i: 1 for i in self.single.values()}
        for (a, b), (rank, made) in words.merges.items():
            if a not in self.left or b not in self.left or not self._meet(a, b, rank):
                continue  # the bytes of this token never become it
            if made in self.left:
                raise ValueError("two merges make one token")
            (x, up), (y, down) = self.left[a], self.right[b]
            self.left[made] = (*x, made), (*up[:-1], rank, NEVER)
            self.right[made] = (*y, made), (*down[:-1], rank, NEVER)
            self.length[made] = self.length[a] + self.length[b]
        self.ids = {i: np.array([i], "<u4").tobytes() for i in self.left}
        # for every token, the tokens asked about so far: may they stand before it?
        self.fits: dict[int, dict[int, bool]] = {i: {} for i in self.left}
        self.answers = 0
        self._automaton({words.pieces[i]: i for i in self.left})

    def _meet(self, a: int, b: int, before: int = NEVER) -> bool:
        """Do the merges below ``before`` leave ``a`` and ``b`` apart, side by side?

        The tokens at the boundary grow from single bytes. The boundary holds if, at every
        stage, one of its tokens is taken up on its own side before the two could merge; of
        equal ranks the leftmost merge goes first.
        """
        (xs, up), (ys, down) = self.right[a], self.left[b]
        i = j = 0
        while True:
            rank, x, y = self.rank.get((xs[i], ys[j]), NEVER), up[i], down[j]
            if rank < min(x, before) and rank <= y:
                return False
            if x == y == NEVER:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def _automaton(self, tokens: dict[bytes, int]) -> None:
        self.step: dict[int, int] = {}
        token = [-1]
        for piece, i in tokens.items():
            at = 0
            for byte in piece:
                to = self.step.get(at << 8 | byte)
                if to is None:
                    to = self.step[at << 8 | byte] = len(token)
                    token.append(-1)
                at = to
            token[at] = i
        self.fail = [0] * len(token)
        self.ends: list[tuple] = [()] * len(token)
        below: dict[int, list[int]] = {}
        for key in self.step:
            below.setdefault(key >> 8, []).append(key)
        level = [0]
        while level:
            deeper = []
            for at in level:
                for key in below.get(at, ()):
                    to = self.step[key]
                    if at:
                        self.fail[to] = self._go(self.fail[at], key & 255)
                    i = token[to]
                    own = ((i, self.length[i], self.fits[i]),) if i >= 0 else ()
                    self.ends[to] = own + self.ends[self.fail[to]]
                    deeper.append(to)
            level = deeper

    def _go(self, at: int, byte: int) -> int:
        to = self.step.get(at << 8 | byte)
        if to is None:
            to = self._go(self.fail[at], byte) if at else 0
            self.step[at << 8 | byte] = to
        return to

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of distinct words in ascending order."""
        if self.answers > PAIRS:
            self.answers = 0
            for known in self.fits.values():
                known.clear()
        step, ends, ids = self.step, self.ends, self.ids
        most = max(map(len, words), default=0) + 1
        state, last, known = [0] * most, [-1] * most, [b""] * min(most, DEEP + 1)
        out, word = [], b""
        for w in words:
            d, n = 0, min(len(w), len(word))
            while d < n and w[d] == word[d]:
                d += 1
            word = w
            at = state[d]
            for byte in w[d:]:
                d += 1
                to = step.get(at << 8 | byte)
                at = self._go(at, byte) if to is None else to
                for token, n, fits in ends[at]:
                    if n == d:
                        break
                    before = last[d - n]
                    fit = fits.get(before)
                    if fit is None:
                        fit = fits[before] = self._meet(before, token)
                        self.answers += 1
                    if fit:
                        break
                else:
                    raise ValueError("no token ends here")
                state[d] = at
                last[d] = token
                if d <= DEEP:
                    known[d] = known[d - n] + ids[token]
            if d <= DEEP:
                out.append(known[d])
                continue
            tail = []
            while d > DEEP:
                tail.append(ids[last[d]])
                d -= self.length[last[d]]
            out.append(b"".join((known[d], *reversed(tail))))
        return out


class Encoder:
    """Ids of texts. Words a worker remembers only save time."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        words = Vocabulary(spec)
        self.trie, self.special = Trie(words), words.special
        self.cut = Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.value = str.maketrans({c: chr(b) for b, c in enumerate(byte_letters())})
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[bytes]:
        """The library's own cut of a text."""
        return [p.translate(self.value).encode("latin-1") for p, _ in self.cut(text)]

    def _unit(self, unit: str) -> list[bytes]:
        """Pieces of a unit: letters and the marks after them are one each, others go to the library."""
        feed = unit[:1] == "\n"
        core = (unit[1:] if feed else unit).rstrip(MARKS)
        if core.isalpha() and max(core) < "ɐ":
            after = unit[feed + len(core):].encode()
            found = [b"\n", core.encode()] if feed else [b" " + core.encode()]
            return [*found, after] if after else found
        return self._pieces(unit if feed else " " + unit)

    def encode(self, texts: list[str]) -> list[bytes]:
        """A text is cut where a space or a line feed stands alone between words, which no piece
        crosses; texts with other white space are one unit. Special tokens' texts stand alone."""
        spans, owner = [], []
        for k, t in enumerate(texts):
            parts = self.marks.split(t) if self.marks is not None and self.marks.search(t) else (t,)
            spans += parts
            owner += [k] * len(parts)
        split, whole = [], []
        for t in spans:
            if t in self.special or not t:
                split.append(None)
                whole.append([])
            elif WordEncoder._side_by_side(t):
                split.append(None)
                whole.append(self._pieces(t))
            else:
                split.append(("\n" + t.replace("\n", " \n")).split(" "))
        if len(self.units) > REMEMBERED:
            self.older, self.units = self.units, {}
        units, older, ids_of, new = self.units, self.older, {}, {}
        for u in set().union(*(u for u in split if u is not None)):
            found = units.get(u)
            if found is None:
                found = older.get(u)
                if found is None:
                    new[u] = self._unit(u)
                    continue
                units[u] = found
            ids_of[u] = found
        known = {}
        for p in set().union(*new.values(), *whole, [b"\n"]):
            # a word without its mark may be remembered
            known[p] = units.get(p[1:].decode()) if p[:1] == b" " and p[1:].isalpha() else None
        pieces = sorted(p for p, found in known.items() if found is None)
        known.update(zip(pieces, self.trie.encode(pieces), strict=True))
        for u, p in new.items():
            found = ids_of[u] = known[p[0]] if len(p) == 1 else b"".join([known[x] for x in p])
            if len(u) <= LONG_WORD:
                units[u] = found
        skip, rest, take = len(known[b"\n"]), iter(whole), ids_of.__getitem__
        out: list[list[bytes]] = [[] for _ in texts]
        for k, t, u in zip(owner, spans, split, strict=True):
            if u is not None:
                out[k].append(b"".join(map(take, u))[skip:])
            elif t in self.special:
                next(rest)
                out[k].append(np.array([self.special[t]], "<u4").tobytes())
            else:
                out[k].append(b"".join([known[p] for p in next(rest)]))
        return [p[0] if len(p) == 1 else b"".join(p) for p in out]


_encoders: dict[int, Encoder] = {}
_decoders: dict[int, dict[int, bytes]] = {}


def _held(held: dict, spec: str, make):
    """The worker's object for a tokenizer; one of a kind is held at a time."""
    key = hash(spec)
    if key not in held:
        held.clear()
        held[key] = make(spec)
    return held[key]


def encode_texts(docs: DataFrame, spec: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit) of every whole text, one row per row.

    ``spec`` comes from ``read_spec``. Texts of special tokens become their ids. A null or empty
    text has no ids; null and repeated ids of documents stay as they are; other columns play no
    part. No shuffle: each batch walks the trie of those of its distinct words that the worker
    doesn't remember. The time of a long text is in proportion to its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def encode(batch: pa.RecordBatch):
        words = _held(_encoders, shared.value, Encoder)
        _, offsets = utf8(batch.column("text"))
        for lo, hi in blocks(offsets, 6 << 20):
            ids = words.encode(batch.column("text")[lo:hi].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[lo:hi], pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return map_arrow(body(docs), encode, "doc_id long, n_tokens long, ids binary")


def decode_ids(rows: DataFrame, spec: str) -> DataFrame:
    """The rows ``doc_id, n_tokens, ids`` with ``decoded``: the text of the ids, special tokens too.

    Bytes that are no UTF-8 become U+FFFD; an unknown id is an error.
    """
    shared = rows.sparkSession.sparkContext.broadcast(spec)

    def decode(batch: pa.RecordBatch):
        piece = _held(_decoders, shared.value, lambda s: Vocabulary(s).text_of).__getitem__
        data, offsets = utf8(batch.column("ids"))
        for lo, hi in blocks(offsets, 4 << 20):
            ids = np.frombuffer(data[offsets[lo]:offsets[hi]].tobytes(), "<u4").tolist()
            o = ((offsets[lo:hi + 1] - offsets[lo]) // 4).tolist()
            found = [b"".join(map(piece, ids[a:b])).decode("utf-8", "replace")
                     for a, b in zip(o[:-1], o[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c)[lo:hi] for c in ("doc_id", "n_tokens", "ids")),
                 pa.array(found, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return map_arrow(rows.select("doc_id", "n_tokens", "ids"), decode,
                     "doc_id long, n_tokens long, ids binary, decoded string")
