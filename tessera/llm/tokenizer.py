"""BPE by forced-boundary splitting, for a tokenizer file of the public `tokenizers` format with a word-end suffix.

White space is dropped by the vocabulary's own rules and never inside a token, so a text falls apart into chunks without
it. A chunk is normalised (NFC, then each character lower-cased) and split into words by the file's pattern. Within a
word, a pair of bytes that occurs in no vocabulary token (at a word's end: with the suffix) can never be merged across,
so it marks a certain cut; the fragments between the cuts are encoded independently and concatenated. A fragment within a
word goes through the vocabulary's merges without the suffix, the last one of a word with it. Chunks recur, so ChunkCoder
finds and hashes them with numpy, encodes each distinct one once and gathers the ids; a worker remembers REMEMBERED chunks
at most and keeps those in use when it forgets. The bytes of a chunk are compared with those remembered, so equal hashes
of different chunks do no harm.

Decoding without a decoder in the file joins the tokens' strings by one space.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .common import EXACT, HELD, SPACES, buffers, release, spans

#: Distinct chunks that a worker remembers, some 60 bytes each, and bytes of text that it works on at a time.
REMEMBERED, PIECE = 300_000, 1 << 20
#: Fragments whose ids a worker remembers, some 200 bytes each.
FRAGMENTS = 100_000
#: What may follow a word in a chunk that is split without the pattern: runs of ASCII marks are one word, but for contractions.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> list[str]:
    """The visible letter for each byte: itself where it is printable, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


class ForcedBoundaryBpe:
    """encode(text) -> list of ids, decode(ids) -> text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:  # a vocabulary installed on every machine, not a table
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters = byte_letters()
        self.to_letters, self.to_bytes = dict(enumerate(letters)), {ord(x): i for i, x in enumerate(letters)}
        library = Tokenizer.from_file(path)
        self.within, self.ending = BPE(vocab=self.vocab, merges=merges), library.model
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # pairs of bytes inside tokens, and pairs of which the second byte ends a word
        self.inner, self.last = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        for token in self.vocab:
            ends = bool(self.end) and token.endswith(self.end) and token != self.end
            body = (token.removesuffix(self.end) if ends else token).translate(self.to_bytes).encode("latin-1", "ignore")
            pairs = [(a << 8) + b for a, b in zip(body, body[1:])]
            self.inner[pairs] = True
            if ends:
                self.last[pairs[-1:]] = True
        self.memory: tuple[dict[str, list[int]], dict[str, list[int]]] = {}, {}

    def split(self, chunk: str) -> list[bytes]:
        """The chunk's normalised words. Letters from U+0250 on, whose classes differ between versions of Unicode, are
        normalised and split by the library's own tables."""
        if max(chunk, default="") >= "\u0250":
            return [w.translate(self.to_bytes).encode("latin-1") for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]
        low = chunk.lower()
        return [low.encode()] if low.isalpha() else [w.encode() for w in self.words.findall(unicodedata.normalize("NFC", chunk).lower())]

    def fragment(self, text: str, ends: bool) -> list[int]:
        """The ids of a fragment, whose bytes are the characters of text; ends: it ends a word."""
        memory = self.memory[ends]
        if len(memory) >= FRAGMENTS:
            memory.clear()
        memory[text] = out = [t.id for t in (self.ending if ends else self.within).tokenize(text.translate(self.to_letters))]
        return out

    def chunks(self, chunks: list[str]) -> tuple[list[int], np.ndarray]:
        """The ids of many chunks without special tokens, and how many each has."""
        words: list[bytes] = []
        upto = [0]
        for c in chunks:
            if c.isascii() and c.isalpha():
                words.append(c.lower().encode())
            else:
                words += self.split(c)
            upto.append(len(words))
        raw = b"".join(words)
        if not raw:
            return [], np.zeros(len(chunks), np.int64)
        data, size = np.frombuffer(raw, np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        pair = (data[:-1].astype(np.int64) << 8) + data[1:]
        cut = np.append(~self.inner[pair], True)  # after each byte
        two = end[size > 1] - 2
        cut[two] = ~self.last[pair[two]]
        cut[end - 1] = True
        stop = np.flatnonzero(cut) + 1
        ends = np.zeros(len(data) + 1, bool)
        ends[end] = True
        text, (within, ending), a, found = raw.decode("latin-1"), self.memory, 0, []
        for b, e in zip(stop.tolist(), ends[stop].tolist(), strict=True):
            ids = (ending if e else within).get(text[a:b])
            found.append(self.fragment(text[a:b], e) if ids is None else ids)
            a = b
        count = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        first = np.searchsorted(stop, np.concatenate([[0], end])[upto], "right")  # fragments before each chunk
        return [t for x in found for t in x], np.diff(count[first])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.specials.split(text):
            out += [self.special[part]] if part in self.special else self.chunks([part])[0]
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids if i in self.names)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


#: ASCII letters 1, marks but for the apostrophe 2, digits 3; other bytes 0. Between two bytes of different kinds, or two digits,
#: the vocabulary's pattern always splits, and no token holds such a pair: a certain cut.
KINDS = np.zeros(256, np.uint8)
KINDS[[ord(c) for c in MARKS if c != "'"]] = 2
KINDS[48:58], KINDS[65:91], KINDS[97:123] = 3, 1, 1


class ChunkCoder:
    """ids(column) -> (ids of all rows, the rows' bounds in them). Chunks lie between ASCII white space and certain cuts; a
    piece that holds the string of a special token is encoded text by text."""

    def __init__(self, bpe: ForcedBoundaryBpe):
        self.bpe, self.special = bpe, [x.encode() for x in bpe.special]
        self.hash, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in order of hash, and each one's place in what follows
        self.head, self.size, self.at, self.uses = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.id_at, self.id_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.blob, self.tokens = np.zeros(0, np.uint8), np.zeros(0, np.int32)  # bytes beyond the eighth; ids

    def _forget(self) -> None:
        """Keeps the chunks that more than one piece used, the most used half at most."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > REMEMBERED // 2:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: REMEMBERED // 2]])
        new = np.full(len(self.uses), -1)
        new[keep] = np.arange(len(keep))
        use = new[self.slot] >= 0
        self.hash, self.slot = self.hash[use], new[self.slot[use]]
        self.blob, self.tokens = self.blob[ranges(self.at[keep], np.maximum(self.size[keep] - 8, 0))], self.tokens[ranges(self.id_at[keep], self.id_n[keep])]
        self.head, self.size, self.uses, self.id_n = self.head[keep], self.size[keep], np.ones(len(keep), np.int64), self.id_n[keep]
        rest = np.maximum(self.size - 8, 0)
        self.at, self.id_at = np.cumsum(rest) - rest, np.cumsum(self.id_n) - self.id_n

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, head: np.ndarray, h: np.ndarray) -> None:
        """New distinct chunks, in order of hash."""
        raw = data.tobytes()
        found, count = self.bpe.chunks([raw[a : a + n].decode() for a, n in zip(start.tolist(), size.tolist(), strict=True)])
        rest = np.maximum(size - 8, 0)
        self.slot = np.insert(self.slot, np.searchsorted(self.hash, h), len(self.uses) + np.arange(len(h)))
        self.hash = np.insert(self.hash, np.searchsorted(self.hash, h), h)
        self.at, self.id_at = np.concatenate([self.at, len(self.blob) + np.cumsum(rest) - rest]), np.concatenate([self.id_at, len(self.tokens) + np.cumsum(count) - count])
        self.blob = np.concatenate([self.blob, data[ranges(start + 8, rest)]])
        self.tokens = np.concatenate([self.tokens, np.array(found, np.int32)])
        self.head, self.size, self.id_n = np.concatenate([self.head, head]), np.concatenate([self.size, size]), np.concatenate([self.id_n, count])
        self.uses = np.concatenate([self.uses, np.zeros(len(h), np.int64)])

    def _by_text(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = [self.bpe.encode(v or "") for v in column.to_pylist()]
        return np.array([t for r in rows for t in r], np.int32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = buffers(column)
        padded = np.concatenate([data[: int(bounds[-1])], np.zeros(8, np.uint8)])
        raw = padded[int(bounds[0]) :].tobytes()
        if any(x in raw for x in self.special):
            return self._by_text(column)
        start, end, h = spans(data, bounds, SPACES, EXACT, kinds=KINDS)
        size = end - start
        head = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))[start]  # the first eight bytes of each chunk
        head &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(size, 8)) * 8).astype(np.uint64)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.uses) + len(distinct) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.hash, distinct)
        new = np.ones(len(distinct), bool) if not len(self.hash) else self.hash[np.minimum(at, len(self.hash) - 1)] != distinct
        if new.any():
            self._learn(padded, start[first[new]], size[first[new]], head[first[new]], distinct[new])
            at = np.searchsorted(self.hash, distinct)
        own = self.slot[at]
        self.uses[own] += 1
        slot = own[back]
        long = np.flatnonzero(size > 8)
        same = (self.size[slot] == size).all() and (self.head[slot] == head).all()
        rest = size[long] - 8
        if not same or not (padded[ranges(start[long] + 8, rest)] == self.blob[ranges(self.at[slot[long]], rest)]).all():  # two chunks with one hash
            return self._by_text(column)
        count = self.id_n[slot]
        upto = np.concatenate([[0], np.cumsum(count)])
        return self.tokens[ranges(self.id_at[slot], count)], upto[np.searchsorted(start, bounds)]


class Strings:
    """The strings of ids, joined by one space within each row, without a Python object for each."""

    def __init__(self, names: dict[int, str]):
        parts = [f"{names[i]} ".encode() if i in names else b"" for i in range(max(names) + 1)]
        self.size = np.array([len(x) for x in parts], dtype=np.int64)
        self.at, self.blob = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(parts), np.uint8)

    def joined(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        n = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(n)])[bounds].tolist()
        out = memoryview(self.blob[ranges(self.at[ids], n)].tobytes())
        return [out[a : max(a, b - 1)] for a, b in zip(upto, upto[1:])]


_WORKER: dict[str, tuple] = {}
HELD.append(_WORKER)


def worker_bpe(path: str) -> tuple[ForcedBoundaryBpe, ChunkCoder, Strings, Strings]:
    """This Python worker's encoder of a vocabulary with what it remembers from earlier tasks, the decimal strings of the
    ids, and the tokens' strings. One vocabulary at a time."""
    if path not in _WORKER:
        release()  # also what this worker kept of other operators
        bpe = ForcedBoundaryBpe(path)
        _WORKER[path] = bpe, ChunkCoder(bpe), Strings({i: str(i) for i in bpe.names}), Strings(bpe.names)
    return _WORKER[path]
