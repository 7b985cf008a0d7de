"""Encoding with the public tokenizers, and token counts at every prefix.

A byte-level BPE never merges across the pieces its splitting pattern makes, so a text's ids are its pieces' ids in a
row. For ids, texts with characters outside Latin, with control characters or with a special token's string go to the vocabulary's own
library; all others to a faster one. Counts are made here for all texts, piece by piece, with a bounded cache per worker.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa

# The splitting patterns of the two vocabularies, for texts in the plain range below.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_DIGIT = "0-9²³¹¼-¾"
_BYTE_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_DIGIT}{_LETTER}]+|\s+(?!\S)|\s+")
_WORD_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTER}]+|[{_DIGIT}]|[^\s{_DIGIT}{_LETTER}]+")
#: Kinds of plain characters in word pieces: 0 white space, 1 letters, 2 digits, 3 all others.
_KINDS = np.array([0 if c.isspace() else 1 if re.match(f"[{_LETTER}]", c) else 2 if re.match(f"[{_DIGIT}]", c) else 3 for c in map(chr, range(0x180))], np.uint8)
_NOT_PLAIN = re.compile("[^\t-\r\x20-\x7e\xa1-ſ]")
_SPECIAL = re.compile(r"<\|(?:start|end)oftext\|>")

MAX_CACHED = 400_000
#: Words whose ids a worker keeps in each of two generations, none of more characters than this; characters split at once.
MAX_WORDS, LONG_WORD, AT_ONCE = 150_000, 64, 1 << 21


def vocabulary_path(name: str) -> str:
    """A vocabulary file: a path as it is, else the name of an installed public tokenizer."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


class LibraryEncoder:
    """A vocabulary's own library: ``encode(text)`` gives a whole text's ids as little-endian bytes."""

    def __init__(self, name: str, dtype: str = "<u4"):
        self.tok, self.dtype = tokenizer(name), dtype

    def encode(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        return map(self.encode, texts)


class RankEncoder:
    """The same ids from the same vocabulary as a file of ranks, which its library applies to a whole text at once.

    For texts in the plain range only, where both libraries split alike; all others go to the vocabulary's own library.
    """

    def __init__(self, name: str, ranks: str, dtype: str = "<u4"):
        import tiktoken

        self.tok, self.dtype = tokenizer(name), dtype
        with open(vocabulary_path(ranks), "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    def encode(self, text: str) -> bytes:
        if _NOT_PLAIN.search(text) or "<|" in text and _SPECIAL.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype(self.dtype).tobytes()

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        return map(self.encode, texts)


class WordEndEncoder:
    """Ids of a vocabulary with word ends, by the same merges as ranks over bytes.

    A mark byte that no plain text holds stands for the word end. Joining a word's last byte with the mark comes first, then the
    vocabulary's merges in their order. The tests hold the ids against the vocabulary's own library, which encodes all texts outside
    the plain range.
    """

    MARK = "\x01"

    def __init__(self, name: str, dtype: str = "<u4"):
        import json

        import tiktoken

        self.tok, self.dtype = tokenizer(name), dtype
        ids = self.tok.get_vocab()
        with open(vocabulary_path(name), encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        shown = byte_letters()
        back = {chr(c): bytes([b]) for b, c in shown.items()}
        raw = lambda token: b"".join(back[c] for c in token.removesuffix("</w>")) + b"\x01" * token.endswith("</w>")
        order = [chr(shown[b]) for b in range(256)] + [chr(shown[b]) + "</w>" for b in range(256)]
        order += ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        ranks, self.ids = {}, []
        for token in order:
            if (key := raw(token)) not in ranks:
                ranks[key] = len(ranks)
                self.ids.append(ids[token])
        self.ids, self.ends = np.array(self.ids, dtype), np.array([k.endswith(b"\x01") for k in ranks])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ranks = tiktoken.Encoding("ends", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text. Plain ones are split and looked up together, some ``AT_ONCE`` characters at a time."""
        todo, size = [], 0
        for text in texts:
            todo.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield from self._group(todo)
                todo, size = [], 0
        yield from self._group(todo)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        lower = [None if _NOT_PLAIN.search(t) or "<|" in t and _SPECIAL.search(t) else t.lower() for t in texts]
        # U+0130 lower-cases to two characters; the plain range then no longer holds.
        lower = [None if t is None or "\u0307" in t else t for t in lower]
        found = iter(self._plain([t for t in lower if t is not None]))
        for text, t in zip(texts, lower, strict=True):
            yield next(found) if t is not None else np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of lower-cased texts in the plain range: the distinct pieces of all of them are looked up once."""
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-16-le"), "<u2")
        starts, inside = word_starts(codes)
        if not len(starts):
            return [b""] * len(texts)
        offsets = np.append(np.cumsum(inside)[starts] - 1, np.count_nonzero(inside)) * codes.itemsize
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(codes[inside])]).dictionary_encode()
        words = pieces.dictionary
        ends, text = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1] // codes.itemsize, words.buffers()[2].to_pybytes().decode("utf-16-le")
        ids = pa.array(self._ids_of([text[a:b] for a, b in pairwise(ends.tolist())]), pa.large_binary()).take(pieces.indices)
        upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        ends, data = np.frombuffer(ids.buffers()[1], np.int64)[upto].tolist(), memoryview(ids.buffers()[2])
        return [bytes(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of different words. Those not seen lately are encoded together, each up to the token that ends in the mark.

        Words are kept in two generations: those still in use move from the older into the younger, the rest go with the older.
        """
        if len(self.known) > MAX_WORDS:
            self.known, self.older = {}, self.known if len(self.known) <= 2 * MAX_WORDS else {}
        known, older, new = self.known, self.older, []
        out = list(map(known.get, words))
        for i in [i for i, x in enumerate(out) if x is None]:
            if words[i] in older:
                out[i] = known[words[i]] = older[words[i]]
            else:
                new.append(i)
        if new:
            found = self.ranks.encode_to_numpy(self.MARK.join([words[i] for i in new]) + self.MARK, disallowed_special=())
            raw, ends = self.ids[found].tobytes(), ((np.flatnonzero(self.ends[found]) + 1) * self.ids.itemsize).tolist()
            for i, (a, b) in zip(new, pairwise([0, *ends]), strict=True):
                out[i] = raw[a:b]
            known.update((words[i], out[i]) for i in new if len(words[i]) <= LONG_WORD)
        return out


def word_starts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of ``_WORD_PIECES`` begin in lower-cased plain text that ends in white space, and which characters are in pieces.

    A piece is a run of one kind of character or a single digit. An apostrophe by itself takes an ending like 's or 're with it.
    """
    kind = _KINDS[codes]
    inside = kind != 0
    first = kind == 2
    first[:1] = True
    first[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(first & (codes == ord("'")))
    at = at[kind[at + 1] == 1]
    for ending in ("s", "t", "m", "d", "re", "ve", "ll"):
        found = at
        for k, c in enumerate(ending, 1):
            found = found[codes[found + k] == ord(c)]
        first[found + 1] = False
        first[found + len(ending) + 1] = True
    return np.flatnonzero(first & inside), inside


def byte_letters() -> dict[int, int]:
    """Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


#: Vocabularies of which a file of ranks is installed too.
RANKS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}


@functools.lru_cache(maxsize=4)
def encoder(name: str, dtype: str = "<u4") -> LibraryEncoder | RankEncoder | WordEndEncoder:
    if name in RANKS:
        return RankEncoder(name, RANKS[name], dtype)
    return WordEndEncoder(name, dtype) if tokenizer(name).normalizer else LibraryEncoder(name, dtype)


class PrefixCounter(dict):
    """piece -> the step in the token count at each of its characters, as signed bytes.

    The count at a prefix follows from a shorter one: the last token of its encoding is the one vocabulary entry ending
    there that the library would leave apart from the token before it; as there is just one, the likely lengths go first. A step lies between -126 and 4, as no
    token is longer than 128 bytes and no character longer than four.
    """

    def __init__(self, name: str):
        super().__init__()
        self.tok = tokenizer(name)
        self.vocab = frozenset(self.tok.get_vocab())
        self.longest = max(map(len, self.vocab))
        self.model, self.apart, self.n_apart = self.tok.model, {}, 0
        self.shown = byte_letters()

    def _apart(self, a: str, b: str) -> bool:
        """Whether the library leaves two tokens apart that stand side by side."""
        if self.n_apart >= 2 * MAX_CACHED:
            self.apart.clear()
            self.n_apart = 0
        found = self.model.tokenize(a + b)
        got = self.apart.setdefault(a, {})[b] = len(found) == 2 and found[0].value == a
        self.n_apart += 1
        return got

    def _counts(self, piece: str) -> list[int]:
        """Tokens of every prefix of a piece, by bytes: entry i is for the first i bytes."""
        word = piece.encode().decode("latin-1").translate(self.shown)
        counts, last, vocab, apart, none, size = [0], [""], self.vocab, self.apart, {}, len(word)
        ways = [*_LIKELY, *range(_LIKELY[-1] + 1, min(self.longest, size) + 1)]
        for end in range(1, size + 1):
            for k in ways:
                at = end - k
                if at > 0:
                    token = word[at:end]
                    ok = apart.get(last[at], none).get(token)
                    if ok is None and token in vocab:
                        ok = self._apart(last[at], token)
                    if not ok:
                        continue
                elif at or (token := word[:end]) not in vocab:
                    continue
                counts.append(counts[at] + 1)
                last.append(token)
                break
        return counts

    def __missing__(self, piece: str) -> bytes:
        counts = self._counts(piece)
        if not piece.isascii():
            counts = [0, *(counts[e] for e in accumulate(len(c.encode()) for c in piece))]
        got = self[piece] = bytes([(b - a) & 255 for a, b in pairwise(counts)])
        return got

    def prefixes(self, text: str) -> tuple[int, bytes]:
        """Tokens of the whole text, and the steps from which ``np.cumsum`` makes the count at every prefix."""
        if _NOT_PLAIN.search(text) or "<|" in text and _SPECIAL.search(text):
            return self._slow(text)
        if len(self) >= MAX_CACHED:
            self.clear()
        steps = b"".join(map(self.__getitem__, _BYTE_PIECES.findall(text)))
        if _RUN.search(text):
            steps = self._spaces(text, steps)
        return int(np.frombuffer(steps, "i1").sum(dtype=np.int64)), steps

    def _run(self, run: str) -> np.ndarray:
        """Tokens of every prefix of a run of white space, by characters: one pass over the run."""
        counts = np.array(self._counts(run), np.int64)
        return counts[1:] if run.isascii() else counts[np.cumsum([len(c.encode()) for c in run])]

    def _spaces(self, text: str, steps: bytes) -> bytes:
        """A prefix that ends in a run of white space has that run as one piece, though the whole text gives its last
        space to the word that follows."""
        counts = np.cumsum(np.frombuffer(steps, "i1"), dtype=np.int64)
        for m in _RUN.finditer(text):
            base = counts[m.start() - 1] if m.start() else 0
            counts[m.start() : m.end()] = base + self._run(m.group())
        return np.diff(counts, prepend=0).astype("i1").tobytes()

    def _slow(self, text: str) -> tuple[int, bytes]:
        """Any text, by the same program: the pieces are split by the vocabulary's whole pattern, a special token's string is one token
        once it is complete, and within one the prefix is encoded again from the last words before it."""
        counts, done, at = np.zeros(len(text), np.int64), 0, 0
        for part in _SPECIAL_SPLIT.split(text):
            if part == _SPECIAL_TOKEN:
                back = at
                for inside in (str.isspace, lambda c: not c.isspace(), str.isspace):
                    while back and inside(text[back - 1]):
                        back -= 1
                head = int(counts[back - 1]) if back else 0
                for k in range(1, len(part)):
                    counts[at + k - 1] = head + len(self.tok.encode(text[back : at + k], add_special_tokens=False).ids)
                done += 1
                counts[at + len(part) - 1] = done
            elif part:
                for m in _all_pieces().finditer(part):
                    step = np.cumsum(np.frombuffer(self[m.group()], "i1"), dtype=np.int64)
                    counts[at + m.start() : at + m.end()] = done + step
                    done += int(step[-1])
                for m in _RUN.finditer(part):
                    base = counts[at + m.start() - 1] if at + m.start() else 0
                    counts[at + m.start() : at + m.end()] = base + self._run(m.group())
            at += len(part)
        return done, np.diff(counts, prepend=0).astype("i1").tobytes()


#: The vocabulary's special token, and its whole splitting pattern.
_SPECIAL_TOKEN = "<|endoftext|>"
_SPECIAL_SPLIT = re.compile(r"(<\|endoftext\|>)")


@functools.lru_cache(maxsize=1)
def _all_pieces():
    import regex

    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


_RUN = re.compile(r"\s\s+")
_LIKELY = (2, 3, 1, 4, 5)


@functools.lru_cache(maxsize=2)
def prefix_counter(name: str) -> PrefixCounter:
    return PrefixCounter(name)
