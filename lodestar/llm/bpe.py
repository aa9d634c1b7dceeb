"""Byte-level BPE with the tokenizers library over Arrow batches.

A text is cut before every single space that has a non-space on both sides, and around every single line feed;
a match of the split pattern always starts there, so the parts can be encoded apart.  Each distinct part of a
batch is encoded once (by the library's pre-tokenizer and model) and kept in a bounded cache of the worker;
the ids of whole texts are then gathered with numpy.  Texts with other white space are cut by a regular expression.
That holds for the split pattern PATTERN only; with any other, and for texts that hold an added token's string (which the
library cuts out first, by default), whole texts go through the library.
"""

from __future__ import annotations

import base64
import gc
import re
import threading
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a Python worker keeps in each of two generations, some 200 bytes each; words in use move to the newer one.
CACHE_WORDS = 450_000
#: Runs of signs after words that it keeps.
CACHE_SIGNS = 10_000
#: Signs that no match of the split pattern joins to the letters before them (an apostrophe may begin one with letters).
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Seconds without work after which a worker gives its kept words back: the process outlives its tasks.
IDLE = 2.0
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
# Fixed value: the split pattern of the byte-level vocabularies, for which the cuts are safe.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge a token's bytes by lowest rank until two parts are left."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if found is None:
            break
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def tokenizer_of_ranks(path: str, pattern: str):
    """A tokenizers.Tokenizer that encodes as a rank file does.

    Within the bytes of a token that comes to be, no merge crosses its ends, so its parts are merged as if they
    stood alone: the last merge of each token is unique, and merges in order of rank give the same ids.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    chars = byte_chars()
    as_text = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1 and len(parts := _parts(token, ranks)) == 2:
            merges.append((as_text[parts[0]], as_text[parts[1]]))
    tokenizer = Tokenizer(models.BPE(vocab={as_text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


class ByteBpe:
    def __init__(self, tokenizer, apart: bool):
        """apart: texts may be cut at safe places, as PATTERN splits them."""
        self.tokenizer, self.model, self.split, self.apart = tokenizer, tokenizer.model, tokenizer.pre_tokenizer, apart
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.from_byte = {b: c for b, c in enumerate(byte_chars())}
        self.kept: dict[bool, list[dict[str, bytes]]] = {True: [{}, {}], False: [{}, {}]}
        self.signs: dict[str, bytes] = {}
        self.shown = np.array([ord(c) for c in byte_chars()], "<u2")
        self._timer: threading.Timer | None = None
        self._bytes: list[bytes] | None = None

    def _encode(self, part: str) -> bytes:
        return array("I", [t.id for w, _ in self.split.pre_tokenize_str(part) for t in self.model.tokenize(w)]).tobytes()

    def _many(self, words: list[str], space: bool) -> list[bytes]:
        if len(self.kept[space][0]) > CACHE_WORDS:
            self.kept[space] = [{}, self.kept[space][0]]
        known, older = self.kept[space]
        found = list(map(known.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        missing = list(map(words.__getitem__, new))
        cores = [core if (core := w.rstrip(_SIGNS)).isalpha() else w for w in missing]  # signs after letters are a match of their own
        fresh = list({w for w in cores if w not in known})
        known.update((w, ids) for w, ids in zip(fresh, map(older.get, fresh), strict=True) if ids is not None)
        fresh, tokenize = [w for w in fresh if w not in known], self.model.tokenize
        plain = [w for w in fresh if w.isalpha()]
        known.update([(w, array("I", [t.id for t in tokenize(x)]).tobytes()) for w, x in zip(plain, self._shown(plain, space), strict=True)])
        known.update([(w, self._encode(" " + w if space else w)) for w in fresh if not w.isalpha()])
        tails = list(map(str.removeprefix, missing, cores))
        signs = {tail: self._sign(tail) for tail in set(tails)}
        for i, ids in zip(new, map(add, map(known.__getitem__, cores), map(signs.__getitem__, tails)), strict=True):
            found[i] = ids
        return found

    def _shown(self, words: list[str], space: bool) -> list[str]:
        """The characters that stand for the bytes of each word, and of a space before it; words without line feeds."""
        if not words:
            return []
        lead = " " if space else ""
        raw = np.frombuffer((lead + f"\n{lead}".join(words)).encode("utf-8", "surrogatepass"), np.uint8)
        return self.shown[raw].tobytes().decode("utf-16-le").split(self.from_byte[10])

    def _sign(self, sign: str) -> bytes:
        if sign not in self.signs:
            if len(self.signs) >= CACHE_SIGNS:
                self.signs.clear()
            self.signs[sign] = self._encode(sign)
        return self.signs[sign]

    def encode_one(self, text: str) -> np.ndarray:
        """Any text, cut at safe spaces only."""
        if not text:
            return np.zeros(0, np.uint32)
        first, *rest = _SAFE_CUT.split(text)
        return np.frombuffer(b"".join([*self._many([first], False), *self._many(rest, True)]), np.uint32)

    def encode_whole(self, text: str) -> np.ndarray:
        """As the library does it, added tokens included."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def forget(self) -> None:
        """Give the kept words back to the system."""
        self.kept = {True: [{}, {}], False: [{}, {}]}
        pa.default_memory_pool().release_unused()

    @contextmanager
    def at_work(self) -> Iterator[None]:
        """While a task encodes; words are forgotten once no task has come for IDLE seconds.  No garbage collection meanwhile:
        encoding makes no cycles, and the collector would walk through all words again and again."""
        if self._timer:
            self._timer.cancel()
        collects = gc.isenabled()
        gc.disable()
        try:
            yield
        finally:
            if collects:
                gc.enable()
            self._timer = threading.Timer(IDLE, self.forget)
            self._timer.daemon = True
            self._timer.start()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin (one more entry than texts).  Null counts as empty."""
        with self.at_work():
            return self._encoded(texts)

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.full(len(texts), not self.apart)
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        at = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = at - at[0]
        bad = np.array(list(map(str.__ne__, words, map(str.strip, words))), bool)
        line, nothing = (pc.index(coded.dictionary, w).as_py() for w in ("\n", ""))  # -1: not there
        if nothing >= 0:
            bad[nothing] = True
        if line >= 0:
            bad[line] = False
        feed = index == line
        plain = np.zeros(len(index), bool)  # parts without a space before them
        plain[at[:-1]] = True
        plain[1:] |= feed[:-1]
        plain |= feed
        ends = np.zeros(len(index), bool)
        ends[at[1:] - 1] = True
        wrong = bad[index] | (feed & ends)  # a line feed at the end may belong to a longer run
        wrong[1:] |= feed[1:] & feed[:-1]
        slow = (np.add.reduceat(wrong.astype(np.int64), at[:-1]) > 0) | whole
        bare_index = np.unique(index[plain])
        bare_place = np.full(len(words), -1, np.int64)
        bare_place[bare_index] = np.arange(len(bare_index))
        table: list[bytes] = [b""] * (len(words) + len(bare_index))
        spaced = np.ones(len(words), bool)  # words that stand after a space somewhere
        spaced[bare_index] = False
        spaced[index[~plain]] = True
        for use, first, space in ((np.flatnonzero(spaced & ~bad), None, True), (np.flatnonzero(~bad[bare_index]), bare_index, False)):
            own = (use if first is None else first[use]).tolist()
            for i, ids in zip((use if space else use + len(words)).tolist(), self._many(list(map(words.__getitem__, own)), space), strict=True):
                table[i] = ids
        code = np.where(plain, len(words) + bare_place[index], index)
        width = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat = np.frombuffer(b"".join(table), np.uint32)
        begin = np.cumsum(width) - width
        each = width[code]
        if slow.any():
            each[np.repeat(slow, np.diff(at))] = 0
        done = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(begin[code] - done[:-1], each) + np.arange(done[-1])]
        starts = done[at]
        if slow.any():
            own = {i: self.encode_whole(texts[i].as_py()) if whole[i] else self.encode_one(texts[i].as_py()) for i in np.flatnonzero(slow).tolist()}
            ids = np.concatenate([own.get(i, ids[starts[i] : starts[i + 1]]) for i in range(len(slow))])
            sizes = np.array([len(own[i]) if i in own else starts[i + 1] - starts[i] for i in range(len(slow))], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
        return ids, starts

    def bytes_of(self) -> list[bytes]:
        """Each id's bytes: its string through the byte table reversed."""
        if self._bytes is None:
            back = {c: b for b, c in enumerate(byte_chars())}
            vocabulary = self.tokenizer.get_vocab()
            table = [b""] * (max(vocabulary.values()) + 1)
            for token, i in vocabulary.items():
                table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
            self._bytes = table
        return self._bytes

    def decode(self, ids: np.ndarray) -> bytes:
        """The exact bytes; a character that tokens split comes back whole once they are joined."""
        return b"".join(map(self.bytes_of().__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of every token; tokens that share a split character all cover it."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        table = self.bytes_of()
        ends = np.cumsum(np.fromiter((len(table[i]) for i in ids.tolist()), np.int64, len(ids)))
        character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        starts = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
        return character[starts], character[ends - 1] + 1


@lru_cache(maxsize=4)
def load(path: str, pattern: str | None = None) -> ByteBpe:
    """Of a tokenizers .json, or of a .tiktoken rank file with its pattern; once in each worker."""
    if path.endswith(".tiktoken"):
        return ByteBpe(tokenizer_of_ranks(path, pattern), pattern == PATTERN)
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    state = json.loads(tokenizer.to_str())
    split = state["pre_tokenizer"] or {}
    return ByteBpe(tokenizer, state["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"])
