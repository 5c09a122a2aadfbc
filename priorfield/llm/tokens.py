"""Token ids of whole texts by the tokenizers library, with a cache of encoded pieces.

Byte-pair encoding works inside pre-tokens, and natural text repeats them. A text is cut at places
where every pre-token of the supported files ends, new pieces go to the library in one batch, and
the ids of the text are gathered with numpy. The result is that of encoding the whole text.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hashing import ENCODERS, MUCH, give_back

_WHITE = r" \t\n\r\x0b\x0c"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation but the apostrophe, which contractions begin with
_OTHER = "\x00-\x08\x0e-\x1b\x7f0-9'\u0080-¿×÷Ā-\U0010ffff"  # with control characters, which join the marks beside them
#: A piece: white space, then letters only or marks only if nothing else touches them, else all up to the next white space.
PIECE = re.compile(rf"[{_WHITE}]*(?:[{_LETTER}]++(?![{_OTHER}])|[{_MARK}]++(?![{_OTHER}])|[^{_WHITE}]+)|[{_WHITE}]+")
#: A piece that is one pre-token whatever follows it, if that begins with a space too.
_PLAIN = re.compile(f" [{_LETTER}]+")
#: White space beyond ASCII's usual six, which may belong to one run with these: such texts are encoded whole.
_RARE_ASCII = tuple(map(chr, range(0x1C, 0x20)))
_RARE = tuple(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Where single spaces are not the only white space beside a space; the second kind is looked for only where its character is.
_NOT_SINGLE = ("  ", "\n ", " \n")
_SELDOM = {a: (a + " ", " " + a) for a in "\t\r\x0b\x0c"}


def _any(parts, text: str) -> bool:
    return any(p in text for p in parts)  # a plain search for each is faster than one pattern


#: So many plain pieces go to the library as one text.
TOGETHER = 100

#: Caches of so many words state that a worker has memory for large groups of texts, and for larger ones still.
ROOMY, VAST = 500_000, 600_000


def _gather(ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at ``begin``, one after the other."""
    ends = np.cumsum(size)
    return ids[np.repeat(begin - ends + size, size) + np.arange(ends[-1])]


class _Cache(dict):
    """Numbers keys as they are first looked up, and holds the ids of each number."""

    def __init__(self):
        self.new: list[str] = []
        self.ids = np.empty(1 << 16, dtype=np.uint32)
        self.starts = np.zeros((1 << 16) + 1, dtype=np.int64)
        self.known = 0

    def __missing__(self, key):
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def look_up(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), dtype=np.int64, count=len(keys))

    def add(self, ids: np.ndarray, sizes: np.ndarray):
        """The ids of the keys that have none yet, one after the other, and how many each has."""
        self.new.clear()
        n, a = self.known, self.starts[self.known]
        self.known += len(sizes)
        while self.known >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while a + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[a:a + len(ids)] = ids
        self.starts[n + 1:self.known + 1] = a + np.cumsum(sizes)

    def gather(self, at: np.ndarray) -> np.ndarray:
        begin = self.starts[at]
        return _gather(self.ids, begin, self.starts[at + 1] - begin)


class Encoder:
    """Encodes texts. Words between single spaces and their pieces are cached;
    a cache is emptied once it holds more keys than its limit."""

    def __init__(self, path: str, words: int = 500_000, pieces: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.library, self.limits = Tokenizer.from_file(path), (words, pieces)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words, self.pieces = _Cache(), _Cache()

    def _pieces(self, pieces: list[str]) -> np.ndarray:
        at = self.pieces.look_up(pieces)
        if self.pieces.new:
            self.pieces.add(*self._new_ids(self.pieces.new))
        return at

    def _new_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has. Plain pieces go to the library some at a
        time; it tells which word an id is of. Were the words not as many as the pieces, each would go on its own."""
        plain, single = [], []
        for i, piece in enumerate(pieces):
            (plain if _PLAIN.fullmatch(piece) else single).append(i)
        every, sizes, order = [], [], []
        for k in range(0, len(plain), TOGETHER):
            some = plain[k:k + TOGETHER]
            got = self.library.encode("".join([pieces[i] for i in some]), add_special_tokens=False)
            words = got.word_ids
            if not words or words[-1] is None or words[-1] + 1 != len(some):
                single += some
                continue
            every.append(np.array(got.ids, dtype=np.uint32))
            sizes.append(np.bincount(words, minlength=len(some)))
            order += some
        found = [x.ids for x in self.library.encode_batch_fast([pieces[i] for i in single], add_special_tokens=False)]
        every.append(np.fromiter(chain.from_iterable(found), dtype=np.uint32))
        sizes.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
        size = np.concatenate(sizes)
        place = np.argsort(np.array(order + single, dtype=np.int64))
        return _gather(np.concatenate(every), (np.cumsum(size) - size)[place], size[place]), size[place]

    def _alone(self, text: str) -> np.ndarray | None:
        """The ids of a text that can't be cut at single spaces; None if it can."""
        if _any(_RARE_ASCII, text) or not text.isascii() and _any(_RARE, text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if text[0] == " " or text[-1] == " " or _any(_NOT_SINGLE, text) or any(a in text and _any(both, text) for a, both in _SELDOM.items()):
            return self.pieces.gather(self._pieces(PIECE.findall(text)))
        return None

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that are cut at single spaces. Different words are looked up once. A first
        word has no space in front; a line break, which no other word begins with, marks it."""
        lists = pc.split_pattern(pa.array(["\n" + t for t in texts], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        at = self.words.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        if self.words.new:
            cut = [PIECE.findall(word[1:] if word[0] == "\n" else " " + word) for word in self.words.new]
            own = self._pieces(list(chain.from_iterable(cut)))
            sizes = self.pieces.starts[own + 1] - self.pieces.starts[own]
            firsts = np.cumsum([0, *map(len, cut)])[:-1]
            self.words.add(self.pieces.gather(own), np.add.reduceat(sizes, firsts))
        at = at[coded.indices.to_numpy()]
        ends = np.cumsum(self.words.starts[at + 1] - self.words.starts[at])
        last = lists.offsets.to_numpy()[1:] - 1
        return np.split(self.words.gather(at), ends[last[:-1]])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; null counts as empty. Most objects made on the way are
        lists of strings and numbers without cycles, so the collector of cycles would look through the caches for nothing."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.pieces) > self.limits[1]:
            self.pieces = _Cache()
        if len(self.words) > self.limits[0]:
            self.words = _Cache()
        out = [self._alone(t) if t else np.empty(0, dtype=np.uint32) for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._words([texts[i] for i in rest]) if rest else []):
            out[i] = ids
        return out

    def encode_column(self, column: pa.Array):
        """The ids of each text of an Arrow column in turn; characters are encoded a group at a time, and memory
        that is free again is given back now and then. Groups are as large as the caches allow: small caches are for
        workers with little memory to spare."""
        sizes = (VAST, 1 << 22, 24 * MUCH), (ROOMY, 1 << 21, 8 * MUCH), (0, 1 << 19, MUCH)
        group, much = next(size for least, *size in sizes if self.limits[0] >= least)
        texts, size, since = [], 0, 0
        for value in column:
            texts.append(value.as_py())
            size += len(texts[-1] or "")
            if size >= group:
                yield from self.encode(texts)
                since += size
                texts, size = [], 0
                if since >= much:
                    give_back()
                    since = 0
        yield from self.encode(texts)


def encoder(path: str, cache: tuple[int, int] = (VAST, 1_000_000)) -> Encoder:
    """One encoder per file and worker process, kept from task to task until the worker does other work on
    words. ``cache`` has the most words and pieces it keeps; results do not depend on it."""
    if path not in ENCODERS or ENCODERS[path].limits != cache:
        ENCODERS[path] = Encoder(path, *cache)
    return ENCODERS[path]
