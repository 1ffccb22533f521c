"""Fast exact encoding with the ``tokenizers`` library.

Both vocabularies cut a text into pieces with a regular expression and encode
each piece on its own, and a single space or line break between two words always
separates pieces.  So the ids of a text are the ids of its words in order.  An
encoder cuts many texts at once into words with Arrow, numbers the different ones,
and looks up only those; the ids of all words are then gathered by number.  The
library's model is asked for pieces that aren't known; the packed answers are kept
in bounded dictionaries, from task to task.  Texts with characters on
which Python and the library could differ (other scripts, combining marks,
unusual white space) or the marks that a vocabulary adds, such as ``<|endoftext|>``,
go to the library whole: the ids are always the library's.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters for which ``re`` and the library agree on letters, digits and
#: white space, and which composition and lower-casing map to one character.
_PLAIN = re.compile(
    "[\x00-\x08\n\x0e-\x1b\x20-\x84\x86-\x9f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įĲ-ɏ‘’“”–—…€•]*"
)

#: How each vocabulary cuts a text, written with classes of ``re``.
_BYTE_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
)
_WORD_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

#: Words, and pieces of mixed words, in one generation of a dictionary; the last one and the one before are kept.
MAX_WORDS, MAX_PIECES = 250_000, 50_000
#: Longer words are encoded but not kept.
MAX_WORD_CHARS = 64
#: Characters of texts that are cut into words at once.
CHUNK_CHARS = 4_000_000
#: Marks that mostly stand behind words.
_MARKS = b",.;:!?"
_IS_MARK = np.isin(np.arange(256), list(_MARKS))
#: ASCII letters and digits, and the first bytes of two that are a letter but for the signs of multiplication and division.
_IS_ASCII_LETTER = np.array([c < 0x80 and chr(c).isalnum() for c in range(256)])
_IS_LEAD = np.isin(np.arange(256), np.arange(0xC3, 0xCA))
_SIGNS = (0x97, 0xB7)
#: Marks the first word of a text in the dictionary; never part of a word there.
_FIRST = "\r"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return [chr(256 + other.index(b) if b in other else b) for b in range(256)]


class _Words:
    """Word to packed ids; asks the vocabulary for words that it does not have.

    A full dictionary becomes the old generation, from which words come back when
    they are met again, so frequent words stay and rare ones go.
    """

    def __init__(self, ask, most: int):
        self._ask, self._most = ask, most
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def of(self, words: list[str]) -> list[bytes]:
        found = list(map(self._new.get, words))
        if None not in found:
            return found
        ask, old = self._ask, self._old.get
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                ids = found[i] = old(word) or ask(word)
                if len(word) <= MAX_WORD_CHARS:
                    if len(self._new) >= self._most:
                        self._old, self._new = self._new, {}
                        old = self._old.get
                    self._new[word] = ids
        return found


class Encoder:
    """Encodes texts to packed little-endian 16-bit ids.

    ``style`` is ``"byte"`` for the byte-level vocabulary and ``"word"`` for the
    lower-casing vocabulary with word ends.  A null text counts as empty.
    """

    def __init__(self, path: str, style: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        if self._tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self._word_ends = style == "word"
        self._cut = (_WORD_PIECES if self._word_ends else _BYTE_PIECES).findall
        self._model = self._tokenizer.model
        added = (re.escape(t.content) for t in self._tokenizer.get_added_tokens_decoder().values())
        self._added = re.compile("|".join(added) or "(?!)", re.IGNORECASE).search
        self._letters = _byte_letters()
        self._pieces = _Words(self._piece, MAX_PIECES)
        self._known = _Words(self._word, MAX_WORDS)
        self._mark_ids = np.zeros(256, dtype="<u2")
        for mark in _MARKS:
            self._mark_ids[mark] = np.frombuffer(self._piece(chr(mark)), dtype="<u2")[0]

    def _whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u2").tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            letters = "".join([self._letters[b] for b in piece.encode()])
        elif self._word_ends:
            letters = piece
        else:
            letters = self._letters[32] + piece[1:] if piece[0] == " " and piece[1:].isalpha() else "".join([self._letters[b] for b in piece.encode()])
        ids = [t.id for t in self._model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}H", *ids)

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(word if self._word_ends else " " + word)
        if not self._word_ends:
            word = word[1:] if word[:1] == _FIRST else word if word[:1] == "\n" else " " + word
        return b"".join(self._pieces.of(self._cut(word)))

    def _by_words(self, text: str) -> bool:
        """Whether the ids of the text's words follow each other in the text's; else it has to go whole."""
        if not _PLAIN.fullmatch(text) or self._added(text):
            return False
        if self._word_ends:
            return True
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1] == " ")

    def _cut_words(self, texts: list[str]) -> pa.ListArray:
        joined = pa.array(texts, pa.string())
        if self._word_ends:
            return pc.utf8_split_whitespace(pc.utf8_lower(joined))
        # A line break stays at the head of its word.
        joined = pc.replace_substring(joined, "\n", " \n")
        return pc.split_pattern(pc.binary_join_element_wise(_FIRST, joined, ""), " ")

    def _encode_words(self, texts: list[str]) -> list[bytes]:
        cut = self._cut_words(texts)
        words = cut.flatten()
        # A mark behind a letter or digit is a piece of its own, so a word with one and without are looked up as one.
        stops, letters = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset :][: len(words) + 1], np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
        last, size = stops[1:] - 1, np.diff(stops)
        has_mark = np.zeros(len(words), dtype=bool)
        at = np.flatnonzero(size > 2)
        at = at[_IS_MARK[letters[last[at]]]]
        one, two = letters[last[at] - 1], letters[last[at] - 2]
        has_mark[at] = _IS_ASCII_LETTER[one] | (_IS_LEAD[two] & (one >= 0x80) & ~((two == 0xC3) & np.isin(one, _SIGNS)))
        stems = pc.if_else(pa.array(has_mark), pc.binary_slice(words.cast(pa.binary()), 0, -1), words.cast(pa.binary()))
        stems = stems.cast(pa.string()).dictionary_encode()
        packed = self._known.of(stems.dictionary.to_pylist())
        sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 2
        pool = np.frombuffer(b"".join(packed), dtype="<u2")
        numbers = stems.indices.to_numpy()
        n = sizes[numbers]
        ends = np.cumsum(n + has_mark)
        # Where each id of a word stands in the pool: at the word's place there, and on from the word's first.
        before = np.cumsum(n) - n
        at = np.repeat(((np.cumsum(sizes) - sizes)[numbers] - before).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, dtype="<u2")
        marks = ends[has_mark] - 1
        of_stem = np.ones(len(ids), dtype=bool)
        of_stem[marks] = False
        ids[of_stem] = pool[at]
        ids[marks] = self._mark_ids[letters[last[has_mark]]]
        bounds = np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        chunk: list[int] = []
        chars = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self._by_words(text):
                out[i] = self._whole(text)
                continue
            chunk.append(i)
            chars += len(text)
            if chars >= CHUNK_CHARS:
                for j, ids in zip(chunk, self._encode_words([texts[j] for j in chunk])):
                    out[j] = ids
                chunk, chars = [], 0
        if chunk:
            for j, ids in zip(chunk, self._encode_words([texts[j] for j in chunk])):
                out[j] = ids
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, style: str) -> Encoder:
    """This Python worker's encoder for a vocabulary file; kept from task to task."""
    if (path, style) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, style] = Encoder(path, style)
    return _ENCODERS[path, style]


def vocabulary(name: str) -> str:
    """Where a vocabulary file lies, by its name in the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
