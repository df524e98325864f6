"""Tokenisation with the ``tokenizers`` library, remembering the ids of the pieces that texts are made of."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers in each of two generations, and the length beyond which one is not remembered.
REMEMBERED = 250_000
LONGEST = 48
#: Pieces sent to the library at once; bytes of a text beyond which it is encoded in segments.
LIBRARY_PIECES, SEGMENT = 20_000, 1 << 22
#: White space as either tokenizer or Python sees it, and a space with white space, or a text's end, on both of its sides.
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = rf"(?:^|[{_SPACE}]) (?:[{_SPACE}]|$)"
#: Latin and Cyrillic letters that every Unicode version knows, and that lower-casing maps one to one.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſЀ-џ"
_WORD = re.compile(f" ?[{_LETTERS}]+")
#: A mark for where a chunk is taken apart; a text that has the character itself goes to the library whole.
_CUT = "\x00"


def byte_letters() -> dict[int, str]:
    """The printable characters that byte-level tokenizers write bytes as: printable Latin-1 as it is, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ChunkEncoder:
    """Encodes texts as the tokenizer file does, but each piece of them only once.

    Both kinds of tokenizer used here cut a text before merging, and what they cut out never reaches over a space: the
    word kind drops white space; the byte kind puts a space in front of what follows it. A text is therefore the
    concatenation of its chunks' ids, with two exceptions that go to the library whole: texts in which an added token
    might stand, and, for the byte kind, texts with white space on both sides of a space, where the run is cut elsewhere.
    Nor does a cut piece reach from a letter to a stop, or over a single line feed between two other characters, so a
    chunk is taken apart there as well. Chunks and pieces are made distinct and put together again in Arrow and numpy;
    Python sees each distinct piece of a batch once. A piece of letters alone goes straight to the library's merging step.
    When a generation is full, it becomes the old one; what is met again moves on.
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        self.letters = byte_letters()
        #: What added tokens begin with; a text that holds such a beginning goes to the library whole.
        self.marks = sorted({_CUT, *(x.content[:2] for x in self.library.get_added_tokens_decoder().values())})
        self.keeps_space = keeps_space
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        probe = [" The" if keeps_space else "The", "Größe", "дом", "x"]
        self.direct = self._merged(probe) == self._whole(probe)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for a in range(0, len(texts), LIBRARY_PIECES) for e in self.library.encode_batch_fast(texts[a : a + LIBRARY_PIECES], add_special_tokens=False)]

    def _merged(self, words: list[str]) -> list[bytes]:
        """The ids of words, which are one cut piece each, by the merging step alone."""
        merge, letters, keeps = self.merge, self.letters, self.keeps_space
        out = []
        for w in words:
            w = w if keeps else w.lower()
            w = w.replace(" ", letters[32]) if w.isascii() else w.encode().decode("latin-1").translate(letters)
            out.append(array("I", [t.id for t in merge(w)]).tobytes())
        return out

    def _pieces(self, names: list[str]) -> list[bytes]:
        """The ids of distinct pieces; those that are not too long are remembered."""
        if len(self.known) > REMEMBERED:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        out = [known.get(x) for x in names]
        words, others = [], []
        for k, found in enumerate(out):
            if found is None:
                x = names[k]
                if x in old:
                    out[k] = known[x] = old[x]
                elif self.direct and len(x) <= LONGEST and _WORD.fullmatch(x):
                    words.append(k)
                else:
                    others.append(k)
        for places, encode in ((words, self._merged), (others, self._whole)):
            for k, ids in zip(places, encode([names[k] for k in places]), strict=True):
                out[k] = ids
                if len(names[k]) <= LONGEST:
                    known[names[k]] = ids
        return out

    def _together(self, texts: pa.Array, begins: bool) -> list[np.ndarray]:
        """The ids of texts that are concatenations of their chunks; ``begins``: their first chunks have no space in front."""
        chunks, offsets = _split(texts, " ")
        coded = chunks.dictionary_encode()
        index, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if self.keeps_space:
            spaced = pc.binary_join_element_wise(" ", names, "")
            if begins:
                first, inverse = np.unique(index[offsets[:-1]], return_inverse=True)
                index[offsets[:-1]] = len(names) + inverse
                spaced = pa.concat_arrays([spaced, names.take(pa.array(first))])
            names = spaced
        parts = pc.replace_substring_regex(names, f"([{_LETTERS}])([,.;:!?])", rf"\1{_CUT}\2")
        parts = pc.replace_substring_regex(parts, rf"([^{_SPACE}])\n([^{_SPACE}])", rf"\1{_CUT}" + "\n" + rf"{_CUT}\2")
        parts, cuts = _split(parts, _CUT)
        coded = parts.dictionary_encode()
        found = self._pieces(coded.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, bounds = _gathered(pool, np.cumsum(sizes) - sizes, sizes, coded.indices.to_numpy(), cuts)
        ids, bounds = _gathered(pool, bounds[:-1], np.diff(bounds), index, offsets)
        return [ids[a:z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; none for a null or empty text."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return []
        whole = pa.array(np.zeros(len(texts), bool))
        for mark in self.marks:
            whole = pc.or_(whole, pc.match_substring(texts, mark))
        if self.keeps_space:
            whole = pc.or_(whole, pc.match_substring_regex(texts, _ODD))
        long = pc.and_(pc.invert(whole), pc.greater(pc.binary_length(texts), SEGMENT))
        apart = np.flatnonzero(pc.or_(whole, long).to_numpy(zero_copy_only=False)).tolist()
        if not apart:
            return self._together(texts, True)
        out = self._together(pc.if_else(pc.or_(whole, long), "", texts), True)
        for i in apart:
            out[i] = self._in_segments(texts[i].as_py()) if long[i].as_py() else np.frombuffer(self._whole([texts[i].as_py()])[0], "<u4")
        return out

    def _in_segments(self, text: str) -> np.ndarray:
        """The ids of a very long text, cut at spaces, so that what is held beside it is bounded."""
        found, at = [], 0
        while at <= len(text):
            stop = text.find(" ", at + SEGMENT)
            stop = len(text) if stop < 0 else stop
            found += self._together(pa.array([text[at:stop]]), not at)
            at = stop + 1
        return np.concatenate(found)


def _split(texts: pa.Array, at: str) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts, and where in them each text begins."""
    split = pc.split_pattern(texts, at)
    offsets = split.offsets.to_numpy().astype(np.int64)
    return split.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def _gathered(pool: np.ndarray, begin: np.ndarray, sizes: np.ndarray, index: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``begin, sizes`` of ``pool`` in the order of ``index``, one after the other, and the bounds in the result of
    the groups that ``offsets`` makes of ``index``."""
    n = sizes[index]
    ends = np.cumsum(n)
    out = pool[np.repeat(begin[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    return out, np.concatenate(([0], ends))[offsets]


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder_of(path: str, keeps_space: bool) -> ChunkEncoder:
    """The encoder of this worker process, which goes on from task to task with what it remembers."""
    if (path, keeps_space) not in _encoders:
        _encoders[path, keeps_space] = ChunkEncoder(path, keeps_space)
    return _encoders[path, keeps_space]
