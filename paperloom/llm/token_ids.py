"""Token ids of texts by a public tokenizer, each distinct word of a batch encoded once."""

from __future__ import annotations

import os
import string
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from paperloom.llm.common import Remembered, give_back

#: Appended to every document.
END_ID = 1
#: Words and cores a worker remembers before it starts anew.
REMEMBERED = 150_000
#: Letters below this lower-case one by one, whatever stands beside them.
LATIN_END = chr(0x250)
#: Fixed value of the byte-level alphabet: bytes shown as themselves; the others follow from 256 on in their order.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Pieces given to the tokenizer at a time, bytes of text that are split and runs that are copied at a time: workers hold
#: several times as much.
PIECES_AT_ONCE, BYTES_AT_ONCE, RUNS_AT_ONCE = 4_096, 2 << 20, 1 << 16


def _simple_words() -> str:
    """Pattern of the words that are letters, in its ``core``, and then ASCII punctuation, in its ``tail``."""
    letters = [chr(code) for code in range(ord(LATIN_END)) if chr(code).isalpha() and chr(code).lower().isalpha()]
    lowered = pc.utf8_lower(pa.array(letters)).to_pylist()
    letters = [letter for letter, low in zip(letters, lowered, strict=True) if low == letter.lower()]
    marks = "".join(f"\\{mark}" for mark in string.punctuation)
    return f"\\A(?P<core>[{''.join(letters)}]+)(?P<tail>[{marks}]*)\\z"


def _runs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[start : start + size]`` of every run, one after another."""
    out, filled = np.empty(sizes.sum(dtype=np.int64), values.dtype), 0
    for first in range(0, len(sizes), RUNS_AT_ONCE):
        of = sizes[first : first + RUNS_AT_ONCE]
        places = np.repeat(starts[first : first + RUNS_AT_ONCE] - _starts(of), of)
        places += np.arange(len(places), dtype=np.int32)
        out[filled : filled + len(places)] = values[places]
        filled += len(places)
    return out


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes, dtype=np.int32) - sizes


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own for tokenizers that drop white space.

    White space separates pre-tokens and is dropped, so the ids of a text are those of its words one after another. A
    word that is letters and then ASCII punctuation is two pre-tokens, and its letters are looked up in lower case; any
    other word goes through the tokenizer as it stands.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = Tokenizer(self.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary, suffix = self.plain.get_vocab(), self.model.end_of_word_suffix
        #: Whether an id is the last of its piece.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[number for token, number in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.simple = _simple_words()
        hidden = iter(range(256, 512))
        self.letters = [chr(byte if byte in SHOWN else next(hidden)) for byte in range(256)]
        self.shown = np.array([ord(letter) for letter in self.letters], "<u4")
        self.shown[ord(" ")] = ord(" ")
        self.words = Remembered("token ids", self._word, REMEMBERED)
        self.pieces = Remembered("token ids", self._piece, REMEMBERED)

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of all ``texts`` one after another, the end id after each, and the number of ids of each; null is empty.

        They come for as many texts at a time as have BYTES_AT_ONCE, or for one that has more. Every distinct word of those
        is looked at once. The pieces of words that are letters and then ASCII punctuation go through the tokenizer's model
        together; other words one by one, and they are remembered.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        bounds = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // BYTES_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(bounds)) + 1).tolist(), len(texts)]
        for first, last in pairwise(cuts):
            yield self._encoded(texts.slice(first, last - first))

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        self.words.claim()
        split = pc.ascii_split_whitespace(texts)
        found = split.flatten().dictionary_encode()
        distinct = found.dictionary
        parts = pc.extract_regex(distinct, self.simple)
        simple = parts.is_valid()
        is_simple, parts = simple.to_numpy(zero_copy_only=False), parts.drop_null()
        pieces = pa.concat_arrays([pc.utf8_lower(parts.field("core")), parts.field("tail")]).dictionary_encode()
        ids, sizes = self._pieces(pieces.dictionary)
        odd = [self.words[word] for word in distinct.filter(pc.invert(simple)).cast(pa.binary()).to_pylist()]
        # Each word is two runs of these ids; the end of a text is one more word.
        first_odd, end = len(sizes), len(sizes) + len(odd)
        ids = np.concatenate([ids, np.frombuffer(b"".join(odd), "<u4"), [END_ID]]).astype("<u4")
        sizes = np.concatenate([sizes, [len(word) // 4 for word in odd], [1, 0]]).astype(np.int32)
        runs = np.full((len(distinct) + 1, 2), end + 1)
        runs[:-1][is_simple] = pieces.indices.to_numpy().reshape(2, -1).T
        runs[:-1, 0][~is_simple] = np.arange(first_odd, end)
        runs[-1, 0] = end
        ids, sizes = _runs(ids, _starts(sizes)[runs].ravel(), sizes[runs].ravel()), sizes[runs].sum(axis=1, dtype=np.int32)
        bounds = split.offsets.to_numpy()
        words = np.insert(found.indices.to_numpy(), bounds[1:], len(distinct))
        ids, sizes = _runs(ids, _starts(sizes)[words], sizes[words]), sizes[words]
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        return ids, np.diff(ends[bounds + np.arange(len(bounds))])

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces one after another, and the number of ids of each; one piece may be empty."""
        ids, sizes = [np.empty(0, "<u4")], np.zeros(len(pieces), np.int32)
        full = np.flatnonzero(pc.binary_length(pieces).to_numpy())
        for start in range(0, len(full), PIECES_AT_ONCE):
            own = full[start : start + PIECES_AT_ONCE]
            named = pieces.take(pa.array(own)).to_pylist()
            shown = self.shown[np.frombuffer(" ".join(named).encode(), np.uint8)].tobytes().decode("utf-32-le")
            got = np.array(self.plain.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) != len(own):  # a model that does not mark the ends of its pieces
                each = [self._piece(piece) for piece in named]
                got, ends = np.frombuffer(b"".join(each), "<u4"), np.cumsum([len(piece) // 4 for piece in each])
            ids.append(got)
            sizes[own] = np.diff(ends, prepend=0)
        return np.concatenate(ids), sizes

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of one text, the end id last."""
        return b"".join(map(self.words.__getitem__, text.split())) + END_ID.to_bytes(4, "little")

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        core = text.rstrip(string.punctuation)
        low = core.lower()
        if core and low.isalpha() and max(core) < LATIN_END:
            tail = text[len(core) :]
            return self.pieces[low] + (self.pieces[tail] if tail else b"")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = "".join([self.letters[byte] for byte in piece.encode()])
        return np.array([token.id for token in self.model.tokenize(shown)], "<u4").tobytes()


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder; it stays with the process, what reading its file took does not."""
    made = Encoder(path)
    give_back()
    return made
