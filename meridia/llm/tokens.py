"""Token ids of whole Arrow batches with the ``tokenizers`` library.

Texts are cut at single spaces and each distinct chunk of a batch is encoded once. For a
vocabulary whose pre-tokens never hold white space that equals encoding the whole text.
A chunk of Latin letters with plain marks behind is two pre-tokens at sight, whose distinct
spellings go straight to the library's model; every other chunk goes through the library's whole pipeline.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Spellings of a generation that a Python worker remembers; two generations are kept, so what is asked again stays.
MEMORY = 150_000
MARKS = ".,;:!?|%*#$&"
#: Letters whose lower case is one letter and whose composed form is their own.
_PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+[.,;:!?|%*#$&]*$"
_LOADED: dict[str, "WordEncoder"] = {}


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct space-separated chunks, each chunk's number in them, each text's first chunk."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
    coded = parts.flatten().dictionary_encode()
    first = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(parts), dtype=np.int64))])
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), first


def gather(values: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs values[bounds[c]:bounds[c+1]] for each code in turn, and where each run ends."""
    size = (bounds[1:] - bounds[:-1])[codes]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(bounds[:-1][codes] - (ends - size), size)
    return values[at], ends


def assemble(words: pa.Array, word_ids: Callable[[list[str]], list[bytes]], whole_ids: Callable[[list[str]], list[bytes]], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct chunks, flat, and each one's bounds in them. A chunk of letters with marks behind is two runs, the ids of its
    letters (in lower case with ``fold``) and of its marks, as ``word_ids`` gives them for distinct spellings, packed as uint32;
    others are one run, as ``whole_ids`` gives it."""
    plain = pc.match_substring_regex(words, _PLAIN)
    full = words.filter(plain)
    head = pc.utf8_rtrim(full, characters=MARKS)
    coded = (pc.utf8_lower(head) if fold else head).dictionary_encode()
    behind = pc.subtract(pc.binary_length(full), pc.binary_length(head)).to_numpy()
    marked = np.flatnonzero(behind)
    tails = [w[-k:] for w, k in zip(full.take(pa.array(marked)).to_pylist(), behind[marked].tolist(), strict=True)]
    kinds = {t: i for i, t in enumerate(dict.fromkeys(tails))}
    heads, other = coded.dictionary.to_pylist(), words.filter(pc.invert(plain)).to_pylist()
    each = [*word_ids(heads), *word_ids(list(kinds)), *whole_ids(other), b""]
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4)])
    pool = np.frombuffer(b"".join(each), dtype=np.uint32)
    runs = np.full((len(words), 2), len(each) - 1, dtype=np.int64)
    is_plain = plain.to_numpy(zero_copy_only=False)
    at = np.flatnonzero(is_plain)
    runs[at, 0] = coded.indices.to_numpy(zero_copy_only=False)
    runs[at[marked], 1] = len(heads) + np.fromiter((kinds[t] for t in tails), dtype=np.int64, count=len(tails))
    runs[~is_plain, 0] = len(heads) + len(kinds) + np.arange(len(other))
    ids, ends = gather(pool, bounds, runs.ravel())
    return ids, np.concatenate([[0], ends[1::2]])


class WordEncoder:
    """Encodes batches with one tokenizer file, as the library does by itself: a special token's string in a
    text is that token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        # ids as packed uint32: a quarter of the memory of lists
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @property
    def largest_id(self) -> int:
        return max(self.tokenizer.get_vocab(with_added_tokens=True).values())

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token, in lower case."""
        letters = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _whole(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _each(self, spellings: list[str], make: Callable[[str], bytes], mark: str = "") -> list[bytes]:
        """Ids of distinct spellings, remembered under a mark of their kind."""
        known, before, out = self.known, self.before, []
        for s in spellings:
            key = mark + s
            ids = known.get(key)
            if ids is None:
                ids = before.get(key)
                if ids is None:
                    ids = make(s)
                known[key] = ids
            out.append(ids)
        return out

    def _of_chunks(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, flat, and each one's bounds in them."""
        if len(self.known) > MEMORY:
            self.known, self.before = {}, self.known
        # a space keeps whole chunks apart from words, whose spelling never has one
        return assemble(words, lambda w: self._each(w, self._word), lambda w: self._each(w, self._whole, " "), True)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch, flat, as uint32, and each text's bounds in them."""
        words, codes, first = chunks(texts)
        flat, bounds = self._of_chunks(words)
        ids, ends = gather(flat, bounds, codes)
        stop = np.concatenate([[0], ends])[first]
        if end_id is None:
            return ids, stop
        with_end = np.insert(ids, stop[1:], np.uint32(end_id))
        return with_end, stop + np.arange(len(stop))


def pieces_of_batch(batch: pa.RecordBatch, column: str, step: int = 2 << 20):
    """Slices of a batch of about ``step`` bytes of text, so that temporaries stay small."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, i = np.cumsum(lengths), 0
    while i < batch.num_rows:
        before = ends[i - 1] if i else 0
        k = max(i + 1, int(np.searchsorted(ends, before + step, "right")))
        yield batch.slice(i, k - i)
        i = k
