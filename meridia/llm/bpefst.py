"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The encoder reads a pre-token byte by byte. The BPE encoding of a text has exactly one last
token for each prefix, and a sequence of tokens is an encoding if and only if every two
neighbours encode to themselves when joined. So the last token of a prefix follows from (a) the
longest suffix that some longer token starts with and (b) the last token of each prefix that ends
inside that suffix where a longer token can still start. These make a state, together with (c) the tokens
that lead to each of these prefixes and aren't final yet. A token is final once all of these ways begin with it:
a transition on a byte gives the next state and the tokens that it makes final, so tokens come after a lookahead of
less than the longest token. States and transitions are made when first
needed and then kept, so the merge table is compiled only as far as the data ask for. A pre-token that is a
token as a whole is that token, as ranked encoders have it.

Decoding is a machine of the same kind: its states are the bytes of a character that is still open, and a
transition on a token, made by the incremental UTF-8 machine when first needed, gives the text that the token completes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.tokens import MARKS, assemble, chunks, gather, pieces_of_batch
from meridia.llm.workspace import ship, tidy

#: Distinct pre-tokens of a generation that a Python worker remembers; two generations are kept, so what is asked again stays.
MEMORY = 200_000
#: Transitions beyond which the machine starts afresh.
TRANSITIONS = 700_000
_LOADED: dict[tuple[str, str], "BpeTransducer"] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class State(dict):
    """Byte -> (next state, ids that are final), filled when first asked. ``tail`` is the longest suffix that
    starts a longer token; ``lasts`` are the last tokens of the prefixes that end at its places, from
    before its first byte to its end: empty at the start of the text, None where no token starts. ``ways`` are the ids behind the
    final ones up to each of these prefixes; the last of them ends the text, if it ends here."""

    __slots__ = ("lasts", "machine", "tail", "ways")

    def __init__(self, machine: BpeTransducer, tail: bytes, lasts: tuple[bytes | None, ...], ways: tuple[tuple[int, ...] | None, ...]):
        self.machine, self.tail, self.lasts, self.ways = machine, tail, lasts, ways

    def __missing__(self, byte: int) -> tuple[State, tuple[int, ...]]:
        self.machine.made += 1
        step = self[byte] = self.machine._advance(self, bytes((byte,)))
        return step


class BpeTransducer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.starts = {t[:i] for t in ranks for i in range(len(t))}
        self._merged: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._reset()
        # ids as packed uint32: a quarter of the memory of lists
        self.pieces: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.made = 0
        self.start = self._state(b"", (b"",), ((),))

    @classmethod
    def of(cls, path: str, pattern: str) -> BpeTransducer:
        if (path, pattern) not in _LOADED:
            _LOADED[path, pattern] = cls(load_ranks(path), pattern)
        return _LOADED[path, pattern]

    def _state(self, *key) -> State:
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = State(self, *key)
        return state

    def _merge(self, text: bytes) -> list[bytes]:
        """Merging by rank: the definition, for tests."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """What a token's last merge joined; None for a single byte or a token that merging doesn't give."""
        parts = self._merged.get(token, ())
        if parts == ():
            pieces = [token[i : i + 1] for i in range(len(token))]
            parts = None
            while len(pieces) > 1:
                found = [(r, i) for i in range(len(pieces) - 1) if (r := self.ranks.get(pieces[i] + pieces[i + 1])) is not None]
                if not found:
                    parts = None
                    break
                i = min(found)[1]
                parts = (pieces[i], pieces[i + 1])
                pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
            self._merged[token] = parts
        return parts

    def _fit(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens stay as they are when joined; an empty left asks for the token alone.

        The merges on both sides of the border are undone from the latest one. The tokens that touch the
        border at some time would have merged across it, had that merge come before the next one undone.
        """
        key = (left, right)
        ok = self._fits.get(key)
        if ok is None:
            if len(self._fits) > TRANSITIONS:
                self._fits.clear()
            ok = self._fits[key] = self._border_holds(left, right) if left else len(right) == 1 or self._parts(right) is not None
        return ok

    def _border_holds(self, left: bytes, right: bytes) -> bool:
        ranks, until = self.ranks, float("inf")
        while True:
            across = ranks.get(left + right)
            if across is not None and across < until:
                return False
            a, b = (ranks[left] if len(left) > 1 else -1), (ranks[right] if len(right) > 1 else -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                # at equal ranks the merge further left comes first
                until, left = a, self._parts(left)[1]
            else:
                until, right = b + 0.5, self._parts(right)[0]

    def _advance(self, state: State, byte: bytes) -> tuple[State, tuple[int, ...]]:
        text, lasts = state.tail + byte, state.lasts
        n = len(text)
        for at in range(n - 1, -1, -1):
            token, before = text[at:], lasts[at]
            # the one token that fits behind the prefix before it
            if before is not None and token in self.ranks and self._fit(b"", token) and (not before or self._fit(before, token)):
                break
        else:
            raise ValueError("some byte isn't a token")
        cut = 0
        while text[cut:] not in self.starts:
            cut += 1
        places = [k if text[k:] in self.starts and lasts[k] is not None else None for k in range(cut, n)]
        ways = [None if k is None else state.ways[k] for k in places] + [state.ways[at] + (self.ranks[token],)]
        there = [w for w in ways if w is not None]
        final = 0
        while len(first := {w[final : final + 1] for w in there}) == 1 and () not in first:
            final += 1
        ways = tuple(None if w is None else w[final:] for w in ways)
        kept = [None if k is None else lasts[k] for k in places]
        return self._state(text[cut:], (*kept, token), ways), there[0][:final]

    def transduce(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out = self.start, []
        for b in piece:
            state, ids = state[b]
            if ids:
                out += ids
        out += state.ways[-1]
        if self.made > TRANSITIONS:
            self._reset()
        return out

    def stream(self, piece: Iterable[int]) -> Iterator[int]:
        """Ids of one pre-token's bytes as they come, each as soon as it is final; a pre-token that is a
        token as a whole isn't known as such before its end, and comes as its merges give it."""
        state = self.start
        for b in piece:
            state, ids = state[b]
            yield from ids
        yield from state.ways[-1]

    def packed(self, pieces: Iterable[str]) -> list[bytes]:
        """Ids of pre-tokens, each packed as uint32."""
        if len(self.pieces) > MEMORY:
            self.pieces, self.before = {}, self.pieces
        known, before, out = self.pieces, self.before, []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = before.get(piece)
                if ids is None:
                    ids = array("I", self.transduce(piece.encode())).tobytes()
                known[piece] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return array("I", b"".join(self.packed(self.pattern.findall(text)))).tolist()

    def encode_chunks(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, each with a space before it, flat, and their bounds. Letters with plain marks behind are two
        pre-tokens at sight; all else goes through the pattern."""
        whole = lambda chunks: [b"".join(self.packed(self.pattern.findall(" " + c))) for c in chunks]
        spelt = lambda heads: self.packed([" " + h if h[0] not in MARKS else h for h in heads])
        return assemble(words, spelt, whole, False)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Utf8Stream:
    """Incremental UTF-8 state machine: feed bytes in any cuts, get the text that is complete so far.

    A state is the number of continuation bytes to come and the range allowed for the next one;
    a byte that doesn't fit gives U+FFFD, counts in ``errors``, and the machine starts afresh, at that byte if it can.
    """

    def __init__(self):
        self.held, self.more, self.low, self.high, self.errors = bytearray(), 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        if not self.more and data.isascii():
            return data.decode("ascii")
        out: list[str] = []
        for b in data:
            if self.more:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.more, self.low, self.high = self.more - 1, 0x80, 0xBF
                    if not self.more:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append("�")
                self.errors += 1
                self._clear()
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.held.append(b)
                self.more = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                # overlong forms, surrogates and values over U+10FFFF end at the second byte
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
                self.errors += 1
        return "".join(out)

    def _clear(self) -> None:
        self.held.clear()
        self.more, self.low, self.high = 0, 0x80, 0xBF

    def close(self) -> str:
        rest = "�" if self.more else ""
        self.errors += len(rest)
        self._clear()
        return rest


def stream_text(tokens: Iterable[bytes]) -> Iterator[str]:
    """Text after each token; a character that tokens share comes with its last byte."""
    machine = Utf8Stream()
    for token in tokens:
        yield machine.feed(token)
    rest = machine.close()
    if rest:
        yield rest


class Open(dict):
    """A state of the decoder: token id -> (text completed, next state), filled when first asked. ``held`` are the
    bytes of the open character; ``broken`` tells that some byte before didn't fit."""

    __slots__ = ("broken", "decoder", "held")

    def __init__(self, decoder: TokenDecoder, held: bytes, broken: bool):
        self.decoder, self.held, self.broken = decoder, held, broken

    def __missing__(self, token: int) -> tuple[str, Open]:
        machine = Utf8Stream()
        machine.feed(self.held)
        text = machine.feed(self.decoder.bytes_of[token])
        step = self[token] = text, self.decoder.state(bytes(machine.held), self.broken or machine.errors > 0)
        return step


class TokenDecoder:
    """Streaming decoder of token ids."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.states: dict[tuple[bytes, bool], Open] = {}
        self.start = self.state(b"", False)
        self.digits = {i: str(i) for i in bytes_of}

    def state(self, held: bytes, broken: bool) -> Open:
        # an open character has three bytes at most, so the states are few
        found = self.states.get((held, broken))
        if found is None:
            found = self.states[held, broken] = Open(self, held, broken)
        return found

    def decode(self, ids: Iterable[int]) -> tuple[str, bool]:
        """The text, and whether all bytes made characters."""
        start = self.start
        steps = [start[i] for i in ids]
        if all([s is start for _, s in steps]):
            # every token ends where it began, between characters
            return "".join([t for t, _ in steps]), True
        state, out = start, []
        for i in ids:
            text, state = state[i]
            out.append(text)
        if state.held:
            out.append("�")
        return "".join(out), not state.broken and not state.held


def encode_batch(machine: BpeTransducer, texts: pa.Array) -> Iterator[list[int]]:
    """Ids of each text. Texts are cut before single spaces that follow other than white space, where
    the pattern cuts as well; each distinct chunk is encoded once. Other texts are encoded whole."""
    texts = pc.fill_null(texts, "")
    spelt, codes, first = chunks(texts)
    words = spelt.to_pylist()
    open_end = np.fromiter((not w or w[-1].isspace() for w in words), dtype=np.int64, count=len(words))
    upto = np.concatenate([[0], np.cumsum(open_end[codes])])
    last = np.maximum(first[1:] - 1, first[:-1])
    whole = upto[last] > upto[first[:-1]]
    # chunks behind a space, of the texts that are cut
    inner = np.repeat(~whole, np.diff(first))
    inner[first[:-1][first[:-1] < first[1:]]] = False
    used, where = np.unique(codes[inner], return_inverse=True)
    flat, bounds = machine.encode_chunks(spelt.take(pa.array(used)))
    ids, ends = gather(flat, bounds, where)
    stop = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(inner)])[first]]
    for i, (lo, hi) in enumerate(zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)):
        if whole[i]:
            yield machine.encode(texts[i].as_py())
        else:
            head = words[codes[first[i]]] if first[i + 1] > first[i] else ""
            yield (machine.encode(head) if head else []) + ids[lo:hi].tolist()


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, valid_utf8) of each row: its text encoded and its
    ids decoded again. Null and empty texts have no ids; every input row gives one row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = BpeTransducer.of(ranks_path, pattern)
        decoder = TokenDecoder(machine.bytes_of)
        digit = decoder.digits.__getitem__
        for whole in batches:
            for batch in pieces_of_batch(whole, "text", 4 << 20):
                counts, ids_sha, decoded_sha, valid = [], [], [], []
                for ids in encode_batch(machine, batch.column("text")):
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(digit, ids)).encode()).hexdigest())
                    text, fits = decoder.decode(ids)
                    # text that isn't whole can't give its bytes back
                    decoded_sha.append(hashlib.sha256(text.encode() if fits else machine.decode(ids)).hexdigest())
                    valid.append(fits)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string()), pa.array(valid, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "valid_utf8"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean")

