"""Ids of whole texts by a public tokenizer, with the ids of distinct pieces remembered.

A text is cut where the tokenizer's own splitting must cut, so the ids of a text are those
of its pieces in a row.  Each distinct piece is encoded once per worker; a piece that is
one run of Latin letters goes to the tokenizer's BPE model at once, any other piece and
any text without safe places to cut through the whole tokenizer.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_PIECES = 450_000
CACHED_BYTES = 48 << 20    # and the ids and characters of them
WHOLE = 1 << 18            # characters of uncut texts (or one text) encoded in a call
LATIN_END = "\u0250"
# a space or newline at an end or beside other white space: not a place to cut
_WHITE = r"[\s\p{Z}\x{85}\x0b\x1c-\x1f]"
ODD_SPACE = rf"(^|{_WHITE})[ \n]|[ \n]($|{_WHITE})|\x00"


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the
    characters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tok.model
        self.alphabet = byte_alphabet()
        self.forget()

    # -- what differs between vocabularies -------------------------------------------------
    def uncut(self, text: pa.Array) -> np.ndarray:
        """Which texts are encoded whole."""
        raise NotImplementedError

    def cut(self, text: pa.Array) -> pa.ListArray:
        """Pieces of the other texts."""
        raise NotImplementedError

    def one_run(self, piece: str) -> str | None:
        """The piece as the BPE model takes it, if it is a single run of Latin letters."""
        raise NotImplementedError

    def spell(self, run: str) -> str:
        return run.encode().decode("latin-1").translate(self.alphabet)

    # -- shared ----------------------------------------------------------------------------
    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = self.chars = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts or pieces that are not cut; a call holds a bounded number of them,
        as the tokenizer keeps far more than the id of each token until it returns."""
        out: list[np.ndarray] = []
        call: list[str] = []
        size = 0
        for i, t in enumerate(texts):
            call.append(t)
            size += len(t)
            if size >= WHOLE or i + 1 == len(texts):
                out += [np.array(e.ids, np.uint32) for e in
                        self.tok.encode_batch_fast(call, add_special_tokens=False)]
                call, size = [], 0
        return out

    def _learn(self, new: list[str]) -> None:
        runs = list(map(self.one_run, new))
        rest = [i for i, r in enumerate(runs) if r is None]
        other = dict(zip(rest, self.whole([new[i] for i in rest]), strict=True))
        size = np.zeros(len(new), np.int64)
        ids: list[int] = []
        tokenize = self.model.tokenize
        for i, r in enumerate(runs):
            n = len(ids)
            if r is None:
                ids += other[i].tolist()
            else:
                ids += [t.id for t in tokenize(r)]
            size[i] = len(ids) - n
        self._store(new, ids, size)

    def _store(self, new: list[str], ids: list[int] | np.ndarray, size: np.ndarray) -> None:
        k = len(self.slot)
        while k + len(new) > len(self.start):
            self.start, self.length = (np.resize(a, 2 * k + len(new)) for a in (self.start, self.length))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(ids), self.flat.dtype)])
        self.start[k:k + len(new)] = self.used + np.cumsum(size) - size
        self.length[k:k + len(new)] = size
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.chars += sum(map(len, new))
        self.slot.update(zip(new, range(k, k + len(new)), strict=True))

    def _ids(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these pieces in a row, where those of each piece end)."""
        size = self.length[slot]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.start[slot] - end + size, size) +
                         np.arange(end[-1] if len(end) else 0)], end

    def _keep(self, words: list[str]) -> None:
        """Forget all pieces but these, so that frequent ones are not encoded anew."""
        known = [w for w in words if w in self.slot]
        slot = np.fromiter(map(self.slot.__getitem__, known), np.int64, len(known))
        ids, size = self._ids(slot)[0], self.length[slot]
        self.forget()
        self._store(known, ids, size)

    def encode(self, text: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: empty)."""
        text = pc.fill_null(text, "")
        odd = self.uncut(text)
        out: list = [None] * len(text)
        whole = np.flatnonzero(odd)
        for i, ids in zip(whole, self.whole(text.take(pa.array(whole)).to_pylist()), strict=True):
            out[i] = ids
        easy = np.flatnonzero(~odd)
        if len(easy):
            cut = self.cut(text if len(easy) == len(text) else text.take(pa.array(easy)))
            off = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(cut)))])
            enc = cut.flatten().dictionary_encode()
            words = enc.dictionary.to_pylist()
            if len(self.slot) + len(words) > CACHED_PIECES or \
                    self.chars + self.flat.itemsize * self.used > CACHED_BYTES:
                self._keep(words)
            if new := [w for w in words if w not in self.slot]:
                self._learn(new)
            slot = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))[
                enc.indices.to_numpy(zero_copy_only=False)]
            ids, end = self._ids(slot)
            bound = np.concatenate([[0], end])[off]
            for k, i in enumerate(easy):
                out[i] = ids[bound[k]:bound[k + 1]]
        return out


class ByteEncoder(Encoder):
    """Byte-level vocabulary: a single space between two other characters starts a
    pre-token, a single newline there is one, and a point or comma after a letter starts
    one.  Texts with other white space beside a space or newline are encoded whole."""

    def uncut(self, text):
        return np.asarray(pc.match_substring_regex(text, ODD_SPACE)).astype(bool)

    def cut(self, text):
        t = pc.replace_substring(text, " ", "\0 ")
        t = pc.replace_substring_regex(pc.replace_substring(t, "\n", "\0\n\0"), r"(\pL)([.,])", "\\1\0\\2")
        return pc.split_pattern(t, "\0")

    def one_run(self, piece):
        run = piece[1:] if piece[:1] == " " else piece
        if not run.isalpha():
            return None
        if run.isascii():
            return piece if run is piece else "\u0120" + run
        return self.spell(piece) if max(run) < LATIN_END else None


class WordEncoder(Encoder):
    """Vocabulary of lower-cased words without white space: white space only parts
    pre-tokens, and ASCII punctuation after a letter starts one.  Texts that may hold a
    special token are encoded whole."""

    def uncut(self, text):
        return np.asarray(pc.match_substring(text, "<|")).astype(bool)

    def cut(self, text):
        t = pc.replace_substring_regex(pc.ascii_lower(text), r"([a-z])([.,;:!?])", "\\1 \\2")
        return pc.ascii_split_whitespace(t)

    def one_run(self, piece):
        if not piece.isalpha():
            return None
        if piece.isascii():
            return piece
        return self.spell(piece.lower()) if max(piece) < LATIN_END and "\u0130" not in piece else None


_ENCODERS: dict[tuple[type, str], Encoder] = {}


def encoder(kind: type[Encoder], name: str) -> Encoder:
    """The worker's encoder of that vocabulary, loaded once."""
    if (kind, name) not in _ENCODERS:
        _ENCODERS[kind, name] = kind(name)
    return _ENCODERS[kind, name]
