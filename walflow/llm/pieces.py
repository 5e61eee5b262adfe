"""SentencePiece encoding and decoding with a batched Viterbi in numpy.

Words (stretches between spaces, with the space before) of equal length advance together, one character a step. The substrings that end at a character
are looked up by hash among the sorted keys of the pieces; a vectorised maximum over them gives each word its best piece there and a backpointer.

Unigram models: the maximum is over the sums of piece scores. BPE models: an encoding is right exactly when each two neighbouring pieces are what merging
their joined characters gives, and just one piece can end the encoding of a prefix; so a candidate counts if it fits the piece before it, and the maximum
finds that one. Which pairs fit is worked out once a pair and remembered. The results equal the SentencePiece library's own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walflow.llm.common import own_id, whole_id

SPACE = "▁"
CACHE = 1_000_000  # words that a worker remembers, some 200 bytes each
WORDS_AT_ONCE = 20_000
DOCS_AT_ONCE = 1000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The pieces of a model file, ready for encoding and decoding."""

    def __init__(self, path: str, unigram: bool | None = None) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id = {self.names[i]: i for i in normal}
        score = np.array([model.get_score(i) for i in range(size)], np.float64)
        self.rank = {self.names[i]: score[i] for i in normal}
        # in a BPE model the scores of merged pieces are minus their order, whole numbers; a unigram model has log probabilities
        self.bpe = bool(all(score[i] == round(score[i]) for i in normal)) if unigram is None else not unigram
        self.longest = max(map(len, self.id), default=1)
        keys = np.array([self._key(s) for s in self.id], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(self.id.values()), np.int64)[order]
        self.score = score
        self.lowest = min((score[i] for i in normal), default=0.0) - 10.0
        self.alone = {i: self._merged(s) == [s] for s, i in self.id.items()} if self.bpe else {}
        self.fits: dict[int, bool] = {}
        #: Characters that stand side by side inside some piece; between any others no piece ever reaches across.
        self.inside = {s[i : i + 2] for s in self.id for i in range(len(s) - 1)}
        self.parts: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        surface = {i: s.replace(SPACE, " ").encode() for s, i in self.id.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.surface = [surface.get(i, b"") for i in range(size)]

    @staticmethod
    def _key(s: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in _mixed(np.array([ord(c) + 1 for c in s], np.uint64)):
                h = h * _MUL + c
            return _mixed(np.array([h + np.uint64(len(s))], np.uint64))[0]

    def _merged(self, s: str) -> list[str]:
        """Characters merged pair by pair: the best-scored joined piece first, leftmost among equals."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _name(self, i: int) -> str:
        return self.names[i] if i >= 0 else chr(-1 - i)

    def _fit(self, pairs: np.ndarray) -> np.ndarray:
        """Whether pieces (before, after), packed as numbers, are neighbours in their own encoding; characters without a piece are -1 - code point."""
        out = np.zeros(len(pairs), bool)
        for j, key in enumerate(pairs.tolist()):
            ok = self.fits.get(key)
            if ok is None:
                a, b = self._name((key >> 24) - (1 << 23)), self._name((key & 0xFFFFFF) - (1 << 23))
                ok = self._merged(a + b) == [a, b]
                if len(self.fits) > CACHE:
                    self.fits.clear()
                self.fits[key] = ok
            out[j] = ok
        return out

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Piece ids of words of one length; characters without a piece are -1 - code point."""
        n, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).astype(np.int64)
        prefix, power = np.zeros((n, length + 1), np.uint64), np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(1, len(power)):
                power[i] = power[i - 1] * _MUL
            mixed = _mixed((codes + 1).astype(np.uint64))
            for i in range(length):
                prefix[:, i + 1] = prefix[:, i] * _MUL + mixed[:, i]
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        last, back = np.zeros((n, length + 1), np.int64), np.zeros((n, length + 1), np.int64)
        for end in range(1, length + 1):
            spans = np.arange(1, min(end, self.longest) + 1)
            with np.errstate(over="ignore"):
                keys = _mixed(prefix[:, end, None] - prefix[:, end - spans] * power[spans] + spans.astype(np.uint64))
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            piece = np.where(self.keys[at] == keys, self.ids[at], -(1 << 40))
            none = piece[:, 0] < 0
            piece[none, 0] = -1 - codes[none, end - 1]
            there = (piece > -(1 << 40)) & np.isfinite(best[:, end - spans])
            if self.bpe:
                value, left = np.full(piece.shape, -np.inf), np.ones(n, bool)
                for s in range(len(spans) - 1, -1, -1):  # one candidate is right, most often the longest
                    w = np.flatnonzero(left & there[:, s])
                    if not len(w):
                        continue
                    own, before = piece[w, s], end - int(spans[s])
                    pair = own if before == 0 else ((last[w, before] + (1 << 23)) << 24) + own + (1 << 23)
                    some, where = np.unique(pair, return_inverse=True)
                    ok = (np.array([self.alone.get(i, True) for i in some.tolist()], bool) if before == 0 else self._fit(some))[where]
                    value[w[ok], s] = 0
                    left[w[ok]] = False
            else:
                gain = np.where(piece >= 0, self.score[np.maximum(piece, 0)], self.lowest)
                value = np.where(there, best[:, end - spans] + gain, -np.inf)
            pick = value.argmax(1)
            best[:, end], last[:, end], back[:, end] = value[np.arange(n), pick], piece[np.arange(n), pick], spans[pick]
        out: list[list[int]] = [[] for _ in words]
        at = np.full(n, length)
        rows = np.arange(n)
        while (open_rows := rows[at > 0]).size:
            for j in open_rows.tolist():
                out[j].append(int(last[j, at[j]]))
            at[open_rows] -= back[open_rows, at[open_rows]]
        return [x[::-1] for x in out]

    def _numbers(self, pieces: list[int]) -> bytes:
        ids: list[int] = []
        for k, p in enumerate(pieces):
            if p >= 0:
                ids.append(p)
            elif self.bytes:
                ids += [self.bytes[b] for b in chr(-1 - p).encode("utf-8", "surrogatepass")]
            elif not k or pieces[k - 1] >= 0:
                ids.append(self.unknown)  # one for a run of unknown characters
        return np.array(ids, "<u4").tobytes()

    def _split(self, word: str) -> list[str]:
        """The word cut wherever no piece reaches across."""
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, words: set[str], known: dict[str, bytes]) -> None:
        split = {w: self._split(SPACE + w) for w in words}
        if len(self.parts) > CACHE // 2:
            self.parts.clear()
        by_length: dict[int, list[str]] = {}
        for part in {p for ps in split.values() for p in ps if p not in self.parts}:
            by_length.setdefault(len(part), []).append(part)
        for same in by_length.values():
            for at in range(0, len(same), WORDS_AT_ONCE):
                some = same[at : at + WORDS_AT_ONCE]
                self.parts.update(zip(some, map(self._numbers, self.viterbi(some)), strict=True))
        known.update({w: b"".join(map(self.parts.__getitem__, ps)) for w, ps in split.items()})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers; an empty text has none. The encoder puts a space before a text."""
        split = []
        for t in texts:
            t = t.replace(SPACE, " ") if SPACE in t else t
            words = t.split(" ") if t else []
            if "" in words:  # of several spaces all but one stay with the word after them
                words = [m[1:].replace(" ", SPACE) for m in re.findall(" +[^ ]*", " " + t)]
            split.append(words)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        self._learn({w for ws in split for w in ws if w not in known}, known)
        return [b"".join(map(known.__getitem__, ws)) for ws in split]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of ids; the leading space is the encoder's own and goes. Ids without a surface are dropped."""
        out = []
        for x in ids:
            s = b"".join(map(self.surface.__getitem__, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace")
            out.append(s[1:] if s[:1] == " " else s)
        return out


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """One for all the tasks that a worker process runs."""
    return Pieces(path)


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, ids (binary, little-endian unsigned 32-bit), n_ids, ids_crc32, round_trip.

    round_trip: whether decoding gives the text back; a text holding U+2581 itself does not, as that sign stands for a space. Null text is empty and has no
    ids. Repeated rows get a row each. Empty tables give empty results; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model_path)
        for batch in batches:
            for at in range(0, len(batch), DOCS_AT_ONCE):
                part = batch.iloc[at : at + DOCS_AT_ONCE]
                texts = [t or "" for t in part["text"]]
                ids = pieces.encode(texts)
                back = pieces.decode(ids)
                yield pd.DataFrame({"doc_id": part["doc_id"], "no_id": part["no_id"], "ids": ids, "n_ids": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids], "round_trip": [a == b for a, b in zip(texts, back, strict=True)]})

    return own_id(docs.select(*whole_id(docs), "text").mapInPandas(run, "doc_id long, no_id boolean, ids binary, n_ids long, ids_crc32 long, round_trip boolean"))


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """rows (doc_id, ids) -> doc_id, text. Null ids are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model_path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "no_id": batch["no_id"], "text": pieces.decode([x or b"" for x in batch["ids"]])})

    return own_id(rows.select(*whole_id(rows), "ids").mapInPandas(run, "doc_id long, no_id boolean, text string"))
