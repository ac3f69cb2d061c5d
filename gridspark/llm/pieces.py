"""Piece encoding by batched Viterbi in numpy, and decoding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # stands for a blank inside pieces
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
BASE = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(44)
MEMO = 400_000  # distinct words a task remembers
WINDOW = 200_000  # characters whose pieces are looked up together


@dataclass
class Pieces:
    """A vocabulary: pieces with scores, sorted by hash, and the ids of the 256 byte pieces."""

    texts: list[str]
    keys: np.ndarray
    present: np.ndarray     # which leading bits of a hash occur among the keys
    ids: np.ndarray
    scores: np.ndarray
    points: np.ndarray      # code points of each piece, filled up with zeros
    lengths: np.ndarray
    longest: int
    bytes_: np.ndarray      # byte value -> id
    unknown: float          # score of a character without a piece
    values: np.ndarray      # id -> byte value or -1


def vocabulary(pieces: list[tuple[str, float]], byte_ids: dict[int, int], skip: set[int]) -> Pieces:
    """From ``(piece, score)`` by id, ids of byte pieces by value, and ids that encoding never gives."""
    own = [i for i in range(len(pieces)) if i not in skip and i not in set(byte_ids.values()) and pieces[i][0]]
    longest = max(len(pieces[i][0]) for i in own)
    points = np.zeros((len(own), longest), dtype=np.uint32)
    lengths = np.array([len(pieces[i][0]) for i in own])
    for row, i in enumerate(own):
        points[row, :lengths[row]] = [ord(c) for c in pieces[i][0]]
    keys = np.zeros(len(own), dtype=np.uint64)
    for n in range(1, longest + 1):
        rows = lengths == n
        keys[rows] = _hashes(points[rows, :n], n)[:, 0]
    order = np.argsort(keys, kind="stable")
    scores = np.array([pieces[i][1] for i in own], dtype=np.float64)
    values = np.full(len(pieces), -1, dtype=np.int16)
    by_value = np.zeros(256, dtype=np.int32)
    for value, i in byte_ids.items():
        values[i], by_value[value] = value, i
    present = np.zeros(1 << 20, dtype=bool)
    present[keys >> SHIFT] = True
    return Pieces([p for p, _ in pieces], keys[order], present, np.array(own, dtype=np.int32)[order], scores[order], points[order],
                  lengths[order], longest, by_value, float(scores.min()) - 10.0, values)


def load(model_file: str) -> Pieces:
    """The vocabulary of a sentencepiece model file, read where the job is planned."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(sp.get_piece_size())
    byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
    skip = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    return vocabulary([(sp.id_to_piece(i), sp.get_score(i)) for i in ids], byte_ids, skip)


def _hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all substrings of ``n`` code points of each row."""
    spots = points.shape[1] - n + 1
    h = np.full((len(points), spots), n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ points[:, k:k + spots].astype(np.uint64)) * BASE
        h ^= h >> np.uint64(29)
    return h * BASE


def _starting(points: np.ndarray, vocab: Pieces, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and vocabulary rows of the pieces that start at positions ``lo`` to ``hi - 1``, by length, row and position."""
    n, size = points.shape
    score = np.full((vocab.longest + 1, n, hi - lo), -np.inf)
    rows = np.full((vocab.longest + 1, n, hi - lo), -1, dtype=np.int32)
    for k in range(1, min(vocab.longest, size - lo) + 1):
        part = points[:, lo:hi + k - 1]
        h = _hashes(part, k)
        w, s = np.nonzero(vocab.present[h >> SHIFT])  # most substrings are no piece and end here
        h = h[w, s]
        at = np.minimum(np.searchsorted(vocab.keys, h), len(vocab.keys) - 1)
        known = (vocab.keys[at] == h) & (vocab.lengths[at] == k)
        w, s, piece = w[known], s[known], at[known]
        # equal hashes are compared character by character
        same = (part[w[:, None], s[:, None] + np.arange(k)] == vocab.points[piece, :k]).all(axis=1)
        w, s, piece = w[same], s[same], piece[same]
        score[k, w, s], rows[k, w, s] = vocab.scores[piece], piece
    score[1][rows[1] < 0] = vocab.unknown
    return score, rows


def viterbi(points: np.ndarray, vocab: Pieces, cells: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of equally long words, rows of code points.

    Returns per row and end position the start of the last piece, and its row in the vocabulary (-1: a character without
    piece).  The score of a segmentation is the sum of its pieces; of equal ones the longer last piece wins.
    Pieces are looked up for about ``cells`` starts at a time, so a word of any length holds a few numbers per character.
    """
    n, size = points.shape
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    start, last = np.zeros((n, size + 1), dtype=np.int32), np.full((n, size + 1), -1, dtype=np.int32)
    wide, row = max(vocab.longest, cells // max(n, 1)), np.arange(n)
    score, rows, base = np.empty((vocab.longest + 1, n, 0)), np.empty((vocab.longest + 1, n, 0), dtype=np.int32), 0
    for lo in range(0, size, wide):
        hi = min(lo + wide, size)
        tail = min(vocab.longest, lo - base)  # starts before the window whose pieces end in it
        old = score[:, :, lo - base - tail:], rows[:, :, lo - base - tail:]
        score, rows = _starting(points, vocab, lo, hi)
        if tail:
            score, rows = np.concatenate([old[0], score], axis=2), np.concatenate([old[1], rows], axis=2)
        base = lo - tail
        for e in range(lo + 1, hi + 1):
            ks = np.arange(min(vocab.longest, e), 0, -1)
            total = best[:, e - ks] + score[ks, :, e - ks - base].T
            pick = total.argmax(axis=1)  # the first maximum, so the longest piece
            k = ks[pick]
            best[:, e], start[:, e], last[:, e] = total[row, pick], e - k, rows[k, row, e - k - base]
    return start, last


def encode_words(words: list[str], vocab: Pieces) -> list[bytes]:
    """Ids of words as little-endian int32, a word being blanks and then other characters; equally long words advance together."""
    out: list[bytes] = [b""] * len(words)
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for size, where in groups.items():
        step = max(1, WINDOW // max(size, 1))
        for s in range(0, len(where), step):
            part = where[s:s + step]
            points = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(part), size)
            start, last = viterbi(points, vocab)
            found = np.full((len(part), size), -2, dtype=np.int32)  # the piece that ends there, -1: a character without one
            ends, active = np.full(len(part), size), np.arange(len(part))
            while len(active):
                e = ends[active]
                found[active, e - 1] = last[active, e]
                ends[active] = start[active, e]
                active = active[ends[active] > 0]
            met = found > -2
            ids = vocab.ids[found[met]].astype("<i4").tobytes()
            upto = np.concatenate(([0], np.cumsum(met.sum(axis=1)))) * 4
            for i, x, y in zip(part, upto[:-1].tolist(), upto[1:].tolist()):
                out[i] = ids[x:y]
            for r in np.flatnonzero((found == -1).any(axis=1)).tolist():
                out[part[r]] = b"".join(
                    vocab.ids[p].tobytes() if p >= 0 else vocab.bytes_[list(_char(c).encode())].tobytes()
                    for p, c in zip(found[r].tolist(), points[r].tolist()) if p > -2)
    return out


ASIDE = "\udfff"  # no text holds a lone surrogate: it keeps the place of a stand-in character of the text itself


def _char(point: int) -> str:
    return SPACE if point == 0xDFFF else chr(point)


def prepare(text: str) -> str:
    """Blanks become stand-ins after a leading one; a stand-in of the text itself is set aside to become bytes."""
    return (SPACE + text.replace(SPACE, ASIDE).replace(" ", SPACE)) if text else ""


class Coder:
    """Encodes and decodes texts of a task; remembers words, up to a bound on their number."""

    def __init__(self, vocab: Pieces):
        self.vocab = vocab
        self.memo: dict[str, bytes] = {}
        self.bytes = [bytes([v]) if v >= 0 else p.replace(SPACE, " ").encode() for p, v in zip(vocab.texts, vocab.values.tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [UNIT.findall(prepare(t)) for t in texts]
        new = list({w for words in split for w in words if w not in self.memo})
        if len(self.memo) + len(new) > MEMO:
            self.memo = {}
            new = list({w for words in split for w in words})
        for w, ids in zip(new, encode_words(new, self.vocab)):
            self.memo[w] = ids
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), dtype="<i4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def encode(docs: DataFrame, model_file: str, texts_at_once: int = 512) -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text.  Missing and empty texts have no ids; each row stands for itself."""
    vocab = load(model_file)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(vocab)
        for batch in batches:
            for s in range(0, len(batch), texts_at_once):
                part = batch.iloc[s:s + texts_at_once]
                yield pd.DataFrame({"doc_id": part.doc_id, "ids": coder.encode(part.text.fillna("").tolist())})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInPandas(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; missing ids give an empty text."""
    vocab = load(model_file)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(vocab)
        for batch in batches:
            texts = [coder.decode(np.asarray(x, dtype=np.int32)) if x is not None else "" for x in batch.ids]
            yield pd.DataFrame({"doc_id": batch.doc_id, "text": texts})

    own = coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return own.mapInPandas(run, "doc_id long, text string")


def coded(docs: DataFrame, model_file: str, texts_at_once: int = 512) -> DataFrame:
    """Per document ``n_pieces, n_bytes_pieces, ids_crc32`` and whether decoding gives the text back."""
    vocab = load(model_file)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(vocab)
        for batch in batches:
            for s in range(0, len(batch), texts_at_once):
                part = batch.iloc[s:s + texts_at_once]
                texts = part.text.fillna("").tolist()
                ids = coder.encode(texts)
                yield pd.DataFrame({
                    "doc_id": part.doc_id, "n_pieces": [len(x) for x in ids],
                    "n_byte_pieces": [int((vocab.values[x] >= 0).sum()) for x in ids],
                    "ids_crc32": [zlib.crc32(x.astype("<i4").tobytes()) for x in ids],
                    "same": [coder.decode(x) == t for x, t in zip(ids, texts)]})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInPandas(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, same boolean")
