"""Piece ids and piece counts of texts, computed once per distinct chunk of a task's texts.

A chunk is what stands between two separators at which the tokenizer always starts anew, so a text's tokens are its
chunks' tokens in a row. Chunks are found and hashed by array operations; only chunks that a worker hasn't met lately
are tokenized.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import SPACE, WORKER_CACHES, Words, mix, ragged, words_of

#: Distinct chunks a worker remembers; beyond it begins anew, so its memory is bounded.
MEMO = 2_000_000
#: Chunks tokenized in one call.
JOINED = 1000


class ChunkTable:
    """For chunk hashes: offset and length in `values`. encode(chunk texts) -> all chunks' values in a row, and how many each has."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: type) -> None:
        self.encode, self.dtype = encode, dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # ascending; the other arrays are in this order
        self.at, self.length, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def rows(self, keys: np.ndarray, text: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row of each key, and the table's arrays. text(i): the chunk of keys[i]."""
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > MEMO:
            self.clear()
        found = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = found < len(self.keys)
        known[inside] = self.keys[found[inside]] == unique[inside]
        if len(new := np.flatnonzero(~known)):
            got, lengths = self.encode([text(i) for i in first[new].tolist()])
            place = found[new]
            self.keys = np.insert(self.keys, place, unique[new])
            self.at = np.insert(self.at, place, len(self.values) + np.cumsum(lengths) - lengths)
            self.length = np.insert(self.length, place, lengths)
            self.values = np.concatenate([self.values, got]).astype(self.dtype, copy=False)
            found = np.searchsorted(self.keys, unique)
        return found[inverse], self.at, self.length, self.values


@functools.lru_cache(4)
def _bpe(path: str) -> ChunkTable:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    # An added token that isn't normalised parts a text before anything else happens: chunks on both sides are tokenized as if alone.
    mark = next(((i, a.content) for i, a in t.get_added_tokens_decoder().items() if not (a.normalized or a.single_word or a.lstrip or a.rstrip)), None)

    def alone(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [t.encode(c, add_special_tokens=False).ids for c in chunks]
        return np.fromiter((i for ids in got for i in ids), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def joined(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks in one call, with the mark after each; those that hold the mark themselves call for single calls."""
        ids = np.array(t.encode("".join(c + mark[1] for c in chunks), add_special_tokens=False).ids, np.uint32)
        is_mark = ids == mark[0]
        if is_mark.sum() != len(chunks):
            return alone(chunks)
        return ids[~is_mark], np.diff(np.flatnonzero(is_mark), prepend=-1) - 1

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [(joined if mark else alone)(chunks[k : k + JOINED]) for k in range(0, len(chunks), JOINED)]
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    return ChunkTable(encode, np.uint32)


WORKER_CACHES.append(_bpe.cache_clear)


def bpe_ids(texts: pa.StringArray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts in a row, and where each text's ids begin (one place more than texts).

    The vocabulary file's tokenizer drops white space and never joins what white space parts, so a text may be cut there.
    """
    w = words_of(texts, SPACE)
    raw = w.buf.tobytes()
    rows, at, length, values = _bpe(path).rows(w.hashes(), lambda i: raw[w.start[i] : w.end[i]].decode())
    n = length[rows]
    ids = values[ragged(at[rows], n)]
    return ids, np.concatenate([[0], np.cumsum(n)])[w.first]


def piece_rows(texts: pa.StringArray, path: str, end_id: int, max_len: int) -> list[tuple[int, int, int, int, int]]:
    """(text's index, piece, start, length, crc32 of the ids) of every piece: a text's ids and then end_id, cut only if longer than max_len."""
    ids, first = bpe_ids(texts, path)
    out = []
    for i in range(len(texts)):
        own = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4")
        for p, s in enumerate(range(0, len(own), max_len)):
            piece = own[s : s + max_len]
            out.append((i, p, s, len(piece), zlib.crc32(piece.tobytes())))
    return out


# ---------------------------------------------------------------- unigram


class Unigram:
    """Best segmentations under a unigram vocabulary.

    The best segmentation has the largest sum of scores. Ties as in the public implementations: going by increasing
    end, a path is replaced only by a strictly better one, paths being tried by increasing start of their last piece;
    so of equal paths the one with the longest last piece wins. A character that is no piece by itself may also be
    taken as unknown, at the lowest score less 10; it counts as its UTF-8 bytes, the vocabulary's byte pieces.
    """

    def __init__(self, pieces: dict[str, float]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        #: White space that no piece has: every segmentation has a boundary on both sides of it.
        used = {c for p in pieces for c in p}
        self.breaks = bytes(ord(c) for c in "\t\n\x0b\x0c\r" if c not in used)

    def count(self, text: str) -> tuple[int, float]:
        """Pieces of the best segmentation and its score, carried along without keeping the segmentation."""
        n = len(text)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.automaton):
            for end, (length, s) in self.automaton.iter(text):
                ends[end].append((length, s))
        for i in range(n):
            best = None
            for length, s in ends[i]:
                got = score[i + 1 - length] + s
                if best is None or got > best or (got == best and length > longest):
                    best, longest, many = got, length, pieces[i + 1 - length] + 1
            if text[i] not in self.single:
                got = score[i] + self.unknown
                if best is None or got > best:
                    best, many = got, pieces[i] + len(text[i].encode())
            score[i + 1], pieces[i + 1] = best, many
        return pieces[n], score[n]


def read_pieces(model_file: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model file, without its control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


@functools.lru_cache(4)
def _unigram(path: str) -> tuple[Unigram, ChunkTable]:
    u = Unigram(read_pieces(path))
    return u, ChunkTable(lambda chunks: (np.array([u.count(c) for c in chunks], np.float64).ravel(), np.full(len(chunks), 2)), np.float64)


def unigram_counts(texts: pa.StringArray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and score of each text; a space stands for U+2581, and a text that isn't empty gets one in front.

    No piece has U+2581 after another character, so every segmentation has a boundary before a run of spaces; and around `breaks`.
    """
    u, memo = _unigram(path)
    w = words_of(texts, b" " + u.breaks)
    # A chunk: a word with the separators before it; the separators at a text's end are a chunk too.
    n = w.counts()
    size = np.diff(w.text_at)
    last_end = np.zeros(len(n), np.int64)
    if len(w.end):
        last_end = np.where(n > 0, w.end[np.maximum(w.first[1:] - 1, 0)], w.text_at[:-1])
    else:
        last_end = w.text_at[:-1]
    tail = last_end < w.text_at[1:]
    owner = np.repeat(np.arange(len(n)), n)
    start = np.concatenate([[0], w.end[:-1]]) if len(w.end) else np.zeros(0, np.int64)
    start = np.maximum(start, w.text_at[owner]) if len(owner) else start
    start = np.concatenate([start, last_end[tail]])
    end = np.concatenate([w.end, w.text_at[1:][tail]])
    owner = np.concatenate([owner, np.flatnonzero(tail)])
    is_first = start == w.text_at[owner]
    keys = mix(w.hashes(start, end) ^ is_first.astype(np.uint64))
    raw = w.buf.tobytes()
    rows, at, _, values = memo.rows(keys, lambda i: ("▁" if is_first[i] else "") + raw[start[i] : end[i]].decode().replace(" ", "▁"))
    pieces, score = values[at[rows]], values[at[rows] + 1]
    return np.bincount(owner, pieces, len(n)).astype(np.int64), np.bincount(owner, score, len(n)) + 0.0 * size
