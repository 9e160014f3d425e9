"""Counts of whole texts that quality rules and classifiers share, computed a slice at a time."""

from __future__ import annotations

import numpy as np

from parchmill.llm.textbuf import SPACED, Hasher, grams, mix, per_row, spans, sums

SYMBOLS = np.zeros(256, np.int32)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
HEAD = np.ones(256, np.int32)
HEAD[0x80:0xC0] = 0  # bytes that continue a character


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[[ord(c) for c in chars]] = 1
    return table


UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALPHA = UPPER + _class("abcdefghijklmnopqrstuvwxyz")
DIGIT = _class("0123456789")
STOPS = _class(".!?")
COMMAS = _class(",;:")
BANGS = _class("!")
WIDE = np.zeros(256, np.int32)
WIDE[0xC0:] = 1  # first bytes of characters beyond ASCII


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a key occurs twice or more, whether it is its key's first occurrence)."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    last = np.ones(len(keys), bool)
    last[:-1] = new[1:]
    many, first = np.empty(len(keys), bool), np.empty(len(keys), bool)
    many[order], first[order] = ~(new & last), new
    return many, first


class Counts:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each row, and the
    words' places for further measures."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, n = buf, off, len(off) - 1
        self.n = n
        self.start, self.end, self.row = spans(buf, off, SPACED)
        self.n_words = per_row(self.row, n)
        self.word_chars = sums(SPACED[buf] * HEAD[buf], off)
        self.n_symbols = sums(SYMBOLS[buf], off)
        hasher = Hasher(buf)
        self.hashes = hasher(self.start, self.end)
        salt = mix(np.arange(1, n + 1, dtype=np.uint64))
        at, windows = grams(self.hashes, self.row, 3)
        again = at[repeated(windows ^ salt[self.row[at]])[0]]
        hit = np.zeros(len(self.start), bool)
        for k in range(3):
            hit[again + k] = True
        self.n_repeat_words = per_row(self.row[hit], n)
        # Lines: every row starts one, every \n but none else starts another.
        breaks = np.flatnonzero(buf == 10)
        of = np.searchsorted(off, breaks, "right") - 1
        begin = np.concatenate([off[:-1], breaks + 1])
        line_row = np.concatenate([np.arange(n), of])
        order = np.lexsort((begin, line_row))
        begin, line_row = begin[order], line_row[order]
        self.n_lines = per_row(line_row, n)
        stop = np.empty(len(begin), np.int64)
        stop[:-1] = begin[1:] - 1
        final = np.ones(len(begin), bool)
        final[:-1] = line_row[1:] != line_row[:-1]
        stop[final] = off[line_row[final] + 1]
        worded = np.searchsorted(self.start, stop) > np.searchsorted(self.start, begin)
        begin, stop, line_row = begin[worded], stop[worded], line_row[worded]
        first = repeated(hasher(begin, stop) ^ salt[line_row])[1]
        self.n_dup_lines = per_row(line_row[~first], n)
        self.n_word_lines = per_row(line_row, n)
        self.salt = salt
