"""Public vocabularies as word encoders, loaded once in each worker.

A path is a parameter everywhere; ``public(name)`` finds the installed file.  Encoders take
distinct words (no white space) in large joined strings, because a call for each word costs
the libraries more than the encoding itself.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np

from parchmill.llm.textbuf import WordCodec, cut_at

#: A word that no other word contains; its token parts joined words again.
MARK = "\x00"


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def hugging(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Where ASCII letters (1) meet ASCII punctuation (2) the words of ``hugging_words`` end too.
#: Apostrophes start contractions and <, | and > belong to special tokens, so they are neither.
LETTER_MEETS_SIGN = np.zeros(256, np.uint8)
LETTER_MEETS_SIGN[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
LETTER_MEETS_SIGN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = 2

#: ASCII white space that every pattern takes as white space.
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[[0x20, 0x09, 0x0A, 0x0D]] = False


@functools.lru_cache(maxsize=2)
def hugging_words(path: str) -> WordCodec:
    """Parts of text between ASCII white space (and where LETTER_MEETS_SIGN), for a
    tokenizer that lower-cases, drops white space and parts letters from signs."""
    tokenizer = hugging(path)
    ids_of = lambda text: tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
    mark = ids_of(MARK)
    if len(mark) != 1 or ids_of(f"a {MARK} a {MARK} b") != [*ids_of("a"), *mark, *ids_of("a"), *mark, *ids_of("b")]:
        raise ValueError(f"{path}: not a tokenizer that encodes words by themselves")
    between = f" {MARK} "

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = {k: ids_of(w) for k, w in enumerate(words) if MARK in w}
        flats, counts = [], []
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            text = between.join("" if at + k in odd else w for k, w in enumerate(part))
            flat, sizes = cut_at(np.asarray(ids_of(text), np.uint32), mark[0])
            if odd and any(at <= k < at + len(part) for k in odd):
                pieces = np.split(flat, np.cumsum(sizes)[:-1])
                for k in range(len(part)):
                    if at + k in odd:
                        pieces[k] = np.asarray(odd[at + k], np.uint32)
                flat, sizes = np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
            flats.append(flat)
            counts.append(sizes)
        return np.concatenate(flats), np.concatenate(counts)

    return WordCodec(encode, keep=400_000)


@functools.lru_cache(maxsize=2)
def pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode_pieces(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, ids of each word) of words as a SentencePiece model encodes them after a space."""
    model, first = pieces(path), piece_starts(path)
    odd = [k for k, w in enumerate(words) if "▁" in w]
    flats, counts = [], []
    for at in range(0, len(words), 2000):
        part = words[at : at + 2000]
        if odd and any(at <= k < at + len(part) for k in odd):
            got = [np.asarray(x, np.uint32) for x in model.encode(part, num_threads=1)]
            flats += got
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            continue
        flat = np.asarray(model.encode(" ".join(part), num_threads=1), np.uint32)
        flats.append(flat)
        counts.append(np.diff(np.append(np.flatnonzero(first[flat]), len(flat))))
    return np.concatenate(flats), np.concatenate(counts)


@functools.lru_cache(maxsize=2)
def piece_starts(path: str) -> np.ndarray:
    """By piece id: whether the piece begins with a space."""
    model = pieces(path)
    return np.array([model.id_to_piece(i).startswith("▁") for i in range(model.get_piece_size())])


@functools.lru_cache(maxsize=2)
def byte_ranks(path: str):
    """The Encoding of a .tiktoken file."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space that doesn't part words here but may do so in a vocabulary's pattern.
INNER_SPACE = re.compile(r"[^\S ]")


@functools.lru_cache(maxsize=2)
def byte_lengths(path: str) -> np.ndarray:
    """By token id: its number of bytes."""
    with open(path, "rb") as handle:
        found = {int(rank): len(base64.b64decode(token)) for token, rank in map(bytes.split, handle)}
    out = np.zeros(max(found) + 1, np.int64)
    out[list(found)] = list(found.values())
    return out


def count_bytes(path: str, words: list[str]) -> np.ndarray:
    """The number of tokens of each word as a byte-level BPE encodes it after a space.

    Words are encoded joined by spaces and told apart by the tokens' lengths, which is exact as
    long as no word holds white space of its own."""
    coder, lengths, out = byte_ranks(path), byte_lengths(path), []
    for at in range(0, len(words), 2000):
        part = words[at : at + 2000]
        text = " " + " ".join(part)
        if INNER_SPACE.search(text):
            out.append(np.fromiter((len(coder.encode_ordinary(" " + w)) for w in part), np.int64, len(part)))
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = np.cumsum(lengths[coder.encode_to_numpy(text, disallowed_special=())])
        out.append(np.diff(np.append(0, np.searchsorted(ends, np.append(np.flatnonzero(raw == 32)[1:], len(raw)), "right"))))
    return np.concatenate(out)


@functools.lru_cache(maxsize=2)
def counted_words(piece_path: str, byte_path: str) -> WordCodec:
    """Each word's number of byte-level tokens, and after it the word's piece ids."""

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = encode_pieces(piece_path, words)
        return np.insert(ids, np.cumsum(sizes) - sizes, count_bytes(byte_path, words).astype(np.uint32)), sizes + 1

    return WordCodec(encode)


@functools.lru_cache(maxsize=2)
def piece_is_byte(path: str) -> np.ndarray:
    """By piece id: whether the piece stands for one byte of an unknown character."""
    model = pieces(path)
    return np.array([model.is_byte(i) for i in range(model.get_piece_size())])
