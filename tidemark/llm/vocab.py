"""Reads public tokenizer files: byte alphabet, vocabulary, merges and special strings."""

from __future__ import annotations

import json
from functools import lru_cache
from typing import NamedTuple

import regex

#: More distinct words than these are not held by a worker; the rest are computed each time.
CACHE_WORDS = 250_000
#: Longer words are not held.
CACHE_CHARS = 64


class Vocab(NamedTuple):
    ids: dict[bytes, int]  # a token's bytes, with the end-of-word mark as text
    texts: dict[int, str]  # as the file writes a token
    merges: dict[tuple[int, int], int]  # pair of ids to rank
    merged: list[int]  # by rank
    first: list[int]  # a byte's id
    last: list[int]  # a byte's id at the end of a word
    special: dict[str, int]


@lru_cache(1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if visible in Latin-1, else the next from 256 on."""
    seen = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in seen else chr(extra))
        extra += b not in seen
    return out


@lru_cache(4)
def load(path: str) -> Vocab:
    """A byte-level BPE model in the JSON format of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model = held["model"]
    vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
    back = {c: b for b, c in enumerate(byte_letters())}
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    merged = [vocab[a + b] for a, b in pairs]
    merges = {(vocab[a], vocab[b]): rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
    special = {x["content"]: x["id"] for x in held["added_tokens"]}
    texts = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
    plain = {t: i for t, i in vocab.items() if t not in special and all(c in back for c in t)}
    return Vocab({bytes(back[c] for c in t): i for t, i in plain.items()}, texts, merges, merged, [vocab[c] for c in byte_letters()], [vocab[c + end] for c in byte_letters()], special)


@lru_cache(4)
def special_pattern(path: str) -> regex.Pattern | None:
    """Splits a text at its special strings, the longest first."""
    found = sorted(load(path).special, key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None
