"""Tokenizers as files: what encodes inside tasks.  Files are parameters and never trained or copied."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken

#: White space as Rust's regular expressions know it; Python's also has U+001C to U+001F.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"


def pretoken_pattern(pattern: str = public_tokenizers.PATTERN) -> regex.Pattern:
    """``pattern`` with the meaning it has for the tokenizer libraries."""
    own = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
    return regex.compile(own)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies in JSON write for bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=8)
def ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token and its rank, which is its id, from a rank file or a byte-level BPE in JSON."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters, special = byte_letters(), {t["content"] for t in model["added_tokens"]}
        return {bytes(letters[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=8)
def byte_bpe(path: str) -> tiktoken.Encoding:
    """The encoder of a byte-level BPE file; it knows no special tokens."""
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=8)
def _pattern() -> regex.Pattern:
    return pretoken_pattern()


@lru_cache(maxsize=8)
def added(path: str) -> tuple[dict[str, int], regex.Pattern | None]:
    """Names of the added tokens of a vocabulary in JSON and their ids, and what finds them; rank files have none."""
    if not path.endswith(".json"):
        return {}, None
    with open(path, encoding="utf-8") as f:
        ids = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    longest_first = sorted(ids, key=len, reverse=True)
    return ids, regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if ids else None


def encode(path: str, text: str) -> np.ndarray:
    """Ids of a text, those of added tokens where their names stand in it.

    What stands between such names is encoded on its own, as the library that
    reads such files does unless it is told otherwise.
    """
    ids, names = added(path)
    if not any(name in text for name in ids):
        return encode_plain(path, text)
    parts = [np.array([ids[part]], np.uint32) if i % 2 else encode_plain(path, part) for i, part in enumerate(names.split(text))]
    return np.concatenate(parts).astype(np.uint32)


def encode_plain(path: str, text: str) -> np.ndarray:
    """Ids of a text in which names of added tokens are ordinary text; piece by piece where it is too much for the library's own splitting."""
    coder = byte_bpe(path)
    try:
        return coder.encode_to_numpy(text, disallowed_special=())
    except Exception:  # the library's backtracking gives up on very long runs
        ids = [i for piece in _pattern().findall(text) for i in encode_piece(path, piece)]
        return np.array(ids, np.uint32)


def encode_piece(path: str, piece: str) -> list[int]:
    """Ids of one pre-token."""
    return byte_bpe(path)._encode_single_piece(piece)
