"""Encoding of whole texts with a public tokenizer file."""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np
import tiktoken

#: Ids of the special tokens that the vocabulary's published tokenizer splits off.
SPECIAL = {"<|endoftext|>": 50256}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def encoder(path: str) -> tiktoken.Encoding:
    """Encoder of a byte-level BPE vocabulary, one per worker.

    ``path``: the tokenizer's JSON file. Its ranks file of the same name beside it holds the
    same vocabulary for the encoder used here, which gives the same ids several times as fast.
    """
    import public_tokenizers

    ranks = os.path.splitext(path)[0] + ".tiktoken"
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)


def encode(path: str, text: str) -> np.ndarray:
    """Ids of a whole text, special tokens in it included as such."""
    return encoder(path).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
