"""Public tokenizer files: where they are and how they load (once per worker)."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

DEFAULT_DIR = os.environ.get("ORRERY_TOKENIZERS", "/opt/tokenizers")
BYTE_RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
#: How text is split before byte merges (must agree with textkit.pretokens).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def locate(path: str | None, name: str) -> str:
    """``path`` may be a file, a folder of vocabulary files, or None for the default folder."""
    path = path or DEFAULT_DIR
    return os.path.join(path, name) if os.path.isdir(path) else path


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def byte_encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("public-bytes", pat_str=SPLIT, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
