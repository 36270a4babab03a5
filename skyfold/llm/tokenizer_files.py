"""Where the public tokenizer lies; SKYFOLD_TOKENIZERS names another folder."""

from __future__ import annotations

import os

import public_tokenizers

_FOLDER = os.environ.get("SKYFOLD_TOKENIZERS")
BYTE_BPE = f"{_FOLDER}/byte_bpe_50k.json" if _FOLDER else str(public_tokenizers.path("byte_bpe_50k.json"))
