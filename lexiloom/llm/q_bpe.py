"""op5: token counts and digests of every document's ids and of their decoding."""

from __future__ import annotations

import os

from lexiloom.llm.bpe import encode_digests
from lexiloom.llm.common import table


def tokenizer_path() -> str:
    """The tokenizer file of the contract, where the public files are installed."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("word_bpe_49k.json"))


def op5_bpe(spark, sf_dir):
    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op5_bpe": op5_bpe}
