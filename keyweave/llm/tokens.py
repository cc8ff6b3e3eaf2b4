"""Sizes of texts in tokens of a public subword tokenizer."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder with the vocabulary files, and the one used unless another is named.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's texts are split before merging.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, Callable[[list[str]], list[int]]] = {}


def load_counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts for a ``.tiktoken``, ``.json`` or ``.model`` file; one
    per worker process. Special tokens' strings inside a text are ordinary text."""
    if path in _loaded:
        return _loaded[path]
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        count = lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    elif path.endswith(".json"):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        count = lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda texts: [len(i) for i in sp.encode(texts, num_threads=1)]
    _loaded[path] = count
    return count


def token_count(text: Column, tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> Column:
    """Tokens of the whole text; a null or empty text has none."""
    path = os.path.join(folder, tokenizer)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = load_counter(path)
        for texts in batches:
            yield pd.Series(counter(texts.fillna("").tolist()), dtype="int64")

    return count(text)
