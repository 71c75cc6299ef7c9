"""Token ids of texts inside tasks, by a public byte-level vocabulary whose files every worker can read."""

from __future__ import annotations

import base64
from collections.abc import Callable

#: Text between these goes through the slower library, which alone gives the special token's id.
SPECIAL = "<|endoftext|>"

_loaded: dict = {}


def encoder(name: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """Ids of one text, without special tokens around it; loaded once per worker.

    The vocabulary is there as a `tokenizers` file and as ranks; both give the same ids (a test compares them), and ranks
    are five times as fast. A text that holds the special token's string goes to the `tokenizers` file.
    """
    if name not in _loaded:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow: list = []

        def encode(text: str) -> list[int]:
            if SPECIAL not in text:
                return fast.encode_ordinary(text)
            if not slow:
                slow.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
            return slow[0].encode(text, add_special_tokens=False).ids

        _loaded[name] = encode
    return _loaded[name]
