"""Token ids of a byte-level BPE vocabulary, read in the task from a given file."""

from __future__ import annotations

from collections.abc import Callable


def byte_bpe(path: str, pattern: str, special: dict[str, int] | None = None) -> Callable:
    """``make() -> (text -> uint32 ids)`` for a vocabulary in ranks form. The ids are
    those of the tokenizer file of the same vocabulary; ``special`` strings in a
    text become their one id."""

    def make():
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})
        return lambda text: bpe.encode_to_numpy(text, allowed_special="all")

    return make


def counting(encoder: Callable) -> Callable:
    """A counter of tokens from an encoder."""

    def make():
        encode = encoder()
        return lambda text: len(encode(text))

    return make
