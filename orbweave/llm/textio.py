"""Tokenizer access shared by the operators on tokens: files by path parameter, words by safe fast paths."""

from __future__ import annotations

import base64
import functools
import re

import tiktoken
from tokenizers import Tokenizer

#: Texts of these characters alone are split by our own pattern; others go through the library as a whole. In this
#: set the letters are the word characters that are neither digits nor the underscore, and the numbers are 0 to 9.
SAFE = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u203e]*")
#: How the two public vocabularies split safe texts before their merges.
RANKS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_vocabulary() -> tuple[str, str]:
    """The byte vocabulary as a tokenizer file and as ranks."""
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    """The tokenizer of a file without its truncation and padding, once per worker."""
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> tiktoken.Encoding:
    """The byte vocabulary as ranks: the same ids as the tokenizer file on safe texts, at a fraction of the cost."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=RANKS_PATTERN, mergeable_ranks=ranks, special_tokens={})


def special_tokens(made: Tokenizer) -> list[str]:
    return [x.content for x in made.get_added_tokens_decoder().values()]
