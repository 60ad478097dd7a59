"""Tokenizers behind one small interface, and columns that encode and decode with them over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cached_property
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions import text as text_rules


class Tokenizer(Protocol):
    """What a tokenizer must offer; it is sent to the executors, so it must be picklable."""

    base_vocab_size: int

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: Sequence[int]) -> str: ...

    def vocab_meta(self) -> dict[str, int | str]: ...


class ByteTokenizer:
    """The default: every byte of the UTF-8 form is a token."""

    base_vocab_size = 256

    def encode(self, text: str) -> list[int]:
        return list(text.encode("utf-8", "replace"))

    def decode(self, ids: Sequence[int]) -> str:
        return bytes(ids).decode("utf-8", "replace")

    def vocab_meta(self) -> dict[str, int | str]:
        return {"type": "bytes", "source": "", "tokenizer_fingerprint": fingerprint([], "bytes"), "base_vocab_size": self.base_vocab_size}


class FileTokenizer:
    """A tokenizer from a `tokenizer.json` file or a folder that has one, on a path that all executors have."""

    def __init__(self, source: str):
        if not source.strip():
            raise ValueError("a tokenizer needs a source")
        self.source = source.strip()
        self.base_vocab_size = max(self._loaded.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        if not self.base_vocab_size:
            raise ValueError(f"the vocabulary of {self.source} is empty")

    @property
    def _file(self) -> Path:
        return Path(self.source) / "tokenizer.json" if Path(self.source).is_dir() else Path(self.source)

    @cached_property
    def _loaded(self):
        from tokenizers import Tokenizer as Loaded

        return Loaded.from_file(str(self._file))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_loaded"}

    def encode(self, text: str) -> list[int]:
        return self._loaded.encode(text, add_special_tokens=False).ids

    def decode(self, ids: Sequence[int]) -> str:
        return self._loaded.decode(list(ids), skip_special_tokens=False)

    def vocab_meta(self) -> dict[str, int | str]:
        names = ("tokenizer.json", "tokenizer_config.json", "special_tokens_map.json")
        return {"type": "file", "source": self.source, "tokenizer_fingerprint": fingerprint([self._file.parent / n for n in names], self.source), "base_vocab_size": self.base_vocab_size}


def fingerprint(files: Sequence[Path], fallback: str) -> str:
    """Sixteen digits over a fallback name and the names and contents of the files that are there."""
    digest = hashlib.sha1(fallback.encode())
    for file in files:
        if file.is_file():
            digest.update(file.name.encode() + file.read_bytes())
    return digest.hexdigest()[:16]


def encoded(text: Column, tokenizer: Tokenizer, code: Column | None = None) -> Column:
    """The token ids of `text`, normalised for the language `code` where one is given.

    Null where there is no text, no supported language, or no token, which a caller treats as a failed row.
    """

    @F.pandas_udf("array<long>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([tokenizer.encode(t) or None if isinstance(t, str) else None for t in texts], dtype=object)

    return encode(text if code is None else text_rules.normalized(text, code))


def decoded(ids: Column, tokenizer: Tokenizer) -> Column:
    """The text of token ids; null for null and for ids outside the vocabulary."""

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in parts:
            yield pd.Series([None if x is None else tokenizer.decode([int(i) for i in x]) for x in lists], dtype=object)

    inside = F.forall(ids, lambda i: i.isNotNull() & (i >= 0) & (i < tokenizer.base_vocab_size))
    return decode(F.when(inside, ids))
