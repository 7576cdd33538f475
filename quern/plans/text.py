"""Parameters of tokenization."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TextOptions:
    """padding: None, "longest" or a fixed length."""

    lowercase: bool = False
    add_special_tokens: bool = True
    max_length: int | None = None
    padding: str | int | None = None
    pad_id: int | None = None

    @property
    def limit(self) -> int | None:
        if isinstance(self.padding, int):
            return self.padding if self.max_length is None else min(self.max_length, self.padding)
        return self.max_length
