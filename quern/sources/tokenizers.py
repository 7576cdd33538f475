"""Tokenizer models: SentencePiece files, and `tokenizer.json` by the `tokenizers` library where it is installed."""

from __future__ import annotations

from pathlib import Path

from ..kernels.sentencepiece import ModelError, SentencePiece

#: Tokens that stand for padding where a model does not say (fixed values, in order of preference).
PAD_TOKENS = ("<pad>", "[PAD]", "<|pad|>", "<|endoftext|>")


class Tokenizer:
    """One interface over both kinds. It travels to workers as the file's bytes. With `plain` a special token of a `tokenizer.json`
    that stands in a text is text like any other."""

    def __init__(self, data: bytes, plain: bool = False):
        self.data, self.plain = data, plain
        self.json = data.lstrip()[:1] == b"{"
        if self.json:
            try:
                from tokenizers import Tokenizer as Library
            except ImportError as e:
                raise ModelError("tokenizer.json needs the tokenizers library") from e
            try:
                self.model = Library.from_str(data.decode())
                self.model.encode_special_tokens = plain
            except Exception as e:
                raise ModelError(str(e)) from e
        else:
            self.model = SentencePiece.from_bytes(data)

    @classmethod
    def from_bytes(cls, data: bytes, plain: bool = False) -> "Tokenizer":
        return cls(data, plain)

    @classmethod
    def from_file(cls, path: str, spark=None) -> "Tokenizer":
        """From a local path, or through Spark's file systems if a session is given."""
        if spark is None:
            return cls(Path(path).read_bytes())
        return cls(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))

    def __reduce__(self):
        return Tokenizer, (self.data, self.plain)

    def __repr__(self) -> str:
        return f"HuggingFace({self.model.get_vocab_size()} tokens)" if self.json else f"SentencePiece({self.model.vocab_size} pieces)"

    def encode(self, text: str, special: bool = True) -> list[int]:
        return self.model.encode(text, add_special_tokens=special).ids if self.json else self.model.encode(text, special, special)

    def encode_truncated(self, text: str, special: bool = True, limit: int | None = None) -> list[int]:
        """At most `limit` ids, special ones included; these stay even if there are more of them than the limit."""
        whole = self.encode(text, special)
        if limit is None or len(whole) <= limit:
            return whole
        if self.json:
            body = self.model.encode(text, add_special_tokens=False)
            body.truncate(max(0, limit - self.model.num_special_tokens_to_add(False)) if special else limit)
            return self.model.post_process(body, add_special_tokens=special).ids
        m = self.model
        front, back = ([x] if special and x is not None else [] for x in (m.bos, m.eos))
        return front + m.encode(text)[: max(0, limit - len(front) - len(back))] + back

    def decode(self, ids, skip_special: bool = True) -> str:
        return self.model.decode(list(ids), skip_special_tokens=skip_special) if self.json else self.model.decode(ids, skip_special)

    def token_to_id(self, token: str) -> int | None:
        return self.model.token_to_id(token) if self.json else self.model.piece_to_id(token)

    def pad_id(self) -> int | None:
        if not self.json:
            return self.model.pad
        if self.model.padding:
            return self.model.padding["pad_id"]
        return next((i for i in map(self.model.token_to_id, PAD_TOKENS) if i is not None), None)

    def vocabulary(self, spark):
        """(id, piece, score, kind) as a table."""
        if self.json:
            rows = [(i, t, 0.0, "normal") for t, i in self.model.get_vocab().items()]
        else:
            rows = list(zip(range(self.model.vocab_size), self.model.pieces, map(float, self.model.scores), self.model.kinds))
        return spark.createDataFrame(rows, "id bigint, piece string, score float, kind string")
