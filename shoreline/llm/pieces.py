"""Token ids of different pieces of text, each encoded once while it is cached."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable


class Known(dict):
    """Ids by piece. What is missing is taken from the former generation or encoded."""

    def __init__(self, encode: Callable[[str], bytes], former: dict[str, bytes] | None = None):
        super().__init__()
        self.encode, self.former = encode, former or {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.former.get(piece)
        if ids is None:
            ids = self.encode(piece)
        self[piece] = ids
        return ids

    def next(self) -> Known:
        """An empty cache that still knows the pieces of this one, but not of those before."""
        return Known(self.encode, dict(self))


class PieceEncoder:
    """A byte-level BPE tokenizer file; its model alone encodes pieces that ``plain`` matches."""

    def __init__(self, path: str, plain: re.Pattern):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), plain
        self.model = self.tokenizer.model
        self.code, self.width = ("H", 2) if self.tokenizer.get_vocab_size() <= 1 << 16 else ("I", 4)
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {ord(c): signs.pre_tokenize_str(c)[0][0] for c in filter(plain.fullmatch, map(chr, range(256)))}
        self.known = Known(self.piece)

    def piece(self, piece: str) -> bytes:
        if self.plain.fullmatch(piece):
            return self.pack([token.id for token in self.model.tokenize(piece.translate(self.signs))])
        return self.pack(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def pack(self, ids: list[int]) -> bytes:
        """Little-endian ids, ``width`` bytes each."""
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def joined(self, pieces: list[str], cached: int) -> bytes:
        """The ids of all pieces; a generation of the cache ends with ``cached`` pieces."""
        if len(self.known) > cached:
            self.known = self.known.next()
        return b"".join(map(self.known.__getitem__, pieces))
