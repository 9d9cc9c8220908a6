"""Words of UTF-8 texts as bytes, block by block, so that a text of any length needs bounded memory besides itself."""
from __future__ import annotations

from collections.abc import Iterator

BLOCK_BYTES = 1 << 20
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def lowered(separators: bytes) -> bytes:
    """Translation table: A-Z to lower case, every byte of ``separators`` to a space."""
    table = bytearray(range(256))
    for upper in range(0x41, 0x5B):
        table[upper] = upper + 0x20
    for s in separators:
        table[s] = 0x20
    return bytes(table)


def word_blocks(data: bytes, table: bytes, block: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Lists of consecutive words of ``data``; together they are all words, and none is cut."""
    text = data.translate(table)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + block)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def gram_blocks(data: bytes, table: bytes, size: int, block: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Lists of all runs of ``size`` consecutive words, joined by one space, across block edges, too."""
    tail: list[bytes] = []
    for words in word_blocks(data, table, block):
        words = tail + words
        if len(words) >= size:
            yield words if size == 1 else list(map(b" ".join, zip(*(words[k:] for k in range(size)))))
            words = words[len(words) - size + 1:]
        tail = words
