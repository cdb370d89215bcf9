"""Terms of whole texts, cut from their UTF-8 bytes."""

from __future__ import annotations

LETTERS = bytes(range(ord("a"), ord("z") + 1))
DIGITS = b"0123456789"


class Terms:
    """Runs of ASCII letters, of ``more`` ASCII characters and of all others beyond ASCII; only A-Z lower-cased.

    Every byte of a character beyond ASCII is 0x80 or more, so a run of bytes is a run of characters.
    """

    def __init__(self, more: bytes = b""):
        kept = set(LETTERS + more) | set(range(0x80, 0x100))
        self.table = bytes(b if b in kept else 0x20 for b in bytes(range(256)).lower())

    def __call__(self, text: bytes | None) -> list[bytes]:
        return text.translate(self.table).split() if text else []


WORDS = Terms()
WORDS_AND_NUMBERS = Terms(DIGITS)
