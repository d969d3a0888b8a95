"""Words of whole texts, on bytes: fast, and exact because every class is defined by ASCII alone."""

from __future__ import annotations

#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Lower-cases A-Z and makes a space of every byte that no alphanumeric word holds (``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``).
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ``[^\\x20\\x09-\\x0D]``; ``bytes.split`` parts at exactly these six bytes."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and whatever lies beyond ASCII."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(ALNUM).split()
