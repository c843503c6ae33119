"""Words of whole texts: runs of ASCII letters and digits and of everything beyond ASCII, with A-Z as a-z."""

from collections.abc import Iterator

#: Every byte that is in no word becomes a blank.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE = 1 << 20


def word_lists(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """All words of a UTF-8 text, in lists of about ``piece`` bytes of it; no word is cut."""
    plain = text.translate(PLAIN)
    low = 0
    while low < len(plain):
        high = plain.find(b" ", low + piece)
        high = len(plain) if high < 0 else high
        yield plain[low:high].split()
        low = high
