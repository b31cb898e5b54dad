"""Terms of a text: maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The text's terms in order, repeats included, in UTF-8; none for null."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()
