"""Terms of a text: runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case.

Over UTF-8 bytes that is one table look-up per byte, so a whole text is folded
and cut by two calls. Nothing but A-Z changes; other scripts keep their case.
"""

from __future__ import annotations

import numpy as np

FOLDED = bytes(b if b > 127 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
FOLD = np.frombuffer(FOLDED, dtype=np.uint8)


def terms(raw: bytes) -> list[bytes]:
    """Terms in text order, with repeats."""
    return raw.translate(FOLDED).split()
