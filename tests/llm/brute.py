"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

from shoreline.llm.katz import CUT, discounts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def katz(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    import numpy as np

    tokens = {i: [*WORD.findall((t or "").translate(UPPER)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    one, two = Counter(), Counter()
    for i, ws in tokens.items():
        if not held[i]:
            one.update(ws)
            two.update(zip(["<start>", *ws], ws))
    n, v = sum(one.values()), len(one)

    def have(c):
        return np.array([0.0] + [float(sum(1 for x in c.values() if x == r)) for r in range(1, CUT + 2)])

    d1, d2 = discounts(have(one)), discounts(have(two))
    off = lambda d, c: d[c] if c <= CUT else 1.0
    kept = sum(off(d1, c) * c for c in one.values()) / n
    scale = 1.0 if kept < 1 - 1e-12 else n / (n + 1)
    p1 = {w: off(d1, c) * c / n * scale for w, c in one.items()}
    unknown = 1 - kept * scale
    followers = defaultdict(dict)
    for (h, w), c in two.items():
        followers[h][w] = c
    p2, back = {}, {}
    for h, ws in followers.items():
        total = sum(ws.values())
        seen = {w: off(d2, c) * c / total for w, c in ws.items()}
        left, room = 1 - sum(seen.values()), 1 - sum(p1[w] for w in ws)
        if left < 1e-12:
            seen, left = {w: p * total / (total + 1) for w, p in seen.items()}, 1 / (total + 1)
        p2[h], back[h] = seen, left / room
    out = {}
    for i, ws in tokens.items():
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws)
        score = 0.0
        for h, w in zip(["<start>", *ws], ws):
            p = p2.get(h, {}).get(w)
            score += math.log10(p if p is not None else back.get(h, 1.0) * p1.get(w, unknown))
        out[i] = (held[i], len(ws), sum(one[w] > 0 for w in ws), n, base, score)
    return out, (p2, back, p1, unknown)
