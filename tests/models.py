"""Sequential models that the relational operators are held against."""

from __future__ import annotations

U64 = 2**64 - 1


def late_flags(windows: list[int]) -> list[bool]:
    """A trade emits all older open windows; late: its window is not newer than the newest emitted."""
    out, held, emitted = [], set(), None
    for w in windows:
        if emitted is not None and w <= emitted:
            out.append(True)
            continue
        gone = {x for x in held if x < w}
        if gone:
            emitted = max(gone) if emitted is None else max(emitted, *gone)
        held = held - gone | {w}
        out.append(False)
    return out


def checks(ids: list[str]) -> list[str]:
    out, last, degraded = [], None, False
    for text in ids:
        body = text[1:] if text[:1] == "+" else text
        n = int(body) if body.isascii() and body.isdigit() and int(body) <= U64 else None
        if degraded:
            out.append("untracked")
        elif n is None:
            degraded = True
            out.append("non_sequential")
        else:
            out.append("ok" if last is None or n == last + 1 else "gap" if n > last else "regression")
            last = n
    return out


def down(carry_connected: bool, turns: list[tuple[int, str]], end: int) -> list[tuple[int, int]]:
    out, up, since = [], carry_connected, 0
    for t, state in sorted(turns, key=lambda x: x[0]):
        if state == "connected" and not up:
            if since < t:
                out.append((since, t))
            up = True
        elif state == "disconnected" and up:
            up, since = False, t
    if not up and since < end:
        out.append((since, end))
    return out
