"""What the operators have to return, computed the plain way for small tables."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def near_groups(texts: dict[int, str | None], size: int = 2) -> dict[int, tuple[int, int]]:
    """Set size and smallest reachable id of each document."""
    sets = {}
    for i, text in texts.items():
        w = [x.lower() for x in words(text)]  # bytes: A-Z only
        sets[i] = {tuple(w[a : a + size]) for a in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    group = {i: i for i in texts}
    for a, b in itertools.combinations(texts, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    return {i: (len(sets[i]), group[i]) for i in texts}


def without_repeats(texts: list[str | None], window: int = 35) -> list[tuple[int, int, str]]:
    every = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in every for i in range(len(w) - window + 1))
    out = []
    for w in every:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        rest = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(rest).hexdigest()))
    return out


def base_metrics(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def secrets(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, rank, kind, end) of the fixed patterns."""
    text, out = text or "", []
    assign = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.I | re.A):
        out += [(m.start(), 0, "assign", m.end())] * (len(m[1]) >= 6)
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        out += [(m.start(), 1, "access", m.end())] * (len(m[0]) >= 20)
    for m in re.finditer("[0-9a-f]+", text):
        out += [(m.start(), 2, "hex", m.end())] * (len(m[0]) >= 24)
    return sorted(out)


def _luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def personal(text: str | None) -> list[tuple[int, int, str, int]]:
    """(rank, start, kind, end) of the fixed patterns."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, m.start(), "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        out += [(1, m.start(), "ip", m.end())] * all(int(x) <= 255 for x in m[0].split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        out += [(2, m.start(), "card", m.end())] * (13 <= len(digits) <= 19 and _luhn(digits))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        out += [(3, m.start(), "phone", m.end())] * (9 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
    return sorted(out)


def digest(spans) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def thue_morse(length: int, letters: str = "ab") -> tuple[str, str]:
    """A word by the Thue-Morse rule, and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(length)]
    return tuple("".join(letters[b ^ flip] for b in bits) for flip in (0, 1))
