"""How two versions of a text differ by lines: anchors that both have once, then what lies between them."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

#: Up to so many pairs of lines between two anchors are compared in full.
COMPARED = 250_000


def lines_of(text: str | None) -> list[str]:
    return [line.strip() for line in (text or "").splitlines() if line.strip()]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs (sorted by the first) whose second numbers rise."""
    ends: list[int] = []  # the least last number of a sequence of each length
    at: list[int] = []  # and the pair that it ends in
    before = [-1] * len(pairs)
    for k, (_, second) in enumerate(pairs):
        n = bisect_left(ends, second)
        ends[n : n + 1] = [second]
        at[n : n + 1] = [k]
        before[k] = at[n - 1] if n else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def anchors(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of lines that each range has exactly once, in an order that both agree on."""
    once = [{line for line, n in Counter(x[low:high]).items() if n == 1} for x, low, high in ((a, a0, a1), (b, b0, b1))]
    both = once[0] & once[1]
    place = {b[j]: j for j in range(b0, b1) if b[j] in both}
    return rising([(i, place[a[i]]) for i in range(a0, a1) if a[i] in both])


def common_run(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """A longest common subsequence of two small ranges."""
    width = b1 - b0 + 1
    best = [[0] * width for _ in range(a1 - a0 + 1)]
    for i in range(a1 - a0 - 1, -1, -1):
        row, under = best[i], best[i + 1]
        for j in range(width - 2, -1, -1):
            row[j] = under[j + 1] + 1 if a[a0 + i] == b[b0 + j] else max(under[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < a1 - a0 and j < width - 1:
        if a[a0 + i] == b[b0 + j]:
            out.append((a0 + i, b0 + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def matched(a: list, b: list) -> list[tuple[int, int]]:
    """Places of equal lines, rising in both: equal ends and unique common lines first, then the same again between them.

    A range without such lines is compared in full if it is small, else by the first common line of each next one; so the cost stays near
    the number of lines however large a change is.
    """
    out: list[tuple[int, int]] = []
    ahead = [(0, len(a), 0, len(b))]
    while ahead:
        a0, a1, b0, b1 = ahead.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= COMPARED:
            out += common_run(a, b, a0, a1, b0, b1)
            continue
        fixed = anchors(a, b, a0, a1, b0, b1)
        if fixed:
            out += fixed
            bounds = [(a0 - 1, b0 - 1), *fixed, (a1, b1)]
            ahead += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(bounds, bounds[1:], strict=False)]
            continue
        places: dict = {}
        for j in range(b0, b1):
            places.setdefault(b[j], []).append(j)
        last = b0 - 1
        for i in range(a0, a1):
            here = places.get(a[i], ())
            k = bisect_left(here, last + 1)
            if k < len(here):
                last = here[k]
                out.append((i, last))
    return sorted(out)


def difference(old: str | None, new: str | None) -> tuple[float, list[str], list[str]]:
    """The share of lines that match (twice the matches over all lines), the lines that came and those that went."""
    a, b = lines_of(old), lines_of(new)
    same = matched(a, b)
    gone, come = {i for i, _ in same}, {j for _, j in same}
    ratio = 2 * len(same) / (len(a) + len(b)) if a or b else 1.0
    return ratio, [x for j, x in enumerate(b) if j not in come], [x for i, x in enumerate(a) if i not in gone]
