"""Plain loops that say what the text operators must return, and small texts to try them on."""

from __future__ import annotations

import random
import re
from collections import Counter

FOLD = {c: c + 32 for c in range(65, 91)}
SYLLABLES = "ka lo mi ru ten sol var dis ent ing tor pha qu é ü ß zo".split()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(FOLD))


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_texts(seed: int = 7) -> list[str | None]:
    """Null, empty, blank, short and very long texts, repeated and nearly repeated ones."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = prose(rng, 9000)
    return [None, "", " \n\t ", "one", "Two words", base, base, base.upper(), " ".join(near), long, long + " end", "x" * 20_000, "ab " * 3000, *(prose(rng, rng.randint(1, 90)) for _ in range(30))]


def shingles(text: str | None, k: int) -> frozenset:
    own = words(text)
    return frozenset(zip(*(own[i:] for i in range(k)), strict=False)) if len(own) >= k else frozenset([tuple(own)] if own else [])


def components(texts: dict[int, str | None], k: int, percent: int) -> dict[int, int]:
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def repeat_words(text: str, width: int = 8) -> int:
    own = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = [tuple(own[i : i + width]) for i in range(len(own) - width + 1)]
    times = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(width)})


def edit_distance_in(item: list, text: list) -> int:
    """The least distance of the item to any passage of the text."""
    cost = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(cost[j] + (x != y), cost[j + 1] + 1, new[-1] + 1))
        cost = new
    return min(cost)
