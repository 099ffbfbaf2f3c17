"""Small document tables with the awkward rows, and plain-Python versions of what operators compute."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

LONG = " ".join(f"word{i % 977} filler{i % 13}" for i in range(12_000))


def documents(spark, seed=1, n=160):
    """Rows with nulls in every column, empty and long texts, copies, near copies, repeated rows, extra columns."""
    rng = random.Random(seed)
    vocabulary = ["the", "and", "tion", "Ér", "a", "of", "ing", "WORLD", "x1", "straße", "ou", "re", "licence", "ation"]
    texts = [" ".join(rng.choice(vocabulary) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 120))) for _ in range(n // 2)]
    texts += [texts[0]] * 12
    for base in texts[1:8]:
        words = base.split()
        for _ in range(4):
            near = list(words)
            for _ in range(max(1, len(near) // 40)):
                near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    texts += [None, "", " ", "\n\t\n", "one", "one two", "a\nb\na\n\nb\na", "x y z x y z", LONG, LONG + " end", " nbsp em", "emoji 😀 한국 漢字"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "Ω", None])) for i, t in enumerate(texts)]
    rows = [(i, t, l, s, i, "x", None) for i, t, l, s in rows]
    rows.append(rows[3])
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, Key string, ids string"
    )


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def fold(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text, width):
    w = words(fold(text))
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_components(texts, width, percent):
    """texts: id -> text. Components by comparing all sets."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for same in holders.values():
        shared.update(combinations(sorted(same), 2))
    links = [p for p, c in shared.items() if 100 * c >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    return sets, components(texts, links)


def line_counts(text):
    w = words(text)
    at = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if at[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def phrase_counts(text, phrases):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(text))
    places = [
        (i, label)
        for phrase, label in phrases.items()
        for i in range(len(w))
        if w[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    labels = sorted({label for _, label in places})
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(labels)
