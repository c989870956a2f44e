"""Plain versions of what the stages decide, over a few hundred texts."""

from itertools import combinations

import regex

from siftline.llm import lines


def slow_lines(rows, min_chars=40, min_docs=5):
    table = str.maketrans(lines.UPPER, lines.LOWER)
    key = lambda line: line.strip(lines.STRIPPED).translate(table)
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    gone = lambda i, line: len(key(line)) >= min_chars and len(held[key(line)]) >= min_docs and max(held[key(line)]) != i
    return {i: "\n".join(x for x in (text or "").split("\n") if not gone(i, x)) for i, text in rows}


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def near_pairs(texts, least):
    sets = {i: shingles(t) for i, t in texts.items()}
    return [(i, j) for i, j in combinations(sets, 2) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]


def slow_contained(docs, items, share=0.8, size=5):
    def of(text):
        words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
        return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}

    wanted = {i: of(t) for i, t in items}
    return [(d, i) for d, text in docs for held in [of(text)] for i, s in wanted.items() if s and len(s & held) >= share * len(s) - 1e-9]
