"""Plain versions of the operators, for small inputs."""

import math
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return SPACE_WORD.findall(text or "")


def cut_repeats(texts, window):
    """Of each text: its words, and those that are kept."""
    own = [words(t) for t in texts]
    seen = {}
    for w in own:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for w in own:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((w, [x for i, x in enumerate(w) if i not in gone]))
    return out


def shingles(text, size=5):
    w = words(lower(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_groups(docs, percent, size=5):
    """docs: (id, text). {id: (shingles, smallest id reachable)}; ids differ."""
    sets = {i: shingles(t, size) for i, t in docs}
    label = {i: i for i, _ in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def phrase_hits(text, items, size=8):
    """(words, hit words, sorted item ids) of a text; items: (id, text)."""
    w = ALNUM_WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        v = ALNUM_WORD.findall(lower(t))
        if item is None or not v:
            continue
        n = min(size, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def text_statistics(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    repeated = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            repeated |= {i, i + 1, i + 2}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            lines += 1
            seen.add(line)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(repeated), "n_lines": lines, "n_distinct": len(set(w)),
        "n_upper": sum("A" <= c <= "Z" for c in text), "n_digits": sum("0" <= c <= "9" for c in text), "n_ends": sum(x[-1] in ".!?" for x in w),
    }


class PlainAutomaton:
    """The model of a few texts with states, arcs and failure arcs in dictionaries."""

    def __init__(self, texts: list[list[str]], order: int, strength: float):
        self.order, counts = order, {}
        for words in texts:
            seq = ("<s>", *words, "</s>")
            for n in range(1, order + 1):
                for i in range(len(seq) - n + 1):
                    counts[seq[i : i + n]] = counts.get(seq[i : i + n], 0) + 1
        single = {k[0]: c for k, c in counts.items() if len(k) == 1 and k[0] != "<s>"}
        total, kinds = sum(single.values()), len(single)
        low = lambda c: math.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
        self.arcs: dict[tuple, dict[str, float]] = {(): {w: low(c) for w, c in single.items()}}
        self.other = low(0)
        self.failure: dict[tuple, float] = {}
        for n in range(2, order + 1):
            for gram, c in ((g, c) for g, c in counts.items() if len(g) == n):
                state = gram[:-1]
                self.failure[state] = math.log10(strength / (counts[state] + strength))
                shorter = self.weight(state[1:], gram[-1])
                self.arcs.setdefault(state, {})[gram[-1]] = math.log10((c + strength * 10**shorter) / (counts[state] + strength))

    def weight(self, state: tuple, word: str) -> float:
        total = 0.0
        while word not in self.arcs.get(state, ()):
            if not state:
                return total + self.other
            total, state = total + self.failure.get(state, 0.0), state[1:]
        return total + self.arcs[state][word]

    def traverse(self, words: list[str]) -> float:
        state, total = ("<s>",)[: self.order - 1], 0.0
        for word in (*words, "</s>"):
            total += self.weight(state, word)
            state = (*state, word)[max(0, len(state) + 2 - self.order) :] if self.order > 1 else ()
        return total
