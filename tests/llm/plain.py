"""Plain, slow versions of what the operators compute."""

import re
from collections import Counter

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

EDGE_TEXTS = [
    None, "", " \t\n", "one", "Two words", "a b c d e f g", "ÄÖÜ straße naïve Ünïcödé 漢字 ١٢٣ é", "x" * 5000,
    "same text twice here", "same text twice here", "tab\tand\x0bvertical\x0cfeed\r\nend", "\U0001F600 smile \U0001F600",
]


def words(text, pattern=WORD):
    return pattern.findall((text or "").encode().translate(LOWER))


def shingle_list(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] * bool(w)


def classes(ids, links):
    """Smallest reachable id of every id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_classes(docs, k, percent):
    """``docs`` are ``(id, text)``; ids with several texts are linked by all of them."""
    sets = [(i, set(shingle_list(words(t), k))) for i, t in docs]
    links = []
    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    return classes({i for i, _ in docs}, links)


def best_windows(docs, items, k=5, least=0.8):
    """``{(doc, item): (start, end, similarity)}`` over all windows of the item's size."""
    out = {}
    for item, text in items:
        own = words(text)
        want = Counter(shingle_list(own, k))
        for doc, body in docs:
            w = words(body)
            for start in range(len(w) - len(own) + 1 if own else 0):
                have = Counter(shingle_list(w[start : start + len(own)], k))
                value = (have & want).total() / (have | want).total()
                if value >= least and value > out.get((doc, item), (0, 0, 0))[2]:
                    out[doc, item] = start, start + len(own), value
    return out


_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def _luhn(text):
    digits = [int(c) for c in reversed(text) if c.isdigit()]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda m: sum(c.isdigit() for c in m[0])
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= digits(m) <= 19 and _luhn(m[0])]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= digits(m) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def places(text, phrases):
    w = words(text, ALNUM)
    out = []
    for phrase, label in phrases:
        p = words(phrase, ALNUM)
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def spelled(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class KneserNey:
    """Interpolated Kneser-Ney on sequences of symbols, count by count, with one or three discounts."""

    def __init__(self, grams, order, discounts):
        """``grams`` are the n-grams of the highest order, with repeats."""
        from collections import Counter

        self.order = order
        self.counts = {order: Counter(grams)}
        for o in range(order - 1, 0, -1):
            self.counts[o] = Counter(g[1:] for g in self.counts[o + 1])  # how many symbols stand before it
        self.cuts = {o: discounts(Counter(c.values())) for o, c in self.counts.items()}
        self.followers = {}
        for o, counts in self.counts.items():
            for g, n in counts.items():
                total, rest = self.followers.get((o, g[:-1]), (0, 0.0))
                self.followers[o, g[:-1]] = total + n, rest + min(n, self.cuts[o][min(n, 3) - 1])

    def probability(self, gram):
        """Of the last symbol after those before it."""
        order = len(gram)
        if order == 0:
            return 1 / (len(self.counts[1]) + 1)
        below = self.probability(gram[1:])
        if (order, gram[:-1]) not in self.followers:
            return below
        total, rest = self.followers[order, gram[:-1]]
        n = self.counts[order].get(gram, 0)
        return (n - min(n, self.cuts[order][min(n, 3) - 1] if n else 0)) / total + rest / total * below


def three_discounts(kinds):
    """Of the modified form, from how many n-grams stand once, twice and so on."""
    y = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] + 2 * kinds[2] else None
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * kinds[i + 1] / kinds[i] if y is not None and kinds[i] and kinds[i + 1] else 0.5
        out.append(max(d, 0.05))
    return out


def one_discount(kinds):
    d = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] + 2 * kinds[2] else 0
    return [d or 0.5] * 3
