"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(texts, length=400):
    """Per text: (bytes, removed, runs, sha256 of what stays)."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(r, gone[1:]) if not g)
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def places(texts, string):
    """Every (id, start) of a string in id -> bytes, sorted."""
    return sorted((d, i) for d, t in texts.items() for i in range(len(t) - len(string) + 1) if t.startswith(string, i))


def repeat_groups(texts, length):
    """string -> its places, of each repeated string of ``length`` bytes stretched as far as all its places agree."""
    at = defaultdict(list)
    for d, t in texts.items():
        for i in range(len(t) - length + 1):
            at[t[i : i + length]].append((d, i))
    out = {}
    for group in at.values():
        if len(group) > 1:
            lo, hi = 0, length
            side = lambda k: {texts[d][i + k] if 0 <= i + k < len(texts[d]) else (d, i) for d, i in group}  # noqa: B023, E731
            while len(side(lo - 1)) == 1:
                lo -= 1
            while len(side(hi)) == 1:
                hi += 1
            d, i = group[0]
            out[texts[d][i + lo : i + hi]] = sorted((d, i + lo) for d, i in group)
    return out


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def personal(text):
    """(counts by kind, base spans as text)."""
    spans, counts = [], []
    for k, (kind, pattern, fits) in enumerate(KINDS):
        found = [m for m in re.finditer(pattern, text or "") if fits(m[0])]
        counts.append(len(found))
        spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in found]
    return counts, ",".join(s for _, _, s in sorted(spans))


def shingles(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def near(docs, size, threshold=80):
    """doc_id -> (shingles, component)."""
    sets = {d: shingles(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    share = defaultdict(Counter)
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            for o in by[x]:
                share[d][o] += 1
            by[x].append(d)
    for d, c in share.items():
        for o, n in c.items():
            if 100 * n >= threshold * (len(sets[d]) + len(sets[o]) - n):
                a, b = sorted((root(d), root(o)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def covered_words(text, least=10):
    """Words covered by repeats of ``least`` words or more, and the longest repeat."""
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + least]) for i in range(len(w) - least + 1))
    hit = {j for i in range(len(w) - least + 1) if grams[tuple(w[i : i + least])] > 1 for j in range(i, i + least)}
    longest = 0
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            longest = max(longest, k)
    return len(hit), longest if longest >= least else 0


def chat(turns):
    """From (role, text) in order: (n_turns, turns digest, loss chars, loss digest)."""
    said = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """source -> target, from source -> words; None last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        got = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | got
        fixed |= {s: most * sizes[s] for s in over}


def crc(b):
    return zlib.crc32(b)


class Tree(HTMLParser):
    """Nodes [name, label, dropped, main, children] of a page, with the ends that HTML leaves out."""

    def __init__(self, page, M):
        super().__init__(convert_charrefs=False)
        self.M, self.skip, self.open = M, None, [["#", "", False, False, []]]
        self.feed(page)
        self.close()
        self.root = self.open[0]

    def handle_starttag(self, name, attrs):
        M, names = self.M, [n[0] for n in self.open]
        if self.skip:
            return
        if name in M.RAW:
            self.skip = name
        elif name in M.VOID:
            if name in ("br", "hr"):
                self.open[-1][4].append(" " if name == "br" else ["hr", "", False, self.open[-1][3], []])
        else:
            if name in M.CLOSES_P and "p" in names:
                del self.open[names.index("p") :]
            if name in M.SELF_CLOSING:
                same, within = M.SELF_CLOSING[name]
                at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k][0] in same | within), 0)
                if at and self.open[at][0] in same:
                    del self.open[at:]
            up, a = self.open[-1], {k: v or "" for k, v in attrs}
            label = " ".join(a[k] for k, _ in attrs if k in ("class", "id", "role")).lower()
            chrome = name in M.CHROME or (name not in ("html", "body", "article", "main") and bool(M.CHROME_WORDS & set(re.split("[^a-z0-9]+", label))))
            node = [name, label, up[2] or chrome or "hidden" in a, up[3] or name in ("article", "main"), []]
            up[4].append(node)
            self.open.append(node)

    def handle_startendtag(self, name, attrs):
        if name not in self.M.RAW:
            self.handle_starttag(name, attrs)

    def handle_endtag(self, name):
        names = [n[0] for n in self.open]
        if self.skip:
            self.skip = None if name == self.skip else self.skip
        elif name in names[1:]:
            del self.open[len(names) - 1 - names[::-1].index(name) :]

    def handle_data(self, data):
        if not self.skip:
            self.open[-1][4].append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def written(node, found):
    """A node as text with its markup, or None where it is or holds the article; ``found`` gathers its block subtrees."""
    parts = [c if isinstance(c, str) else written(c, found) for c in node[4]]
    if None in parts or (node[0] in ("article", "main") and node[3]):
        return None
    flat = " ".join("".join(parts).split())
    whole = f"<{node[0]} {node[1]}>{flat}</>" if flat else ""
    if whole and not node[2]:
        found[id(node)] = whole
    return whole


def main_text(root, M, found, templates):
    pieces = []

    def walk(node):
        for c in node[4]:
            if isinstance(c, str):
                if not node[2]:
                    pieces.append((c, node[3]))
            elif c[0] in M.BLOCK and found.get(id(c)) in templates:
                pieces.append(("", c[3]))
            else:
                edge = [("", c[3])] * (c[0] in M.BLOCK)
                pieces.extend(edge)
                walk(c)
                pieces.extend(edge)

    def told(node):
        return any((not node[2] and node[3] and c.strip()) if isinstance(c, str) else told(c) for c in node[4])

    walk(root)
    article, lines = told(root), [""]
    for text, main in pieces:
        if text == "":
            lines.append("")
        elif main or not article:
            lines[-1] += text
    return "\n".join(" ".join(x.split()) for x in map(html.unescape, lines) if x.strip())


def main_texts(pages, M, least):
    """Text of each (host, html): block subtrees that stand on pages of ``least`` different texts of their host are gone,
    prose only if that is a share of the host's texts as well."""
    parsed, seen, texts = [], defaultdict(set), defaultdict(set)
    for host, page in pages:
        root, found = Tree(page or "", M).root, {}
        written(root, found)
        text = main_text(root, M, found, ())
        parsed.append((host, root, found))
        texts[host].add(text)
        for w in found.values():
            seen[host, w].add(text)
    need = lambda host, w: max(least, M.SHARE * len(texts[host]) if re.match(r"<(\w+)", w)[1] in M.PROSE else 0)
    return [main_text(root, M, found, {w for w in found.values() if len(seen[host, w]) >= need(host, w)}) for host, root, found in parsed]
