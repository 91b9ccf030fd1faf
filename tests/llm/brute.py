"""Plain versions of the text operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# -- personal data ------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((m.start(), n, m.end(), kind))
    return sorted(out)


def spans_text(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


# -- edit distance ------------------------------------------------------------------------------------


def least_distance(item, text):
    """(least distance of the item to a substring, end of the first such)."""
    row = list(range(len(item) + 1))
    best, end = len(item), 0
    for j, c in enumerate(text, 1):
        new = [0]
        for i in range(1, len(item) + 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (item[i - 1] != c)))
        row = new
        if row[-1] < best:
            best, end = row[-1], j
    return best, end


# -- lines --------------------------------------------------------------------------------------------


def _fields(text):
    out = []
    for i, line in enumerate((text or "").split("\n")):
        found = [x for x in re.split(r"[\x20\x09\x0B\x0C\x0D]+", line) if x]
        if found:
            out.append((i, ["<*>" if re.search("[0-9]", x) else x for x in found]))
    return out


def _templates(w):
    n = len(w)
    ends = [2 + (n - 2) * i // 4 for i in range(5)]
    lead, blocks = (n, tuple(w[:2])), [tuple(w[ends[i] : ends[i + 1]]) for i in range(4)]
    out = [(-1, lead, tuple(blocks))]
    if n >= 10:
        out += [(j, lead, tuple(b for i, b in enumerate(blocks) if i != j)) for j in range(4)]
    return out


def line_templates(rows):
    """(doc_id, lines, dropped, text left) of rows (doc_id, text)."""
    texts = {t: _fields(t) for _, t in rows if t is not None}
    seen = defaultdict(set)
    for text, lines in texts.items():
        for _, w in lines:
            for t in _templates(w):
                seen[t].add(text)
    shared = {t for t, found in seen.items() if len(found) >= 5}
    around = defaultdict(lambda: (set(), set()))
    for text, lines in texts.items():
        heads = [None if any(t in shared for t in _templates(w)) else tuple(w[:3]) for _, w in lines]
        for k, (_, w) in enumerate(lines):
            before = next((h for h in heads[:k][::-1] if h is not None), "start")
            after = next((h for h in heads[k + 1 :] if h is not None), "end")
            for t in shared.intersection(_templates(w)):
                around[t][0].add(before)
                around[t][1].add(after)
    recurring = {t for t, (b, a) in around.items() if max(len(b), len(a)) >= 5}
    out = []
    for doc, text in rows:
        drop = {i for i, w in _fields(text) if len(w) >= 3 and any(t in recurring for t in _templates(w))}
        lines = text.split("\n") if text is not None else []
        out.append((doc, len(lines), len(drop), "\n".join(x for i, x in enumerate(lines) if i not in drop)))
    return out


# -- shingles -----------------------------------------------------------------------------------------


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows):
    """{row number: (set size, least id of the component)}."""
    sets = [shingles(t) for _, t in rows]
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in inverted[x] if j < i)
        for j, k in common.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return {i: (len(s), least.get(find(i))) for i, s in enumerate(sets)}


# -- repeated bytes -----------------------------------------------------------------------------------


def repeats(rows, length=200):
    """(doc_id, bytes, removed, runs, digest of the rest)."""
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if covered[i] and (i == 0 or not covered[i - 1]))
        left = bytes(x for x, c in zip(t, covered) if not c)
        out.append((doc, len(t), sum(covered), runs, hashlib.sha256(left).hexdigest()))
    return out


# -- token alignment ----------------------------------------------------------------------------------


def token_groups(text, a, b):
    """[(ids of A, ids of B)] by byte offsets where both end, or [] for a text that either does not give back."""
    whole = " " + (text or "")
    if not text:
        return []
    stand = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    stand |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if chr(c) not in stand)}
    left = [(i, bytes(stand[c] for c in a.id_to_token(i))) for i in a.encode(whole, add_special_tokens=False).ids]
    right = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode()) for i in b.encode(text)]
    if any(b"".join(x for _, x in side) != whole.encode() for side in (left, right)):
        return []
    out, xs, ys, at, to = [], [], [], 0, 0
    right = iter(right)
    for i, x in left:
        xs.append(i)
        at += len(x)
        while to < at:
            j, y = next(right)
            ys.append(j)
            to += len(y)
        if to == at:
            out.append((xs, ys))
            xs, ys = [], []
    return out


def alignment(rows, a, b):
    """Counter of (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest)."""
    every = [(doc, token_groups(text, a, b)) for doc, text in rows]
    count = Counter(pair for _, groups in every for pair in {(x, y) for xs, ys in groups for x in xs for y in ys})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = Counter()
    for doc, groups in every:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        names = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        digest = hashlib.sha256(names.encode()).hexdigest() if groups else ""
        sizes = [sum(len(g[k]) for g in groups) for k in (0, 1)]
        out[doc, *sizes, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest] += 1
    return out


# -- exact copies -------------------------------------------------------------------------------------


def exact_copies(rows):
    """Counter of (doc_id, keep_id, group size, kept)."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    out = Counter()
    for members in groups.values():
        members.sort(key=lambda m: m[:3])
        out.update((m[3], members[0][3], len(members), i == 0) for i, m in enumerate(members))
    return out


# -- filters ------------------------------------------------------------------------------------------


def fails(rows):
    """Per row of (doc_id, text), the filters it fails."""
    least = {}
    for doc, text in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    out = []
    for doc, text in rows:
        text = text or ""
        w = WORD.findall(text)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": re.search("[#$%&*|]", text)}
        bad["E"] = text in least and (doc is None or least[text] < doc)
        out.append("".join(k for k in "ABCDE" if bad[k]))
    return out


def audit(rows, labels):
    """{(part, order, step): (kept, removed, redundant, unique, good, toxic, share)} of rows (doc_id, text, source)."""
    from itertools import permutations

    failing = fails([r[:2] for r in rows])
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failing) if (r[2] or "") == part]
        share = Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = mine
            for step, k in enumerate(order, 1):
                gone = [x for x in alive if k in x[1]]
                share[k] += len(gone)
                alive = [x for x in alive if k not in x[1]]
                every = [x for x in mine if k in x[1]]
                alone = sum(x[1] == k for x in mine)
                out[part, order, step] = [len(alive), len(gone), len(every) - len(gone), alone, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}
