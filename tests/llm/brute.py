"""Plain versions of the training-data operators, for small inputs: loops over Python lists, no sharing with the operators."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def words(text):
    return WORD.findall(text or "")


def rank(doc_id):
    return LAST if doc_id is None else doc_id


def substring_dedup(rows, window=50):
    """[(doc_id, n_words, n_removed, sha256)] of (doc_id, text) rows."""
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, LAST), rank(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < rank(i):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def base_stats(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    w = words(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count = Counter(grams)
    repeated = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))


def base_failed(text):
    s = base_stats(text)
    return s[0] < 50 or 100 * s[4] > 50 * s[0]


def rejected_hosts(rows, limit=0.5):
    """Hosts of (host, text) rows whose shrunken failure rate is above the limit."""
    n, f = Counter(), Counter()
    for host, text in rows:
        if host is not None:
            n[host] += 1
            f[host] += base_failed(text)
    if not n:
        return set()
    docs = sum(n.values())
    mean = sum(f.values()) / docs
    noise = mean * (1 - mean)
    between = sum(f[h] ** 2 / n[h] for h in n) / docs - mean**2 - noise * len(n) / docs
    strength = 1e6 if between <= noise / (1e6 + 1) else max(1.0, noise / between - 1)
    return {h for h in n if (f[h] + mean * strength) / (n[h] + strength) > limit}


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def near_classes(rows, threshold=(4, 5)):
    """[(doc_id, class_id, n_links)] of (doc_id, text) rows, over all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and threshold[1] * both >= threshold[0] * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = defaultdict(lambda: LAST)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], rank(i))
    return [(i, None if least[find(k)] == LAST else least[find(k)], links[k]) for k, (i, _) in enumerate(rows)]


def fold(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]


def leaks(rows, items, window=13, changed=2, least=5):
    """{(doc_id, item_id)} of (doc_id, text) and (item_id, text) rows."""
    out = set()
    docs = [(i, fold(t)) for i, t in rows]
    for item_id, item in items:
        it = fold(item)
        if len(it) < least:
            continue
        size, may = (window, changed) if len(it) >= window else (len(it), 0)
        for doc_id, d in docs:
            there = set(d)
            if sum(w in there for w in it) < size - may:
                continue  # too few of its words for any window
            if any(sum(x != y for x, y in zip(d[a : a + size], it[b : b + size])) <= may
                   for a in range(len(d) - size + 1) for b in range(len(it) - size + 1)):
                out.add((doc_id, item_id))
    return out


def source_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """{source: target}: share by weight, cut at the caps, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        left, total = budget - sum(full.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in free}
        full |= {s: most * sizes[s] for s in over}


def mixture(rows):
    """[(doc_id, size, source_size, target, copies)] of (doc_id, source, text) rows."""
    sizes, of = Counter(), defaultdict(list)
    for k, (i, s, t) in enumerate(rows):
        n = len(words(t))
        sizes[s] += n
        symbols = sum(c in "#*$%&|<>" for c in t or "")
        digest = hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()
        u = (int(digest[:13], 16) + 0.5) / 2**52
        key = -math.log(u) / max(0.05, (n + 1) / (n + 1 + symbols))
        of[s].append((key, i is not None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), n, k))
    targets, copies = source_targets(sizes), {}
    for s, docs in of.items():
        epochs = int(targets[s] // sizes[s]) if sizes[s] else 0
        rest, before = targets[s] - epochs * sizes[s], 0
        for key, _, _, _, n, k in sorted(docs):
            copies[k] = epochs + (rest > 0 and before + n / 2 <= rest)
            before += n
    return [(i, len(words(t)), sizes[s], targets[s], copies[k]) for k, (i, s, t) in enumerate(rows)]


def token_rows(rows, encode, end_id=2):
    """[(doc_id, start, n_tokens, crc32)] of (doc_id, text) rows in ascending doc_id order."""
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*encode(t or ""), end_id]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


def lm_scores(rows, targets, min_word=3, min_pair=5, strength=200.0, frequent=1 << 18):
    """[(doc_id, n_words, h_target, h_background)]: the formulas token by token."""
    total = Counter(w for _, t in rows for w in words(t))
    texts = sum(bool(words(t)) for _, t in rows)
    known = {w for w, n in total.items() if n >= min_word}
    often = {w for w in known if total[w] * frequent > texts + sum(total.values())} | {"<", ">"}
    seen = lambda t: [w if w in known else "rare word" for w in words(t)]

    def tokens(t):
        x = seen(t)
        return list(zip(["<", *x], [*x, ">"])) if x else []

    every, good = Counter(), Counter()
    for i, t in rows:
        every.update(tokens(t))
        if i in targets:
            good.update(tokens(t))
    kept = {p for p, n in every.items() if n >= min_pair and p[0] in often and p[1] in often}
    mass = sum(good.values())
    scale = mass / max(1, sum(every.values()))

    def model(count, by):
        one, after = Counter(), Counter()
        for (a, b), n in count.items():
            one[b] += n * by
            if (a, b) in kept:
                after[a] += n * by
        p = lambda b: (one[b] + 1) / (mass + len(known) + 2)
        return lambda a, b: -math.log2(((count[a, b] * by if (a, b) in kept else 0) + strength * p(b)) / (after[a] + strength))

    lt, lb = model(good, 1), model(every, scale)
    out = []
    for i, t in rows:
        p = tokens(t)
        n = max(1, len(p))
        out.append((i, len(words(t)), sum(lt(*x) for x in p) / n, sum(lb(*x) for x in p) / n))
    return out


SECRETS = (
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    (re.compile(r"[0-9a-f]+"), 0, 16),
)
KINDS = ("assign", "access", "hex")


def base_secrets(text):
    """[(start, kind number, end, credential)] in order."""
    out = []
    for k, (pattern, group, least) in enumerate(SECRETS):
        out += [(m.start(), k, m.end(), m.group(group)) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(out)


def automaton_bits(automaton, symbols, value):
    state, total = 0, 0.0
    for c in value:
        total += automaton.bits[state][symbols.index(c)]
        state = automaton.after[state][symbols.index(c)]
    return total + automaton.end_bits[state]


def secret_spans(text, automata, symbols, gain=0.5, total=16.0, least=16):
    """[(kind, start, end)]: base spans, and candidates clear of them that an automaton of a kind explains better than the last one."""
    base = base_secrets(text)
    out = [(s, k, e) for s, k, e, _ in base]
    known = [a for a in automata[:-1] if a is not None]
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text or ""):
        start, end = m.span()
        while start < end and text[start] in ".-/":
            start += 1
        while start < end and text[end - 1] in ".-/":
            end -= 1
        if end - start < least or any(s < end and e > start for s, _, e, _ in base) or not known or automata[-1] is None:
            continue
        value = text[start:end]
        bits = automaton_bits(automata[-1], symbols, value) - min(automaton_bits(a, symbols, value) for a in known)
        if bits >= total and bits >= gain * (end - start):
            out.append((start, 3, end))
    return [((*KINDS, "inferred")[k], s, e) for s, k, e in sorted(out)]


def ranked(docs, items, top=10):
    """[(item_id, rank, doc_id, score)] of (doc_id, text) and (item_id, text) rows."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    of = lambda t: Counter(term.findall((t or "").translate(fold)))
    docs = [(i, c) for i, t in docs if (c := of(t))]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            n = sum(c.values())
            m = 10 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in of(text) if t in c)
            if score > 0:
                scores.append((-score, i is not None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def spelling_variants(rows, least=7, min_count=2, ratio=10):
    """[(word, form, root, n, n_near, form_n)] of (doc_id, text) rows."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(fold)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= min_count}
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
            if (short := w[:k] + w[k + 1 :]) in n:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out
