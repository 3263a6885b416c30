"""Plain, slow versions of the operators, written from their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter

SPACE = r"[^\x20\x09-\x0D]+"
HEX = lambda s: hashlib.sha256(s.encode()).hexdigest()


def secrets(text):
    text, out, n = text or "", [], {}
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for k, (kind, p, ok) in enumerate([("assign", assign, lambda m: len(m[2]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]):
        hits = [m for m in p.finditer(text) if ok(m)]
        n[kind] = len(hits)
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in hits]
    return n["assign"], n["access"], n["hex"], HEX(",".join(x[2] for x in sorted(out)))


def _luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def pii(text):
    text, out, n = text or "", [], []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    for kind, p, ok in rules:
        hits = [m for m in re.finditer(p, text) if ok(m)]
        n.append(len(hits))
        out += [f"{kind}:{m.start()}:{m.end()}" for m in hits]
    return (*n, HEX(",".join(out)))


def quality(text):
    text = text or ""
    words = re.findall(SPACE, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    at, inside = {}, set()
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            inside.update(j for i in places for j in range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n


def fold(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def contamination(docs, items):
    """docs and items: (id, text) -> {row number: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    windows = {}
    for item, text in items:
        w = fold(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, of = fold(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i : i + m])) in windows:
                    hit.update(range(i, i + m))
                    of |= windows[k]
        out.append((doc, len(w), len(hit), len(of), HEX(",".join(sorted(of))), bool(hit)))
    return out


def substring_dedup(docs, k=50):
    """docs: (id, text) -> [(id, n_words, n_removed, kept_sha256)]"""
    least = {}
    words = [(d, re.findall(SPACE, t or "")) for d, t in docs]
    for d, w in words:
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if least[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), HEX(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def ranked_search(docs, items, top=10):
    """docs, items: (id, text) -> [(item, rank, doc, score)]; documents in any order, equal ids allowed."""
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [(d, Counter(w)) for d, t in docs if (w := term(t))]
    n_docs, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(term(text))
    out = []
    for item, terms in queries.items():
        scores = []
        for d, c in found:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d, s))
        out += [(item, k, d, s) for k, (_, _, d, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out


def line_dedup(docs, min_docs=10, min_chars=1, keep_first=False):
    """docs: (id, text) -> [(id, n_lines, n_dropped, kept)]; rows equal in id and text are one document."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    where = {}
    for d, t in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                where.setdefault(key(line), {})[d, t] = None
    often = {k: next(iter(v)) for k, v in where.items() if len(v) >= min_docs}
    out = []
    for d, t in docs:
        lines, kept, seen = (t or "").split("\n"), [], set()
        for line in lines:
            k = key(line)
            first = keep_first and k in often and often[k] == (d, t) and k not in seen
            seen.add(k)
            if k not in often or first:
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def merkle(rows, fanout=16):
    """rows: (doc_id, source, lang, n_chars, text), ids distinct within a source -> {(doc_id, source): (leaf, subroot, root, proof_sha256, folded_root, verified)}"""
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: HEX("".join(map(put, r)))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([HEX("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
        return levels

    def sides(levels, at):
        out = []
        for level in levels[:-1]:
            run = level[at // fanout * fanout :][:fanout]
            out.append(("".join(run[: at % fanout]), "".join(run[at % fanout + 1 :])))
            at //= fanout
        return out

    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    upper = tree([trees[g][-1][0] for g in names])
    out = {}
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = sides(trees[g], i) + sides(upper, k)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            h = leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))) if changed else leaf(r)
            for left, right in path:
                h = HEX(left + h + right)
            out[r[0], g] = (leaf(r), trees[g][-1][0], upper[-1][0], HEX("".join(a + b for a, b in path)), h, h == upper[-1][0])
    return out


def language(text, content, block=1024, level=6):
    """content: language -> dictionary bytes, the most frequent language first -> (language, score)."""
    import zstandard as zstd

    if text is None or not any(c.isalpha() for c in text) or not content:
        return "und", 0.0
    raw, sizes = text.lower().encode(), []
    for place, (lang, data) in enumerate(content.items()):
        d = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        c = zstd.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append((sum(len(c.compress(raw[i : i + block])) for i in range(0, len(raw), block)), place, lang))
    first, *rest = sorted(sizes)
    return first[2], (rest[0][0] - first[0]) / rest[0][0] if rest else 1.0
