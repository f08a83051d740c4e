"""The contracts restated in plain Python, one document at a time."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def targets(docs):
    size = defaultdict(int)
    for _, text, source in docs:
        size[source] += len(WORD.findall(text or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        goal = {s: 3.0 * size[s] if s in full else rest * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in full and goal[s] > 3 * size[s]}
        if not over:
            return dict(size), goal
        full |= over


def personal_data(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0:
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def secrets(text):
    text = text or ""
    spans = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.I | re.A):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            spans.append((m.start(), 1, "access", m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 32:
            spans.append((m.start(), 2, "hex", m.end()))
    return [(k, s, e) for s, _, k, e in sorted(spans)]


PII_FOR = {"iban": "iban|account|bank|transfer|konto|compte|cuenta", "ssn": "ssn|ssns|social security|security number"}
PII_AGAINST = {"iban": "order|serial|part|model|checksum", "ssn": "order|serial|part|model|invoice"}


def personal_data_added(text):
    """Spans (kind, start, end, score) beyond the base kinds."""
    text = text or ""
    iban = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
    out = []
    for kind, pattern, score in (("iban", iban, 0.65), ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.45)):
        for m in re.finditer(pattern, text):
            code = m[0].replace(" ", "")
            if kind == "iban" and not (15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1):
                continue
            if kind == "ssn" and (code[:3] in ("000", "666") or code[0] == "9" or code[4:6] == "00" or code[7:] == "0000"):
                continue
            around = text[max(0, m.start() - 49) : m.start()] + "\n" + text[m.end() : m.end() + 49]
            has = lambda words: bool(re.search(rf"(?<![^\W_])(?:{words})(?![^\W_])", around, re.I))  # noqa: B023, E731
            now = round(score + 0.2 * has(PII_FOR[kind]) - 0.2 * has(PII_AGAINST[kind]), 2)
            if now >= 0.6:
                out.append((kind, *m.span(), now))
    return out


def secrets_all(text):
    """Base spans and linked ones, by start, then kind."""
    text = text or ""
    base = secrets(text)
    mixed = lambda x: all(re.search(p, x) for p in ("[A-Z]", "[a-z]", "[0-9]"))
    clear = lambda s, e: not any(t < e and s < u for _, t, u in base)
    near = lambda x, others: any(o[1] - x[2] <= 256 and x[1] - o[2] <= 256 for o in others)
    keys = [("key", *m.span()) for m in re.finditer("(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", text) if mixed(m[0]) and clear(*m.span())]
    idents = [("ident", *m.span()) for m in re.finditer("(?<![A-Za-z0-9])[A-Z0-9]{20}(?![A-Za-z0-9])", text) if re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0]) and clear(*m.span())]
    if not (idents or "AKIA" in text or re.search("https?://", text)):
        keys = []
    ids = idents + [x for x in base if x[0] == "access"]
    hidden = keys + [x for x in base if x[0] != "access"]
    ends = [("endpoint", *m.span()) for m in re.finditer("https?://[A-Za-z0-9.-]+", text)]
    linked = [x for x in idents if near(x, hidden)] + [x for x in keys if near(x, ids)] + [x for x in ends if near(x, ids) and near(x, hidden)]
    rank = {k: i for i, k in enumerate(("assign", "access", "hex", "ident", "key", "endpoint"))}
    return sorted(base + linked, key=lambda x: (x[1], rank[x[0]], x[2]))


def written(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def quality(text):
    text = text or ""
    ws = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


STOPS = set(
    "the of and to in a is that it for on was be with as by this are or an der die das und von zu den mit ist ein eine nicht sich für auf im dem des "
    "le la les de et un une du en que dans pour par sur qui au est pas el los las y se por con una no del para su al lo".split()
)


def quality_kept(text):
    n, chars, symbols, dup, _, failed = quality(text)
    text = text or ""
    ws, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    return not failed and not (
        not 1.5 <= chars / n <= 25 or symbols / n > 0.4 or text.count("!") / n > 0.5 or dup / len(lines) > 0.5
        or (n >= 100 and sum(len(w) <= 5 and w.lower() in STOPS for w in ws) / n < 0.01)
        or sum(x.endswith(("...", "…")) for x in lines) / len(lines) > 0.5 or sum(x[0] in "-*•" for x in lines) / len(lines) > 0.9
    )


def sketch(text, k=5):
    """Hashes below a quarter of the range, shifted to 34 bits, ascending; the least one if there is none."""
    import xxhash

    ws = WORD.findall(text or "")
    hashes = []
    for i in range(max(1, len(ws) - k + 1) if ws else 0):
        h = 42
        for w in ws[i : i + k]:
            h = xxhash.xxh64_intdigest(xxhash.xxh64_intdigest(w.encode(), seed=42).to_bytes(8, "little"), seed=h)
        hashes.append(h >> 30)
    return sorted({h for h in hashes if h < 1 << 32}) or sorted(hashes)[:1]


def shingles(text, k=2):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return frozenset()
    return frozenset([tuple(ws)]) if len(ws) < k else frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))


def components(docs, k=2, percent=80):
    """docs: (doc_id, text) -> {doc_id: (n_shingles, component)}; all pairs with a common shingle are compared."""
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders, first = defaultdict(list), {}
    for d in sorted(sets):
        if not sets[d]:
            continue
        if sets[d] in first:
            parent[root(d)] = root(first[sets[d]])
            continue
        first[sets[d]] = d
        common = Counter(h for s in sets[d] for h in holders[s])
        for h, c in common.items():
            if 100 * c >= percent * (len(sets[d]) + len(sets[h]) - c):
                a, b = sorted((root(d), root(h)))
                parent[b] = a
        for s in sets[d]:
            holders[s].append(d)
    least = {}
    for d in sorted(sets):
        least.setdefault(root(d), d)
    return {d: (len(sets[d]), least[root(d)]) for d in sets}


def edited(docs):
    """docs: (doc_id, text) in ascending order -> {doc_id: (n_chars, sha256 of the edited text)}."""
    out = {}
    for i, (d, t) in enumerate(docs):
        t, nxt = t or "", docs[(i + 1) % len(docs)][1] or ""
        q = len(t) // 4
        out[d] = (len(t), sha256(t[: len(t) - q] + nxt[:q]))
    return out


def archive(pages, least=0):
    holder = {}
    for p, html in pages:
        h = (html or "").encode()
        if len(h) >= least:
            holder[h] = max(holder.get(h, p), p)
    out = {}
    for p, html in pages:
        h = (html or "").encode()
        other = holder.get(h, p)
        out[p] = (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if other == p else "revisit", None if other == p else other)
    return out


def crc_of(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
