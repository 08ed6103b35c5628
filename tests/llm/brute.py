"""Plain Python versions of the operators, for comparison on small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s) -> str:
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def rem(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def decontaminate(docs, bench, n=10):
    grams = defaultdict(set)
    for item, text in bench:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1) if w else ():
            grams[tuple(w[i : i + k])].add(item)
    out = []
    for d, text in docs:
        w, hit, items = words(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in grams:
                    hit.update(range(i, i + k))
                    items |= grams[g]
        ids = sorted(str(x) for x in items if x is not None)
        out.append((d, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    text, out = text or "", []
    for i, (kind, p) in enumerate(KINDS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), i, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def turns(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t, r is not None, r or "", x or ""))
    out = {}
    for c, ts in by.items():
        ts.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3], x[4]))
        loss = "".join(x[4] for x in ts if x[3] == "assistant")
        out[c] = (len(ts), sha("".join(f"{x[3]}\n{x[4]}\n" for x in ts)), len(loss), sha(loss))
    return out


def repeats(texts, n=400):
    """For each text: its bytes, and whether each is covered by an n-byte string that starts anywhere else too."""
    seen = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] += 1
    out = []
    for b in raw:
        cover = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                cover[i : i + n] = b"\1" * n
        out.append((b, cover))
    return out
