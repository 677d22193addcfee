"""Plain versions of the operators, over lists of rows."""

import collections
import hashlib
import math
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEYS = ("doc_id", "text", "source")


def low(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def secrets(docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = []
    for d in docs:
        t = d["text"] or ""
        s = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        s += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        s += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        names = ("assign", "access", "hex")
        out.append((d["doc_id"], *[sum(x[1] == k for x in s) for k in range(3)], sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(s)))))
    return out


def fingerprint(text):
    w = WORD.findall(low(text or ""))
    parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for j in range(64):
            counts[j] += h >> j & 1
    return sum(1 << j for j in range(64) if 2 * counts[j] > len(parts)) if parts else 0


def components(prints, limit=4):
    """{fingerprint: smallest of its component} over a set of them."""
    up = {x: x for x in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    u = sorted(prints)
    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= limit:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {x: root(x) for x in u}


def near_duplicates(docs):
    fp = [fingerprint(d["text"]) for d in docs]
    of = components(set(fp))
    least = {}
    for d, x in zip(docs, fp, strict=True):
        if d["doc_id"] is not None:
            least[of[x]] = min(d["doc_id"], least.get(of[x], d["doc_id"]))
    return [(d["doc_id"], f"{x:016x}", least.get(of[x])) for d, x in zip(docs, fp, strict=True)]


def base_scores(docs):
    held = lambda d: zlib.crc32(("" if d["doc_id"] is None else str(d["doc_id"])).encode()) % 5 == 1
    tokens = [[*WORD.findall(low(d["text"] or "")), "\n"] for d in docs]
    c = collections.Counter(t for d, ts in zip(docs, tokens, strict=True) if not held(d) for t in ts)
    n, v = sum(c.values()), len(c)
    return [(d["doc_id"], held(d), len(ts), sum(t in c for t in ts), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)) for d, ts in zip(docs, tokens, strict=True)]


def contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for b in items:
        w = word.findall(low(b["text"] or ""))
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add("" if b["item_id"] is None else str(b["item_id"]))
    out = []
    for d in docs:
        w, hit, met = word.findall(low(d["text"] or "")), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    met |= found
        out.append((d["doc_id"], len(w), len(hit), len(met), sha(",".join(sorted(met))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def lines(docs, least=3):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(list)
    for d in docs:
        for k in {key(x) for x in (d["text"] or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(d["doc_id"])
    out = []
    for d in docs:
        all_lines = (d["text"] or "").split("\n")
        top = lambda k: max((x for x in held[k] if x is not None), default=None)
        kept = [x for x in all_lines if not (len(held.get(key(x), ())) >= least and top(key(x)) != d["doc_id"])]
        out.append((d["doc_id"], len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def repeats(docs, length=50):
    seen, out = {}, []
    for d in docs:
        b = (d["text"] or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            own = -(2**63) if d["doc_id"] is None else d["doc_id"]
            seen[s] = min(own, seen.get(s, own))
    for d in docs:
        b = (d["text"] or "").encode()
        gone = bytearray(len(b))
        own = -(2**63) if d["doc_id"] is None else d["doc_id"]
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] < own:
                gone[i : i + length] = b"\1" * length
        out.append((d["doc_id"], len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, y in zip(b, gone, strict=True) if not y))))
    return out


def rules(docs):
    out = []
    for d in docs:
        t = d["text"] or ""
        w, ls = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        m = set()
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                m |= {i, i + 1, i + 2}
        out.append((d["doc_id"], len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(ls) - len(set(ls)), len(m), len(w) < 50 or 100 * len(m) > 50 * len(w)))
    return out


def edited(docs):
    """doc_id, code points, hash of the edited text, common prefixes, and the true likeness of span sets with the edited and the next text."""
    def spans(t, k=8):
        return {t[i : i + k] for i in range(len(t) - k + 1)} if len(t) >= k else {t} if t else set()

    def like(a, b):
        x, y = spans(a), spans(b)
        return 1.0 if a == b else len(x & y) / max(1, len(x | y))

    def same(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    def body(t):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    rows = sorted(((d["doc_id"], d["text"] or "") for d in docs), key=lambda r: (r[0] is not None, r[0] or 0, body(r[1])))
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        m = len(t) // 4
        e = t[: len(t) - m] + after[:m]
        yield i, len(t), sha(e), same(t, e), same(t, after), like(t, e), like(t, after)


def repairs(rows):
    """op12's columns for rows (conv_id, turn, role, text): the least of all cheapest strings, carried from row to row."""
    convs = {}
    for conv, turn, role, text in rows:
        got = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        got += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for conv, got in convs.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds = set(), []
        for _, role, text in got:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in got if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(got, got[1:], strict=False)]
        best = {"": (0, "", [])}  # by initials so far, shortened to what decides what may follow

        def add(out, state, cost, edits, lines):
            if state not in out or (cost, edits) < out[state][:2]:
                out[state] = (cost, edits, lines)

        def inserts(out):
            for _ in range(3):
                for state, (cost, edits, lines) in list(out.items()):
                    name = "assistant" if state == "u" else "user"
                    add(out, name[0], cost + 2, edits + "I", [*lines, name + ":"])
            return out

        inserts(best)
        for (_, role, text), kind in zip(got, kinds, strict=True):
            after = {}
            for state, (cost, edits, lines) in best.items():
                add(after, state, cost + 3, edits + "D", lines)
                if kind in ("blank", "duplicate"):
                    continue
                late, name = int(kind == "truncated"), "assistant" if state == "u" else "user"
                add(after, name[0], cost + 2 + late, edits + "R", [*lines, f"{name}:{text}"])
                if role[:1] == name[0] or (role[:1] == "s" and not state):
                    add(after, role[0], cost + late, edits + "K", [*lines, f"{role}:{text}"])
            best = inserts(after)
        cost, edits, lines = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
        yield conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, sha("\n".join(lines))
