"""The whole query in plain Python, for tests: tables and loops, and nothing of the library.

Texts are given with their size; sounds as a function of a token that gives
its phonemes, None for an unvoiced token and ``UNKNOWN`` for one of unknown
sound.
"""

from __future__ import annotations

import math
from itertools import combinations

UNKNOWN = ("?",)
GAP = object()


def common(a, b):
    """Length of the longest common subsequence by its table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    return table[-1][-1]


def ratio(a, b):
    return 2 * common(a, b) / (len(a) + len(b)) if len(a) + len(b) else 1.0


class Doc:
    def __init__(self, id, tokens, spaces, sounds, syllables):
        self.id, self.tokens, self.spaces = id, tokens, spaces
        self.sounds, self.syllables = [sounds(t) for t in tokens], [syllables(t) for t in tokens]

    def text(self, start, end):
        return "".join(t + s for t, s in zip(self.tokens[start:end], self.spaces[start:end])).removesuffix(self.spaces[end - 1] if end > start else "")

    def spoken(self, start, end):
        return "".join(x or "" for p in self.sounds[start:end] for x in p or ())

    def unknown(self, start, end):
        return any(p == UNKNOWN for p in self.sounds[start:end])


def seeds(docs, order, all_pairs, spaces_break=True):
    """Pairs of places, in the order of documents, whose n-grams sound alike."""
    places = {}
    for n, d in enumerate(docs):
        for start in range(max(len(d.tokens) - order + 1, 1) if d.tokens else 0):
            end = min(start + order, len(d.tokens))
            text = d.text(start, end) if spaces_break else "".join(d.tokens[start:end])
            if text.isalpha() and not d.unknown(start, end):
                places.setdefault(d.spoken(start, end), []).append((n, start, end))
    found = {}
    for bucket in places.values():
        for (a, s, e), (b, t, f) in combinations(bucket, 2):
            variant = any(x != y and p == q for x, y, p, q in zip(docs[a].tokens[s:e], docs[b].tokens[t:f], docs[a].sounds[s:e], docs[b].sounds[t:f]))
            if a != b and (all_pairs or variant):
                found.setdefault((a, b), []).append((s, e, t, f))
    return found


def score(u, v, m, limit, phonetic, front):
    s, e, t, f = m
    if phonetic and (u.unknown(s, e) or v.unknown(t, f)):
        return -1
    a, b = (u.spoken(s, e), v.spoken(t, f)) if phonetic else (u.text(s, e), v.text(t, f))
    return ratio(a[:limit], b[:limit]) if front else ratio(a[-limit:], b[-limit:])


def extend(u, v, m, threshold, limit, phonetic=True):
    ends = []
    for front in (False, True):
        s, e, t, f = m
        now, fallen = score(u, v, m, limit, phonetic, front), 0
        while now >= threshold and (s > 0 and t > 0 if front else e < len(u.tokens) and f < len(v.tokens)):
            s, e, t, f = (s - 1, e, t - 1, f) if front else (s, e + 1, t, f + 1)
            new = score(u, v, (s, e, t, f), limit, phonetic, front)
            fallen, now = (fallen + 1 if new < now else 0), new
        ends.append((s + fallen, t + fallen) if front else (e - fallen, f - fallen))
    (e, f), (s, t) = ends
    return (s, e, t, f), score(u, v, (s, e, t, f), limit, phonetic, False)


def folded(u, v, matches, threshold, limit, phonetic=True):
    done, working = [], []
    for m in sorted(matches):
        if working and m[0] < working[0][0][1]:
            if not any(w[2] <= m[2] and m[3] <= w[3] for w, _ in working):
                working.append(extend(u, v, m, threshold, limit, phonetic))
        else:
            done, working = done + working, [extend(u, v, m, threshold, limit, phonetic)]
    return done + working


def local(a, b):
    """Local alignment: (start in a, start in b, columns of places, score); ties go up, diagonal, left, and to the last cell."""
    n, m = len(a), len(b)
    table = [[0] * (n + 1) for _ in range(m + 1)]
    best = (0, 0, 0)
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            table[i][j] = max(0, table[i - 1][j] - 1, table[i][j - 1] - 1, table[i - 1][j - 1] + (1 if a[j - 1] == b[i - 1] else -1))
            if table[i][j] >= best[0] and table[i][j] > 0:
                best = (table[i][j], i, j)
    top, i, j = best
    columns = []
    while i and j:
        here = table[i][j]
        if here == table[i - 1][j] - 1:
            i -= 1
            columns.insert(0, (GAP, i))
        elif here == table[i - 1][j - 1] + (1 if a[j - 1] == b[i - 1] else -1):
            i, j = i - 1, j - 1
            columns.insert(0, (j, i))
        elif here == table[i][j - 1] - 1:
            j -= 1
            columns.insert(0, (j, GAP))
        else:
            break
    return j, i, columns, top


def align(u, v, m, phonetic=True, gap="　"):
    s, e, t, f = m
    symbols = lambda d, a, b: ["".join(x or "" for x in p or ()) or w for p, w in zip(d.sounds[a:b], d.tokens[a:b])] if phonetic else d.tokens[a:b]
    a, b, columns, top = local(symbols(u, s, e), symbols(v, t, f))
    nu, nv = sum(x is not GAP for x, _ in columns), sum(y is not GAP for _, y in columns)
    us, vs, ue, ve = s + a, t + b, s + a + nu, t + b + nv
    rows = [(GAP if x is GAP else u.tokens[s + x], GAP if y is GAP else v.tokens[t + y]) for x, y in columns][: max(nu, nv)]
    mark = lambda c: any(x is not GAP and not x.isalnum() for x in c)
    while rows and mark(rows[-1]):
        rows, ue, ve = rows[:-1], max(ue - 1, us), max(ve - 1, vs)
    while rows and mark(rows[0]):
        rows, us, vs = rows[1:], min(us + 1, ue), min(vs + 1, ve)
    if not rows:
        return None
    shown = [[gap if c[k] is GAP else c[k] for c in rows] for k in (0, 1)]
    return (us, ue, vs, ve), top / len(rows), *shown


def reuse(docs, order=4, threshold=0.7, limit=50, all_pairs=False, spaces_break=True, filters=(8, 64, 0.0, 0.9, 0.7, 1.0)):
    """Dicts of the results in their order, with ``rank`` for ties."""
    low, high, g_low, g_high, p_low, p_high = filters
    out = []
    for (a, b), found in sorted(seeds(docs, order, all_pairs, spaces_break).items()):
        u, v = docs[a], docs[b]
        for seq, (m, _) in enumerate(folded(u, v, found, threshold, limit)):
            done = align(u, v, m)
            if done is None:
                continue
            (s, e, t, f), weight, au, av = done
            graphic = ratio(au, av)
            if low <= max(e - s, f - t) <= high and g_low <= graphic <= g_high and p_low <= weight <= p_high:
                out.append({
                    "u_id": u.id, "v_id": v.id, "u_text": u.text(s, e), "v_text": v.text(t, f), "u_text_aligned": "".join(au), "v_text_aligned": "".join(av),
                    "u_transcription": "*" + " ".join(u.syllables[s:e]), "v_transcription": "*" + " ".join(v.syllables[t:f]), "u_start": s, "u_end": e, "v_start": t, "v_end": f,
                    "phonetic_similarity": weight, "graphic_similarity": graphic, "score": weight / graphic if graphic else math.inf, "rank": (a, b, seq),
                })
    return sorted(out, key=lambda r: (-r["score"], r["rank"]))


def groups(rows):
    """(number of matches, means, anchor) of every group of results."""
    one = {}
    for r in sorted(rows, key=lambda r: (r["rank"][:2], r["u_start"], r["u_end"], r["v_start"], r["v_end"])):
        one.setdefault((*sorted((r["u_id"], r["v_id"])), *sorted((r["u_text"], r["v_text"]))), r)
    held = {}
    for r in rows:
        key = (*sorted((r["u_id"], r["v_id"])), *sorted((r["u_text"], r["v_text"])))
        for x in "uv":
            held.setdefault((r[f"{x}_id"], r[f"{x}_start"], r[f"{x}_end"]), set()).add(key)
    found, joined = set(), []
    for keys in held.values():
        if len(keys) == 1:
            found.add(frozenset(keys))
            continue
        touched = [g for g in joined if g & keys]
        joined = [g for g in joined if not g & keys] + [set().union(keys, *touched)]
    out = []
    for g in [*found, *map(frozenset, joined)]:
        ms = [one[k] for k in g]
        spans = [(m[f"{x}_text_aligned"], m["rank"]["uv".index(x)], m[f"{x}_start"], m[f"{x}_end"], m[f"{x}_id"], m[f"{x}_text"]) for m in ms for x in "uv"]
        _, _, start, end, id, text = min(spans)
        mean = lambda c: sum(m[c] for m in ms) / len(ms)  # noqa: B023, E731
        out.append((len(ms), mean("graphic_similarity"), mean("phonetic_similarity"), mean("score"), id, start, end, text))
    return sorted(out)
