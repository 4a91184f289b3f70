"""Plain versions of the operators, one document or all pairs at a time, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# --- personal data -----------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(number):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(number[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def base_spans(text):
    def valid(kind, found):
        number = re.sub(r"[^0-9]", "", found)
        if kind == "ip":
            return all(int(part) <= 255 for part in found.split("."))
        if kind == "card":
            return 16 <= len(number) <= 19 and _luhn(number)
        return kind == "email" or 8 <= len(number) <= 15

    return {
        kind: [m.span() for m in re.finditer(pattern, text) if valid(kind, m.group())]
        for kind, pattern in BASE.items()
    }


# --- quality -----------------------------------------------------------------------------------


def measures(text):
    text = text or ""
    found = words(text)
    three = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    count = Counter(three)
    covered = {p for i, w in enumerate(three) if count[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if words(line)]
    return {
        "n_words": len(found),
        "word_chars": sum(map(len, found)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(found) < 50 or 100 * len(covered) > 50 * len(found),
    }


def line_key(line):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return hashlib.md5(re.sub(r"[\x20\x09-\x0D0-9]+", " ", lowered).strip(" ").encode()).hexdigest()


def frequent(rows, min_documents):
    """The (host, line key) pairs held by too many different texts of the host."""
    held, texts = defaultdict(set), defaultdict(set)
    for host, text in rows:
        for line in (text or "").split("\n"):
            if words(line):
                held[host, line_key(line)].add(text)
                texts[host].add(text)
    return {
        (host, key)
        for (host, key), found in held.items()
        if len(found) > min_documents and len(found) ** 2 > len(texts[host])
    }


def verdicts(rows, min_documents):
    """(measures, removed words, kept) of (host, text) rows."""
    above = frequent(rows, min_documents)
    result = []
    for host, text in rows:
        gone = 0
        for line in (text or "").split("\n"):
            if words(line) and (host, line_key(line)) in above:
                gone += len(words(line))
        found = measures(text)
        left = found["n_words"] - gone
        depleted = gone > 0 and (
            (left < 50 and left < 0.5 * found["n_words"]) or left < 0.2 * found["n_words"]
        )
        result.append((found, gone, not found["base_failed"] and not depleted))
    return result


# --- near-duplicates ---------------------------------------------------------------------------


def fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = words(lowered)
    if not found:
        return 0
    shingles = [found[i : i + 4] for i in range(len(found) - 3)] or [found]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def component_ids(rows, distance=4):
    """The component id of every (doc id, fingerprint) row, by all pairs."""
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= distance:
                group[find(i)] = find(j)
    members = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        members[find(i)].append(doc_id)
    smallest = {
        root: min((d for d in ids if d is not None), default=None) for root, ids in members.items()
    }
    return [smallest[find(i)] for i in range(len(rows))]


# --- mixing ------------------------------------------------------------------------------------


def targets(sizes, weights=(1, 2, 3), most=3):
    """Target of every source: share by weight, cut at ``most`` times its size, share again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    cut, budget = set(), sum(sizes.values())
    while True:
        free = [name for name in names if name not in cut]
        rest = budget - sum(most * sizes[name] for name in cut)
        total = sum(weight[name] for name in free)
        share = {name: rest * weight[name] / total for name in free}
        over = {name for name in free if share[name] > most * sizes[name]}
        if not over:
            return share | {name: float(most * sizes[name]) for name in cut}
        cut |= over


def mix(rows, most=3):
    """(size, source size, target, taken) of (doc id, source, text) rows."""
    size = [len(words(text)) for _, _, text in rows]
    sizes = Counter()
    for (_, source, _), n in zip(rows, size):
        sizes[source] += n
    target = targets(sizes, most=most)

    def order(i):
        doc_id, _, text = rows[i]
        inner = hashlib.md5((text or "").encode()).hexdigest()
        return hashlib.md5(f"{'' if doc_id is None else doc_id}|{inner}".encode()).hexdigest()

    turns, taken, so_far = [], [0] * len(rows), Counter()
    for i in sorted(range(len(rows)), key=order):
        source = rows[i][1]
        so_far[source] += size[i]
        if size[i]:
            turns += [
                ((so_far[source] + turn * sizes[source]) / target[source], order(i), i)
                for turn in range(most)
            ]
    through, budget = 0, sum(size)
    for _, _, i in sorted(turns):
        through += size[i]
        if through > budget:
            break
        taken[i] += size[i]
    return [(n, sizes[r[1]], target[r[1]], t) for n, r, t in zip(size, rows, taken)]
