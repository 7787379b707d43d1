"""Plain versions of the operators' contracts, for small inputs."""

import re
from collections import Counter

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def fingerprint(text, shingle=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    tokens = WORD.findall(low)
    if not tokens:
        return 0
    parts = [" ".join(tokens[i : i + shingle]) for i in range(max(len(tokens) - shingle + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    """Smallest index connected with each of n, from pairs of indices."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    tokens = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(tokens[i : i + 3]) for i in range(len(tokens) - 2))
    covered = {i + k for i in range(len(tokens) - 2) if windows[tuple(tokens[i : i + 3])] > 1 for k in range(3)}
    return len(tokens), sum(map(len, tokens)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def phrases(text):
    """n_words, n_base, first_word, last_word, base labels."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    tokens = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        want = phrase.split()
        for i in range(len(tokens) - len(want) + 1):
            if tokens[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return (
        len(tokens), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
    )


def address(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def water_targets(sizes, weights, total):
    """Targets by repeated dealing of the excess."""
    left, target, open_ = total, {}, set(sizes)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * weights[s]}
        if not full:
            target.update({s: level * weights[s] for s in open_})
            break
        target.update({s: 2.0 * sizes[s] for s in full})
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target
