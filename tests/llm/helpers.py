"""Small tables and brute-force versions that the operator tests share."""

import collections
import hashlib
import re

GAP = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, tag string, "
          "node string, key string, score string, digest string, words string, target string, taken string, "
          "copy string, kept string, start string, runs string, held_out string")

PASSAGE = " ".join(f"shared{k}" for k in range(70))
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))


def row(doc_id, text, lang="en", source="a"):
    extra = ["9"] * 13
    return (doc_id, text, lang, source, None, 5, *extra)


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    return [
        row(1, "same text here for two rows of this table"),
        row(2, "same  text\there\nfor two rows of this table"),
        row(2, "same  text\there\nfor two rows of this table"),
        row(3, None), row(4, ""), row(5, "   \n\t"), row(None, None, None, None),
        row(6, LONG), row(7, LONG + " end", source=None), row(8, "head words " + PASSAGE + " tail"),
        row(9, PASSAGE), row(10, "one " + PASSAGE + " two", lang=None), row(11, "a"), row(12, "A"),
        row(13, "été où x  y"), row(None, "an id that is null, with text", "fr", "b"),
        row(14, "<|im_end|> <\\|x|> password=abcdef123 AKIA" + "A" * 20),
        (15, "only an id and a text", None, None, None, *[None] * 14),
    ]


def words(text):
    return (text or "").encode().split()


def brute_substring(rows, width=50):
    top = 1 << 63
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            first[key] = min(first.get(key, top), top if d is None else d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < (top if d is None else d):
                gone[i:i + width] = [True] * width
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return out


def shingle_set(text):
    w = (text or "").encode().lower().split()
    if len(w) >= 5:
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def brute_near(rows, percent=85):
    """{row number: (set size, smallest id of its component)}; ids may repeat or be null."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    for k, s in enumerate(sets):
        shared = collections.Counter(e for x in s for e in where[x] if e > k)
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                parent[find(e)] = find(k)
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[find(k)] = min(low.get(find(k), d), d)
    return [(d, len(sets[k]), low.get(find(k)) if sets[k] else d) for k, (d, _) in enumerate(rows)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
