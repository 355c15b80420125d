"""Plain versions of the operators, row by row, and a table of awkward documents."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIRST = 1 << 62
EXTRA = ["kept", "keep_id", "node", "label", "part", "block", "_key", "n", "bucket", "_doc", "_gone", "digest", "epoch", "row", "__patchloom"]


def documents(seed=4, size=120):
    """Rows (doc_id, text, lang, source, n_chars): nulls, empty and long texts, ties, repeated rows, near copies, odd characters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßн") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 90))) for _ in range(8)]
    out = []
    for i in range(size):
        kind = i % 12
        if kind == 0:
            text = None
        elif kind == 1:
            text = rng.choice(["", " ", "\n\n \t", "....", "12 34"])
        elif kind in (2, 3, 4):
            words = rng.choice(base).split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = rng.choice([" ", "\n"]).join(words)
        elif kind == 5:
            text = rng.choice(base).replace(" ", rng.choice([" ", "  ", "\t"]))
        elif kind == 6:
            text = rng.choice(["a" * 700, "ab " * 200, "one", "One two", "x\n" * 40, "😀 ﬁ ½ \x00 \u00a0z Ａ. don't <|endoftext|>"])
        else:
            text = ". ".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", " " + rng.choice(base)[:120]])
        out.append((i, text, None if i % 19 == 0 else ["en", "fr", "de"][i % 3], None if i % 23 == 0 else f"src{i % 7 if i % 2 else 0}", len(text or "")))
    out += [out[2], out[2], (None, "a row without id " + base[0], "en", "src1", 1), (None, None, None, None, None)]
    return out


def frame(spark, rows=None):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(documents() if rows is None else rows, schema)
    for name in EXTRA:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df.repartition(3)


def key(i):
    return FIRST if i is None else i


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)

    def inside(n):
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return {j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}

    chars, five = sum(map(len, w)), inside(5)
    failed = len(w) < 10 or 100 * len(five) > 20 * len(w)
    seen, lines = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            lines += len(line) if line in seen else 0
            seen.add(line)
    bad = lines > 0.2 * chars or any(sum(len(w[j]) for j in inside(n)) > share * chars for n, share in {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}.items())
    return len(w), chars, sum(t.count(c) for c in "#*$%&|<>"), dup, len(five), failed, not failed and not bad


def exact(rows):
    groups = {}
    for i, text, *_ in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(bare, []).append((-len(text or ""), key(i), i))
    out = []
    for i, text, *_ in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        keep = min(groups[bare])[2]
        out.append((i, keep, len(groups[bare]), i == keep, hashlib.sha256(bare.encode()).hexdigest()))
    return out


def near(rows, k):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, text, *_ in rows:
        w = WORD.findall((text or "").translate(low))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = sets[a] == sets[b] and sets[a]
            linked = rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            if same or linked:
                root[find(a)] = find(b)
    least = {}
    for x, r in enumerate(rows):
        if r[0] is not None:
            least[find(x)] = min(least.get(find(x), FIRST), r[0])
    # a row without id shares the component of rows with its set only
    return [(r[0], len(sets[x]), c := (r[0] if not sets[x] else least.get(find(x))), r[0] is not None and r[0] == c) for x, r in enumerate(rows)]


def long_matches(rows, length=50):
    first = {}
    for i, text, *_ in rows:
        b = (text or "").encode()
        for j in range(len(b) - length + 1):
            first[b[j : j + length]] = min(first.get(b[j : j + length], FIRST + 1), key(i))
    out = []
    for i, text, *_ in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < key(i):
                gone[j : j + length] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(left).hexdigest()))
    return out


def token_files(rows, encode):
    at, out = 0, []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*encode(text or ""), 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out
