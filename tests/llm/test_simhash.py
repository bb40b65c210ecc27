"""SimHash near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from verdant.llm import simhash

DOCS = "doc_id long, text string, fp string, variant long, u long"  # clashing extra columns


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)
    return sorted((tuple(r)[:3] for r in simhash.near_duplicates(df).collect()), key=repr)


def test_equals_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ΑΣ", "QUITE", "quite"]
    rows = [(10, None), (11, ""), (12, " \n\t\x0b"), (13, "one"), (14, "ONE"), (15, "two words"), (16, "a b c"), (16, "a b c"), (None, "a B c"),
            (None, "nobody has this one"), (17, "x y\x1cz w"), (18, "lorem " * 40_000), (19, "z" * 200_000), (None, None)]
    for base in range(8):  # near copies: long texts with a word or two changed, and exact copies
        words = [rng.choice(vocabulary) for _ in range(rng.choice([20, 400, 3000]))]
        for i in range(12):
            own = list(words)
            for _ in range(i % 4):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((rng.randrange(10**6), " ".join(own)))
    rng.shuffle(rows)
    want = brute(rows)
    assert run(spark, rows) == want
    assert len({r[2] for r in want}) < len({r[1] for r in want})  # some components hold several fingerprints


def test_ball_links_of_bare_fingerprints(spark):
    rng = random.Random(5)
    fps = {0}
    for _ in range(40):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.add(at)
            for _ in range(rng.randint(1, 4)):
                at ^= 1 << rng.randrange(64)
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    got = simhash.ball_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(far(r.u, r.v) <= 2 for r in got) and len(got) == len({(r.u, r.v) for r in got})

    def parts(pairs):
        root = {x: x for x in signed}
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for x in signed:
            groups.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, groups.values()))

    assert parts((r.u, r.v) for r in got) == parts((a, b) for a in signed for b in signed if a < b and far(a, b) <= 2)


def test_group_of_near_copies_stays_linear(spark):
    """A full ball of 65 neighbours and their neighbours: links grow with the members, not with their square."""
    ball = [0] + [1 << i for i in range(63)] + [(1 << i) | (1 << j) for i in range(63) for j in range(i)]
    links = simhash.ball_links(spark.createDataFrame([(x,) for x in ball], "fp long")).count()
    assert links <= 65 * len(ball)


@pytest.mark.parametrize("stretch", [1, 2, 7])
def test_stretches_do_not_change_the_fingerprint(monkeypatch, stretch):
    text = "Some words, some MORE words and Été " * 5
    monkeypatch.setattr(simhash, "STRETCH", stretch)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_empty_table(spark):
    assert run(spark, []) == []
