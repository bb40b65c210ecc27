"""The corpus pipeline against a brute-force version, stage by stage."""

import collections
import hashlib
import random
import re
import zlib

import pytest

import corpus_pipeline
from verdant.llm import bpe, exact_dedup, language, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def brute_near(texts):
    """Ids that stay: the smallest of each component."""
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {d: lo if r == hi else r for d, r in root.items()}
    return {d for d in root if root[d] == d}


def make_rows():
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(40, 90))) for _ in range(25)]
    texts += [texts[3].upper(), texts[3], texts[7]]  # exact copies but for case
    for i in (1, 1, 5):  # near copies: one word more
        texts.append(texts[i] + " " + rng.choice(vocab))
    texts += ["write to someone@mail.example.org or call +1 (208) 555-0199 soon", None, "", "12 34 !!"]
    return [(10 * i + 1, t, "en" if i % 2 else "de", "web", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def steps(spark):
    """Each stage's rows by name, as the pipeline writes and reads them."""
    docs = spark.createDataFrame(make_rows(), DOCS)
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, ""), f"test_{name}")
        out[name] = docs
    return out


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_brute_force(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "pii", "packing"]
    for name in ("language", "exact_dedup", "near_dedup", "pii"):
        assert steps[name].columns == steps["documents"].columns
    first = texts_of(steps["documents"])
    spoken = texts_of(steps["language"])
    assert spoken == {d: t for d, t in first.items() if language.LETTERS.search(t or "")}
    last = {}
    for d, t in sorted(spoken.items()):
        last[fold(t)] = d
    exact = texts_of(steps["exact_dedup"])
    assert exact == {d: spoken[d] for d in last.values()} and len(exact) < len(spoken)
    near = texts_of(steps["near_dedup"])
    assert near == {d: exact[d] for d in brute_near(exact)} and len(near) < len(exact)
    clean = texts_of(steps["pii"])
    assert clean.keys() == near.keys() and any("[EMAIL]" in t and "[PHONE]" in t for t in clean.values())
    for d, t in clean.items():
        assert not pii.scan(t) and (pii.scan(near[d]) or t == near[d])


def test_packing_holds_all_that_the_stages_kept(steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    ids = {d: library.encode(t, add_special_tokens=False).ids + [2] for d, t in texts_of(steps["pii"]).items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in steps["packing"].collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == ids.keys()
    for d, rows in pieces.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            part = ids[d][r.start:r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += r.length
        assert at == len(ids[d])
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_empty_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, ""), f"empty_{name}")
    assert docs.count() == 0


def test_dedup_stages_keep_one_row_without_an_id_or_repeated(spark):
    rng = random.Random(6)
    long = [" ".join(rng.choice(["red", "green", "blue", "nine", "four"]) + str(rng.randrange(900)) for _ in range(80)) for _ in range(4)]
    rows = [(1, long[0]), (1, long[0]), (None, long[0]), (None, long[0] + " more"), (2, long[0] + " end"),
            (None, long[1]), (None, long[1]), (None, long[1] + " more"), (5, long[2]), (5, long[2] + " end"), (5, long[3]), (None, long[3] + "  end")]
    docs = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], DOCS)
    stages = dict(corpus_pipeline.STAGES)
    exact = corpus_pipeline.written(stages["exact_dedup"](spark, docs, ""), "test_once_exact")
    assert exact.columns == docs.columns
    count = collections.Counter((r.doc_id, r.text) for r in exact.collect())
    assert count == {x: 1 for x in set(rows) - {(None, long[0])}}
    near = stages["near_dedup"](spark, exact, "")
    assert near.columns == docs.columns
    got = sorted((next(i for i, t in enumerate(long) if r.text.startswith(t)), r.doc_id or 0) for r in near.collect())
    assert got == [(0, 1), (1, 0), (2, 5), (3, 5)]


def test_exact_stage_goes_through_the_digest_index(spark, monkeypatch):
    seen = []
    plain = exact_dedup.DigestIndex.add

    def counted(index, batch):
        rows = [(r.doc_id, bytes(r.digest).hex()) for r in batch.collect()]
        seen.extend(rows)
        return plain(index, batch)

    monkeypatch.setattr(exact_dedup.DigestIndex, "add", counted)
    # a heavy text, repeats of the row that stays, and texts of their own
    rows = [(i, "HEAVY one" if i % 2 else "heavy ONE") for i in range(60)] + [(59, "HEAVY one")] * 2 + [(100 + i, f"own {i}") for i in range(20)]
    docs = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], DOCS)
    got = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == [59, *range(100, 120)]
    assert collections.Counter(seen) == collections.Counter((d, hashlib.sha256(fold(t).encode()).hexdigest()) for d, t in rows)


def test_near_stage_has_five_words_and_80_percent(spark):
    """Four words changed in 200: 0.886 on three-word shingles, 0.815 on five-word ones."""
    rng = random.Random(5)
    texts = {}
    for i in range(12):
        words = [f"v{rng.randrange(5000)}" for _ in range(200)]
        texts[10 * i] = " ".join(words)
        for n in range(1, 4):  # 4, 8 and 3 changes, evenly spread
            gap = (0, 50, 25, 66)[n]
            texts[10 * i + n] = " ".join(f"new{i}x{n}x{j}" if j % gap == gap // 2 else w for j, w in enumerate(words))
    for size in (6, 9, 14, 30):  # small sets too
        words = [f"s{size}x{j}" for j in range(size)]
        texts[1000 + size], texts[2000 + size] = " ".join(words), " ".join(words + ["end"])
    sets = {d: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in texts.items())}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {d: lo if r == hi else r for d, r in root.items()}
    docs = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in texts.items()], DOCS)
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}
    assert got == {d for d in root if root[d] == d} and 1 not in got and 2 in got
