"""Line dedup, the prefix trie and fill-in-the-middle against plain loops."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import awkward, table, words

from pairworks.llm import fill_middle, line_dedup, prefix_trie

SPACE = " \t\n\x0b\x0c\r"
SHARED = ["A line that Many documents share", "  a LINE that many documents share\t", "ünïcödé 中文 line", "short", "", "exactly 10",
          "Ärger mit Umlauten", "ärger mit umlauten", "\x1cnot white space\x1c"]


def key_of(line):
    key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    return key if len(key) >= 10 else None


def brute_lines(rows, live=None):
    """(id, n_lines, n_dropped, kept) per row; `live` are the ids that count."""
    ids = [i for i, _ in rows] if live is None else live
    held = {}
    for i, text in rows:
        if i in ids:
            for key in {key_of(line) for line in (text or "").split("\n")} - {None}:
                held.setdefault(key, set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(held.get(key_of(line), ())) > 1 and i != min(held[key_of(line)], key=lambda x: (x is None, x or 0)) for line in lines]
        out.append((i, len(lines), sum(gone), "\n".join(line for line, g in zip(lines, gone, strict=True) if not g)))
    return out


def line_rows(seed, n):
    rng = random.Random(seed)
    pool = SHARED + [f"one of the common lines {i}" for i in range(30)]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else words(rng.random(), 4) for _ in range(rng.randrange(8)))) for i in range(n)]


def ordered(rows):
    return sorted(rows, key=str)


def check_index(index):
    """The counts are those of the live references, and the filters hold a fingerprint per count."""
    held = Counter((r.h1, r.h2) for r in index.live_references().collect())
    counts = index.stored_counts().collect()
    assert {(r.h1, r.h2): r.n for r in counts} == held and len(counts) == len(held)
    filters = {r.shard: line_dedup.Cuckoo(r.data, index.buckets) for r in index.stored_filters().collect()}
    assert sum(int((part > 0).sum()) for f in filters.values() for part in f.parts) == len(held)
    for h1, h2 in held:
        found = filters[(h1 % 2**64 >> 34) % index.shards].contains(np.array([h1]), np.array([h2]))
        assert found.all()


def test_lines_by_brute_force(spark):
    rows = awkward() + [(100 + i, t) for i, t in line_rows(1, 60)] + [(100, "ünïcödé 中文 line\nonly here, this one"), (None, SHARED[0] + "\n" + SHARED[0])]
    docs = table(spark, rows)
    for steps in (1, 3):
        got = line_dedup.dedupe_in_steps(docs.repartition(5), steps)
        assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
        assert ordered(map(tuple, got.collect())) == ordered(brute_lines(rows))
    assert line_dedup.report(docs.limit(0)).count() == 0
    alone = line_dedup.report(table(spark, [(4, None)])).collect()
    assert [tuple(r) for r in alone] == [(4, 1, 0, hashlib.sha256(b"").hexdigest())]


def test_documents_come_and_go(spark, monkeypatch):
    """Random insertions and deletions, with filters so small that they overflow into further parts."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    rng = random.Random(3)
    rows = line_rows(2, 90) + [(None, SHARED[0])]
    docs = table(spark, rows)
    index, live = line_dedup.empty_index(docs, buckets=4), set()
    waiting = [i for i, _ in rows]
    rng.shuffle(waiting)
    for step in range(4):
        come = [waiting.pop() for _ in range(22)]
        index = index.insert(docs.filter(docs.doc_id.isin([i for i in come if i is not None]) | (docs.doc_id.isNull() if None in come else docs.doc_id < 0)))
        live |= set(come)
        before = index
        go = rng.sample(sorted(live, key=str), 8)
        index = index.delete(spark.createDataFrame([(i,) for i in [*go, 5000]], "id long"))
        live -= set(go)
        check_index(index)
        here = table(spark, [r for r in rows if r[0] in live])
        got = line_dedup.dedupe_lines(index, here).collect()
        assert ordered(map(tuple, got)) == ordered(brute_lines([r for r in rows if r[0] in live]))
    check_index(before)
    # A document that comes back is as if it had never gone.
    index = index.insert(docs.filter(docs.doc_id.isin([i for i in go if i is not None])))
    check_index(index)
    none = index.delete(docs.select("doc_id"))
    assert none.stored_counts().count() == 0 and none.repeated().count() == 0
    check_index(none)


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    keys = rng.integers(-2**63, 2**63 - 1, (3000, 2))
    f = line_dedup.Cuckoo(buckets=256)
    f.add(keys[:900, 0], keys[:900, 1])
    assert len(f.parts) == 1 and f.contains(*keys[:900].T).all()
    f.add(keys[900:2500, 0], keys[900:2500, 1])
    assert len(f.parts) > 1 and f.contains(*keys[:2500].T).all()
    assert f.contains(*keys[2500:].T).mean() < 0.02
    f = line_dedup.Cuckoo(f.data(), 256)
    f.remove(*keys[:2000].T)
    assert f.contains(*keys[2000:2500].T).all() and sum(int((p > 0).sum()) for p in f.parts) == 500
    same = np.repeat(keys[:1], 20, axis=0)
    f.add(*same.T)
    f.remove(*same[:19].T)
    assert f.contains(*same[:1].T).all()
    with pytest.raises(ValueError):
        f.remove(*same[:5].T)


# --- the trie ---------------------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn int, role string, text string, pos string, id int"


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(ms) - 1) * len(p[-1][1]) if p else 0
    return [(min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), kids[p], leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c in sorted(ms) if built[c] == p).encode()).hexdigest()) for p, ms in members.items()]


def conversation_rows(seed):
    rng = random.Random(seed)
    said = [words(i, 3) for i in range(4)] + ["", None, "Ünïcödé 中文 😀"]
    rows = []
    for c in [*range(0, 40), *range(100, 130), 200, 201, 202, 305, 306, 307, -100, -101, -150]:
        n = 30 if c in (3, 200, 201, 202) else rng.randrange(0, 11)
        turns = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said[:2] if t < 4 else said)) for t in range(n)]
        if c == 7:
            turns = [(c, t, "user", said[0]) for t in (0, 0, 0, None, None, 2)]
        rows += turns
    rows += [(201 + i, t, "user", said[t % 3]) for i in (10, 11, 12) for t in range(70)]
    rows += [(400 + i, t, "user", said[t % 3] if t < 40 + i % 3 else f"end {i % 5}") for i in range(20, 40) for t in range(45)]
    return rows + [(None, 1, "user", "no conversation"), (900, None, None, None)]


@pytest.mark.parametrize("stretch, ends, chunk", [(4096, 4096, 1 << 20), (2, 3, 16)])
def test_trie_by_brute_force(spark, monkeypatch, stretch, ends, chunk):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "ENDS", ends)
    long_keys = prefix_trie.long_keys
    monkeypatch.setattr(prefix_trie, "long_keys", lambda df, keys, order: long_keys(df, keys, order, chunk))
    rows = conversation_rows(1)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS).repartition(4)
    got = prefix_trie.rebuilt_trie(df)
    want = brute_trie(rows)
    assert ordered(map(tuple, got.collect())) == ordered(want)
    assert max(r[1] for r in want) > 8 * 8 and any(r[5] > 1 and r[1] > 8 for r in want)


def test_trie_of_little(spark):
    df = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.rebuilt_trie(df).count() == 0
    # Conversation 1 takes the first turns of one that is not there, and has none after them.
    got = prefix_trie.rebuilt_trie(spark.createDataFrame([(1, 0, "user", "hi", "x", 1)], CONVERSATIONS)).collect()
    assert ordered(map(tuple, got)) == ordered(brute_trie([(1, 0, "user", "hi")]))


def test_digests_of_lists(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS", 7)
    rows = [(k, v) for k in range(4) for v in random.Random(k).sample(range(-500, 5000), 3 ** k * 10)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(6)
    got = {r.k: r.ends_sha256 for r in prefix_trie.list_digests(df, ["k"], "v").collect()}
    assert got == {k: hashlib.sha256(",".join(str(v) for v in sorted(v for q, v in rows if q == k)).encode()).hexdigest() for k in range(4)}


# --- fill in the middle -----------------------------------------------------------------------


def brute_middle(i, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_middles_by_brute_force(spark):
    rng = random.Random(8)
    pieces = ["a", "<", "P", ">", "<P", "M>", "é", "中", "😀", "\n", "\x00", " and so on ", "<S"]
    rows = awkward() + [(1000 + i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(2000 + i, "é" * i) for i in range(20)] + [(3000 + i, f"a <{m}> b 😀") for i, m in enumerate("PSM")]
    docs = table(spark, rows)
    made = fill_middle.fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = [brute_middle(i, t) for i, t in rows]
    assert ordered(map(tuple, made.collect())) == ordered(want)
    assert len({w[2] for w in want}) == 3
    back = made.select("doc_id", fill_middle.restored(made.output, made.form).alias("text")).collect()
    assert ordered((r.doc_id, r.text) for r in back) == ordered((i, t or "") for i, t in rows)
    told = fill_middle.report(docs).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert ordered((r.doc_id, r.output_sha256, r.restored_sha256) for r in told) == ordered(
        (w[0], digest(w[5]), digest(t or "")) for w, (_, t) in zip(want, rows, strict=True))
    assert fill_middle.report(docs.limit(0)).count() == 0


def test_sparse_index():
    text = "ab" + "é" * 3 + "x中y😀z" + "plain" * 4 + "é"
    data = text.encode()
    index = fill_middle.CharIndex(np.frombuffer(data, np.uint8))
    places = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
    assert (index.byte_at(np.arange(len(text) + 1)) == places).all()
    assert (index.char_at(places) == np.arange(len(text) + 1)).all()
