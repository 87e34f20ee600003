import gzip
import hashlib
import random

import corpus_pipeline
import numpy as np
import pytest
from llm_rows import SCHEMA, awkward, table, words
from pyspark.sql import functions as F

from pairworks.llm import mixing, near_dedup, warc


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 3 else zip(w, w[1:], w[2:]))


def brute_components(rows):
    """component by row number, over rows (id, text)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        known = least.get(find(i))
        least[find(i)] = key if known is None else known if key is None else min(known, key)
    return [(key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)]


def edited(text, n, seed):
    rng, w = random.Random(seed), text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "".join(rng.choices("klmnop", k=6))
    return " ".join(w)


@pytest.mark.parametrize("small, block", [(64, 256), (4, 6)])
def test_near_duplicates_by_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    base, other = words(11, 120, ""), words(12, 90, "")
    rows = awkward() + [(100 + i, edited(base, i % 9, i)) for i in range(60)] + [(300 + i, edited(other, i % 4, i)) for i in range(25)]
    rows += [(400 + i, words(i, 50, "") + " the common passage that many of the documents share with each other") for i in range(30)]
    rows += [(500 + i, base) for i in range(10)]
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    want = brute_components(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(
        ((i, n, i if n == 0 else c) for i, n, c in want), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("n", [600, 1200])
def test_documents_that_share_a_passage_part(spark, monkeypatch, n):
    """Half of each text is the same passage: none of them is left to be compared in blocks, and links among them are found."""
    left = []
    compare = near_dedup._within_dense

    def counted(dense, *rest):
        left.append(dense.select("set_id").distinct().count())
        return compare(dense, *rest)

    monkeypatch.setattr(near_dedup, "_within_dense", counted)
    passage = words(5, 50, "")
    rows = [(i, f"{passage} {words(1000 + i, 50, f'{i}')}") for i in range(n)]
    rows += [(n + i, edited(rows[i][1], 1, i)) for i in range(40)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == {key: component for key, _, component in brute_components(rows[:40] + rows[n:])} | {i: i for i in range(40, n)}
    assert sum(left) < n // 10


def passages(n):
    passage = words(5, 50, "")
    rows = [(i, f"{passage} {words(1000 + i, 50, f'{i}')}") for i in range(n)]
    return rows + [(n + i, edited(rows[i][1], 1, i)) for i in range(20)]


def test_nodes_that_branch_on_are_not_stored_level_by_level(spark, monkeypatch):
    """Each table stored on the way is a stage of as many tasks as there are partitions."""
    labels = []
    monkeypatch.setattr(near_dedup, "materialise", lambda df, label, store=near_dedup.materialise: labels.append(label) or store(df, label))
    rows = passages(300)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == {key: component for key, _, component in brute_components(rows)}
    assert sum(label.startswith("path-") for label in labels) <= 2 and len(labels) <= 20


@pytest.mark.parametrize("whole", [4, 40])
def test_nodes_too_large_for_a_task_branch_on_level_by_level(spark, monkeypatch, whole):
    stored = []
    monkeypatch.setattr(near_dedup, "materialise", lambda df, label, store=near_dedup.materialise: stored.append(label) or store(df, label))
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "WHOLE", whole)
    base = words(11, 120, "")
    rows = passages(60) + [(300 + i, edited(base, i % 9, i)) for i in range(40)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == {key: component for key, _, component in brute_components(rows)}
    assert "path-labels" in stored and "path-alike" in stored


def test_nodes_below_are_the_same_in_a_task(spark):
    rng = np.random.default_rng(3)
    node, sig = rng.integers(-1 << 63, 1 << 63, 300), rng.integers(0, 1 << 32, (300, near_dedup.TOKENS), dtype=np.uint32)
    df = spark.createDataFrame([(int(x), i, s.tobytes()) for i, (x, s) in enumerate(zip(node, sig, strict=True))], "node long, i int, sig binary")
    want = near_dedup._branch(df, 30).select("i", "node").collect()
    at, below = near_dedup._branched(node.view(np.uint64), sig, 30)
    assert len(at) > 300
    assert sorted(zip(at.tolist(), below.view(np.int64).tolist(), strict=True)) == sorted((r.i, r.node) for r in want)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(table(spark, awkward()).limit(0)).count() == 0
    alone = near_dedup.near_duplicates(table(spark, [(4, None), (2, " ")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in alone) == [(2, 0, 2, True), (4, 0, 4, True)]


def test_one_row_of_each_group_stays(spark):
    rows = [(1, words(1, 40)), (1, words(1, 40)), (2, words(1, 40)), (3, words(3, 40)), (3, words(4, 40))]
    stay = near_dedup.one_of_each(table(spark, rows))
    assert sorted((r.doc_id, r.text) for r in stay.collect()) == sorted({(1, words(1, 40)), (3, words(3, 40)), (3, words(4, 40))})
    assert stay.columns == table(spark, rows).columns


def test_one_row_of_a_group_without_ids_or_with_one_id_stays(spark):
    long = [words(seed, 200) for seed in range(3)]
    rows = [(None, long[0]), (None, long[0] + " a"), (None, long[0] + " b"), (None, long[0]), (5, long[1]), (5, long[1] + " a"), (5, long[1] + " a"),
            (None, long[1] + " b"), (None, long[2]), (7, long[2] + " a"), (None, ""), (None, None), (None, ""), (8, "")]
    stay = [(r.doc_id, r.text) for r in near_dedup.one_of_each(table(spark, rows)).collect()]
    assert set(stay) <= set(rows) and len(stay) == len(set(stay)) == 6
    for text, ids in zip(long, ([None], [5], [7]), strict=True):
        assert [i for i, t in stay if t and t.startswith(text)] == ids
    assert {(None, ""), (None, None), (8, "")} <= set(stay)


def mixture(spark):
    sources = {"a": 40, "b": 3, "c": 25, None: 12, "é": 1}
    rows = [(k * 100 + i, words(i, 1 + i * 7 % 50), "en", s, 1, 0.1, 1, "t") for k, (s, n) in enumerate(sources.items()) for i in range(n)]
    rows += [(900, None, "en", "a", 1, 0.1, 1, "t"), (901, " ", "en", "c", 1, 0.1, 1, "t"), (None, "no id here", "en", "a", 1, 0.1, 1, "t"),
             (902, words(9, 5000), "en", "c", 1, 0.1, 1, "t"), (903, "", "en", "empty", 1, 0.1, 1, "t")]
    return rows + rows[:2]


def filled(sizes, weights):
    """Targets by sharing out again and again."""
    target, left, full = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set()
    while left > 1e-9:
        rest = [s for s in sizes if s not in full]
        unit = left / sum(weights[s] for s in rest)
        left = 0.0
        for s in rest:
            target[s] += unit * weights[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                full.add(s)
    return target


@pytest.mark.parametrize("block", [1, 7, 512])
def test_mixture(spark, block):
    rows = mixture(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, block_words=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), block_words=block).collect()))
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    order = sorted(s for s in sizes if s is not None) + [None]
    target = filled(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_schedule_takes_every_block_once_and_stays_even(spark):
    sources = spark.createDataFrame([(0, 600), (1, 300), (2, 100), (3, 0)], "source_no int, quota long")
    got = sorted(map(tuple, mixing.schedule(sources, 100, 10).collect()))
    assert sorted((s, b) for _, s, b in got) == [(s, b) for s, n in ((0, 60), (1, 30), (2, 10)) for b in range(n)]
    for n in (20, 50, 100):
        head = [s for slot, s, _ in got if slot < n]
        assert all(abs(head.count(s) - n * share) <= 4 for s, share in ((0, 0.6), (1, 0.3), (2, 0.1)))
    blocks = [(slot, b) for slot, s, b in got if s == 0]
    assert [b for _, b in blocks] == sorted(b for _, b in blocks)


def test_copies_are_what_is_taken(spark):
    docs = spark.createDataFrame(mixture(spark), SCHEMA)
    times = {}
    for r in mixing.copies(docs).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for r in mixing.mix(docs).filter("doc_id > 1").collect():
        assert times.get(r.doc_id, 0) == (-(-r.taken // r.size) if r.size else 0)


def test_any_stretch_of_the_mix_has_each_source_close_to_its_share(spark, tmp_path):
    rows = [(1000 * k + i, words(1000 * k + i, 20 + i % 50), "en", f"s{k}", 1, 0.1, 1, "t") for k, n in enumerate((600, 300, 900)) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    mixing.copies(docs, block_words=64).write.parquet(str(tmp_path / "mix"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # The files in their order, as they were written.
    files = sorted((tmp_path / "mix").glob("*.parquet"))
    mix = [r for f in files for r in spark.read.schema(SCHEMA).parquet(str(f)).coalesce(1).collect()]
    assert len(files) > 1
    size = [len(r.text.split()) for r in mix]
    target = {r.source: r.target for r in mixing.mix(docs, block_words=64).collect()}
    taken = dict.fromkeys(target, 0)
    for i, r in enumerate(mix):
        taken[r.source] += size[i]
        done = sum(taken.values())
        assert all(abs(taken[s] - done * target[s] / sum(target.values())) < 64 * 12 for s in taken)
    told = {r.doc_id: (r.first_slot, r.n_slots, r.taken) for r in mixing.mix(docs, block_words=64).collect()}
    assert all((slot is None) == (n == 0) == (words_ == 0) for slot, n, words_ in told.values())


def test_columns_of_any_name_come_through(spark, tmp_path):
    names = ["__id", "__times", "__copy", "__kept_tag", "__tag", "__before", "id", "tag", "times", "slots", "slot", "copy", "kept_id", "KEPT_TAG", "own_tag",
             "before", "parts", "base_spans", "all_spans", "_id", "group", "rows", "n", "score", "label", "round"]
    rows = [(1, words(1, 30)), (1, words(1, 30)), (2, words(2, 30) + " password=hunter22"), (3, words(2, 30) + " password=hunter22 more")]
    docs = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").withColumns({name: F.lit(f"own {name}") for name in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[name] == f"own {name}" for r in got for name in names)


def pages(spark):
    same, rng = "<p>same</p>" * 20, random.Random(3)
    rows = [(i, f"http://x/{i}", same if i % 3 == 0 else f"<p>{rng.random()}</p>" * rng.randint(0, 30), "t") for i in range(60)]
    rows += [(100, None, None, "t"), (101, "http://x/a b\r\nX: y", "", "t"), (102, "u", "short", "t"), (103, "v", "short", "t"),
             (None, "w", same, "t"), (0, "http://x/0", same, "t"), (104, "ü", "é\r\n\r\nWARC/1.1\r\n" * 50, "t"), (105, "z", "long " * 100_000, "t")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_archives_round_trip(spark):
    rows, table_ = pages(spark)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(table_.repartition(4)).collect())
    want, first = [], {}
    for i, _, html, _ in rows:
        if i is not None:
            first[html] = min(first.get(html, i), i)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and i != first[html]
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert warc.round_trip(table_.limit(0)).count() == 0


def test_conditions_reach_the_reader_and_payloads_stay_undecoded(spark, tmp_path, monkeypatch):
    rows, table_ = pages(spark)
    path = str(tmp_path / "archive")
    warc.write_archives(warc.records(table_), path)
    found = warc.read_archives(spark, path, payload=False).filter("record_type = 'revisit' AND page_id IN (3, 6, 7)")
    assert sorted((r.page_id, r.refers_to, r.payload) for r in found.collect()) == [(3, 0, None), (6, 0, None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "").replace("pushedFilters", "") or "IN" not in plan.split("BatchScan")[0]
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("page_id",), 3)])) == [GreaterThan(("page_id",), 3)]
    monkeypatch.setattr(warc.WarcReader, "_take_payload", lambda *a: pytest.fail("decoded"))
    inflated, read = [], warc.Member.read
    monkeypatch.setattr(warc.Member, "read", lambda self, n: inflated.append(read(self, n)) or inflated[-1])
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == found.sparkSession.read.format("warc").option(
        "payload", "false").load(path).filter("record_type = 'revisit'").count()
    # Of the page of 500,000 bytes no more than a header's share is inflated.
    assert 0 < sum(map(len, inflated)) < 4096 * len(rows)


def test_archives_of_several_writes(spark, tmp_path):
    _, table_ = pages(spark)
    path = str(tmp_path / "archive")
    ids = lambda: sorted(r.page_id for r in warc.read_archives(spark, path, payload=False).collect())
    one, two = (warc.records(table_.filter(f"page_id >= {a} AND page_id < {a + 10}").distinct()) for a in (10, 30))
    warc.write_archives(one, path)
    warc.write_archives(two, path, compress=False)
    assert ids() == [*range(10, 20), *range(30, 40)]
    broken = two.withColumn("target_uri", F.when(F.col("page_id") == 35, F.raise_error(F.lit("no"))).otherwise("x"))
    with pytest.raises(Exception, match="no"):
        warc.write_archives(broken, path)
    assert ids() == [*range(10, 20), *range(30, 40)]
    warc.write_archives(two, path, mode="overwrite")
    assert ids() == [*range(30, 40)]
    left = [f.name for f in (tmp_path / "archive").iterdir() if not f.name.startswith(".")]
    assert sum(name.startswith("_files-") for name in left) == 1 and not any(name.endswith(".warc") for name in left)


def test_payloads_are_the_html(spark, tmp_path):
    warc.write_archives(warc.records(spark.createDataFrame([(1, "u", "<p>é</p>")], "page_id long, url string, html string")),
                        str(tmp_path / "a"), compress=False)
    (file,) = (tmp_path / "a").glob("*.warc")
    data = file.read_bytes()
    length = int(data.split(b"Content-Length: ")[1].split(b"\r\n")[0])
    block = data.split(b"\r\n\r\n", 1)[1][:length]
    assert block.startswith(b"HTTP/1.1 200") and block.split(b"\r\n\r\n", 1)[1] == "<p>é</p>".encode()
    assert hashlib.sha256("<p>é</p>".encode()).hexdigest().encode() in data


@pytest.mark.parametrize("form", ["plain", "members", "told"])
def test_archives_made_elsewhere(spark, tmp_path, form):
    def made(fields, block):
        head = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "content-length": len(block)}.items())
        return f"WARC/1.0\r\n{head}\r\n".encode() + block + b"\r\n\r\n"

    records = [
        made({"WARC-Type": "warcinfo", "Content-Type": "application/warc-fields"}, b"software: x\r\n"),
        made({"warc-type": "response", "WARC-TARGET-URI": "http://a", "content-type": "application/http; msgtype=response",
              "WARC-Payload-Digest": "sha1:ABC"}, b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody" + b"z" * 5000),
        made({"WARC-Type": "metadata", "WARC-Record-ID": "<urn:1>"}, b""),
        made({"WARC-Type": "response", "Content-Type": "application/http"}, b"HTTP/1.0 204 No\r\n\r\n")]
    pack = {"plain": lambda r: r, "members": gzip.compress, "told": warc.member}[form]
    (tmp_path / ("a.warc" if form == "plain" else "a.warc.gz")).write_bytes(b"".join(map(pack, records)))
    (tmp_path / "notes.txt").write_text("no archive")
    read = warc.read_archives(spark, str(tmp_path))
    got = [(r.record_type, r.target_uri, r.record_id, r.payload_digest, r.payload_bytes, bytes(r.payload)) for r in read.collect()]
    assert got == [("warcinfo", None, None, None, 13, b"software: x\r\n"), ("response", "http://a", None, "sha1:ABC", 5004, b"body" + b"z" * 5000),
                   ("metadata", None, "<urn:1>", None, 0, b""), ("response", None, None, None, 0, b"")]
    heads = warc.read_archives(spark, str(tmp_path), payload=False).filter("record_type = 'response' AND page_id IS NULL")
    assert [(r.target_uri, r.payload) for r in heads.collect()] == [("http://a", None), (None, None)]


def test_files_of_unfinished_tasks_are_not_read(spark, tmp_path):
    _, table_ = pages(spark)
    path = tmp_path / "archive"
    warc.write_archives(warc.records(table_), str(path))
    n = warc.read_archives(spark, str(path)).count()
    (path / "left-behind.warc").write_bytes(b"WARC/1.1\r\nbroken")
    assert warc.read_archives(spark, str(path)).count() == n


def test_pipeline_by_brute_force(spark, tmp_path):
    rows = [(i, words(i, 60), "en", f"s{i % 3}", None, 0.1, 1, "t") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " x", "en", "s1", None, 0.1, 1, "t") for i in range(8)]
    rows += [(200, "", "en", "s0", 0, 0.1, 1, "t"), (201, "12 34", "en", "s0", 5, 0.1, 1, "t"),
             (202, words(77, 50) + " password=hunter22", "en", "s2", 1, 0.1, 1, "t")]
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [r for r in rows if r[0] not in (200, 201)]
    stay = {i for i, _, c in brute_components([(r[0], r[1]) for r in kept]) if i == c}
    clean = spark.createDataFrame([(r[0], r[1].replace("password=hunter22", "[secret]"), *r[2:]) for r in kept if r[0] in stay], SCHEMA)
    want = sorted(r.doc_id for r in mixing.copies(clean).collect())
    assert sorted(r.doc_id for r in final) == want
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in final)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "secrets", "mixture", "byte-level BPE"]


def test_stages_take_awkward_rows(spark, tmp_path):
    docs = table(spark, awkward()).select("doc_id", "text", "lang", "source", "n_chars").withColumn("extra", F.lit(1))
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, str(tmp_path))
            assert out.columns == some.columns
            out.count()
