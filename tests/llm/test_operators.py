"""The operators against brute force on small tables with nulls, empties, ties, repeated rows, long texts and extra columns."""

import base64
import bz2
import collections
import gzip
import hashlib
import itertools
import random
import re
import time
import tracemalloc
import urllib.parse
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.llm import decontamination, html_extraction, local_descriptors, mixing, near_duplicates, pii, quality, queries, repeats, secrets, shared, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id string, id long, root long, key string"


def make_texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(150)] + ["Der", "der", "ÄB", "a1", "zz!"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(60)
    texts = [None, "", "   \n", "one", "one two three four", say(13), passage, passage, f"{say(30)}\n{passage} {say(20)}", f"{say(40)} {passage}", say(3000), "same " * 400]
    base = say(200).split()
    for i in range(12):
        x = list(base)
        x[i * 3] = f"edit{i}"
        texts.append(" ".join(x))
    texts += [say(rng.randint(5, 80)) for _ in range(40)]
    # words of up to 1,000 bytes, made of the same blocks in another order
    x, y = "x" * 64, "y" * 63 + "z"
    tail = say(12)
    texts += [f"{w} {tail}" for w in (x + y + y + x, y + x + x + y, x + x + y + y, (x + y) * 7, (y + x) * 7, "é" * 500, "é" * 499 + "e")]
    return texts, passage


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", ["b", "a", None, "c"][i % 4 if i % 3 else 0], 0, "x", -1, -2, "k") for i, t in enumerate(texts[0])]
    rows.append(rows[8])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bench_words(t):
    return WORD.findall((t or "").translate(LOWER))


def test_decontamination(spark, docs, texts, empty):
    rows, passage = texts
    items = spark.createDataFrame([("10", passage), ("9", " ".join(passage.split()[20:40]).upper()), ("8", "one"), ("7", None), ("6", "!!"), ("8", "one")], "item_id string, text string")
    got = {r.doc_id: r for r in decontamination.contamination(docs, items).collect()}
    windows = collections.defaultdict(set)
    for r in items.collect():
        w = bench_words(r.text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(r.item_id)
    for i, t in enumerate(rows):
        w, hit, found = bench_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        g = got[i]
        assert (g.n_words, g.n_hit, g["items"], g.contaminated) == (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
        terms = [(r.item_id, set(bench_words(r.text))) for r in items.collect()]
        near = {n for n, t in terms if t and any(t <= set(w[k : k + len(t) + 5]) for k in range(len(w)))}
        assert g.n_near == len(near)
    assert decontamination.contamination(empty, items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_keeps_rows_apart(spark):
    """Null ids, different texts under one id, repeated rows, and columns with dots."""
    words = [f"w{i}" for i in range(13)]
    halves = [" ".join(words[:6] + ["x"] * 7), " ".join(["y"] * 6 + words[6:])]
    rows = [(1, halves[0]), (1, halves[1]), (None, " ".join(words)), (None, "other"), (3, "a " + " ".join(words)), (3, "a " + " ".join(words)), (None, None)]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, `a.b` int, row int")
    items = spark.createDataFrame([(None, "w0 w1"), ("i", " ".join(words))], "item_id string, text string")
    got = decontamination.contamination(docs, items.where("item_id is not null")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in got) == [(0, 0, 0, False), (0, 1, 0, False), (0, 13, 13, True), (1, 13, 0, False), (1, 13, 0, False), (3, 14, 13, True), (3, 14, 13, True)]
    kept = decontamination.clean_docs(docs, items.where("item_id is not null"))
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in rows if not t or "w0 w1 w2 w3 w4 w5 w6" not in t)
    assert decontamination.contamination(docs, items).where("n_hit > 0").count() == 4


def test_mixing(docs, texts, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts[0]) + 1
    total = sum(r.size for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert sum(d["words"] for d in r.draws) <= 3 * r.size
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    sizes = {s: sum(r.size for r in by[s]) for s in order}
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, left = {}, list(order), float(total)
    while True:
        rate = left / sum(weight[s] for s in free)
        over = [s for s in free if rate * weight[s] > 3 * sizes[s]]
        if not over:
            target |= {s: rate * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    for s in order:
        assert by[s][0].target == pytest.approx(target[s]) and by[s][0].source_size == sizes[s]
        assert abs(sum(d["words"] for r in by[s] for d in r.draws) - target[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0


def test_split_tree_is_exact(spark):
    counts = spark.createDataFrame([("a", 1000), ("b", 500), (None, 7), ("c", 1)], "source string, n long")
    rows = mixing.split_tree(counts, 8, 3, shared.Scratch(spark, "t")).collect()
    per, shard = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.quota >= 0
        per[r.source] += r.quota
        shard[r.shard] += r.quota
    assert per == {"a": 1000, "b": 500, None: 7, "c": 1} and max(shard.values()) - min(shard.values()) <= 1


def test_split_tree_against_drawing_blocks(spark):
    """Over many seeds, a shard's part of a source has the mean and variance of blocks drawn without replacement."""
    n = {"a": 60, "b": 30, "c": 10}
    counts = spark.createDataFrame(list(n.items()), "source string, n long")
    got = collections.defaultdict(list)
    for seed in range(4):
        for r in mixing.split_tree(counts, 4, seed, shared.Scratch(spark, "t")).collect():
            got[r.source].append(r.quota)
    rng = random.Random(1)
    want = collections.defaultdict(list)
    for _ in range(400):
        blocks = [s for s, k in n.items() for _ in range(k)]
        rng.shuffle(blocks)
        for i in range(4):
            part = collections.Counter(blocks[i * 25 : (i + 1) * 25])
            for s in n:
                want[s].append(part[s])
    for s, k in n.items():
        assert np.mean(got[s]) == k / 4
        assert 0.3 * np.var(want[s]) < np.var(got[s]) < 3 * np.var(want[s])


def test_mixing_of_many_sources(spark):
    """More sources than groups; every block has one shard, and shards are alike in size."""
    rows = [(i, f"host{i % 700}", "w " * (i % 5 + 1)) for i in range(2100)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    shards = collections.Counter()
    per = collections.defaultdict(int)
    for r in got:
        for d in r.draws:
            shards[d["shard"]] += 1
            per[r.source] += d["words"]
    assert all(abs(per[r.source] - r.target) <= 1 for r in got)
    assert len(shards) == 16 and max(shards.values()) < 1.5 * min(shards.values())


def test_hypergeometric_law(spark):
    n = 20_000
    got = spark.range(n).select(mixing.hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(25).cast("long"), (F.col("id") + 0.5) / n).alias("x")).agg(F.avg("x"), F.variance("x")).first()
    assert got[0] == pytest.approx(10, abs=0.02) and got[1] == pytest.approx(25 * 0.4 * 0.6 * 25 / 49, abs=0.05)


def test_near_duplicates(docs, texts, empty):
    rows = texts[0]
    got = {r.doc_id: r for r in near_duplicates.join(docs).collect()}
    sets = [set(zip(*[w[i:] for i in range(5)], strict=False)) or ({tuple(w)} if w else set()) for w in ((t or "").split() for t in rows)]
    where = list(range(len(rows))) + [8]
    for i, a in enumerate(sets):
        links = [j for j in where if a and len(a & sets[j]) >= 0.8 * len(a | sets[j])]
        assert got[i].n_links == max(len(links) - 1, 0)
        assert got[i].class_id == (min(links) if len(links) > 1 else i)
    kept = near_duplicates.first_docs(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i in got if got[i].class_id == i)
    assert near_duplicates.join(empty).count() == 0


def test_near_duplicates_keep_rows_apart(spark):
    """Null ids, two texts under one id, repeated rows, columns with dots; classes without any id."""
    x, y = [" ".join(f"{c}{i}" for i in range(60)) for c in "xy"]
    rows = [(5, x), (5, y), (None, x + " more"), (2, y + " more"), (None, "alone here is a text"), (None, "alone here is a text"), (9, None), (9, None), (8, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, `a.b` int")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in near_duplicates.join(df).collect())
    assert got == [(0, 0, 1), (0, 0, 1), (0, 5, 1), (2, 2, 1), (5, 2, 1), (5, 5, 1), (8, 8, 0), (9, 9, 0), (9, 9, 0)]
    kept = near_duplicates.first_docs(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "alone here is a text"), (2, y + " more"), (5, x), (8, ""), (9, "")]


def test_forest_recall(spark):
    """Every chain of edits around the threshold, against brute force; prefixes are shortened as far as the recall asks."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(20, 120))]
        for edits in (0, 1, 1, 2, 3):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    got = {r.doc_id: r.n_links for r in near_duplicates.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(want) > 200
    assert near_duplicates.shortest_prefix() == 5 and near_duplicates.shortest_prefix(recall=0.99) == 7


def test_repeats(docs, texts, empty):
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    words = [(t or "").split() for t in texts[0]]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_files(spark, docs, tmp_path, monkeypatch):
    """However many partitions there are, the tables have files by the input's size and none for checksums, and the session's settings stay."""
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "docs"))
    want, files, left, keep = sorted(map(str, repeats.remove_repeats(docs).collect())), [], [], shared.Scratch.keep

    def kept(self, *a, **k):
        out = keep(self, *a, **k)
        files.append(len(out.inputFiles()))
        crc = [f for f in Path(self.paths[id(out)].removeprefix("file:")).iterdir() if f.suffix == ".crc"]
        left.append((crc, spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")))
        return out

    monkeypatch.setattr(shared.Scratch, "keep", kept)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": "1k"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = repeats.remove_repeats(spark.read.parquet(str(tmp_path / "docs")))
        assert sorted(map(str, got.collect())) == want
        assert got.rdd.getNumPartitions() <= 8 and max(files) <= 8 and len(files) == 5
        assert left == [([], "false")] * 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_near_duplicates_files(spark, docs, tmp_path, monkeypatch):
    """However many partitions there are, tables and results have files by the input's size, and no table has files beside its parts."""
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "docs"))
    want, first = (sorted(map(str, f(docs.select("doc_id", "text")).collect())) for f in (near_duplicates.join, near_duplicates.first_docs))
    files, beside, keep = [], [], shared.Scratch.keep

    def kept(self, *a, **k):
        out = keep(self, *a, **k)
        files.append(len(out.inputFiles()))
        beside.extend(f.name for f in Path(self.paths[id(out)].removeprefix("file:")).iterdir() if not f.name.startswith("part-"))
        return out

    monkeypatch.setattr(shared.Scratch, "keep", kept)
    settings = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": "1k"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for f, rows in ((near_duplicates.join, want), (near_duplicates.first_docs, first)):
            got = f(spark.read.parquet(str(tmp_path / "docs")))
            assert sorted(map(str, got.collect())) == rows
            assert got.rdd.getNumPartitions() <= 8
        assert files and max(files) <= 8 and beside == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_word_hashes():
    rng = random.Random(2)
    blocks = ["".join(rng.choice("ab") for _ in range(64)) for _ in range(4)]
    words = ["".join(w) for n in (2, 3, 4, 5) for w in itertools.product(blocks, repeat=n)] + ["x" * n for n in range(1, 1000)]
    assert len({int(h) for h in shared.word_hashes(" ".join(words).encode())[0]}) == len(set(words))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = shared.connected(shared.Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    assert all(root(r.id) == r.root for r in got.collect())


def labelled(spark):
    rng = random.Random(8)
    rows, labels = [(100_000, None), (100_001, "")], [(100_000, 1), (100_001, 0), (7, None), (999_999, 1)]
    for i in range(900):
        toxic = i % 6 == 0
        w = ["".join(rng.choice(("th", "an", "er", "on", "de", "ing")) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 60))]
        if toxic:
            for bad in rng.sample(("grumbus", "grumbold", "vexwit", "vexling"), 3):
                w.insert(rng.randrange(len(w)), bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels


def test_toxicity(spark, empty):
    docs, labels = labelled(spark)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, y in labels if i in got and i % 4 == 2 and i < 1000]
    assert all((s >= 0.3) == bool(y) for s, y in held)
    assert all(0 <= s <= 1 for s in got.values())
    none = toxicity.train(docs, marks.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.bucket("^^éab") == spark.range(1).select(toxicity.bucket_of(F.lit("^^éab"))).first()[0]


def test_corpus_grams_memory(monkeypatch):
    """Many words that share their n-grams: what a worker holds is the words, not the n-grams of all of them at once."""
    words = ["".join(w) for w in itertools.product("abcd", repeat=8)]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words[i : i + 256]) for i in range(0, len(words), 256)] + [None, "", "A é_b"])], ["text"])
    want = set(itertools.chain.from_iterable(map(toxicity.grams, [*words, "a", "é", "b"])))
    tracemalloc.start()
    try:
        found = [x.column(0).to_pylist() for x in toxicity.corpus_grams(iter([batch]))]
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()
    assert len(found) == 1 and sorted(found[0]) == sorted(want)
    monkeypatch.setattr(toxicity, "CACHE", 100)  # words that are forgotten are spelt again
    assert {g for x in toxicity.corpus_grams(iter([batch, batch])) for g in x.column(0).to_pylist()} == want


def test_quality(spark):
    docs, labels = labelled(spark)
    rows = [(r.doc_id, r.text.upper().replace(" ", "!! ") if r.text and r.doc_id % 5 == 1 else r.text) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 5 != 1)) for i, _ in rows if i < 1000], "doc_id long, quality int")
    model = quality.train(docs, marks, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 5 != 1) for i in got if i % 3 == 0 and i < 1000)
    assert all(0 <= s <= 1 for s in got.values())


def test_secrets(spark, docs, empty):
    plain = "password = hunter2hunter2"
    packed = base64.b64encode(gzip.compress(plain.encode())).decode()
    cases = [urllib.parse.quote(plain), packed, base64.b64encode(packed.encode()).decode(), base64.b64encode(zlib.compress(plain.encode())).decode(), "".join(f"\\u{ord(c):04x}" for c in plain), urllib.parse.quote(urllib.parse.quote(plain))]
    for c in cases:
        base, every, _ = secrets.scan("é " + c)
        assert not base and ("assign" in secrets.joined(every)) and every[0][0] >= 2 and every[-1][2] <= len(c) + 2
    mixed = "Token: 'abcdefgh' AKIA123 AKIA" + "Z" * 12 + " " + "0f" * 16 + " ſecret=abcdefghij api-key=abcdefghij"
    assert secrets.joined(secrets.scan(mixed)[0]) == "assign:0:16,access:26:42,hex:43:75"
    assert secrets.scan(None)[0] == [] and secrets.scan("%2525252525")[1] == []
    assert "hunter" not in secrets.masked(f"a {plain} b") and secrets.masked(None) is None
    got = secrets.scan_docs(docs)
    assert got.count() == docs.count() and secrets.scan_docs(empty).count() == 0
    assert secrets.mask_docs(docs).columns == docs.columns


def test_secrets_in_repeated_parts():
    part = base64.b64encode(b"password=hunter2hunter2").decode()
    packed = base64.b64encode(gzip.compress(part.encode(), mtime=0)).decode()
    for p in (part, part.encode().hex(), packed, packed.encode().hex()):
        text = f"a {p} b {p} c {p}"
        assert p not in secrets.masked(text) and secrets.masked(text).count("[SECRET]") == 3
    # a part that also stands within another one
    assert secrets.masked(f"{packed} and {part}") == secrets.masked(f"{part} and {packed}") == "[SECRET] and [SECRET]"


def test_secrets_in_nested_streams():
    plain = b"see password=hunter2hunter2 end"
    member = lambda x: gzip.compress(x, mtime=0)
    cases = [member(member(plain)), zlib.compress(bz2.compress(member(plain))), member(b"first ") + member(plain), bz2.compress(b"first ") + bz2.compress(plain), member(plain[:12]) + member(plain[12:])]
    # beyond MOST_GROWTH, cut within a character before, as well as a stream within
    cases += [member("é".encode() * 9_000_000 + b"x" + plain), member(b" " * (secrets.MOST_GROWTH - 12) + plain), zlib.compress(member(b"-. " * 7_000_000 + plain))]
    for data in cases:
        text = base64.b64encode(data).decode()
        assert secrets.masked(f"a {text} b") == "a [SECRET] b"
    # pieces of a long stretch lose nothing where they meet
    for n in range(-40, 3):
        long = b"a," * (secrets.MOST_GROWTH // 2) + b"a" * 50
        at = secrets.MOST_GROWTH + n
        if n % 13 == 0:
            assert any("password=hunter2hunter2" in x for x in secrets._texts(long[:at] + b" password=hunter2hunter2 " + long[at:]))


def test_secrets_in_chains_of_escapes():
    plain = "password=hunter2hunter2"
    for depth in range(1, 12):
        for wrap in (urllib.parse.quote, lambda x: "".join(f"\\x{ord(c):02x}" for c in x), lambda x: x.replace("%", "%25").replace("=", "%3D"), lambda x: x.replace("\\", "\\u005c").replace("=", "\\u003d"), lambda x: x.replace("&", "&#38;").replace("=", "&#61;")):
            text = plain
            for _ in range(depth if len(text) < 20_000 else 0):
                if len(text) < 20_000:
                    text = wrap(text)
            if text != plain:
                base, every, _ = secrets.scan(f"é {text} z")
                assert any(k == 0 and a >= 2 and b <= len(text) + 2 for a, k, b in every), (depth, text[:80])
    for chain in ("%" + "25" * 100_000 + "41", "\\x5c" + "x5c" * 60_000, "%5C" + "x255C" * 40_000, "&#38;" + "#38;" * 50_000, "%25" * 60_000):
        began = time.perf_counter()
        secrets.scan(chain)
        assert time.perf_counter() - began < 8
    for wide in ("utf-16-le", "utf-16-be", "utf-16", "latin-1"):
        data = f"see {plain} end é".encode(wide)
        for part in (base64.b64encode(data).decode(), data.hex(), base64.b64encode(gzip.compress(data, mtime=0)).decode()):
            assert secrets.masked(f"a {part} b").replace("//[", "[") == "a [SECRET] b", (wide, part)  # "//" begins a byte order mark


def test_secrets_against_a_plain_decoder():
    """Generated nestings: what is wrapped is found, at the place of its wrapping, and nothing else is."""
    rng = random.Random(11)
    steps = [urllib.parse.quote, lambda x: base64.b64encode(x.encode()).decode(), lambda x: x.encode().hex(), lambda x: base64.b64encode(gzip.compress(x.encode(), mtime=0)).decode(), lambda x: base64.b64encode(bz2.compress(x.encode())).decode(), lambda x: "".join(f"\\u{ord(c):04x}" for c in x)]
    for n in range(150):
        secret = rng.random() < 0.6
        text = f"id {n} password=hunter2hunter2 {rng.random()}" if secret else f"id {n} nothing to be seen {rng.random()}"
        for _ in range(rng.randint(1, 4)):
            text = rng.choice(steps)(text) if len(text) < 5000 else text
        every = [(a, b) for a, k, b in secrets.scan(f"before {text} after")[1] if k == 0]
        assert bool(every) == secret and all(a >= 7 and b <= 7 + len(text) for a, b in every), text[:100]


def test_secrets_in_wrapped_and_foreign_runs():
    plain = b"see password=hunter2hunter2 and so on, \xc3\xa9"
    for data in (plain, gzip.compress(plain, mtime=0), plain * 5):
        part = base64.b64encode(data).decode().rstrip("=")
        for before in ("host/cb/", "key-", "id_", "k/", "xyz_"):
            assert secrets.masked(f"a {before}{part} b") == f"a {before}[SECRET] b"
        for before in ("abc", "a-b/c_"):
            assert part not in secrets.masked(f"a {before}{part} b")
    rng = random.Random(3)
    long = "".join(rng.choice("abc def") for _ in range(300)).encode()
    for data in (long[:44] + b" password=hunter2hunter2 " + long, gzip.compress(rng.randbytes(300) + plain, mtime=0), zlib.compress(rng.randbytes(99) + plain)):
        part = base64.b64encode(data).decode()
        for width in (10, 64, 76):
            for br in ("\n", "\r\n", "\n  "):
                lines = [part[i : i + width] for i in range(0, len(part), width)]
                text = f"Begin{br}" + br.join(lines) + f"{br}. End"
                got = [(a, b) for a, k, b in secrets.scan(text)[1] if k == 0]
                assert got and secrets.masked(text).startswith("Begin") and secrets.masked(text).endswith(". End")
                if data[0] > 100 or data[0] < 32:
                    assert not any(x in secrets.masked(text) for x in lines if len(x) > 4)
    # over lines, what one line holds is that line's
    one = base64.b64encode(b"password=hunter2hunter2!").decode()
    assert secrets.masked(f"{one}\n{one}") == "[SECRET]\n[SECRET]"


def test_html(spark):
    fitted = html_extraction.models()
    rng = random.Random(123)
    for _ in range(60):
        source, labels = html_extraction.made_page(rng)
        page = html_extraction.Page(source)
        want = "\n\n".join(t for e, t, _ in page.blocks if labels[e - 1] != "0")
        assert html_extraction.extract_all([source], fitted) == [want]
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "</p><b>x"), (None, "u", "<p>" * 300 + "a&amp;b &nbsp; c")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.extract(odd).collect()}
    assert got[1] == got[2] == "" and len(got) == 4


def test_html_without_end_tags():
    blocks = lambda x: [t for _, t, _ in html_extraction.Page(x).blocks]
    body = "<body><article><p>one</p><p>two</p></article>"
    for head in ("<head><title>x</title>", "<head><meta name=a><script>if (a) '<p>'</script><title>x", "<head><title>x</title><noscript><style>b</style></noscript> <link rel=a>", "<head><title>x</title>stray</head>"):
        assert blocks(f"<!DOCTYPE html><html>{head}{body}") == ["one", "two"]
        assert blocks(f"<html>{head}<p>three{body}")[0] == "three"
    assert blocks("<head><title>x</title>only text") == ["only text"]
    for raw in ("object data=x", "iframe src=x", "select", "svg", "video", "canvas", "textarea", "noscript", "title", "template"):
        tag = raw.split()[0]
        for after in ("", f"<p><{raw}>c</{tag}></p>"):
            assert blocks(f"<article><div>a<{raw}>b</div><p>one</p><p>two</p>{after}</article><p>three") == ["a", "one", "two", "three"]
            assert blocks(f"<article><p>a<{raw}>b<p>one</p>{after}</article>three") == ["a", "one", "three"]
            assert blocks(f"<ul><li>a<{raw}>b<li>one</ul>{after}two") == ["a", "one", "two"]
        assert blocks(f"<div>a<{raw}>b</{tag}>c</div>d") == ["a c", "d"]
    assert blocks("<div>a<object><object>b</object>c</object>d</div>") == ["a d"]
    assert blocks("a<script>b<p>c</p>") == ["a"]


def test_labels_do_not_contradict():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = 30
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        label = html_extraction.decode(parent, rng.normal(0, 3, n), rng.normal(0, 3, n))
        for e in range(1, n):
            up = label[parent[e]]
            assert up != html_extraction.CLUTTER or label[e] == html_extraction.CLUTTER
            assert up != html_extraction.MAIN or label[e] != html_extraction.MIXED


def test_pii(spark, docs, empty):
    text = "Call +1 (017) 555-7713, +1 017-555-7713, Joe.Doe34@mail7.example.com joe.doe34@MAIL7.example.com 97.51.17.173 192.168.3.4 4111 1111 1111 1111 Mr. Smith met Maria Lopez."
    new = pii.replaced(text)
    for old in ("555-7713", "doe34", "97.51", "4111", "Smith", "Maria"):
        assert old.lower() not in new.lower()
    digits = ["".join(re.findall(r"\d", x)) for x in re.findall(r"\+[\d ()-]+", new)]
    assert digits[0] == digits[1] and "192.168." in new
    assert pii.luhn("".join(re.findall(r"\d", new.split("192.168.")[1].split(" ", 1)[1][:19])))
    assert next(m for m in re.findall(r"met (\w+)", new)) in pii.NAMES[("latin", "f")]
    assert len({pii.surrogate("card", f"{i:014d}") for i in range(3000)}) == 3000
    assert pii.replaced(None) is None
    rows = [(i, f"Mr. Zed{chr(97 + i % 26)}{chr(97 + i // 26)}q was here") for i in range(120)]
    got = pii.replace_docs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.text for r in got}) == 120  # names from short lists stay distinct
    assert pii.replace_docs(docs).count() == docs.count() and pii.replace_docs(empty).count() == 0


def test_pii_finds_and_leaves():
    kinds = lambda t: [k for _, _, k, _ in pii.find(t)]
    for text in ("on 2024-05-06 and 06.05.2024 or 5/6/2024", "10 20 30 40", "order 1234 5678 12", "version 1.2.3", "at 12:30:45", "Dear Sir or Madam"):
        assert kinds(text) == [], text
    for text, want in (("call 555-0100 now", ["phone"]), ("+442071838750", ["phone"]), ("(020) 7183 8750", ["phone"]), ("at fe80::1ff:fe23:4567:890a.", ["ipv6"]), ("José García", ["name"] * 2), ("Priya Sharma", ["name"] * 2), ("Mr. O'Brien", ["name"]), ("Contact: 王小明", ["name"]), ("MR. SMITH", []), ("Mr. SMITH", ["name"])):
        assert kinds(text) == want, text
    assert pii.replaced("+442071838750").startswith("+44") and pii.replaced("+1 415 555 0100").startswith("+1 ")
    assert pii.replaced("+49 171 2345678").replace(" ", "") == pii.replaced("+491712345678")
    assert pii.replaced("Mr. Smith, Mr. SMITH") == (lambda x: f"Mr. {x}, Mr. {x.upper()}")(pii.surrogate("name", "Smith"))


def test_pii_against_originals(spark):
    """No surrogate of a family name, phone or address is an original anywhere; rows without an id are told their rounds."""
    first = pii.surrogate("name", "Zedaq")
    rows = [(None, "Mr. Zedaq and"), (1, f"Mr. {first} came"), (None, f"Mr. {pii.surrogate('name', first)} left"), (None, None), (2, "Mr. Zedaq again")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n_entities int, entity_kinds string, `a.b` int")
    out = pii.replace_docs(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    got = out.collect()
    names = {r.text.split()[1] for r in got if r.text}
    assert len(names) == 3 and not names & {"Zedaq", first, pii.surrogate("name", first)}
    assert len({r.text.split()[1] for r in got if r.text and r.text.split()[-1] in ("and", "again")}) == 1
    assert {r.n_entities for r in got} == {0, 1}


def test_pii_surrogates_are_permutations():
    """Brute force over whole forms: every value has its own surrogate of the same form."""
    for values in ([a + b + c for a in "BCDF" for b in "aeiou" for c in "bcdfgh"], ["Ab" + a + b for a in "aeiou" for b in "bcdfghjklmnpqrstvwxyz"], ["王" + chr(0x4E00 + i) for i in range(500)], ["Иван" + a + b for a in "аеиоу" for b in "бвгд"]):
        new = [pii.surrogate("name", v) for v in values]
        assert len(set(new)) == len(values) and all(len(n) == len(v) and n[0].isupper() == v[0].isupper() for n, v in zip(new, values, strict=True))
    for kind, values in (("phone", [f"{i:05d}" for i in range(3000)]), ("ssn", [f"123{i:06d}" for i in range(1, 3000, 7)]), ("ip", [f"10.0.{i}.{j}" for i in range(30) for j in range(30)])):
        assert len({pii.surrogate(kind, v) for v in values}) == len(values)


def grey(x):
    return np.ascontiguousarray(np.clip(np.rint(x), 0, 255).astype(np.uint8))


def texture(rng):
    """A grey picture with detail at several scales."""
    n = int(rng.integers(60, 100))
    x = sum(local_descriptors.scaled(rng.normal(0, 1, (k, k)), (n + k) / k)[:n, :n] * k**-0.5 for k in (4, 8, 16))
    return 255 * (x - x.min()) / (x.max() - x.min())


def image_rows(images):
    return [(i, x.shape[1], x.shape[0], bytearray(x.tobytes())) for i, x in images.items()]


IMAGES = "id long, width int, height int, pixels binary"


def test_images(spark):
    rng = np.random.default_rng(5)
    images = dict(enumerate(grey(local_descriptors.scaled(rng.integers(0, 255, (8, 8)).astype(float), 8)) for _ in range(20)))
    edited = {100: grey(images[3] * 0.8 + 20), 101: grey(images[4][6:, 4:60]), 102: grey(np.rot90(images[5])), 103: images[6], 104: images[6]}
    flat = {202: np.zeros((64, 64), np.uint8), 203: np.zeros((64, 64), np.uint8)}
    rows = image_rows(images | edited | flat) + [(200, 5, 5, None), (201, 9, 9, bytearray(b"x")), (None, None, None, None), (None, 3, 3, bytearray(9))]
    df = spark.createDataFrame(rows, IMAGES).withColumn("image", F.lit(1)).withColumn("a.b", F.lit(2))
    got = {(r.query_id, r.match_id) for r in local_descriptors.search(F.col("id") >= 100, df).collect()}
    assert got == {(100, 3), (101, 4), (102, 5)}
    every = [r for r in local_descriptors.matched(F.col("id") >= 100, df).collect() if r.id is not None]
    assert len(every) == len(rows) - 2
    by = {r.id: r for r in every}
    assert [(by[i].class_id, by[i].n_matches) for i in (6, 103, 104, 202, 203, 200, 201)] == [(6, 2), (6, 1), (6, 1), (202, 1), (202, 1), (200, 0), (201, 0)]
    assert [m.class_id for m in by[3].matches] == [100] and by[3].n_matches == 1 and by[100].n_matches == 0
    # repeated rows are equal images
    twice = local_descriptors.matched(F.col("id") == 103, df.union(df.where("id = 103"))).where("id = 103").collect()
    assert len(twice) == 2 and {r.n_matches for r in twice} == {1}
    assert local_descriptors.matched(F.col("id") >= 100, df.limit(0)).count() == 0


def test_images_against_brute_force(spark):
    """All pairs compared whole, on textures with edits; recall by edit."""
    rng = np.random.default_rng(9)
    edits = {
        "crop to 56 %": lambda x: x[x.shape[0] // 4 :, : x.shape[1] * 3 // 4],
        "crop to 36 %": lambda x: x[x.shape[0] // 5 : x.shape[0] * 4 // 5, x.shape[1] // 5 : x.shape[1] * 4 // 5],
        "turn": lambda x: np.rot90(x),
        "larger": lambda x: local_descriptors.scaled(x, 1.4),
        "smaller": lambda x: local_descriptors.scaled(x, 0.8),
        "brightness": lambda x: x * 0.7 + 30,
        "noise": lambda x: x + rng.normal(0, 4, x.shape),
    }
    base = [texture(rng) for _ in range(12)]
    images = {i: grey(x) for i, x in enumerate(base)} | {100 * (k + 1) + i: grey(e(x)) for k, e in enumerate(edits.values()) for i, x in enumerate(base)}
    points = {i: local_descriptors.describe(x) for i, x in images.items()}
    asked = [i for i in images if i < 100]
    want = {(q, i) for q in asked for i in images if i != q and local_descriptors.inliers(points[q], points[i]) >= local_descriptors.LEAST}
    got = {(r.query_id, r.match_id) for r in local_descriptors.search(F.col("id") < 100, spark.createDataFrame(image_rows(images), IMAGES)).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    assert all(q == i % 100 for q, i in got)  # no false pair
    for k, name in enumerate(edits):
        assert sum((i, 100 * (k + 1) + i) in got for i in range(12)) >= 11, name


def test_images_in_blocks(spark, monkeypatch):
    """However small the blocks and parts: all pairs that share SEEDS keys and agree, and no row for a shared key."""
    rng = np.random.default_rng(3)
    base = {i: grey(local_descriptors.scaled(rng.integers(0, 255, (6, 6)).astype(float), 8)) for i in range(60)}
    images = base | {100 + i: grey(base[i] * 0.8 + 20) for i in range(0, 60, 3)} | {200: np.zeros((48, 48), np.uint8)}
    points = {i: local_descriptors.describe(x) for i, x in images.items()}
    keys = {i: set(local_descriptors.keys_of(p).tolist()) for i, p in points.items()}
    want = {(q, i, n) for q in images if q % 5 == 0 for i in images if q != i and len(keys[q] & keys[i]) >= local_descriptors.SEEDS and (n := local_descriptors.inliers(points[q], points[i])) >= local_descriptors.LEAST}
    assert len(want) >= 8
    plans, keep = [], shared.Scratch.keep
    monkeypatch.setattr(shared.Scratch, "keep", lambda self, df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(self, df, *a))
    df = spark.createDataFrame(image_rows(images), IMAGES)
    for block, part in ((16 << 20, 4 << 20), (20_000, 40_000)):
        monkeypatch.setattr(local_descriptors, "BLOCK", block)
        monkeypatch.setattr(local_descriptors, "PART", part)
        assert {tuple(r) for r in local_descriptors.search(F.col("id") % 5 == 0, df).collect()} == want
    assert not [p for p in plans if re.search(r"\bkey#", p)]
    assert local_descriptors.search(F.col("id") == -1, df).count() == 0


def test_drawn_images(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0, 1.0, 0.25, 0.1]), (2, None), (3, []), (4, [None, 1.0]), (5, [0.0] * 4)], "vec_id long, embedding array<double>")
    got = {r.id: r for r in local_descriptors.drawn(df).collect()}
    assert (got[1].width, got[2].width, got[3].width, got[4].width, got[5].width) == (24, 0, 0, 16, 16)
    assert len(got[1].pixels) == 576 and got[5].pixels == bytes(256)


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.queries()) == list(range(1, 11))
