import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docindex.llm import bpe, components, line_dedup, mixing, quality_mil, quality_rules, queries, sharding, simhash, toxicity, url_filter, winnow
from docindex.llm.shingles import WordHashes, shingles
from tests.compare import connection, rows_of_frame, rows_of_sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `row` string, id long, hash string, tid string, positions string, kept string, score string"


def docs(spark, rows):
    """Rows of (doc_id, text[, source[, lang]]), with columns that clash with names the operators use."""
    full = []
    for r in rows:
        i, text, source, lang = (*r, *("src", "en")[len(r) - 2 :]) if len(r) < 4 else r
        full.append((i, text, lang, source, len(text or ""), "r", 7, "h", "t", "p", "k", "s"))
    return spark.createDataFrame(full, DOCS)


def words(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))


LONG = " ".join(f"w{i % 997}" for i in range(30_000))
LINE = "  A line that Many documents share.\t"
EDGE = [
    (None, "text of no id"), (1, None), (2, ""), (3, "\n\n"), (4, LONG), (5, f"{LINE}\nown 5"), (6, f"{LINE.strip().upper()}\n{LINE}\nown 6"), (7, f"x\n{LINE}"), (7, f"x\n{LINE}"),
    (8, "é\U0001f600 \x00 ß"), (9, words(9)), (10, words(9)), (11, words(9) + " more"), (12, None, None), (13, " \t\r\n\x0b\x0c "), (14, "<|endoftext|>idiot's  \n\n x"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return docs(spark, EDGE)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, data, name):
    assert rows_of_frame(queries.QUERIES[name](spark, data)) == rows_of_sql(connection(data), queries.ORACLES[name])


# Line dedup


def brute_lines(rows, least=20):
    trim = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(trim))
    held = collections.defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                held[k].append(i)
    low = -(10**9)
    keeper = {k: max(low if i is None else i for i in v) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), low if i is None else i) == (low if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(edge):
    got = line_dedup.dedup_lines(edge).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines([r[:2] for r in EDGE])


def test_line_dedup_keeps_columns(edge, none):
    done = line_dedup.apply_dedup(edge)
    assert done.columns == edge.columns and done.count() == len(EDGE) and done.schema["n_chars"].dataType == edge.schema["n_chars"].dataType
    assert {r.n_chars for r in done.where("doc_id = 5").collect()} == {len("own 5")}
    assert line_dedup.apply_dedup(none).count() == 0


def test_line_dedup_all_lines_and_no_ids(spark):
    rows = [(1, LINE), (2, LINE), (3, LINE), (None, "n" * 30), (None, "n" * 30), (None, "n" * 30)]
    got = {(r.row.doc_id, r.kept) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {(1, ""), (2, ""), (3, LINE), (None, "n" * 30)}


# Sharding


def test_lookup_table():
    table = sharding.lookup_table()
    counts = collections.Counter(table)
    assert len(table) == sharding.SIZE and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.1 * sharding.SIZE
    assert sharding.lookup_table(("b", "a"), 7) == brute_table(("b", "a"), 7)
    for wrong in (((), 7), (("a", "a"), 7), (("a",), 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*wrong)


def brute_table(shards, size):
    want = {}
    for s in shards:
        a, b = sharding._digests(s)
        want[s] = [(a % size + j * (b % (size - 1) + 1)) % size for j in range(size)]
    table = [None] * size
    while None in table:
        for s in sorted(shards):
            free = next((x for x in want[s] if table[x] is None), None)
            if free is not None:
                table[free] = shards.index(s)
    return table


def test_sharding_edges(edge, none, tmp_path, spark):
    placed = sharding.place(edge, "doc_id")
    assert placed.count() == len(EDGE) and placed.where("shard is null").count() == 0
    assert placed.where("row.doc_id = 7").select("shard").distinct().count() == 1
    assert sharding.place(none, "doc_id").count() == 0
    sharding.write_shards(edge.drop("row"), "doc_id", f"{tmp_path}/s", shards=("a", "b"))
    assert spark.read.parquet(f"{tmp_path}/s").groupBy("shard").count().count() == 2


# URL filter


def test_urls(spark):
    rows = [
        (1, None), (2, "no scheme.com/en/"), (3, "HTTP://WWW.Example.COM/en/x?y#z"), (4, "http://example.com/en/"), (5, "http://a.example.com/en/x"), (6, "http://com"), (7, "http://xcom/"), (8, "https://b.net/es/1"),
        (9, "http://net/fr/"), (10, "http://net/FR/"), (11, "http://free-bets.example.net/"), (12, "http://x.free-bets.example.net?/es/"), (13, "http://notexample.com/en/#"), (14, "http://a://b.com/en/"), (15, ""), (16, "http:///es/"), (4, "http://example.com/en/"),
    ]
    pages = spark.createDataFrame([(*r, "v", "h") for r in rows], "page_id long, url string, verdict string, host string")
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 4: ("example.com", "/en/", "example.com/en/", "block"), 5: ("a.example.com", "/en/x", "example.com/en/", "block"),
        6: ("com", "", None, "allow"), 7: ("xcom", "/", None, "allow"), 8: ("b.net", "/es/1", "net/es/", "block"), 9: ("net", "/fr/", "net/fr/", "block"), 10: ("net", "/FR/", None, "allow"), 11: ("free-bets.example.net", "/", None, "block"),
        12: ("x.free-bets.example.net", "", None, "block"), 13: ("notexample.com", "/en/", "com/", "allow"), 14: ("a:", "//b.com/en/", None, "allow"), 15: ("", "", None, "allow"), 16: ("", "/es/", None, "allow"),
    }
    assert url_filter.judge_urls(pages.where("false")).count() == 0


def test_long_urls(tmp_path, monkeypatch):
    """A host of a hundred thousand labels takes no longer than its length, and all suffixes that can fit are tried."""
    at = tmp_path / "f"
    at.write_bytes(url_filter.packed([*url_filter.RULES, ("block", "a.b.c.d.org", "/")], ["x..bad.org"]))
    array = url_filter.DigestArray.open(str(at))
    deep, probed = "a." * 100_000, []
    find = array.probe
    monkeypatch.setattr(url_filter.DigestArray, "probe", lambda self, keys: probed.extend(keys) or find(keys))
    hosts = [deep + "example.com", deep + "b.c.d.org", deep + "x..bad.org", "..", deep, "b.c.d.org"]
    rules, verdicts = array.judge(hosts, ["/en/" + "x" * 100_000, "/", "/", "/", "/", "/"])
    assert rules == ["example.com/en/", "a.b.c.d.org/", None, None, None, None] and verdicts == ["block", "block", "block", "allow", "allow", "allow"]
    assert len(probed) < 200 and max(map(len, probed)) < 200
    monkeypatch.setattr(url_filter, "MAX_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        url_filter.publish(None, b"x" * 11)


def test_digest_collision(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh3_64_intdigest", lambda raw: 5)
    at = tmp_path / "f"
    at.write_bytes(url_filter.packed(url_filter.RULES, ["bad.org"]))
    array = url_filter.DigestArray.open(str(at))
    assert (array.probe(["net/es/", "other", "bad.org"]) >= 0).tolist() == [True, False, True]
    assert array.judge(["a.net", "x.bad.org"], ["/es/", "/"]) == (["net/es/", None], ["block", "block"])
    at.write_bytes(url_filter.packed([]))
    assert url_filter.DigestArray.open(str(at)).judge(["a.net"], ["/es/"]) == ([None], ["allow"])


# Quality rules


def brute_rules(text):
    w = (text or "").encode("utf-8").split()
    wins = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


RULES = [*EDGE, (20, " ".join("a b c d e f g h".split() * 3)), (21, "x " * 40), (22, "a|b %\na|b %\n\n \n" * 5), (23, " ".join(map(str, range(30)))), (24, " ".join(map(str, [*range(20), 99, *range(4, 14)])))]


def test_quality_rules(spark, none):
    got = quality_rules.quality_rules(docs(spark, RULES)).collect()
    assert len(got) == len(RULES)
    want = sorted(((r[0], *brute_rules(r[1])) for r in RULES), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert quality_rules.quality_rules(none).count() == 0


def test_hosts(spark):
    good, bad = words(1, 40), "short"
    rows = [(i, bad if i % 10 else words(i, 40), "junk") for i in range(40)] + [(100 + i, good if i % 10 else bad, "fine") for i in range(40)] + [(200, good, None), (201, words(3, 40), "single")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert not any(got[i] for i in range(40)) and got[101] and not got[100] and got[200] and got[201]
    assert quality_rules.beta_prior(None, None, None) == (0.5, 2.0) and quality_rules.beta_prior(0.5, 0.0, 10.0) == (0.5, 2.0)


# SimHash


def brute_classes(rows, similarity=0.8):
    cache = WordHashes()
    texts = sorted({t or "" for _, t in rows})
    sets = [set(shingles(t, cache).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    label = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        if i is not None:
            least[label[t or ""]] = min(i, least.get(label[t or ""], i))
    return sorted(((i, least.get(label[t or ""])) for i, t in rows), key=repr)


def near(seed, edits, n=200):
    rng = random.Random(f"{seed}/{edits}")
    w = words(seed, n).split()
    for _ in range(edits):
        w[rng.randrange(n)] = f"edit{rng.random()}"
    return " ".join(w)


def test_simhash_against_brute_force(spark):
    rows = [r[:2] for r in EDGE]
    rows += [(1000 + 10 * s + e, near(s, e)) for s in range(20) for e in range(5)]
    rows += [(3000 + i, words(777, 100)) for i in range(50)]
    got = simhash.classes(docs(spark, rows)).select("doc_id", "class_id").collect()
    want = brute_classes(rows)
    wrong = set(map(tuple, got)) ^ set(want)
    assert len(got) == len(rows) and len(wrong) <= 4  # pairs at the very threshold may be missed


def test_simhash_splits_hot_buckets(spark):
    rows = [(i, near(5, 1, 300) + f" tail{i}") for i in range(120)] + [(1000 + i, words(i, 80)) for i in range(120)]
    got = {r.doc_id: r.class_id for r in simhash.classes(docs(spark, rows), cap=16).collect()}
    assert {got[i] for i in range(120)} == {0} and all(got[1000 + i] == 1000 + i for i in range(120))


def edited_to(seed, likeness, n=300):
    """Two texts of which one has a stretch of other words, so that their similarity is just `likeness` or more."""
    w = words(seed, n).split()
    shared = n - 4 - int((1 - likeness) / (1 + likeness) * (n - 4))
    return " ".join(w), " ".join(w[: shared + 4] + words(f"{seed} other", n).split()[shared + 4 :])


@pytest.mark.parametrize(("similarity", "most"), [(0.8, 1), (0.5, 1), (0.4, 1)])
def test_distance_filter_keeps_pairs_at_the_threshold(similarity, most):
    cache, lost = WordHashes(), 0
    for seed in range(1000):
        h = [shingles(t, cache) for t in edited_to(f"far {seed}", similarity + 0.005)]
        prints = np.stack([np.packbits(simhash.bits_of(x)) for x in h]).view(np.uint64)
        lost += not len(simhash.bucket_links(prints, np.array([len(x) for x in h]), similarity)[0])
    assert lost <= most


@pytest.mark.parametrize("bits", [8, 11, 13, 17])
def test_tables_suffice_for_any_size(bits):
    rng = np.random.default_rng(bits)
    number = simhash.tables_for(0.8, bits)
    at, cache, met = simhash.coordinates(number)[:, :bits], WordHashes(), []
    for seed in range(300):
        a, b = (simhash.bits_of(shingles(t, cache)) for t in edited_to(f"{bits} {seed}", 0.8 + 0.05 * rng.random()))
        met.append((a[at] == b[at]).all(axis=1).any())
    assert np.mean(met) > 0.97


def test_simhash_makes_as_many_tables_as_bits_need(spark):
    rows = [(2 * s + k, t) for s in range(60) for k, t in enumerate(edited_to(s, 0.85))]
    got = {r.doc_id: r.class_id for r in simhash.classes(docs(spark, rows), tables=2).collect()}
    assert sum(got[2 * s] == got[2 * s + 1] for s in range(60)) >= 58


@pytest.mark.parametrize("per_table", [1024, 1])
def test_simhash_finds_copies_in_hot_buckets(spark, monkeypatch, per_table):
    """Texts that share boilerplate fill buckets far beyond `cap`; only some have a near copy."""
    monkeypatch.setattr(simhash, "PER_TABLE", per_table)
    boilerplate, rows = words("boilerplate", 154), []
    for i in range(320):
        own = words(f"own {i}", 46)
        rows.append((2 * i, f"{boilerplate} {own}"))
        if i < 60:
            rows.append((2 * i + 1, " ".join([boilerplate, *own.split()[:30], words(f"edit {i}", 16)])))
    got = {r.doc_id: r.class_id for r in simhash.classes(docs(spark, rows), cap=2).collect()}
    want = dict(brute_classes(rows))
    assert sum(want[2 * i] == want[2 * i + 1] for i in range(60)) == 60 and len(set(want.values())) == 320
    assert sum(got[i] != want[i] for i in want) <= 2


def test_lost_bits_are_counted():
    """A run that is split notes for each text the bits that part it from the rest of the run."""
    import pyarrow as pa

    n, keys = 12, [(k << 56) + (k % 4 << 40) for k in [0] * 3 + [1] * 9]
    prints = [bytes([i]) * 64 for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array([f"{i:016d}".encode() for i in range(n)]), pa.array([100] * n, pa.int32()), pa.array(prints)], ["t", "key", "tid", "n", "print"])
    rows = [r for b in simhash._links(0.8, 8, 4, lost=True)(iter([batch])) for r in b.to_pylist() if r["b"] is None]
    lost = {int(r["a"]): r["lost"] for r in rows}
    assert {i for i in lost} >= set(range(3, 12)) and all(x > 0 for x in lost.values())
    assert lost[4] > lost[0]  # parted after all 64 sampled bits, not at the edge of a partition


def test_equal_prints_over_cap():
    import pyarrow as pa

    n, one = 50, bytes(range(64))
    batch = pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([7] * n, pa.int64()), pa.array([f"{i:016d}".encode() for i in range(n)]), pa.array([100] * n, pa.int32()), pa.array([one] * n)], ["t", "key", "tid", "n", "print"])
    pairs = [(r["a"], r["b"]) for b in simhash._links(0.8, 8, 8)(iter([batch])) for r in b.to_pylist()]
    parent = {f"{i:016d}".encode(): f"{i:016d}".encode() for i in range(n)}
    for a, b in sorted(pairs):
        x, y = parent[a], parent[b]
        parent = {k: min(x, y) if v in (x, y) else v for k, v in parent.items()}
    assert len(set(parent.values())) == 1 and len(pairs) < 2 * n


def test_keep_one(edge, none):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids.count(7) == 1 and 9 in ids and 10 not in ids and 11 not in ids and None in ids
    assert simhash.keep_one(none).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)] + [(300, 300)]
    root = {}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                m = min(root.get(a, a), root.get(b, b))
                root[a] = root[b] = m
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == root and len(got) == len(root)


# Winnowing


def test_winnow_against_brute_force():
    rng = random.Random(2)
    texts = ["", "a", "abc" * 3, "aaaa" * 40, LONG[:900], "é\U0001f600" * 50, *("".join(rng.choice("ab") for _ in range(n)) for n in range(1, 150, 7))]
    for text in texts:
        points = winnow.code_points(text)
        h, at = winnow.fingerprint(text)
        if not len(points):
            assert not len(h)
            continue
        grams = winnow.gram_hashes(points)
        width, want = min(winnow.WINDOW, len(grams)), []
        for i in range(len(grams) - width + 1):
            part = grams[i : i + width]
            best = i + max(j for j in range(width) if part[j] == part.min())
            if not want or want[-1] != best:
                want.append(best)
        assert at.tolist() == want and (h == grams[at]).all()
        k = min(winnow.K, len(points))
        assert all(grams[i] == winnow.gram_hashes(points[i : i + k])[0] for i in range(0, len(grams), 17))


def test_winnow_guarantee():
    shared = words(3, 12)[: winnow.WINDOW + winnow.K - 1]
    a, _ = winnow.fingerprint(words(1, 40) + shared + words(2, 40))
    b, _ = winnow.fingerprint(words(5, 33) + shared + words(6, 21))
    assert len(np.intersect1d(a, b))


def test_winnow_with_next(spark, edge, none):
    got = winnow.compare_with_next(edge).collect()
    rows = sorted(((r[0], r[1] or "") for r in EDGE), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, follow = (winnow.fingerprint(x) for x in (text, edited, after))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), winnow.written(*own), winnow.written(*other), winnow.likeness(own[0], other[0]), winnow.likeness(own[0], follow[0])))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert winnow.compare_with_next(none).count() == 0
    named = docs(spark, EDGE).withColumn("doc_id", F.concat(F.lit("né-"), F.lpad("doc_id", 4, "0")))
    texts = winnow.compare_with_next(named).drop("doc_id")
    assert sorted(map(tuple, texts.collect()), key=repr) == sorted((r[1:] for r in want), key=repr)
    alone = winnow.compare_with_next(docs(spark, [(3, "alone in the world, with itself to follow")])).first()
    assert alone.near_next == 1.0
    plain = winnow.fingerprints(edge).where("doc_id = 9").first().fingerprint
    assert plain.hashes == winnow.fingerprint(words(9))[0].tolist()


# BPE


@pytest.mark.parametrize("blocks", [{}, {"block_words": 40}, {"block_distinct": 3}])
def test_bpe_equals_library(spark, none, blocks):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_path())
    rows = [*EDGE, (30, "a<|endoftext|><|endoftext|>b"), (31, "  x\n\n y  z　'S 's it's IT'LL\t\t\n"), (32, "\x85\x1c\x1d ab"), (33, "٠١ ½ Ⅷ ﻿한국어 日本語 กำ"), (34, "a" * 5000), (35, " " * 5000 + "x"), (36, "a\x1c \x1fb")]
    done = bpe.encode(docs(spark, rows), **blocks)
    for r, (i, text) in zip(sorted(done.collect(), key=lambda r: (repr(r.doc_id), r.ids)), sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (repr(r[0]), tokenizer.encode(r[1], add_special_tokens=False).ids))):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(done)
    assert sorted(r.text for r in back.collect()) == sorted(r[1] or "" for r in rows)
    assert bpe.encode(none).count() == 0


# Classifiers


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_gradients():
    rng = np.random.default_rng(0)
    m, x, starts, y = quality_mil.AttentionModel(), rng.normal(size=(9, quality_mil.WIDTH)), np.array([0, 3, 4]), np.array([1.0, 0, 1])
    g = m._gradient(m._forward(x, starts), y)
    loss = lambda: -(y * np.log(m.score(x, starts)) + (1 - y) * np.log(1 - m.score(x, starts))).mean()
    for k, v in m.p.items():
        flat = v.reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - g[k].reshape(-1)[i]) < 1e-7
    sums = np.add.reduceat(m.attention(x, starts), starts)
    assert np.allclose(sums, 1)


def test_attention_against_brute_force(spark):
    """Scores of whole texts, passage by passage and word by word."""
    rng, model = np.random.default_rng(2), quality_mil.AttentionModel()
    texts = [words(i, n) for i, n in ((1, 10), (2, 64), (3, 65), (4, 300))] + ["", "A!! B?? | 12"]
    cache = WordHashes()
    parts = [quality_mil.encode(t, cache) for t in texts]
    model.shift, model.scale = rng.normal(size=quality_mil.WIDTH), rng.random(quality_mil.WIDTH) + 0.5
    got = model.score(np.concatenate(parts).astype(float), np.cumsum([0, *map(len, parts[:-1])]))
    p, sigmoid = model.p, lambda v: 1 / (1 + np.exp(-v))
    for text, x, y in zip(texts, parts, got):
        assert len(x) == max(1, -(-len(text.split()) // 64))
        h = [np.tanh(np.clip((r - model.shift) / model.scale, -6, 6) @ p["E"] + p["e"]) for r in x.astype(float)]
        a = np.array([(np.tanh(v @ p["V"]) * sigmoid(v @ p["U"])) @ p["w"] for v in h])
        weight = np.exp(a) / np.exp(a).sum()
        assert np.isclose(y, sigmoid(sum(w * v for w, v in zip(weight, h)) @ p["c"] + p["b"][0]))
        for k, row in enumerate(x):
            passage = text.split()[64 * k : 64 * k + 64]
            counts = np.zeros(quality_mil.HASHED)
            for w in passage:
                m = int(quality_mil.mix(np.array([cache[w.encode()]], np.uint64))[0])
                counts[m % quality_mil.HASHED] += 1 if m >> 63 else -1
            assert np.allclose(row[-quality_mil.HASHED :], counts / np.sqrt(max(len(passage), 1)), atol=1e-5)


def test_passages_are_bounded(spark):
    rows = [(i, words(i, 640 if i % 10 == 0 else 30) + (" !! ||" * 9 if i % 2 else "")) for i in range(80)]
    lab = labels(spark, [(i, (i + 1) % 2, 0) for i, _ in rows])
    sizes = []
    fit = quality_mil.AttentionModel.fit
    try:
        quality_mil.AttentionModel.fit = lambda self, x, starts, y, **k: sizes.append(len(x)) or fit(self, x, starts, y, **k)
        quality_mil.fit(docs(spark, rows), lab, max_passages=60)
    finally:
        quality_mil.AttentionModel.fit = fit
    assert 30 < sizes[0] <= 60


def heldout_accuracy(spark, folder, name, label):
    got = queries.QUERIES[name](spark, folder)
    both = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").select("predicted", label).collect()
    return np.mean([r.predicted == r[label] for r in both]), len(both)


@pytest.mark.parametrize(("name", "label", "least"), [("op3_quality_mil", "quality", 0.97), ("op5_toxicity", "toxic", 0.95)])
def test_held_out(spark, name, label, least):
    share, n = heldout_accuracy(spark, "/root/testdata/sf0.01", name, label)
    assert n > 50 and share >= least


@pytest.mark.parametrize("op", [quality_mil, toxicity])
def test_classifier_edges(spark, edge, none, op):
    made = [(20 + i, ("you idiot " if i % 2 else "") + words(i, 30) + (" !! ||" * 9 if i % 2 else "")) for i in range(60)]
    both = docs(spark, EDGE + made)
    lab = labels(spark, [(i, (i + 1) % 2, i % 2) for i, _ in made] + [(20, 1, 0), (9999, 1, 1), (21, None, None)])
    got = op.classify(both, lab).collect()
    assert len(got) == len(EDGE) + 60 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len({r.score for r in got if r.doc_id in (9, 10)}) == 1
    right = [r.predicted == ((r.doc_id % 2) if op is toxicity else (r.doc_id + 1) % 2) for r in got if r.doc_id and r.doc_id >= 20]
    assert np.mean(right) > 0.95
    assert op.classify(none, lab).count() == 0
    assert op.classify(edge, lab.where("false")).count() == len(EDGE)
    one = op.classify(edge, labels(spark, [(9, 1, 1), (4, 1, 1)])).collect()
    assert len(one) == len(EDGE)


def test_held_out_labels_are_never_learned(spark):
    rows = [(i, words(i, 30)) for i in range(50)]
    lab = [(i, i % 2, i % 2) for i in range(50)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in lab]
    scores = [sorted((r.doc_id, r.score) for r in quality_mil.classify(docs(spark, rows), labels(spark, x)).collect()) for x in (lab, flipped)]
    assert scores[0] == scores[1]


def test_drop_toxic(spark):
    rows = [(i, ("moron scum trash " if i % 3 == 0 else "") + words(i, 40)) for i in range(60)] + [(None, None), (70, "")]
    kept = toxicity.drop_toxic(docs(spark, rows), labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(60)]))
    assert kept.columns == docs(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(60) if i % 3} | {None, 70}


def test_glued_and_long_words_are_read(spark):
    """Insults between marks, in words of any length, and beside blanks that aren't ASCII."""
    finder = toxicity.Finder(["idiot", "^moro"])
    v = lambda text: toxicity.votes(text, finder)
    assert v("an idiot_moron_" + "x" * 500)[:2].tolist() == [1, 1]
    assert v("idiot,moron")[-2] == 1 and v("moroni" * 100)[1] == 1 and v("nothing")[-2] == 0
    mined = {e for w in toxicity.tokens("big idiot\u3000here") for e in toxicity.entries_of(w.decode())}
    assert "idiot" in mined and v("big idiot\u3000here")[-2] == 1
    assert v("YOU soooo i*iot !! you idiot")[2:7].tolist() == [1, 1, 1, 1, 1]


def test_label_model_against_brute_force():
    """Posteriors with independent voters are Bayes' rule; unlabelled documents go by the voters alone."""
    rng = np.random.default_rng(4)
    y = rng.random(3000) < 0.4
    x = np.stack([np.where(y, rng.random(3000) < a, rng.random(3000) < b) for a, b in ((0.8, 0.1), (0.6, 0.05), (0.7, 0.2), (1.0, 0.0))], axis=1)
    seen = np.arange(3000) < 1500
    x[~seen, -1] = False
    m = toxicity.LabelModel().fit(x, np.where(seen, np.where(x[:, -1], 0.9, 0.1), 0.0), seen)
    assert np.allclose(m.on[:3], (0.8, 0.6, 0.7), atol=0.06) and np.allclose(m.off[:3], (0.1, 0.05, 0.2), atol=0.06) and abs(m.prior - 0.4) < 0.06
    for i in (*range(5), *range(2995, 3000)):
        yes, no = m.prior, 1 - m.prior
        for k in range(4 if seen[i] else 3):
            a, b = (m.on[k], m.off[k]) if x[i, k] else (1 - m.on[k], 1 - m.off[k])
            yes, no = yes * a ** m.weight[k], no * b ** m.weight[k]
        assert np.isclose(m.posterior(x, seen)[i], yes / (yes + no))
    assert ((m.posterior(x, seen) > 0.5) == y)[~seen].mean() > 0.85


def test_label_model_reads_correlations():
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.3
    noisy = lambda a, b: np.where(y, rng.random(2000) < a, rng.random(2000) < b)
    one = noisy(0.6, 0.1)
    x = np.stack([one, one, one, noisy(0.7, 0.2), noisy(0.8, 0.05), noisy(0.95, 0.005)], axis=1)
    m = toxicity.LabelModel().fit(x, x[:, -1].astype(float))
    assert m.weight[0] < 0.5 < m.weight[3] and abs(m.correlation[0, 1]) > 0.9
    assert ((m.posterior(x) > 0.5) == y).mean() > 0.95


# Mixing


def test_mixing(spark, none):
    rng = random.Random(3)
    voc = {"en": ["the", "and", "of", "to"], "de": ["der", "und", "das", "zu"], "fr": ["le", "et", "de", "au"]}
    make = lambda d, n: " ".join(rng.choice(voc[d]) for _ in range(n))
    rows = [(i, make(d, 30 + i % 7), "s", d) for i, d in enumerate(["en"] * 60 + ["de"] * 20 + ["fr"] * 10)]
    rows += [(500, None, "s", None), (501, "", "s", None), (502, "zzz unknown", "s", None), (503, rows[0][1], "s", "en"), (503, rows[0][1], "s", "en"), (None, make("de", 9), "s", "de")]
    frame = docs(spark, rows)
    lab = frame.where("doc_id < 500 and doc_id % 2 = 0").select("doc_id", F.col("lang").alias("domain"))
    targets = {"en": 0.2, "de": 0.5, "fr": 0.3, "xx": 0.4}
    rated, domains = mixing.mix(frame, lab, targets)
    got = rated.collect()
    assert domains == ["de", "en", "fr"] and len(got) == len(rows)
    p = np.array([[r.p0, r.p1, r.p2] for r in got])
    t, rate = np.array([r.tokens for r in got]), np.array([r.rate for r in got])
    assert (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    totals = (rate * t) @ p
    assert np.allclose(totals / t.sum(), [0.5, 0.2, 0.3], atol=1e-3)
    assert {r.rate for r in got if not r.tokens} == {1.0}
    mixed = mixing.apply_mix(frame, lab, targets=targets)
    kept = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == frame.columns and set(kept) == {r[0] for r in rows} and kept[503] >= 2 and kept[80] >= 2
    assert mixing.mix(none, lab)[0].count() == 0
    plain, domains = mixing.mix(frame, lab.where("false"))
    assert domains == [] and {r.rate for r in plain.collect()} == {1.0}
    assert mixing.apply_mix(frame, lab.where("false")).count() == len(rows)
    with pytest.raises(ValueError):
        mixing.mix(frame, lab, {"xx": 1.0})


@pytest.mark.parametrize("wanted", [(0.5, 0.3, 0.2), (0.2, 0.6, 0.2), (0.0, 0.0, 1.0)])
def test_rates_are_least_squares(spark, wanted):
    """Targets in and out of reach, against all sets of at most three documents: one of them holds a solution."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([1.0, 1.0, 1.0], 40) * 0.6 + np.array([0.4, 0.0, 0.0])
    p[7] = p[3]  # documents of one direction share it
    t = rng.integers(1, 50, 40)
    frame = spark.createDataFrame([(i, int(n), *map(float, q)) for i, (n, q) in enumerate(zip(t, p))] + [(99, 0, 0.0, 0.0, 1.0)], "doc_id long, tokens long, p0 double, p1 double, p2 double")
    goal, whole = np.array(wanted), t.sum()
    got = mixing.fit_rates(frame.coalesce(1), list(map(float, goal * whole)))
    assert got.columns == [*frame.columns, "rate"]
    rate = np.array([r.rate for r in got.where("doc_id < 99").orderBy("doc_id").collect()])
    a = (p * t[:, None]).T / whole
    best = np.linalg.norm(goal)
    for n in (1, 2, 3):
        for some in itertools.combinations(range(40), n):
            x = np.linalg.lstsq(a[:, some], goal, rcond=None)[0]
            if (x >= 0).all():
                best = min(best, np.linalg.norm(a[:, some] @ x - goal))
    assert (rate >= 0).all() and np.linalg.norm(a @ rate - goal) <= best + 2e-4
    assert best < 1e-9 or np.isclose(rate[3], rate[7])


def test_unreached_rates_are_reported(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([1.0, 1.0, 1.0], 40) * 0.6 + np.array([0.4, 0.0, 0.0])
    frame = spark.createDataFrame([(i, 1, *map(float, q)) for i, q in enumerate(p)], "doc_id long, tokens long, p0 double, p1 double, p2 double")
    with pytest.warns(UserWarning, match="direction"):
        mixing.fit_rates(frame.coalesce(1), [4.0, 32.0, 4.0], steps=2, edges=1)


def test_posteriors_against_brute_force(spark):
    """Words of any length and number count; words of fewer than three documents of the sample don't."""
    rng = random.Random(8)
    long_word, voc = "w" * 5000, [f"v{i}" for i in range(6000)]
    rows = [(i, " ".join([*rng.choices(voc[i % 2 * 3000 : i % 2 * 3000 + 3000], k=400), *["both", long_word][: 1 + i % 2]]), "s", "ab"[i % 2]) for i in range(40)] + [(50, None, "s", "a"), (51, "unseen", "s", "b")]
    frame = docs(spark, rows)
    lab = frame.where("doc_id < 30").select("doc_id", F.col("lang").alias("domain"))
    sample = [(set(t.split()), d) for i, t, _, d in rows if i < 30]
    n = {d: sum(x == d for _, x in sample) for d in "ab"}
    count = {d: collections.Counter(w for ws, x in sample if x == d for w in ws) for d in "ab"}
    known = {w for d in "ab" for w in count[d] if count["a"][w] + count["b"][w] >= 3}
    assert len(known) > 1000 and long_word in known
    rated, domains = mixing.mix(frame, lab)
    assert domains == ["a", "b"]
    for r in rated.collect():
        ws = [w for w in set((dict((i, t) for i, t, *_ in rows)[r.doc_id] or "").split()) if w in known]
        weight = min(len(ws), 12) / len(ws) if ws else 0
        s = [np.log(n[d] / 30) + weight * sum(np.log((count[d][w] + 0.5) / (n[d] + 1)) for w in ws) for d in "ab"]
        assert np.isclose(r.p0, 1 / (1 + np.exp(s[1] - s[0])), atol=1e-9)
