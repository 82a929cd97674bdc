"""Exact dedup, SimHash, fingerprints, substring dedup, against brute force."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import common, exact, orderminhash, simhash, substring
from quarry.llm.components import components

from .conftest import prose, texts

GAP = r"[\x20\x09-\x0D]+"


def test_exact_groups(odd, none):
    groups = collections.defaultdict(list)
    for k, t in texts(odd):
        groups[re.sub(GAP, "", t)].append((-len(t), k is None, k or 0, k))
    got = exact.exact_groups(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        of = next(v for n, v in groups.items() if hashlib.sha256(n.encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == (min(of)[3], len(of))
    assert sum(r.kept for r in got) == len(groups) + 1  # one row that stays is there twice, and is one of the groups
    assert exact.exact_groups(none).count() == 0
    left = exact.exact_deduplicated(odd)
    assert left.columns == odd.columns and left.count() == len(groups)


def test_digest_index_in_batches(spark, tmp_path):
    path = f"file://{tmp_path}/digests"
    index = exact.DigestIndex(spark, path, buckets=4)
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    result = lambda df: {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in df.collect()}
    first = docs([(1, "a b"), (2, "c")])
    index.add(first, batch="0")
    spark.sql(f"DROP TABLE {index.name}")  # another session finds the files
    index = exact.DigestIndex(spark, path)
    assert index.buckets == 4 and index.batches() == ["0"]
    second, expected = docs([(3, "ab"), (4, "d"), (5, "d "), (6, "c")]), {3: (1, False, 1), 4: (5, False, 2), 5: (5, True, 2), 6: (2, False, 1)}
    for _ in range(2):  # the same batch again changes nothing
        assert result(index.add(second, batch="1")) == expected
        assert index.table().count() == 3 and index.batches() == ["0", "1"]
    assert result(index.add(first, batch="0")) == {1: (1, True, 1), 2: (2, True, 1)}
    assert result(index.add(first, batch="2")) == {1: (1, False, 1), 2: (2, False, 1)}
    with pytest.raises(ValueError, match="other texts"):
        index.add(docs([(9, "new")]), batch="1")
    with pytest.raises(ValueError, match="buckets"):
        exact.DigestIndex(spark, path, buckets=5)


def test_digest_index_after_a_lost_driver(spark, tmp_path, monkeypatch):
    """The driver goes after the files are there and before they count; the batch is added again."""
    index = exact.DigestIndex(spark, f"file://{tmp_path}/digests", buckets=4)
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "ab")], "doc_id long, text string")

    def lost(self, state):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(common.Manifest, "write", lost)
        with pytest.raises(KeyboardInterrupt):
            index.add(docs, batch="x")
    assert index.batches() == [] and index.table().count() == 2
    index = exact.DigestIndex(spark, f"file://{tmp_path}/digests")
    assert {r.doc_id: (r.keep_id, r.kept) for r in index.add(docs, batch="x").collect()} == {1: (1, True), 2: (2, True), 3: (1, False)}
    assert index.table().count() == 2


def test_paths_that_look_alike_are_indexes_of_their_own(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for name in ("a/b", "a_b", "a-b"):
        assert exact.DigestIndex(spark, f"{tmp_path}/{name}", buckets=2).add(docs, batch="0").first().kept
        assert substring.WindowIndex(spark, f"{tmp_path}/w/{name}", buckets=2).runs() == []


def test_manifest_is_swapped_whole(spark, tmp_path):
    at = common.Manifest(spark, f"file://{tmp_path}/m")
    assert at.read() == {}
    for i in range(4):
        at.write({"i": i, "names": ["ä", "b"]})
        assert common.Manifest(spark, f"file://{tmp_path}/m").read() == {"i": i, "names": ["ä", "b"]}
    (tmp_path / "m" / "_manifest" / "new-half").write_text("{")  # what a lost driver was writing
    assert at.read()["i"] == 3


def brute_fingerprint(t, words):
    w = [x for x in re.split(GAP, "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + words]).encode(), seed=42) for k in range(max(1, len(w) - words + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(n, close):
    return closed_by(n, [(i, j) for i, j in itertools.combinations(range(n), 2) if close(i, j)])


def closed_by(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_near_groups(odd, none):
    docs = texts(odd)
    prints = [brute_fingerprint(t, 4) for _, t in docs]
    roots = closed(len(docs), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {r: min((k for (k, _), q in zip(docs, roots, strict=True) if q == r and k is not None), default=None) for r in roots}
    expected = sorted(((k is None, k or 0, format(p, "016x"), least[r]) for (k, _), p, r in zip(docs, prints, roots, strict=True)), key=str)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_groups(odd, tile=2).collect()), key=str)
    assert got == expected
    assert simhash.near_groups(none).count() == 0


def test_links_of_wide_and_narrow_fingerprints(spark):
    rng = np.random.default_rng(3)
    for bits, radius, tile in ((64, 4, 16), (64, 4, 4096), (256, 52, 16)):
        seeds = rng.integers(0, 2, (40, bits))
        rows = np.concatenate([seeds] + [np.where(rng.random(seeds.shape) < p, 1 - seeds, seeds) for p in (0.02, 0.05, 0.2)])
        prints = sorted({np.packbits(r).tobytes() for r in rows})
        df = spark.createDataFrame([(7, bytearray(p), int.from_bytes(p, "big").bit_count()) for p in prints], "k long, fp binary, ones int")
        df = df.select(simhash.node(F.col("k"), F.col("fp")).alias("node"), "ones")
        got = {bytes(r.node)[8:]: bytes(r.root)[8:] for r in components(simhash.links(df, radius, bits, tile)).collect()}
        n = [int.from_bytes(p, "big") for p in prints]
        roots = closed(len(n), lambda i, j, n=n, radius=radius: (n[i] ^ n[j]).bit_count() <= radius)
        assert [got.get(p, p) for p in prints] == [prints[r] for r in roots]


def test_nodes_are_in_the_order_of_keys(spark):
    keys = [None, 5, -1, 0, -(1 << 63), (1 << 63) - 2, 300]
    rows = spark.createDataFrame([(k, bytearray(b"x")) for k in keys], "k long, fp binary").select("k", simhash.node(F.col("k"), F.col("fp")).alias("n")).select("k", "n", simhash.first_of(F.col("n")).alias("b")).collect()
    assert all(r.k == r.b for r in rows)
    assert [r.k for r in sorted(rows, key=lambda r: bytes(r.n))] == sorted(k for k in keys if k is not None) + [None]


def test_near_copies_go_and_others_stay(spark):
    def edited(seed, words, n):
        w = prose(seed, words).split()
        for i in range(n):
            w[(i * 61 + 17) % words] = "edit"
        return " ".join(w)

    docs = [(i, prose(100 + i, 300)) for i in range(30)] + [(100 + i, edited(100 + i, 300, 5)) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_deduplicated(df, tile=16).collect()) == list(range(30))


def shingle_set(t, words=5):
    w = [x for x in re.split(GAP, "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if x]
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def test_near_copies_are_those_of_brute_force(spark, odd, none):
    """Rows go if links of 0.8 or more, and no others, lead to a row of a lesser key; pieces small and large."""
    rng = np.random.default_rng(8)
    docs = []
    for family in range(14):  # copies of 0.3 to 0.95, some in chains
        w = prose(500 + family, int(rng.integers(60, 400))).split()
        base = list(w)
        for n in range(12):
            w = list(w if family % 2 else base)
            for at in rng.integers(0, len(w), int(len(w) * (0.002 + 0.004 * (n + family % 3)))):
                w[at] = f"e{family}x{n}x{at}"
            docs.append((int(rng.integers(0, 1 << 40)), " ".join(w)))
    docs.append((7, "a b c d e f g h"))
    sets = [shingle_set(t) for _, t in docs]
    like = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    roots = closed(len(docs), lambda i, j: like(i, j) >= 0.8)
    assert sum(0.55 < like(i, j) < 0.8 for i, j in itertools.combinations(range(len(docs)), 2)) > 100
    stay = sorted(min(k for (k, _), q in zip(docs, roots, strict=True) if q == r) for r in set(roots))
    assert 30 < len(stay) < len(docs) - 30
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for sizes in ({}, {"tile": 16, "piece": 6000}):
        assert sorted(r.doc_id for r in simhash.near_deduplicated(df, **sizes).collect()) == stay
    left = simhash.near_deduplicated(odd)
    assert left.columns == odd.columns and simhash.near_deduplicated(none).count() == 0
    kinds = texts(odd)
    assert left.count() == len(set(closed(len(kinds), lambda i, j: (a := shingle_set(kinds[i][1])) == (b := shingle_set(kinds[j][1])) or len(a & b) >= 0.8 * len(a | b))))


def test_size_classes_of_near_copies():
    for n in [*range(1, 3000), 10**6, 10**9]:
        most = n * 5 // 4  # the largest set that may be a near copy
        assert simhash.size_class(most) - simhash.size_class(n) <= 1
    assert simhash.size_class(0) == -1


def test_all_near_copies_of_a_table_are_found(spark):
    """Recall of the candidate search against brute force over all documents of sf0.01, by an inverted index of shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {k: frozenset(shingle_set(t)) for k, t in texts(docs)}
    first: dict = {}
    for k, v in sorted(sets.items()):
        first.setdefault(v, k)  # equal sets are one
    keys = sorted(first.values())
    where = collections.defaultdict(list)
    for k in keys:
        for x in sets[k]:
            where[x].append(k)
    shared = collections.Counter((a, b) for v in where.values() for a, b in itertools.combinations(v, 2))
    pairs = {p for p, n in shared.items() if 5 * n >= 4 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    assert len(pairs) >= 5
    at = {k: i for i, k in enumerate(keys)}
    roots = closed_by(len(keys), [(at[a], at[b]) for a, b in pairs])
    stay = sorted(keys[i] for i, r in enumerate(roots) if i == r)
    assert sorted(r.doc_id for r in simhash.near_deduplicated(docs).collect()) == stay


def test_repeated_lines_count_once(spark):
    """A line that is repeated neither hides a near copy nor makes one."""
    docs = []
    for i in range(8):
        line, t = " ".join(prose(900 + i, 12).split()[:12]), prose(700 + i, 220)
        docs += [(10 * i, t), (10 * i + 1, t + f" {line}" * 12), (10 * i + 2, prose(800 + i, 100) + f" {line}" * 40), (10 * i + 3, prose(850 + i, 100) + f" {line}" * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_deduplicated(df).collect()) == sorted(k for k, _ in docs if k % 10 != 1)


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5400)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(pairs, "a long, b long")
    nodes = sorted({x for a, b in pairs if a is not None and a != b for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    up = list(range(len(nodes)))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a is not None and a != b and up[at[a]] != up[at[b]]:
                low = min(up[at[a]], up[at[b]])
                up[at[a]] = up[at[b]] = low
                changed = True
    assert sorted(map(tuple, components(df).collect())) == [(x, nodes[up[at[x]]]) for x in nodes]
    assert components(df.where("a < 0")).count() == 0


def brute_order_minhash(t):
    h = [int(v) >> 24 for v in orderminhash._kmers(np.array([ord(c) for c in t], np.uint32))]
    seen, buckets = collections.Counter(), collections.defaultdict(list)
    mix = lambda v: int(orderminhash._mix(np.array([v % 2**64], np.uint64))[0])
    for place, k in enumerate(h):
        g = mix(k + seen[k] * int(orderminhash._C) + int(orderminhash._A)) >> 24
        seen[k] += 1
        buckets[g >> 34].append((g, place))
    out = ""
    for q in range(64):
        best, a = sorted(sorted(buckets[q])[:2], key=lambda v: v[1]), 0
        for g, _ in best:
            a = mix(a * int(orderminhash._A) + g + 1)
        out += format(a >> 48, "04x") if best else "----"
    return out


def test_order_minhash():
    for t in ("a", "abcdefgh", "abcdefghi", "a" * 40, "ab" * 60, prose(7, 200), "日本語" * 20):
        assert orderminhash.fingerprint(t) == brute_order_minhash(t)
    assert orderminhash.fingerprint("") == "-" * 256
    a = prose(8, 400)
    moved = a[len(a) // 2 :] + " " + a[: len(a) // 2]
    near, far = orderminhash.likeness(orderminhash.fingerprint(a), orderminhash.fingerprint(a[:-200] + prose(9, 30))), orderminhash.likeness(orderminhash.fingerprint(a), orderminhash.fingerprint(prose(10, 400)))
    assert near > 0.5 and far < 0.05
    assert orderminhash.likeness(orderminhash.fingerprint(a), orderminhash.fingerprint(moved)) < 0.75  # same pieces, another order
    assert orderminhash.likeness("-" * 256, "-" * 256) == 1.0
    low, orderminhash._LOW, orderminhash._MASK = orderminhash._LOW, 3, np.uint64(7)
    try:  # texts with more places than fit beside a hash are sorted another way
        long = orderminhash._ordered(np.array([9 << 60, 1 << 60, 9 << 60] * 5, np.uint64))
    finally:
        orderminhash._LOW, orderminhash._MASK = low, np.uint64((1 << low) - 1)
    assert long[1].tolist() == [1, 4, 7, 10, 13, 0, 2, 3, 5, 6, 8, 9, 11, 12, 14]


def test_edits(odd, none):
    docs = sorted(texts(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    prints: dict[str, str] = {}

    def fingerprint(t):
        if t not in prints:
            prints[t] = ("----" * 64 if not t else brute_order_minhash(t)) if len(t) < 5000 else orderminhash.fingerprint(t)
        return prints[t]

    def likeness(a, b):
        x, y = ([p[i : i + 4] for i in range(0, 256, 4)] for p in map(fingerprint, (a, b)))
        there = [(u, v) for u, v in zip(x, y, strict=True) if (u, v) != ("----", "----")]
        return sum(u == v for u, v in there) / len(there) if there else 1.0

    expected = []
    for (k, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        expected.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(t), fingerprint(edited), likeness(t, edited), likeness(t, after)))
    got = [tuple(r) for r in orderminhash.edits(odd).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert orderminhash.edits(none).count() == 0
    one = orderminhash.edits(odd.where("doc_id = 10")).first()
    assert one.near_next == 1.0


def brute_repeats(docs, window, known=()):
    words = [[w for w in re.split(GAP, t) if w] for t in docs]
    seen = collections.Counter(tuple(w[k : k + window]) for w in [*words, *([x for x in re.split(GAP, t) if x] for t in known)] for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_repeats(odd, none):
    docs = texts(odd)
    expected = sorted(((k, *v) for (k, _), v in zip(docs, brute_repeats([t for _, t in docs], 35), strict=True)), key=str)
    assert sorted(map(tuple, substring.repeats_removed(odd).collect()), key=str) == expected
    assert substring.repeats_removed(none).count() == 0


def test_anchors_are_shared_by_equal_windows():
    rng = np.random.default_rng(0)
    block, substring._BLOCK = substring._BLOCK, 16  # places are found by blocks
    try:
        h = rng.integers(0, 5, 400).astype(np.uint64)
        for window, gram in ((35, 8), (6, 2), (5, 5), (4, 1)):
            hashes, place, first, stop = substring.anchors(h, window, gram)
            at = {}
            for g, p, a, b in zip(hashes, place, first, stop, strict=True):
                for s in range(a, b):
                    assert s <= p <= s + window - gram
                    assert at.setdefault(tuple(h[s : s + window]), (int(g), int(p) - s)) == (int(g), int(p) - s)
            assert sum(stop - first) == len(h) - window + 1
    finally:
        substring._BLOCK = block


def removed(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("many", [1024, 1])  # with 1, all hashes that repeat are split
def test_window_index_in_batches(spark, tmp_path, monkeypatch, many):
    monkeypatch.setattr(substring, "share", lambda rows, parts: many)
    batches = [[(10 * b + i, f"{prose(b, 8)} {prose(50 + (b + i) % 4, 14)} {prose(70 + i, 5)}") for i in range(4)] for b in range(4)]
    opened = lambda: substring.WindowIndex(spark, f"file://{tmp_path}/windows", window=10, gram=3, buckets=4, most_runs=2)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    before = []
    for n, b in enumerate(batches):
        expected = brute_repeats([t for _, t in b], 10, [t for _, t in before])
        for history in (before, before + b):  # run again, and with a corpus that the batch has landed in
            got = removed(substring.without_repeats(frame(b), opened(), batch=str(n), history=frame(history) if history else None))
            assert [got[k] for k, _ in b] == expected
        before += b
    index = opened()
    assert len(index.runs()) <= 3 and [x for r in index.runs() for x in r["batches"]] == ["0", "1", "2", "3"]
    total = sum(index.places(r).count() for r in index.runs())
    index.compact()
    (run,) = index.runs()
    assert index.places(run).count() == run["places"] == total == index.keys(run).agg(F.sum("n")).first()[0]
    assert index.places(run).select("h", "s").distinct().count() <= index.keys(run).agg(F.sum("salts")).first()[0] and (many > 1 or index.keys(run).agg(F.max("salts")).first()[0] > 1)
    with pytest.raises(ValueError, match="merged"):
        index.add(frame(batches[0]), batch="0", history=frame(before))
    with pytest.raises(ValueError, match="windows of 10"):
        substring.WindowIndex(spark, f"file://{tmp_path}/windows")


@pytest.mark.parametrize("lost_at", ["add", "compact"])
def test_window_index_after_a_lost_driver(spark, tmp_path, monkeypatch, lost_at):
    """The driver goes when a run is written and doesn't count yet, of a batch or of a merge; then all is done again."""
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first, second = [(1, prose(1, 40)), (2, prose(2, 40))], [(3, prose(3, 20) + " " + prose(1, 30)), (4, prose(4, 50))]
    opened = lambda: substring.WindowIndex(spark, f"file://{tmp_path}/windows", window=10, gram=3, buckets=2)
    substring.without_repeats(frame(first), opened(), batch="a").collect()
    if lost_at == "compact":
        substring.without_repeats(frame([(9, prose(9, 30))]), opened(), batch="b", history=frame(first)).collect()
    index = opened()
    runs = index.runs()

    def lost(self, state):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(common.Manifest, "write", lost)
        with pytest.raises(KeyboardInterrupt):
            index.compact() if lost_at == "compact" else index.add(frame(second), batch="c", history=frame(first))
    assert opened().runs() == runs
    history = frame(first + second + [(9, prose(9, 30))])
    got = removed(substring.without_repeats(frame(second), opened(), batch="c", history=history))
    assert [got[k] for k, _ in second] == brute_repeats([t for _, t in second], 10, [t for _, t in first])
    opened().compact()
    assert len(opened().runs()) == 1 and len([n for n in common.names_in(spark, index.path) if n.startswith("run-")]) == 1


def test_repeats_of_wide_windows(spark, tmp_path):
    """An anchor may have more windows than an int has bits."""
    shared = [prose(40 + i, 150 + 30 * i) for i in range(4)]
    docs = [(10 * i + j, f"{prose(200 + 10 * i + j, 45)} {t} {prose(300 + 10 * i + j, 60)}") for i, t in enumerate(shared) for j in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for window, gram in ((50, 8), (39, 8), (120, 4)):
        index = substring.WindowIndex(spark, f"file://{tmp_path}/wide-{window}", window=window, gram=gram, buckets=4)
        got = removed(substring.without_repeats(df, index, batch="0"))
        assert [got[k] for k, _ in docs] == brute_repeats([t for _, t in docs], window)


def test_words_in(spark):
    values = [None, "", " ", "a", " a b ", "a b", "a\x0bb\tc\r\nd", "\na", "a\n", "x" * 10]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", common.words_in(F.col("t")).alias("n"))
    assert [r.n for r in rows.orderBy("i").collect()] == [len([w for w in re.split(GAP, v or "") if w]) for v in values]
