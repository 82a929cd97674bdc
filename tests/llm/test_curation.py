"""Mixing, personal data, preferences, quality, the pipeline, the entry module."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, mixing, pii, quality
from quarry.llm import queries as q

from .conftest import prose, texts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_oracle(spark, name):
    for t in ("documents", "labels", "conversations"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want, got = duckdb.sql(q.SQL[name]).df(), q.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    order = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(want), order(got))


def filled(sizes, weights):
    """Targets by resharing again and again what is over the limits."""
    total, left, out = 1.5 * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while left:
        share = total / sum(weights[i] for i in left)
        over = [i for i in left if share * weights[i] > 2 * sizes[i]]
        for i in over or left:
            out[i] = 2.0 * sizes[i] if over else share * weights[i]
        if not over:
            break
        total -= sum(out[i] for i in over)
        left -= set(over)
    return out


def test_mix(odd, none, spark):
    docs = spark.createDataFrame([(i, prose(i, 5 + i % 30), f"s{i % 7}" if i % 7 < 6 else None) for i in range(900)], "doc_id long, text string, source string").where("source IS NULL OR source <> 's1' OR doc_id % 3 = 0")
    got = mixing.mix_report(docs).collect()
    assert got == mixing.mix_report(docs).collect() or sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(docs.repartition(3)).collect()))
    of = collections.defaultdict(list)
    for d, r in zip(sorted(docs.collect(), key=lambda d: d.doc_id), sorted(got, key=lambda r: r.doc_id), strict=True):
        assert r.size == len(d.text.split()) and r.taken in (0, r.size, 2 * r.size)
        of[d.source].append(r)
    names = sorted((s for s in of if s is not None)) + [None]
    sizes = [sum(r.size for r in of[s]) for s in names]
    for s, size, target in zip(names, sizes, filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True):
        assert all(r.source_size == size and r.target == pytest.approx(target) for r in of[s])
        assert abs(sum(r.taken for r in of[s]) - target) <= max(r.size for r in of[s])
        times = {r.taken // r.size for r in of[s]}
        assert max(times) - min(times) <= 1  # whole epochs come first
    repeated = mixing.mix(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in repeated} == {r.doc_id: r.taken // r.size for r in got if r.taken}
    assert len(mixing.mix_report(odd).collect()) == odd.count() and mixing.mix(odd).columns == odd.columns
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


def test_weights_decide_what_a_fraction_takes(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", 4.0 if i % 2 else 0.25) for i in range(2000)], "doc_id long, text string, source string, w double")
    taken = {r.doc_id for r in mixing.mix_report(docs, weight=F.col("w"), share=0.3, most=1.0).collect() if r.taken}
    assert abs(len(taken) - 600) <= 1 and sum(i % 2 for i in taken) > 500


def test_base_spans_follow_the_patterns():
    words = ["a.b@c.d", "@x.y", "a@b", "q@w.e@r.t", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 555-1234", "+1 2", "4111-1111-1111-1111 2", "ü@x.yz", "+12345678901234567"]
    rng = np.random.default_rng(2)
    for _ in range(300):
        t = " ".join(rng.choice(words, 6))
        email = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        ip = [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) < 256 for p in m[0].split("."))]
        card = [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        phone = [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(t) == email + ip + card + phone
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_addresses_with_very_long_parts():
    assert pii.base_spans("1.2.3." + "9" * 5000) == [] and pii.base_spans("at " + "1" * 5000 + ".2.3.4 x") == []
    zeros = "1.2.3." + "0" * 5000
    assert pii.base_spans(zeros) == [(1, 0, len(zeros))] and pii.base_spans(zeros + "255") == [(1, 0, len(zeros) + 3)] and pii.base_spans(zeros + "256") == []
    assert pii.Chooser().spans("1.2.3." + "9" * 5000)[1] == []


#: Sentences that neither trees nor thresholds know, with what should be added in <>.
WRITTEN = [
    "Ring me on <(415) 555-0134> before noon.", "The clinic: <212-555-0187>, ask for Dr. Lee.", "<617.555.0175> is the night line.", "Visa <4539 1488 0343 6467> 8273 1232 7351 0569", "It was <4012888888881881>4012 again",
    "paid by card <6011.0009.9013.9424> on Monday", "write to <jane.doe [at] example [dot] org> for a copy", "contact <sales(at)northwind.com> today", "mail <k_miller at gmx dot de> and wait", "ping <10 . 0 . 0 . 17> first", "we blocked <203[.]0[.]113[.]9> last week",
    "server <192. 168. 7. 21> is down", "Tel <001 646 555 0143>", "fax <(0xx)>".replace("<(0xx)>", "none"),
    "The parts 100-200-3000-4 and 7 are sold.", "ISBN 978-0-306-40615-7 is a reprint.", "Chapter 4. 2. 1. 9 says so.", "On 12.05.2021 we sold 1200 units at 14.50.", "He looked at the dot on the page. Then he left.", "Build 10.20.30.400 failed at 17:45:12.", "Total 12 345 678 901 234 567 of all", "order no. 20240131-000017-22 shipped",
    "IBAN DE89 3704 0044 0532 0130 00 is ours", "pi is 3.14159265358979 and e is 2.71828182845904", "lat 48.858370 lon 2.294481", "a[at] = b[dot] in the listing", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", "tracking 1Z999AA10123456784 arrived", "see fig. 3. 1. 2. 4 and table 7", "0000000000000000 is a placeholder",
]


def test_added_spans():
    choose = pii.Chooser()
    assert len(set(choose.threshold)) == 4 and all(0.3 < t < 1 and t != 0.5 for t in choose.threshold)
    made = pii.cases(np.random.default_rng(99), 150, 1) + pii.examples(np.random.default_rng(98), 150)  # other fillings of forms, other examples
    for kind in range(4):
        seen = [e for e in made if e[1] == kind]
        right = [choose.trees.predict(np.array([pii.features(*e[:4])]))[0] >= choose.threshold[kind] for e in seen]
        good = np.array([e[4] for e in seen])
        assert good[right].mean() > 0.97 and np.array(right)[good].mean() > 0.9, (kind, good[right].mean(), np.array(right)[good].mean())
    hit = wrong = wanted = 0
    for sentence in WRITTEN:
        text = re.sub("[<>]", "", sentence)
        base, spans = choose.spans(text)
        added = {text[a:b] for k, a, b in spans if (k, a, b) not in base}
        want = set(re.findall("<(.*?)>", sentence)) - {text[a:b] for _, a, b in base}
        hit, wrong, wanted = hit + len(added & want), wrong + len(added - want), wanted + len(want)
    assert wanted >= 12 and hit / wanted >= 0.75 and hit / (hit + wrong) >= 0.85, (hit, wrong, wanted)
    both = "pay 4111111111111111 4242424242424242 ok"
    assert choose.spans(both)[0] == [] and pii.joined(choose.spans(both)[1]) == "card:4:20,card:21:37"
    for clean in ("order 1234567 of 2024-01-02", "version 10.20.30", "look at the dot here", "It was 12 or 13. At 4 it was 5.", "", "token = \"24be64439e3e49cf46b2d7c90f3602a3\""):
        assert choose.spans(clean)[1] == []
    assert pii.redact("mail a@b.c or 1.2.3.4", choose.spans("mail a@b.c or 1.2.3.4")[1]) == "mail [email] or [ip]"


@pytest.mark.parametrize("text", ["x" * 300_000 + " (at) b", "1" * 300_000, "1." * 100_000, "1 2 " * 40_000, "a@" * 100_000 + " (dot)", "+1 " * 60_000, "4111111111111111 " * 8_000, "(at)" * 50_000 + "(dot)", "a (at) b" + " dot b" * 40_000])
def test_time_is_in_proportion(text):
    import time

    choose = pii.Chooser()
    took = []
    for part in (text[: len(text) // 4], text):
        began = time.process_time()
        base, spans = choose.spans(part)
        took.append(time.process_time() - began)
        assert set(base) <= set(spans)
    assert took[1] < 10 * took[0] + 1 and took[1] < 20


def brute_base(t):
    """The contract's patterns as they are written, on code points."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def check_detected(rows, docs):
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(k for k, _ in docs)
    hits, by_text = collections.Counter(), {(k, hashlib.sha256(",".join(f"{n}:{s}:{e}" for n, s, e in brute_base(t)).encode()).hexdigest()): (t, brute_base(t)) for k, t in docs}
    for r in rows:
        t, base = by_text[r.doc_id, r.base_sha256]  # an unequal digest has no entry
        of = collections.Counter(n for n, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(of[k] for k in pii.KINDS)
        spans = [(n, int(a), int(b)) for n, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(base) <= set(spans) and len(spans) == len(base) + r.n_added and all(0 <= a < b <= len(t) for _, a, b in spans)
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        hits.update(of)
    return hits


def test_detect(spark, odd, none):
    assert check_detected(pii.detect(odd).collect(), texts(odd)) == {"email": 1, "ip": 1, "card": 1, "phone": 1}
    words = ["\U0001f600", "a.b@c.de", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 555-1234", "é", "4111111111111112", "1.2.3.4.5", "x@y", "1" * 5000, "\n", "jo (at) ab (dot) com", "12-34"]
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words, 9))) for i in range(300)] + [(None, None), (7, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hits = check_detected(pii.detect(docs).collect(), texts(docs))
    assert min(hits[k] for k in pii.KINDS) > 50
    real = spark.read.parquet(f"{SF}/documents.parquet")
    assert sum(check_detected(pii.detect(real).collect(), texts(real)).values()) > 0
    assert pii.detect(none).count() == 0


def test_preferences(spark):
    turns = [(0, 0, "system", "s"), (0, 1, "user", "q"), (0, 2, "assistant", "good"), (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"), (1, 3, "user", "x"), (2, 0, "user", "a"), (4, 1, None, None), (5, 1, None, ""), (6, 0, "user", "t"), (6, 0, "user", "t"), (7, 0, "user", "t"), (None, 0, "user", "u")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv long, turn long, role string, text string, pair_id long")
    got = {r.pair_id: r for r in chat.preferences(df, pair=F.floor(F.col("conv") / 2), side=F.col("conv") % 2).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    r = got[0]
    assert (r.prompt_turns, r.prompt, r.chosen) == (2, "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n", "<|assistant|>\ngood<|end|>\n")
    assert r.rejected == "<|assistant|>\nbad<|end|>\n<|user|>\nx<|end|>\n"
    cut = lambda t, spans: [t[int(a) : int(b)] for a, b in (s.split(":") for s in spans.split(","))]
    assert cut(r.chosen, r.chosen_loss) == ["good<|end|>\n"] and cut(r.rejected, r.rejected_loss) == ["bad<|end|>\n"]
    assert (got[1].prompt_turns, got[1].rejected, got[1].chosen_loss) == (0, None, "")
    assert (got[2].prompt_turns, got[2].chosen, got[2].rejected) == (1, "", "")
    assert (got[3].prompt_turns, got[3].chosen, got[3].rejected) == (1, "<|user|>\nt<|end|>\n", "")
    assert chat.preferences(df.where("conv < 0"), pair=F.col("conv"), side=F.col("conv")).count() == 0


def test_against_earlier_answers(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 2, "user", "more"), (1, 3, "assistant", "last \U0001f600"), (1, 4, "user", "bye"), (2, 0, "user", "q"), (2, 1, "assistant", "only"), (3, 0, "user", "q"), (3, 0, "user", "q"),
        (4, 0, "assistant", "same"), (4, 1, "assistant", "same"), (5, None, None, None), (5, 1, "assistant", None), (6, 0, "assistant", "x"), (6, 0, "assistant", "x"), (None, 0, "user", "u"),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv long, turn long, role string, text string, pair_id long")
    got = {r.pair_id: r for r in chat.against_earlier_answers(df, conversation=F.col("conv"), declined="no.").collect()}
    show = lambda *turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)
    r = got[1]
    assert (r.prompt_turns, r.prompt) == (3, show(("user", "q"), ("assistant", "first"), ("user", "more")))
    assert r.chosen == show(("assistant", "last \U0001f600"), ("user", "bye")) and r.rejected == show(("assistant", "first"), ("user", "bye"))
    cut = lambda t, spans: [t[int(a) : int(b)] for a, b in (s.split(":") for s in spans.split(",") if s)]
    assert cut(r.chosen, r.chosen_loss) == ["last \U0001f600<|end|>\n"] and cut(r.rejected, r.rejected_loss) == ["first<|end|>\n"]
    assert (got[2].prompt_turns, got[2].chosen, got[2].rejected) == (1, show(("assistant", "only")), show(("assistant", "no.")))
    assert (got[3].prompt_turns, got[3].chosen, got[3].rejected, got[3].chosen_loss) == (2, "", "", "")
    assert (got[4].prompt_turns, got[6].prompt_turns) == (2, 2)
    assert (got[5].prompt_turns, got[5].chosen, got[5].rejected) == (1, show(("assistant", "")), show(("assistant", "no.")))
    assert set(got) == {1, 2, 3, 4, 5, 6} and chat.against_earlier_answers(df.where("conv < 0"), conversation=F.col("conv"), declined="").count() == 0
    real = q.op8_preferences(spark, SF)
    assert real.where("prompt_turns > 0 AND prompt <> '' AND chosen <> rejected").count() > 0.7 * real.count()


def test_votes_against_brute_force(spark):
    """Trigram counts, weights and votes, in plain Python; the fitted basis is taken from the voter."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    voter = quality.fit(docs, labels)

    def features(t):
        b, out = t.encode(), [0] * (2048 + 3)
        for i in range(len(b) - 2):
            out[((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 21] += 1
        w = t.split()
        for lag in (1, 2, 3):
            out[2047 + lag] = 16 * sum(x == y for x, y in zip(w, w[lag:]))  # noqa: B905
        return np.array(out, float) if len(b) > 2 else np.zeros(2051)

    text = {r.doc_id: r.text or "" for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    x = {i: np.sqrt(features(text[i])) for i in text}
    seen = np.array([x[i] for i in known])
    idf = np.log((1 + len(known)) / (1 + (seen > 0).sum(axis=0))) + 0.1
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    latent = {i: unit(unit(x[i] * idf) @ voter.basis) for i in text}
    got = {r.doc_id: r.score for r in quality.score(docs, voter).collect()}
    for i in list(text)[:60]:
        near = sorted(((float(latent[i] @ latent[j]), j) for j in known), reverse=True)[:25]
        w = [min(max(c, 0), 1) ** 8 for c, _ in near]
        expected = sum(a * known[j] for a, (_, j) in zip(w, near, strict=True)) / sum(w) if sum(w) > 1e-12 else np.mean(list(known.values()))
        assert got[i] == pytest.approx(expected, abs=2e-3), i


def test_a_repeated_key_comes_to_the_driver_once(spark):
    a, b = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = spark.createDataFrame([(a, f"text {i % 3}") for i in range(900)] + [(b, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(a, 1), (b, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels).y.tolist() == [1, 0]


def test_quality(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    got = q.op9_quality(spark, sf).toPandas().set_index("doc_id")
    marks = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got.index) and got.score.between(0, 1).all()
    held = [i for i in marks.index if got.held_out[i]]
    right = [got.predicted[i] == marks[i] for i in held]
    assert np.mean(right) > 0.95 and np.mean([got.predicted[i] for i in held if marks[i] == 1]) > 0.98
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, 1), (7, None), (None, 1), (3, 1), (9, 0), (99, 1)], "doc_id long, quality int")
    rows = quality.score(odd, quality.fit(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(none, quality.fit(none, labels)).count() == 0
    assert all(r.score == 0.5 for r in quality.score(odd, quality.fit(odd, labels.where("doc_id < 0"))).collect())


def drawn(docs):
    """How often each document is taken: whole epochs, then a prefix by exponential keys, all in one list."""
    rows = collections.defaultdict(list)
    for k, source, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        weight = max(0.05, len(set(w)) / len(w) * (1 - sum(t.count(m) for m in "!|*$") / len(t))) if w else 0.05
        u = (int(hashlib.md5(f"mix{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rows[source].append((-math.log(u) / weight, k, len(w)))
    names = sorted(x for x in rows if x is not None) + [None] * (None in rows)
    sizes = [sum(n for _, _, n in rows[s]) for s in names]
    times = {}
    for s, size, target in zip(names, sizes, filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True):
        epochs, run = int(target // size) if size else 0, 0
        for _, k, n in sorted(rows[s]):
            run += n
            times[k] = epochs + (2 * run - n < 2 * (target - epochs * size))
    return {k: n for k, n in times.items() if n}


def test_pipeline(spark, tmp_path, tokenizer):
    """Each stage over what the one before kept, against plain Python."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {"documents": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.toPandas()
        assert name == "packing" or docs.columns == columns
    scores = quality.score(spark.read.parquet(f"{SF}/documents.parquet"), quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")))
    assert set(seen["quality"].doc_id) == {r.doc_id for r in scores.where("predicted = 1").collect()}
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    groups = collections.defaultdict(list)
    for i, t in zip(seen["quality"].doc_id, seen["quality"].text, strict=True):
        groups[strip(t)].append((-len(t), i))
    assert set(seen["exact-dedup"].doc_id) == {min(v)[1] for v in groups.values()} and len(seen["exact-dedup"]) == len(groups)
    near = seen["near-dedup"]
    assert set(near.doc_id) <= set(seen["exact-dedup"].doc_id) and near.doc_id.is_unique

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    came = sorted(zip(seen["exact-dedup"].doc_id, seen["exact-dedup"].text, strict=True))
    s, first = [shingles(t) for _, t in came], list(range(len(came)))
    for n, a in enumerate(s):
        for m in range(n):
            if len(a & s[m]) >= 0.8 * len(a | s[m]):
                low, high = sorted((first[n], first[m]))
                first = [low if f == high else f for f in first]
    assert set(near.doc_id) == {came[f][0] for f in first} and len(near) < len(came)
    times = collections.Counter(seen["mixing"].doc_id)
    assert times == drawn([(r.doc_id, r.source, r.text) for r in near.itertuples()])
    from quarry.llm.tokens import TextEncoder

    e = TextEncoder(tokenizer)
    assert seen["packing"].length.sum() == sum(len(e.encode(t)) // 2 + 1 for t in seen["mixing"].text)
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_stages_over_odd_rows(spark, odd, none, tmp_path):
    """All stages take nulls, repeats, long texts and columns with clashing names, and keep the columns of their input."""
    import corpus_pipeline

    for given in (odd, none):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert name == "packing" or docs.columns == odd.columns
            docs.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            assert docs.count() > 0 or given is none


def test_queries_carry_their_columns(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in found} and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    columns = {
        "op1_token_records": "doc_id start n_tokens ids_crc32", "op3_simhash": "doc_id fingerprint component_id", "op4_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op6_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op7_repeats": "doc_id n_words n_removed kept_sha256", "op9_quality": "doc_id held_out score predicted",
        "op10_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    }
    for name, cols in columns.items():
        df = found[name](spark, SF)
        assert set(cols.split()) <= set(df.columns) and df.count() >= 200, name


def test_texts_helper(odd):
    assert len(texts(odd)) == odd.count()
