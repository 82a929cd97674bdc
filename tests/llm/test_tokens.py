"""Token records and packing: exact round trips."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import packing, queries, records
from quarry.llm.tokens import TextEncoder

from .conftest import prose, texts

PLAIN: dict = {}
ODD = ["", "\n", " ", "  a", "a ", "\na", "a\n\nb", "a  b", "a\tb c", "<|endoftext|> x", "don't 12 3. we's", "é à\x1cb", "a \n b", "日本 語 x1", "a\r\nb", "x, y!! z*** É, é! é́ a", "a_b c-d", " a b", "a​b c", "'s 's", "Ωx, ß."]


def ids(tokenizer, text, end):
    """What the library itself gives, with nothing set."""
    if tokenizer not in PLAIN:
        PLAIN[tokenizer] = Tokenizer.from_file(tokenizer)
    return PLAIN[tokenizer].encode(text, add_special_tokens=False).ids + [end]


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_words_give_the_same_ids_as_whole_texts(tokenizer):
    e = TextEncoder(tokenizer, cap=16)  # a small cache, that often starts anew
    assert e.by_word
    for t in [*ODD, prose(5, 300), "Aa, b.\nCc dd\nee " + prose(6, 50)]:
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_added_tokens_are_encoded_as_the_library_does(tokenizer):
    e, plain = TextEncoder(tokenizer), Tokenizer.from_file(tokenizer)
    for t in [*ODD, "a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|><|endoftext|>y", "a <|endoftext| > b"]:
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert np.frombuffer(e.encode("a <|endoftext|> b"), e.dtype).tolist() == [64, 220, 50256, 275]


def test_frames():
    data = b"".join(records.frame(k, i, 2) for k, i in ((5, b"\x01\x00"), (None, b""), (-3, b"\x02\x00\x03\x00")))
    import io

    read = io.BytesIO(data).read
    assert [records.unframe(read) for _ in range(4)] == [(5, 2, b"\x01\x00"), (None, 2, b""), (-3, 2, b"\x02\x00\x03\x00"), None]
    for at in (3, 9, 14, 24, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        read = io.BytesIO(bytes(broken)).read
        with pytest.raises(ValueError):
            while records.unframe(read) is not None:
                pass


def test_records_round_trip(spark, odd, none, tokenizer, tmp_path):
    root = f"file://{tmp_path}/records"
    got = [tuple(r) for r in records.token_records(odd, tokenizer, root=root).orderBy("start").collect()]
    start, expected = 0, []
    for k, t in sorted(texts(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        v = ids(tokenizer, t, 0)
        expected.append((k, start, len(v), crc(v)))
        start += len(v)
    assert got == expected
    assert records.token_records(none, tokenizer).count() == 0


def test_shards_and_index(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 20)) for i in range(60)], "doc_id long, text string")
    root = f"file://{tmp_path}/shards"
    manifest = records.write_records(docs, root, tokenizer, shard_bytes=500)
    rows = manifest.collect()
    assert len(rows) > 8 and sum(r.records for r in rows) == 60
    at = rows[3]
    keys = [records.read_at(root, at.path, i)[0] for i in range(at.records)]
    assert keys == sorted(keys)
    with open(at.path, "r+b") as f:
        f.seek(30)
        byte = f.read(1)
        f.seek(30)
        f.write(bytes([byte[0] ^ 255]))
    with pytest.raises(Exception, match="damaged"):
        records.read_records(spark, manifest, root).collect()


def check_pieces(rows, docs, tokenizer, capacity):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id, r.doc_tokens].append(r)
    for pieces in by_seq.values():
        offset = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == offset and r.length > 0
            offset += r.length
        assert offset <= capacity
    assert sum(r.length for r in rows) == sum(len(ids(tokenizer, t, 1)) for _, t in docs)
    made = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    for k, t in docs:
        v, covered = ids(tokenizer, t, 1), 0
        for r in sorted(by_doc[k, len(v)], key=lambda r: r.start):
            if r.start == covered and made[k, r.start, r.length, crc(v[r.start : r.start + r.length])] > 0:
                made[k, r.start, r.length, r.ids_crc32] -= 1
                covered += r.length
        assert covered == len(v), (k, covered, len(v))
    assert not any(made.values())
    return by_seq


@pytest.mark.parametrize("parts", [1, 5])
def test_packing(odd, none, tokenizer, parts):
    docs = texts(odd)
    rows = odd.coalesce(1) if parts == 1 else odd.orderBy(F.desc("n_chars"), F.rand(3)).repartition(parts)  # another order of rows, other partitions
    by_seq = check_pieces(packing.pack(rows, tokenizer).collect(), docs, tokenizer, 2048)
    sizes = [sum(r.length for r in p) for p in by_seq.values()]
    assert all(s == 2048 or s & (s - 1) == 0 for s in sizes)
    assert packing.pack(none, tokenizer).count() == 0


def test_each_limit_stops_sequences(spark, tokenizer):
    """The query's own limits on a real table, in several partitions: all three bind, and next to nothing is padded."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3).withColumn("head", F.floor(F.char_length("text") / queries.HEAD))
    rows = packing.pack(docs, tokenizer, loss_from="head", capacity=queries.CAPACITY, max_segments=queries.SEGMENTS, max_loss=queries.LOSS).collect()
    by_seq = check_pieces(rows, texts(docs), tokenizer, 2048)
    size = {s: sum(r.length for r in p) for s, p in by_seq.items()}
    loss = {s: sum(r.loss_tokens for r in p) for s, p in by_seq.items()}
    assert all(len(p) <= queries.SEGMENTS and loss[s] <= queries.LOSS for s, p in by_seq.items())
    share = lambda of: sum(of) / len(by_seq)
    assert share(n == 2048 for n in size.values()) > 0.95 and 0.1 < share(n == queries.LOSS for n in loss.values()) < 0.9
    assert sum(2048 - n for n in size.values() if n & (n - 1)) < 0.005 * sum(size.values())
    few = packing.pack(docs, tokenizer, loss_from="head", capacity=2048, max_segments=5, max_loss=queries.LOSS).groupBy("sequence_id").count()
    assert few.agg(F.max("count")).first()[0] == 5 and few.where("count = 5").count() > 0.2 * few.count()


def test_packing_limits(spark, tokenizer):
    docs = spark.createDataFrame([(i, prose(i, 3 + i % 40), (i * 7) % 60) for i in range(200)], "doc_id long, text string, prompt long")
    rows = packing.pack(docs.coalesce(1), tokenizer, loss_from="prompt", capacity=256, max_segments=4, max_loss=150, block=50).collect()
    by_seq = check_pieces(rows, texts(docs), tokenizer, 256)
    start = {r.doc_id: r.prompt for r in docs.collect()}
    for pieces in by_seq.values():
        assert len(pieces) <= 4 and sum(r.loss_tokens for r in pieces) <= 150
        assert all(r.loss_tokens == max(0, r.start + r.length - max(r.start, start[r.doc_id])) for r in pieces)
