"""Encoding, packing and counting against the libraries and plain loops."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer, models

from lodestone.llm import bpe, packing, tokencount
from lodestone.llm.common import tokenizer_path

ODD = [
    "", " ", "  a  b\n\nc \n d\t e", "it's  I'LL we're'x don't 's 't 12'34", "<|endoftext|>hi <|endoftext|><|startoftext|> z", "ÀÉ é ΣΑΣ Σ İstanbul ß µ ª º ²³¹ ¼",
    "日本語 テキスト 123 4567 　 x\x1cy\x85z q\xa0w", "á ́b", "🎉🎉 👩‍👩‍👧", "x" * 3000, "ab" * 999, "\x00\x01 \x7f", "ǅ ǆ ﬁ Å K", "a\r\nb\r\n\r\n c", "١٢٣ ½ Ⅷ", "...!!! *** aaa aaaa aaaaa",
]


def texts(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(120).collect()]


def rows(spark, values, extra=""):
    data = [(i, v, "x") for i, v in enumerate(values)]
    return spark.createDataFrame(data, "doc_id long, text string, n_tokens string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(spark, sf, name):
    some = ODD + texts(spark, sf)
    coder = bpe.Encoder(open(tokenizer_path(name), encoding="utf-8").read(), memo_words=500)
    tk = Tokenizer.from_file(tokenizer_path(name))
    for _ in range(2):  # the memo turns over in between
        got = [x for a, b in bpe.in_groups(some, 20_000) for x in coder.encode(some[a:b])]
        want = [e.ids for e in tk.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    if name.startswith("byte"):
        assert [coder.decode(g) for g in got] == [tk.decode(w, skip_special_tokens=False) for w in want]
        assert coder.decode(np.array([255, 60000], "<u4").tobytes()) == tk.decode([255], skip_special_tokens=False)


def test_random_texts_equal_the_library():
    rng = random.Random(3)
    some = ["".join(rng.choice("ab 'sé\n\t 12.!Σ日") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        coder, tk = bpe.Encoder(open(tokenizer_path(name), encoding="utf-8").read()), Tokenizer.from_file(tokenizer_path(name))
        assert [np.frombuffer(g, "<u4").tolist() for g in coder.encode(some)] == [e.ids for e in tk.encode_batch(some, add_special_tokens=False)]


def test_encode_query(spark):
    df = rows(spark, [*ODD, None, "a", "a"])
    got = {r.doc_id: r for r in bpe.encode_decode(df, keep_ids=True).collect()}
    tk = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for i, t in enumerate([*ODD, "", "a", "a"]):
        ids = tk.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids == ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0)).count() == 0


def check_packing(pieces, docs, limits, quiet):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for i, ids in docs.items():
        parts = sorted(by_doc[i], key=lambda p: p.start)
        assert [x for p in parts for x in p.ids] == ids and [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
        for p in parts:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
            assert p.loss_tokens == p.length - min(p.length, max(0, quiet.get(i, 0) - p.start))
    for parts in by_seq.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
        assert sum(p.length for p in parts) <= limits[0] and len(parts) <= limits[1] and sum(p.loss_tokens for p in parts) <= limits[2]
    return by_seq


@pytest.mark.parametrize("limits", [(2048, 64, 2048), (100, 3, 40), (64, 1, 64)])
def test_packing(spark, sf, limits):
    some = texts(spark, sf) + [None, "", "word", "word"]
    quiet = {i: (i * 37) % 300 for i in range(len(some))}
    df = spark.createDataFrame([(i, t, quiet[i], "x") for i, t in enumerate(some)], "doc_id long, text string, quiet int, length string").repartition(3)
    pieces = packing.pack(df, max_tokens=limits[0], max_segments=limits[1], max_loss=limits[2], quiet_col="quiet", keep_ids=True).collect()
    tk = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = {i: [*tk.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(some)}
    check_packing(pieces, docs, limits, quiet)
    pieces = packing.pack(df, max_tokens=limits[0], max_segments=limits[1], max_loss=limits[2], keep_ids=True).collect()
    check_packing(pieces, docs, limits, {i: len(tk.encode(t.split("\n")[0], add_special_tokens=False).ids) if t and "\n" in t else 0 for i, t in enumerate(some)})


def test_the_dot_product_is_not_the_longest_fit():
    """What is scarce in a sequence counts more: a shorter item with loss goes before a longer one without."""
    packer = packing.Packer(100, 8, 50, least_cut=1)
    placed = [(item, length, sequence) for item, _, length, _, sequence, _ in packer.place(np.array([60, 50, 30, 20]), np.array([60, 0, 30, 15]))]
    assert placed[0] == (1, 50, 0) and placed[1] == (2, 30, 0)  # 60 no longer fit after 50
    placed = [(item, sequence) for item, *_, sequence, _ in packing.Packer(100, 8, 50).place(np.array([40, 45, 50]), np.array([0, 45, 0]))]
    assert placed == [(2, 0), (1, 0), (0, 1)]  # the loss limit keeps 40 out although it would fit beside 50
    packer = packing.Packer(100, 2, 100)
    assert [s for *_, s, _ in packer.place(np.array([10, 10, 10, 10, 10]), np.zeros(5, dtype=int))] == [0, 0, 1, 1, 2]


def test_hard_rows_are_packed_whole(spark):
    hard = [(1, None), (2, ""), (None, "a b"), (3, "word " * 5000), (3, "word " * 5000), (4, "x" * 200_000), (5, "one\n" * 3000), (6, "\n\nword")]
    df = spark.createDataFrame([(i, t, 1, "o", 7) for i, t in hard], "doc_id long, text string, length int, offset string, sequence_id int").repartition(2)
    tk = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = packing.pack(df, keep_ids=True).collect()
    want = sorted((-1 if i is None else i, len(tk.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in hard)
    whole = {}
    for p in pieces:
        whole[-1 if p.doc_id is None else p.doc_id] = whole.get(-1 if p.doc_id is None else p.doc_id, 0) + p.length
    assert whole == {i: sum(n for j, n in want if j == i) for i, _ in want}
    for i, t in hard:
        starts = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
        assert sum(n for s, n in starts) == sum(n for j, n in want if j == (-1 if i is None else i))
    assert max(sum(p.length for p in pieces if p.sequence_id == s) for s in {p.sequence_id for p in pieces}) <= 2048


def test_long_and_repeated_rows(spark):
    """Megabyte words, null and repeated ids and clashing columns in encoding and counting."""
    some = ["y" * 300_000, "ab cd " * 60_000, "q" * 70 + " q", None, "same", "same"]
    df = spark.createDataFrame([(None if i > 3 else 1, t, "a", "b", 3) for i, t in enumerate(some)], "doc_id long, text string, ids_sha256 string, n_words string, n_tokens int").repartition(3)
    tk = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = bpe.encode_decode(df).collect()
    want = [(None if i > 3 else 1, len(tk.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(some)]
    assert sorted(map(str, ((r.doc_id, r.n_tokens) for r in got))) == sorted(map(str, want))
    counted = tokencount.count_tokens(df).collect()
    assert sorted((r.doc_id is None, r.n_words) for r in counted) == sorted([(False, 1), (False, 120_000), (False, 2), (False, 0), (True, 1), (True, 1)])


def test_memos_are_bounded_in_bytes():
    coder = bpe.Encoder(open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8").read())
    coder.encode([f"{'w' * 1000}{i} ok" for i in range(50)])
    assert max(map(len, coder.memo)) <= bpe.MEMO_CHARS
    counter = tokencount.Counter([("a", -1.0)])
    counter.count(["a" * 5000 + " a"])
    assert max(map(len, counter.memo)) <= tokencount.MEMO_CHARS


def test_little_padding(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = packing.pack(df).groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert r.sum() / (2048 * len(r)) > 0.98
    assert packing.pack(df.limit(0)).count() == 0


def test_unigram_counts_equal_the_library(spark, sf):
    pieces = tokencount.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    words = sorted({w for t in texts(spark, sf)[:40] + ODD for w in t.split()} | {"日本", "q" * 50})
    unigram = models.Unigram([("<unk>", -100.0), *pieces], 0, False)
    counter = tokencount.Counter(pieces)
    plain = [w for w in words if all(counter.tails.get(c) is not None for c in w)]
    assert len(plain) > 500
    got = dict(zip(words, counter.walk(words)))
    assert [got[w] for w in plain] == [len(unigram.tokenize("▁" + w)) for w in plain]
    strange = next(c for c in map(chr, range(0x10330, 0x10400)) if c not in counter.tails)
    assert counter.walk([strange + "x" + strange]) == [1 + 4 + 1 + 4]


def test_unigram_against_every_segmentation():
    counter = tokencount.Counter([("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("▁a", -4.0), ("bab", -4.4), ("ba", -4.5)])

    def best(text):
        if not text:
            return (0.0, 0)
        out = []
        for k in range(1, len(text) + 1):
            own = counter.tails.get(text[:k])
            if own is not None:
                s, n = best(text[k:])
                out.append((own + s, n + 1))
        if counter.tails.get(text[0]) is None:
            s, n = best(text[1:])
            out.append((counter.unknown + s, n + len(text[0].encode())))
        return max(out, key=lambda x: (round(x[0], 9), -x[1]))

    words = sorted({"".join(random.Random(i).choices("abé", k=1 + i % 8)) for i in range(300)})
    assert counter.walk(words) == [best("▁" + w)[1] for w in words]


def test_count_query(spark):
    df = rows(spark, [*ODD, None, "a b", "a b"])
    got = {r.doc_id: (r.n_tokens, r.n_words) for r in tokencount.count_tokens(df).collect()}
    assert got[0] == (0, 0) and got[len(ODD)] == (0, 0) and got[len(ODD) + 1] == got[len(ODD) + 2] and got[len(ODD) + 1][1] == 2
    assert tokencount.count_tokens(df.limit(0)).count() == 0
