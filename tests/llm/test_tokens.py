import itertools
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chunk_store, packing, token_counts
from tessera.llm.bpe import LibraryEncoder, encoder, prefix_counter, tokenizer
from tessera.llm.common import running_start
from tests.llm.conftest import ODD

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def random_texts(n):
    rng = random.Random(3)
    chars = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA1, 0x180)]] + [" "] * 80 + ["\n"] * 30 + ["'"] * 30 + list("etaoinsrstmdlvre") * 9
    return ["".join(rng.choices(chars, k=rng.randrange(1, 60))) for _ in range(n)] + [t for t in ODD if t]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_ids_are_the_librarys(spark, small, name):
    texts = random_texts(4000) + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    want = [e.ids for e in tokenizer(name).encode_batch(texts, add_special_tokens=False)]
    for enc in (encoder(name), LibraryEncoder(name)):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_all(texts)] == want


def test_count_at_every_prefix():
    tok, counter = tokenizer(BYTE), prefix_counter(BYTE)
    for text in [t for t in random_texts(250) if len(t) < 200] + ["a  b \n\n c   d's we'll x<|endoftext|>y  z", "!!<|endoftext|>  <|endof", "=====    ----" * 9, "I'll I'l I'd 'v 've"]:
        total, steps = counter.prefixes(text)
        counts = np.cumsum(np.frombuffer(steps, "i1"), dtype=int).tolist()
        assert counts == [len(tok.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)] and total == counts[-1]


def test_counts_of_any_text_are_the_programs_own_and_the_librarys():
    rng, tok, counter = random.Random(9), tokenizer(BYTE), prefix_counter(BYTE)
    chars = [chr(c) for c in [*range(1, 33), *range(0x370, 0x400), *range(0x4E00, 0x4E40), 0x2003, 0x3000, 0x200D, 0x1F600, 0x301]] + list("  \n\tab ") * 12
    texts = ["".join(rng.choices(chars, k=rng.randrange(1, 80))) for _ in range(1500)] + ["<|endoftext|>".join(["", "a  ", " b", "中 "] * 3)]
    assert [counter.prefixes(t)[0] for t in texts] == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    for text in texts[:120] + texts[-1:]:
        counts = np.cumsum(np.frombuffer(counter.prefixes(text)[1], "i1"), dtype=int).tolist()
        assert counts == [len(tok.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]


def test_long_runs_of_white_space_take_linear_time():
    for gap in (" ", "\u3000", "\n "):
        text = "中" + gap * 20_000 + "x"
        began = time.perf_counter()
        total, steps = prefix_counter(BYTE).prefixes(text)
        assert time.perf_counter() - began < 5
        assert total == len(tokenizer(BYTE).encode(text, add_special_tokens=False).ids) and len(steps) == len(text)


def test_budgets_from_the_store(spark, odd):
    kept = token_counts.prefix_counts(odd.where("doc_id between 3 and 8"))
    got = kept.select("doc_id", token_counts.count_at(F.col("steps"), F.lit(5)).alias("at5"), token_counts.longest_prefix(F.col("steps"), F.lit(4)).alias("fit")).collect()
    tok = tokenizer(BYTE)
    for r in got:
        count = lambda k, t=ODD[r["doc_id"]]: len(tok.encode(t[:k], add_special_tokens=False).ids)
        assert r["at5"] == count(5)
        assert r["fit"] == max(k for k in range(min(60, len(ODD[r["doc_id"]])) + 1) if count(k) <= 4)


def test_token_report(odd, empty):
    tok = tokenizer(BYTE)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_report(odd).collect())
    want = []
    for r in odd.collect():
        t = r["text"] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        want.append((r["doc_id"] if r["doc_id"] is not None else -1, len(t.encode()), n, n > 512))
    assert got == sorted(want)
    assert token_counts.token_report(empty).count() == 0


def check_packing(docs, rows, capacity):
    tok, pieces, bins = tokenizer(BYTE), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(pieces[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert mine[0]["length"] == (len(ids) % capacity or capacity) and all(r["length"] == capacity for r in mine[1:])
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in rows) // capacity)


def test_packing(spark, small, odd, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    used, least = check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], packing.pack_documents(docs).collect(), 2048)
    assert used <= least + 2
    distinct = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing([(r["doc_id"], r["text"]) for r in distinct.collect()], packing.pack_documents(distinct, 64).collect(), 64)
    assert packing.pack_documents(odd).select("sequence_id", "offset").distinct().count() == packing.pack_documents(odd).count()
    assert packing.pack_documents(empty).count() == 0


def test_exact_complements_come_first():
    plan = packing.plan({60: 2, 40: 1, 25: 1, 15: 1, 30: 1, 7: 3, 9: 1}, 100)
    assert [60, 40] in [p for p, _ in plan] and [60, 25, 15] in [p for p, _ in plan]
    assert packing.plan({}, 100) == []
    assert packing.plan({100: 5}, 100) == [([100], 5)]
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 101, 20), rng.integers(1, 50, 20), strict=True)}
        got = defaultdict(int)
        for items, times in packing.plan(counts, 100):
            assert sum(items) <= 100
            for x in items:
                got[x] += times
        assert got == counts


def test_sums_of_two_and_three_lengths_against_all_combinations():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randrange(1, 40): rng.randrange(1, 3) for _ in range(rng.randrange(1, 12))}
        index = packing.SumIndex(counts, 100)
        for _ in range(12):
            total = rng.randrange(2, 100)
            stock = [x for x in range(101) for _ in range(int(index.n[x]))]
            for k, ask in ((2, index.pair), (3, index.triple)):
                there = {tuple(sorted(c, reverse=True)) for c in itertools.combinations(stock, k) if sum(c) == total}
                assert ask(total) == (max(there) if there else None)
            if got := index.complement(total):
                for x in got:
                    index.n[x] -= 1


def test_running_start_of_sparse_null_and_repeated_keys(spark):
    rng = random.Random(2)
    rows = [(rng.getrandbits(62), rng.randrange(9), i) for i in range(3000)] + [(7, 4, 1)] * 50 + [(None, 5, 2), (None, 6, 3)]
    got = running_start(spark.createDataFrame(rows, "k long, n long, i long"), ["k", "n", "i"], "n", "start").collect()
    at = 0
    for r in sorted(got, key=lambda r: (r["k"] is not None, r["k"] or 0, r["n"], r["i"], r["start"])):
        assert r["start"] == at
        at += r["n"]
    assert len(got) == len(rows)


def check_store(docs, rows):
    tok, at = tokenizer(WORD), 0
    rows = {r["doc_id"]: r for r in rows}
    for doc, text in sorted(docs):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        r = rows[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_store_round_trip(spark, small, odd, empty, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    distinct = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    for k, df in enumerate((docs, distinct, empty)):
        path = f"file://{tmp_path}/s{k}"
        chunk_store.write_store(df, path)
        got = chunk_store.with_starts(chunk_store.read_store(spark, path)).collect()
        assert len(got) == df.count()
        check_store([(r["doc_id"], r["text"]) for r in df.collect()], got)


def test_each_chunk_is_stored_once_and_repeats_come_back(spark, odd, tmp_path):
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(6000))
    rows = [(i, base if i % 3 else base + f" tail {i} " * 200) for i in range(12)] + [(3, base), (3, base), (None, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/s"
    chunk_store.write_store(df, path)
    stored = spark.read.parquet(path)
    held = stored.withColumn("own", F.coalesce("own", F.transform("hashes", lambda h: F.lit(True))))
    held = held.select(F.explode(F.arrays_zip("hashes", "own")).alias("c")).where("c.own").groupBy("c.hashes").count()
    assert held.where("count > 1").count() == 0 and held.count() == stored.select(F.explode("hashes").alias("h")).distinct().count()
    got = chunk_store.read_store(spark, path, keep_ids=True).collect()
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(np.array([*tokenizer(WORD).encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    have = defaultdict(list)
    for r in got:
        have[r["doc_id"]].append(bytes(r["ids"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    ids = [r["doc_id"] for r in stored.withColumn("f", F.input_file_name()).orderBy("f").collect()]
    assert [i for i in ids if i is not None] == sorted(i for i in ids if i is not None)


def test_a_changed_chunk_is_noticed(spark, odd, tmp_path):
    path = f"file://{tmp_path}/s"
    chunk_store.write_store(odd.where("doc_id in (3, 8)"), path)
    bad = spark.read.parquet(path).withColumn("root", F.unhex(F.lit("00" * 16)))
    bad.write.parquet(f"file://{tmp_path}/bad")
    with pytest.raises(Exception, match="Merkle"):
        chunk_store.read_store(spark, f"file://{tmp_path}/bad").collect()


def test_words_kept_by_an_encoder(monkeypatch):
    from tessera.llm import bpe

    monkeypatch.setattr(bpe, "MAX_WORDS", 50)
    enc, lib = bpe.WordEndEncoder(WORD), LibraryEncoder(WORD)
    texts = [*random_texts(300), "a" * 5000 + " it's aaa" * 3, "", "one two one two", "b" * 64 + " " + "b" * 65]
    for t in texts * 2:
        assert enc.encode(t) == lib.encode(t)
        assert not any(len(p) > bpe.LONG_WORD for p in enc.known)
    assert 0 < len(enc.known) <= 50 + max(len(t) for t in texts)


def test_words_in_use_are_encoded_once(monkeypatch):
    from types import SimpleNamespace

    from tessera.llm import bpe

    monkeypatch.setattr(bpe, "MAX_WORDS", 50)
    enc, lib, seen = bpe.WordEndEncoder(WORD), LibraryEncoder(WORD), []
    ranks = enc.ranks
    enc.ranks = SimpleNamespace(encode_to_numpy=lambda text, **k: seen.extend(text.split(enc.MARK)) or ranks.encode_to_numpy(text, **k))
    letters = "abcdefghij"
    for k in range(200):
        text = "These stay: " + " ".join(letters[k // 100] + letters[k // 10 % 10] + letters[k % 10] + x for x in "stuvw")
        assert enc.encode(text) == lib.encode(text)
    assert seen.count("these") == seen.count("stay") == seen.count(":") == 1
    assert len(enc.known) <= 60 and len(enc.older) <= 100


def test_word_pieces_by_kind_of_character(monkeypatch):
    from tessera.llm import bpe

    texts = [t.lower() for t in random_texts(3000) if not bpe._NOT_PLAIN.search(t) and "İ" not in t]
    texts += ["", "'", "''s", "it's's 're've 'llama 're", "x'r 'v 'l'", "9's1½²'t", "."]
    for text in texts:
        codes = np.frombuffer((text + "\n").encode("utf-16-le"), "<u2")
        starts, inside = bpe.word_starts(codes)
        assert ["".join(c for c, k in zip(text[a:b], inside[a:b].tolist()) if k) for a, b in itertools.pairwise([*starts.tolist(), len(text)])] == bpe._WORD_PIECES.findall(text)
    enc, one, lib = bpe.WordEndEncoder(WORD), bpe.WordEndEncoder(WORD), LibraryEncoder(WORD)
    monkeypatch.setattr(bpe, "AT_ONCE", 100)
    mixed = [*texts[-300:], "中 文", "<|endoftext|> x", "İstanbul's", "a b"]
    assert list(enc.encode_all(mixed)) == [one.encode(t) for t in mixed] == [lib.encode(t) for t in mixed]
    assert list(enc.encode_all([])) == []
