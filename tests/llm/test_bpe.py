import hashlib

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from loomstore.llm import bpe
from loomstore.llm.queries import bpe_digests, tokenizer

RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
ENCODING = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_ids_equal_the_library_and_decode_to_the_text(make_docs, texts):
    rows = bpe.encode(make_docs(list(enumerate(texts))), *tokenizer()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = ENCODING.encode_ordinary(text)
        assert [int(x) for x in r["ids_text"].split()] == ids and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == text.encode()
        assert bpe.decode(ids[:50], tokenizer()[0]) == ENCODING.decode_bytes(ids[:50])


def test_digests(make_docs):
    r = bpe_digests(make_docs([(1, "Hello there"), (None, None)])).orderBy(F.col("doc_id").desc()).collect()
    ids = " ".join(map(str, ENCODING.encode_ordinary("Hello there")))
    assert r[0]["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest() and r[0]["decoded_sha256"] == hashlib.sha256(b"Hello there").hexdigest()
    assert (r[1]["n_tokens"], r[1]["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())


def test_memory_of_words_is_bounded_without_changing_results(make_docs, texts, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 3)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 10)
    rows = bpe.encode(make_docs(list(enumerate(texts))), *tokenizer()).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(ENCODING.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_higher_order_fold_gives_the_same_ids(spark):
    words = [" there", "Hello", "naïve", "antidisestablishmentarianism", "🙂", "thinoreablested", "", "aaaaaaa", " 数据"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.fold_column(F.col("w").cast("binary"), RANKS).alias("ids"))
    assert {r["w"]: r["ids"] for r in df.collect()} == {w: ENCODING.encode_ordinary(w) for w in words}


def test_the_fold_of_distinct_words_gives_the_same_rows(make_docs, texts):
    docs = make_docs([*enumerate(texts), (3, texts[3]), (None, "no id"), (900, "x" * 700 + " aa"), (901, "é" * 400)])
    by = lambda df: sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_text"], bytes(r["decoded"])) for r in df.collect())
    assert by(bpe.encode_distinct(docs, *tokenizer())) == by(bpe.encode(docs, *tokenizer()))
    assert bpe.encode_distinct(make_docs([]), *tokenizer()).count() == 0


def step_by_step(word, byte_ids, pairs):
    ids = [byte_ids[b] for b in word]
    while (best := min(((pairs[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs), default=None)) is not None:
        ids[best[1] : best[1] + 2] = [best[0]]
    return ids


def test_long_words():
    import random
    import time

    rng = random.Random(2)
    pairs, byte_ids = bpe.pair_ranks(RANKS), [RANKS[bytes([b])] for b in range(256)]
    for n in (1, 2, 3, 50, 300, 2000):
        for letters in (b"a", b"ab", b"etaoin shrdlu", bytes(range(256))):
            word = bytes(rng.choices(letters, k=n))
            plain = bpe.fold_word(word, byte_ids, pairs) if n <= bpe.LONG_WORD else step_by_step(word, byte_ids, pairs)
            assert bpe._fold_long(word, byte_ids, pairs) == plain
    began = time.perf_counter()
    assert b"".join(ENCODING.decode_single_token_bytes(i) for i in bpe.fold_word(b"ab" * 100_000, byte_ids, pairs)) == b"ab" * 100_000
    assert time.perf_counter() - began < 20


def test_empty_table(make_docs):
    assert bpe.encode(make_docs([]), *tokenizer()).count() == 0
