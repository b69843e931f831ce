import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomstore.llm import token_files as K

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
KNOWN = {"stops": ".,;:!?", "lower": True}


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_codes_give_back_any_id_and_any_run(ids, data):
    codes = K.Codes(K.encode_ids(np.array(ids, np.uint32)))
    assert codes.size == len(ids) and codes.run(0, len(ids)).tolist() == ids
    a, z = sorted(data.draw(st.tuples(st.integers(0, len(ids)), st.integers(0, len(ids)))))
    assert codes.run(a, z).tolist() == ids[a:z]
    places = data.draw(st.lists(st.integers(0, max(0, len(ids) - 1)), max_size=20)) if ids else []
    assert codes.at(np.array(places, np.int64)).tolist() == [ids[p] for p in places]
    with pytest.raises(IndexError):
        codes.at(np.array([len(ids)]))


def test_widths_take_the_fewest_bits():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.geometric(0.01, 20_000), 2**20).astype(np.uint32)
    made = len(K.encode_ids(ids))
    for widths in ([8, 8, 8], [4] * 6, [21]):
        assert made <= 1.02 * _size(ids, widths)


def _size(ids, widths):
    bits, left = 0.0, np.array(ids)
    for k, w in enumerate(widths):
        bits += len(left) * (w + (17 / 16 if k + 1 < len(widths) else 0))
        left = (left >> w)[left >> w > 0]
    return bits / 8


WORDS = ["the", "The", "CAFÉ", "naïve.", "don't", "it's,", "J̌", "áb", "ΣΑΣ", "İ.", "12.5", "x,y.z!?", "<|endoftext|>", "<|ENDOFTEXT|>.", "数据。", " ", " z", "\x1c", "🙂!", "straße;", "...", "é.,é", "ÿŸ", "×÷", "ͅ", "K."]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.one_of(st.sampled_from(WORDS), st.text(max_size=6)), max_size=12), st.sampled_from([" ", "\n", "  \t", ""]))
def test_words_give_what_the_library_gives_for_the_text(words, space):
    import pyarrow as pa

    text = space.join(words).encode("utf-8", "ignore").decode()
    for known in ({}, KNOWN):
        got, n = K.Words(K.tokenizer_words(PATH, known.get("lower", False)), **known)(pa.array([text, None, text]))
        assert got.tolist() == 2 * ids_of(text) and n.tolist() == [len(ids_of(text)), 0, len(ids_of(text))]


def read(spark, df, path, end_id=2):
    K.write_tokens(df, PATH, path, end_id, **KNOWN)
    return sorted((r["start"], r["id"], r["n_tokens"], bytes(r["tokens"])) for r in K.read_documents(spark, path).collect())


@pytest.mark.parametrize("block", [50, 1 << 16])
def test_files_hold_all_documents_in_order(spark, make_docs, texts, tmp_path, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK_TOKENS", block)
    monkeypatch.setattr(K, "TASK_BYTES", 20_000)
    monkeypatch.setattr(K, "MEMORY_WORDS", 30)
    rows = [(7 * k % 41, t) for k, t in enumerate(texts)] + [(None, "no id"), (None, "no id"), (3, "again"), (3, "again"), (5, "wörd " * 300_000)]
    got = read(spark, make_docs(rows), str(tmp_path / "t"))
    want = sorted(((i, np.array([*ids_of(t), 2], "<u4").tobytes()) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted(((i, t) for _, i, _, t in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) == want
    assert [i for _, i, _, _ in got] == [i for i, _ in want]  # ascending, nulls first
    at = 0
    for start, _, n, tokens in got:
        assert start == at and n == len(tokens) // 4
        at += n
    every = np.frombuffer(b"".join(t for *_, t in got), "<u4")
    rng = random.Random(1)
    places = [rng.randrange(at) for _ in range(200)] + [0, at - 1, at, -1, None]
    found = K.tokens_at(spark, str(tmp_path / "t"), spark.createDataFrame([(p,) for p in places], "place bigint")).collect()
    assert {(r["place"], r["token"]) for r in found} == {(p, int(every[p])) for p in places if p is not None and 0 <= p < at}


def test_the_query_equals_the_library(spark):
    import pyarrow.parquet as pq

    from loomstore.llm.queries import op13_token_files

    rows = sorted(zip(*(c.to_pylist() for c in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).columns)))
    want, at = [], 0
    for i, t in rows:
        ids = np.array([*ids_of(t), 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in op13_token_files(spark, "/root/testdata/sf0.001").collect()) == want


def test_no_documents_and_no_end_id(spark, make_docs, tmp_path):
    assert read(spark, make_docs([]), str(tmp_path / "a")) == []
    assert [(i, n, t) for _, i, n, t in read(spark, make_docs([(1, ""), (2, None), (3, "a")]), str(tmp_path / "b"), None)] == [(1, 0, b""), (2, 0, b""), (3, 1, np.array(ids_of("a"), "<u4").tobytes())]


def test_words_that_come_again_are_tokenized_once(monkeypatch):
    """Also when more words came between than a task remembers."""
    import pyarrow as pa

    monkeypatch.setattr(K, "MEMORY_WORDS", 30)
    asked = []
    words = K.Words(lambda new: asked.extend(new) or [[len(w), ord(w[-1])] for w in new])
    for k in range(40):
        text = "often " + " ".join(f"w{k}x{j}" for j in range(9)) + " often"
        ids, counts = words(pa.array([text]))
        assert counts.tolist() == [22] and ids.tolist() == [x for w in text.split() for x in (len(w), ord(w[-1]))]
        assert len(words.slots) <= 30 + 10
    assert asked.count("often") == 1 and len(asked) == 361


def test_a_worker_keeps_its_words_from_task_to_task(spark, tmp_path):
    import shutil

    import pyarrow as pa

    path = str(tmp_path / "tokenizer.json")
    shutil.copy(PATH, path)

    def run(batches):
        words = K.kept_words(path, **KNOWN)
        known = len(words.slots)
        for _ in batches:
            words(pa.array(["often again"]))
        yield pa.RecordBatch.from_arrays([pa.array([known])], names=["known"])

    known = [r["known"] for r in spark.range(0, 24, 1, 24).mapInArrow(run, "known bigint").collect()]
    assert set(known) == {0, 2} and known.count(0) <= 4  # one first task for each of four workers
    before = K.kept_words(path, **KNOWN)
    assert K.kept_words(path, **KNOWN) is before
    with open(path, "a") as f:
        f.write("\n")
    assert K.kept_words(path, **KNOWN) is not before


def test_a_task_gets_few_bytes_of_text(spark, tmp_path):
    """They lie in an executor's memory to be sorted, and so do their codes."""
    docs = spark.range(480).selectExpr("id AS doc_id", "repeat('word ', 25000) AS text")  # 60 MB
    K.write_tokens(docs, PATH, str(tmp_path / "t"), 2, **KNOWN)
    shards = K.blocks(spark, str(tmp_path / "t")).groupBy("shard").agg(F.sum(F.size("ids")).alias("n")).collect()
    assert sum(r["n"] for r in shards) == 480 and max(r["n"] for r in shards) * 125_000 <= 40 << 20


def test_half_a_million_words_are_remembered():
    import pyarrow as pa

    asked = []
    words = K.Words(lambda new: asked.extend(new) or [[len(w)] for w in new])
    for k in [*range(20), *range(20)]:
        ids, counts = words(pa.array([" ".join(f"w{k}x{j}" for j in range(25_000))]))
        assert counts.tolist() == [25_000] and ids[0] == len(f"w{k}x0") and ids[-1] == len(f"w{k}x24999")
    assert len(asked) == len(set(asked)) == 500_000


def test_words_of_letters_go_to_the_model_as_one_text(monkeypatch):
    """Nothing is called for each of them."""
    texts = []

    class Counted:
        def __init__(self, model):
            self.inner = model if isinstance(model, Tokenizer) else Tokenizer(model)

        def encode_batch_fast(self, given, **known):
            texts.extend(given)
            return self.inner.encode_batch_fast(given, **known)

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def __setattr__(self, name, value):
            super().__setattr__(name, value) if name == "inner" else setattr(self.inner, name, value)

        @staticmethod
        def from_file(path):
            return Counted(TOKENIZER)

    monkeypatch.setattr("tokenizers.Tokenizer", Counted)
    rng = random.Random(3)
    given = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzàéïößÿ", k=rng.randrange(1, 12))) for _ in range(10_000)] + ["<|endoftext|>", "x7", ""]
    rng.shuffle(given)
    assert K.tokenizer_words(PATH, True)(given).to_pylist() == [ids_of(w) for w in given]
    assert 0 < len(texts) <= 10_000 / 256 + 3 + 3


@pytest.mark.parametrize("suffix, lacking", [("</w>", ""), ("</w>", "b"), ("b", ""), (None, "")])
def test_other_files_with_lower(tmp_path, suffix, lacking):
    """Also if the model does not mark the ends of words, or drops the last letter of some."""
    import pyarrow as pa
    from tokenizers import Regex, models, normalizers, pre_tokenizers

    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    known = [*letters, *(c + suffix for c in letters if suffix and c not in lacking), "ab", "Ã©"]
    tokenizer = Tokenizer(models.BPE({w: k for k, w in enumerate(known)}, [("a", "b"), ("Ã", "©")], **({"end_of_word_suffix": suffix} if suffix else {})))
    tokenizer.normalizer = normalizers.Lowercase()
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"\p{L}+|[^\s\p{L}]+"), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokenizer.save(path := str(tmp_path / "tokenizer.json"))
    text = "ab cab é éb B Abc ÉTÉ x1 b --b b"
    got, n = K.Words(K.tokenizer_words(path, True), lower=True)(pa.array([text, "b", text]))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "b", text)]
    assert got.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]
