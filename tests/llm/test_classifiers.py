"""Toxicity, quality and language: held-out accuracy, and defined results without labels, texts or rows."""

import random
import zlib

import numpy as np
import pytest

from loomstore.llm import langid, quality, queries, toxicity
from loomstore.llm.common import labelled_sample

SF = "/root/testdata/sf0.1"


def crc(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def synthetic(n=600, seed=1):
    """English-like texts; a third of them have bad words, all of whose kinds the training rows show."""
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 7))) for _ in range(150)]
    bad = ["zorkish", "zorkling", "blatherskite", "nincompoop", "zorkful"]
    rows, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.33)
        words = rng.choices(plain, k=rng.randrange(20, 60))
        for _ in range(toxic * rng.randrange(2, 5)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        poor = int(rng.random() < 0.3)
        text = " ".join(w.upper() + "!!" if poor else w for w in words)
        rows.append((i, text))
        labels.append((i, 1 - poor, toxic))
    return rows, labels


def accuracy(rows, truth, held):
    rows = [r for r in rows if r["held_out"] == held and r["doc_id"] in truth]
    assert rows
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows])


@pytest.mark.parametrize("name,column,least", [("op2_toxicity", "toxic", 0.97), ("op7_quality", "quality", 0.99)])
def test_held_out_accuracy(spark, name, column, least):
    rows = queries.QUERIES[name](spark, SF).collect()
    truth = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert accuracy(rows, truth, True) >= least
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    mod, rest = (4, 2) if column == "toxic" else (3, 1)
    assert all(r["held_out"] == (crc(r["doc_id"], mod) == rest) for r in rows)


def test_held_out_languages(spark):
    rows = queries.op10_language(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.99
    assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)


def test_learning_on_synthetic_rows_and_odd_rows(spark, make_docs, texts):
    rows, labels = synthetic()
    odd = [(10_000 + k, t) for k, t in enumerate(texts)] + [(None, "zorkish zorkling"), (3, rows[3][1])]
    docs, labelled = make_docs(rows + odd), labels_of(spark, labels + [(0, labels[0][1], labels[0][2]), (None, 1, 1), (77_777, 1, 1), (5, None, None)])
    for module, column, mod, rest, cut in ((toxicity, 2, 4, 2, 0.3), (quality, 1, 3, 1, 0.5)):
        model = module.fit(docs, labelled)
        found = module.score(docs, model).collect()
        assert len(found) == len(rows) + len(odd)
        held = [r for r in found if r["held_out"] and r["doc_id"] < 10_000]
        assert all(crc(r["doc_id"], mod) == rest for r in held)
        assert np.mean([(r["score"] >= cut) == labels[r["doc_id"]][column] for r in held]) > 0.97
        assert all(0 <= r["score"] <= 1 for r in found)
        keep = module.keep_clean(docs, model) if module is toxicity else module.keep_good(docs, model)
        assert keep.columns == docs.columns
        want = sum((r["score"] < cut) if module is toxicity else (r["score"] >= cut) for r in found)
        assert keep.count() == want


def test_labels_of_held_out_rows_are_never_seen(spark, make_docs):
    rows, labels = synthetic(200)
    flipped = [(i, 1 - q, 1 - t) if crc(i, 4) == 2 else (i, q, t) for i, q, t in labels]
    a = {r["doc_id"]: r["score"] for r in toxicity.score(make_docs(rows), toxicity.fit(make_docs(rows), labels_of(spark, labels))).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.score(make_docs(rows), toxicity.fit(make_docs(rows), labels_of(spark, flipped))).collect()}
    assert a == b


def test_sample_is_bounded_by_class(spark, make_docs):
    rows, labels = synthetic(200)
    sample, sizes = labelled_sample(make_docs(rows), labels_of(spark, labels), "toxic", 4, 2, 10)
    assert sorted(r["y"] for r in sample.collect()) == [0] * 10 + [1] * 10 and sum(sizes.values()) == sum(crc(i, 4) != 2 for i, *_ in labels)


def test_one_class_or_none(spark, make_docs):
    rows, _ = synthetic(20)
    for labels, share in (([(i, 1, 1) for i in range(20)], 1.0), ([(i, 0, 0) for i in range(20)], 0.0), ([], None)):
        for module in (toxicity, quality):
            scores = {round(r["score"], 2) for r in module.score(make_docs(rows), module.fit(make_docs(rows), labels_of(spark, labels))).collect()}
            assert scores == {share if share is not None else 0.5 if module is quality else 0.0}
    for module in (toxicity, quality):
        assert module.score(make_docs([]), module.fit(make_docs([]), labels_of(spark, []))).count() == 0


def test_label_model_finds_accuracies_and_discounts_copies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    good = [np.where(rng.random(4000) < 0.9, truth, ~truth).astype(int) for _ in range(3)]
    coin = rng.integers(0, 2, 4000)
    votes = np.stack([*good, coin, coin], 1)
    posterior, accuracies, correlation = toxicity.label_model(votes, np.ones(4000), 0.3)
    assert np.mean((posterior > 0.5) == truth) > 0.94
    assert accuracies[0, 1, 2] > 0.8 and correlation[3, 4] > 0.9 and abs(correlation[0, 1]) < 0.3


def test_languages_without_words_letters_or_training(spark, make_docs):
    rows = [(i, "der hund und die katze") for i in range(0, 40)] + [(i, "the dog and the cat") for i in range(40, 80)]
    lang = {i: "de" if i < 40 else "en" for i in range(80)}
    docs = make_docs(rows + [(100, None), (101, ""), (102, "123 !?"), (103, "hunden"), (104, "und " * 5000), (None, "the cat")], lang)
    model = langid.fit(docs)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert [found[k] for k in (100, 101, 102, 103, 104, None, 0, 79)] == ["und", "und", "und", "de", "de", "en", "de", "en"]
    bare = make_docs(rows, None)
    assert {r["lang_pred"] for r in langid.predict(bare, langid.fit(bare)).collect()} == {"und"}
    assert langid.predict(make_docs([]), model).count() == 0


def test_unseen_words_fall_back_to_shorter_ngrams():
    counts = [("aa", 0, "known", 5), ("aa", 3, "<zq", 4), ("bb", 1, "z", 9), ("bb", 3, "xyz", 2)]
    m = langid.Model(counts)
    assert (langid.Reader(m).figures(["known"])[0] == m.tables[0][m.row[0]["known"]]).all()
    assert (m.unseen("zqk") == m.tables[3][m.row[3]["<zq"]]).all()
    assert (m.unseen("kz") == m.tables[1][m.row[1]["z"]]).all() and not m.unseen("ooo").any()


def brute_language(text, rows):
    """From (language, text) rows: language and score by the definition, term by term."""
    languages = sorted({lang for lang, _ in rows})
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    split = lambda t: "".join(c if "a" <= c <= "z" or c >= "\x80" else " " for c in t.lower()).split(" ")
    words = {lang: [w for at, t in rows if at == lang for w in split(t) if w] for lang in languages}
    terms = {(lang, 0): words[lang] for lang in languages}
    for n in range(1, langid.NGRAMS + 1):
        for lang in languages:
            marked = words[lang] if n == 1 else [f"<{w}>" for w in words[lang]]
            terms[lang, n] = [w[i : i + n] for w in marked for i in range(len(w) - n + 1)]
    distinct = {n: {t for lang in languages for t in terms[lang, n]} for n in range(langid.NGRAMS + 1)}

    def log(lang, n, term):
        return np.log((terms[lang, n].count(term) + 0.1) / (len(terms[lang, n]) + 0.1 * (len(distinct[n]) + 1)))

    sums, count = dict.fromkeys(languages, 0.0), 0
    for word in filter(None, split(text)):
        count += 1
        if word in distinct[0]:
            for lang in languages:
                sums[lang] += log(lang, 0, word)
            continue
        for n in range(langid.NGRAMS, 0, -1):
            marked = word if n == 1 else f"<{word}>"
            known = [marked[i : i + n] for i in range(len(marked) - n + 1) if marked[i : i + n] in distinct[n]]
            if known:
                for lang in languages:
                    sums[lang] += sum(log(lang, n, g) for g in known) / len(known)
                break
    top = max(sums.values())
    shares = {lang: np.exp(langid.SHARPNESS * (x - top) / max(1, count)) for lang, x in sums.items()}
    best = min(lang for lang in languages if sums[lang] == top)
    return best, shares[best] / sum(shares.values())


def test_languages_equal_the_definition(make_docs, monkeypatch):
    rng = random.Random(4)
    vocabulary = {"de": ["der", "hund", "straße", "und", "über"], "en": ["the", "dog", "street", "and", "don't"], "ja": ["犬", "道", "と"]}
    rows, lang = [], {}
    for i in range(45):
        lang[i] = ["de", "en", "ja"][i % 3]
        rows.append((i, " ".join(rng.choices(vocabulary[lang[i]], k=rng.randrange(1, 9)))))
    odd = ["hunde", "streets of dogs", "犬犬 道", "²½", "①②", "Ⅷ", "5 + ½", "\u0301", "x\u0301", "DER HUND", "zzz qqq", "a1b2", None, "", "the hund", "ß"]
    docs = make_docs(rows + [(100 + k, t) for k, t in enumerate(odd)], lang)
    learned = [(lang[i], t) for i, t in rows if crc(i, 3) != 1]
    for cached in (langid.CACHED_WORDS, 1):
        monkeypatch.setattr(langid, "CACHED_WORDS", cached)
        found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.fit(docs)).collect()}
        assert len(found) == len(rows) + len(odd)
        for i, text in [*rows, *((100 + k, t) for k, t in enumerate(odd))]:
            want = brute_language(text, learned)
            assert found[i][0] == want[0] and abs(found[i][1] - want[1]) < 1e-9, (text, found[i], want)
    assert all(found[100 + odd.index(t)] == ("und", 0.0) for t in ("²½", "①②", "Ⅷ", "5 + ½", "\u0301"))


def test_the_label_is_no_voter(spark, make_docs):
    """Turning the labels of a few texts round leaves their posterior, and so the model's view of them, with the words."""
    rows, labels = synthetic(600)
    turned = {i for i, _, t in labels if t and crc(i, 4) != 2 and i % 9 == 0}
    flipped = [(i, q, 0 if i in turned else t) for i, q, t in labels]
    docs = make_docs(rows)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels_of(spark, flipped))).collect()}
    assert len(turned) > 10 and np.mean([found[i] >= 0.3 for i in turned]) > 0.9


def test_scores_equal_their_definition(spark, make_docs, texts):
    """The scores of whole tables are those of each text alone, from the model's weights and look-up tables."""
    rows, labels = synthetic(400)
    docs = make_docs(rows + [(10_000 + k, t) for k, t in enumerate(texts)])
    every = dict(rows) | {10_000 + k: t for k, t in enumerate(texts)}
    model = toxicity.fit(docs, labels_of(spark, labels))
    weight = dict(zip(model.features, model.w))
    for r in toxicity.score(docs, model).collect():
        low = "".join(c if "a" <= c <= "z" or c >= "\x80" else " " for c in (every[r["doc_id"]] or "").lower()).split(" ")
        hits = [[f for f in [w, *(w[:n] + "*" for n in toxicity.PREFIXES if len(w) > n)] if f in weight] for w in low if w]
        z = model.b + sum(weight[f] for f in {f for x in hits for f in x}) + sum(c for step, c in zip(model.steps, model.c) if sum(map(bool, hits)) >= step)
        assert abs(r["score"] - 1 / (1 + np.exp(-max(-30, min(30, z))))) < 1e-9
    gam = quality.fit(docs, labels_of(spark, labels))
    for r in quality.score(docs, gam).collect():
        x, z = quality.figures(every[r["doc_id"]]), gam.base
        for k, table in enumerate(gam.tables):
            z += table[sum(edge <= x[k] for edge in gam.edges[k])]
        for i, j, table in gam.pairs:
            z += table[sum(edge <= x[i] for edge in gam.coarse[i]), sum(edge <= x[j] for edge in gam.coarse[j])]
        assert abs(r["score"] - 1 / (1 + np.exp(-max(-30, min(30, z))))) < 1e-9


def test_sample_counts_documents_once(spark, make_docs):
    rows = [(1, "b"), (1, "a"), (1, "a"), (2, "c"), (3, None), (None, "d")]
    sample, sizes = labelled_sample(make_docs(rows), labels_of(spark, [(1, 0, 1), (1, 0, 0), (2, 0, 0), (3, 0, 0), (9, 0, 1), (None, 1, 1)]), "toxic", 1, 1, 10)
    found = sorted((r["doc_id"], r["y"]) for r in sample.collect())
    assert found == [(1, 1), (2, 0), (3, 0)] and sizes == {0: 2, 1: 1}
