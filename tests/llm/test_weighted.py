import hashlib
import random
from collections import Counter

import numpy as np

from loomstore.llm import weighted as W


def brute(rows):
    """Edited texts by order of id and hash of the text; rows of one id need one text here."""
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        out[i] = t[: len(t) - n] + following[:n]
    return out


def test_edits_and_fingerprints(make_docs, texts, monkeypatch):
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts)]
    want = brute([(i, t or "") for i, t in rows])
    for block in (4096, 5, 1):
        monkeypatch.setattr(W, "BLOCK_ROWS", block)
        found = {r["doc_id"]: r for r in W.fingerprint_documents(make_docs(rows)).collect()}
        assert len(found) == len(rows)
        sampler, by_id = W.Sampler(), {i: t or "" for i, t in rows}
        ids = sorted(by_id)
        for k, i in enumerate(ids):
            r, following = found[i], by_id[ids[(k + 1) % len(ids)]]
            assert r["edited_sha256"] == hashlib.sha256(want[i].encode()).hexdigest() and r["n_chars"] == len(by_id[i])
            a, b, c = sampler.of(by_id[i]), sampler.of(want[i]), sampler.of(following)
            assert (r["fingerprint"], r["edited_fingerprint"]) == (W.to_text(a), W.to_text(b))
            assert (r["near_edited"], r["near_next"]) == (W.likeness(a, b), W.likeness(a, c))


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = random.Random(0)
    errors = []
    sampler = W.Sampler(512)
    for _ in range(12):
        a = rng.choices("abcdefghijklmnop", k=60)
        b = a[: rng.randrange(10, 60)] + rng.choices("klmnopqrstuv", k=20)
        x, y = Counter(a), Counter(b)
        true = sum((x & y).values()) / sum((x | y).values())
        errors.append(W.likeness(sampler.of(" ".join(a)), sampler.of(" ".join(b))) - true)
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.09


def test_odd_rows(make_docs, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ROWS", 2)
    rows = [(1, "a b c d"), (1, "a b c d"), (2, None), (None, "x y"), (None, ""), (3, "a b c d")]
    found = W.fingerprint_documents(make_docs(rows)).collect()
    assert len(found) == len(rows)
    assert len({r["fingerprint"] for r in found if r["n_chars"] == 7}) == 1
    assert W.fingerprint_documents(make_docs([])).count() == 0
    alone = W.fingerprint_documents(make_docs([(9, "one two three four")])).first()
    assert alone["near_next"] == 1.0
    assert len(W.fingerprint_documents(make_docs([(None, "q"), (None, "r")])).collect()) == 2


def test_memory_is_bounded_without_changing_results(monkeypatch):
    texts = [" ".join(random.Random(k).choices("abcdefgh", k=12)) for k in range(50)]
    want = [W.to_text(W.Sampler().of(t)) for t in texts]
    monkeypatch.setattr(W, "REMEMBERED", 3)
    s = W.Sampler()
    assert [W.to_text(s.of(t)) for t in texts] == want
