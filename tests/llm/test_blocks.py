import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from loomstore.llm import blocks


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5, 0, 255], [256, 1], [2**64 - 1, 0], rng.integers(0, 2**63, 1000).tolist()):
        a = np.array(values, np.uint64)
        assert blocks.unpacked(blocks.packed(a)).tolist() == a.tolist()


def test_asking_takes_no_longer_for_more_ranges():
    import time

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**64, 300_000, np.uint64))
    times = []
    for parts in (200, 5_700, 57_000, 570_000, 2**31 - 1):
        began = time.perf_counter()
        rows = blocks.ask(1, keys, np.ones(len(keys), np.uint64), parts)
        times.append(time.perf_counter() - began)
        assert sum(rows["n"].to_pylist()) == len(keys) and rows["part"].to_pylist() == sorted(set(rows["part"].to_pylist()))
        found = np.concatenate([blocks._asked(x, p)[0] for x, p in zip(rows["data"].to_pylist(), rows["plain"].to_pylist())])
        assert (found == keys).all()
    assert max(times) < 10 * min(times) + 1


@pytest.mark.parametrize("few", [0, 3, 64])
def test_each_block_is_answered_with_the_sums_over_all(spark, monkeypatch, few):
    monkeypatch.setattr(blocks, "FEW_KEYS", few)
    rng = np.random.default_rng(2)
    universe = np.append(rng.integers(0, 2**64, 60, np.uint64), [np.uint64(0), np.uint64(2**64 - 1)])
    held = {b: np.unique(rng.choice(universe, 25)) for b in range(7)} | {7: np.zeros(0, np.uint64)}
    counts = {b: rng.integers(0, 3, len(k)).astype(np.uint64) for b, k in held.items()}
    for parts in (1, 3, 50):
        asked = [blocks.ask(b, held[b], counts[b], parts) for b in held]
        found = blocks.answer(spark.createDataFrame(pa.concat_tables(asked)), 1)
        rows = pa.Table.from_batches(found.toArrow().to_batches())
        total = {int(k): sum(int(counts[b][held[b] == k].sum()) for b in held) for k in universe}
        for b in held:
            got, elsewhere = blocks.answers_of(rows.filter(pc.equal(rows["block"], b)), 1)
            assert got.tolist() == [total[int(k)] for k in held[b]]
            assert elsewhere.tolist() == [any(k in held[x] for x in held if x != b) for k in held[b]]
        assert sum(rows["present"].to_pylist()) == sum(c > 0 for k, c in total.items() if any(k in held[b].tolist() for b in held))
