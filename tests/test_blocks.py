import numpy as np
import pytest

from wideframe.operators import ranks
from wideframe.sources.blocks import SparseBlocks, number_features, sparse_blocks


def dense(made: SparseBlocks, width: int) -> dict:
    ids = {r["row"]: (r["k"], r["j"]) for r in made.rows.collect()}
    out = {i: np.zeros(width) for i in ids.values()}
    blocks = sorted(made.blocks.collect(), key=lambda b: b["block"])
    assert sum(len(b["pointers"]) - 1 for b in blocks) == len(ids) and [b["first_row"] for b in blocks] == sorted(b["first_row"] for b in blocks)
    for b in blocks:
        assert b["pointers"][0] == 0 and b["pointers"][-1] == len(b["indices"]) == len(b["values"])
        for i, (start, end) in enumerate(zip(b["pointers"], b["pointers"][1:])):
            assert b["indices"][start:end] == sorted(set(b["indices"][start:end]))
            for c, v in zip(b["indices"][start:end], b["values"][start:end]):
                out[ids[b["first_row"] + i]][c] = v
    return out


@pytest.mark.parametrize("most", [7, 1_000_000])
def test_blocks_against_a_dense_matrix(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(ranks, "ROWS_PER_SLICE", 10)
    rng = np.random.default_rng(3)
    rows = [(int(i % 9) if i else None, f"r{i}") for i in range(40)]
    cells = [(*rows[rng.integers(30)], f"f{rng.integers(12)}", float(rng.integers(-2, 3))) for _ in range(150)]
    cells += [(*rows[0], None, 4.0), (99, "none", "f1", 5.0), (*rows[1], "f2", None), (*rows[2], "g", 1.0), (*rows[2], "g", -1.0)]
    df = spark.createDataFrame(cells, "k int, j string, feature string, value double").repartition(3)
    ids = spark.createDataFrame(rows + rows[:5], "k int, j string")
    made = sparse_blocks(df, ids, ["k", "j"], cells_per_block=most)
    names = {r["feature"]: r["index"] for r in made.features.collect()}
    assert names == {f: i for i, f in enumerate(sorted({c[2] for c in cells if c[2]}))}
    want = {i: np.zeros(len(names)) for i in rows}
    for k, j, f, v in cells:
        if (k, j) in want and f is not None and v is not None:
            want[k, j][names[f]] += v
    got = dense(made, len(names))
    assert set(got) == set(want) and all((got[i] == want[i]).all() for i in want)
    assert (made.blocks.count() > 5) == (most == 7)
    made.write(str(tmp_path / "m"))
    back = SparseBlocks.load(spark, str(tmp_path / "m")).triples().collect()
    assert sorted(map(str, back)) == sorted(map(str, made.triples().collect())) and len(back) == sum((v != 0).sum() for v in want.values())
    other = sparse_blocks(df.filter("feature <> 'f3'"), ids, ["k", "j"], features=number_features(df.filter("feature <> 'f5'")))
    assert other.triples().filter("feature in ('f3', 'f5')").count() == 0 and other.triples().count() > 0


def test_no_cells_and_no_rows(spark):
    cells = spark.createDataFrame([(1, "a", 2.0)], "k int, feature string, value double")
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    empty = sparse_blocks(cells.limit(0), rows, "k")
    assert [b["pointers"] for b in empty.blocks.collect()] == [[0, 0, 0]] and empty.triples().count() == 0
    assert sparse_blocks(cells, rows.limit(0), "k").blocks.count() == 0
