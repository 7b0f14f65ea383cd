"""What the saved pipeline of ``model_round_trip`` holds."""

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScalerModel, StringIndexerModel
from wideframe.catalogue import queries
from wideframe.sources import tables


def _flat(model):
    return [s for m in model.stages for s in (_flat(m) if isinstance(m, PipelineModel) else [m])]


def test_the_saved_pipeline_has_the_dictionary_and_the_scaling(spark, sf, monkeypatch):
    paths = []
    monkeypatch.setattr(tables, "save_model", lambda model, path, save=tables.save_model: (paths.append(path), save(model, path)))
    row = queries.QUERIES["model_round_trip"](spark, sf).first()
    assert row["n_rows"] == row["n_same"] > 0 and row["evaluated"]
    lines, parts = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "part"))
    used = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    stages = _flat(tables.load_model(paths[0]))
    found = {s.getInputCol(): list(s.labels) for s in stages if isinstance(s, StringIndexerModel)}
    assert found == {f"__text_{c}": sorted(r[0] for r in used.select(c).distinct().collect()) for c in ("l_returnflag", "l_linestatus", "p_brand")}
    assert any(isinstance(s, StandardScalerModel) for s in stages)
    assert stages[-1].numFeatures == len(queries.NUMERIC) + sum(map(len, found.values()))
