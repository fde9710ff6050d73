import json
import os

from conftest import SF_SMALL
from febrile.plans import scoring_job, upload_run
from febrile.sources import fixtures as fx
from febrile.sources.store import read_store


def test_scoring_job_cli(spark, scratch, capsys):
    inp = os.path.join(scratch, "obs_csv")
    fx.observations(spark, SF_SMALL).write.option("header", True).csv(inp)
    scoring_job.main(["--input", inp, "--models_dir", scratch + "/models", "--output_dir", scratch + "/out"])
    info = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert info["model"] == "RandomForest" and info["cat_cols"] == ["feat_lang"]
    assert spark.read.option("header", True).csv(scratch + "/out/predictions").count() == 200
    assert os.path.isdir(scratch + "/models/outbreak_model") and os.path.isdir(scratch + "/out/metrics")


def test_upload_cli(spark, scratch, capsys):
    inp = os.path.join(scratch, "obs_csv")
    fx.observations(spark, SF_SMALL).drop("row_seq").write.option("header", True).csv(inp)
    cand = os.path.join(scratch, "candidates")
    fx.candidates(spark, SF_SMALL).write.parquet(cand)
    upload_run.main(["--input", inp, "--store", scratch + "/store", "--target", scratch + "/new",
                     "--candidates", cand])
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["run"]["total_rows"] == 200
    preds = read_store(spark, scratch + "/new", "predictions")
    assert preds.count() == fx.observations(spark, SF_SMALL).select("Region").distinct().count()
    g = out["geocoding"]
    assert g["newly_geocoded"] + g["cached"] + g["failed"] == preds.count()
