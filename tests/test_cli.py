import json

import numpy as np

from lumenframe import cli
from lumenframe.params import Params
from lumenframe.plans import session
from lumenframe.sources import avi, store
from tests.test_programs import synthetic


def test_from_files_to_a_report(spark, tmp_path, capsys):
    movie, *_ = synthetic(t=120)
    movie = np.clip((movie - movie.min()) * 18, 0, 255).astype(np.uint8)
    raw, at = tmp_path / "raw", lambda n: str(tmp_path / n)
    raw.mkdir()
    for i in range(3):
        (raw / f"{i}.avi").write_bytes(avi.encode(movie[40 * i : 40 * i + 40]))
    params = Params(sigma=2.5, min_corr=0.4, min_pnr=3.0, border_px=0, seed_method="threshold", n_iter_main=1, init_patches=False, mc_n_iter=1, max_shift=(3, 3), mc_sharpen_template=False)
    (tmp_path / "params.json").write_text(params.to_json())
    run = lambda *a: cli.main([*a, "--params", at("params.json"), "--shape", "32x32"], spark)
    run("ingest", str(raw), at("frames"))
    rows = store.load_frames(spark, at("frames")).orderBy("t").collect()
    assert len(rows) == 120 and np.allclose([r.px for r in rows], movie.reshape(120, -1))
    run("motion-folder", str(raw), at("moved"))
    assert store.load_frames(spark, at("moved")).count() == 120 and spark.read.parquet(at("moved-shifts")).count() == 120
    run("tiles", at("frames"), at("tiles"))
    assert store.load_tiles(spark, at("tiles")).own().count() == 1024
    run("fit", at("frames"), at("model"))
    model = session.Model.load(spark, at("model"))
    assert model.count >= 2 and model.solver["temporal"]["failed"] == {}
    run("evaluate", at("model"), at("metrics"))
    assert spark.read.csv(at("metrics"), header=True).count() == model.count
    cli.main(["upsample", at("model"), at("big"), "--shape", "64x64", "--ssub", "2", "--tsub", "2"], spark)
    big = session.Model.load(spark, at("big"))
    assert big.shape == (64, 64) and big.traces.shape == (model.count, 240)
    cli.main(["downsample", at("frames"), at("small"), "--shape", "32x32", "--ssub", "2", "--tsub", "3"], spark)
    assert store.load_facts(spark, at("small")) == {"dims": [16, 16], "orig_dims": [32, 32], "orig_T": 120, "ssub": 2, "tsub": 3}
    run("validate", at("frames"), at("valid"))
    report = json.loads((tmp_path / "valid" / "result.json").read_text())
    assert [r["label"] for r in report["tables"]["runs"]] == ["recommended", "lowthr"]
    capsys.readouterr()
    try:
        cli.main(["batch", at("models"), at("frames"), at("nothing"), "--shape", "32x32", "--params", at("params.json")], spark)
        raise AssertionError("a session that is not there")
    except SystemExit as e:
        assert e.code == 1
    assert session.Model.load(spark, at("models/frames")).count == model.count
