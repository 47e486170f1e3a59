"""Registered queries against their DuckDB oracles, on the smallest tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from gaitlake.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
PICKED = ["motif_poses", "feature_ridge", "painted_map", "ego_rotate", "joint_angles_planar", "velocity_std", "median_filter_even", "floor_align", "cluster_freq_by_cat", "js_distance_segments", "knn_regress_distance", "hist2d", "augment_mirror", "meta_csv", "pose_of_sessions", "features_written_and_read", "behaviours_csv", "rolling_window", "segment_borders", "heuristic_score", "best_parameter", "repair_z", "wavelet_power", "augment_speed", "loo_lstsq", "loo_elastic_net", "scatter_by_cat"]


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF):
        duck.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracles()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert got.equals(want.astype(got.dtypes.to_dict()))


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(registry.oracles()) <= set(registry.queries()) <= set(entry.queries())


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def imported(tmp_path, change):
    """What importing a changed copy of the repository says of its queries."""
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "gaitlake"), copy / "gaitlake", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), copy / name)
    change(copy)
    code = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"
    return subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, check=False)


def test_entry_imports_without_the_corpus_subpackage(tmp_path):
    def remove(copy):
        shutil.rmtree(copy / "gaitlake" / "llm", ignore_errors=True)
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)

    got = imported(tmp_path, remove)
    assert got.returncode == 0, got.stderr
    assert got.stdout.strip() == f"{sorted(registry.queries())} {sorted(registry.oracles())}"


@pytest.mark.skipif(not os.path.isdir(os.path.join(ROOT, "gaitlake", "llm")), reason="no corpus subpackage")
def test_broken_imports_inside_the_subpackage_are_errors(tmp_path):
    def spoil(copy):
        (copy / "gaitlake" / "llm" / "queries.py").write_text("import no_such_module\n")

    got = imported(tmp_path, spoil)
    assert got.returncode != 0 and "no_such_module" in got.stderr


@pytest.mark.parametrize("name", ["embed_tsne", "kfold_reembed"])
def test_template_is_the_whole_table(spark, monkeypatch, name):
    seen = []
    monkeypatch.setattr("gaitlake.operators.kernels.tsne", lambda x, *a, **b: (seen.append(len(x)), x[:, :2])[1])
    registry.queries()[name](spark, SF).collect()
    assert seen == [spark.read.parquet(f"{SF}/embeddings.parquet").count()]
