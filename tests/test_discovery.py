"""Volume and mask files below a folder."""

import pytest

from voxlake.sources import files as FS


def test_files_are_listed_by_tasks(spark, tmp_path):
    names = ["DATA_1.nrrd", "a/DATA_007.nrrd", "a/b c/MASK_12.nrrd", "a/d%20/x/DATA_new.nrrd", "k=1/MASK_3.nrrd", "_k=1/DATA_4.nrrd"]
    for name in [*names, "_hidden/DATA_2.nrrd", ".x/DATA_3.nrrd", "a/_y/DATA_5.nrrd", "a/notes.txt", "a/DATA_9.nrrd.gz"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    found = FS.discover_files(spark, str(tmp_path))
    assert "binaryFile" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r["path"]: (r["length"], r["kind"], r["case_id"]) for r in found.collect()}
    known = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    known = known.option("pathGlobFilter", "{DATA,MASK}_*.nrrd").load(str(tmp_path))
    assert rows.keys() == {r["path"] for r in known.select("path").collect()} == {f"file:{tmp_path}/{n}" for n in names}
    assert rows[f"file:{tmp_path}/a/b c/MASK_12.nrrd"] == (18, "MASK", 12)
    assert rows[f"file:{tmp_path}/a/d%20/x/DATA_new.nrrd"] == (22, "DATA", None)


def test_roots_that_are_globs_files_or_absent(spark, tmp_path):
    for name in ("s1/DATA_1.nrrd", "s2/t/DATA_2.nrrd", "u/DATA_3.nrrd"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    cases = {r["case_id"] for r in FS.discover_files(spark, f"{tmp_path}/s*").collect()}
    assert cases == {1, 2}
    assert [r["case_id"] for r in FS.discover_files(spark, f"{tmp_path}/u/DATA_3.nrrd").collect()] == [3]
    (tmp_path / "empty").mkdir()
    assert FS.discover_files(spark, f"{tmp_path}/empty").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        FS.discover_files(spark, f"{tmp_path}/none")
