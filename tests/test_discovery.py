"""Discovery of raw files without reading what is known, and digests in blocks."""

import hashlib
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stellarframe.operators import history
from stellarframe.sources import bronze

ROW = "OBJECT_NAME,NORAD_CAT_ID,EPOCH,INCLINATION,ECCENTRICITY,MEAN_MOTION,BSTAR\nISS,25544,2026-08-30T10:00:00,51.64,0.0004,15.5,\n"


def put(root: Path, name: str, text: str) -> Path:
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_known_files_are_not_read(spark, tmp_path):
    """Ten thousand files that were loaded before; their content is changed behind the index's back, so that reading shows."""
    root, home = tmp_path / "bronze", str(tmp_path / "history")
    names = [f"celestrak/stations_202608{10 + i // 3600 // 24:02d}T{i // 3600 % 24:02d}{i // 60 % 60:02d}{i % 60:02d}Z.csv" for i in range(10_000)]
    for n in names:
        put(root, n, "x")
    files = bronze.found(spark, str(root))
    sha = hashlib.sha256(b"x").hexdigest()
    files.select("file_path", "source", "snapshot_at_utc", F.lit(sha).alias("sha256"), F.current_timestamp().alias("loaded_at_utc"), F.lit(1).alias("row_count")).coalesce(1).write.parquet(f"{home}/bronze_file_registry")
    files.select("file_path", "length", "modified_at", F.lit(sha).alias("sha256"), F.lit("x").alias("first_line")).coalesce(1).write.parquet(f"{home}/bronze_file_index")
    changed = root / names[7]
    at = changed.stat()
    changed.write_text("y")
    os.utime(changed, ns=(at.st_atime_ns, at.st_mtime_ns))
    assert history.unread(files, history.read_index(spark, home), history.read_registry(spark, home)).count() == 0
    assert history.load(spark, str(root), home) == {}
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    # all is read on demand, and a file that looks changed is read again
    assert [Path(r.file_path).name for r in history.audit(spark, str(root), home).collect()] == [changed.name]
    os.utime(changed)
    with pytest.raises(history.ModifiedFile):
        history.load(spark, str(root), home)
    changed.write_text("x")
    assert history.load(spark, str(root), home) == {} and history.read_index(spark, home).count() == 10_001
    assert history.unread(files, history.read_index(spark, home), history.read_registry(spark, home)).count() == 0


def test_a_load_takes_new_files_and_an_index_is_made_up_for(spark, tmp_path):
    root, home = tmp_path / "bronze", str(tmp_path / "history")
    put(root, "celestrak/stations_20260830T120000Z.csv", ROW)
    assert history.load(spark, str(root), home) == {"orbital_snapshot_history": 1}
    put(root, "celestrak/stations_20260830T130000Z.csv", ROW)
    assert history.load(spark, str(root), home) == {"orbital_snapshot_history": 1}
    assert history.read_index(spark, home).count() == 2 and history.audit(spark, str(root), home).count() == 0
    # a history from before there was an index
    history._delete(spark, f"{home}/bronze_file_index")
    assert history.load(spark, str(root), home) == {} and history.read_index(spark, home).count() == 2
    (root / "celestrak/stations_20260830T120000Z.csv").unlink()
    assert [(Path(r.file_path).name, r.sha256) for r in history.audit(spark, str(root), home).collect()] == [("stations_20260830T120000Z.csv", None)]


def test_files_above_two_gigabytes(spark, tmp_path):
    path = put(tmp_path / "bronze", "noaa/plasma_20260830T120000Z.json", "")
    size = (2 << 30) + 12_345
    os.truncate(path, size)
    got = bronze.listing(spark, str(tmp_path / "bronze")).first()
    digest, left = hashlib.sha256(), size
    while left:
        digest.update(bytes(min(left, 1 << 24)))
        left -= min(left, 1 << 24)
    assert got.length == size and got.sha256 == digest.hexdigest() and got.source == "plasma"


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_digests_in_blocks(spark, tmp_path, block):
    texts = {"a b.csv": "x,y\r\n1,2\n", "ü.csv": "only line", "empty.csv": ""}
    for name, text in texts.items():
        put(tmp_path / "in", name, text)
    got = {Path(r.file_path).name: r for r in bronze.digests(spark.createDataFrame([(str(tmp_path / "in" / n),) for n in texts], "file_path string"), block).collect()}
    assert {n: r.sha256 for n, r in got.items()} == {n: hashlib.sha256(t.encode()).hexdigest() for n, t in texts.items()}
    assert {n: r.first_line for n, r in got.items()} == {"a b.csv": "x,y", "ü.csv": "only line", "empty.csv": ""}
