"""Logs of versions: commits of writers at once, live versions only, compaction."""

import shutil
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from plumbline.operators.snapshot import Snapshot
from plumbline.sources import manifest, sinks


def snapshot(spark, rows, note="n"):
    return Snapshot.of(spark.createDataFrame([(m, u, "dataset", note) for m, u in rows], "model_urn string, urn string, entity_type string, deprecation_note string"))


def assets(spark, path):
    return sorted((r["model_urn"], r["urn"], r["deprecation_note"]) for r in sinks.read_baseline(spark, path).assets.collect())


def test_one_of_many_commits_wins(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert manifest.entries(spark, path) == [] and manifest.last(spark, path) == 0

    def commit(i):
        try:
            return manifest.append(spark, path, f"v{i}", 0)
        except manifest.ConflictError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [n for n in pool.map(commit, range(8)) if n]
    assert won == [1] and [e.sequence for e in manifest.entries(spark, path)] == [1]
    assert manifest.append(spark, path, "c", 1, checkpoint=True) == 2
    assert manifest.append(spark, path, "d", 2) == 3
    assert [e.version for e in manifest.entries(spark, path)] == ["c", "d"]
    assert [p.name for p in (tmp_path / "log" / "_log").iterdir() if p.name.endswith("draft")] == []


def test_overlapping_baselines_conflict(spark, tmp_path, monkeypatch):
    """Two writers saw the same log: for one model the second loses, for different models both stay."""
    path = f"file://{tmp_path}/base"
    sinks.write_baseline(snapshot(spark, [("m", "a"), ("n", "a")], "first"), path)
    real = sinks._write_version

    def meanwhile(other):
        def write(own, at, version):
            real(own, at, version)
            monkeypatch.setattr(sinks, "_write_version", real)
            sinks.write_baseline(other, path)

        monkeypatch.setattr(sinks, "_write_version", write)

    meanwhile(snapshot(spark, [("m", "b")], "second"))
    with pytest.raises(manifest.ConflictError):
        sinks.write_baseline(snapshot(spark, [("m", "c")], "third"), path)
    assert assets(spark, path) == [("m", "b", "second"), ("n", "a", "first")]
    assert len(list((tmp_path / "base" / "assets").iterdir())) == 2
    meanwhile(snapshot(spark, [("o", "x")], "fourth"))
    sinks.write_baseline(snapshot(spark, [("m", "c")], "fifth"), path)
    assert assets(spark, path) == [("m", "c", "fifth"), ("n", "a", "first"), ("o", "x", "fourth")]


def test_a_read_opens_live_versions_only(spark, tmp_path):
    path = f"file://{tmp_path}/base"
    for i in range(4):
        sinks.write_baseline(snapshot(spark, [("m", f"u{i}")], str(i)), path)
    sinks.write_baseline(snapshot(spark, [("n", "x")]), path)
    live, versions = sinks.live_versions(spark, path)
    assert len(versions) == 2 and live.count() == 2
    for folder in (tmp_path / "base" / "assets").iterdir():
        if folder.name.removeprefix("version=") not in versions:
            shutil.rmtree(folder)  # nothing reads the replaced ones
    assert assets(spark, path) == [("m", "u3", "3"), ("n", "x", "n")]
    gone = sinks.compact_baseline(spark, path)
    assert len(gone) == 5 and assets(spark, path) == [("m", "u3", "3"), ("n", "x", "n")]
    assert len(list((tmp_path / "base" / "assets").iterdir())) == 1 and len(manifest.entries(spark, path)) == 1
    sinks.write_baseline(snapshot(spark, [("n", "y")]), path)
    assert assets(spark, path) == [("m", "u3", "3"), ("n", "y", "n")]
    assert sinks.compact_baseline(spark, f"{path}-none") == []


def patches(spark, rows):
    return spark.createDataFrame(rows, "model_urn string, properties map<string,string>")


def test_patches_of_writers_at_once_all_stay(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    assert sinks.properties(spark, out).count() == 0
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: sinks.patch_properties(patches(spark, [("m", {f"k{i}": str(i)}), (f"m{i}", {"own": "x"})]), out), range(4)))
    got = lambda: {r["model_urn"]: r["properties"] for r in sinks.properties(spark, out).collect()}
    want = {"m": {f"k{i}": str(i) for i in range(4)}} | {f"m{i}": {"own": "x"} for i in range(4)}
    assert got() == want
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "model_properties").glob("version=*/*.parquet")}
    sinks.patch_properties(patches(spark, [("m", {"k0": "new", "k1": None}), ("m3", {"own": None})]), out)
    want["m"] = {"k0": "new", "k2": "2", "k3": "3"}
    del want["m3"]
    assert got() == want
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())  # a patch of one model leaves all other files alone
    sinks.compact_properties(spark, out)
    assert got() == want and len(list((tmp_path / "out" / "model_properties").glob("version=*"))) == 1
    sinks.patch_properties(patches(spark, [("m0", {"own": "y"})]), out)
    assert got() == want | {"m0": {"own": "y"}}


def test_compaction_gives_way_to_a_patch(spark, tmp_path, monkeypatch):
    out = f"file://{tmp_path}/out"
    sinks.patch_properties(patches(spark, [("m", {"a": "1"})]), out)
    real = sinks.properties

    def late(*args):
        monkeypatch.setattr(sinks, "properties", real)
        found = real(*args)
        sinks.patch_properties(patches(spark, [("m", {"b": "2"})]), out)
        return found

    monkeypatch.setattr(sinks, "properties", late)
    with pytest.raises(manifest.ConflictError):
        sinks.compact_properties(spark, out)
    assert sinks.properties(spark, out).select(F.map_keys("properties")).first()[0] == ["a", "b"]
