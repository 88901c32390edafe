"""Conversions that are broken off, repeated and go on."""

import os
import shutil

from inversia.plans import resume
from tests.test_raster import put


def state(spark, out):
    rows = resume.read_points(spark, out).collect()
    return sorted((r.file.rsplit("/", 1)[1], r.key, r.value) for r in rows)


def test_only_what_is_new_is_converted(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(source)
    put(tmp_path / "in", "grid_tmean_us_30s_20210102")
    first = resume.convert_new_rasters(spark, source, out, region=None)
    assert [r.name for r in first["converted"].collect()] == ["grid_tmean_us_30s_20210102.bil"]
    before = state(spark, out)
    assert len(before) == 11
    # nothing new: nothing converted, nothing changed
    assert resume.convert_new_rasters(spark, source, out, region=None)["converted"].collect() == []
    assert state(spark, out) == before
    # a broken run's points count for nothing
    points = f"{out}/{resume.POINTS}"
    shutil.copytree(f"{points}/{os.listdir(points)[0]}", f"{points}/run=99999999-broken")
    put(tmp_path / "in", "grid_ppt_us_30s_20220102")
    (tmp_path / "in" / "grid_ppt_us_30s_20220103.bil").write_bytes(b"short")
    second = resume.convert_new_rasters(spark, source, out, region=None)
    assert [r.name for r in second["converted"].collect()] == ["grid_ppt_us_30s_20220102.bil"]
    assert [r.name for r in second["failures"].collect()] == ["grid_ppt_us_30s_20220103.bil"]
    assert len(state(spark, out)) == 22 and {(r["year"], r["files"], r["failed"]) for r in second["report"].collect()} == {(2022, 2, 1)}
    # a file that could not be read is tried again, a changed file is converted again
    put(tmp_path / "in", "grid_ppt_us_30s_20220103")
    path = tmp_path / "in" / "grid_tmean_us_30s_20210102.bil"
    path.write_bytes(path.read_bytes())
    os.utime(path, (2_000_000_000, 2_000_000_000))
    third = resume.convert_new_rasters(spark, source, out, region=None)
    assert sorted(r.name for r in third["converted"].collect()) == ["grid_ppt_us_30s_20220103.bil", "grid_tmean_us_30s_20210102.bil"]
    assert len(state(spark, out)) == 33 and set(before) <= set(state(spark, out))
