import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.sources import avi, movie


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r = np.random.default_rng(5)
    path = tmp_path_factory.mktemp("avi")
    parts = [r.integers(0, 256, (n, 10, 13)).astype(np.uint8) for n in (7, 4, 12)]
    for i, p in enumerate(parts):
        (path / f"{i + 9}.avi").write_bytes(avi.encode(p))  # 9, 10, 11: by number, not by letters
    return path, np.concatenate(parts).astype(float), [len(p) for p in parts]


def stack(df, h, w):
    rows = df.orderBy("t").collect()
    return [x.t for x in rows], np.array([x.px for x in rows]).reshape(-1, h, w)


def test_files_are_one_movie_read_by_several_tasks(spark, folder):
    path, want, sizes = folder
    df = movie.read(spark, str(path), frames_per_task=3)
    assert df.rdd.getNumPartitions() == sum(-(-n // 3) for n in sizes)
    t, got = stack(df, 10, 13)
    assert t == list(range(23)) and (got == want).all()
    assert [x.n for x in df.groupBy("file_no").agg(F.count("*").alias("n")).orderBy("file_no").collect()] == sizes
    assert movie.facts(str(path)) | {"files": None} == {"n": 23, "by_file": sizes, "height": 10, "width": 13, "files": None}
    assert movie.facts(str(path / "*.avi"), tsub=2)["by_file"] == [3, 2, 6]


def test_box_range_bins_and_mask(spark, folder):
    path, want, sizes = folder
    t, got = stack(movie.read(spark, str(path), box=(2, 8, 3, 11), t_range=(5, 13)), 6, 8)
    assert t == list(range(5, 13)) and (got == want[5:13, 2:8, 3:11]).all()
    mask = np.random.default_rng(1).random((10, 13)) > 0.5
    t, got = stack(movie.read(spark, str(path), box=(0, 10, 0, 12), mask=mask, ssub=2, tsub=2, frames_per_task=4), 5, 6)
    starts = np.cumsum([0, *sizes])
    bins = [want[a + 2 * i : a + 2 * i + 2].mean(0) for a, n in zip(starts, sizes) for i in range(n // 2)]
    masked = np.where(mask, bins, 0.0)[:, :, :12].reshape(len(bins), 5, 2, 6, 2).mean((2, 4))
    assert t == list(range(11)) and np.allclose(got, masked)
    t, got = stack(movie.read(spark, str(path), frames=[22, 0, 7, 400]), 10, 13)
    assert t == [0, 7, 22] and (got == want[[0, 7, 22]]).all()
    assert movie.read(spark, str(path), t_range=(30, 40)).count() == 0


def test_time_filters_reach_the_planner(spark, folder):
    path, want, _ = folder
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df = movie.read(spark, str(path), frames_per_task=2).where("t >= 9 AND t < 12 AND file_no >= 0")
        assert df.rdd.getNumPartitions() == 2 and stack(df, 10, 13)[0] == [9, 10, 11]
    finally:
        spark.conf.set(key, before)
    assert stack(movie.read(spark, str(path)).where("t > 20"), 10, 13)[0] == [21, 22]


def test_only_the_rows_of_a_box_are_read(folder, monkeypatch):
    path, want, _ = folder
    seen = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            seen.append(n)
            return self.f.read(n)

        def __getattr__(self, name):
            return getattr(self.f, name)

    plain = movie.opened

    @movie.contextmanager
    def counted(p):
        with plain(p) as f:
            yield Counted(f)

    monkeypatch.setattr(movie, "opened", counted)
    reader = movie.MovieReader({"path": str(path), "box": "4:6:0:5", "start": "8", "stop": "10"})
    parts = reader.partitions()
    assert sum(seen) < 23 * 8 + 3 * 4000 and len(parts) == 1  # heads of chunks only
    seen.clear()
    got = np.array(next(iter(reader.read(parts[0]))).column(5).to_pylist()).reshape(-1, 2, 5)
    assert (got == want[8:10, 4:6, :5]).all() and seen == [2 * 16, 2 * 16]


def halves(data, codec, height, width):
    """A codec of this test: every second pixel, twice."""
    return np.repeat(np.frombuffer(data, np.uint8), 2)[: height * width].reshape(height, width)


def test_compressed_files_need_a_decoder(spark, tmp_path):
    frames = np.random.default_rng(2).integers(0, 256, (3, 6, 8)).astype(np.uint8)
    frames[:, :, 1::2] = frames[:, :, ::2]
    data = bytearray(avi.encode(frames))
    at = data.index(b"strf") + 8
    data[at + 16 : at + 20] = b"HALF"
    head, body = bytes(data[: data.index(b"movi") + 4]), b""
    for f in frames:
        body += b"00dc" + struct.pack("<I", 24) + f[:, ::2].tobytes()
    (tmp_path / "1.avi").write_bytes(head[:4] + struct.pack("<I", len(head) + len(body) - 8) + head[8:-8] + struct.pack("<I", len(body) + 4) + b"movi" + body)
    with pytest.raises(Exception, match=r"compressed \(HALF\): name a decoder"):
        movie.read(spark, str(tmp_path)).count()
    t, got = stack(movie.read(spark, str(tmp_path), decoder="tests.test_movie_source:halves", box=(1, 5, 0, 8)), 4, 8)
    assert t == [0, 1, 2] and (got == frames[:, 1:5]).all()


def test_errors_name_the_cause(spark, tmp_path, folder):
    (tmp_path / "1.avi").write_bytes(avi.encode(np.zeros((2, 4, 4), np.uint8)))
    (tmp_path / "2.avi").write_bytes(avi.encode(np.zeros((2, 4, 6), np.uint8)))
    (tmp_path / "x.bin").write_bytes(b"RIFF\0\0\0\0AVI ")
    for path, settings, words in ((str(tmp_path), {}, "different sizes"), (str(tmp_path / "*.mov"), {}, "no movie files"), (str(tmp_path / "x.bin"), {}, "no AVI file"), (str(tmp_path / "1.avi"), {"box": (0, 5, 0, 4)}, "not within"), (str(tmp_path / "1.avi"), {"mask": np.ones((3, 3), bool)}, "does not match")):
        with pytest.raises(Exception, match=words):
            movie.read(spark, path, **settings).count()
