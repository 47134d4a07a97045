"""Copies with attempts, and what is left where they fail."""

import os

from tidespan.sources import transfer


def test_copies_and_failures(spark, tmp_path):
    for n in (1, 5_000_000):
        (tmp_path / f"in{n}").write_bytes(os.urandom(n))
    (tmp_path / "empty").write_bytes(b"")
    out = tmp_path / "out" / "deep"
    rows = [("small", str(tmp_path / "in1"), str(out / "a")), ("large", f"file://{tmp_path}/in5000000", f"file://{out}/b"), ("missing", str(tmp_path / "nowhere"), str(out / "c")), ("empty", str(tmp_path / "empty"), str(out / "d")), ("null", None, str(out / "e"))]
    d = spark.createDataFrame(rows, "bytes_name string, source string, target string").repartition(3)
    got = {r.bytes_name: (r.bytes, r.tries, r.error) for r in transfer.transferred(d, "source", "target", attempts=2, wait=0.01).collect()}
    assert got["small"] == (1, 1, None) and got["large"] == (5_000_000, 1, None) and got["null"] == (None, 0, "no name")
    assert got["missing"][:2] == got["empty"][:2] == (None, 2) and "nothing was read" in got["empty"][2]
    assert sorted(os.listdir(out)) == ["a", "b"]  # no parts of files
    for name, n in (("a", 1), ("b", 5_000_000)):
        assert (out / name).read_bytes() == (tmp_path / f"in{n}").read_bytes()
    assert transfer.transferred(d.where("false"), "source", "target").count() == 0


def test_a_source_that_breaks_off_is_tried_again(tmp_path):
    (tmp_path / "in").write_bytes(b"x" * 1000)
    tries = []

    class Broken:
        def __init__(self, path):
            self.f = open(path, "rb")
            tries.append(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read(self, n):
            if len(tries) < 3 and self.f.tell():
                raise OSError("broken off")
            return self.f.read(min(n, 600))

    for expected in (False, False, True):
        try:
            assert transfer.copy(str(tmp_path / "in"), str(tmp_path / "out"), Broken) == 1000 and expected
        except OSError:
            assert not expected and os.listdir(tmp_path) == ["in"]
