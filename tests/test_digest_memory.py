"""Files of a mounted folder that are too large to hold stream through their digest."""

import hashlib

from medloom.sources import readers


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_large_mounted_files_are_not_held_whole(spark, tmp_path):
    large, small, empty = tmp_path / "large.bin", tmp_path / "small.bin", tmp_path / "empty.bin"
    large.write_bytes(b"abcdefgh" * (readers.HELD_BYTES // 8) + b"x")
    small.write_bytes(b"small")
    empty.write_bytes(b"")
    df = readers.file_digests(spark, [str(large), str(small), str(empty)])
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in df.collect()}
    assert got == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in (large, small, empty)}
    assert "file_digests" in plan(df)
    assert "file_digests" not in plan(readers.file_digests(spark, [str(small), str(empty)]))
