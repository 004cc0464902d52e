"""Digests of files against plain ones; of a large file only its ends are read."""

import hashlib
import os

import pytest

from folia.sources import digests


@pytest.mark.parametrize("size", [0, 1, 999, 1000, 1001, 1999, 2000, 2500, 9000])
@pytest.mark.parametrize("end", [1, 1000, 5000])
def test_ranges(size, end):
    raw, seen = os.urandom(size), []

    def read(at, n):
        seen.append(n)
        return raw[at : at + n]

    got, count = digests.digest(read, size, end, 1000)
    if size <= 1000:
        assert (got, count) == (hashlib.sha256(raw).hexdigest(), size)
    else:
        want = hashlib.sha256(raw[:end] + raw[max(0, size - end) :] + str(size).encode())
        assert (got, count) == ("p:" + want.hexdigest(), 2 * min(end, size)) and sum(seen) == count


def test_a_short_read_is_an_error():
    with pytest.raises(OSError):
        digests.digest(lambda at, n: b"", 5)


def test_files(spark, tmp_path):
    folder = tmp_path / "files" / "deep"
    folder.mkdir(parents=True)
    large = b"head" * (1 << 18) + bytes(49 << 20) + b"tail" * (1 << 18)
    hidden = large[: 5 << 20] + b"x" + large[(5 << 20) + 1 :]  # differs in the middle alone
    for name, raw in (("a.pdf", large), ("b.pdf", hidden), ("c.pdf", b"small"), ("d.pdf", b"small"), ("e.pdf", b""), ("f.txt", b"small")):
        (folder / name).write_bytes(raw)
    found = digests.file_digests(spark, f"file://{tmp_path}/files", "*.pdf").cache()
    rows = {r["path"].rsplit("/", 1)[1]: r for r in found.collect()}
    assert set(rows) == {"a.pdf", "b.pdf", "c.pdf", "d.pdf"}
    assert rows["a.pdf"]["bytes_read"] == 2 << 20 and rows["a.pdf"]["size"] == 51 << 20
    assert rows["a.pdf"]["digest"] == rows["b.pdf"]["digest"] == "p:" + hashlib.sha256(large[: 1 << 20] + large[-(1 << 20) :] + str(51 << 20).encode()).hexdigest()
    same = {r["keeper"].rsplit("/", 1)[1]: (r["trusted"], r["copies"]) for r in digests.duplicates(found).collect()}
    assert same == {"a.pdf": (False, 2), "c.pdf": (True, 2)}
