import io
import random

import pytest

from caseweave.sources.logs import last_lines, read_log_tail
from caseweave.streaming import snapshots as sn

FACT = "case_id int, fact_key string, fact_type string, summary string, quote string, review_status string, importance string, ord int"


def facts(spark, rows):
    return spark.createDataFrame([(c, k, "medical_event", s, "", "pending", "core", o) for c, k, s, o in rows], FACT)


def held(spark, folder, version=None):
    return {(r.case_id, r.fact_key): r.summary for r in sn.read_snapshot(spark, folder, version).collect()}


def listing(spark, folder):
    """Every data file of the folder."""
    out = set()
    for v in sn._names(spark, f"{folder}/data"):
        for b in sn._names(spark, f"{folder}/data/{v}"):
            out |= {(v, b, f) for f in sn._names(spark, f"{folder}/data/{v}/{b}")} if b.startswith("bucket=") else set()
    return out


def test_snapshot_in_buckets(spark, tmp_path):
    folder = f"file://{tmp_path}/facts"
    first = facts(spark, [(c, f"k{i}", "v1", 1) for c in range(4) for i in range(25)] + [(0, "k0", "v2", 2)])
    assert sn.merge_batch(first, 0, folder, 8)
    want = {(c, f"k{i}"): "v1" for c in range(4) for i in range(25)} | {(0, "k0"): "v2"}
    assert held(spark, folder) == want and len(sn.read_manifest(spark, folder)["buckets"]) == 8
    ids = {(r.case_id, r.fact_key): r.fact_id for r in sn.read_snapshot(spark, folder).collect()}

    # The next batch writes the buckets of its two keys; all other buckets keep their files.
    before, old = listing(spark, folder), sn.read_manifest(spark, folder)["buckets"]
    second = facts(spark, [(1, "k3", "v9", 1), (9, "new", "v1", 1)])
    touched = {str(r[0]) for r in second.select(sn.bucket_of(8)).collect()}
    assert sn.merge_batch(second, 1, folder, 8)
    new = sn.read_manifest(spark, folder)["buckets"]
    assert {b for b in new if new[b] != old.get(b)} == touched and before < listing(spark, folder)
    now = want | {(1, "k3"): "v9", (9, "new"): "v1"}
    assert held(spark, folder) == now and held(spark, folder, 1) == want
    assert all(ids[k] == r for k, r in {(r.case_id, r.fact_key): r.fact_id for r in sn.read_snapshot(spark, folder).collect()}.items() if k in ids)

    # Repeated and late batches change nothing, not even a file.
    files = listing(spark, folder)
    assert not sn.merge_batch(second, 1, folder, 8) and not sn.merge_batch(first, 0, folder, 8)
    assert listing(spark, folder) == files and held(spark, folder) == now
    # Another stream counts for itself; an empty batch is noted and writes no data.
    assert sn.merge_batch(first.limit(0), 0, folder, 8, "other") and listing(spark, folder) == files
    assert sn.read_manifest(spark, folder)["applied"] == {"facts": 1, "other": 0}
    with pytest.raises(ValueError, match="buckets"):
        sn.merge_batch(second, 2, folder, 4)


def test_a_batch_that_failed_before_its_manifest(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/facts"
    sn.merge_batch(facts(spark, [(1, "a", "v1", 1)]), 0, folder, 4)

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(sn, "_write_manifest", fails)
        with pytest.raises(OSError):
            sn.merge_batch(facts(spark, [(1, "a", "v2", 1), (1, "b", "v1", 1)]), 1, folder, 4)
    assert held(spark, folder) == {(1, "a"): "v1"}
    assert sn.merge_batch(facts(spark, [(1, "a", "v2", 1), (1, "b", "v1", 1)]), 1, folder, 4)
    assert held(spark, folder) == {(1, "a"): "v2", (1, "b"): "v1"}


def test_old_versions_expire(spark, tmp_path):
    folder = f"file://{tmp_path}/facts"
    for n in range(4):
        sn.merge_batch(facts(spark, [(1, "a", f"v{n}", 1)] + ([(2, "b", "v", 1)] if n == 0 else [])), n, folder, 64)
    assert sn.expire(spark, folder, 2) == 2 and sn.versions(spark, folder) == [3, 4]
    assert held(spark, folder) == {(1, "a"): "v3", (2, "b"): "v"} and held(spark, folder, 3) == {(1, "a"): "v2", (2, "b"): "v"}


class Counted(io.BytesIO):
    seen = 0

    def read(self, n=-1):
        out = super().read(n)
        self.seen += len(out)
        return out


@pytest.mark.parametrize("end", ["", "\n", "\r\n", "\n\n"])
def test_last_lines_of_a_file(end):
    rnd = random.Random(4)
    for lines in (0, 1, 2, 30):
        text = "\n".join("é" * rnd.randint(0, 9) for _ in range(lines)) + (end if lines else "")
        raw = text.encode()
        whole, at = [], 0
        for part in raw.split(b"\n"):
            whole.append((at, part.decode().removesuffix("\r")))
            at += len(part) + 1
        whole = whole[:-1] if not raw or raw.endswith(b"\n") else whole
        for n in (0, 1, 3, 29, 30, 99):
            for block in (1, 2, 7, 4096):
                assert last_lines(io.BytesIO(raw), len(raw), n, block) == (whole[-n:] if n else [])


def test_bytes_read_do_not_grow_with_the_log():
    read = []
    for lines in (1_000, 100_000):
        raw = b"".join(b"line %07d\n" % i for i in range(lines))
        f = Counted(raw)
        assert [x for _, x in last_lines(f, len(raw), 20, 256)] == [f"line {i:07d}" for i in range(lines - 20, lines)]
        read.append(f.seen)
    assert read[0] == read[1] <= 512


def test_tail_over_several_logs(spark, tmp_path):
    for name, lines in (("a.log", "a1\na2\n"), ("b.log", ""), ("c.log", "c1\nc2"), ("_SUCCESS", "x\n")):
        (tmp_path / name).write_text(lines)
    got = [r.line for r in read_log_tail(spark, str(tmp_path), 3).orderBy("line_no").collect()]
    assert got == ["a2", "c1", "c2"]
    assert [r.line for r in read_log_tail(spark, f"file://{tmp_path}/a.log", 9).orderBy("line_no").collect()] == ["a1", "a2"]
