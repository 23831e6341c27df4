"""Line files below a folder: links, nested folders, unreadable files, stretches."""

import os

import pytest

from tidemark.sources import tree


@pytest.fixture
def root(tmp_path):
    at, other = tmp_path / "root", tmp_path / "other"
    for p in (at / "a" / "b", other):
        p.mkdir(parents=True)
    (at / "one.jsonl").write_text('{"timestamp":"2024-03-01T10:00:00Z","sessionId":"s1","cwd":"/w/p"}\n{bad\n{"timestamp":"2024-02-01T10:00:00Z"}\n')
    (at / "a" / "two.jsonl").write_bytes(b'{"type":"session_meta","payload":{"id":"s2","cwd":"/w/p2"}}\n\xff\xfe no utf-8\nlast without end')
    (at / "a" / "b" / "empty.jsonl").write_text("")
    (at / "a" / "b" / "skipped.txt").write_text("x\n")
    (at / "a" / "b" / "UPPER.JSONL").write_text("x\n")
    (other / "secret.jsonl").write_text("secret\n")
    os.symlink(other / "secret.jsonl", at / "leaves.jsonl")
    os.symlink(other, at / "away")
    os.symlink(at / "one.jsonl", at / "a" / "again.jsonl")
    os.symlink(at, at / "a" / "b" / "loop")
    os.symlink(at / "nothing", at / "dangling.jsonl")
    return at


def test_links_and_nested_folders(spark, root):
    rows = tree.read_lines(spark, str(root)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path, []).append(r)
    assert sorted(by) == ["a/again.jsonl", "a/b/empty.jsonl", "a/two.jsonl", "away", "dangling.jsonl", "leaves.jsonl", "one.jsonl"]
    assert {p: by[p][0].why for p in by if by[p][0].value is None} == {"a/b/empty.jsonl": None, "away": "outside", "dangling.jsonl": "unreadable", "leaves.jsonl": "outside"}
    assert [r.value for r in by["a/two.jsonl"]][1:] == ["�� no utf-8", "last without end"] and not any("secret" in (r.value or "") for r in rows)
    surveyed = {r.path: r for r in tree.survey(tree.read_lines(spark, str(root))).collect()}
    one = surveyed["one.jsonl"]
    assert (one.lines, one.bad, one.session, one.cwd, str(one["first"]), one.bytes) == (3, 1, "s1", "/w/p", "2024-02-01 10:00:00", (root / "one.jsonl").stat().st_size)
    assert surveyed["a/two.jsonl"].session == "s2" and surveyed["a/two.jsonl"]["first"] is None and surveyed["a/b/empty.jsonl"].lines == 0
    kept = lambda **x: sorted(r.path for r in tree.since(tree.survey(tree.read_lines(spark, str(root))), **x).collect())
    assert kept(day="2024-02-01") == ["a/again.jsonl", "one.jsonl"] and kept(day="2024-02-02") == [] and kept(project="/w/p") == ["a/again.jsonl", "one.jsonl"] and kept(project="/w/p2") == ["a/two.jsonl"]


def test_stretches_give_each_line_once(spark, root):
    lines = [f"{i} " + "x" * (i * 37 % 90) for i in range(400)]
    (root / "long.jsonl").write_text("\n".join(lines) + "\n")
    want = sorted(map(str, tree.read_lines(spark, str(root)).collect()))
    for part in (1, 7, 100, 5000):
        df = tree.read_lines(spark, str(root), part_bytes=part) if part > 1 else tree.read_lines(spark, str(root), part_bytes=64)
        assert sorted(map(str, df.collect())) == want
    got = tree.read_lines(spark, str(root), part_bytes=1000).where("path = 'long.jsonl'")
    assert [r.value for r in got.orderBy("at").collect()] == lines and got.rdd.getNumPartitions() > 10
    assert tree.read_lines(spark, str(root), pattern="none*").where("why is null").count() == 0
