"""Trees under paths and URIs, and version history that is whole or fails."""

from __future__ import annotations

import datetime
import subprocess

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators.ranking import _top
from quarry.sources import git, tree


def test_uri_roots_keep_all_names_and_the_ignore_file(spark, tmp_path):
    for name in ("pkg/__init__.py", "pkg/_priv.py", "pkg/c.py", "pkg/__tests__/a.test.ts", "node_modules/x.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / "pkg/big.py").write_text("y = 2\n" * 200_000)
    (tmp_path / ".gitignore").write_text("_priv.py\n")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        read = {r.path for r in tree.read_files(spark, root).select("path").collect()}
        assert read == {".gitignore", "pkg/__init__.py", "pkg/_priv.py", "pkg/c.py", "pkg/__tests__/a.test.ts"}
        assert {r.path for r in tree.scan_tree(spark, root, "r").select("path").collect()} == {"pkg/__init__.py", "pkg/c.py", "pkg/__tests__/a.test.ts"}
        assert "pkg/big.py" in {r.path for r in tree.scan_tree(spark, root, "r", max_bytes=None).select("path").collect()}


def test_log_records_become_commits(spark):
    raw = "\0abc\x002024-01-02T03:04:05+02:00\na/b.py\nc d.py\n\n\0def\0bad\nx\n\0eee\x002024-01-02T03:04:05Z\n"
    found = git.commits_of(spark.createDataFrame(list(git.records(raw)), git.RECORD)).collect()
    assert [tuple(r) for r in found] == [("abc", datetime.datetime(2024, 1, 2, 1, 4, 5), 120, ["a/b.py", "c d.py"]), ("def", None, None, ["x"])]


def test_a_failing_slice_raises(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    with pytest.raises(RuntimeError, match="git .*log.* failed"):
        list(git._LogReader({"path": str(tmp_path)}).read(git._Slice(0, 10)))


def test_top_k_of_a_batch_keeps_ties_in_order():
    scores = np.array([[1.0, 0.0], [1.0, 2.0], [1.0, 2.0], [0.5, 2.0]])
    row, column = _top(scores, pa.array([9, 3, 5, 1]), 2)
    assert sorted(zip(column.tolist(), row.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 1), (1, 3)]
