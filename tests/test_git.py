"""Tracked, staged and unstaged files, against git itself."""

import os
import shutil
import subprocess

import pytest

from loomstore.engine import Engine
from loomstore.sources import git

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="needs git to compare with")
ENV = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null", "PATH": os.environ["PATH"], "HOME": "/tmp"}


def run(root, *args):
    return subprocess.run(["git", "-c", "core.quotePath=false", *args], cwd=root, env=ENV, check=True, capture_output=True, text=True).stdout


def told(root, *args):
    kinds = {"A": "created", "M": "modified", "D": "deleted", "T": "modified"}
    return sorted((p, kinds[k]) for k, p in (x.split("\t") for x in run(root, "diff", "--no-renames", "--name-status", *args).splitlines()))


def check(spark, root):
    rows = git.sides(spark, str(root))
    got = lambda df: sorted((r["path"], r["change_type"]) for r in df.collect())
    assert sorted(r["path"] for r in git.tracked(rows).collect()) == sorted(run(root, "ls-files").splitlines())
    assert got(git.staged(rows)) == told(root, "--cached")
    assert got(git.unstaged(rows)) == told(root)


@pytest.mark.parametrize("version", ["2", "4"])
def test_lists_equal_those_of_git(spark, tmp_path, version):
    root = tmp_path / "r"
    (root / "src/deep/er").mkdir(parents=True)
    run(root, "init", "-q", "-b", "main")
    run(root, "config", "index.version", version)
    check(spark, root)  # before the first commit, without an index
    for k in range(30):
        (root / f"src/file{k}.py").write_text("".join(f"line {j} of {k // 10}\n" for j in range(200)))
    (root / "src/deep/er/ünï.txt").write_text("x")
    (root / ".hidden").write_text("h")
    os.symlink("src/file1.py", root / "link")
    run(root, "add", "-A")
    check(spark, root)
    run(root, "commit", "-qm", "one")
    for k in range(0, 30, 3):
        (root / f"src/file{k}.py").write_text("".join(f"line {j} of {k // 10}\n" for j in range(200)) + "more\n")
    run(root, "commit", "-qam", "two")
    run(root, "gc", "-q", "--aggressive")  # packs, with deltas, and packed refs
    check(spark, root)
    (root / "src/file1.py").write_text("changed")
    (root / "src/new.py").write_text("new")
    run(root, "add", "src/file1.py", "src/new.py")
    run(root, "rm", "-q", "--cached", "src/file2.py")
    run(root, "mv", "src/file4.py", "src/moved.py")
    (root / "src/new.py").write_text("changed again")
    (root / "src/file5.py").unlink()
    os.utime(root / "src/file7.py", (1, 1))  # of another time only
    os.chmod(root / "src/file8.py", 0o755)
    (root / ".hidden").write_text("i")
    check(spark, root)
    engine = Engine(spark, str(tmp_path / "db"))
    changed = {r["path"] for r in engine.context.changed_in_git(str(root)).collect()}
    assert {"src/new.py", "src/file5.py", "src/moved.py", ".hidden"} <= changed and "src/file7.py" not in changed
    assert engine.context.unified(engine.context.changed_in_git(str(root)))["impacted"].count() == 0
