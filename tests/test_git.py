"""A made repository's objects, log and pairs of files, loose and packed, against literals and the program's own log."""

import os
import shutil
import subprocess

import pytest

from tessella.sources import git

pytestmark = pytest.mark.skipif(not shutil.which("git"), reason="a repository is made by the program")


def run(root, *args, at=0):
    stamp = f"{1_700_000_000 + at} +0000"
    env = os.environ | {"GIT_AUTHOR_DATE": stamp, "GIT_COMMITTER_DATE": stamp, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null", "HOME": str(root)}
    who = ("-c", "user.name=A B", "-c", "user.email=a@b.c", "-c", "init.defaultBranch=main", "-c", "gc.auto=0", "-c", "protocol.file.allow=always")
    return subprocess.run(["git", "-C", str(root), *who, *args], env=env, check=True, capture_output=True, text=True).stdout


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run(root, "init", "-q")
    n = 0

    def commit(message, files=(), gone=(), moved=()):
        nonlocal n
        n += 1
        for name, text in dict(files).items():
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_text(text)
        for name in gone:
            run(root, "rm", "-q", name)
        for a, b in moved:
            (root / b).parent.mkdir(parents=True, exist_ok=True)
            run(root, "mv", a, b)
        run(root, "add", "-A")
        run(root, "commit", "-q", "--allow-empty", "-m", message, at=n)

    long = "".join(f"line {i} of a file that is long enough for a delta\n" for i in range(300))
    commit("first\n\nwith a body", {"a.txt": "1", "src/b.py": long, "src/deep/er/c.py": "3"})
    commit("two", {"a.txt": "2", "src/b.py": long.replace("line 7 ", "line seven ")})
    commit("nothing")
    commit("moved", moved=[("src/deep/er/c.py", "src/other/c.py")])
    shutil.rmtree(root / "src/deep", ignore_errors=True)
    commit("a file where a directory was", {"src/deep": "now a file", "é ü.txt": "x"})
    run(root, "checkout", "-q", "-b", "side")
    commit("on the side", {"side.txt": "s", "src/b.py": long.replace("line 9 ", "line nine ")})
    run(root, "checkout", "-q", "main")
    commit("many", {f"m/{i}.txt": str(i) for i in range(60)})
    n += 1
    run(root, "merge", "-q", "--no-ff", "side", "-m", "merge", at=n)
    commit("gone", gone=["a.txt"], files={"src/b.py": "short"})
    run(root, "commit", "-q", "--amend", "-m", "gone, amended", at=n)
    (root / "src/b.py").chmod(0o755)
    commit("mode")
    return root


WANT = [
    {"a.txt", "src/b.py", "src/deep/er/c.py"}, {"a.txt", "src/b.py"}, {"src/other/c.py"}, {"src/deep", "é ü.txt"}, {"side.txt", "src/b.py"}, {f"m/{i}.txt" for i in range(60)}, {"a.txt", "src/b.py"}, {"src/b.py"},
]


def logged(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.time, r.commit), set()).add(r.path)
    return [v for _, v in sorted(out.items())], {c for _, c in out}


def told(root, *args):
    out = {}
    for part in run(root, "-c", "core.quotePath=false", "log", "--name-only", "--no-merges", "--pretty=format:%x00%H", *args).split("\0")[1:]:
        sha, *files = [x for x in part.split("\n") if x]
        out[sha] = set(files)
    return out


def test_log_loose_and_packed(spark, repo):
    assert logged(git.log(spark, str(repo)))[0] == WANT
    run(repo, "gc", "-q", "--aggressive", "--prune=now")
    assert [x for x in (repo / ".git/objects/pack").iterdir() if x.suffix == ".pack"]
    pack = git.Pack(str(next(x for x in (repo / ".git/objects/pack").iterdir() if x.suffix == ".pack")))
    assert any(pack._head(at)[1] is not None for at, _ in pack.names), "no delta was made"
    sides, shas = logged(git.log(spark, str(repo), limit=4, under="src"))
    assert shas == set(told(repo, "-n4", "--", "src")) and sides == [{x for x in w if x.startswith("src/")} for w in (WANT[3], WANT[4], WANT[6], WANT[7])]
    blobs = {r.sha: bytes(r.data) for r in git.objects(spark, str(repo), "blob").collect()}
    for line in run(repo, "ls-tree", "-r", "HEAD").splitlines():
        sha = line.split()[2]
        assert blobs[sha] == run(repo, "cat-file", "blob", sha).encode()


def test_commits_and_pairs(spark, repo):
    rows = {r.message.strip(): r for r in git.commits(git.objects(spark, str(repo))).collect()}
    first = rows["first\n\nwith a body"]
    assert first.author == "A B <a@b.c>" and first.authored == first.committed == 1_700_000_001 and first.parents == []
    assert len(rows["merge"].parents) == 2 and first.sha in {r.sha for r in git.reachable(git.commits(git.objects(spark, str(repo))), rows["merge"].sha).collect()}
    pairs = {(r.path_a.removeprefix(f"{repo}/"), r.path_b.removeprefix(f"{repo}/")): r.n for r in git.co_change(spark, str(repo)).collect()}
    assert pairs == {("a.txt", "src/b.py"): 3, ("a.txt", "src/deep/er/c.py"): 1, ("src/b.py", "src/deep/er/c.py"): 1, ("src/deep", "é ü.txt"): 1, ("side.txt", "src/b.py"): 1}


def test_refs_and_empty_repositories(spark, repo, tmp_path):
    assert git.resolve(str(repo)) == run(repo, "rev-parse", "HEAD").strip() and git.resolve(str(repo), "refs/heads/side") == run(repo, "rev-parse", "side").strip()
    run(tmp_path, "init", "-q")
    assert git.resolve(str(tmp_path)) is None and git.log(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        git.directory(str(tmp_path / "none"))
