"""What a git repository tracks, as a data source: its index, the tree of its head, and its files as they are.

format("git-files") reads a checked-out repository that executors can open, without
git: the index file (versions 2 to 4, with their shortened paths), objects as files
and in packs (with deltas), and the stored size and time of each file.  Rows are
(side, path, mode, sha): `index`, `head` and `work`; files are hashed only where
their size or time differs from the index, in ranges of the index's entries.
Comparing the sides is left to joins.  Filters on checkout (line ends) are not
applied; links and submodules have no `work` row; unmerged paths have one of each stage.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = "side string, path string, mode int, sha string"
#: Entries of the index whose files one task looks at.
RANGE = 10_000
_FILE = 0o100000


def _folder(root: str) -> str:
    """The folder that holds the repository's own files."""
    path = os.path.join(root, ".git")
    if os.path.isfile(path):  # a linked tree names its folder
        with open(path) as f:
            return os.path.join(root, f.read().split(":", 1)[1].strip())
    return path


def index_entries(data: bytes) -> Iterator[tuple[str, int, str, int, int]]:
    """(path, mode, sha, size, time in nanoseconds) of an index file's entries, in their order."""
    mark, version, count = struct.unpack(">4sII", data[:12])
    if mark != b"DIRC" or version not in (2, 3, 4):
        raise ValueError("not an index of version 2 to 4")
    at, before = 12, b""
    for _ in range(count):
        _, _, seconds, nanos, _, _, mode, _, _, size = struct.unpack(">10I", data[at : at + 40])
        sha, flags = data[at + 40 : at + 60].hex(), struct.unpack(">H", data[at + 60 : at + 62])[0]
        name = at + 62 + 2 * (version > 2 and bool(flags & 0x4000))
        if version == 4:
            cut, name = _varint(data, name)
            end = data.index(b"\0", name)
            before = before[: len(before) - cut] + data[name:end]
            at = end + 1
        else:
            end = data.index(b"\0", name)
            before = data[name:end]
            at += (end - at + 8) // 8 * 8
        yield before.decode("utf-8", "surrogateescape"), mode, sha, size, seconds * 10**9 + nanos


def _varint(data: bytes, at: int) -> tuple[int, int]:
    """A number of 7 bits a byte, most first, each further byte adding one; and where it ends."""
    value = data[at] & 127
    while data[at] & 128:
        at += 1
        value = (value + 1 << 7) | data[at] & 127
    return value, at + 1


class Objects:
    """A repository's objects, by their sha: (kind, content)."""

    KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}

    def __init__(self, folder: str):
        self.own = folder  # a linked tree's own head; objects and branches are shared
        common = os.path.join(folder, "commondir")
        if os.path.isfile(common):
            with open(common) as f:
                folder = os.path.normpath(os.path.join(folder, f.read().strip()))
        self.folder, self.packs = folder, []
        packs = os.path.join(folder, "objects", "pack")
        for name in sorted(os.listdir(packs)) if os.path.isdir(packs) else ():
            if name.endswith(".idx"):
                with open(os.path.join(packs, name), "rb") as f:
                    self.packs.append((f.read(), os.path.join(packs, name[:-4] + ".pack")))

    def get(self, sha: str) -> tuple[str, bytes]:
        path = os.path.join(self.folder, "objects", sha[:2], sha[2:])
        if os.path.isfile(path):
            with open(path, "rb") as f:
                head, _, body = zlib.decompress(f.read()).partition(b"\0")
            return head.split()[0].decode(), body
        for index, pack in self.packs:
            if (at := self._place(index, bytes.fromhex(sha))) is not None:
                with open(pack, "rb") as f:
                    return self._packed(f, at)
        raise KeyError(sha)

    @staticmethod
    def _place(index: bytes, sha: bytes) -> int | None:
        if index[:8] != b"\xfftOc\0\0\0\2":
            raise ValueError("not a pack index of version 2")
        fan = struct.unpack(">256I", index[8:1032])
        low, high, n = fan[sha[0] - 1] if sha[0] else 0, fan[sha[0]], fan[255]
        while low < high:
            middle = (low + high) // 2
            here = index[1032 + 20 * middle : 1052 + 20 * middle]
            if here == sha:
                offsets = 1032 + 24 * n
                at = struct.unpack(">I", index[offsets + 4 * middle : offsets + 4 * middle + 4])[0]
                if at >> 31:
                    at = struct.unpack(">Q", index[offsets + 4 * n + 8 * (at & 0x7FFFFFFF) :][:8])[0]
                return at
            low, high = (middle + 1, high) if here < sha else (low, middle)
        return None

    def _packed(self, f, at: int) -> tuple[str, bytes]:
        f.seek(at)
        head = f.read(64)
        kind, k = head[0] >> 4 & 7, 1
        while head[k - 1] & 128:
            k += 1
        base = None
        if kind == 6:
            back, k = _varint(head, k)
            base = lambda: self._packed(f, at - back)
        elif kind == 7:
            sha = head[k : k + 20].hex()
            base, k = lambda: self.get(sha), k + 20
        f.seek(at + k)
        body, out = zlib.decompressobj(), b""
        while not body.eof:
            out += body.decompress(f.read(1 << 16))
        if base is None:
            return self.KINDS[kind], out
        kind_of_base, source = base()
        return kind_of_base, _patched(source, out)

    def head(self) -> str | None:
        """The sha of the head's commit; none before the first."""
        with open(os.path.join(self.own, "HEAD")) as f:
            ref = f.read().strip()
        while ref.startswith("ref:"):
            name = ref[4:].strip()
            for folder in (self.own, self.folder):
                if os.path.isfile(path := os.path.join(folder, name)):
                    with open(path) as f:
                        ref = f.read().strip()
                    break
            else:
                packed = os.path.join(self.folder, "packed-refs")
                lines = []
                if os.path.isfile(packed):
                    with open(packed) as f:
                        lines = f.read().split("\n")
                ref = next((x.split()[0] for x in lines if x.endswith(" " + name) and x[:1] not in "#^"), "")
        return ref or None

    def files(self, tree: str, above: str = "") -> Iterator[tuple[str, int, str]]:
        """(path, mode, sha) of the files below a tree."""
        data, at = self.get(tree)[1], 0
        while at < len(data):
            end = data.index(b"\0", at)
            mode, name = data[at:end].split(b" ", 1)
            sha, at = data[end + 1 : end + 21].hex(), end + 21
            path = above + name.decode("utf-8", "surrogateescape")
            if int(mode, 8) == 0o40000:
                yield from self.files(sha, path + "/")
            else:
                yield path, int(mode, 8), sha


def _patched(source: bytes, delta: bytes) -> bytes:
    """What a delta makes of its source: runs of it, and bytes of its own."""
    at = 0
    for _ in range(2):  # the sizes of source and result
        while delta[at] & 128:
            at += 1
        at += 1
    out = []
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 128:
            values = []
            for bits, first in ((4, 0), (3, 4)):
                value = 0
                for k in range(bits):
                    if op >> first + k & 1:
                        value |= delta[at] << 8 * k
                        at += 1
                values.append(value)
            out.append(source[values[0] : values[0] + (values[1] or 0x10000)])
        else:
            out.append(delta[at : at + op])
            at += op
    return b"".join(out)


class GitFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git-files"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def _entries(self) -> list[tuple[str, int, str, int, int]]:
        path = os.path.join(_folder(self.root), "index")
        if not os.path.isfile(path):
            return []
        with open(path, "rb") as f:
            return list(index_entries(f.read()))

    def partitions(self):
        return [InputPartition(("head", 0)), InputPartition(("index", 0)), *(InputPartition(("work", k)) for k in range(0, len(self._entries()), RANGE))]

    def read(self, partition):
        side, first = partition.value
        if side == "head":
            objects = Objects(_folder(self.root))
            if commit := objects.head():
                tree = objects.get(commit)[1].split(b"\n", 1)[0].split()[1].decode()
                for path, mode, sha in objects.files(tree):
                    yield side, path, mode, sha
        elif side == "index":
            for path, mode, sha, _, _ in self._entries():
                yield side, path, mode, sha
        else:
            for path, mode, sha, size, time in self._entries()[first : first + RANGE]:
                if mode & 0o170000 != _FILE:
                    continue
                try:
                    found = os.lstat(os.path.join(self.root, path))
                except OSError:
                    continue
                if (found.st_size & 0xFFFFFFFF, found.st_mtime_ns) != (size, time):
                    with open(os.path.join(self.root, path), "rb") as f:
                        content = f.read()
                    sha = hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()
                yield side, path, 0o100755 if found.st_mode & 0o100 else 0o100644, sha


def sides(spark: SparkSession, root: str) -> DataFrame:
    """ROWS of the repository at `root`."""
    spark.dataSource.register(GitFiles)
    return spark.read.format("git-files").load(root)


def _compared(rows: DataFrame, old: str, new: str) -> DataFrame:
    of = lambda side, name: rows.where(F.col("side") == side).groupBy("path").agg(F.min(F.struct("mode", "sha")).alias(name))
    both = of(old, "was").join(of(new, "now"), "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return both.select("path", kind.alias("change_type")).where("change_type is not null")


def tracked(rows: DataFrame) -> DataFrame:
    """(path) of all files in the index."""
    return rows.where("side = 'index'").select("path").distinct()


def staged(rows: DataFrame) -> DataFrame:
    """(path, change_type) between the head's tree and the index."""
    return _compared(rows, "head", "index")


def unstaged(rows: DataFrame) -> DataFrame:
    """(path, change_type) between the index and the files as they are."""
    return _compared(rows.where(F.col("mode").isin(0o100644, 0o100755)), "index", "work")
