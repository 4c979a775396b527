"""A tree of files as a data source: one partition for each group of folders, dot files included, pruned while walking."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmill.functions import names as N
from corpusmill.operators.classify import ScanOptions
from corpusmill.sources.ignore import Pattern, compile_lines, is_ignored, keep_globs

SCHEMA = "rel string, name string, size long, content binary"
IGNORE_FILES = (".gitignore", ".ignore", ".millignore")
_VENV = re.compile("(^|[^a-z])(venv|virtualenv|site-packages)([^a-z]|$)")
#: Roots that are never read.
BLOCKED = frozenset("bin boot dev etc lib lib64 proc run sbin sys usr".split())
#: How credential files are looked for: also where ignored or hidden, and up to a size of their own.
HARVEST = ScanOptions(include_hidden=True, respect_gitignore=False, max_file_size=4 << 20)


def check_root(path: str) -> str:
    """The real path of a root: no link itself, a folder, and not under a system folder."""
    path = unicodedata.normalize("NFKC", path)
    if os.path.islink(path.rstrip("/")):
        raise ValueError(f"{path} is a link")
    real = os.path.realpath(path)
    if not os.path.isdir(real):
        raise ValueError(f"{path} is no folder")
    first = real.strip("/").split("/")[0]
    if first in BLOCKED or not first:
        raise ValueError(f"{path} is a system folder")
    return real


def skips_folder(name: str, options: ScanOptions) -> bool:
    """Whether the walk doesn't enter a folder."""
    low = name.lower()
    if low in N.PRUNED_FOLDERS or low == "system volume information":
        return True
    if not options.include_venv and (low in N.VENV_NAMES or _VENV.search(low)):
        return True
    return low.startswith(".") and not options.include_hidden and low not in N.DOT_FOLDERS


def sensitive(name: str) -> bool:
    """Whether a name is one that may hold credentials, so that it is reported although it is hidden."""
    low = name.lower()
    stem, _, ext = low.rpartition(".")
    return (
        low == ".env" or (low.startswith(".env.") and low[5:] not in ("example", "sample", "template")) or ext in N.KEY_EXTENSIONS
        or low.startswith(("id_rsa", "id_ed25519", "id_ecdsa", "id_dsa")) or low in N.CREDENTIAL_STORES or (ext in N.DATA_EXTENSIONS and any(m in stem for m in N.DATA_MARKERS))
    )


def skips_file(name: str, options: ScanOptions) -> bool:
    """Whether the walk passes over a hidden file."""
    low = name.lower()
    return low.startswith(".") and not options.include_hidden and low not in N.DOT_FILES and not low.startswith(N.DOT_FILE_PREFIXES) and not sensitive(low)


def walk(root: str, options: ScanOptions) -> Iterator[tuple[str, int]]:
    """(relative path, size) of the files of a tree; links are passed over."""

    def enter(rel: str, rules: list[tuple[str, list[Pattern]]]) -> Iterator[tuple[str, int]]:
        here = os.path.join(root, rel) if rel else root
        if options.respect_gitignore:
            for f in IGNORE_FILES:
                if os.path.isfile(p := os.path.join(here, f)):
                    with open(p, errors="replace") as lines:
                        rules = [*rules, (rel, compile_lines(lines))]
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            if e.is_symlink():
                continue
            folder = e.is_dir()
            if options.respect_gitignore:
                last = None
                for base, patterns in rules:
                    own = path[len(base) + 1 :] if base else path
                    target = own + "/" if folder else own
                    for p in patterns:
                        if re.search(p.regex, target):
                            last = not p.negated
                if last:
                    continue
            if folder:
                if not skips_folder(e.name, options):
                    yield from enter(path, rules)
            elif e.is_file() and not skips_file(e.name, options):
                yield path, e.stat().st_size

    own = os.path.join(root, ".git/info/exclude")
    first: list[tuple[str, list[Pattern]]] = []
    if options.respect_gitignore and os.path.isfile(own):
        with open(own, errors="replace") as lines:
            first = [("", compile_lines(lines))]
    include, exclude = compile_lines(options.include_globs), compile_lines(options.exclude_globs)
    for rel, size in enter("", first):
        if keep_globs(rel, include, exclude):
            yield rel, size


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class TreeSource(DataSource):
    """``spark.read.format("tree").load(root)``; the option ``scan`` is a ScanOptions as text, and with ``sensitive`` only files that may hold credentials are read, whatever their extension."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], options_of(self.options.get("scan", "")), int(self.options.get("partition_bytes", 32 << 20)), self.options.get("sensitive", "") == "true")


class _Reader(DataSourceReader):
    def __init__(self, root: str, options: ScanOptions, most: int, sensitive: bool = False) -> None:
        self.root, self.options, self.most, self.sensitive = check_root(root), options, most, sensitive

    def partitions(self) -> list[InputPartition]:
        groups: list[list[tuple[str, int]]] = [[]]
        held = 0
        for rel, size in walk(self.root, self.options):
            if self.sensitive and not sensitive(rel.rsplit("/", 1)[-1]):
                continue
            if groups[-1] and held + size > self.most:
                groups.append([])
                held = 0
            groups[-1].append((rel, size))
            held += min(size, self.options.max_file_size)
        return [_Files(g) for g in groups]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for rel, size in partition.files:
            name = rel.rsplit("/", 1)[-1]
            ext = os.path.splitext(name.lower())[1][1:]
            # what names and sizes rule out is not read
            if size > self.options.max_file_size or (ext in N.BINARY_EXTENSIONS and not self.sensitive):
                yield rel, name, size, None
                continue
            try:
                with open(os.path.join(self.root, rel), "rb") as f:
                    yield rel, name, size, f.read()
            except OSError:
                yield rel, name, size, None


def options_of(text: str) -> ScanOptions:
    """ScanOptions from JSON."""
    import json

    given = json.loads(text) if text else {}
    return ScanOptions(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def read_tree(spark: SparkSession, root: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """The files of a tree: (rel, name, size, content)."""
    import json
    from dataclasses import asdict

    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("scan", json.dumps(asdict(options))).load(root)


def read_credentials(spark: SparkSession, root: str) -> DataFrame:
    """The files of a tree that may hold credentials by their names, as ``read_tree``, whatever ignore files say; larger ones than HARVEST takes have null content."""
    import json
    from dataclasses import asdict

    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("scan", json.dumps(asdict(HARVEST))).option("sensitive", "true").load(root)


def ignored_by(rel: str, lines: list[str]) -> bool:
    """Whether a path is ignored by the lines of one ignore file at the root."""
    return is_ignored(rel, compile_lines(lines))
