"""Files and folders of whatever file system a path belongs to, by the cluster's own client."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import SparkSession


class Files:
    """Existence, listing, reading, writing, renaming and deleting, for paths with or without a scheme."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def system(self, path: str):
        return self.path(path).getFileSystem(self.conf)

    def full(self, path: str) -> str:
        return self.system(path).makeQualified(self.path(path)).toString()

    def exists(self, path: str) -> bool:
        return self.system(path).exists(self.path(path))

    def is_file(self, path: str) -> bool:
        return self.exists(path) and self.system(path).getFileStatus(self.path(path)).isFile()

    def below(self, folder: str) -> list[str]:
        """All files in a folder and its subfolders, hidden ones left out."""
        found, it = [], self.system(folder).listFiles(self.path(folder), True)
        while it.hasNext():
            name = it.next().getPath()
            if not name.getName().startswith((".", "_")):
                found.append(name.toString())
        return found

    def size(self, path: str) -> int:
        return self.system(path).getFileStatus(self.path(path)).getLen()

    def read(self, path: str) -> str:
        stream = self.system(path).open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A new file; one in place is an error."""
        stream = self.system(path).create(self.path(path), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        return self.system(old).rename(self.path(old), self.path(new))

    def make(self, folder: str) -> None:
        self.system(folder).mkdirs(self.path(folder))

    def delete(self, path: str) -> None:
        self.system(path).delete(self.path(path), True)


def resolve(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = (".parquet", ".jsonl", ".jsonl.gz"), include: list[str] | None = None) -> list[str]:
    """Files of a list of files and folders, once each, in case-folded order. ``include`` are patterns of the name or of the path inside its folder. A missing path,
    or nothing found, is an error."""
    files = Files(spark)
    found: set[str] = set()
    for p in paths:
        if not files.exists(p):
            raise FileNotFoundError(p)
        if files.is_file(p):
            found.add(files.full(p))
            continue
        root = files.full(p).rstrip("/") + "/"
        for full in files.below(p):
            name, inside = full.rsplit("/", 1)[-1], full.removeprefix(root)
            if name.endswith(suffixes) and (not include or any(fnmatch(name, x) or fnmatch(inside, x) for x in include)):
                found.add(full)
    if not found:
        raise FileNotFoundError(f"no {'/'.join(suffixes)} files in {paths}")
    return sorted(found, key=str.casefold)
