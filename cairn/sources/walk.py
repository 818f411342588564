"""Complete listing of a mounted folder as a Spark data source.

Unlike Spark's own file listing it keeps empty files and names that start with
``_`` or ``.``, has modification times in nanoseconds, and gives what could not be
read as rows.  The driver lists the top folder only.  Every folder below it is walked
by ``slices`` tasks; each looks up the files whose path falls to it, so one
folder with a third of all files is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import cut_lineage

NAME = "cairn_tree"
TREE = "relative_path string, size_bytes long, mtime_ns long, problem string"


def _source() -> type:
    """The source class; made inside a function, it travels to the executors by value."""
    import os
    import stat
    import zlib

    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    schema_text = "relative_path string, size_bytes long, mtime_ns long, problem string"

    class Slice(InputPartition):
        def __init__(self, top: str | None, number: int, of: int) -> None:
            self.top, self.number, self.of = top, number, of

    class TreeReader(DataSourceReader):
        def __init__(self, options) -> None:
            self.root = options["path"]
            self.slices = int(options.get("slices", "4"))

        def partitions(self):
            folders = sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
            own = [Slice(None, i, self.slices) for i in range(self.slices)]
            return own + [Slice(f, i, self.slices) for f in folders for i in range(self.slices)]

        def _entry(self, path):
            name = os.path.relpath(path, self.root).replace(os.sep, "/")
            try:
                name.encode()
            except UnicodeEncodeError:
                return (ascii(name), None, None, "path is not valid text")
            try:
                found = os.lstat(path)
            except OSError as error:
                return (name, None, None, f"file cannot be read: {error.strerror}")
            if stat.S_ISLNK(found.st_mode):
                return (name, None, None, "link is not followed")
            return (name, found.st_size, found.st_mtime_ns, None) if stat.S_ISREG(found.st_mode) else None

        def _rows(self, part, folder, names):
            for name in names:
                path = os.path.join(folder, name)
                if zlib.crc32(os.fsencode(os.path.relpath(path, self.root))) % part.of == part.number:
                    row = self._entry(path)
                    if row is not None:
                        yield row

        def read(self, part):
            if part.top is None:
                yield from self._rows(part, self.root, [e.name for e in os.scandir(self.root) if not e.is_dir(follow_symlinks=False)])
                return
            lost = []
            for folder, _, names in os.walk(os.path.join(self.root, part.top), onerror=lost.append):
                yield from self._rows(part, folder, names)
            if part.number == 0:
                for error in lost:
                    place = os.path.relpath(error.filename, self.root).replace(os.sep, "/")
                    yield (ascii(place)[1:-1], None, None, f"folder cannot be read: {error.strerror}")

    class Tree(DataSource):
        @classmethod
        def name(cls):
            return "cairn_tree"

        def schema(self):
            return schema_text

        def reader(self, schema):
            return TreeReader(self.options)

    return Tree


def list_tree(spark: SparkSession, root: str, slices: int = 4) -> tuple[DataFrame, DataFrame]:
    """(listing, problems) of all regular files below ``root``.

    ``listing`` has the shape of a listing table; ``problems`` (relative_path,
    problem) are links, unreadable folders and files that went away during the walk.
    Both come from one walk.
    """
    if slices < 1:
        raise ValueError("slices must be positive")
    spark.dataSource.register(_source())
    found = cut_lineage(spark.read.format(NAME).option("slices", str(slices)).load(root))
    listing = found.where(F.col("problem").isNull()).select("relative_path", "size_bytes", "mtime_ns")
    return listing, found.where(F.col("problem").isNotNull()).select("relative_path", "problem")
