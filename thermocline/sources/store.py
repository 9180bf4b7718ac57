"""File operations on whatever file system the tables lie on."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """Thin layer over Hadoop's FileSystem, so that local folders, HDFS and object stores work alike."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def files(self, folder: str) -> list[tuple[str, int, int]]:
        """``(path, bytes, modified ms)`` of all files below a folder."""
        p, out = self._path(folder), []
        if not self._fs.exists(p):
            return out
        it = self._fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            out.append((self.plain(s.getPath().toString()), s.getLen(), s.getModificationTime()))
        return out

    def write_text(self, path: str, text: str) -> None:
        """Writes a new file; fails if there is one."""
        stream = self._fs.create(self._path(path), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def read_text(self, path: str) -> str:
        io = self.spark._jvm.org.apache.commons.io.IOUtils
        stream = self._fs.open(self._path(path))
        try:
            return io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def footer(self, path: str, column: str) -> tuple[int | None, int | None, int] | None:
        """Lowest and highest value of a column and the number of rows of a Parquet file, by its footer alone; None where that doesn't tell the range."""
        parquet = self.spark._jvm.org.apache.parquet.hadoop
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(self._path(path), self._conf))
        try:
            low = high = None
            rows, blocks = 0, reader.getFooter().getBlocks()
            for i in range(blocks.size()):
                block = blocks.get(i)
                rows += block.getRowCount()
                columns = block.getColumns()
                stats = next((c.getStatistics() for c in (columns.get(j) for j in range(columns.size())) if c.getPath().toDotString() == column), None)
                if stats is None or stats.isEmpty():
                    return None
                if not stats.hasNonNullValue():
                    if stats.getNumNulls() != block.getRowCount():
                        return None
                    continue
                least, most = stats.genericGetMin(), stats.genericGetMax()
                if not isinstance(least, int):
                    return None
                low, high = least if low is None else min(low, least), most if high is None else max(high, most)
            return low, high, rows
        finally:
            reader.close()

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    @staticmethod
    def plain(path: str) -> str:
        """A path without the several spellings of the local scheme."""
        if path.startswith("file:"):
            return "/" + path[5:].lstrip("/")
        return path
