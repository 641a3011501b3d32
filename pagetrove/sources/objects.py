"""Feed objects with exact numbers: a data source sink that publishes whole folders on commit."""

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..schemas import RAW_PAGE
from .feed import ITEMS_PER_OBJECT

FORMAT = "feed_objects"


def _sink() -> type:
    """The data source. It is made here, so that it travels to executors by value and they need no package."""
    import posixpath
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    @dataclass
    class Written(WriterCommitMessage):
        folder: str
        objects: int

    class Writer(DataSourceArrowWriter):
        """Lines come by part, in order. A part is ``share`` rows, whole objects; only the last is shorter."""

        def __init__(self, options):
            self.path, self.staging = options["path"].rstrip("/"), options["staging"]
            self.rows, self.share, self.per_object = (int(options[n]) for n in ("rows", "share", "per_object"))

        def files(self, path):
            from urllib.parse import urlparse

            from pyarrow import fs

            if path.startswith("file:"):
                path = urlparse(path).path
            return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

        def write(self, iterator):
            from uuid import uuid4

            # An attempt owns its folder; only folders that a message names are published.
            folder = posixpath.join(self.staging, f"part-{uuid4().hex}")
            files, root = self.files(folder)
            files.create_dir(root, recursive=True)
            part, place, written, out = None, 0, 0, None

            def check():
                if part is not None and place != min(self.share, self.rows - part * self.share):
                    raise ValueError("the order of feed objects is not unique, or the pages changed while being numbered")

            try:
                for batch in iterator:
                    for own, line in zip(batch.column("part").to_pylist(), batch.column("line").to_pylist()):
                        if own != part:
                            check()
                            part, place = own, 0
                        if place % self.per_object == 0:
                            if out is not None:
                                out.close()
                            number = (part * self.share + place) // self.per_object + 1
                            out = files.open_output_stream(posixpath.join(root, f"{number}.json"))
                            written += 1
                        out.write(line.encode() + b"\n")
                        place += 1
                check()
            finally:
                if out is not None:
                    out.close()
            return Written(folder, written)

        def commit(self, messages):
            from pyarrow import fs

            files, staging = self.files(self.staging)
            keep = {posixpath.basename(m.folder) for m in messages if m is not None and m.objects}
            if sum(m.objects for m in messages if m is not None) != -(-self.rows // self.per_object):
                raise ValueError("objects are missing")
            files.create_dir(staging, recursive=True)
            for attempt in files.get_file_info(fs.FileSelector(staging)):
                if attempt.base_name not in keep:
                    files.delete_dir(attempt.path)
            _, path = self.files(self.path)
            files.create_dir(posixpath.dirname(path), recursive=True)
            files.move(staging, path)

        def abort(self, messages):
            from pyarrow import fs

            files, staging = self.files(self.staging)
            if files.get_file_info(staging).type != fs.FileType.NotFound:
                files.delete_dir(staging)

    class FeedObjects(DataSource):
        @classmethod
        def name(cls):
            return "feed_objects"

        def writer(self, schema, overwrite):
            return Writer(self.options)

    return FeedObjects


def write_feed_objects(pages: DataFrame, path: str, order: list[str], per_object: int = ITEMS_PER_OBJECT) -> None:
    """Write JSON-lines objects ``<path>/part-*/<n>.json`` of exactly ``per_object`` pages; the last may hold fewer.

    Object n holds the n-th share of the pages by ``order``, nulls first. The order must tell all pages apart; if it does
    not, the job fails. Numbering reads the columns of the order only. The numbers say at which keys the
    pages are cut into tasks of whole objects, one key a task, and the pages are moved once. The folder appears at
    ``path`` in one move when every task is done; a path that exists is refused, and a failed job leaves nothing. An empty table gives an
    empty folder.
    """
    spark = pages.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        raise FileExistsError(path)
    numbered = number_rows(pages.select(*order), order)
    rows = numbered.count()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = per_object * max(1, math.ceil(rows / per_object / parts))
    key = F.struct(*[F.col(name) for name in order])
    # One key a task but the first.
    cuts = numbered.where((F.col("_number") > 1) & ((F.col("_number") - 1) % share == 0)).orderBy("_number").select(*order).collect()
    types = pages.schema
    bounds = [F.struct(*[F.lit(cut[name]).cast(types[name].dataType).alias(name) for name in order]) for cut in cuts]
    part = F.size(F.filter(F.array(*bounds), lambda bound: bound <= key)) if bounds else F.lit(0)
    # Explicit nulls, so that a missing key and a null value stay apart.
    line = F.to_json(F.struct(*RAW_PAGE.names), {"ignoreNullFields": "false"})
    placed = pages.select(part.alias("part"), key.alias("key"), line.alias("line"))
    lines = placed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key")
    spark.dataSource.register(_sink())
    lines.select("part", "line").write.format(FORMAT).mode("append").options(
        path=path, staging=f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}", rows=rows, share=share, per_object=per_object
    ).save()
