"""Following a log of events while it grows: a streaming source whose offset is the event id.

The log is a folder of Parquet files to which writers add files; its ids rise. A tail begins behind a cursor, an id, and each batch takes
the ids behind the last one taken, up to the greatest that is there. The checkpoint holds that id, so a tail that is
started anew goes on behind it, and a batch that is run again has the same ids: nothing is lost or repeated."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagemill.streaming.events import EVENTS

NAME, ID, BEFORE_ALL, ROWS = "event_tail", "event_id", -1, 8192
# Types of the events that end a job's log.
LAST = ["job.completed", "job.failed", "job.cancelled"]


class Group(InputPartition):
    """A row group of a file, and the ids asked of it: above ``start``, up to ``end``."""

    def __init__(self, path: str, group: int, start: int, end: int):
        self.path, self.group, self.start, self.end = path, group, start, end


class TailReader(DataSourceStreamReader):
    """Plans by the footers of files, each read once, as a file does not change; rows are read by tasks, a row group each."""

    def __init__(self, path: str, cursor: int, schema: StructType):
        self.path, self.cursor, self.schema = path, cursor, schema
        self.footers: dict[str, list[tuple[int, int, int]]] = {}

    def _look(self) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        there = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        for info in there:
            below = info.path[len(root) :].strip("/").split("/")
            if info.type != pafs.FileType.File or any(p.startswith(("_", ".")) for p in below) or info.path in self.footers:
                continue
            with fs.open_input_file(info.path) as f:
                self.footers[info.path] = list(_ranges(pq.ParquetFile(f)))

    def initialOffset(self) -> dict:
        return {ID: self.cursor}

    def latestOffset(self) -> dict:
        self._look()
        return {ID: max((high for groups in self.footers.values() for _, _, high in groups), default=self.cursor)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._look()  # after a restart a batch may be planned before the folder was looked at
        low, high = start[ID], end[ID]
        return [Group(path, n, low, high) for path, groups in sorted(self.footers.items()) for n, least, most in groups if most > low and least <= high]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        wanted = to_arrow_schema(self.schema)
        with fs.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(ROWS, row_groups=[partition.group], columns=wanted.names):
                ids = batch.column(ID)
                batch = batch.filter(pc.and_(pc.greater(ids, partition.start), pc.less_equal(ids, partition.end)))
                if batch.num_rows:
                    columns = [batch.column(x.name).cast(x.type, safe=False) if x.name in batch.schema.names else pa.nulls(batch.num_rows, x.type) for x in wanted]
                    yield pa.RecordBatch.from_arrays(columns, schema=wanted)


def _ranges(file: pq.ParquetFile) -> Iterator[tuple[int, int, int]]:
    """(row group, least id, greatest id) of those with ids; from the footer, or from the column where that does not tell."""
    at = file.schema_arrow.get_field_index(ID)
    for n in range(file.num_row_groups):
        told = file.metadata.row_group(n).column(at).statistics
        if told is not None and told.has_min_max:
            yield n, told.min, told.max
        else:
            both = pc.min_max(file.read_row_group(n, columns=[ID]).column(0)).as_py()
            if both["min"] is not None:
                yield n, both["min"], both["max"]


class EventTail(DataSource):
    """Options: ``path``, a URI or an absolute path that the driver and all executors can read; ``cursor``, the id to begin behind, -1 by default."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("cursor", BEFORE_ALL)), schema)


def follow(spark: SparkSession, path: str, cursor: int = BEFORE_ALL) -> DataFrame:
    """A stream of the events (EVENTS) of a folder whose ids are above a cursor; of an empty or missing folder, what will come.

    Of a started query the checkpoint decides, not the cursor. Null ids are never behind a cursor and do not come; a repeated id comes
    as often as it is there. An id that shows up after a greater one has been taken is passed over, as in any read by cursor:
    files of lower ids have to be there first. Columns that a file lacks are null, others are not read. The trigger availableNow takes all
    that is there as one batch; after a failure it takes the batch that failed, and the next start what has come since."""
    spark.dataSource.register(EventTail)
    return spark.readStream.format(NAME).option("path", path).option("cursor", str(cursor)).load()


def frames(events: DataFrame) -> DataFrame:
    """(job_id, event_id, frame): each event as a frame that carries its id, so that a reader that comes back names the last it had. The frame of an event that
    ends its job's log is followed by one of type "end". A payload that is no JSON is a text; what is null is not told."""
    payload = F.coalesce(F.try_parse_json("payload"), F.parse_json(F.to_json(F.col("payload").cast("variant"))))
    data = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("type").alias("event_type"), payload.alias("payload"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at")))
    frame = F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\nevent: "), F.coalesce("type", F.lit("message")), F.lit("\ndata: "), data, F.lit("\n\n"))
    end = F.when(F.col("type").isin(LAST), "event: end\ndata: {}\n\n").otherwise("")
    return events.select("job_id", "event_id", F.concat(frame, end).alias("frame"))
