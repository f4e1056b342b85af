"""Reads that arrive as a stream: every micro-batch is a cohort with insert sizes of its own."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandline.align import alt, flow, index
from strandline.align.options import DEFAULTS, Options

#: Characters that no micro-batch has: its reads are one batch.
WHOLE = 1 << 62


def align_stream(reads: DataFrame, ref: index.Index, out: str, checkpoint: str, o: Options = DEFAULTS, lifts: dict[int, alt.Lift] | None = None, **trigger) -> StreamingQuery:
    """SAM lines of the streaming ``reads`` as Parquet (batch, read_id, rec_ix, line) in ``out``.

    A batch that is run again after a failure writes over what it had written,
    so every read has its records once. A pair's two rows must arrive in one
    batch. ``trigger`` is what ``DataStreamWriter.trigger`` takes.
    """

    def one(batch: DataFrame, number: int) -> None:
        lines = flow.align(batch, ref, replace(o, batch_bases=WHOLE), lifts)
        lines.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
