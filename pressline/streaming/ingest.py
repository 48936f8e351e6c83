"""The first half of an ingestion run on pages as they land."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from pressline.plans.ingestion import candidates
from pressline.sources.profiles import Profile
from pressline.streaming.intake import append_batch


def stream_candidates(
    pages: DataFrame, profiles: Mapping[str, Profile], links: Callable[[], DataFrame],
    incidents: Callable[[], DataFrame], keywords: Sequence[str], as_of: Column, path: str, checkpoint: str,
) -> StreamingQuery:
    """Judges the pages of each micro-batch like a batch run and appends the outcome to ``path``.

    ``links`` and ``incidents`` are read anew for each batch. Only links whose page is in the batch are
    judged; the others wait for theirs. A repeated batch overwrites its own folder.
    """
    write = append_batch(path)

    def judge(batch: DataFrame, batch_id: int) -> None:
        here = batch.select("source", "url").distinct()
        waiting = links().join(here, ["source", "url"], "left_semi")
        write(candidates(profiles, waiting, batch, incidents(), keywords, as_of), batch_id)

    return (
        pages.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(judge).start()
    )
