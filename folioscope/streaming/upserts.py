"""Enrichment state fed by micro-batches. The operators are batch functions of (state, new rows); this applies them from foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from folioscope.operators.enrich import upsert_enrichment
from folioscope.operators.rank import first_by
from folioscope.operators.state import PARTITIONS, apply_batch


def enrichment_sink(read_state: Callable[[], DataFrame], write_state: Callable[[DataFrame, int], None], order: list) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the first new row of each article by `order` is merged into the state; write_state gets the result and the batch
    id, and should write each batch id once (to a path of its own, say), so that a repeated batch changes nothing."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_state(upsert_enrichment(read_state(), first_by(batch, ["article_id"], order)), batch_id)

    return sink


def keyed_sink(root: str, order: list, schema: str, partitions: int = PARTITIONS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over a state kept in partitions: a batch rewrites those of its articles only, and a repeated one nothing."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        apply_batch(root, first_by(batch, ["article_id"], order), batch_id, upsert_enrichment, schema, "article_id", partitions)

    return sink
