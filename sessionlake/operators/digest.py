"""One narrow row per event, with what reports need of its payload.

A report over whole sessions asks a log for sums, openers of side calls, call ids and
errors. Read one by one, each would read and parse the payloads again. A digest reads them
once and is written to the shared folder; it stands for the log wherever no payload text
is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake import vocabulary as V
from sessionlake.functions.payload import with_payload
from sessionlake.functions.text import error_excerpt, error_text
from sessionlake.operators.events import EVENT_COLUMNS
from sessionlake.operators.toolcalls import with_call_ids
from sessionlake.operators.transcript import EXCERPT, SAID
from sessionlake.workspace import written


def digested(events: DataFrame) -> DataFrame:
    """The events without their payload: their typed fields (see `with_payload`), the ids of a
    response's calls, and what an error says. A table of its own."""
    fields = with_payload(events.select(*EVENT_COLUMNS, "payload"))
    failed = F.col("event_type") == V.LLM_ERROR
    told = with_call_ids(fields).withColumns({
        SAID: F.when(failed, error_text(F.col("payload"))), EXCERPT: F.when(failed, error_excerpt(F.col("payload")))})
    return written(told.drop("payload"), "digest")
