"""The one-question-at-a-time path for a live source: each micro-batch is answered
with the batch plan. No state is kept between batches, and what a batch staged is removed
when the sink has returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from lanternfold.plans.answer import answer
from lanternfold.session import short_lived


def answer_stream(questions: DataFrame, sink: Callable[[DataFrame, int], None], **options) -> DataStreamWriter:
    """``questions(question_id, question)`` as a stream -> responses handed to ``sink``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        with short_lived():
            sink(answer(batch, **options), batch_id)

    return questions.writeStream.foreachBatch(handle)
