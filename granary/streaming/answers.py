"""A model's answer as it streams in, and documents as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class ThoughtFilter:
    """Passes on the pieces of an answer without its think blocks, whose tags may be cut anywhere."""

    TAGS = (("<think>", "</think>"), ("<thinking>", "</thinking>"))

    def __init__(self) -> None:
        self.held, self.closing = "", ""
        self.trim = False

    def feed(self, piece: str) -> str:
        self.held += piece
        out = ""
        while True:
            if self.closing:
                at = self.held.find(self.closing)
                if at < 0:
                    self.held = self.held[-(len(self.closing) - 1) :]
                    return out
                self.held, self.closing, self.trim = self.held[at + len(self.closing) :], "", True
            if self.trim:
                self.held = self.held.lstrip()
                if not self.held:
                    return out
                self.trim = False
            found = min(((self.held.find(o), c, o) for o, c in self.TAGS if o in self.held), default=None)
            if found:
                at, self.closing, tag = found
                out, self.held = out + self.held[:at], self.held[at + len(tag) :]
                continue
            keep = max((k for o, _ in self.TAGS for k in range(1, len(o)) if self.held.endswith(o[:k])), default=0)
            cut = len(self.held) - keep
            out, self.held = out + self.held[:cut], self.held[cut:]
            return out

    def finish(self) -> str:
        """What is left at the end; an unclosed block is dropped."""
        rest, self.held = ("" if self.closing else self.held), ""
        return rest


def ingest(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Handle new parquet files of a folder once each; what was handled is kept in the checkpoint."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
