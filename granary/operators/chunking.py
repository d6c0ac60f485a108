"""Sections, subsections and overlapping chunks that end at sentences."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import profiles as P
from granary.functions.text import strip
from granary.operators.scan import pieces

# where a chunk may end, by profile: alternatives in order of rank, each with the characters it keeps
_ENDS = {
    "zh": [(re.compile(f"……”(?={P.HAN})"), 3), (re.compile(f"(?:。”|！”|？”|”。|）。)(?={P.HAN})"), 2), (re.compile(f"……(?={P.HAN})"), 2), (re.compile(f"[。！？](?={P.HAN})"), 1)],
    "latin": [(re.compile(r"[.!?](?=\s)"), 1)],
}


class Boundaries:
    """The next sentence end at or after a position: of the first pattern, in order of rank, that has one where the scan meets it."""

    def __init__(self, text: str, profile: str) -> None:
        at: dict[int, int] = {}
        for pattern, keep in _ENDS[profile]:
            for m in re.finditer(f"(?={pattern.pattern})", text):
                at.setdefault(m.start(), m.start() + keep)
        self.starts, self.n = sorted(at), len(text)
        self.ends = [at[s] for s in self.starts]

    def right(self, position: int) -> int:
        i = bisect_left(self.starts, position)
        return self.ends[i] if i < len(self.starts) else self.n


def windows(text: str, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP, profile: str = "latin") -> list[tuple[int, int]]:
    """Half-open chunks that cover the text. Up to `size` it is one chunk; a remainder of at most twice the size is cut in
    two balanced halves that overlap; else a chunk runs to the sentence end after `size` characters, and the next starts at
    the one after its last `overlap` characters. Ends are pushed back where a text has no sentence end left."""
    n = len(text)
    if n <= size:
        return [(0, n)] if n else []
    b, out = Boundaries(text, profile), []

    def halves(left: int) -> list[tuple[int, int]]:
        end = min(b.right((left + n) // 2 + overlap // 2), n - 1)
        if end <= left:
            end = min(left + size, n)
        start = min(b.right(max(left + 1, end - overlap)), n - 1, end)
        return [(left, end), (start, n)]

    right = 0
    while n - right > 2 * size:
        left = min(b.right(max(0, right - overlap)), right) if out else 0
        end = b.right(left + size)
        right = end if end > left else min(left + size, n)
        out.append((left, right))
    return out + halves(right) if right < n else out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP, profile: str = "latin") -> DataFrame:
    """(doc_id, chunk_no, left, right, text) of each chunk that isn't blank, its text stripped. A task holds the chunks of
    some megabytes of text at once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                kept = [(a, z) for a, z in windows(text, size, overlap, profile) if text[a:z].strip()]
                rows += [(doc_id, i, a, z, text[a:z].strip()) for i, (a, z) in enumerate(kept)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], names=["doc_id", "chunk_no", "left", "right", "text"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(cut, "doc_id long, chunk_no long, left long, right long, text string")


def sections(docs: DataFrame, heading: str = P.SECTION_LATIN, overview: str = "概述") -> DataFrame:
    """(doc_id, pos, section, body): parts start at lines that begin with a heading; what comes before is the overview."""
    part = F.posexplode(F.split("text", rf"\n[ 　]*(?={heading})"))
    own = docs.select("doc_id", part.alias("pos", "part")).withColumn("part", strip(F.col("part")))
    titled = F.regexp_like("part", F.lit(rf"^(?:{heading})"))
    own = own.withColumn("first", F.split("part", "\n")[0])
    rest = F.expr("substring(part, length(first) + 2)")
    return own.select("doc_id", "pos", F.when(titled, strip(F.col("first"))).otherwise(overview).alias("section"), F.when(titled, strip(rest)).otherwise(F.col("part")).alias("body"))


def subsections(bodies: DataFrame, id_col: str, text_col: str = "text", marker: str = P.SUBSECTION_ZH) -> DataFrame:
    """(id, pos, subsection, content): parts start behind lines that a marker (anchored to its line's ends) matches, and are
    named by its first digits, or the marker where it has none. What comes before the first is named ""; blank parts go. A
    body without markers is one part, blank or not."""
    own = bodies.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    part = F.posexplode(F.split("body", rf"(?md)(?={marker})"))
    own = own.select(id_col, part.alias("pos", "part"), F.regexp_like("body", F.lit(rf"(?md){marker}")).alias("marked"))
    own = own.withColumn("mark", F.regexp_extract("part", rf"(?md)\A{marker}", 0))
    digits = F.regexp_extract("mark", r"\d+", 0)
    content = F.when(F.col("marked"), strip(F.expr("substring(part, length(mark) + 1)"))).otherwise(F.col("part"))
    out = own.select(id_col, "pos", F.when(digits != "", digits).otherwise(strip(F.col("mark"))).alias("subsection"), content.alias("content"), "marked")
    return out.filter((F.col("content") != "") | ~F.col("marked")).drop("marked")


def structure_sample(c, head: int = 3000, size: int = 1000):
    """The head of a text and slices at its quarters that start after the head."""
    n = F.length(c)
    parts = [F.substring(c, 1, head)]
    for q in (0.25, 0.5, 0.75):
        at = F.floor(n * q).cast("int")
        parts.append(F.when(at > head, F.substr(c, at + 1, F.lit(size))))
    return F.concat_ws("\n...\n", *parts)


def heading_format(c):
    """"hui" where chapter headings outnumber listed ones in the first 3000 characters, else "dun"."""
    head = F.substring(c, 1, 3000)
    return F.when(F.regexp_count(head, F.lit(P.HEAD_HUI)) > F.regexp_count(head, F.lit(P.HEAD_DUN)), "hui").otherwise("dun")
