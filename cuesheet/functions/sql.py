"""One call registers the functions that SQL texts may use: seq_ratio, spoken_form, repair_json, glossary_apply and the
table functions split_for_display and split_long, which take a table:

    SELECT * FROM split_long(TABLE(segments), most_ms => 8000)
    SELECT * FROM split_for_display(TABLE(segments), lines => 2, line_words => 0, all_caps => false)

They deal rows by media and read them by start and segment, and give the rows of the operators of the same names."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from . import text as X

NEEDED = ["media_id", "seg_id", "start_ms", "end_ms", "text"]


def _rounded(x: float) -> int:
    return int(Decimal(repr(float(x))).quantize(Decimal(1), ROUND_HALF_UP))


def _described(segs: AnalyzeArgument, *fields: tuple[str, T.DataType]) -> AnalyzeResult:
    if not segs.isTable:
        raise ValueError("the first argument is a table: TABLE(name)")
    lacking = [n for n in NEEDED if n not in segs.dataType.fieldNames()]
    if lacking:
        raise ValueError(f"the table has no {', '.join(lacking)}")
    ids = [T.StructField(n, segs.dataType[n].dataType) for n in NEEDED[:2]]
    schema = T.StructType([*ids, *[T.StructField(n, t) for n, t in fields]])
    return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("media_id")], orderBy=[OrderingColumn("start_ms"), OrderingColumn("seg_id")])


def long_pieces(text: str, start: int, end: int, words: list | None, most: int) -> list[tuple[str, int, int]]:
    """Sentences, or else clauses, packed up to a length of time."""
    for marks in (r"[.!?;。！？；]", r"[,，、：:\-]"):
        cut = [p for p in re.split(rf"(?<={marks})\s*", text.strip(" "), flags=re.A) if p]
        if len(cut) > 1:
            break
    if end - start <= most or len(cut) < 2:
        return [(text, start, end)]
    whole, chunks = sum(map(len, cut)), []
    for p in cut:
        if chunks and (chunks[-1][1] + len(p)) / whole * (end - start) <= most:
            chunks[-1] = (f"{chunks[-1][0]} {p}", chunks[-1][1] + len(p))
        else:
            chunks.append((p, len(p)))
    bounds, upto = [start], 0
    for _, n in chunks[:-1]:
        upto += n
        heard, at = 0, bounds[-1] + n / whole * (end - start)
        for w in words or []:
            heard += len(w["word"])
            if heard >= upto and w["t1_ms"] is not None:
                at = w["t1_ms"]
                break
        bounds.append(_rounded(min(max(at, bounds[-1] + 100), end - 100)))
    if len(chunks) > 1:
        last = min(bounds[-1], end - 100)
        return [*((t, a, z) for (t, _), a, z in zip(chunks, bounds, bounds[1:])), (chunks[-1][0], last, end)]
    return [(chunks[0][0], start, end)]


class SplitLong:
    """Pieces of one media; those of segments that overlap wait until no earlier one can come, so that numbers follow time."""

    @staticmethod
    def analyze(segs: AnalyzeArgument, most_ms: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _described(segs, ("text", T.StringType()), ("start_ms", T.LongType()), ("end_ms", T.LongType()), ("new_id", T.IntegerType()))

    def __init__(self):
        self.media, self.given, self.waiting = None, 0, []

    def _due(self, before: tuple | None) -> Iterator[tuple]:
        while self.waiting and (before is None or self.waiting[0][:2] < before):
            start, seg, _, text, end = heapq.heappop(self.waiting)
            self.given += 1
            yield self.media, seg, text, start, end, self.given

    def eval(self, segs: Row, most_ms: int = 10_000):
        self.media = segs["media_id"]
        yield from self._due((segs["start_ms"], segs["seg_id"]))
        words = segs["words"] if "words" in segs.__fields__ else None
        start, end = segs["start_ms"], segs["end_ms"]
        pieces = [(None, start, end)] if segs["text"] is None else long_pieces(segs["text"], start, end, words, most_ms)
        for i, (text, a, z) in enumerate(pieces):
            heapq.heappush(self.waiting, (a, segs["seg_id"], i, text, z))

    def terminate(self):
        yield from self._due(None)


class Wrap:
    """The measures of display cues: how many letters or words a line and a cue hold."""

    def __init__(self, lines: int, line_words: int):
        from ..operators.media import LINE, LINE_ALONE

        self.width = LINE_ALONE if lines == 1 else LINE
        self.lines, self.line_words, self.most = lines, line_words, (line_words or self.width) * lines

    def size(self, text: str) -> int:
        return text.count(" ") + 1 if self.line_words else len(text)

    def grouped(self, text: str, n: int) -> list[str]:
        w = text.split(" ")
        return [" ".join(w[i : i + n]) for i in range(0, len(w), n)]

    def shown(self, text: str) -> str:
        if self.line_words:
            return "\n".join(self.grouped(text, self.line_words)[: self.lines])
        rows: list[str] = []
        for w in text.split(" "):
            if rows and len(rows[-1]) + 1 + len(w) <= self.width:
                rows[-1] += f" {w}"
            else:
                rows.append(w)
        return "\n".join(rows[: self.lines])

    def clause(self, part: str) -> tuple[list[str], str]:
        """What comes off a clause as cues of their own, and what may share a cue."""
        if self.line_words:
            *own, rest = self.grouped(part, self.most)
            return own, rest
        own, left = [], part.split(" ")
        while left and len(" ".join(left)) > self.most:
            n, used = 1, len(left[0])
            while n < len(left) and used + 1 + len(left[n]) <= self.width:
                used += 1 + len(left[n])
                n += 1
            own.append(" ".join(left[:n]))
            left = left[n:]
        return own, " ".join(left)

    def cues(self, text: str) -> list[str]:
        if self.size(text) <= self.most:
            return [text]
        out, cur = [], ""
        for part in re.split(r"(?<=[,.!?;…])\s+", text):
            own, rest = self.clause(part)
            if own:
                out += [cur] * (cur != "") + own
                cur = ""
            if rest and cur and self.size(f"{cur} {rest}") > self.most:
                out.append(cur)
                cur = rest
            elif rest:
                cur = f"{cur} {rest}" if cur else rest
        return out + [cur] * (cur != "")


class SplitForDisplay:
    """Cues of one media; a null or blank text has none."""

    @staticmethod
    def analyze(segs: AnalyzeArgument, lines: AnalyzeArgument | None = None, line_words: AnalyzeArgument | None = None, all_caps: AnalyzeArgument | None = None) -> AnalyzeResult:
        text, ms = T.StringType(), T.LongType()
        return _described(segs, ("pos", T.IntegerType()), ("text", text), ("lines", text), ("start_ms", ms), ("end_ms", ms))

    def eval(self, segs: Row, lines: int = 2, line_words: int = 0, all_caps: bool = False):
        from ..operators.media import LEAST_CUE_MS, PAUSE

        text = re.sub(r"\s+", " ", segs["text"] or "", flags=re.A).strip(" ")
        if not text:
            return
        wrap, start, end = Wrap(lines, line_words), segs["start_ms"], segs["end_ms"]
        cues = wrap.cues(text.upper() if all_caps else text)
        weights = [max(1.0, c.count(" ") + 1 + (PAUSE if c[-1] in ",;:—-…" else 0.0)) for c in cues]
        span, total, at = max(0, end - start), sum(weights, 0.0), float(start)
        for i, (cue, weight) in enumerate(zip(cues, weights, strict=True)):
            share = span * weight / total
            till = min(at + (max(share, LEAST_CUE_MS) if span >= LEAST_CUE_MS * len(cues) else share), end)
            till = float(end) if i == len(cues) - 1 else till
            yield segs["media_id"], segs["seg_id"], i, cue, wrap.shown(cue), _rounded(at), _rounded(till)
            at = till


def register(spark: SparkSession, glossary: list[tuple[str, str]] | None = None) -> None:
    spark.udf.register("seq_ratio", X.ratio_udf())
    spark.udf.register("spoken_form", X.spoken_udf())
    spark.udf.register("repair_json", X.repair_udf())
    spark.udf.register("glossary_apply", X.glossary_udf(glossary or []))
    spark.udtf.register("split_for_display", F.udtf(SplitForDisplay))
    spark.udtf.register("split_long", F.udtf(SplitLong))
