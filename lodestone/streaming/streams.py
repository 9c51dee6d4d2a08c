"""Event streams: reassembly, null frames, rate limits, windows, cache replay; batch forms and forms with state across micro-batches."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The frame that is taken out, and the white space around a line that does not count.
_NULL, _WHITE = "data: null", " \t\n\x0b\x0c\r"


def reassembled(tokens: DataFrame) -> DataFrame:
    """stream, answer: token events (stream, seq, text) put together."""
    return tokens.groupBy("stream").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "text"))).getField("text"), "").alias("answer"))


def without_null_frames(chunks: DataFrame) -> DataFrame:
    """stream, text: `data: null` lines and the one blank line after each are gone, all else is as it was.

    Lines are compared without the white space around them.  Chunks (stream, seq, text) may split
    anywhere, so lines are looked at after joining; what stands after the last newline goes only if it is a null frame.
    """
    lines = reassembled(chunks).select("stream", F.split("answer", "\n").alias("l"))
    bare = lines.select("*", F.transform("l", lambda x: F.regexp_replace(x, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")).alias("t"))
    last = F.size("l") - 1
    keep = F.filter(
        F.transform("l", lambda x, i: F.struct(F.when(i < last, F.concat(x, F.lit("\n"))).otherwise(x).alias("x"), i.alias("i"))),
        lambda e: (F.get("t", e["i"]) != "data: null") & ~((F.get("t", e["i"]) == "") & (e["i"] > 0) & (F.get("t", e["i"] - 1) == "data: null") & (e["i"] < last)),
    )
    return bare.select("stream", F.array_join(F.transform(keep, lambda e: e["x"]), "").alias("text"))


_TEXT = "stream long, seq long, text string"


def null_frames_removed(chunks: DataFrame) -> DataFrame:
    """`without_null_frames` on a stream: pieces (stream, seq, text) as soon as their lines are whole, to be joined by seq.

    chunks: stream, seq (0, 1, ... in each stream), text, done (true with a stream's last chunk).  What waits between micro-batches
    is a stream's unfinished line, whether a blank line is still to go, and chunks that came before an earlier one.  A
    chunk that comes again is ignored while its stream goes on; a stream that is done is forgotten.
    """

    def repaired(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, part, blank, waiting = state.get if state.exists else (0, "", False, "{}")
        ahead = {int(k): v for k, v in json.loads(waiting).items()}
        for pdf in frames:
            ahead |= {int(q): (t or "", bool(d)) for q, t, d in zip(pdf["seq"], pdf["text"], pdf["done"], strict=True) if q >= at}
        first, out, done = at, [], False
        while not done and at in ahead:
            text, done = ahead.pop(at)
            at += 1
            *whole, part = (part + text).split("\n")
            for line in whole:
                bare = line.strip(_WHITE)
                null, after = bare == _NULL, blank and not bare
                blank = null
                if not null and not after:
                    out.append(line + "\n")
        if done:
            out += [part] if part.strip(_WHITE) != _NULL else []
            state.remove()
        else:
            state.update((at, part, blank, json.dumps(ahead)))
        if out:
            yield pd.DataFrame({"stream": [key[0]], "seq": [first], "text": ["".join(out)]})

    kept = "next long, part string, blank boolean, waiting string"
    return chunks.groupBy("stream").applyInPandasWithState(repaired, _TEXT, kept, "append", GroupStateTimeout.NoTimeout)


def rate_limited_stream(events: DataFrame, limit: int, window_s: int = 60, late: str = "5 minutes") -> DataFrame:
    """`rate_limited` on a stream of events (client, ts, event_id): client, ts, event_id, admitted.

    A client's windows are counted until the watermark has passed them; events later than that fall away.
    Of one window's events those of an earlier micro-batch count first.
    """

    def admitted(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = {int(k): v for k, v in json.loads(state.get[0]).items()} if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
            ok = []
            for at in (rows["ts"].astype("int64") // 10**9 if rows["ts"].dtype == "datetime64[ns]" else rows["ts"].map(pd.Timestamp.timestamp).astype("int64")):
                counts[at // window_s] = counts.get(at // window_s, 0) + 1
                ok.append(counts[at // window_s] <= limit)
            yield rows.assign(client=key[0], admitted=ok)[["client", "ts", "event_id", "admitted"]]
        mark = state.getCurrentWatermarkMs() // 1000
        counts = {w: n for w, n in counts.items() if (w + 1) * window_s > mark}
        if counts:
            state.update((json.dumps(counts),))
            state.setTimeoutTimestamp(max(mark * 1000 + 1, (max(counts) + 1) * window_s * 1000))
        else:
            state.remove()

    timed = events.select("client", "ts", "event_id").withWatermark("ts", late)
    return timed.groupBy("client").applyInPandasWithState(admitted, "client long, ts timestamp, event_id long, admitted boolean", "counts string", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited(events: DataFrame, limit: int, window: str = "1 minute") -> DataFrame:
    """events (client, ts, event_id) with admitted: the first `limit` of each client's fixed window."""
    w = Window.partitionBy("client", F.window("ts", window)).orderBy("ts", "event_id")
    return events.withColumn("admitted", F.row_number().over(w) <= limit)


def window_counts(events: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """client, start, n: works on a stream as well; rows later than the watermark fall away there."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy("client", F.window("ts", window).alias("w")).agg(F.count("*").alias("n")).select("client", F.col("w.start").alias("start"), "n")


def cache_replay(lookups: DataFrame, capacity: int = 256, ttl_s: float = 300.0) -> DataFrame:
    """cache, hits, misses of a least-recently-used cache with expiry over lookups (cache, at, seq, key): rows stream through in order."""

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, hits, misses = None, OrderedDict(), 0, 0
        for pdf in frames:
            done = []
            for cache, at, key in zip(pdf["cache"], pdf["at"], pdf["key"], strict=True):
                if cache != now:
                    if now is not None:
                        done.append((now, hits, misses))
                    now, held, hits, misses = cache, OrderedDict(), 0, 0
                if key in held and at - held[key] < ttl_s:
                    hits += 1
                    held.move_to_end(key)
                else:
                    misses += 1
                    held[key] = at
                    held.move_to_end(key)
                    if len(held) > capacity:
                        held.popitem(last=False)
            if done:
                yield pd.DataFrame(done, columns=["cache", "hits", "misses"])
        if now is not None:
            yield pd.DataFrame([(now, hits, misses)], columns=["cache", "hits", "misses"])

    return lookups.repartition("cache").sortWithinPartitions("cache", "at", "seq").select("cache", "at", "key").mapInPandas(replay, "cache string, hits long, misses long")
